"""Quality rules: fixed text statistics, then line labelling by a conditional random field.

A document is the sequence of its lines. Each line is described by a few
categories (length, shares of symbols, bars, capitals, digits, repeated words,
its ending, whether it repeats an earlier line); a linear-chain random field
decoded by Viterbi marks it as content or boilerplate. A document is kept if
enough of its words stand in content lines and the base rules pass.

Training reads a bounded sample of labelled documents (``SAMPLE_DOCS`` of each
class, by hash of the id); all lines of a good one are taken as content, those
of a bad one as boilerplate. Everything else reads every row whole.

Defined cases: null text counts as empty: no words, so the base rule rejects it;
without labelled documents of both classes the field is not used and the base
rules decide; repeated rows repeat their result; an empty table gives an empty
result; columns other than id and text are not read by the query, and the
filter passes all columns on unchanged.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossframe.llm.common import id_and_text, map_arrow, slices, string_hashes, text_buffers, window_hashes, word_bounds
from lossframe.llm.crf import Crf, train

#: Labelled documents of each class that training reads, and lines of each class.
SAMPLE_DOCS, SAMPLE_LINES = 1500, 60_000
#: Of one document training takes at most this part of a class's lines: its first 3,000.
DOC_SHARE = 20
#: A document is kept if at least this share of its words stands in content lines.
CONTENT_SHARE = 0.5
CONTENT, BOILERPLATE = 0, 1
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL = _flags(b"#*$%&|<>")
_BAR, _DIGIT, _BANG = _flags(b"|"), _flags(b"0123456789"), _flags(b"!")
_UPPER = _flags(bytes(range(65, 91)))
_LETTER = _flags(bytes([*range(65, 91), *range(97, 123)]))
_END = _flags(b".?!")
_NOT_CONTINUED = np.arange(256) & 0xC0 != 0x80  # every byte that begins a code point


def _sums(flag: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flag) + 1, np.int64 if len(flag) >= 1 << 31 else np.int32)
    np.cumsum(flag, out=total[1:])
    return (total[end] - total[start]).astype(np.int64)


def line_bounds(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""(start, end, document) of the \n-split lines of every document, empty ones included."""
    breaks = np.flatnonzero(raw == 10)
    start = np.sort(np.concatenate([offs[:-1], breaks + 1]))
    end = np.sort(np.concatenate([offs[1:], breaks]))
    # both have one line per document more than there are breaks; ties keep document order
    n_lines = 1 + _sums(raw == 10, offs[:-1], offs[1:])
    return start, end, np.repeat(np.arange(len(offs) - 1), n_lines)


def _repeats_earlier(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the same (document, key) stands further up."""
    order = np.lexsort((np.arange(len(key)), key, doc))
    again = np.zeros(len(key), bool)
    again[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    return again


#: Upper bounds of the categories of each template; a value falls in the first whose bound it does not exceed.
TEMPLATES = (
    ("words", (0, 2, 5, 10, 30, 100)),
    ("symbols per word", (0, 0.05, 0.2, 0.5, 0.9)),
    ("bars per word", (0, 0.05, 0.2, 0.4)),
    ("capitals per letter", (0, 0.05, 0.15, 0.4, 0.8)),
    ("digits per character", (0, 0.05, 0.2, 0.5)),
    ("exclamations per word", (0, 0.1, 0.5)),
    ("repeated words per word", (0, 0.1, 0.4)),
    ("characters per word", (2, 4, 6, 8, 12)),
    ("ends a sentence", (0,)),
    ("stood before", (0,)),
)
CATEGORIES = [len(b) + 1 for _, b in TEMPLATES]


class TextStats:
    """Statistics of the documents of one slice, by document and by line."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray):
        n_docs = len(offs) - 1
        start, end, doc = word_bounds(raw, offs)
        self.n_words = np.bincount(doc, minlength=n_docs)
        word = string_hashes(raw, start, end)
        chars = _sums(_NOT_CONTINUED[raw], start, end)
        self.word_chars = np.bincount(doc, chars, minlength=n_docs).astype(np.int64)
        self.n_symbols = _sums(_SYMBOL[raw], offs[:-1], offs[1:])
        self.n_repeat_words = self._covered(word, doc, n_docs)
        ls, le, ld = line_bounds(raw, offs)
        line_of_word = np.searchsorted(ls, start, side="right") - 1
        words = np.bincount(line_of_word, minlength=len(ls))
        before = _repeats_earlier(ld, string_hashes(raw, ls, le)) & (words > 0)
        self.n_dup_lines = np.bincount(ld, before, minlength=n_docs).astype(np.int64)
        same = np.zeros(len(word), bool)
        same[1:] = (word[1:] == word[:-1]) & (line_of_word[1:] == line_of_word[:-1])
        ends = np.zeros(len(ls), bool)
        if len(start):
            last = np.cumsum(words) - 1
            full = words > 0
            ends[full] = _END[raw[end[last[full]] - 1]]

        def per(x, y):
            return x / np.maximum(y, 1)

        sums = {k: _sums(f[raw], ls, le) for k, f in (("sym", _SYMBOL), ("bar", _BAR), ("up", _UPPER), ("let", _LETTER),
                                                      ("dig", _DIGIT), ("bang", _BANG))}
        size = np.bincount(line_of_word, chars, minlength=len(ls))
        values = (words, per(sums["sym"], words), per(sums["bar"], words), per(sums["up"], sums["let"]),
                  per(sums["dig"], size), per(sums["bang"], words),
                  per(np.bincount(line_of_word, same, minlength=len(ls)), words), per(size, words), ends, before)
        self.features = np.stack([np.searchsorted(np.array(b, float), v, side="left")
                                  for (_, b), v in zip(TEMPLATES, values)], axis=1)
        self.line_words, self.line_doc = words, ld
        self.n_lines = np.bincount(ld, minlength=n_docs)

    @staticmethod
    def _covered(word: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        """Words in windows that are found twice or more in their document."""
        if len(word) < WINDOW:
            return np.zeros(n_docs, np.int64)
        at = np.flatnonzero(doc[WINDOW - 1:] == doc[:len(doc) - WINDOW + 1])
        key, of = window_hashes(word, at, WINDOW), doc[at]
        order = np.lexsort((key, of))
        twin = (key[order[1:]] == key[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
        found = np.zeros(len(at), bool)
        found[order[1:]] |= twin
        found[order[:-1]] |= twin
        edge = np.zeros(len(word) + 1, np.int64)
        np.add.at(edge, at[found], 1)
        np.add.at(edge, at[found] + WINDOW, -1)
        return np.bincount(doc, np.cumsum(edge[:-1]) > 0, minlength=n_docs).astype(np.int64)

    def base_failed(self) -> np.ndarray:
        return (self.n_words < MIN_WORDS) | (100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words)

    def content_words(self, model: Crf | None) -> np.ndarray:
        """Words in lines that the field marks as content."""
        if model is None:
            return self.n_words
        content = model.decode(self.features, self.n_lines) == CONTENT
        return np.bincount(self.line_doc, self.line_words * content, minlength=len(self.n_words)).astype(np.int64)

    def kept(self, model: Crf | None) -> np.ndarray:
        return ~self.base_failed() & (self.content_words(model) >= CONTENT_SHARE * self.n_words)


def train_line_model(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS,
                     sample_lines: int = SAMPLE_LINES) -> Crf | None:
    """The line field, from at most ``sample_docs`` labelled documents of each class; None, with a warning, without both.

    Each class has ``sample_lines`` lines of its own (the document that reaches them still counts), and of one document
    the first ``sample_lines`` / ``DOC_SHARE`` are taken, so neither a class nor a long document can use up the other's.
    """
    doc_lines = max(1, sample_lines // DOC_SHARE)
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs) for q in (0, 1)]
    chosen = F.broadcast(picked[0].union(picked[1]))  # bounded by the limits; a repeated id gives its smallest text
    sample = id_and_text(docs).join(chosen, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1):
                s = TextStats(*text_buffers(part.column(1)))
                rows = [x[:doc_lines] for x in np.split(s.features.astype(np.int8), np.cumsum(s.n_lines)[:-1])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([r.tobytes() for r in rows], pa.binary())],
                                                 names=["doc_id", "quality", "features"])

    found = map_arrow(sample.select("doc_id", "text", F.col("quality").cast("long").alias("quality")), run,
                      "doc_id long, quality long, features binary").where(F.length("features") > 0)
    before = F.sum(F.length("features")).over(_by_hash()) - F.length("features")
    rows = found.withColumn("before", before).where(F.col("before") < sample_lines * len(TEMPLATES)).collect()
    if len({r.quality for r in rows}) < 2:
        warnings.warn("no line field: the labelled documents with lines are not of both classes", stacklevel=2)
        return None
    rows.sort(key=lambda r: (r.doc_id, r.quality, r.features))
    features = [np.frombuffer(bytes(r.features), np.int8).reshape(-1, len(TEMPLATES)).astype(np.int64) for r in rows]
    lengths = np.array([len(f) for f in features])
    gold = np.repeat([CONTENT if r.quality == 1 else BOILERPLATE for r in rows], lengths)
    return train(np.concatenate(features), gold, lengths, CATEGORIES, 2)


def _by_hash():
    from pyspark.sql import Window

    return Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def judge(docs: DataFrame, model: Crf | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base statistics, base_failed, kept, content_words of every row."""
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
             "content_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1):
                s = TextStats(*text_buffers(part.column(1)))
                longs = [pa.array(x, pa.int64()) for x in (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines,
                                                           s.n_repeat_words)]
                yield pa.RecordBatch.from_arrays([part.column(0), *longs, pa.array(s.base_failed()),
                                                  pa.array(s.kept(model)), pa.array(s.content_words(model), pa.int64())],
                                                 names=names)

    types = ["long"] * 6 + ["boolean"] * 2 + ["long"]
    return map_arrow(id_and_text(docs, id_col, text_col), run, ", ".join(f"{n} {t}" for n, t in zip(names, types)))


def keep_good(docs: DataFrame, model: Crf | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, all columns unchanged; one pass, no join."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.RecordBatch.from_arrays([pc.fill_null(b.column(at), "")], names=["text"])
            mask = [TextStats(*text_buffers(part.column(0))).kept(model) for part in slices(texts, 0)]
            if mask:
                yield b.filter(pa.array(np.concatenate(mask)))

    return map_arrow(docs, run, docs.schema)
