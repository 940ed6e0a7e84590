"""Personal data: fixed patterns, and a conditional random field over word shapes that adds what they miss.

A word can only belong to personal data of these kinds if it holds a digit or
an at sign. The stretches of such words, with two words of context on either
side, are the sequences of a linear-chain random field; all other words are
outside by definition. Its features are the words' shapes, digit counts and
neighbours. It is trained from a small labelled table: the examples below, and
a bounded sample of documents labelled by the fixed patterns (``SAMPLE_DOCS``,
by hash of the id). Sequences are decoded by Viterbi in numpy batches. Words
that it labels and no fixed pattern covers become spans of their own kinds.

Defined cases: null text counts as empty and has no spans; offsets are code
points, ends exclusive, ordered by start, then by the order of kinds; repeated
rows repeat their result; an empty table gives an empty result; columns other
than id and text are not read by the finder, and ``redact`` passes all columns
on (a null text stays null, a null n_chars too).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossframe.llm.common import id_and_text, map_arrow
from lossframe.llm.crf import Crf, train

BASE_KINDS = ("email", "ip", "card", "phone")
FIELD_KINDS = ("field_email", "field_ip", "field_card", "field_phone")
KINDS = BASE_KINDS + FIELD_KINDS
SAMPLE_DOCS = 400
CONTEXT = 2

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a digit run is tried from its first digit only: later starts in it fail alike
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: from each at sign back over the local part, then on over the domain."""
    cursor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > cursor and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            cursor = domain.end()
        at = text.find("@", max(at + 1, cursor))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the fixed patterns, sorted."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text)
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text)
            if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


# ---------------------------------------------------------------------------
# Sequences and features
# ---------------------------------------------------------------------------

_WORD = re.compile("[^\x20\x09-\x0d]+")
_MARK = re.compile("[0-9@]")


@dataclass
class Sequences:
    """Words of the stretches around marked words: (text index, start, end), and the stretches' lengths."""

    words: list[tuple[int, int, int]]
    lengths: list[int]


def stretches(texts: list[str]) -> Sequences:
    words, lengths = [], []
    for k, text in enumerate(texts):
        if not _MARK.search(text):
            continue
        own = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        starts = [s for s, _ in own]
        marked = sorted({int(i) for i in np.searchsorted(starts, [m.start() for m in _MARK.finditer(text)], side="right") - 1})
        last = -1
        for i in marked:
            lo, hi = max(i - CONTEXT, 0), min(i + CONTEXT, len(own) - 1)
            if lo > last or not lengths or last < 0:
                lengths.append(0)
                last = lo - 1
            fresh = [(k, *own[j]) for j in range(max(lo, last + 1), hi + 1)]
            words += fresh
            lengths[-1] += len(fresh)
            last = max(last, hi)
    return Sequences(words, lengths)


_CLASS = str.maketrans({**{c: "X" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "x" for c in "abcdefghijklmnopqrstuvwxyz"},
                        **{c: "d" for c in "0123456789"}})
_RUN = re.compile(r"([Xx])\1+")
_DIGIT_RUN = re.compile(r"d{5,}")
_DIGITS = re.compile(r"d+")


def shapes(word: str) -> tuple[str, str]:
    """(shape with the lengths of short digit runs, shape without lengths)."""
    s = _RUN.sub(r"\1", word[:80].translate(_CLASS))
    return _DIGIT_RUN.sub("D", s)[:24], _DIGITS.sub("d", s)[:16]


def checked(digits: str) -> int:
    """0: not as long as a card number, 1: its check digit is right, 2: it is wrong."""
    return 0 if not 13 <= len(digits) <= 19 else 1 if luhn(digits) else 2


_DIGIT_BOUNDS = np.array([0, 1, 2, 3, 4, 6, 9, 12, 13, 16, 19])


@dataclass
class PiiField:
    """The random field with the shapes and cue words it knows (category 0: unknown)."""

    crf: Crf | None
    fine: dict[str, int]
    coarse: dict[str, int]
    cues: dict[str, int]

    def features(self, texts: list[str], seq: Sequences) -> np.ndarray:
        known: dict[str, tuple[int, ...]] = {}
        rows = np.zeros((len(seq.words), 5), np.int64)
        for i, (k, s, e) in enumerate(seq.words):
            word = texts[k][s:e]
            row = known.get(word)
            if row is None:
                (fine, coarse), digits = shapes(word), _digits(word)
                row = known[word] = (self.fine.get(fine, 0), self.coarse.get(coarse, 0), self.cues.get(word.lower(), 0),
                                     int(np.searchsorted(_DIGIT_BOUNDS, len(digits))), checked(digits))
            rows[i] = row
        first = np.zeros(len(rows), bool)
        if seq.lengths:
            first[np.cumsum([0, *seq.lengths[:-1]])] = True
        last = np.roll(first, -1)
        before = np.where(first[:, None], 0, np.roll(rows, 1, axis=0))
        after = np.where(last[:, None], 0, np.roll(rows, -1, axis=0))
        return np.column_stack([rows[:, 0], rows[:, 1], rows[:, 3], rows[:, 4], before[:, 1], before[:, 2], after[:, 1]])

    def categories(self) -> list[int]:
        a, b, c = len(self.fine) + 1, len(self.coarse) + 1, len(self.cues) + 1
        return [a, b, len(_DIGIT_BOUNDS) + 1, 3, b, c, b]

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Base spans of each text and the field's spans that overlap none of them, sorted."""
        found = [base_spans(t) if _MARK.search(t) else [] for t in texts]
        if self.crf is None:
            return found
        seq = stretches(texts)
        if not seq.words:
            return found
        labels = self.crf.decode(self.features(texts, seq), np.array(seq.lengths))
        i = 0
        for n in seq.lengths:
            end = i + n
            while i < end:
                j = i + 1
                if labels[i]:
                    while j < end and labels[j] == labels[i]:
                        j += 1
                    k, s, e = seq.words[i][0], seq.words[i][1], seq.words[j - 1][2]
                    s, e = trimmed(texts[k], s, e)
                    clear = not any(s < y and x < e for x, kind, y in found[k] if kind < len(BASE_KINDS))
                    if clear and plausible(int(labels[i]) - 1, texts[k][s:e]):
                        found[k].append((s, len(BASE_KINDS) + int(labels[i]) - 1, e))
                i = j
        return [sorted(f) for f in found]


def plausible(kind: int, span: str) -> bool:
    """What a labelled span must hold at least to be of its kind."""
    n = len(_digits(span))
    return ("@" in span[1:-1], n >= 4 and span.count(".") == 3, 12 <= n <= 19, 7 <= n <= 15)[kind]


_EDGE = frozenset(".,;:!?\"'<>[]{}|*#$%&")


def trimmed(text: str, s: int, e: int) -> tuple[int, int]:
    """Without punctuation at the ends."""
    while s < e and text[s] in _EDGE:
        s += 1
    while s < e and text[e - 1] in _EDGE:
        e -= 1
    return s, e


# ---------------------------------------------------------------------------
# Training
# ---------------------------------------------------------------------------

#: Labelled examples: words between brackets with a kind are personal data, everything else is not.
EXAMPLES = """
call me at [phone (614) 555-8001] after noon
phone [phone 614-555-8001] or come by
tel [phone (017) 555-7713] and ask
her number is [phone 555-201-7713] , she said
fax [phone (243) 555-5526] for the form
mobile [phone 0171 5550934] any time
reach us under [phone +49 171 5550934] or later
the office , [phone +1 (803) 555-5351] opens early
write to [email jane.doe@example.com] soon
mail [email j_smith99@mail7.example.org] for more
contact [email info@shop-online.example.net] today
send it to [email 34@mail7.example.com] please
or to [email bob@intranet] at work
card [card 4111 1111 1111 1111] was used
paid with [card 5500-0000-0000-0004] last week
number [card 4012888888881881] on the bill
visa [card 4222222222222] was stolen
serial 4012888888881882 is printed on the part
article 5500000000000005 is out of stock
from [ip 192.168.4.17] at night
host [ip 97.51.17.173] answered
address [ip 10.0.0.254] is local
the server at [ip 137.187.58.226] is down
in 1998 there were 12 of them
on 2024-03-18 at 10:45 it ended
version 2.0.1 came out in 2021
about 3.5 million of 120 cases
pages 100-120 , see also 4.2 and 7
it cost $ 1,299.00 or 15 % less
the year 1845 and the 19th century
room 214 on floor 3 is free
section 3.1.4 of part 2
token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" in the file
order 100234 of 5 May 2020
a 10 km run in 45 minutes
the 1st , 2nd and 3rd of 40
call 911 or 112 in danger
@ the top of page 4
chapter 12 verse 7
isbn 978-3-16-148410-0 of the book
"""
_BRACKET = re.compile(r"\[(\w+) ([^\]]+)\]")


def read_examples(lines: str = EXAMPLES) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """(text, spans) of the labelled examples."""
    out = []
    for line in lines.strip().split("\n"):
        text, spans, done = "", [], 0
        for m in _BRACKET.finditer(line):
            text += line[done:m.start()]
            spans.append((len(text), BASE_KINDS.index(m[1]), len(text) + len(m[2])))
            text += m[2]
            done = m.end()
        out.append((text + line[done:], spans))
    return out


def _labels(seq: Sequences, spans: list[list[tuple[int, int, int]]]) -> np.ndarray:
    out = np.zeros(len(seq.words), np.int64)
    for i, (k, s, e) in enumerate(seq.words):
        for x, kind, y in spans[k]:
            if s < y and x < e:
                out[i] = kind + 1
    return out


def train_field(labelled: list[tuple[str, list[tuple[int, int, int]]]], rounds: int = 80) -> PiiField:
    """The field from texts with their spans; shapes and cue words seen twice or more are known to it."""
    texts, spans = [t for t, _ in labelled], [s for _, s in labelled]
    seq = stretches(texts)
    if not seq.words:
        return PiiField(None, {}, {}, {})
    words = [texts[k][s:e] for k, s, e in seq.words]

    def known(values, least: int) -> dict[str, int]:
        return {v: i for i, v in enumerate(sorted(v for v, n in Counter(values).items() if n >= least), 1)}

    field = PiiField(None, known((shapes(w)[0] for w in words), 2), known((shapes(w)[1] for w in words), 2),
                     known((w.lower() for w in words if not _MARK.search(w)), 2))
    gold = _labels(seq, spans)
    field.crf = train(field.features(texts, seq), gold, np.array(seq.lengths), field.categories(),
                      len(BASE_KINDS) + 1, rounds=rounds, ridge=1e-4)
    return field


def train_from(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> PiiField:
    """The field from the examples and at most ``sample_docs`` documents with marked words, labelled by the
    fixed patterns. Only the stretches with marks are fetched, as lines of words."""
    marked = id_and_text(docs).where(F.col("text").rlike("[0-9@]") & F.col("doc_id").isNotNull())
    # ids are picked without their texts, which would all meet in one task; a repeated id gives its smallest text
    ids = marked.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    picked = marked.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            lines = []
            for t in texts:
                seq = stretches([t])
                at, own = 0, []
                for n in seq.lengths[:50]:
                    own.append(t[seq.words[at][1]:seq.words[at + n - 1][2]][:2000])
                    at += n
                lines.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.list_(pa.string()))], names=["lines"])

    rows = map_arrow(picked, run, "lines array<string>").collect()
    sample = sorted(x for r in rows for x in r.lines)
    return train_field(read_examples() * 3 + [(t, base_spans(t)) for t in sample])


# ---------------------------------------------------------------------------
# Spark
# ---------------------------------------------------------------------------

def find_pii(docs: DataFrame, field: PiiField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>> of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for b in batches:
            rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]
                    for spans in field.spans(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(kind))], names=["doc_id", "spans"])

    return map_arrow(id_and_text(docs, id_col, text_col), run,
                     "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans go as one, named by the first."""
    out, done = [], 0
    for s, k, e in spans:
        if s >= done:
            out += [text[done:s], f"[{KINDS[k].removeprefix('field_')}]"]
        done = max(done, e)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, field: PiiField, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data replaced in the text, and the length column (if any) renewed."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pc.fill_null(b.column(at), "").to_pylist()
            clean = [redacted(t, s) if s else t for t, s in zip(texts, field.spans(texts))]
            columns = [pc.if_else(pc.is_null(c), None, pa.array(clean, c.type)) if i == at else c
                       for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    out = map_arrow(docs, run, docs.schema)
    if length_col and length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.when(F.col(length_col).isNotNull(), F.length(text_col).cast(kind)))
    return out
