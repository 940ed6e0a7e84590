"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its hashed character n-grams (3 to 5 code points, letters lower-cased in ASCII and
Latin-1), with further elements for n-grams that it has at least 2 and 4 times in 2048 code points on average
(a shorter text counts as that long). On labelled texts each element gets the log ratio of its smoothed shares in
toxic and in clean documents; a logistic regression is fitted on the sets scaled by these ratios. A document's
score is the regression's probability over all elements of its whole text.

Training reads a bounded sample (``SAMPLE_DOCS`` of each class, by hash of the id, texts of at most
``SAMPLE_CHARS`` code points) of the rows given as labelled; both classes are weighted back to their true
sizes. Scoring reads every row whole, in chunks, so a long text needs no more memory than a short one.

Defined cases: null text counts as empty, and an empty text has the score of no n-gram; labels other than 0
and 1 and labels without an id are unused; an id labelled twice counts as toxic if one label says so; without
labelled texts of both classes every score is the labelled share of toxic ones (0 without any), with a
warning; repeated rows repeat their result; an empty table gives an empty result; columns other than id and
text are not read by a score.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossframe.llm.common import id_and_text, map_arrow, slices, text_buffers

SIZES = (3, 4, 5)
#: Buckets of the hashed n-grams: the model is a table of this size for each level, whatever the corpus.
BUCKET_BITS = 18
#: Occurrences in ``RATE_CHARS`` code points from which an n-gram gives a further element.
LEVELS, RATE_CHARS = (2, 4), 2048
FEATURES = (1 + len(LEVELS)) << BUCKET_BITS
#: Labelled documents of each class that training reads, and the longest of their texts.
SAMPLE_DOCS, SAMPLE_CHARS = 2000, 10_000
#: An element is a feature if at least so many training texts have it and its log ratio is at least this far from 0.
MIN_DOCS, MIN_RATIO = 5, 1.0
SMOOTHING, L2, ROUNDS = 1.0, 1e-3, 150
#: Bytes of text that are hashed at once.
CHUNK = 1 << 20


def code_points(raw: np.ndarray) -> np.ndarray:
    """Lower-cased code points of UTF-8 bytes that begin and end with whole ones."""
    c = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).copy()
    c[((c >= 65) & (c <= 90)) | ((c >= 0xC0) & (c <= 0xDE) & (c != 0xD7))] += 32
    return c


def buckets(chars: np.ndarray, size: int) -> np.ndarray:
    """The bucket of every n-gram of that size, by its first position."""
    n = len(chars) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = (h ^ chars[k:k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def elements(raw: np.ndarray, offs: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, element) of the set of each text, by document; only n-grams whose bucket is ``wanted``, if given.

    The bytes are taken in chunks; an n-gram belongs to the chunk that it begins in.
    """
    first = raw & 0xC0 != 0x80
    first_at = np.concatenate([[0], np.cumsum(first)])
    doc_end = first_at[offs[1:]]  # in code points
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = 0
    while at < len(raw):
        end = min(at + CHUNK, len(raw))
        while end < len(raw) and not first[end]:
            end += 1
        over = min(end + 4 * max(SIZES), len(raw))
        while over < len(raw) and not first[over]:
            over += 1
        chars, own = code_points(raw[at:over]), int(first_at[end] - first_at[at])
        place = first_at[at] + np.arange(own)
        doc = np.searchsorted(doc_end, place, side="right")
        room = doc_end[doc] - place
        for size in SIZES:
            b = buckets(chars, size)[:own]
            ok = room[:len(b)] >= size
            if wanted is not None:
                ok &= wanted[b]
            key, n = np.unique((doc[:len(b)][ok] << BUCKET_BITS) | b[ok], return_counts=True)
            keys.append(key)
            counts.append(n)
        at = end
    key, of = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(of, np.concatenate(counts), minlength=len(key))
    doc, bucket = key >> BUCKET_BITS, key & ((1 << BUCKET_BITS) - 1)
    rate = n * RATE_CHARS / np.maximum(np.diff(first_at[offs])[doc], RATE_CHARS)
    docs, found = [doc], [bucket]
    for i, level in enumerate(LEVELS, 1):
        docs.append(doc[rate >= level])
        found.append(bucket[rate >= level] + (i << BUCKET_BITS))
    doc, found = np.concatenate(docs), np.concatenate(found)
    order = np.argsort(doc, kind="stable")
    return doc[order], found[order]


@dataclass(frozen=True)
class ToxicModel:
    """Weight of every element (ratio times regression weight) and the constant."""
    weights: np.ndarray
    constant: float

    def scores(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        doc, found = elements(raw, offs, (self.weights != 0).reshape(-1, 1 << BUCKET_BITS).any(axis=0))
        z = np.bincount(doc, self.weights[found], minlength=len(offs) - 1) + self.constant
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(sets: list[np.ndarray], toxic: np.ndarray, clean_weight: float = 1.0) -> ToxicModel:
    """The model of documents given as sets of elements. ``clean_weight`` is the weight of a clean one against a toxic one."""
    size = FEATURES
    n_toxic, n_clean = int(toxic.sum()), int((~toxic).sum())
    col = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    in_toxic = np.bincount(col[toxic[row]], minlength=size)
    in_clean = np.bincount(col[~toxic[row]], minlength=size)
    ratio = (np.log((in_toxic + SMOOTHING) / (n_toxic + 2 * SMOOTHING))
             - np.log((in_clean + SMOOTHING) / (n_clean + 2 * SMOOTHING)))
    feature = (in_toxic + in_clean >= MIN_DOCS) & (np.abs(ratio) >= MIN_RATIO)
    used = feature[col]
    place = np.cumsum(feature) - 1
    row, col = row[used], place[col[used]]
    value = ratio[feature][col]
    y = toxic.astype(np.float64)
    weight = np.where(toxic, 1.0, clean_weight)
    weight /= weight.mean() * len(y)
    theta = np.zeros(int(feature.sum()) + 1)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, ROUNDS + 1):  # gradient descent with moment estimates on the whole sample
        z = np.bincount(row, value * theta[col], minlength=len(y)) + theta[-1]
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.append(np.bincount(col, value * error[row], minlength=len(theta) - 1) + L2 * theta[:-1], error.sum())
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad * grad
        theta -= 0.05 * (mean / (1 - 0.9 ** t)) / (np.sqrt(square / (1 - 0.99 ** t)) + 1e-8)
    weights = np.zeros(size)
    weights[feature] = theta[:-1] * ratio[feature]
    return ToxicModel(weights, float(theta[-1]))


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic") -> ToxicModel:
    """The model of a bounded sample of the labelled documents."""
    marked = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
              .groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic")))
    texts = id_and_text(docs, id_col, text_col)
    short = texts.where(F.length("text").between(1, SAMPLE_CHARS))
    fitting = marked.join(short.select("doc_id"), "doc_id", "left_semi")
    count = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}

    def sample(toxic: int) -> DataFrame:
        return fitting.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)

    picked = sample(1).unionByName(sample(0))  # at most 2 * SAMPLE_DOCS ids
    chosen = short.join(F.broadcast(picked), "doc_id")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1):
                raw, offs = text_buffers(part.column(1))
                doc, found = elements(raw, offs)
                ends = np.searchsorted(doc, np.arange(len(offs)))
                sets = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(found.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), sets], names=["doc_id", "toxic", "sets"])

    # one text for each id, the smallest, whatever the order of the rows
    once = chosen.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    found = map_arrow(once, step, "doc_id long, toxic int, sets array<int>").toArrow()
    toxic = np.asarray(found.column("toxic")) == 1
    if toxic.all() or not toxic.any():
        warnings.warn("no toxicity model: the labelled documents with text are not of both classes", stacklevel=2)
        share = count.get(1, 0) / max(1, sum(count.values()))
        return ToxicModel(np.zeros(FEATURES), float(np.log(share / (1 - share))) if 0 < share < 1 else 500.0 * (2 * share - 1))
    order = np.argsort(np.asarray(found.column("doc_id")), kind="stable")
    sets = [np.asarray(found.column("sets")[int(i)].values) for i in order]
    toxic = toxic[order]
    return fit(sets, toxic, (count[0] / (~toxic).sum()) / (count[1] / toxic.sum()))


def score_toxicity(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) of every row."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1):
                raw, offs = text_buffers(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(raw, offs))], names=["doc_id", "score"])

    return map_arrow(id_and_text(docs, id_col, text_col), step, "doc_id long, score double")


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows whose labels training may not see: crc32 of the id as text leaves 1 over 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
