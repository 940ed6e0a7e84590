"""Hard negatives by angular triangle filtering.

Every vector's components become floor(scale * x); a score is the integer inner product of two such vectors.
Stored with each vector are its norm and its angles to a few reference directions. For an anchor a and a row x
the triangle inequality of angles puts the angle between them into
[max |angle(a, r) - angle(x, r)|, min(angle(a, r) + angle(x, r), 2 pi - that sum)] over the references r; its
cosine times both norms, widened for rounding, bounds the score from both sides. Only rows whose bounds overlap
the wanted window are scored, in integers:

* positives: the k-th largest lower bound of an anchor's rows of its own label is a floor that its k best reach;
* negatives: rows of another label whose bounds overlap the window of one of the anchor's positives.

Rows are dealt over shards of bounded size by a hash of their id; all anchors (the query set) pass through every
shard in blocks, once for the positives and once for the negatives, and each shard answers with its few best.

Defined cases: rows with a null id or label, a null vector, or a null or non-finite component (also after
scaling) take no part; an empty vector scores 0; only vectors of an anchor's own length are its candidates;
rows sharing an id are one row, the one with the smallest label and vector; ties go to the smaller id; scores
beyond 64 bits are compared exactly and returned as the nearest long; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossframe.llm.common import map_arrow
from lossframe.session import persist_table

#: Reference directions, and the rows (by hash of the id) among which they are picked.
REFERENCES, REFERENCE_SAMPLE = 8, 256
#: Bytes of the components of one shard, in double precision, and rows of one at most.
SHARD_BYTES, SHARD_ROWS = 16 << 20, 8192
#: Tasks that the shards are dealt over at most; a task takes its shards one after the other.
MAX_TASKS = 20_000
#: Anchors that a shard handles at once.
ANCHOR_BLOCK = 64
#: Integers up to here are exact in a double.
EXACT = float(1 << 53)
ANGLE_SLACK, SCORE_SLACK = 1e-6, 1e-9
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


def usable(vector: Column, scale: float) -> Column:
    """Not null, every component present and finite, also when scaled."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x * scale) == float("inf")))
    return vector.isNotNull() & ~bad


def norms_and_angles(vectors: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norm of every vector and its angle to every (unit) reference; a zero vector has the angle 0."""
    top = np.abs(vectors).max(axis=1, initial=0.0)
    unit = vectors / np.where(top > 0, top, 1.0)[:, None]  # no square overflows
    size = np.sqrt((unit * unit).sum(axis=1))
    cosine = unit @ references.T / np.where(size > 0, size, 1.0)[:, None]
    return size * top, np.where(size[:, None] > 0, np.arccos(np.clip(cosine, -1.0, 1.0)), 0.0)


def pick_references(vectors: np.ndarray, count: int = REFERENCES) -> np.ndarray:
    """Unit directions of vectors far from each other in angle: each next one is the least alike to those before."""
    top = np.abs(vectors).max(axis=1, initial=0.0)
    vectors = vectors[top > 0] / top[top > 0][:, None]
    if not len(vectors):
        return np.zeros((0, vectors.shape[1]))
    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    picked, nearest = [0], unit @ unit[0]
    while len(picked) < min(count, len(unit)):
        i = int(np.argmin(nearest))
        picked.append(i)
        nearest = np.maximum(nearest, unit @ unit[i])
    return unit[picked]


@dataclass
class Shard:
    """Rows of one length: ids ascending, integer components as doubles, norms, angles."""
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray
    angles: np.ndarray

    @staticmethod
    def of(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, norms: np.ndarray, angles: np.ndarray) -> Shard:
        order = np.argsort(ids, kind="stable")
        return Shard(*(x[order] for x in (ids, labels, vectors, norms, angles)))

    def take(self, rows: np.ndarray) -> Shard:
        return Shard(*(x[rows] for x in (self.ids, self.labels, self.vectors, self.norms, self.angles)))

    def bounds(self, anchors: Shard) -> tuple[np.ndarray, np.ndarray]:
        """(low, high) of the score of every anchor with every row."""
        shape = len(anchors.ids), len(self.ids)
        least, most = np.zeros(shape), np.full(shape, np.pi)
        for r in range(self.angles.shape[1]):
            a, x = anchors.angles[:, r, None], self.angles[None, :, r]
            np.maximum(least, np.abs(a - x), out=least)
            both = a + x
            np.minimum(most, np.minimum(both, 2 * np.pi - both), out=most)
        with np.errstate(over="ignore"):
            product = anchors.norms[:, None] * self.norms[None, :]
            slack = 1.0 + SCORE_SLACK * product
            low = np.cos(np.minimum(most + ANGLE_SLACK, np.pi)) * product - slack
            high = np.cos(np.maximum(least - ANGLE_SLACK, 0.0)) * product + slack
        wild = ~np.isfinite(product)
        return np.where(wild, -np.inf, low), np.where(wild, np.inf, high)

    def scores(self, anchors: Shard) -> np.ndarray:
        """Exact inner products: in doubles where no sum can leave their integers, else in Python's."""
        reach = [np.abs(s.vectors).max(initial=0.0) for s in (self, anchors)]
        with np.errstate(over="ignore"):
            exact = reach[0] * reach[1] * max(1, self.vectors.shape[1]) < EXACT
        if exact:
            return anchors.vectors @ self.vectors.T
        whole = [np.array([[int(c) for c in v] for v in s.vectors], object).reshape(s.vectors.shape) for s in (anchors, self)]
        return whole[0] @ whole[1].T


def best_same(shard: Shard, anchors: Shard, k: int) -> Iterator[tuple[int, int, int]]:
    """(anchor id, row id, score) of the k best other rows of each anchor's label."""
    for label in np.unique(anchors.labels):
        own = shard.take(np.flatnonzero(shard.labels == label))
        asked = anchors.take(np.flatnonzero(anchors.labels == label))
        if not len(own.ids):
            continue
        low, high = own.bounds(asked)
        itself = asked.ids[:, None] == own.ids[None, :]
        low[itself], high[itself] = -np.inf, -np.inf
        if len(own.ids) > k:
            floor = -np.partition(-low, k - 1, axis=1)[:, k - 1]
            open_ = (high >= floor[:, None]) & ~itself
        else:
            open_ = ~itself
        rows = np.flatnonzero(open_.any(axis=0))
        if not len(rows):
            continue
        score, open_ = own.take(rows).scores(asked), open_[:, rows]
        for i in range(len(asked.ids)):
            at = np.flatnonzero(open_[i])
            for j in at[np.argsort(-score[i, at], kind="stable")[:k]]:
                yield int(asked.ids[i]), int(own.ids[rows[j]]), int(score[i, j])


def _double(x: int) -> float:
    """Nearest double; infinite beyond the doubles."""
    try:
        return float(x)
    except OverflowError:
        return np.inf if x > 0 else -np.inf


def best_inside(shard: Shard, anchors: Shard, windows: list[list[tuple[int, int, int]]],
                k: int) -> Iterator[tuple[int, int, int, int]]:
    """(anchor id, positive id, row id, score): of each window (positive id, lowest, highest score) the k best rows
    of another label than the anchor's."""
    low, high = shard.bounds(anchors)
    reach = np.array([[_double(min((w[1] for w in own), default=0)), _double(max((w[2] for w in own), default=-1))]
                      for own in windows])
    some = np.array([bool(own) for own in windows])
    open_ = (some[:, None] & (anchors.labels[:, None] != shard.labels[None, :])
             & (high >= reach[:, :1]) & (low <= reach[:, 1:]))
    rows = np.flatnonzero(open_.any(axis=0))
    if not len(rows):
        return
    score, open_ = shard.take(rows).scores(anchors), open_[:, rows]
    for i, own in enumerate(windows):
        at = np.flatnonzero(open_[i])
        at = at[np.argsort(-score[i, at], kind="stable")]
        falling = -score[i, at]
        for positive, lowest, highest in own:
            top = -highest if falling.dtype == object else -_double(highest)
            begin = np.searchsorted(falling, top, side="left")
            for j in at[begin:begin + k]:
                if int(score[i, j]) < lowest:
                    break
                yield int(anchors.ids[i]), positive, int(shard.ids[rows[j]]), int(score[i, j])


# ---------------------------------------------------------------------------
# On Spark
# ---------------------------------------------------------------------------

INDEX = "vec_id long, label long, v array<double>, norm double, angles array<double>"


def _matrix(column: pa.Array, width: int, picked: np.ndarray) -> np.ndarray:
    return np.asarray(column.take(pa.array(picked)).flatten(), np.float64).reshape(len(picked), width)


def index_rows(vectors: DataFrame, label: Column, scale: float = 256.0, id_col: str = "vec_id",
               vector_col: str = "embedding") -> DataFrame:
    """vec_id, label, v (floor(scale * x), whole doubles), norm and angles of every row that takes part; stored."""
    v = F.col(vector_col).cast("array<double>")
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("x"))
            .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("x"), scale)))
    once = (rows.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r"))
            .select("vec_id", "r.label", F.col("r.x").alias("x")))
    # the commonest length gets the references; rows of another length have none and are bounded by their norms
    first = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(REFERENCE_SAMPLE).select("x").collect()
    lengths = [len(r.x) for r in first]
    width = max(sorted(set(lengths)), key=lengths.count) if lengths else 0
    sample = [np.floor(scale * np.array(r.x, float)) for r in first if len(r.x) == width]
    references = pick_references(np.array(sample).reshape(len(sample), width))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.asarray(b.column(2).value_lengths())
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                q = np.floor(scale * _matrix(b.column(2), n, at))
                norm, angle = norms_and_angles(q, references if n == width else np.zeros((0, n)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), _lists(q), pa.array(norm), _lists(angle)],
                    names=["vec_id", "label", "v", "norm", "angles"])

    return persist_table(map_arrow(once, step, INDEX), "vectors")


def _lists(m: np.ndarray) -> pa.Array:
    ends = np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(m.ravel()))


def _dealt(index: DataFrame, anchors: DataFrame, spans: str) -> DataFrame:
    """Every row with its shard, then all anchors in every shard; one shard a task, rows before anchors."""
    n, width = index.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    shards = max(1, -(-n // max(256, min(SHARD_ROWS, SHARD_BYTES // (8 * max(1, width or 0))))))
    rows = index.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("asks"), "*",
                        F.lit(None).cast(spans).alias("windows"))
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("asks"),
                           *index.columns, "windows")
    tasks = min(shards, MAX_TASKS)
    return (rows.unionByName(asked).repartitionById(tasks, F.pmod("shard", F.lit(tasks)))
            .sortWithinPartitions("shard", "asks", "vec_id"))


def _through_shards(answer):
    """A step over the dealt rows: collects a shard's rows, then gives its anchors to ``answer`` in blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, ready = None, {}, {}
        for b in batches:
            of, asks = np.asarray(b.column(0)), np.asarray(b.column(1))
            ids, labels, norms = (np.asarray(b.column(i)) for i in (2, 3, 5))
            size = np.asarray(b.column(4).value_lengths())
            n_angles = np.asarray(b.column(6).value_lengths())

            def rows(at: np.ndarray, n: int) -> Shard:
                return Shard(ids[at], labels[at], _matrix(b.column(4), n, at), norms[at], _matrix(b.column(6), n_angles[at[0]], at))

            for s in np.unique(of):
                if s != shard:
                    shard, parts, ready = s, {}, {}
                for n in np.unique(size[of == s]):
                    here = (of == s) & (size == n)
                    if len(own := np.flatnonzero(here & (asks == 0))):
                        parts.setdefault(n, []).append(rows(own, n))
                    asking = np.flatnonzero(here & (asks == 1))
                    if not len(asking) or n not in parts:
                        continue
                    if n not in ready:  # all rows of a shard come before its anchors
                        ready[n] = Shard.of(*(np.concatenate([getattr(p, f) for p in parts[n]])
                                              for f in ("ids", "labels", "vectors", "norms", "angles")))
                    for i in range(0, len(asking), ANCHOR_BLOCK):
                        at = asking[i:i + ANCHOR_BLOCK]
                        yield from answer(ready[n], rows(at, n), b.column(7).take(pa.array(at)))

    return run


def _long(x: int) -> int:
    return min(max(x, LONG_MIN), LONG_MAX)


def _batch(rows: list[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Rows of whole numbers as longs, the last one's exact text beside it."""
    if rows:
        names = [f.split()[0] for f in schema.split(", ")]
        columns = [pa.array([_long(r[i]) for r in rows], pa.int64()) for i in range(len(rows[0]))]
        exact = pa.array([str(r[-1]) for r in rows])
        yield pa.RecordBatch.from_arrays([*columns, exact], names=names)


#: Exact order of whole numbers written as text: by sign, then by digits.
def _falling(exact: str) -> list[Column]:
    digits = F.regexp_replace(exact, "^-", "")
    negative = F.col(exact).startswith("-")
    size = F.when(negative, -F.length(digits)).otherwise(F.length(digits))
    return [size.desc(), F.when(~negative, digits).desc_nulls_last(), F.when(negative, digits).asc_nulls_last()]


def hard_negatives(vectors: DataFrame, label: Column, is_anchor: Column, positives: int = 5, negatives: int = 3,
                   low_percent: int = 50, high_percent: int = 95, scale: float = 256.0, id_col: str = "vec_id",
                   vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``label`` is a column of ``vectors``, ``is_anchor`` a condition on ``vec_id``. Of each anchor's ``positives`` best
    rows of its label, the ``negatives`` best rows of another label whose score is between the two percentages of
    the positive's.
    """
    index = index_rows(vectors, label, scale, id_col, vector_col)
    anchors = index.where(is_anchor)
    span = "array<struct<positive: bigint, low: string, high: string>>"

    def same(shard: Shard, asked: Shard, _: pa.Array) -> Iterator[pa.RecordBatch]:
        return _batch(list(best_same(shard, asked, positives)), pairs)

    pairs = "anchor_id long, positive_id long, positive_score long, exact string"
    by_anchor = Window.partitionBy("anchor_id").orderBy(*_falling("exact"), "positive_id")
    found = map_arrow(_dealt(index, anchors.withColumn("windows", F.lit(None).cast(span)), span), _through_shards(same), pairs)
    best = persist_table(found.withColumn("place", F.row_number().over(by_anchor)).where(F.col("place") <= positives), "positives")

    def edges(exact: pa.Array, positive: pa.Array) -> pa.RecordBatch:
        low, high = [], []
        for e in exact.to_pylist():
            low.append(str(-(-low_percent * int(e) // 100)))
            high.append(str(high_percent * int(e) // 100))
        return pa.RecordBatch.from_arrays([*positive, pa.array(low), pa.array(high)], names=["anchor_id", "positive", "low", "high"])

    def window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield edges(b.column(2), [b.column(0), b.column(1)])

    wanted = (map_arrow(best.select("anchor_id", "positive_id", "exact"), window,
                        "anchor_id long, positive long, low string, high string")
              .groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive", "low", "high")).alias("windows")))

    def other(shard: Shard, asked: Shard, windows: pa.Array) -> Iterator[pa.RecordBatch]:
        spans = [[(w["positive"], int(w["low"]), int(w["high"])) for w in own if int(w["low"]) <= int(w["high"])]
                 for own in windows.to_pylist()]
        return _batch(list(best_inside(shard, asked, spans, negatives)), inside)

    inside = "anchor_id long, positive_id long, negative_id long, negative_score long, exact string"
    by_pair = Window.partitionBy("anchor_id", "positive_id").orderBy(*_falling("exact"), "negative_id")
    near = map_arrow(_dealt(index, anchors.join(wanted, "vec_id"), span), _through_shards(other), inside)
    ranked = near.withColumn("rank", F.row_number().over(by_pair)).where(F.col("rank") <= negatives)
    return (ranked.join(best.select("anchor_id", "positive_id", "positive_score"), ["anchor_id", "positive_id"])
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
