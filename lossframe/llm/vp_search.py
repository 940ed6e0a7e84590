"""Nearest neighbours by vantage-point trees, one per shard.

Vectors are dealt evenly over shards of bounded size, by a hash of id and
components, so that a task that runs again deals alike; each task builds the
trees of its shards and streams all queries through them in blocks. At a node
the distance to the vantage point bounds the distance to everything in a child
(triangle inequality): a child is skipped when ``relax`` times that bound
exceeds the k-th best distance so far. ``relax`` 1 skips only what cannot
matter, so the search is exact; a larger value skips more and may lose
neighbours. Each shard returns its k best; the best k of those are the result.

Defined cases: vectors that are null, empty, zero, or hold a null or
non-finite component take no part; only vectors of a query's own length are
its candidates; rows with the query's id are the query's own and no candidates; a
repeated query id is searched once, with its smallest vector; other repeated
rows are candidates each (of equal rows, ``k`` are kept, which is all that a
result can hold); ties go to the smaller id; distances whose squares pass the
range of doubles are computed on scaled differences, and one that itself
passes it is infinite and comes last; no rows, no result; columns other than
id and vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lossframe.llm.common import map_arrow

LEAF = 128
QUERY_BLOCK = 128


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of every row of ``a`` to every row of ``b``, in double precision."""
    with np.errstate(over="ignore"):
        diff = a[:, None, :] - b[None, :, :]
        out = np.sqrt((diff ** 2).sum(axis=2))
        over = np.isinf(out)
        if over.any():
            far = np.abs(diff[over])
            scale = far.max(axis=1)
            real = np.isfinite(scale)  # a difference that is infinite itself is no nearer
            out[over] = np.where(real, scale * np.sqrt(((far / np.where(real, scale, 1)[:, None]) ** 2).sum(axis=1)), np.inf)
    return out


class VpTree:
    """Vectors (double) and ids of one shard. Split by rank, so equal distances cannot unbalance the tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.ids, self.vectors, self._leaf = ids, vectors, leaf
        self.root = self._build(np.arange(len(ids)))
        self.computed = 0

    def _build(self, rows: np.ndarray):
        if len(rows) <= self._leaf:
            return rows
        centre = (self.vectors[rows] / len(rows)).sum(axis=0, keepdims=True)
        vantage = int(np.argmax(distances(centre, self.vectors[rows])[0]))  # a point at the rim separates best
        v, rest = rows[vantage], np.delete(rows, vantage)
        d = distances(self.vectors[v:v + 1], self.vectors[rest])[0]
        order, half = np.argsort(d, kind="stable"), len(rest) // 2
        inner, outer = order[:half], order[half:]
        return (v, d[inner[-1]], d[outer[0]], d[outer[-1]], self._build(rest[inner]), self._build(rest[outer]))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, relax: float) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids) of the k best of each query, by distance then id; missing ones NaN, which sorts last."""
        best = np.full((len(queries), k), np.nan)
        best_id = np.full((len(queries), k), np.iinfo(np.int64).max)

        def offer(q: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
            self.computed += d.size
            d = np.where(ids[None, :] == own[q][:, None], np.nan, d)
            d = np.hstack([best[q], d])
            i = np.hstack([best_id[q], np.broadcast_to(ids, (len(q), len(ids)))])
            order = np.lexsort((i, d), axis=-1)[:, :k]
            best[q], best_id[q] = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)

        def visit(node, q: np.ndarray) -> None:
            if not len(q):
                return
            if isinstance(node, np.ndarray):
                if len(node):
                    offer(q, distances(queries[q], self.vectors[node]), self.ids[node])
                return
            v, inner_hi, outer_lo, outer_hi, inner, outer = node
            d = distances(queries[q], self.vectors[v:v + 1])
            offer(q, d, self.ids[v:v + 1])
            d = d[:, 0]
            near = d <= inner_hi / 2 + outer_lo / 2
            visit(inner, q[near])
            visit(outer, q[~near])
            with np.errstate(invalid="ignore", over="ignore"):  # a bound that is no number skips nothing
                to_outer, to_inner = np.maximum(outer_lo - d, d - outer_hi), d - inner_hi
                skip_outer, skip_inner = relax * to_outer > best[q, -1], relax * to_inner > best[q, -1]
            visit(outer, q[near & ~skip_outer])
            visit(inner, q[~near & ~skip_inner])

        visit(self.root, np.arange(len(queries)))
        return best, best_id


def usable(vector: F.Column) -> F.Column:
    """Non-null, finite in every component and not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


SCHEMA = "query_id long, vec_id long, score double"


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, relax: float = 1.0, shard_rows: int = 8192,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query row, against every row of ``vectors``."""
    def shaped(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
        return df.where(usable(F.col("v")) & F.col("vec_id").isNotNull())

    rows = vectors.count()
    shards = max(1, -(-rows // shard_rows))
    # equal rows meet first, summed up before the shuffle, so that no shard is filled by one row's copies
    copies = shaped(vectors).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("n"))
    base = copies.select(
        F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("is_query"),
        "vec_id", "v", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))).alias("_copy")).drop("_copy")
    asked = (shaped(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
             .select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("is_query"),
                     "vec_id", "v"))
    dealt = base.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "is_query", "vec_id")

    def matrix(column: pa.Array, picked: np.ndarray) -> np.ndarray:
        flat = column.take(pa.array(picked))
        return np.asarray(flat.flatten()).astype(np.float64).reshape(len(picked), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, trees = None, {}, {}
        for b in batches:
            of = np.asarray(b.column(0))
            is_query, ids = np.asarray(b.column(1)), np.asarray(b.column(2))
            size = np.asarray(b.column(3).value_lengths())
            for s in np.unique(of):
                if s != shard:
                    shard, parts, trees = s, {}, {}
                for n in np.unique(size[of == s]):
                    here = (of == s) & (size == n)
                    own = np.flatnonzero(here & (is_query == 0))
                    if len(own):
                        parts.setdefault(n, []).append((ids[own], matrix(b.column(3), own)))
                    asking = np.flatnonzero(here & (is_query == 1))
                    if not len(asking) or n not in parts:
                        continue
                    if n not in trees:  # all candidates of a shard come before its queries
                        trees[n] = VpTree(*(np.concatenate(x) for x in zip(*parts[n])))
                    for at in range(0, len(asking), QUERY_BLOCK):
                        q = asking[at:at + QUERY_BLOCK]
                        d, i = trees[n].search(matrix(b.column(3), q), ids[q], k, relax)
                        found = ~np.isnan(d)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.repeat(ids[q], found.sum(axis=1))), pa.array(i[found]), pa.array(d[found])],
                            names=["query_id", "vec_id", "score"])

    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (map_arrow(dealt, run, SCHEMA).withColumn("rank", F.row_number().over(best))
            .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
