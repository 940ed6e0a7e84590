"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a grouped minimum and a join, so no node's neighbours are ever
gathered in one task; the edge table is written and reread between steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossframe.session import persist_table


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.join(low, "a").where((F.col("b") > F.col("a")) & (F.col("b") != F.col("m")))
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    rest = e.join(low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.union(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge to another one.

    ``edges``: two long columns. Self-loops and edges with a null end count for nothing.
    """
    x, y = edges.columns
    e = (edges.where(F.col(x) != F.col(y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct())
    e = persist_table(e, "edges")

    def state(t: DataFrame):
        return t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = state(e)
    for _ in range(max_rounds):
        e = persist_table(_small_star(_large_star(e)), "edges")
        before, now = now, state(e)
        if now == before:
            break
    else:
        raise RuntimeError("components did not converge")
    low = e.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(low)
