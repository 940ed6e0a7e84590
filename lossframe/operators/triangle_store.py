"""Triangles kept up to date by runs (T2-T4): signed deltas over (run, accident year, lag, claim).

A run adds what its claims come to: one row a (year, lag, claim), with rows and amounts. Saving a run again adds, in the
same commit, the negative of what the store holds of it. Nothing else is read or written then, so a
run costs its own size, not the history's: its claims and the negative rows are summed up together, in one shuffle and one
write. Sums over the stored rows are the state; ``compact`` stores them as such. Commits
go through ``versions``: a crash leaves the old or the new state, and of two writers at once the second one
takes its negative from the first one's result (and reads its claims again).

A claim counts in a (year, lag) as long as its rows there come to more than none. All lags are stored; the
reader takes those up to ``max_dev``. Claims without an id add to the amounts alone, as in ``triangles``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lossframe.constants import MAX_DEV_MONTHS
from lossframe.functions.names import is_blank
from lossframe.operators import versions
from lossframe.operators.triangles import SUM, _dated

MEASURES = ["n_rows", "paid", "incurred"]
KEYS = ["run_id", "ay", "dev_mon", "claim_id"]
SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("ay", T.IntegerType()), T.StructField("dev_mon", T.IntegerType()),
    T.StructField("claim_id", T.StringType()), T.StructField("n_rows", T.LongType()),
    T.StructField("paid", T.DecimalType(38, 6)), T.StructField("incurred", T.DecimalType(38, 6)),
])
NAME = "triangle_deltas"


def _claim_rows(std: DataFrame, run_id: str) -> DataFrame:
    """The claims that have both dates as rows of the store, each for itself."""
    amounts = [F.coalesce(F.col(f), F.lit(0)).cast(SCHEMA[f].dataType).alias(f) for f in ("paid", "incurred")]
    return _dated(std).select(F.lit(run_id).alias("run_id"), F.col("ay").cast("int").alias("ay"), F.col("dev_mon").cast("int").alias("dev_mon"),
                              "claim_id", F.lit(1).cast("long").alias("n_rows"), *amounts)


def _summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(m).cast(SCHEMA[m].dataType).alias(m) for m in MEASURES])


def _not_zero() -> Column:
    return (F.col("n_rows") != 0) | (F.col("paid") != 0) | (F.col("incurred") != 0)


def run_delta(std: DataFrame, run_id: str) -> DataFrame:
    """One row a (accident year, lag, claim) of a run's claims that have both dates."""
    return _of_run(_claim_rows(std, run_id), run_id)


def _of_run(rows: DataFrame, run_id: str) -> DataFrame:
    """Sums of rows that are all of one run: its name is no part of the key that is shuffled."""
    return _summed(rows, KEYS[1:]).select(F.lit(run_id).alias("run_id"), *SCHEMA.fieldNames()[1:])


def save_run(std: DataFrame, run_id: str, root: str) -> int:
    """Add a run, or put it in place of its earlier state. Returns the store's version."""
    return _put(std.sparkSession, root, run_id, _claim_rows(std, run_id))


def withdraw_run(spark: SparkSession, run_id: str, root: str) -> int:
    """Take a run out (e.g. one that retention removes)."""
    return _put(spark, root, run_id, None)


def _put(spark: SparkSession, root: str, run_id: str, new: DataFrame | None) -> int:
    def change(store: DataFrame) -> DataFrame:
        negative = [(-F.col(m)).cast(SCHEMA[m].dataType).alias(m) for m in MEASURES]
        old = store.where(F.col("run_id") == run_id).select(*KEYS, *negative)
        # a run saved again as it was adds no row
        return _of_run(old if new is None else old.unionByName(new), run_id).where(_not_zero())

    return versions.extend(spark, f"{root}/{NAME}", SCHEMA, change)


def compact(spark: SparkSession, root: str) -> int:
    """Store the sums in place of the deltas; rows that come to nothing go."""
    return versions.replace(spark, f"{root}/{NAME}", SCHEMA, lambda store: _summed(store, KEYS).where(_not_zero()))


def triangles_long(spark: SparkSession, root: str, max_dev: int = MAX_DEV_MONTHS) -> DataFrame:
    """ay, dev_mon, n_claims (T2), paid (T3), incurred (T4) of all stored runs, of the (year, lag) pairs that have rows."""
    store = versions.read(spark, f"{root}/{NAME}", SCHEMA).where(F.col("dev_mon") <= max_dev)
    claims = _summed(store, ["ay", "dev_mon", "claim_id"]).where(F.col("n_rows") > 0)
    return claims.groupBy("ay", "dev_mon").agg(
        F.count_if(~is_blank(F.col("claim_id"))).alias("n_claims"),
        *[F.sum(f).cast(SUM).alias(f) for f in ("paid", "incurred")])
