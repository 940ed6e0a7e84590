"""Accident-year pivots and report-lag triangles.

Triangles are incremental by report lag (loss month -> report month). The
wide form pivots over the fixed lag list 0..max_dev, which gives a static
schema and spares Spark the extra job that discovers pivot values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossframe.constants import MAX_DEV_MONTHS
from lossframe.functions.dates import accident_year, dev_months
from lossframe.functions.names import is_blank

SUM = "decimal(38,6)"


def ay_currency_pivot(std: DataFrame) -> DataFrame:
    """Accident year x currency: rows, distinct claims (NULL counted), sums; ay desc, currency asc."""
    g = (std.withColumn("ay", accident_year(F.col("loss_date")))
         .groupBy("ay", "currency")
         .agg(F.count(F.lit(1)).alias("rows"),
              (F.count_distinct("claim_id") + F.coalesce(F.max(F.col("claim_id").isNull().cast("int")), F.lit(0)))
              .cast("long").alias("claims"),
              F.coalesce(F.sum("paid"), F.lit(0)).cast(SUM).alias("paid"),
              F.coalesce(F.sum("incurred"), F.lit(0)).cast(SUM).alias("incurred"),
              F.coalesce(F.sum("outstanding"), F.lit(0)).cast(SUM).alias("outstanding")))
    return g.orderBy(F.col("ay").desc_nulls_last(), F.col("currency").asc_nulls_last())


def _dated(std: DataFrame) -> DataFrame:
    """Rows with both dates, their accident year and development month."""
    return (std.where(F.col("loss_date").isNotNull() & F.col("report_date").isNotNull())
            .withColumn("ay", accident_year(F.col("loss_date")))
            .withColumn("dev_mon", dev_months(F.col("loss_date"), F.col("report_date"))))


def with_dev(std: DataFrame, max_dev: int = MAX_DEV_MONTHS) -> DataFrame:
    """Rows with both dates, their accident year and development month (<= max_dev)."""
    return _dated(std).where(F.col("dev_mon") <= max_dev)


def triangle_beyond(std: DataFrame, max_dev: int = MAX_DEV_MONTHS) -> DataFrame:
    """What the triangles leave out, a row for every accident year: rows with a lag over ``max_dev``, their claims
    (counted as in T2) and amounts (as in T3, T4)."""
    late = F.col("dev_mon") > max_dev
    claim = F.when(late & ~is_blank(F.col("claim_id")), F.struct("claim_id", "dev_mon"))
    amount = lambda f: F.coalesce(F.sum(F.when(late, F.col(f))), F.lit(0)).cast(SUM).alias(f)
    return (_dated(std).groupBy("ay")
            .agg(F.count_if(late).alias("n_rows"), F.count_distinct(claim).alias("n_claims"), amount("paid"), amount("incurred"))
            .orderBy(F.col("ay").asc_nulls_last()))


def triangle_counts_long(std: DataFrame, max_dev: int = MAX_DEV_MONTHS) -> DataFrame:
    """T2 long form: distinct (claim, ay, lag) counted per (ay, lag)."""
    d = with_dev(std.where(~is_blank(F.col("claim_id"))), max_dev)
    return (d.select("claim_id", "ay", "dev_mon").distinct()
            .groupBy("ay", "dev_mon").agg(F.count(F.lit(1)).alias("n_claims")))


def triangle_amounts_long(std: DataFrame, field: str = "paid", max_dev: int = MAX_DEV_MONTHS) -> DataFrame:
    """T3/T4 long form: sum of ``field`` per (ay, lag), NULL summing to 0."""
    if field not in ("paid", "incurred"):
        raise ValueError("field must be 'paid' or 'incurred'")
    return (with_dev(std, max_dev).groupBy("ay", "dev_mon")
            .agg(F.coalesce(F.sum(field), F.lit(0)).cast(SUM).alias("val")))


def _wide(long: DataFrame, value: str, max_dev: int, zero) -> DataFrame:
    lags = list(range(max_dev + 1))
    w = long.groupBy("ay").pivot("dev_mon", lags).agg(F.first(value))
    return w.select("ay", *[F.coalesce(F.col(str(k)), F.lit(zero)).cast(long.schema[value].dataType).alias(str(k))
                            for k in lags]).orderBy(F.col("ay").asc_nulls_last())


def triangle_counts(std: DataFrame, max_dev: int = MAX_DEV_MONTHS) -> DataFrame:
    """T2 wide: one row per accident year, columns '0'..'max_dev', zero-filled."""
    return _wide(triangle_counts_long(std, max_dev), "n_claims", max_dev, 0)


def triangle_amounts(std: DataFrame, field: str = "paid", max_dev: int = MAX_DEV_MONTHS) -> DataFrame:
    """T3 (paid) / T4 (incurred) wide, zero-filled."""
    return _wide(triangle_amounts_long(std, field, max_dev), "val", max_dev, 0)
