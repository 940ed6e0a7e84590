"""Distinct claims for any roll-up from one stored cube (Q1, T1): bitmaps over dense claim numbers.

Distinct counts of groups do not add up; sets do. Every claim id (NULL being one) gets a number, in the order of its first
accident year, so the claims of a year lie close together. A cube row holds, for one cell (accident year, currency) and
one block of 32,768 numbers, the bitmap of the claims it has, with their rows and amounts. A
roll-up to some of the dimensions joins bitmaps by OR and counts bits; it reads the cube, never the claims.

The claims are summed up to (claim, cell) before anything is joined, so a claim with a third of all rows is
one row. A block costs 4 KB in each cell that it has claims in: numbers in the order of years keep that to the blocks of
the cell's own years.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossframe.functions.dates import accident_year
from lossframe.operators.numbering import number_rows
from lossframe.operators.triangles import SUM
from lossframe.session import persist_table

DIMENSIONS = ("ay", "currency")
AMOUNTS = ("paid", "incurred", "outstanding")


def _add(c: str) -> Column:
    return F.sum(c).cast(SUM).alias(c)


def build_cube(std: DataFrame) -> DataFrame:
    """ay, currency, block, claims (bitmap), rows, paid, incurred, outstanding; stored once."""
    amounts = [F.coalesce(F.sum(a), F.lit(0)).cast(SUM).alias(a) for a in AMOUNTS]
    cells = persist_table(std.withColumn("ay", accident_year(F.col("loss_date"))).groupBy("claim_id", *DIMENSIONS)
                          .agg(F.count(F.lit(1)).alias("rows"), *amounts), "claim-cells")
    ids = cells.groupBy("claim_id").agg(F.min("ay").alias("first_ay"))
    numbers = number_rows(ids, ["first_ay", "claim_id"], "no").select(F.col("claim_id").alias("id"), "no")
    met = cells.join(numbers, F.col("claim_id").eqNullSafe(F.col("id")))
    return persist_table(
        met.groupBy(*DIMENSIONS, F.bitmap_bucket_number("no").alias("block"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("no")).alias("claims"), F.sum("rows").alias("rows"), *[_add(a) for a in AMOUNTS]),
        "claim-cube")


def roll_up(cube: DataFrame, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """``by`` (any of the dimensions; none: one row in all), rows, claims (distinct, NULL counted), amounts."""
    if not set(by) <= set(DIMENSIONS):
        raise ValueError(f"dimensions are {', '.join(DIMENSIONS)}")
    # two steps: a block's sets first, so that no task holds a whole group's bits
    blocks = cube.groupBy(*by, "block").agg(F.bitmap_count(F.bitmap_or_agg("claims")).alias("claims"), F.sum("rows").alias("rows"),
                                            *[_add(a) for a in AMOUNTS])
    zero = [F.coalesce(F.sum(c), F.lit(0)).cast(kind).alias(c) for c, kind in
            [("rows", "long"), ("claims", "long"), *[(a, SUM) for a in AMOUNTS]]]
    return blocks.groupBy(*by).agg(*zero)
