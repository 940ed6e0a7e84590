"""Distinct claims from stored bitmaps, and triangles kept up to date by signed deltas."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lossframe.operators import claim_cube as C
from lossframe.operators import triangle_store as S
from lossframe.operators import triangles as TR
from lossframe.operators import versions as W


def claims(spark, rows):
    return spark.createDataFrame(rows, "row_id long, claim_id string, loss string, rep string, paid int, incurred int, currency string").selectExpr(
        "row_id", "claim_id", "DATE(loss) AS loss_date", "DATE(rep) AS report_date", "CAST(paid AS DECIMAL(28,6)) AS paid",
        "CAST(incurred AS DECIMAL(28,6)) AS incurred", "CAST(NULL AS DECIMAL(28,6)) AS outstanding", "currency")


def made(n, seed):
    rng = random.Random(seed)
    return [(i, rng.choice(["HOT"] * 5 + [None, "", "x"] + [f"C{k}" for k in range(n // 3)]),
             rng.choice([None, "2020-03-01", "2021-12-31", "2022-06-05"]), rng.choice([None, "2022-07-01", "2023-01-01", "2030-01-01"]),
             rng.choice([None, -3, 5, 7]), rng.choice([None, 2, 9]), rng.choice([None, "", "USD", "EUR"])) for i in range(n)]


def exact(std, by):
    d = std.withColumn("ay", F.year("loss_date").cast("long"))
    null = F.coalesce(F.max(F.col("claim_id").isNull().cast("int")), F.lit(0))
    out = d.groupBy(*by).agg(F.count(F.lit(1)), F.count_distinct("claim_id") + null, *[F.coalesce(F.sum(a), F.lit(0)) for a in C.AMOUNTS])
    return rows(out)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_every_roll_up_equals_count_distinct(spark):
    std = claims(spark, made(900, 1))
    cube = C.build_cube(std)
    for k in range(3):
        for by in combinations(C.DIMENSIONS, k):
            assert rows(C.roll_up(cube, by)) == exact(std, by), by
    with pytest.raises(ValueError):
        C.roll_up(cube, ["status"])


def test_cube_of_several_blocks_and_of_nothing(spark):
    n = 70_000  # three blocks of numbers
    std = spark.range(n).selectExpr("concat('c', id % 66000) AS claim_id", "DATE('2020-01-01') + CAST(id % 900 AS INT) AS loss_date",
                                    "CAST(1 AS DECIMAL(28,6)) AS paid", "CAST(2 AS DECIMAL(28,6)) AS incurred",
                                    "CAST(0 AS DECIMAL(28,6)) AS outstanding", "IF(id % 2 = 0, 'USD', 'EUR') AS currency")
    cube = C.build_cube(std)
    assert cube.select("block").distinct().count() == 3
    assert rows(C.roll_up(cube)) == [(n, 66000, n, 2 * n, 0)] and rows(C.roll_up(cube, ["ay"])) == exact(std, ["ay"])
    none = C.build_cube(std.limit(0))
    assert rows(C.roll_up(none)) == [(0, 0, 0, 0, 0)] and rows(C.roll_up(none, ["ay"])) == []


def full(std):
    counts = TR.triangle_counts_long(std)
    amounts = TR.triangle_amounts_long(std, "paid").withColumnRenamed("val", "paid").join(
        TR.triangle_amounts_long(std, "incurred").withColumnRenamed("val", "incurred"), ["ay", "dev_mon"])
    return rows(amounts.join(counts, ["ay", "dev_mon"], "left").selectExpr("ay", "dev_mon", "coalesce(n_claims, 0)", "paid", "incurred"))


def test_runs_and_a_re_save_equal_the_full_build(spark, tmp_path):
    std, root = claims(spark, made(400, 2)), str(tmp_path)
    part = lambda i: std.where(F.col("row_id") % 3 == i)
    S.save_run(std.where("row_id % 5 < 3"), "r0", root)  # a first state that is put right later
    for i in (1, 2):
        S.save_run(part(i), f"r{i}", root)
    S.save_run(part(0), "r0", root)
    assert rows(S.triangles_long(spark, root)) == full(std)
    before = W.read(spark, f"{root}/{S.NAME}", S.SCHEMA).count()
    S.save_run(part(0), "r0", root)  # as it was: no row is added
    assert W.read(spark, f"{root}/{S.NAME}", S.SCHEMA).count() == before
    S.compact(spark, root)
    assert rows(S.triangles_long(spark, root)) == full(std) and W.read(spark, f"{root}/{S.NAME}", S.SCHEMA).count() < before
    S.withdraw_run(spark, "r1", root)
    assert rows(S.triangles_long(spark, root)) == full(std.where("row_id % 3 <> 1"))
    for r in ("r0", "r2"):
        S.withdraw_run(spark, r, root)
    assert rows(S.triangles_long(spark, root)) == []


def test_a_re_save_that_meets_another_one(spark, tmp_path, monkeypatch):
    """Both save the same run: the slower one withdraws what the faster one left."""
    std, root = claims(spark, made(120, 3)), str(tmp_path)
    real, met = W._claim, []

    def claim(spark_, table, number, names):
        if not met:
            met.append(1)
            S.save_run(std.where("row_id < 90"), "r", root)
        return real(spark_, table, number, names)

    monkeypatch.setattr(W, "_claim", claim)
    S.save_run(std, "r", root)
    monkeypatch.undo()
    assert rows(S.triangles_long(spark, root)) == full(std)


def test_a_save_sums_up_once_and_stores_nothing_beside_the_table(spark, tmp_path, monkeypatch):
    from lossframe.session import stored_tables

    std, root, plans, real = claims(spark, made(90, 4)), str(tmp_path), [], W._write
    monkeypatch.setattr(W, "_write", lambda df, table, kind: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, table, kind))
    beside = stored_tables(spark)
    for _ in range(2):
        S.save_run(std, "r", root)
    S.withdraw_run(spark, "r", root)
    assert [p.count("Aggregate [") for p in plans] == [1, 1, 1] and stored_tables(spark) == beside
    assert rows(S.triangles_long(spark, root)) == [] and rows(S.run_delta(std, "r")) == rows(S.run_delta(std.union(std.limit(0)), "r"))
