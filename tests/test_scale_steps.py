"""Steps that every claims query shares: what they shuffle, and methods small enough for the JIT."""

from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from lossframe.operators import numbering as N
from lossframe.operators import rules as V
from lossframe.operators.mapping import identity_mapping
from lossframe.operators.standardize import standardize
from lossframe.plans import stores
from lossframe.session import persist_table

JIT_LIMIT = 8000


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def std_rows(spark, ids=(1, 2, 3, 4)):
    """Claims of which every second repeats the claim before."""
    rows = [(i, f"C{i // 2}", date(2023, 1, 5), date(2023, 1, 4 + i % 3), Decimal(i), Decimal(i - 1), Decimal(1), "AUD" if i % 2 else "??",
             "P" if i % 2 else None, "O", "Jo") for i in ids]
    return spark.createDataFrame(rows, "row_id long, claim_id string, loss_date date, report_date date, paid decimal(28,6), incurred decimal(28,6), "
                                       "outstanding decimal(28,6), currency string, policy_number string, status string, claimant string")


def test_numbering_does_not_shuffle_rows_by_file(spark):
    stored = persist_table(spark.range(1000).repartition(5), "t")
    numbered = N.number_stored(stored)
    assert "Exchange hashpartitioning" not in plan(numbered)
    assert sorted(r[0] for r in numbered.select("row_id").collect()) == list(range(1, 1001))

    placed = spark.range(0, 100, 1, 4).select("id", F.when(F.col("id") < 25, "b").otherwise("a").alias(N.FILE), F.lit(0).alias(N.BLOCK),
                                              F.monotonically_increasing_id().alias(N.POSITION))
    by_position = N.number_by_position(placed.where("id < 25 OR id >= 75"))  # a partition is a file, as a scan has it
    assert "Exchange hashpartitioning" not in plan(by_position)
    got = {r["id"]: r["row_id"] for r in by_position.collect()}
    assert got == {**{i: i - 74 for i in range(75, 100)}, **{i: 26 + i for i in range(25)}}


def test_standardise_compiles_to_methods_the_jit_takes(spark):
    mapping = identity_mapping()
    raw = persist_table(spark.createDataFrame([["1"] * len(mapping)], ", ".join(f"{c} string" for c in mapping.values())), "raw")
    for locale in ("AU", "US"):
        stages = standardize(raw, mapping, locale, "f", "t", "r")._jdf.queryExecution().debug().codegenToSeq()
        sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
        assert sizes and max(sizes) < JIT_LIMIT, sizes


def test_row_rules_are_one_number_in_the_shuffle(spark):
    std = persist_table(std_rows(spark), "std")
    cfg = V.RuleConfig()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    try:
        flags = V.row_flags_one_pass(std, cfg, {"lower": Decimal(0), "upper": Decimal(3)}).select("row_id", "claim_id", "flags", "flags_detail")
        above = plan(flags).split("Exchange hashpartitioning")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(above) > 1
    for column in ("paid", "policy_number", "claimant"):  # read below the shuffle only
        assert f"{column}#" not in above[0]
    # the bits give each row the issues that its rules give without the join
    local = V.RuleConfig(rule_duplicates=False, rule_multi_rows_per_claim=False)
    fences = {"lower": Decimal(0), "upper": Decimal(3)}
    key = ["row", "rule_order", "issue", "detail"]
    alone = V.validate(std, local, fences).select(*key).collect()
    joined = V.validate(std, cfg, fences).where(~F.col("rule_order").isin(*V.KEYED_RULES)).select(*key).collect()
    assert alone and sorted(map(tuple, alone)) == sorted(map(tuple, joined))


def test_csv_dialects_reads_each_claim_once(spark):
    """Rows that share a number stay as they are: the amounts come from the row itself, not from a join of the claims with themselves."""
    query = next(fn for name, fn, _ in stores.registered(lambda s, sf: std_rows(spark, (1, 1, 2, 3)), *[lambda *a, **k: ""] * 3)
                 if name == "csv_dialects")
    assert sorted((r["row_id"], r["paid"]) for r in query(spark, "").collect()) == [
        ("1", "1,000000"), ("1", "1,000000"), ("2", "2,000000"), ("3", "3,000000")]
