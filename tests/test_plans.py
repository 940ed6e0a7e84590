"""Plan-shape checks: the properties the scale design relies on."""

import re

import pytest

from conftest import SF001
from lossframe.operators import quality as Q
from lossframe.operators import rules as V
from lossframe.operators.standardize import standardize
from lossframe.sources.fixtures import claims_std, table


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def count(pattern, text):
    return len(re.findall(pattern, text))


@pytest.fixture(scope="module")
def std(spark):
    return claims_std(spark, SF001)


def test_row_local_rules_are_one_scan_one_generate_no_shuffle(std):
    cfg = V.RuleConfig(rule_duplicates=False, rule_multi_rows_per_claim=False, rule_paid_outliers=False)
    p = plan(V.validate(std, cfg))
    assert count(r"FileScan parquet", p) == 1
    assert count(r"Generate ", p) == 1
    assert "Exchange" not in p


def test_set_based_rules_scan_the_claims_once_beside_the_stored_keys(std):
    p = plan(V.validate(std, V.RuleConfig(rule_paid_outliers=False)))
    assert count(r"FileScan parquet.*claimant", p) == 1  # the single rule pass
    assert count(r"Generate explode\(_issues", p) + count(r"Generate explode", p) >= 1
    assert "SinglePartition" not in p


def test_key_table_reads_only_key_columns_and_shuffles_once_for_its_windows(std):
    import lossframe.operators.rules as R
    kept = R.persist_table
    try:
        R.persist_table = lambda df, name="": df
        p = plan(R.claim_keys(std))
    finally:
        R.persist_table = kept
    fields = {f.split(":")[0] for f in re.findall(r"ReadSchema: struct<([^>]*)>", p)[0].split(",")}
    assert {"claim_id", "loss_date"} <= fields
    assert not fields & {"paid", "incurred", "outstanding", "currency", "policy_number", "claimant", "status"}
    assert count(r"Window \[", p) == 2 and count(r"Exchange hashpartitioning", p) == 2  # the aggregate's and the windows' one


def test_row_aggregates_have_no_expand(std):
    assert "Expand" not in plan(Q.row_aggregates(std))
    assert "Expand" not in plan(Q.claim_aggregates(Q.claim_totals(std)))


def test_standardize_prunes_unmapped_columns(spark):
    li = table(spark, SF001, "lineitem")
    out = standardize(li, {"claim_id": "l_orderkey", "paid": "l_extendedprice"})
    p = plan(out)
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double>" in p


def test_filters_reach_the_scan(spark):
    from lossframe.operators.history import retention_filter
    from datetime import datetime
    ev = table(spark, SF001, "events")
    p = plan(retention_filter(ev, "ts", datetime(2024, 1, 30)).select("event_id"))
    assert "PushedFilters: [" in p and "GreaterThanOrEqual(ts" in p


def test_triangle_pivot_uses_fixed_columns_without_extra_job(std):
    from lossframe.operators.triangles import triangle_counts
    df = triangle_counts(std)
    assert df.columns == ["ay"] + [str(i) for i in range(37)]
