"""Spark vs DuckDB on the registered queries (small scale) and the entry smoke check."""

import pytest

from conftest import SF001

import __spark_entry__ as E
from tools.compare_oracle import compare, duck

# aggregate-style queries are insensitive to the one row-order tie at sf0.001
FAST = ["union_files", "content_hash_dups", "text_lines", "text_sufficiency", "normalize_text_key",
        "latest_per_key", "distinct_sorted", "excel_serial_dates", "scrub_names", "claim_rollup", "open_closed",
        "incurred_lt_paid_summary", "recon_summary", "outlier_summary", "policy_term_summary", "currency_summary",
        "exact_row_dups", "dup_summary", "required_missing", "dataset_recon", "ay_currency_pivot",
        "triangle_counts", "triangle_paid", "triangle_incurred", "run_headers", "retention_prune",
        "orphan_prune", "audit_json", "rule_reconcile", "rule_paid_outliers", "all_issues", "clean_amounts",
        "export_standard", "export_ebix", "export_lloyds", "export_sunrise", "export_unmasked", "parse_dates_us",
        "issues_lloyds", "run_metrics", "quality_summary", "claim_cube_totals", "triangles_by_runs", "audit_log_store"]


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


def test_every_query_has_an_oracle_or_is_documented():
    from lossframe.plans import catalog

    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(catalog.queries()) == set(catalog.oracle())


@pytest.mark.parametrize("name", FAST)
def test_query_matches_duckdb(spark, con, name):
    r = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF001)
    assert r["ok"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["rule_order", "issue", "n_rows"] and len(rows) >= 10
    got = {r.issue: r.n_rows for r in rows}
    # FIXTURES.md sf0.001 numbers
    assert got["Missing required fields"] == 293 and got["Unrecognised currency"] == 1239
    assert got["Loss date outside policy term"] == 2237 and got["Incurred less than Paid"] == 3139


def test_claims_beyond_the_triangles(spark, con):
    from lossframe.operators import triangles as TR

    rows = [("a", "2001-01-05", "2004-01-31", 1, 2), ("a", "2001-01-05", "2004-02-01", 4, 8), ("a", "2001-01-06", "2004-02-09", 16, None),
            ("", "2001-01-06", "2009-01-01", 32, 64), ("b", "2002-01-01", "2002-01-01", 5, 5), ("c", "2001-01-01", None, 7, 7)]
    std = spark.createDataFrame(rows, "claim_id string, loss_date string, report_date string, paid int, incurred int").selectExpr(
        "claim_id", "DATE(loss_date) AS loss_date", "DATE(report_date) AS report_date", "CAST(paid AS DECIMAL(28,6)) AS paid",
        "CAST(incurred AS DECIMAL(28,6)) AS incurred")
    got = [tuple(r) for r in TR.triangle_beyond(std).collect()]
    assert got == [(2001, 3, 1, 52, 72), (2002, 0, 0, 0, 0)]
    inside = TR.triangle_amounts_long(std, "paid").groupBy().sum("val").first()[0]
    assert inside + sum(r[3] for r in got) == 58  # all claims with both dates
    r = compare(spark, con, "triangle_beyond", E.queries()["triangle_beyond"], E.oracle_sql()["triangle_beyond"], SF001)
    assert r["ok"], r
