"""End-to-end run plan on two small 'files' with different headers."""

import tempfile
from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from lossframe.operators.mapping import guess_schema
from lossframe.operators.rules import RuleConfig
from lossframe.operators.standardize import file_status
from lossframe.plans import claims_run as R


def _files(spark):
    a = spark.createDataFrame(
        [(1, "C-1", "05/01/2023", "10/01/2023", "$ 100", "150", "50", "aud"),
         (2, "C-2", "31/02/2023", "10/01/2023", "(20)", "0", "0", "USD"),
         (3, "C-1", "05/01/2023", "12/01/2023", "0", "0", "0", "AUD")],
        "line int, `Claim No` string, `Date of Loss` string, `Reported` string, `Paid` string, "
        "`Incurred` string, `Reserve` string, `Curr` string")
    b = spark.createDataFrame(
        [(1, "c-1 ", "2023-01-05", "2023-02-01", "5", None, "1", "XXX", "Jane")],
        "line int, claim_number string, lossdate string, notif_date string, paid_total string, "
        "paid_incurred string, outstanding string, currency string, insured string")
    return a, b


def test_prepare_run_save_export(spark):
    a, b = _files(spark)
    ma, mb = guess_schema(a.columns), guess_schema(b.columns)
    assert mb["claim_id"] == ""  # 'claim_number' is not an alias: that file has no claim ids
    std = R.prepare([(a, "a.csv"), (b, "b.csv")], [ma, mb], tenant_id="t", run_id="run-1", order_col="line")
    rows = std.orderBy("row_id").collect()
    assert [(r.row_id, r.source_file) for r in rows] == [(1, "a.csv"), (2, "a.csv"), (3, "a.csv"), (4, "b.csv")]
    assert rows[0].currency == "AUD" and rows[1].loss_date is None and rows[1].paid == Decimal(-20)
    assert rows[3].incurred == Decimal(6)  # filled from paid + outstanding

    res = R.run(std, RuleConfig(), policy_start=date(2023, 1, 1), policy_end=date(2023, 12, 31))
    issues = {(r.row, r.issue) for r in res.issues.collect()}
    assert (2, "Unparseable loss_date") in issues and (2, "Negative paid") in issues
    assert (3, "Potential duplicate claim rows") in issues and (4, "Unrecognised currency") in issues
    assert (1, "Multiple rows for claim_id") in issues and (3, "Multiple rows for claim_id") in issues
    assert res.summary["n_rows"] == 4 and res.summary["n_claims"] == 3
    flagged = {r.row_id: r.flags for r in res.flagged.collect()}
    assert flagged[4].startswith("Missing required fields")

    root = tempfile.mkdtemp(prefix="lf-run-")
    R.save(res, root, tenant_id="t")
    out = R.export_bundle(res, tempfile.mkdtemp(prefix="lf-bundle-"), "lloyds_v5_2", masked=True, salt="s")
    assert spark.read.parquet(out["clean"]).count() == 4
    assert spark.read.parquet(out["triangles_counts"]).count() >= 1


def test_file_status_reports_missing_columns(spark):
    a, b = _files(spark)
    raw = a.withColumn("source_file", F.lit("a.csv"))
    st = file_status(raw, {"claim_id": "Claim No", "claimant": "Insured"}).first()
    assert st.n_rows == 3 and st.n_claim_id == 3 and st.n_claimant == 0
