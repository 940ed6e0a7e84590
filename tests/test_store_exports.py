"""Mapping store, exports, run history, retention and audit."""

import json
import tempfile
from datetime import date, datetime
from decimal import Decimal

import pytest

from pyspark.sql import functions as F

import lossframe
from lossframe.operators import exports as X
from lossframe.operators import history as H
from lossframe.operators import mapping as M
from lossframe.operators import rules as V


def test_guess_schema_first_column_wins():
    cols = ["Reported", "Claim Number", "claim_no", "Date of Loss", "PAID", "Total Incurred", "Reserve", "CCY",
            "Policy #", "State", "Insured Name"]
    m = M.guess_schema(cols)
    assert m["claim_id"] == "claim_no"  # 'claim_number' is not an alias
    assert m["report_date"] == "Reported" and m["loss_date"] == "Date of Loss" and m["paid"] == "PAID"
    assert m["incurred"] == "Total Incurred" and m["outstanding"] == "Reserve" and m["currency"] == "CCY"
    assert m["policy_number"] == "Policy #" and m["status"] == "State" and m["claimant"] == "Insured Name"
    assert M.guess_schema(["foo"])["claim_id"] == ""


def test_mapping_json_round_trip():
    m = M.identity_mapping()
    assert M.mapping_from_json(M.mapping_to_json(m)) == m
    partial = M.mapping_from_json(json.dumps({"claim_id": "Claim", "paid": ["Paid"]}))
    assert partial["claim_id"] == "Claim" and partial["paid"] == "Paid" and partial["status"] == ""


def test_mapping_store_upsert_load_list(spark):
    store = M.empty_store(spark)
    t0, t1 = datetime(2024, 1, 1), datetime(2024, 2, 1)
    store = M.save_mapping(store, "t1", "broker-b", {"claim_id": "A"}, t0)
    store = M.save_mapping(store, "t1", "broker-a", {"claim_id": "B"}, t0)
    store = M.save_mapping(store, "t1", "broker-b", {"claim_id": "C"}, t1)
    store = M.save_mapping(store, "t2", "broker-z", {"claim_id": "D"}, t1)
    assert store.count() == 3
    assert M.load_mapping(store, "t1", "broker-b")["claim_id"] == "C"
    assert M.load_mapping(store, "t1", "nobody") is None
    assert [r[0] for r in M.list_counterparties(store, "t1").collect()] == ["broker-a", "broker-b"]


def test_export_layouts(sample_std):
    salt = "v1|s"
    std_csv = X.transform_export(sample_std, "standard_csv", masked=True, salt=salt)
    assert std_csv.columns[-3] == "claimant_masked" and len(std_csv.columns) == 14
    r = std_csv.orderBy("claim_id").first()
    assert r.claimant_masked == "xxxx xxx" and r.loss_date == "2023-01-05" and len(r.policy_number) == 64
    ebix = X.transform_export(sample_std, "ebix_v1", masked=True, salt=salt).orderBy("ClaimNumber").first()
    assert ebix.DateOfLoss == "05/01/2023" and ebix.Paid == Decimal("1200.00") and ebix.Outstanding == Decimal("300.00")
    ll = X.transform_export(sample_std, "lloyds_v5_2", masked=True, salt=salt).orderBy("Claim_Reference").first()
    assert ll.Outstanding_Reserves == Decimal("300.00") and ll.Loss_Date == "2023-01-05"
    sun = X.transform_export(sample_std, "sunrise_basic", masked=True, salt=salt)
    assert sun.columns == ["ClaimID", "LossDate", "ReportDate", "Paid", "Incurred", "OS", "CCY", "PolicyNo"]
    plain = X.transform_export(sample_std, "standard_csv", masked=False).orderBy("claim_id").first()
    assert plain.claimant == "Jane Doe" and plain.policy_number == "POL123" and plain.run_id == "r1"


def test_writers_and_bundle(spark, sample_std):
    d = tempfile.mkdtemp(prefix="lf-exp-")
    X.write_csv(X.transform_export(sample_std, "ebix_v1", masked=True, salt="s"), f"{d}/csv")
    back = spark.read.option("header", True).csv(f"{d}/csv")
    assert back.count() == 3 and "ClaimNumber" in back.columns
    iss = V.validate(sample_std, V.RuleConfig())
    doc = X.summary_json("r1", {"n_rows": 3}, {"n_rows": 3, "total_paid": Decimal(8700)}, "ebix_v1")
    out = X.write_bundle(f"{d}/bundle", {"clean": sample_std, "issues": iss.drop("rule_order")}, doc)
    assert set(out) == {"clean", "issues", "summary_json"}
    text = "\n".join(r.value for r in spark.read.text(out["summary_json"]).collect())
    assert json.loads(text)["Q"]["total_paid"] == 8700.0


def test_save_run_is_idempotent(spark, sample_std):
    root = tempfile.mkdtemp(prefix="lf-hist-")
    iss = V.validate(sample_std, V.RuleConfig.only("rule_zero_rows", "rule_multi_rows_per_claim"))
    hdr = H.run_header(sample_std, "r1", "t1", F.lit(datetime(2024, 1, 1)))
    H.save_run(hdr, iss, root)
    H.save_run(hdr, iss, root)
    runs = H.read_table(spark, root, "runs", H.RUNS_SCHEMA)
    assert runs.count() == 1 and runs.first().n_rows == 3
    hdr2 = H.run_header(sample_std, "r2", "t1", F.lit(datetime(2024, 3, 1)))
    H.save_run(hdr2, iss, root)
    assert H.read_table(spark, root, "runs", H.RUNS_SCHEMA).count() == 2


def test_retention_and_orphans(spark):
    runs = spark.createDataFrame([("old", datetime(2024, 1, 1)), ("new", datetime(2024, 3, 1)), ("nots", None)],
                                 "run_id string, ts_utc timestamp")
    kept = H.retention_filter(runs, "ts_utc", datetime(2024, 3, 10), 30)
    assert sorted(r.run_id for r in kept.collect()) == ["new", "nots"]
    issues = spark.createDataFrame([("old", 1), ("new", 2), (None, 3)], "run_id string, row long")
    assert [r.row for r in H.orphan_filter(issues, kept, "run_id").collect()] == [2]


def test_prune_and_delete_all(spark, sample_std):
    root = tempfile.mkdtemp(prefix="lf-prune-")
    iss = V.validate(sample_std, V.RuleConfig.only("rule_multi_rows_per_claim"))
    H.save_run(H.run_header(sample_std, "old", "t", F.lit(datetime(2020, 1, 1))), iss, root)
    H.save_run(H.run_header(sample_std, "new", "t", F.lit(datetime(2024, 1, 1))), iss, root)
    H.append_audit(spark, root, "run_completed", {"rows": 3})
    H.prune(spark, root, as_of=datetime(2024, 1, 15))
    assert [r.run_id for r in H.read_table(spark, root, "runs", H.RUNS_SCHEMA).collect()] == ["new"]
    H.delete_all(spark, root, confirm=True)
    assert H.read_table(spark, root, "runs", H.RUNS_SCHEMA).count() == 0


def test_audit_records(spark):
    ev = spark.createDataFrame([(datetime(2024, 1, 2, 3, 4, 5), "download_csv", '{"unmasked": false, "n": 2}',
                                 "x.csv")], "ts timestamp, event string, detail string, f string")
    rec = json.loads(H.audit_records(ev, file_col="f").first().json)
    assert rec == {"ts": "2024-01-02T03:04:05Z", "event": "download_csv", "detail": {"unmasked": False, "n": 2},
                   "file": "redacted", "app_version": lossframe.__version__}


#: No sample claim falls into this term: one issue for each row.
TERM_MISSED = V.RuleConfig.only("rule_policy_term").with_term(date(2024, 1, 1), date(2024, 12, 31))


def test_resaving_a_clean_run_clears_its_issues(spark, sample_std):
    root = tempfile.mkdtemp(prefix="lf-clean-")
    iss = V.validate(sample_std, TERM_MISSED)
    for run in ("a b/c=%", "r2"):
        H.save_run(H.run_header(sample_std, run, "t"), iss, root)
    n = iss.count()
    H.save_run(H.run_header(sample_std, "a b/c=%", "t"), iss.limit(0), root)
    left = H.read_table(spark, root, "issues", H.ISSUES_SCHEMA).groupBy("run_id").count().collect()
    assert [tuple(r) for r in left] == [("r2", n)]
    assert H.read_table(spark, root, "runs", H.RUNS_SCHEMA).count() == 2


def test_prune_under_either_overwrite_mode_and_unreadable_table(spark, sample_std, monkeypatch):
    iss = V.validate(sample_std, TERM_MISSED)
    own = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    for mode in ("static", "dynamic"):
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
        try:
            root = tempfile.mkdtemp(prefix="lf-modes-")
            H.save_run(H.run_header(sample_std, "old", "t", F.lit(datetime(2020, 1, 1))), iss, root)
            H.save_run(H.run_header(sample_std, "new", "t", F.lit(datetime(2024, 1, 1))), iss, root)
            assert H.prune(spark, root, as_of=datetime(2024, 1, 15)) == {"runs": 1, "issues": 1, "audit_log": 0}
            for name, schema in (("runs", H.RUNS_SCHEMA), ("issues", H.ISSUES_SCHEMA)):
                assert {r.run_id for r in H.read_table(spark, root, name, schema).collect()} == {"new"}
        finally:
            spark.conf.set("spark.sql.sources.partitionOverwriteMode", own)

    real = H.read_table

    def broken(spark, root, name, schema):
        if name == "issues":
            raise OSError("listing failed")
        return real(spark, root, name, schema)

    monkeypatch.setattr(H, "read_table", broken)
    with pytest.raises(OSError):
        H.prune(spark, root, as_of=datetime(2030, 1, 1))
    monkeypatch.undo()
    assert H.read_table(spark, root, "runs", H.RUNS_SCHEMA).count() == 1
    assert H.read_table(spark, root, "issues", H.ISSUES_SCHEMA).count() == iss.count()


def test_stored_mappings_upsert_with_equal_times(spark):
    root, t = tempfile.mkdtemp(prefix="lf-maps-"), datetime(2024, 1, 1)

    def rows(*r):
        return spark.createDataFrame(list(r), M.MAPPING_STORE_SCHEMA)

    M.store_mappings(spark, root, rows(("t", "a", "z", t), ("t", "b", "1", t)))
    M.store_mappings(spark, root, rows(("t", "a", "c", t)))
    got = {(r.counterparty, r.mapping_json) for r in H.read_table(spark, root, "saved_mappings", M.MAPPING_STORE_SCHEMA).collect()}
    assert got == {("a", "c"), ("b", "1")}


def test_failed_run_is_audited(spark, tmp_path):
    from lossframe.plans.claims_run import process
    (tmp_path / "x.pdf").write_bytes(b"no pdf")
    with pytest.raises(ValueError):
        process(spark, str(tmp_path), str(tmp_path / "root"), run_id="r", audit_salt="s")
    rows = H.read_table(spark, str(tmp_path / "root"), "audit_log", H.AUDIT_SCHEMA).collect()
    assert sorted(r.event for r in rows) == ["run_failed", "run_requested"]
    assert all(tmp_path.name not in r.detail_json for r in rows)


def test_release_tables(spark):
    from lossframe.session import persist_table, release_tables, stored_tables
    df = persist_table(spark.range(5), "five")
    path = stored_tables(spark)[-1]
    assert df.count() == 5 and release_tables(spark, [path]) == 1 and path not in stored_tables(spark)


def test_mapping_lookup_does_not_grow_with_the_event_types(spark, tmp_path, monkeypatch):
    import __spark_entry__ as E
    from lossframe.constants import STANDARD_FIELDS

    def one_by_one(*args, **kwargs):
        raise AssertionError("a plan step for each event type")

    monkeypatch.setattr(M, "save_mapping", one_by_one)
    spark.range(900).selectExpr("concat('kind ', lpad(id % 300 + 7, 4, '0')) AS event_type").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.field: r.source for r in E.queries()["mapping_lookup"](spark, str(tmp_path)).collect()}
    assert got == {f: {"claim_id": "kind 0007 no", "paid": "Paid"}.get(f, "") for f in STANDARD_FIELDS}


def test_mapping_lookup_matches_duckdb(spark):
    import __spark_entry__ as E
    from conftest import SF001
    from tools.compare_oracle import compare, duck

    r = compare(spark, duck(SF001), "mapping_lookup", E.queries()["mapping_lookup"], E.oracle_sql()["mapping_lookup"], SF001)
    assert r["ok"], r
