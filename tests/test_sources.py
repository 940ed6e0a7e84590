"""File intake: CSV read, checks, hashes, text lines, header promotion, layout JSON, streaming."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from lossframe.operators.mapping import guess_schema
from lossframe.operators.standardize import standardize
from lossframe.sources import files as S
from lossframe.sources import layout as L
from lossframe.sources.samples import SAMPLE_HEADER, SAMPLE_ROWS


def _write(path, data: bytes):
    with open(path, "wb") as f:
        f.write(data)


def _csv_text(rows, header):
    lines = [",".join(header)] + [",".join("" if v is None else v for v in r) for r in rows]
    return ("\n".join(lines) + "\n").encode()


def test_read_csv_all_text_with_lineage_and_na(spark):
    d = tempfile.mkdtemp(prefix="lf-csv-")
    _write(f"{d}/a.csv", b'Claim No, Paid Amount ,Date of Loss\nC-1,"$ 1,000",05/01/2023\nNA,(20),\n')
    _write(f"{d}/b.csv", b"Claim No,Paid Amount,Date of Loss\nC-2,5,2023-02-01\n")
    raw = S.read_csv(spark, [f"{d}/a.csv", f"{d}/b.csv"])
    assert all(t == "string" for _, t in raw.dtypes)
    m = guess_schema([c for c in raw.columns if c != "source_file"])
    assert m["claim_id"] == "Claim No" and m["paid"] == "Paid Amount" and m["loss_date"] == "Date of Loss"
    std = standardize(raw, m, source_file=F.col("source_file"))
    got = sorted((r.source_file, str(r.claim_id), str(r.paid), str(r.loss_date)) for r in std.collect())
    assert got == [("a.csv", "C-1", "1000.000000", "2023-01-05"), ("a.csv", "None", "-20.000000", "None"),
                   ("b.csv", "C-2", "5.000000", "2023-02-01")]


def test_union_files_fills_missing_columns(spark):
    a = spark.createDataFrame([("1", "x")], "k string, a string")
    b = spark.createDataFrame([("2", "y")], "k string, b string")
    u = S.union_files([a, b]).orderBy("k").collect()
    assert [tuple(r) for r in u] == [("1", "x", None), ("2", None, "y")]


def test_file_checks(spark):
    d = tempfile.mkdtemp(prefix="lf-files-")
    _write(f"{d}/ok.csv", b"a,b\n1,2\n")
    _write(f"{d}/zip_in_disguise.csv", b"PK\x03\x04rest")
    _write(f"{d}/real.pdf", b"%PDF-1.7 ...")
    _write(f"{d}/fake.pdf", b"hello")
    _write(f"{d}/book.xlsx", b"PK\x03\x04xl")
    _write(f"{d}/old.xls", bytes([0xD0, 0xCF, 0x11, 0xE0, 0xA1, 0xB1, 0x1A, 0xE1]) + b"..")
    _write(f"{d}/notes.txt", b"hi")
    _write(f"{d}/big.csv", b"x" * 3000)
    res = {os.path.basename(r.path): (r.ok, r.reason)
           for r in S.file_checks(spark, f"{d}/*", max_mb=2000 / 1024 / 1024).collect()}
    assert res["ok.csv"] == (True, None)
    assert res["zip_in_disguise.csv"][0] is False and res["fake.pdf"][0] is False
    assert res["real.pdf"] == (True, None) and res["book.xlsx"] == (True, None) and res["old.xls"] == (True, None)
    assert res["notes.txt"] == (False, "unsupported type")
    assert res["big.csv"] == (False, "file too large")
    assert {os.path.basename(r.path) for r in S.file_checks(spark, f"{d}/*").where("ok").collect()} >= {"big.csv"}  # no cap by default
    assert S.read_heads(spark, [f"{d}/real.pdf"], 5) == {f"{d}/real.pdf": b"%PDF-"}


def test_read_csv_by_header_with_quotes_and_line_breaks(spark):
    d = tempfile.mkdtemp(prefix="lf-csv2-")
    _write(f"{d}/a.csv", b'claim_id,paid\nA1,100\n"Smith ""Bob"" Ltd, The","two\nlines"\n')
    _write(f"{d}/b.csv", b"paid,claim_id,extra\n500,B1,x\n")
    _write(f"{d}/empty.csv", b"")
    rows = sorted((r.source_file, r.claim_id, r.paid, r.extra) for r in S.read_csv(spark, d).collect())
    assert rows == [("a.csv", "A1", "100", None), ("a.csv", 'Smith "Bob" Ltd, The', "two\nlines", None),
                    ("b.csv", "B1", "500", "x")]


def test_intake_checks_reads_and_maps_each_file(spark):
    from lossframe.plans.claims_run import intake
    d = tempfile.mkdtemp(prefix="lf-intake-")
    _write(f"{d}/a.csv", b"claim_no,paid_amount\nA1,100\nA2,5\n")
    _write(f"{d}/b.csv", b"Paid,Claim ID\n7,B1\n")
    _write(f"{d}/c.csv", b"PK\x03\x04zip")
    _write(f"{d}/d.csv", b"x,y\nclaim_id,paid\nD1,9\n")
    std, checks = intake(spark, d, promote=False)
    assert sorted(os.path.basename(r.path) for r in checks.where("NOT ok").collect()) == ["c.csv"]
    got = [(r.row_id, r.source_file, r.claim_id, None if r.paid is None else int(r.paid)) for r in std.orderBy("row_id").collect()]
    assert got[:3] == [(1, "a.csv", "A1", 100), (2, "a.csv", "A2", 5), (3, "b.csv", "B1", 7)]
    os.remove(f"{d}/a.csv")
    os.remove(f"{d}/b.csv")
    promoted, _ = intake(spark, d, promote=True)
    assert [(r.claim_id, None if r.paid is None else int(r.paid)) for r in promoted.collect()] == [("D1", 9)]


def test_content_hash_dups_and_file_hashes(spark):
    df = spark.createDataFrame([(1, "same"), (2, "same"), (3, "other"), (4, None)], "id long, t string")
    got = [tuple(r) for r in S.content_hash_dups(df, "id", "t").collect()]
    import hashlib
    assert got == [(hashlib.sha256(b"same").hexdigest(), 2, 1)]


def test_text_lines_r_semantics(spark):
    df = spark.createDataFrame([(1, "a\nb\n"), (2, "x"), (3, "p\n\nq"), (4, ""), (5, None)], "id long, t string")
    got = sorted(tuple(r) for r in S.text_lines(df, "id", "t").collect())
    assert got == [(1, 1, "a"), (1, 2, "b"), (2, 1, "x"), (3, 1, "p"), (3, 2, ""), (3, 3, "q")]


def test_text_sufficiency(spark):
    df = spark.createDataFrame([(1, "a b\tc\n" * 150), (2, "short")], "id long, t string")
    got = {r.id: (r.nonspace_chars, r.has_text) for r in S.text_sufficiency(df, "id", "t").collect()}
    assert got == {1: (450, True), 2: (5, False)}


def test_promote_header(spark):
    rows = [(1, "Claim No", "Paid", ""), (2, "C-1", "10", "x"), (3, "C-2", "20", "y")]
    df = spark.createDataFrame(rows, "line int, c1 string, c2 string, c3 string")
    out = S.promote_header(df, True, order_col="line")
    assert out.columns == ["line", "Claim.No", "Paid", "X"]
    assert out.count() == 2
    sparse = spark.createDataFrame([(1, "A", "", ""), (2, "x", "y", "z")], "line int, c1 string, c2 string, c3 string")
    assert S.promote_header(sparse, True, order_col="line").columns == sparse.columns


def test_promote_header_by_file(spark):
    rows = [(1, "a", "Claim No", "Paid"), (2, "a", "A1", "10"), (1, "b", "Paid", "Claim No"), (2, "b", "20", "B1"),
            (1, "c", "only", ""), (2, "c", "x", "y"), (None, "a", "A2", "30"), (1, "d", "one", "row")]
    df = spark.createDataFrame(rows, "line int, f string, c1 string, c2 string")
    out = S.promote_header(df, True, order_col="line", file_col="f")
    got = sorted((r.f, r["Claim.No"], r.Paid, r.c1, r.c2) for r in out.collect() if r.f in "ab")
    assert got == [("a", "A1", "10", None, None), ("a", "A2", "30", None, None), ("b", "B1", "20", None, None)]
    rest = sorted((r.f, r.c1, r.c2) for r in out.collect() if r.f in "cd")
    assert rest == [("c", "only", ""), ("c", "x", "y"), ("d", "one", "row")]


def test_layout_of_one_column_tables_and_absurd_counts(spark):
    docs = [{"analyzeResult": {"tables": [{"rowCount": 2, "columnCount": 1, "cells": [
                {"rowIndex": 0, "columnIndex": 0, "content": "a"}, {"rowIndex": 1, "columnIndex": 0, "content": "b"}]}]}},
            {"analyzeResult": {"tables": [{"rowCount": 2000000000, "columnCount": 2000000000, "cells": [
                {"rowIndex": 0, "columnIndex": 0, "content": "c", "columnSpan": 2000000000}]}]}}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "doc_id long, json string")
    one = L.layout_tables(df.where("doc_id = 0"))
    assert [(r.row_no, r.V1) for r in one.orderBy("row_no").collect()] == [(0, "a"), (1, "b")]
    with pytest.raises(ValueError, match="layout document 1"):  # counts are taken as they are, or refused
        L.layout_tables(df.where("doc_id = 1"))
    with pytest.raises(ValueError):
        L.layout_tables(df, max_columns=1)


def test_layout_tables(spark):
    doc = {"analyzeResult": {"tables": [
        {"rowCount": 3, "columnCount": 3, "boundingRegions": [{"pageNumber": 2}],
         "cells": [
             {"rowIndex": 0, "columnIndex": 0, "content": "Claim", "columnSpan": 2},
             {"rowIndex": 0, "columnIndex": 1, "content": "ignored (taken by span)"},
             {"rowIndex": 0, "columnIndex": 2, "content": ""},
             {"rowIndex": 0, "columnIndex": 2, "text": "Paid"},
             {"rowIndex": 1, "columnIndex": 0, "content": "C-1", "rowSpan": 2000000000},
             {"rowIndex": 9, "columnIndex": 0, "content": "outside the table"},
             {"rowIndex": 1, "columnIndex": 2, "content": "10"},
         ]},
        {"rowCount": 0, "columnCount": 2, "cells": []},
        {"rowCount": 1, "columnCount": 1, "cells": [{"rowIndex": 0, "columnIndex": 0, "content": "solo"}]},
    ]}}
    docs = spark.createDataFrame([(7, json.dumps(doc))], "doc_id long, json string")
    wide = L.layout_tables(docs).orderBy("table_no", "row_no").collect()
    got = [(r.table_no, r.row_no, r.V1, r.V2, r.V3, r["..source_page.."]) for r in wide]
    assert got == [(0, 0, "Claim", "Claim", "Paid", 2), (0, 1, "C-1", "", "10", 2), (0, 2, "C-1", "", "", 2),
                   (2, 0, "solo", None, None, None)]


def test_streaming_intake_matches_batch_rules(spark):
    from lossframe.operators.mapping import identity_mapping
    from lossframe.streaming.ingest import start
    land = tempfile.mkdtemp(prefix="lf-land-")
    out = tempfile.mkdtemp(prefix="lf-out-") + "/issues"
    ck = tempfile.mkdtemp(prefix="lf-ck-")
    rows = list(SAMPLE_ROWS) + [(None, "", "", "31/02/2023", "2023-01-01", "(5)", "1", "", "XXX", "", "Open", "")]
    _write(f"{land}/f1.csv", _csv_text([tuple("" if v is None else v for v in r) for r in rows], SAMPLE_HEADER))
    q = start(spark, land, SAMPLE_HEADER, identity_mapping(), out, ck)
    q.awaitTermination(120)
    got = sorted((r.claim_id, r.issue) for r in spark.read.parquet(out).collect())
    issues = {i for _, i in got}
    assert "Missing required fields" in issues and "Unrecognised currency" in issues
    assert "Negative paid" in issues and "Missing policy number" in issues
    assert all(c is None or c == "" for c, _ in got)


def test_streaming_restart_is_exactly_once(spark):
    from lossframe.operators.mapping import identity_mapping
    from lossframe.streaming.ingest import start
    land = tempfile.mkdtemp(prefix="lf-land2-")
    out = tempfile.mkdtemp(prefix="lf-out2-") + "/issues"
    ck = tempfile.mkdtemp(prefix="lf-ck2-")
    bad = (None, "", "", "n/a", "", "(5)", "", "", "XXX", "", "", "")
    _write(f"{land}/a.csv", _csv_text([tuple("" if v is None else v for v in bad)], SAMPLE_HEADER))
    start(spark, land, SAMPLE_HEADER, identity_mapping(), out, ck).awaitTermination(120)
    first = spark.read.parquet(out).count()
    assert first > 0
    # restart on the same checkpoint with no new files: nothing is appended again
    start(spark, land, SAMPLE_HEADER, identity_mapping(), out, ck).awaitTermination(120)
    assert spark.read.parquet(out).count() == first
    # a new file is picked up once, alone
    _write(f"{land}/b.csv", _csv_text([tuple("" if v is None else v for v in bad)], SAMPLE_HEADER))
    start(spark, land, SAMPLE_HEADER, identity_mapping(), out, ck).awaitTermination(120)
    files = {r.source_file for r in spark.read.parquet(out).collect()}
    assert spark.read.parquet(out).count() == 2 * first and files == {"a.csv", "b.csv"}


def test_streaming_replay_of_an_uncommitted_batch(spark):
    """A batch whose commit was lost is written again, not added."""
    from lossframe.operators.mapping import identity_mapping
    from lossframe.streaming.ingest import start
    land = tempfile.mkdtemp(prefix="lf-land3-")
    out = tempfile.mkdtemp(prefix="lf-out3-") + "/issues"
    ck = tempfile.mkdtemp(prefix="lf-ck3-")
    bad = (None, "", "", "n/a", "", "(5)", "", "", "XXX", "", "", "")
    _write(f"{land}/a.csv", _csv_text([tuple("" if v is None else v for v in bad)], SAMPLE_HEADER))
    start(spark, land, SAMPLE_HEADER, identity_mapping(), out, ck).awaitTermination(120)
    first = sorted(map(tuple, spark.read.parquet(out).collect()), key=str)
    for name in os.listdir(f"{ck}/commits"):
        os.remove(f"{ck}/commits/{name}")
    start(spark, land, SAMPLE_HEADER, identity_mapping(), out, ck).awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(out).collect()), key=str) == first and first


def test_layout_documents_of_a_large_nation_are_bounded(spark, tmp_path):
    import __spark_entry__ as E
    from lossframe.plans import stores

    n = 2300
    cu = spark.range(1, n + 1).selectExpr("id AS c_custkey", "IF(id % 10 = 0, 1, 2) AS c_nationkey",
                                          "concat('n', id) AS c_name", "concat('s', id) AS c_mktsegment")
    cu.write.parquet(f"{tmp_path}/customer.parquet")
    got = sorted(tuple(r) for r in E.queries()["layout_tables"](spark, str(tmp_path)).select("doc_id", "row_no", "V1", "V2").collect())
    two = [i for i in range(1, n + 1) if i % 10]
    assert got == ([(1, k, f"n{i}", None) for k, i in enumerate(range(10, n + 1, 10))]
                   + [(2, k, f"n{i}", f"s{i}") for k, i in enumerate(two)])
    sizes = stores.nation_documents(cu).selectExpr("CAST(get_json_object(json, '$.analyzeResult.tables[0].rowCount') AS INT) AS n")
    assert sizes.agg({"n": "max"}).first()[0] <= stores.BLOCK_KEYS
