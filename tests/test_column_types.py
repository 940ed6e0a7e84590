"""Types and date orders learnt per file and column (F1, F2)."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from lossframe.operators import column_types as CT

ROWS = [
    ("us", "01/02/2023"), ("us", "12/25/2023"), ("us", "11/30/2023"), ("us", "3/4/23"), ("us", "12/31/22"), ("us", "31/12/2023"),
    ("au", "01/02/2023"), ("au", "25/12/2023"), ("au", "3.4.23"), ("au", "5 Jan 2023"), ("au", "Jan 6, 2023"),
    ("tie", "01/02/2023"), ("tie", None), ("tie", "  "),
    ("num", "45000"), ("num", "45,001.9"), ("num", "20000"), ("num", "6e4"), ("num", " 59999 "), ("num", None),
    ("txt", "45000"), ("txt", "n/a"), ("txt", "2023-01-05"), ("txt", "2023-01-05T10:00:00"), ("txt", "31/02/2023"),
    ("iso", "2023-01-05"), ("iso", "2023-01-05 10:00:00"), ("none", None), ("none", ""),
    (None, "13/01/2023"), (None, "02/03/2023"),
]
D = date
WANT = [
    D(2023, 1, 2), D(2023, 12, 25), D(2023, 11, 30), D(2023, 3, 4), D(2022, 12, 31), D(2023, 12, 31),
    D(2023, 2, 1), D(2023, 12, 25), D(2023, 4, 3), D(2023, 1, 5), D(2023, 1, 6),
    D(2023, 2, 1), None, None,
    D(2023, 3, 15), D(2023, 3, 16), None, None, D(2064, 4, 7), None,
    None, None, D(2023, 1, 5), D(2023, 1, 5), None,
    D(2023, 1, 5), D(2023, 1, 5), None, None,
    D(2023, 1, 13), D(2023, 3, 2),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, f, v, "kept") for i, (f, v) in enumerate(ROWS)], "i int, file string, v string, type string")


def parsed(df):
    return [r.v for r in df.orderBy("i").collect()]


def test_each_file_by_its_own_order_and_type(rows):
    out = CT.trained_dates(rows, ["v"], "file")
    assert out.columns == rows.columns and {r.type for r in out.collect()} == {"kept"}
    assert parsed(out) == WANT


def test_types(rows):
    got = {r.file: r.type for r in CT.column_rules(CT.profile(rows, ["v"], "file")).collect()}
    assert got == {"us": "text", "au": "text", "tie": "text", "num": "number", "txt": "text", "iso": "date", "none": "empty",
                   None: "text"}


def test_rules_beyond_the_broadcast_bound(rows, monkeypatch):
    monkeypatch.setattr(CT, "BROADCAST_RULES", 0)
    assert parsed(CT.trained_dates(rows, ["v"], "file")) == WANT


def test_one_locale_only(rows):
    """Without other locales' orders the result is that of the fixed list, but for numbers in text columns."""
    got = parsed(CT.trained_dates(rows, ["v"], "file", across=False))
    assert got[:6] == [D(2023, 2, 1), None, None, D(2023, 4, 3), None, D(2023, 12, 31)] and got[10] is None and got[11:] == WANT[11:]
    us = parsed(CT.trained_dates(rows, ["v"], "file", locale="US"))
    assert us[11] == D(2023, 1, 2) and us[:11] == WANT[:11]
    with pytest.raises(ValueError, match="unknown locale"):
        CT.date_orders("XX")


def test_profiles_add_up(rows):
    whole = CT.profile(rows, ["v"], "file")
    parts = [CT.profile(rows.where(F.col("i") % 3 == k), ["v"], "file") for k in range(3)]
    merged = CT.merge_profiles(*parts, orders=7)
    assert sorted((r.file or "", r.n, r.n_number, r.n_date, r.n_order) for r in merged.collect()) == sorted(
        (r.file or "", r.n, r.n_number, r.n_date, r.n_order) for r in whole.collect())
    rules = CT.column_rules(merged)
    assert parsed(CT.trained_dates(rows, ["v"], "file", rules=rules)) == WANT


def test_several_fields_and_no_rows(spark, rows):
    both = rows.withColumn("w", F.when(F.col("file") == "us", "45000").otherwise(F.col("v")))
    out = CT.trained_dates(both, ["v", "w"], "file").orderBy("i").collect()
    assert [r.v for r in out] == WANT and [r.w for r in out] == [D(2023, 3, 15)] * 6 + WANT[6:]
    assert CT.trained_dates(rows.limit(0), ["v"], "file").count() == 0


def test_intake_reads_each_file_in_its_own_order(spark, tmp_path):
    from lossframe.plans.claims_run import intake

    for name, text in (("a.csv", "claim_id,loss_date,report_date\nA1,12/25/2023,45300\nA2,01/02/2023,45301\n"),
                       ("b.csv", "claim_id;loss_date;report_date\nB1;25/12/2023;45300\nB2;01/02/2023;x\n")):
        (tmp_path / name).write_text(text)
    std, _ = intake(spark, str(tmp_path), train_dates=True)
    got = [(r.row_id, r.claim_id, r.loss_date, r.report_date) for r in std.orderBy("row_id").collect()]
    assert got == [(1, "A1", D(2023, 12, 25), D(2024, 1, 9)), (2, "A2", D(2023, 1, 2), D(2024, 1, 10)),
                   (3, "B1", D(2023, 12, 25), None), (4, "B2", D(2023, 2, 1), None)]
    plain, _ = intake(spark, str(tmp_path))
    assert [r.loss_date for r in plain.orderBy("row_id").collect()] == [None, D(2023, 2, 1), D(2023, 12, 25), D(2023, 2, 1)]
