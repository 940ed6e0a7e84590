"""Scalar tables for the parsers, masking and helpers (F1-F16, M1)."""

import hmac
import hashlib
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lossframe.functions import amounts as A
from lossframe.functions import dates as D
from lossframe.functions import names as N
from lossframe.functions import privacy as P


def _col(spark, values, dtype="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {dtype}")


AU_CASES = [
    ("05/01/2023", date(2023, 1, 5)), ("5/1/2023", date(2023, 1, 5)), ("2023-01-05", date(2023, 1, 5)),
    ("05.01.2023", date(2023, 1, 5)), ("5 Jan 2023", date(2023, 1, 5)), ("5-Jan-2023", date(2023, 1, 5)),
    ("2023/01/05", date(2023, 1, 5)), ("05/01/23", date(2023, 1, 5)), ("05/01/70", date(1970, 1, 5)),
    ("05/01/68", date(2068, 1, 5)), ("Jan 5, 2023", None), ("31/02/2023", None), ("n/a", None), ("", None),
    (None, None), ("  05/01/2023\t", date(2023, 1, 5)), ("2023-01-05T10:11:12", date(2023, 1, 5)),
    ("45000", date(2023, 3, 15)), ("20000", None), ("20001", date(1954, 10, 4)), ("59999", date(2064, 4, 7)),
    ("60000", None), ("29/02/2024", date(2024, 2, 29)), ("29/02/2023", None), ("00/01/2023", None),
    ("5/13/2023", None), ("5-jan-2023", date(2023, 1, 5)), ("5 JAN 2023", date(2023, 1, 5)),
    ("5 Jnx 2023", None), ("05//01--2023", date(2023, 1, 5)), ("0000-01-05", None),
]
US_CASES = [("05/01/2023", date(2023, 5, 1)), ("Jan 5, 2023", date(2023, 1, 5)), ("5 Jan 2023", None),
            ("2023-01-05", date(2023, 1, 5)), ("12/31/99", date(1999, 12, 31))]


@pytest.mark.parametrize("locale,cases", [("AU", AU_CASES), ("US", US_CASES)])
def test_parse_date_text(spark, locale, cases):
    df = _col(spark, [c[0] for c in cases])
    got = [r[0] for r in df.select(D.parse_date_text(F.col("v"), locale)).collect()]
    assert got == [c[1] for c in cases]


@pytest.mark.parametrize("locale,cases", [("AU", AU_CASES), ("US", US_CASES)])
def test_staged_date_parse_in_standardize_agrees(spark, locale, cases):
    from lossframe.operators.standardize import standardize
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, v string")
    std = standardize(df, {"loss_date": "v"}, locale=locale, keep=["i"])
    got = [r.loss_date for r in std.orderBy("i").collect()]
    assert got == [c[1] for c in cases]


def test_excel_serial_numeric(spark):
    df = _col(spark, [20000.0, 20000.5, 45000.0, 59999.9, 60000.0, None], "double")
    got = [r[0] for r in df.select(D.parse_date(F.col("v"), df.schema["v"].dataType)).collect()]
    assert got == [None, date(1954, 10, 3), date(2023, 3, 15), date(2064, 4, 7), None, None]


AMOUNTS = [
    ("$ 1,234.50", Decimal("1234.5")), ("(500)", Decimal("-500")), ("−75.25", Decimal("-75.25")),
    ("-75.25", Decimal("-75.25")), ("5.", Decimal("5")), (".5", Decimal("0.5")), ("5-", None),
    ("1.2.3", None), ("-", None), ("", None), (None, None), ("$(500)", Decimal("500")),
    ("1e5", Decimal("100000")), ("AUD 1,000", Decimal("1000")), ("  (1,234.56)  ", Decimal("-1234.56")),
]


def test_clean_amount_text(spark):
    df = _col(spark, [a[0] for a in AMOUNTS])
    got = [r[0] for r in df.select(A.clean_amount_text(F.col("v"))).collect()]
    assert got == [a[1] for a in AMOUNTS]


def test_clean_amount_numeric_no_text_round_trip(spark):
    df = _col(spark, [100000.0, 12345678.0], "double")
    got = [r[0] for r in df.select(A.clean_amount(F.col("v"), df.schema["v"].dataType)).collect()]
    assert got == [Decimal("100000"), Decimal("12345678")]


def test_fill_incurred(spark):
    d = Decimal
    df = spark.createDataFrame([(None, d(1), d(2)), (None, None, d(2)), (d(5), d(1), d(2))],
                               "i decimal(28,6), p decimal(28,6), o decimal(28,6)")
    got = [r[0] for r in df.select(A.fill_incurred(F.col("i"), F.col("p"), F.col("o"))).collect()]
    assert got == [Decimal(3), None, Decimal(5)]


def test_two_decimals_ok(spark):
    df = spark.createDataFrame([(Decimal("1.25"),), (Decimal("2.5"),), (None,)], "v decimal(28,6)")
    assert df.agg(A.two_decimals_ok(F.col("v"))).first()[0] is True
    df2 = spark.createDataFrame([(Decimal("1.255"),)], "v decimal(28,6)")
    assert df2.agg(A.two_decimals_ok(F.col("v"))).first()[0] is False
    empty = spark.createDataFrame([(None,)], "v decimal(28,6)")
    assert empty.agg(A.two_decimals_ok(F.col("v"))).first()[0] is True


def test_format_num(spark):
    df = spark.createDataFrame([(Decimal("1234.5"),), (Decimal("1200"),), (None,), (Decimal("0.25"),)],
                               "v decimal(28,6)")
    assert [r[0] for r in df.select(A.format_num(F.col("v"))).collect()] == ["1,234.5", "1,200", "NA", "0.25"]


def test_normalize_name():
    assert N.normalize_name("Claim Number") == "claim_number"
    assert N.normalize_name("  Date of Loss (AU) ") == "date_of_loss_au"
    assert N.normalize_name("__Paid__Total__") == "paid_total"
    assert N.normalize_name("O/S Amount") == "o_s_amount"


def test_normalize_name_col_matches_driver(spark):
    names = ["Claim Number", "  Date of Loss (AU) ", "__Paid__Total__", "Policy #"]
    got = [r[0] for r in _col(spark, names).select(N.normalize_name_col(F.col("v"))).collect()]
    assert got == [N.normalize_name(n) for n in names]


def test_norm_id_trims_tabs_and_newlines(spark):
    got = [r[0] for r in _col(spark, [" C-1\t", "\nc-1 ", None]).select(N.norm_id(F.col("v"))).collect()]
    assert got == ["c-1", "c-1", None]


def test_mask_claimant_ascii_only(spark):
    got = [r[0] for r in _col(spark, ["Jane Doe", "Zoë 2", None]).select(P.mask_claimant(F.col("v"))).collect()]
    assert got == ["xxxx xxx", "xxë 2", None]


@pytest.mark.parametrize("key", ["v1|salt", "k" * 64, "long-key-" * 20, "ünïcode"])
def test_hmac_matches_python(spark, key):
    msgs = ["POL123", "POL-42", "ß-policy"]
    got = [r[0] for r in _col(spark, msgs).select(P.hmac_sha256_col(F.col("v"), key)).collect()]
    want = [hmac.new(key.encode(), m.encode(), hashlib.sha256).hexdigest() for m in msgs]
    assert got == want


def test_mask_policy_keeps_null_and_blank(spark):
    got = [r[0] for r in _col(spark, [None, "", "POL1"]).select(P.mask_policy(F.col("v"), "s")).collect()]
    assert got[:2] == [None, ""] and len(got[2]) == 64


def test_choose_salt():
    assert P.choose_salt("x").source == "env"
    t = P.choose_salt("", "master", "tenant")
    assert t.source == "tenant" and t.value == "v1|" + P.hmac_sha256_hex("master", "tenant")
    e1, e2 = P.choose_salt(), P.choose_salt()
    assert e1.source == "ephemeral" and e1.value != e2.value


def test_scrub_name(spark):
    df = _col(spark, ["a.csv"])
    assert df.select(P.scrub_name(F.col("v"), hide=False)).first()[0] == "a.csv"
    assert df.select(P.scrub_name(F.col("v"))).first()[0] == "redacted"
    assert df.select(P.scrub_name(F.col("v"), audit_salt="k")).first()[0] == P.hmac_sha256_hex("k", "a.csv")


def test_dev_months(spark):
    df = spark.createDataFrame([(date(2023, 1, 31), date(2023, 2, 1)), (date(2023, 3, 5), date(2023, 1, 9)),
                                (date(2022, 12, 1), date(2025, 12, 31))], "l date, r date")
    got = [r[0] for r in df.select(D.dev_months(F.col("l"), F.col("r"))).collect()]
    assert got == [1, 0, 36]


def test_format_date(spark):
    df = spark.createDataFrame([(date(2023, 1, 5),)], "d date")
    assert df.select(D.format_date(F.col("d"), "iso"), D.format_date(F.col("d"), "au")).first() == \
        ("2023-01-05", "05/01/2023")


def test_full_month_names_in_both_locales(spark):
    texts = ["5 January 2023", "5 June 2023", "05-September-2023", "5 Sept 2023", "5 Janu 2023", "5 may 2023", "5 Marchx 2023"]
    us = ["January 5, 2023", "june 5 2023", "September-05-2023", "Sept 5 2023", "Janu 5 2023", "MAY 5 2023", "Marchx 5 2023"]
    want = ["2023-01-05", "2023-06-05", "2023-09-05", None, None, "2023-05-05", None]
    for locale, own in (("AU", texts), ("US", us)):
        df = _col(spark, own)
        assert [None if r[0] is None else str(r[0]) for r in df.select(D.parse_date_text(F.col("v"), locale)).collect()] == want
        s, c = D.date_text_parts(F.col("v"))
        kind, *p = D.date_kind_fields(c, locale)
        got = df.select(D.date_from_ymd(s, *D.date_ymd(kind, p, locale))).collect()
        assert [None if r[0] is None else str(r[0]) for r in got] == want
