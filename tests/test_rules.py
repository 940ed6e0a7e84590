"""Rule behaviour on small frames, checked against brute force."""

from datetime import date
from decimal import Decimal

import pytest

from lossframe import constants as K
from lossframe.operators import rules as V
from lossframe.operators.quantiles import quantiles

SCHEMA = ("row_id long, claim_id string, loss_date date, report_date date, paid decimal(28,6), "
          "incurred decimal(28,6), outstanding decimal(28,6), currency string, policy_number string, "
          "status string, claimant string")
D = Decimal


def frame(spark, rows):
    full = []
    for i, r in enumerate(rows, start=1):
        base = dict(row_id=i, claim_id="C1", loss_date=date(2023, 1, 1), report_date=date(2023, 1, 2),
                    paid=D(10), incurred=D(10), outstanding=D(0), currency="AUD", policy_number="P",
                    status="Open", claimant="A")
        base.update(r)
        full.append(tuple(base[c.split()[0]] for c in SCHEMA.split(", ")))
    return spark.createDataFrame(full, SCHEMA)


def issues(df, *rules, **kw):
    return sorted((r.row, r.issue, r.detail) for r in V.validate(df, V.RuleConfig.only(*rules, **kw)).collect())


def test_duplicates_normalise_ids_and_group_nulls(spark):
    df = frame(spark, [dict(claim_id="C-1"), dict(claim_id=" c-1 "), dict(claim_id="C-2"),
                       dict(claim_id=None), dict(claim_id=None), dict(claim_id=None, loss_date=None),
                       dict(claim_id=None, loss_date=None)])
    got = [r for r, _, _ in issues(df, "rule_duplicates")]
    assert got == [2, 5, 7]


def test_multi_rows_per_claim_counts_null_group(spark):
    df = frame(spark, [dict(claim_id="A"), dict(claim_id="A"), dict(claim_id="B"), dict(claim_id=None),
                       dict(claim_id=None), dict(claim_id=None), dict(claim_id="")])
    got = issues(df, "rule_multi_rows_per_claim")
    assert got == [(1, K.ISSUE_MULTI_ROWS, "n=2"), (2, K.ISSUE_MULTI_ROWS, "n=2"),
                   (4, K.ISSUE_MULTI_ROWS, "n=3"), (5, K.ISSUE_MULTI_ROWS, "n=3"), (6, K.ISSUE_MULTI_ROWS, "n=3")]


def test_row_local_rules(spark):
    df = frame(spark, [
        dict(claim_id=""),                                      # 1 required
        dict(paid=D(-1), incurred=D(-1), outstanding=D(0)),     # 2 neg paid, neg incurred
        dict(paid=D(10), incurred=D(5), outstanding=D(-5)),     # 3 inc<paid, neg os
        dict(paid=D(10), incurred=D(12), outstanding=D(1)),     # 4 reconcile
        dict(currency="XXX"),                                   # 5 currency
        dict(currency=""),                                      # 6 currency + missing currency
        dict(loss_date=date(2023, 2, 1)),                       # 7 date order
        dict(policy_number=""), dict(claimant=None),            # 8, 9
        dict(paid=D(0), incurred=D(0)),                         # 10 zero
        dict(paid=D(1), incurred=D("2.01"), outstanding=D("1.01")),  # 11 ratio > 2
        dict(report_date=None),                                 # 12 required + unparseable report
    ])
    got = issues(df, "rule_required_fields", "rule_negative_values", "rule_incurred_lt_paid", "rule_reconcile",
                 "rule_currency_list", "rule_date_order", "rule_missing_policy", "rule_missing_currency",
                 "rule_missing_claimant", "rule_zero_rows", "rule_high_ratio", "rule_parse_dates")
    by_row = {}
    for r, i, _ in got:
        by_row.setdefault(r, []).append(i)
    assert by_row[1] == [K.ISSUE_REQUIRED]
    assert sorted(by_row[2]) == sorted([K.ISSUE_NEG_PAID, K.ISSUE_NEG_INCURRED])
    assert sorted(by_row[3]) == sorted([K.ISSUE_NEG_OUTSTANDING, K.ISSUE_INC_LT_PAID])
    assert by_row[4] == [K.ISSUE_RECONCILE]
    assert by_row[5] == [K.ISSUE_CURRENCY]
    assert sorted(by_row[6]) == sorted([K.ISSUE_CURRENCY, K.ISSUE_MISSING_CURRENCY])
    assert by_row[7] == [K.ISSUE_DATE_ORDER]
    assert by_row[8] == [K.ISSUE_MISSING_POLICY] and by_row[9] == [K.ISSUE_MISSING_CLAIMANT]
    assert by_row[10] == [K.ISSUE_ZERO_ROWS] and by_row[11] == [K.ISSUE_HIGH_RATIO]
    assert sorted(by_row[12]) == sorted([K.ISSUE_REQUIRED, K.ISSUE_UNPARSE_REPORT])


def _type7(xs, p):
    xs = sorted(xs)
    h = (len(xs) - 1) * Decimal(str(p))
    lo = int(h)
    hi = min(lo + 1, len(xs) - 1)
    return xs[lo] + (h - lo) * (xs[hi] - xs[lo])


@pytest.mark.parametrize("values", [
    [D(v) for v in (1, 2, 3, 4, 100)],
    [D(v) for v in (5, 5, 5, 5, 5, 5, 7)],
    [D(i % 37) * D("1.25") for i in range(1, 400)] + [D(0)] * 300,  # a hot value holding ~40% of rows
])
def test_exact_quantiles_match_brute_force(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "paid decimal(28,6)")
    n, (q1, q3) = quantiles(df, "paid", [0.25, 0.75])
    assert n == len(values)
    assert q1 == _type7(values, 0.25) and q3 == _type7(values, 0.75)


def test_paid_outliers_fence_and_detail(spark):
    vals = [1, 2, 3, 4, 5, 6, 7, 8, 9, 100]
    df = frame(spark, [dict(paid=D(v), incurred=D(v)) for v in vals])
    got = issues(df, "rule_paid_outliers")
    assert got == [(10, K.ISSUE_PAID_OUTLIER, "IQR fence: [0..14.5] (mult=1.5)")]


def test_outliers_need_five_values(spark):
    df = frame(spark, [dict(paid=D(v)) for v in (1, 2, 3, 1000)])
    assert issues(df, "rule_paid_outliers") == []


def test_row_flags_and_top_issues(spark):
    df = frame(spark, [dict(claim_id="", currency="XXX"), dict(), dict(paid=D(-1), incurred=D(-1))])
    cfg = V.RuleConfig.only("rule_required_fields", "rule_currency_list", "rule_negative_values")
    iss = V.validate(df, cfg)
    flags = {r.row_id: (r.flags, r.flags_detail) for r in V.row_flags_one_pass(df, cfg).collect()}
    assert flags[1] == ("Missing required fields; Unrecognised currency",
                        "claim_id/loss_date/report_date | " + K.DETAIL_CURRENCY)
    assert flags[2] == (None, None)
    assert flags[3] == ("Negative paid; Negative incurred", "paid < 0 | incurred < 0")
    top = [(r.row, r.issue) for r in V.top_issues(iss, 2).collect()]
    assert top == [(1, K.ISSUE_REQUIRED), (3, K.ISSUE_NEG_PAID)]
    ann = V.annotate(df, cfg)
    assert [r.row_id for r in V.flagged_rows(ann, [K.ISSUE_CURRENCY]).collect()] == [1]
    assert sorted(r.row_id for r in V.flagged_rows(ann).collect()) == [1, 3]
    assert "Join" not in V.flagged_rows(ann)._jdf.queryExecution().executedPlan().toString()


def test_rule_packs_are_exactly_their_rules():
    uw = V.RuleConfig.pack("underwriter")
    assert uw.rule_paid_outliers and uw.rule_high_ratio and not uw.rule_duplicates
    qa = V.RuleConfig.pack("claims_qa")
    assert qa.rule_zero_rows and qa.rule_duplicates and not qa.rule_currency_list
    ll = V.RuleConfig.pack("lloyds")
    assert ll.rule_policy_term and ll.rule_parse_dates and not ll.rule_negative_values


def test_run_metrics(spark):
    df = frame(spark, [dict(claim_id=""), dict(), dict(claim_id=None)])
    m = {r.metric: r.value for r in V.run_metrics(V.annotate(df, V.RuleConfig()), long=True).collect()}
    assert m["n_rows"] == "3" and m["n_claims"] == "3" and m["missing_required"] == "2"


def test_r_num():
    assert V.r_num(Decimal("14.25")) == "14.25"
    assert V.r_num(Decimal("0")) == "0"
    assert V.r_num(Decimal("1500.50")) == "1500.5"
    assert V.r_num(Decimal("100000")) == "1e+05"
    assert V.r_num(Decimal("150000")) == "150000"
    assert V.r_num(1.5) == "1.5" and V.r_num(2.0) == "2"


def _flags_by_group(df, cfg):
    """'Why flagged' the other way round: the issues grouped by row."""
    out = {r.row_id: ([], []) for r in df.collect()}
    for r in sorted(V.validate(df, cfg).collect(), key=lambda r: (r.row, r.rule_order)):
        texts, details = out[r.row]
        if r.issue not in texts:
            texts.append(r.issue)
        if r.detail and r.detail not in details:
            details.append(r.detail)
    return {k: ("; ".join(t), " | ".join(d)) if t else (None, None) for k, (t, d) in out.items()}


def test_one_pass_flags_equal_grouped_flags(spark):
    df = frame(spark, [dict(claim_id="", currency="XXX"), dict(), dict(paid=D(-1), incurred=D(-1)),
                       dict(claim_id="C9"), dict(claim_id="C9", currency="")])
    cfg = V.RuleConfig()
    got = {r.row_id: (r.flags, r.flags_detail) for r in V.row_flags_one_pass(df, cfg).collect()}
    assert got == _flags_by_group(df, cfg) and any(v[0] for v in got.values())


def test_approx_quantile_option_is_close(spark):
    values = [D(i) for i in range(1, 1001)]
    df = spark.createDataFrame([(v,) for v in values], "paid decimal(28,6)")
    n, (q1, q3) = quantiles(df, "paid", [0.25, 0.75], method="approx")
    assert n == 1000 and abs(q1 - D("250.75")) <= 2 and abs(q3 - D("750.25")) <= 2
    with pytest.raises(ValueError):
        quantiles(df, "paid", [0.5], method="median-of-medians")


def test_shared_quartiles_match_separate_runs(spark):
    from lossframe.operators.quantiles import quantiles_with_suffix
    vals = [D(-5), D(-1), D(0), D(0), D(3), D("7.5"), D(10), D(12), D(100), D(-2)]
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "paid decimal(28,6)")
    got = quantiles_with_suffix(df, "paid", [0.25, 0.75], suffix_from=0)
    nonneg = [v for v in vals if v >= 0]
    assert got["all"] == (len(vals), [_type7(vals, 0.25), _type7(vals, 0.75)])
    assert got["suffix"] == (len(nonneg), [_type7(nonneg, 0.25), _type7(nonneg, 0.75)])


def test_hot_keys_are_split_by_size_without_a_cap(spark):
    # two thirds of the rows share (NULL claim id, one loss date): far beyond 64 shares of the target
    rows = [dict(claim_id=None) for _ in range(300)] + [dict(claim_id=f"C{i % 20}") for i in range(60)]
    df = frame(spark, rows)
    want = sorted(tuple(r) for r in V.with_claim_keys(df, target_rows=10**9).select("row_id", "_first_row", "_claim_n").collect())
    salted = V.with_claim_keys(df, target_rows=3)
    assert sorted(tuple(r) for r in salted.select("row_id", "_first_row", "_claim_n").collect()) == want
    assert len(want) == 360 and {r[2] for r in want if r[0] <= 300} == {300}
    keys = V.claim_keys(df)
    assert keys.count() == 21 and max(r._kn for r in keys.collect()) == 300  # exact sizes, one row per key


def test_order_statistics_in_narrow_brackets(spark):
    import random
    from lossframe.operators.quantiles import order_statistics
    rnd = random.Random(7)
    values = [D(rnd.choice([rnd.randint(-500, 500), 7])) / 4 for _ in range(4000)]  # half of them one value
    df = spark.createDataFrame([(v,) for v in values], "v decimal(28,6)").repartition(5)
    ranks = [0, 1, 999, 1000, 2000, 2999, 3999]
    for accuracy, most in ((10_000, 50_000), (20, 30), (50, 5)):
        got = order_statistics(df, ranks, len(values), accuracy, most)
        assert [got[k] for k in ranks] == [sorted(values)[k] for k in ranks]


def test_every_currency_is_listed(spark):
    from lossframe.operators.quality import currency_text

    std = spark.range(3002).selectExpr("IF(id < 3000, concat('C', lpad(id % 1500, 4, '0')), NULL) AS currency")
    assert currency_text(std) == ", ".join(f"C{i:04d}" for i in range(1500))
    assert currency_text(std.where("currency IS NULL")) == ""
