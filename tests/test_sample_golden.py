"""Goldens from the 3-row sample loss run (hand-computed from its values)."""

from datetime import date
from decimal import Decimal


from lossframe.operators import quality as Q
from lossframe.operators import rules as V
from lossframe.operators import triangles as TR


def test_standardised_sample(sample_std):
    rows = sample_std.orderBy("row_id").collect()
    assert [r.row_id for r in rows] == [1, 2, 3]
    assert rows[0].loss_date == date(2023, 1, 5) and rows[2].report_date == date(2023, 6, 6)
    assert [r.paid for r in rows] == [Decimal(1200), Decimal(0), Decimal(7500)]
    assert {r.currency for r in rows} == {"AUD"} and rows[1].claimant == "Acme Pty Ltd"


def test_sample_summary(sample_std):
    d = Q.summary_dict(sample_std)
    assert d["n_rows"] == 3 and d["n_claims"] == 3
    assert d["total_paid"] == Decimal(8700) and d["total_incurred"] == Decimal(11000)
    assert d["severity_claim"] == Decimal(2900)
    assert (d["open_n"], d["closed_n"]) == (3, 0)
    assert d["open_os"] == Decimal(2300) and d["closed_paid"] == Decimal(0)
    assert d["zero_claims"] == 0 and d["recon_rows_n"] == 0 and d["outliers_n"] == 0
    assert d["dataset_recon_gap"] == Decimal(0) and d["dataset_recon_ok"] is True
    assert d["currencies"] == "AUD" and d["currency_ok"] and d["decimals_ok"]
    assert d["pol_term_set"] is False and d["outside_term_n"] is None


def test_sample_has_no_issues_with_default_rules(sample_std):
    assert V.validate(sample_std, V.RuleConfig()).count() == 0


def test_sample_pivot_and_triangle(sample_std):
    p = TR.ay_currency_pivot(sample_std).collect()
    assert [tuple(r) for r in p] == [(2023, "AUD", 3, 3, Decimal(8700), Decimal(11000), Decimal(2300))]
    t = TR.triangle_counts(sample_std).collect()
    assert len(t) == 1 and t[0]["ay"] == 2023 and t[0]["0"] == 3 and t[0]["1"] == 0
    tp = TR.triangle_amounts(sample_std, "paid").collect()[0]
    assert tp["0"] == Decimal(8700)


def test_sample_with_policy_term(sample_std):
    cfg = V.RuleConfig.only("rule_policy_term").with_term(date(2023, 2, 1), date(2023, 12, 31))
    iss = V.validate(sample_std, cfg).collect()
    assert [(i.row, i.issue, i.detail) for i in iss] == [
        (1, "Loss date outside policy term", "Policy: 2023-02-01 to 2023-12-31")]
