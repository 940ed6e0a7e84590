"""Data-quality summary (Q1-Q17).

The summary is a handful of aggregates over the claims, each a hash
aggregate with map-side partial aggregation:

* one row-level aggregate (counts, sums, null/blank counts, decimals test),
  a single scan without distinct aggregates;
* one aggregate per (claim_id, loss_date), which answers all claim measures
  and the duplicate pairs;
* one count by a hash of the ten-column key for exact duplicates;
* the count above the exact IQR fence over non-negative paid;
* the distinct currencies (one partial aggregate).

Each returns one small row; ``quality_summary`` assembles them into one row.
"""

from __future__ import annotations

from datetime import date
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lossframe import constants as K
from lossframe.functions.amounts import two_decimals_ok
from lossframe.functions.names import is_blank, norm_id
from lossframe.operators.quantiles import fences_from, iqr_fences

SUM = "decimal(38,6)"


def _tau() -> Column:
    return F.lit(Decimal(K.OPEN_TOLERANCE))


def _z(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def _sum(c: Column) -> Column:
    return _z(F.sum(c)).cast(SUM)


def _n_distinct(c: Column) -> Column:
    """dplyr n_distinct: NULL counts as one value."""
    return (F.count_distinct(c) + _z(F.max(c.isNull().cast("int")))).cast("long")


def claim_rollup(std: DataFrame) -> DataFrame:
    """Q2: per non-blank claim_id: paid_c, incurred_c, os_c = sum(incurred - paid)."""
    p, i = _z(F.col("paid")), _z(F.col("incurred"))
    return (std.where(~is_blank(F.col("claim_id")))
            .groupBy("claim_id")
            .agg(_sum(p).alias("paid_c"), _sum(i).alias("incurred_c"), _sum(i - p).alias("os_c")))


def open_closed(std: DataFrame) -> DataFrame:
    """Q4 + Q6: open/closed counts and amounts, zero-amount claims (one row)."""
    r = claim_rollup(std)
    is_open = F.col("os_c") > _tau()
    return r.agg(
        F.count_if(is_open).cast("long").alias("open_n"),
        F.count_if(~is_open).cast("long").alias("closed_n"),
        _sum(F.when(is_open, F.col("os_c"))).alias("open_os"),
        _sum(F.when(~is_open, F.col("paid_c"))).alias("closed_paid"),
        F.count_if((F.col("paid_c") == 0) & (F.col("incurred_c") == 0)).cast("long").alias("zero_claims"),
    )


def _inc_lt(c=F.col) -> Column:
    return c("incurred") < c("paid")


def _recon_delta() -> Column:
    """Q8 uses coalesce(outstanding, 0), unlike rule V6."""
    return F.abs(F.col("incurred") - (F.col("paid") + _z(F.col("outstanding"))))


def row_aggregates(std: DataFrame, policy_start: date | None = None, policy_end: date | None = None) -> DataFrame:
    """All row-level measures in one aggregate (one row)."""
    c = F.col
    inc_lt = _inc_lt()
    recon = c("paid").isNotNull() & c("incurred").isNotNull() & (_recon_delta() > _tau())
    term_set = policy_start is not None and policy_end is not None
    aggs = [
        F.count(F.lit(1)).alias("n_rows"),
        _sum(c("paid")).alias("total_paid"),
        _sum(c("incurred")).alias("total_incurred"),
        _sum(c("outstanding")).alias("total_os"),
        F.count_if(c("paid") < 0).cast("long").alias("neg_paid_n"),
        _sum(F.when(c("paid") < 0, c("paid"))).alias("neg_paid_sum"),
        F.count_if(c("outstanding") < 0).cast("long").alias("neg_os_n"),
        _sum(F.when(c("outstanding") < 0, c("outstanding"))).alias("neg_os_sum"),
        F.count_if(inc_lt).cast("long").alias("inc_lt_rows_n"),
        _sum(F.when(inc_lt, c("paid") - c("incurred"))).alias("inc_lt_variance"),
        F.count_if(recon).cast("long").alias("recon_rows_n"),
        _sum(F.when(recon, _recon_delta())).alias("recon_abs_delta"),
        F.count_if(c("loss_date").isNull()).cast("long").alias("unparse_loss"),
        F.count_if(c("report_date").isNull()).cast("long").alias("unparse_report"),
        F.count_if(c("report_date") < c("loss_date")).cast("long").alias("report_before_loss"),
        F.coalesce(F.bool_and(F.when(c("currency").isNotNull(), c("currency").isin(*K.ALLOWED_CURRENCIES))),
                   F.lit(True)).alias("currency_ok"),
        (two_decimals_ok(c("paid")) & two_decimals_ok(c("incurred"))).alias("decimals_ok"),
        F.count_if(is_blank(c("claim_id"))).cast("long").alias("req_claim_id"),
        F.count_if(c("loss_date").isNull()).cast("long").alias("req_loss_date"),
        F.count_if(c("report_date").isNull()).cast("long").alias("req_report_date"),
        F.count_if(is_blank(c("policy_number"))).cast("long").alias("req_policy_number"),
        F.count_if(is_blank(c("currency"))).cast("long").alias("req_currency"),
        F.count_if(is_blank(c("status"))).cast("long").alias("req_status"),
    ]
    if term_set:
        aggs.append(F.count_if((c("loss_date") < F.lit(policy_start)) | (c("loss_date") > F.lit(policy_end)))
                    .cast("long").alias("outside_term_n"))
    else:
        aggs.append(F.lit(None).cast("long").alias("outside_term_n"))
    return std.agg(*aggs)


def claim_totals(std: DataFrame) -> DataFrame:
    """One row per (claim_id, loss_date): rows, sums and whether incurred < paid anywhere; a hot key is one row.

    It answers the distinct-claim counts, the claim roll-up and the duplicate pairs (Q1, Q2, Q4, Q6, Q7, Q15)."""
    p, i = _z(F.col("paid")), _z(F.col("incurred"))
    return std.groupBy("claim_id", "loss_date").agg(
        F.count(F.lit(1)).alias("n"), _sum(p).alias("paid_c"), _sum(i).alias("incurred_c"), _sum(i - p).alias("os_c"),
        F.coalesce(F.bool_or(_inc_lt()), F.lit(False)).alias("lt"))


def claim_aggregates(totals: DataFrame) -> DataFrame:
    """One lazy row from ``claim_totals``: n_claims and inc_lt_claims_n (NULL counted as one claim id, as
    n_distinct does), the open/closed split, zero claims, and the duplicate pairs."""
    c = F.col
    per = totals.groupBy("claim_id").agg(
        F.sum("paid_c").cast(SUM).alias("paid_c"), F.sum("incurred_c").cast(SUM).alias("incurred_c"),
        F.sum("os_c").cast(SUM).alias("os_c"), F.bool_or("lt").alias("lt"), F.sum(c("n") - 1).alias("dups"))
    real = ~is_blank(c("claim_id"))
    is_open = c("os_c") > _tau()
    return per.agg(
        F.count(F.lit(1)).cast("long").alias("n_claims"), F.count_if("lt").cast("long").alias("inc_lt_claims_n"),
        F.count_if(real & is_open).cast("long").alias("open_n"), F.count_if(real & ~is_open).cast("long").alias("closed_n"),
        _sum(F.when(real & is_open, c("os_c"))).alias("open_os"),
        _sum(F.when(real & ~is_open, c("paid_c"))).alias("closed_paid"),
        F.count_if(real & (c("paid_c") == 0) & (c("incurred_c") == 0)).cast("long").alias("zero_claims"),
        _z(F.sum("dups")).cast("long").alias("dup_claimid_lossdate_n"))


def incurred_lt_paid(std: DataFrame) -> DataFrame:
    """Q7 as one row: rows, distinct claims and variance where incurred < paid."""
    short = std.where(_inc_lt())
    return short.agg(F.count(F.lit(1)).cast("long").alias("inc_lt_rows_n"), _n_distinct(F.col("claim_id")).alias("inc_lt_claims_n"),
                     _sum(F.col("paid") - F.col("incurred")).alias("inc_lt_variance"))


def exact_key() -> list[Column]:
    """Q14 key: normalised ids, both dates, amounts rounded with NULL as 0, upper currency."""
    c = F.col
    r2 = lambda x: F.round(_z(c(x)), 2).cast("decimal(28,2)")
    return [norm_id(c("claim_id")).alias("k1"), c("loss_date").alias("k2"), c("report_date").alias("k3"),
            r2("paid").alias("k4"), r2("incurred").alias("k5"), r2("outstanding").alias("k6"),
            F.upper(F.coalesce(c("currency"), F.lit(""))).alias("k7"), norm_id(c("policy_number")).alias("k8"),
            norm_id(c("status")).alias("k9"), norm_id(c("claimant")).alias("k10")]


def duplicate_count(std: DataFrame, keys: list[Column]) -> DataFrame:
    """Rows beyond the first per key = sum over groups of (size - 1); NULL keys group together."""
    return (std.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
            .agg(_z(F.sum(F.col("_n") - 1)).cast("long").alias("dups")))


def exact_row_dups(std: DataFrame) -> DataFrame:
    """Q14 as one row ``exact_dup_n``.

    Rows are first counted by a 128-bit hash of the ten-column key (each value with its NULL mark), so what is
    shuffled is 16 bytes and a count for each key of a task, not ten columns of every row."""
    parts = [x for k in exact_key() for x in (k.isNull(), k)]
    halves = [F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(42), *reversed(parts)).alias("h2")]
    return duplicate_count(std, halves).withColumnRenamed("dups", "exact_dup_n")


def dup_claimid_lossdate(std: DataFrame) -> DataFrame:
    """Q15: 2nd+ rows on the raw (claim_id, loss_date) pair."""
    return duplicate_count(std, [F.col("claim_id"), F.col("loss_date")]).withColumnRenamed(
        "dups", "dup_claimid_lossdate_n")


def summary_outliers(std: DataFrame, method: str = "exact", nonneg_quartiles: tuple | None = None) -> dict:
    """Q9: upper fence (k = 1.5) from quantiles over paid >= 0; needs 5 values.

    ``nonneg_quartiles`` = ``(n, [q1, q3])`` reuses quartiles already computed
    (e.g. by ``quantiles_with_suffix`` together with the rule fences)."""
    k = Decimal(K.SUMMARY_OUTLIER_K)
    if nonneg_quartiles is not None:
        n, (q1, q3) = nonneg_quartiles
        f = fences_from(n, q1, q3, float(k), min_n=5, lower_floor=False)
    else:
        f = iqr_fences(std.where(F.col("paid") >= 0), "paid", float(k), min_n=5, lower_floor=False, method=method)
    if f is None:
        return {"outlier_k": k, "outliers_n": 0, "top_loss": None, "iqr": None, "q3": None, "fence": None}
    fence = f["upper"]
    row = std.where(F.col("paid") > F.lit(fence)).agg(
        F.count(F.lit(1)).alias("n"), F.max("paid").alias("top")).collect()[0]
    return {"outlier_k": k, "outliers_n": int(row["n"]), "top_loss": row["top"], "iqr": f["iqr"], "q3": f["q3"],
            "fence": fence}


SUMMARY_SCHEMA = T.StructType([
    T.StructField("n_rows", T.LongType()), T.StructField("n_claims", T.LongType()),
    T.StructField("total_paid", T.DecimalType(38, 6)), T.StructField("total_incurred", T.DecimalType(38, 6)),
    T.StructField("severity_claim", T.DecimalType(38, 6)),
    T.StructField("open_n", T.LongType()), T.StructField("closed_n", T.LongType()),
    T.StructField("open_os", T.DecimalType(38, 6)), T.StructField("closed_paid", T.DecimalType(38, 6)),
    T.StructField("neg_paid_n", T.LongType()), T.StructField("neg_paid_sum", T.DecimalType(38, 6)),
    T.StructField("neg_os_n", T.LongType()), T.StructField("neg_os_sum", T.DecimalType(38, 6)),
    T.StructField("zero_claims", T.LongType()),
    T.StructField("inc_lt_rows_n", T.LongType()), T.StructField("inc_lt_claims_n", T.LongType()),
    T.StructField("inc_lt_variance", T.DecimalType(38, 6)),
    T.StructField("recon_rows_n", T.LongType()), T.StructField("recon_abs_delta", T.DecimalType(38, 6)),
    T.StructField("outlier_k", T.DecimalType(38, 6)), T.StructField("outliers_n", T.LongType()),
    T.StructField("top_loss", T.DecimalType(38, 6)), T.StructField("iqr", T.DecimalType(38, 6)),
    T.StructField("q3", T.DecimalType(38, 6)),
    T.StructField("unparse_loss", T.LongType()), T.StructField("unparse_report", T.LongType()),
    T.StructField("report_before_loss", T.LongType()),
    T.StructField("pol_term_set", T.BooleanType()),
    T.StructField("policy_start", T.DateType()), T.StructField("policy_end", T.DateType()),
    T.StructField("outside_term_n", T.LongType()), T.StructField("outside_term_pct", T.DecimalType(38, 1)),
    T.StructField("currencies", T.StringType()), T.StructField("currency_ok", T.BooleanType()),
    T.StructField("decimals_ok", T.BooleanType()),
    T.StructField("exact_dup_n", T.LongType()), T.StructField("dup_claimid_lossdate_n", T.LongType()),
    T.StructField("req_claim_id", T.LongType()), T.StructField("req_loss_date", T.LongType()),
    T.StructField("req_report_date", T.LongType()), T.StructField("req_policy_number", T.LongType()),
    T.StructField("req_currency", T.LongType()), T.StructField("req_status", T.LongType()),
    T.StructField("dataset_recon_ok", T.BooleanType()), T.StructField("dataset_recon_gap", T.DecimalType(38, 6)),
    T.StructField("dataset_recon_tol", T.DecimalType(38, 6)),
])


def _q6(x) -> Decimal | None:
    return None if x is None else Decimal(x).quantize(Decimal("0.000001"))


def summary_dict(std: DataFrame, policy_start: date | None = None, policy_end: date | None = None,
                 method: str = "exact", nonneg_quartiles: tuple | None = None) -> dict:
    """Q1-Q17 as a Python dict (each part computed by Spark).

    The parts (rows, claim keys, exact keys, outliers, currencies) are independent aggregates of the
    same persisted table; they are submitted as concurrent Spark jobs so their small final stages
    overlap instead of leaving cores idle."""
    from concurrent.futures import ThreadPoolExecutor

    jobs = {
        "ra": lambda: row_aggregates(std, policy_start, policy_end).first().asDict(),
        "oc": lambda: claim_aggregates(claim_totals(std)).first().asDict(),
        "ex": lambda: exact_row_dups(std).first()["exact_dup_n"],
        "ol": lambda: summary_outliers(std, method, nonneg_quartiles),
        "cu": lambda: currency_text(std),
    }
    with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
        futs = {k: pool.submit(f) for k, f in jobs.items()}
        res = {k: f.result() for k, f in futs.items()}
    ra, oc, ex, ol = res["ra"], res["oc"], res["ex"], res["ol"]
    dp = oc.pop("dup_claimid_lossdate_n")
    ra.update({k: oc.pop(k) for k in ("n_claims", "inc_lt_claims_n")})
    n_rows, n_claims = ra["n_rows"], ra["n_claims"]
    tp, ti, tos = ra["total_paid"], ra["total_incurred"], ra["total_os"]
    term_set = policy_start is not None and policy_end is not None
    pct = None
    if term_set and n_rows:
        pct = (Decimal(100) * Decimal(ra["outside_term_n"]) / Decimal(n_rows)).quantize(
            Decimal("0.1"), rounding=ROUND_HALF_UP)
    gap = abs(ti - (tp + tos))
    tol = max(Decimal(K.DATASET_RECON_MIN_TOL), Decimal(K.DATASET_RECON_REL_TOL) * max(Decimal(1), ti))
    return {
        "n_rows": n_rows, "n_claims": n_claims, "total_paid": tp, "total_incurred": ti,
        "severity_claim": _q6(tp / n_claims) if n_claims else None,
        **oc,
        "neg_paid_n": ra["neg_paid_n"], "neg_paid_sum": ra["neg_paid_sum"],
        "neg_os_n": ra["neg_os_n"], "neg_os_sum": ra["neg_os_sum"],
        "inc_lt_rows_n": ra["inc_lt_rows_n"], "inc_lt_claims_n": ra["inc_lt_claims_n"],
        "inc_lt_variance": ra["inc_lt_variance"],
        "recon_rows_n": ra["recon_rows_n"], "recon_abs_delta": ra["recon_abs_delta"],
        "outlier_k": ol["outlier_k"], "outliers_n": ol["outliers_n"], "top_loss": ol["top_loss"],
        "iqr": _q6(ol["iqr"]), "q3": _q6(ol["q3"]),
        "unparse_loss": ra["unparse_loss"], "unparse_report": ra["unparse_report"],
        "report_before_loss": ra["report_before_loss"],
        "pol_term_set": term_set, "policy_start": policy_start, "policy_end": policy_end,
        "outside_term_n": ra["outside_term_n"], "outside_term_pct": pct,
        "currencies": res["cu"], "currency_ok": ra["currency_ok"],
        "decimals_ok": ra["decimals_ok"],
        "exact_dup_n": ex, "dup_claimid_lossdate_n": dp,
        "req_claim_id": ra["req_claim_id"], "req_loss_date": ra["req_loss_date"],
        "req_report_date": ra["req_report_date"], "req_policy_number": ra["req_policy_number"],
        "req_currency": ra["req_currency"], "req_status": ra["req_status"],
        "dataset_recon_ok": gap <= tol, "dataset_recon_gap": _q6(gap), "dataset_recon_tol": _q6(tol),
    }


def quality_summary(std: DataFrame, policy_start: date | None = None, policy_end: date | None = None,
                    method: str = "exact") -> DataFrame:
    """Q1-Q17 as one row (``currencies`` joined with ', ')."""
    d = summary_dict(std, policy_start, policy_end, method)
    return std.sparkSession.createDataFrame([tuple(d[f.name] for f in SUMMARY_SCHEMA.fields)], SUMMARY_SCHEMA)


def required_missing(std: DataFrame) -> DataFrame:
    """Q16 as one row of null/blank counts."""
    c = F.col
    return std.agg(*[F.count_if(is_blank(c(f)) if f not in ("loss_date", "report_date") else c(f).isNull())
                     .cast("long").alias(f) for f in
                     ["claim_id", "loss_date", "report_date", "policy_number", "currency", "status"]])


def currency_summary(std: DataFrame) -> DataFrame:
    """Q12 long form: one row per distinct non-null currency with its allowed flag."""
    return (std.where(F.col("currency").isNotNull()).groupBy("currency")
            .agg(F.count(F.lit(1)).alias("n_rows"))
            .withColumn("allowed", F.col("currency").isin(*K.ALLOWED_CURRENCIES)))


def dataset_recon(std: DataFrame) -> DataFrame:
    """Q17 as one row: gap, tolerance and ok flag computed in Spark."""
    a = std.agg(_sum(F.col("paid")).alias("tp"), _sum(F.col("incurred")).alias("ti"),
                _sum(F.col("outstanding")).alias("tos"))
    gap = F.abs(F.col("ti") - (F.col("tp") + F.col("tos")))
    tol = F.greatest(F.lit(Decimal(K.DATASET_RECON_MIN_TOL)),
                     F.lit(Decimal(K.DATASET_RECON_REL_TOL)) * F.greatest(F.lit(Decimal(1)), F.col("ti")))
    return a.select(gap.cast(SUM).alias("dataset_recon_gap"), tol.cast(SUM).alias("dataset_recon_tol"),
                    (gap <= tol).alias("dataset_recon_ok"))


def currency_text(std: DataFrame) -> str:
    """All distinct currencies, sorted and joined, however many; ``currency_summary`` has them as a table."""
    codes = F.array_join(F.sort_array(F.collect_list("currency")), ", ")
    return currency_summary(std).agg(codes).first()[0]
