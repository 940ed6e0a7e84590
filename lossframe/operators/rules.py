"""Row-level validation rules.

Plan shape (``validate``):

* the IQR fence (V13) is computed first by the exact distributed quantile
  helper and enters the plan as two literals;
* the set-based rules (V8 duplicates, V18 multiple rows per claim) never
  window over the claims themselves: one scan + partial aggregation of the
  claims to ``(claim_id, norm_id, loss_date)`` groups, two windows over
  that small table after one exchange, and ONE join of the claims back on
  ``(claim_id, loss_date)``. A hot key is one row there, and for the join
  it is split by its exact size (see ``with_claim_keys``);
* every rule then becomes one ``when(predicate, struct(...))`` element of
  a single array, and one ``explode`` emits the issues: a single pass over
  the claims for all nineteen issue kinds.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossframe import constants as K
from lossframe.functions.names import is_blank, norm_id
from lossframe.operators.quantiles import fences_from, iqr_fences, quantiles_with_suffix
from lossframe.session import persist_table


@dataclass
class RuleConfig:
    """The 16 rule toggles (all on by default) and their parameters."""

    rule_required_fields: bool = True
    rule_negative_values: bool = True
    rule_incurred_lt_paid: bool = True
    rule_reconcile: bool = True
    rule_currency_list: bool = True
    rule_duplicates: bool = True
    rule_date_order: bool = True
    rule_policy_term: bool = True
    rule_missing_policy: bool = True
    rule_missing_currency: bool = True
    rule_paid_outliers: bool = True
    rule_high_ratio: bool = True
    rule_missing_claimant: bool = True
    rule_zero_rows: bool = True
    rule_parse_dates: bool = True
    rule_multi_rows_per_claim: bool = True
    iqr_multiplier: float = K.DEFAULT_IQR_MULTIPLIER
    ratio_threshold: float = K.DEFAULT_RATIO_THRESHOLD
    policy_start: date | None = None
    policy_end: date | None = None
    quantile_method: str = "exact"

    @classmethod
    def only(cls, *rules: str, **params) -> "RuleConfig":
        """A config with exactly ``rules`` switched on."""
        flags = {f: (f in rules) for f in K.RULE_FLAGS}
        unknown = set(rules) - set(K.RULE_FLAGS)
        if unknown:
            raise ValueError(f"unknown rules: {sorted(unknown)}")
        return cls(**flags, **params)

    @classmethod
    def pack(cls, name: str, **params) -> "RuleConfig":
        """Named rule pack: exactly its listed rules, with its parameters."""
        spec = K.RULE_PACKS[name]
        p = {k: v for k, v in spec.items() if k in ("iqr_multiplier", "ratio_threshold")}
        p.update(params)
        return cls.only(*spec["rules"], **p)

    def with_term(self, start: date | None, end: date | None) -> "RuleConfig":
        return replace(self, policy_start=start, policy_end=end)

    @property
    def term_set(self) -> bool:
        return self.policy_start is not None and self.policy_end is not None

    def flags(self) -> dict[str, bool]:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name.startswith("rule_")}


# ---------------------------------------------------------------------------
# R-style number text for details
# ---------------------------------------------------------------------------

def r_num(x) -> str:
    """Print a number the way R's as.character does (15 significant digits,
    no trailing zeros, scientific only when shorter)."""
    d = Decimal(str(x))
    if d == 0:
        return "0"
    d = Decimal(f"{d:.15g}") if len(d.as_tuple().digits) > 15 else d
    fixed = format(d.normalize(), "f")
    if "." in fixed:
        fixed = fixed.rstrip("0").rstrip(".")
    sign, digits, exp = d.normalize().as_tuple()
    mant = "".join(map(str, digits)).rstrip("0") or "0"
    e10 = len(digits) + exp - 1
    m = mant[0] + ("." + mant[1:] if len(mant) > 1 else "")
    sci = ("-" if sign else "") + m + "e" + ("-" if e10 < 0 else "+") + f"{abs(e10):02d}"
    return sci if len(fixed) > len(sci) else fixed


def round2(d: Decimal) -> Decimal:
    from decimal import ROUND_HALF_UP
    return d.quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)


# ---------------------------------------------------------------------------
# Set-based keys
# ---------------------------------------------------------------------------

def claim_keys(std: DataFrame, need_dup: bool = True, need_multi: bool = True) -> DataFrame:
    """One row per (claim_id, loss_date): its exact size ``_kn``, the first row of its (norm_id, loss_date) key
    and the rows of its claim_id (NULL being one group). Stored once.

    Claims are first summed up to the keys on the map side, so a key held by a third of all rows
    is one row here. ``_nid`` is a function of ``claim_id``, so one exchange on it serves both windows.
    """
    from pyspark.sql import Window

    c = F.col
    groups = (std.select("claim_id", "loss_date", "row_id", norm_id(c("claim_id")).alias("_nid"))
              .groupBy("claim_id", "_nid", "loss_date")
              .agg(F.min("row_id").alias("_gmin"), F.count(F.lit(1)).alias("_kn")).repartition("_nid"))
    if need_dup:
        groups = groups.withColumn("_first_row", F.min("_gmin").over(Window.partitionBy("_nid", "loss_date")))
    if need_multi:
        groups = groups.withColumn("_claim_n", F.sum("_kn").over(Window.partitionBy("_nid", "claim_id")))
    return persist_table(groups.drop("_nid", "_gmin"), "claim_keys")


def with_claim_keys(std: DataFrame, need_dup: bool = True, need_multi: bool = True,
                    target_rows: int | None = None) -> DataFrame:
    """Attach ``_first_row`` (first row of its (norm_id, loss_date) key) and
    ``_claim_n`` (rows sharing its claim_id): one null-safe join with the stored key table.

    Every key with more rows than a partition's fair share (``target_rows``:
    all rows / shuffle partitions) is split into ``ceil(rows / target)``
    salts. The sizes are exact, and at most ``partitions`` keys can exceed
    the share, so the list needs no limit and no salt a cap: no task
    gets more than about one share of one key, however large the key is.
    """
    c = F.col
    info = claim_keys(std, need_dup, need_multi)
    if target_rows is None:
        total = info.agg(F.sum("_kn")).first()[0] or 0
        target_rows = max(1, -(-total // int(std.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    salts = F.ceil(c("_kn") / F.lit(target_rows)).cast("int").alias("_salts")
    hot = info.where(c("_kn") > target_rows).select(c("claim_id").alias("_h_cid"), c("loss_date").alias("_h_ld"), salts)
    spread = (info.select("*", F.explode(F.sequence(F.lit(0), salts - 1)).alias("_k_salt")).drop("_kn")
              .withColumnRenamed("claim_id", "_k_cid").withColumnRenamed("loss_date", "_k_ld"))
    salted = (std.join(F.broadcast(hot), c("claim_id").eqNullSafe(c("_h_cid")) & c("loss_date").eqNullSafe(c("_h_ld")), "left")
              .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("row_id"), c("_salts").cast("long")).cast("int"), F.lit(0)))
              .drop("_h_cid", "_h_ld", "_salts"))  # at most one hot key for each shuffle partition
    return (salted.join(spread, c("claim_id").eqNullSafe(c("_k_cid")) & c("loss_date").eqNullSafe(c("_k_ld"))
                        & (c("_salt") == c("_k_salt")))
            .drop("_k_cid", "_k_ld", "_k_salt", "_salt"))


# ---------------------------------------------------------------------------
# Rule predicates
# ---------------------------------------------------------------------------

def _issue(order: int, text: str, detail: str | Column) -> Column:
    d = detail if isinstance(detail, Column) else F.lit(detail)
    return F.struct(F.lit(order).alias("rule_order"), F.lit(text).alias("issue"), d.alias("detail"))


def rule_elements(cfg: RuleConfig, fences: dict | None) -> list[Column]:
    """One ``when(pred, issue)`` per enabled rule, in rule order."""
    return [F.when(p, s) for p, s, _ in _rules(cfg, fences)]


#: Rules whose condition needs the claim keys.
KEYED_RULES = (8, 19)


def _rules(cfg: RuleConfig, fences: dict | None) -> list[tuple[Column, Column, int]]:
    """(condition, issue, rule order) of every enabled rule, in rule order."""
    c = F.col
    paid, inc, os_ = c("paid"), c("incurred"), c("outstanding")
    els: list[tuple[Column, Column, int]] = []

    def add(condition: Column, order: int, text: str, detail: str | Column) -> None:
        els.append((condition, _issue(order, text, detail), order))

    if cfg.rule_required_fields:
        add(is_blank(c("claim_id")) | c("loss_date").isNull() | c("report_date").isNull(), 1, K.ISSUE_REQUIRED, K.DETAIL_REQUIRED)
    if cfg.rule_negative_values:
        add(paid < 0, 2, K.ISSUE_NEG_PAID, K.DETAIL_NEG_PAID)
        add(inc < 0, 3, K.ISSUE_NEG_INCURRED, K.DETAIL_NEG_INCURRED)
        add(os_ < 0, 4, K.ISSUE_NEG_OUTSTANDING, K.DETAIL_NEG_OUTSTANDING)
    if cfg.rule_incurred_lt_paid:
        add(inc < paid, 5, K.ISSUE_INC_LT_PAID, K.DETAIL_INC_LT_PAID)
    if cfg.rule_reconcile:
        add(F.abs(inc - (paid + os_)) > F.lit(Decimal("0.01")), 6, K.ISSUE_RECONCILE, K.DETAIL_RECONCILE)
    if cfg.rule_currency_list:
        add(c("currency").isNotNull() & ~c("currency").isin(*K.ALLOWED_CURRENCIES), 7, K.ISSUE_CURRENCY, K.DETAIL_CURRENCY)
    if cfg.rule_duplicates:
        add(c("row_id") != c("_first_row"), 8, K.ISSUE_DUPLICATE, K.DETAIL_DUPLICATE)
    if cfg.rule_date_order:
        add(c("loss_date") > c("report_date"), 9, K.ISSUE_DATE_ORDER, K.DETAIL_DATE_ORDER)
    if cfg.rule_policy_term and cfg.term_set:
        s, e = cfg.policy_start, cfg.policy_end
        add((c("loss_date") < F.lit(s)) | (c("loss_date") > F.lit(e)), 10, K.ISSUE_POLICY_TERM, f"Policy: {s.isoformat()} to {e.isoformat()}")
    if cfg.rule_missing_policy:
        add(is_blank(c("policy_number")), 11, K.ISSUE_MISSING_POLICY, "")
    if cfg.rule_missing_currency:
        add(is_blank(c("currency")), 12, K.ISSUE_MISSING_CURRENCY, "")
    if cfg.rule_paid_outliers and fences is not None:
        lo, hi = fences["lower"], fences["upper"]
        detail = f"IQR fence: [{r_num(round2(lo))}..{r_num(round2(hi))}] (mult={r_num(cfg.iqr_multiplier)})"
        add((paid > F.lit(hi)) | (paid < F.lit(lo)), 13, K.ISSUE_PAID_OUTLIER, detail)
    if cfg.rule_high_ratio:
        t = Decimal(str(cfg.ratio_threshold))
        add((paid > 0) & inc.isNotNull() & (inc > paid * F.lit(t)), 14, K.ISSUE_HIGH_RATIO, f"ratio > {r_num(cfg.ratio_threshold)}")
    if cfg.rule_missing_claimant:
        add(is_blank(c("claimant")), 15, K.ISSUE_MISSING_CLAIMANT, "")
    if cfg.rule_zero_rows:
        add((paid == 0) & (inc == 0), 16, K.ISSUE_ZERO_ROWS, "")
    if cfg.rule_parse_dates:
        add(c("loss_date").isNull(), 17, K.ISSUE_UNPARSE_LOSS, K.DETAIL_UNPARSE)
        add(c("report_date").isNull(), 18, K.ISSUE_UNPARSE_REPORT, K.DETAIL_UNPARSE)
    if cfg.rule_multi_rows_per_claim:
        add(c("_claim_n") > 1, 19, K.ISSUE_MULTI_ROWS, F.concat(F.lit("n="), c("_claim_n").cast("string")))
    return els


def paid_fences(std: DataFrame, cfg: RuleConfig, quartiles: tuple | None = None) -> dict | None:
    """V13 fences over all non-null paid (needs at least 5 values).
    ``quartiles`` = ``(n, [q1, q3])`` reuses quartiles already computed."""
    if quartiles is not None:
        n, (q1, q3) = quartiles
        return fences_from(n, q1, q3, cfg.iqr_multiplier, min_n=5, lower_floor=True)
    return iqr_fences(std, "paid", cfg.iqr_multiplier, min_n=5, lower_floor=True, method=cfg.quantile_method)


def paid_quartiles(std: DataFrame) -> dict:
    """Quartiles of all paid (rule V13) and of paid >= 0 (summary Q9) from one
    distributed prefix-count structure."""
    return quantiles_with_suffix(std, "paid", [0.25, 0.75], suffix_from=0)


def annotate(std: DataFrame, cfg: RuleConfig | None = None, fences: dict | None = None) -> DataFrame:
    """The claims with one extra column ``_issues``: the array of this row's
    issues (rule_order, issue, detail) in rule order. Both the issue list
    (one explode) and the "why flagged" text (one projection) derive from it,
    so neither needs a group-by or a join of its own."""
    cfg = cfg or RuleConfig()
    if cfg.rule_paid_outliers and fences is None:
        fences = paid_fences(std, cfg)
    base, rules = std, _rules(cfg, fences)
    if cfg.rule_duplicates or cfg.rule_multi_rows_per_claim:
        # the rules of a row alone are bits before the join, so the shuffle carries one number for them and not the columns they read
        own = [(p, k) for p, _, k in rules if k not in KEYED_RULES]
        bits = F.lit(0)
        for p, k in own:
            bits = bits.bitwiseOR(F.when(p, F.lit(1 << k)).otherwise(F.lit(0)))
        marked = std.withColumn("_hits", bits)
        base = with_claim_keys(marked, cfg.rule_duplicates, cfg.rule_multi_rows_per_claim)
        rules = [(p if k in KEYED_RULES else F.col("_hits").bitwiseAND(F.lit(1 << k)) != 0, s, k) for p, s, k in rules]
    els = [F.when(p, s) for p, s, _ in rules]
    arr = F.array_compact(F.array(*els)) if els else F.array().cast(
        "array<struct<rule_order:int,issue:string,detail:string>>")
    return base.select(*[F.col(f"`{c}`") for c in std.columns], arr.alias("_issues"))


def validate(std: DataFrame, cfg: RuleConfig | None = None, fences: dict | None = None) -> DataFrame:
    """All enabled rules -> issues ``(row, claim_id, issue, detail, rule_order)``.

    ``std`` must carry ``row_id``. Pass precomputed ``fences`` to reuse them.
    """
    ann = annotate(std, cfg, fences)
    exploded = ann.select(F.col("row_id").alias("row"), "claim_id", F.explode("_issues").alias("_i"))
    return exploded.select(
        F.col("row").cast("long").alias("row"), "claim_id",
        F.col("_i.issue").alias("issue"), F.col("_i.detail").alias("detail"),
        F.col("_i.rule_order").alias("rule_order"))


def flags_from_annotated(ann: DataFrame) -> DataFrame:
    """V22 from ``annotate``: unique issues joined by '; ' and unique non-blank
    details by ' | ', in rule order; NULL for rows without issues."""
    arr = F.col("_issues")
    has = F.size(arr) > 0
    flags = F.array_join(F.array_distinct(F.transform(arr, lambda x: x["issue"])), "; ")
    details = F.array_join(F.array_distinct(F.filter(F.transform(arr, lambda x: x["detail"]),
                                                     lambda d: d.isNotNull() & (d != ""))), " | ")
    return ann.select(*[F.col(f"`{c}`") for c in ann.columns if c != "_issues"],
                      F.when(has, flags).alias("flags"), F.when(has, details).alias("flags_detail"))


def row_flags_one_pass(std: DataFrame, cfg: RuleConfig | None = None, fences: dict | None = None) -> DataFrame:
    """V22 in the same pass as the rules (no group-by of issues, no join)."""
    return flags_from_annotated(annotate(std, cfg, fences))


# ---------------------------------------------------------------------------
# Metrics, flags, previews
# ---------------------------------------------------------------------------

def run_metrics(ann: DataFrame, long: bool = False) -> DataFrame:
    """V21 from ``annotate``: the eight run metrics (one row, or ``(metric, value)`` rows) in one lazy aggregate.

    The issues are counted in each row's array, so no issue is exploded and no rule runs again."""
    def issued(text: str) -> Column:
        return F.count_if(F.exists("_issues", lambda i: i["issue"] == text)).cast("long")

    m = ann.agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.count_distinct("claim_id") + F.coalesce(F.max(F.col("claim_id").isNull().cast("int")), F.lit(0)))
        .cast("long").alias("n_claims"),
        F.coalesce(F.sum("paid"), F.lit(0)).cast("decimal(38,6)").alias("total_paid"),
        F.coalesce(F.sum("incurred"), F.lit(0)).cast("decimal(38,6)").alias("total_incurred"),
        F.avg("paid").cast("decimal(38,6)").alias("avg_severity"),
        issued(K.ISSUE_REQUIRED).alias("missing_required"), issued(K.ISSUE_DUPLICATE).alias("duplicates"),
        issued(K.ISSUE_PAID_OUTLIER).alias("outliers"))
    if not long:
        return m
    pairs = ", ".join(f"'{c}', CAST({c} AS STRING)" for c in m.columns)
    return m.selectExpr(f"stack({len(m.columns)}, {pairs}) AS (metric, value)")


def flagged_rows(ann: DataFrame, selected: list[str] | None = None) -> DataFrame:
    """V23 from ``annotate``: claims rows that carry any of the selected issues (all, without a selection); a filter, no join."""
    hit = F.exists("_issues", lambda i: i["issue"].isin(*selected)) if selected else F.size("_issues") > 0
    return ann.where(hit).drop("_issues")


def top_issues(issues: DataFrame, n: int = 30) -> DataFrame:
    """The first ``n`` issues in report order (TakeOrdered, no full sort)."""
    group_key = F.when(F.col("rule_order") == 19, F.col("claim_id"))
    return issues.orderBy(F.col("rule_order"), group_key.asc_nulls_last(), F.col("row")).limit(n)
