"""Standardising projection (M3 with F1-F5, F15).

One ``select`` maps any raw frame onto the fixed claims schema. It is a
narrow, row-local projection: Catalyst prunes every raw column that is
not mapped and the whole thing runs inside one whole-stage-codegen span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lossframe.constants import MONEY, STANDARD_FIELDS
from lossframe.functions.amounts import amount_text_parts, clean_amount, fill_incurred, parse_amount_parts
from lossframe.functions.dates import date_from_ymd, date_kind_fields, date_place_parts, date_text_parts, date_ymd, parse_date, serial_number
from lossframe.functions.names import trim_ws

SOURCE_PAGE_COLUMNS = ("..source_page..", "source_page")


def _source(df: DataFrame, name: str) -> tuple[Column, T.DataType]:
    if name and name in df.columns:
        return F.col(f"`{name}`"), df.schema[name].dataType
    return F.lit(None), T.NullType()


def standardize(df: DataFrame, mapping: dict[str, str], locale: str = "AU",
                source_file: str | Column | None = None, tenant_id: str = "",
                run_id: str | None = None, keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Map a raw frame to the standard claims schema.

    ``mapping``: standard field -> raw column ("" or a missing column gives
    NULL, so one bad file does not sink a multi-file run). ``keep`` carries
    lineage columns such as ``row_id`` through unchanged.

    A chain of narrow projections: (1) text helpers computed once per value
    (trimmed text, collapsed date separators, stripped money text); (2) the
    date pattern and its fields; (3) year / month / day; (4) parsing; (5) filling incurred from paid +
    outstanding. Catalyst does not re-inline a non-trivial expression that
    is referenced more than once, so every helper runs once per value. Stage
    (2) holds a lambda, so it is compiled by itself and the stages before
    and after it are two methods, each under the 8,000 bytes beyond which
    the JIT leaves a method interpreted.
    """
    unknown = set(mapping) - set(STANDARD_FIELDS)
    if unknown:
        raise ValueError(f"unknown standard fields in mapping: {sorted(unknown)}")
    src = {f: _source(df, mapping.get(f, "")) for f in STANDARD_FIELDS}

    if isinstance(source_file, Column):
        sf = source_file.cast("string")
    else:
        sf = F.lit(source_file).cast("string")
    page_col = next((c for c in SOURCE_PAGE_COLUMNS if c in df.columns), None)
    page = F.col(f"`{page_col}`").try_cast("int") if page_col else F.lit(None).cast("int")

    def is_text(field: str) -> bool:
        return isinstance(src[field][1], (T.StringType, T.VarcharType, T.CharType))

    c = F.col
    lineage = ["source_file", "source_page", *[F.col(f"`{k}`") for k in keep]]
    text_dates = [f for f in ("loss_date", "report_date") if is_text(f)]
    text_money = [f for f in ("paid", "incurred", "outstanding") if is_text(f)]

    # stage 1: raw values and text helpers
    s1 = [src[f][0].alias(f"_src_{f}") for f in STANDARD_FIELDS]
    for f in text_dates:
        s_, coll = date_text_parts(src[f][0])
        s1 += [s_.alias(f"_s_{f}"), coll.alias(f"_c_{f}")]
    for f in text_money:
        raw, stripped = amount_text_parts(src[f][0])
        s1 += [raw.alias(f"_r_{f}"), stripped.alias(f"_x_{f}")]
    s1 += [sf.alias("source_file"), page.alias("source_page")] + [F.col(f"`{k}`") for k in keep]
    cur = df.select(*s1)

    # stages 2-3 (text dates): places and parts, pattern kind and fields, then year / month / day
    if text_dates:
        keep_cols = [x for x in cur.columns if not any(x == f"_c_{f}" for f in text_dates)]
        extra = []
        for f in text_dates:
            place, parts = date_place_parts(c(f"_c_{f}"), locale)
            extra += [place.alias(f"_g_{f}"), parts.alias(f"_w_{f}")]
        cur, extra = cur.select(*[c(f"`{x}`") for x in keep_cols], *extra), []
        for f in text_dates:
            kind, p1, p2, p3 = date_kind_fields(c(f"_c_{f}"), locale, (c(f"_g_{f}"), c(f"_w_{f}")))
            extra += [kind.alias(f"_k_{f}"), p1.alias(f"_p1_{f}"), p2.alias(f"_p2_{f}"), p3.alias(f"_p3_{f}")]
        cur = cur.select(*[c(f"`{x}`") for x in keep_cols], *extra)
        extra, drop = [], set()
        for f in text_dates:
            y, m, d = date_ymd(c(f"_k_{f}"), [c(f"_p{i}_{f}") for i in (1, 2, 3)], locale)
            number = F.when(c(f"_k_{f}").isNull(), serial_number(c(f"_s_{f}")))  # a number has no pattern
            extra += [y.alias(f"_y_{f}"), m.alias(f"_m_{f}"), d.alias(f"_d_{f}"), number.alias(f"_n_{f}")]
            drop |= {f"_k_{f}", f"_p1_{f}", f"_p2_{f}", f"_p3_{f}"}
        cur = cur.select(*[c(f"`{x}`") for x in cur.columns if x not in drop], *extra)

    # stage 4: parse
    def date_expr(f: str) -> Column:
        if is_text(f):
            return date_from_ymd(c(f"_s_{f}"), c(f"_y_{f}"), c(f"_m_{f}"), c(f"_d_{f}"), c(f"_n_{f}"))
        return parse_date(c(f"_src_{f}"), src[f][1], locale)

    def money_expr(f: str) -> Column:
        if is_text(f):
            return parse_amount_parts(c(f"_r_{f}"), c(f"_x_{f}"))
        return clean_amount(c(f"_src_{f}"), src[f][1])

    stage2 = cur.select(
        c("_src_claim_id").cast("string").alias("claim_id"),
        date_expr("loss_date").alias("loss_date"),
        date_expr("report_date").alias("report_date"),
        money_expr("paid").alias("paid"),
        money_expr("incurred").alias("_incurred_raw"),
        money_expr("outstanding").alias("outstanding"),
        F.upper(trim_ws(c("_src_currency").cast("string"))).alias("currency"),
        c("_src_policy_number").cast("string").alias("policy_number"),
        c("_src_status").cast("string").alias("status"),
        c("_src_claimant").cast("string").alias("claimant"),
        *lineage)

    # stage 3: fill incurred, stamp tenant / run
    cols = [
        "claim_id", "loss_date", "report_date", "paid",
        fill_incurred(c("_incurred_raw"), c("paid"), c("outstanding")).cast(MONEY).alias("incurred"),
        "outstanding", "currency", "policy_number", "status", "claimant", "source_file", "source_page",
        F.lit(tenant_id).cast("string").alias("tenant_id"),
    ]
    if run_id is not None:
        cols.append(F.lit(run_id).cast("string").alias("run_id"))
    cols += [F.col(f"`{k}`") for k in keep]
    return stage2.select(*cols)


def file_status(raw: DataFrame, mapping: dict[str, str], file_col: str = "source_file") -> DataFrame:
    """Per file: how many rows and which mapped columns are absent (all-null)."""
    mapped = {f: c for f, c in mapping.items() if c}
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for f, c in mapped.items():
        if c in raw.columns:
            aggs.append(F.count(F.col(f"`{c}`")).alias(f"n_{f}"))
        else:
            aggs.append(F.lit(0).cast("long").alias(f"n_{f}"))
    return raw.groupBy(file_col).agg(*aggs)
