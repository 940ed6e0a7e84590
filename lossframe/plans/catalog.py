"""Registered queries: one Spark plan and one DuckDB statement per operator.

Outputs use portable column types on both sides so that any comparison
of the two engines sees identical values: money is computed exactly as
DECIMAL and cast to DOUBLE only at the very end, dates become ISO text,
integers are BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lossframe import __version__
from lossframe import constants as K
from lossframe.functions import dates as D
from lossframe.functions.amounts import clean_amount_text
from lossframe.functions.names import normalize_name_col
from lossframe.functions.privacy import mask_claimant, scrub_name
from lossframe.operators import claim_cube as CC
from lossframe.operators import column_types as CT
from lossframe.operators import exports as X
from lossframe.operators import history as H
from lossframe.operators import quality as Q
from lossframe.operators import rules as V
from lossframe.operators import triangle_store as TS
from lossframe.operators import triangles as TR
from lossframe.operators.mapping import guess_schema, latest_per_key
from lossframe.operators.standardize import standardize
from lossframe.plans import oracle_sql as O
from lossframe.plans import stores
from lossframe.sources import files as S
from lossframe.sources.fixtures import (FIXTURE_RUN, FIXTURE_TENANT, ORDER_KEYS, RAW_HEADERS, claims_raw,
                                        claims_std, table)

POLICY_START = date(1996, 1, 1)
POLICY_END = date(1999, 12, 31)
FIXTURE_SALT = "v1|fixture-salt"
AUDIT_SALT = "audit-salt"

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def portable(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def register(name: str, sql: str | None):
    def deco(fn: Query) -> Query:
        def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
            return portable(fn(spark, sf_dir))
        wrapped.__name__ = fn.__name__
        wrapped.__doc__ = fn.__doc__
        REGISTRY[name] = (wrapped, sql)
        return wrapped
    return deco


def std(spark, sf):
    return claims_std(spark, sf)


def term_cfg(cfg: V.RuleConfig) -> V.RuleConfig:
    return cfg.with_term(POLICY_START, POLICY_END)


# SQL helpers --------------------------------------------------------------

def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def iso(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


STD_COLS_SQL = (f"row_id, claim_id, {iso('loss_date')} AS loss_date, {iso('report_date')} AS report_date, "
                f"{dbl('paid')} AS paid, {dbl('incurred')} AS incurred, {dbl('outstanding')} AS outstanding, "
                "currency, policy_number, status, claimant, source_file, CAST(source_page AS BIGINT) AS source_page, "
                "tenant_id, run_id")


# ---------------------------------------------------------------------------
# Sources (S)
# ---------------------------------------------------------------------------

@register("row_numbering", O.claims_with(
    "SELECT row_id, row_key FROM (SELECT row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, "
    "l_linenumber) AS row_id, row_key FROM raw)"))
def q_row_numbering(spark, sf):
    """Stable 1..n numbering in file order, without a single-partition window."""
    from lossframe.operators.numbering import number_rows
    return number_rows(claims_raw(spark, sf), ORDER_KEYS).select("row_id", "row_key")


UNION_FILES_SQL = O.claims_with(f"""
SELECT source_file, count(*) AS n_rows,
       CAST(count(DISTINCT claim_id) + max(CASE WHEN claim_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_claims,
       {dbl(f"CAST(coalesce(sum(paid), 0) AS {O.SUM})")} AS total_paid,
       {dbl(f"CAST(coalesce(sum(incurred), 0) AS {O.SUM})")} AS total_incurred,
       count(claimant) AS n_claimant, count(loss_date) AS n_loss_date
FROM (
  SELECT s.claim_id, s.paid, s.incurred, s.loss_date,
         CASE WHEN r.l_returnflag = 'R' THEN NULL ELSE s.claimant END AS claimant,
         'bordereau_' || r.l_returnflag || '.csv' AS source_file
  FROM std s JOIN (SELECT row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber) AS rid,
                          l_returnflag FROM raw) r ON s.row_id = r.rid
) GROUP BY source_file""")


@register("union_files", UNION_FILES_SQL)
def q_union_files(spark, sf):
    """S2 + M2 + M3: three 'files' with different headers (one lacking the
    claimant column), each mapped by its own guessed mapping, standardised
    and unioned by name with per-file lineage."""
    from lossframe.sources.fixtures import claims_raw_table
    raw = claims_raw_table(spark, sf)
    renames = {
        "A": {},
        "N": {"claim_no": "ClaimNumber", "date_of_loss": "Incident Date", "reported_date": "Date Reported",
              "paid_amount": "Amount Paid", "total_incurred": "Incurred Amount", "case_reserve": "Reserve",
              "ccy": "Currency", "policy_no": "Policy #", "claim_status": "Open/Closed", "insured_name": "Insured"},
        "R": {"claim_no": "CLAIM_NUM", "date_of_loss": "LossDate", "reported_date": "notif date",
              "paid_amount": "Paid Total", "total_incurred": "Reserve Plus Paid", "case_reserve": "Outstanding Amount",
              "ccy": "Curr", "policy_no": "PolicyID", "claim_status": "State"},
    }
    known = list(renames)
    frames = []
    # every other flag (or none) is a file with the plain headers
    for flag, ren in [*renames.items(), (None, {})]:
        own = F.col("l_returnflag") == flag if flag else ~F.coalesce(F.col("l_returnflag").isin(known), F.lit(False))
        part = raw.where(own)
        cols = [F.col(c).alias(ren.get(c, c)) for c in RAW_HEADERS if not (flag == "R" and c == "insured_name")]
        mapping = guess_schema([ren.get(c, c) for c in RAW_HEADERS if not (flag == "R" and c == "insured_name")])
        name = F.concat(F.lit("bordereau_"), F.col("_file"), F.lit(".csv"))
        frames.append(standardize(part.select(*cols, F.col("l_returnflag").alias("_file")), mapping, source_file=name,
                                  tenant_id=FIXTURE_TENANT))
    u = S.union_files(frames)
    return u.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.count_distinct("claim_id") + F.max(F.col("claim_id").isNull().cast("int"))).cast("long").alias("n_claims"),
        F.coalesce(F.sum("paid"), F.lit(0)).cast("decimal(38,6)").alias("total_paid"),
        F.coalesce(F.sum("incurred"), F.lit(0)).cast("decimal(38,6)").alias("total_incurred"),
        F.count("claimant").alias("n_claimant"), F.count("loss_date").alias("n_loss_date"))


@register("content_hash_dups", """
SELECT content_hash, count(*) AS n_docs, min(doc_id) AS first_doc_id
FROM (SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL)
GROUP BY content_hash HAVING count(*) > 1""")
def q_content_hash_dups(spark, sf):
    """Exact-duplicate contents by SHA-256 (documents as uploaded files)."""
    return S.content_hash_dups(table(spark, sf, "documents"), "doc_id", "text")


@register("text_lines", """
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line
FROM (
  SELECT doc_id, generate_subscripts(parts, 1) AS line_no, unnest(parts) AS line
  FROM (SELECT doc_id,
               CASE WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[1:-2]
                    ELSE string_split(text, chr(10)) END AS parts
        FROM documents WHERE text <> '')
)""")
def q_text_lines(spark, sf):
    """One row per text line, numbered from 1 (whole texts)."""
    return S.text_lines(table(spark, sf, "documents"), "doc_id", "text")


@register("text_sufficiency", f"""
SELECT doc_id, CAST(length(regexp_replace(text, '[\\t\\n\\x0B\\f\\r ]+', '', 'g')) AS BIGINT) AS nonspace_chars,
       length(regexp_replace(text, '[\\t\\n\\x0B\\f\\r ]+', '', 'g')) >= {K.TEXT_MIN_CHARS} AS has_text
FROM documents""")
def q_text_sufficiency(spark, sf):
    """Does a document carry enough selectable text (>= 400 non-space chars)?"""
    return S.text_sufficiency(table(spark, sf, "documents"), "doc_id", "text")


# ---------------------------------------------------------------------------
# Mapping (M)
# ---------------------------------------------------------------------------

@register("normalize_text_key", """
SELECT p_partkey, p_type,
       lower(array_to_string(regexp_extract_all(p_type, '[A-Za-z0-9]+'), '_')) AS norm_key
FROM part""")
def q_normalize_text_key(spark, sf):
    """M1 as a column expression (the header normaliser applied to text)."""
    p = table(spark, sf, "part")
    return p.select("p_partkey", "p_type", normalize_name_col(F.col("p_type")).alias("norm_key"))


@register("standardize", O.claims_with(f"SELECT {STD_COLS_SQL} FROM std"))
def q_standardize(spark, sf):
    """M3: the standard claims table (guessed mapping, AU locale)."""
    return std(spark, sf).select("row_id", *[c for c in K.STANDARD_SCHEMA.fieldNames()], "run_id")


@register("latest_per_key", """
SELECT user_id AS tenant_id, event_type AS counterparty, props AS mapping_json,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_utc
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn
      FROM events) WHERE rn = 1""")
def q_latest_per_key(spark, sf):
    """M5: upsert semantics - newest value per (tenant, counterparty) key."""
    ev = table(spark, sf, "events").select(
        F.col("user_id").alias("tenant_id"), F.col("event_type").alias("counterparty"),
        F.col("props").alias("mapping_json"), F.col("ts").alias("ts_utc"), "event_id")
    out = latest_per_key(ev, ["tenant_id", "counterparty"], ["ts_utc", "event_id"], ["mapping_json"])
    return out.select("tenant_id", "counterparty", "mapping_json", "ts_utc")


@register("distinct_sorted", """
SELECT DISTINCT user_id AS tenant_id, event_type AS counterparty FROM events ORDER BY 1, 2""")
def q_distinct_sorted(spark, sf):
    """M7: distinct counterparties per tenant, sorted."""
    from lossframe.operators.mapping import list_counterparties
    ev = table(spark, sf, "events").select(F.col("user_id").alias("tenant_id"),
                                           F.col("event_type").alias("counterparty"))
    return list_counterparties(ev)


# ---------------------------------------------------------------------------
# Scalar functions (F)
# ---------------------------------------------------------------------------

@register("parse_dates", O.claims_with(
    f"SELECT row_id, {iso('loss_date')} AS loss_date, {iso('report_date')} AS report_date FROM std"))
def q_parse_dates(spark, sf):
    """F1 (AU profile) over the mixed date spellings of the fixture."""
    return std(spark, sf).select("row_id", "loss_date", "report_date")


@register("parse_dates_us", O.claims_with(
    f"SELECT row_id, {iso('loss_date')} AS loss_date, {iso('report_date')} AS report_date FROM std",
    locale="US"))
def q_parse_dates_us(spark, sf):
    """F1 (US profile): day-first spellings are read month-first or rejected."""
    return claims_std(spark, sf, locale="US").select("row_id", "loss_date", "report_date")


def dated_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as rows of five files (their priorities): the date spelled as each file does, the price as text."""
    o = table(spark, sf, "orders")
    key, d, file = F.col("o_orderkey"), F.to_date("o_orderdate"), F.substring("o_orderpriority", 1, 1)
    price = F.col("o_totalprice").cast("decimal(18,2)")
    serial = F.datediff(d, F.lit(K.EXCEL_ORIGIN).cast("date")).cast("string")
    opened = (F.when(file == "1", F.when(key % 5 == 0, F.date_format(d, "MM/dd/yy")).otherwise(F.date_format(d, "MM/dd/yyyy")))
              .when(file == "2", F.when(key % 5 == 0, F.date_format(d, "d.M.yy")).otherwise(F.date_format(d, "dd/MM/yyyy")))
              .when(file == "3", F.when(key % 3 == 0, F.date_format(d, "d-MMM-yyyy"))
                    .when(key % 3 == 1, F.date_format(d, "MMM d, yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd")))
              .when(file == "4", F.when(key % 7 != 0, serial))
              .otherwise(F.when(key % 9 == 1, F.lit("n/a")).when(key % 2 == 0, serial).otherwise(F.date_format(d, "yyyy-MM-dd"))))
    text = (F.when(file == "3", F.concat(F.lit("$ "), price.cast("string"))).when(file == "4", F.format_number(price, 2))
            .when(file != "5", price.cast("string")))
    return o.select("o_orderkey", F.col("o_orderpriority").alias("file"), opened.alias("opened"), text.alias("price"),
                    F.when(file != "3", F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")).alias("stamp"))


DATED_ORDERS = f"""
raw AS (
  SELECT o_orderkey, o_orderpriority AS file,
    CASE o_orderpriority[1]
      WHEN '1' THEN CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%m/%d/%y') ELSE strftime(o_orderdate, '%m/%d/%Y') END
      WHEN '2' THEN CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%-d.%-m.%y') ELSE strftime(o_orderdate, '%d/%m/%Y') END
      WHEN '3' THEN CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%-d-%b-%Y')
                         WHEN 1 THEN strftime(o_orderdate, '%b %-d, %Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END
      WHEN '4' THEN CASE WHEN o_orderkey % 7 <> 0 THEN CAST(CAST(o_orderdate AS DATE) - DATE '{K.EXCEL_ORIGIN}' AS VARCHAR) END
      ELSE CASE WHEN o_orderkey % 9 = 1 THEN 'n/a'
                WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_orderdate AS DATE) - DATE '{K.EXCEL_ORIGIN}' AS VARCHAR)
                ELSE strftime(o_orderdate, '%Y-%m-%d') END
    END AS opened,
    CASE o_orderpriority[1] WHEN '3' THEN '$ ' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)
      WHEN '4' THEN format('{{:,.2f}}', CAST(o_totalprice AS DOUBLE))
      WHEN '5' THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS price,
    CASE WHEN o_orderpriority[1] <> '3' THEN strftime(CAST(o_orderdate AS DATE), '%Y-%m-%dT00:00:00') END AS stamp
  FROM orders),
long AS (UNPIVOT raw ON opened, price, stamp INTO NAME field VALUE text),
spelled AS (SELECT *, regexp_replace(text, '[ ,./-]+', '-', 'g') AS c FROM long),
dated AS (
  SELECT *, CASE WHEN regexp_matches(c, '^[0-9]{{1,2}}-[0-9]{{1,2}}-[0-9]{{4}}$') THEN try_strptime(c, '%d-%m-%Y') END AS dmy4,
    CASE WHEN regexp_matches(c, '^[0-9]{{1,2}}-[0-9]{{1,2}}-[0-9]{{4}}$') THEN try_strptime(c, '%m-%d-%Y') END AS mdy4,
    CASE WHEN regexp_matches(c, '^[0-9]{{1,2}}-[0-9]{{1,2}}-[0-9]{{2}}$') THEN try_strptime(c, '%d-%m-%y') END AS dmy2,
    CASE WHEN regexp_matches(c, '^[0-9]{{1,2}}-[0-9]{{1,2}}-[0-9]{{2}}$') THEN try_strptime(c, '%m-%d-%y') END AS mdy2,
    CASE WHEN regexp_matches(c, '^[0-9]{{4}}-') THEN try_strptime(c, '%Y-%m-%d') END AS ymd,
    try_strptime(c, '%d-%b-%Y') AS dby, try_strptime(c, '%b-%d-%Y') AS bdy,
    regexp_matches(text, '^[0-9]+([.][0-9]*)?$|^[0-9]{{1,3}}(,[0-9]{{3}})+([.][0-9]*)?$') AS is_number,
    regexp_matches(text, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(T.*)?$') AND TRY_CAST(text AS TIMESTAMP) IS NOT NULL AS is_date
  FROM spelled),
counted AS (
  SELECT f.file, f.field, count(d.text) AS n, count(*) FILTER (WHERE is_number) AS n_number,
    count(*) FILTER (WHERE is_date) AS n_date, count(dmy4) AS n_dmy4, count(mdy4) AS n_mdy4, count(dmy2) AS n_dmy2, count(mdy2) AS n_mdy2
  FROM (SELECT DISTINCT r.file, t.field FROM raw r, (VALUES ('opened'), ('price'), ('stamp')) t(field)) f
  LEFT JOIN dated d ON d.file = f.file AND d.field = f.field GROUP BY f.file, f.field),
typed AS (SELECT *, CASE WHEN n = 0 THEN 'empty' WHEN n_number = n THEN 'number' WHEN n_date = n THEN 'date' ELSE 'text' END AS type
          FROM counted)"""


@register("column_types", f"""
WITH {DATED_ORDERS}
SELECT file, field, n, n_number, n_date, type, n_dmy4 AS n_day_first, n_mdy4 AS n_month_first FROM typed""")
def q_column_types(spark, sf):
    """type and counts of every file's columns, one aggregate over the values."""
    orders = [order for _, order, _ in CT.date_orders("AU")]
    seen = CT.profile(dated_orders(spark, sf), ["opened", "price", "stamp"], "file")
    return seen.select("file", "field", "n", "n_number", "n_date", CT.column_type().alias("type"),
                       *[F.get("n_order", F.lit(orders.index(o))).alias(n)
                         for o, n in (("dmY", "n_day_first"), ("mdY", "n_month_first"))])


@register("parse_dates_trained", f"""
WITH {DATED_ORDERS}
SELECT r.o_orderkey, r.file, strftime(CASE WHEN t.type = 'number' THEN
    CASE WHEN CAST(d.text AS DOUBLE) > {K.EXCEL_SERIAL_MIN} AND CAST(d.text AS DOUBLE) < {K.EXCEL_SERIAL_MAX}
         THEN DATE '{K.EXCEL_ORIGIN}' + CAST(floor(CAST(d.text AS DOUBLE)) AS INTEGER) END
  ELSE CAST(coalesce(ymd, dby, bdy, CASE WHEN n_mdy4 > n_dmy4 OR (n_mdy4 = n_dmy4 AND n_mdy4 + n_mdy2 > n_dmy4 + n_dmy2) THEN coalesce(mdy4, dmy4) ELSE coalesce(dmy4, mdy4) END,
                     CASE WHEN n_mdy2 > n_dmy2 OR (n_mdy2 = n_dmy2 AND n_mdy4 + n_mdy2 > n_dmy4 + n_dmy2) THEN coalesce(mdy2, dmy2) ELSE coalesce(dmy2, mdy2) END) AS DATE) END, '%Y-%m-%d') AS opened
FROM raw r LEFT JOIN dated d ON d.o_orderkey = r.o_orderkey AND d.field = 'opened'
LEFT JOIN typed t ON t.file = r.file AND t.field = 'opened'""")
def q_parse_dates_trained(spark, sf):
    """dates by the order and type that each file's column shows: month first in one file, day first in
    another, Excel days only where the whole column is numeric."""
    return CT.trained_dates(dated_orders(spark, sf), ["opened"], "file").select("o_orderkey", "file", "opened")


@register("excel_serial_dates", f"""
SELECT o_orderkey, o_totalprice AS serial,
       strftime(CASE WHEN o_totalprice > {K.EXCEL_SERIAL_MIN} AND o_totalprice < {K.EXCEL_SERIAL_MAX}
                THEN DATE '{K.EXCEL_ORIGIN}' + CAST(floor(o_totalprice) AS INTEGER) END, '%Y-%m-%d') AS as_date
FROM orders""")
def q_excel_serial_dates(spark, sf):
    """a numeric column read as Excel serial days (only 20000 < n < 60000)."""
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", F.col("o_totalprice").alias("serial"),
                    D.parse_date(F.col("o_totalprice"), o.schema["o_totalprice"].dataType).alias("as_date"))


@register("clean_amounts", O.claims_with(f"""
SELECT row_key, paid_amount, {dbl(O.clean_amount('paid_amount'))} AS paid,
       case_reserve, {dbl(O.clean_amount('case_reserve'))} AS outstanding FROM raw"""))
def q_clean_amounts(spark, sf):
    """money text ('$ 1,234.50', '(12.00)', ...) -> exact DECIMAL."""
    r = claims_raw(spark, sf)
    return r.select("row_key", "paid_amount", clean_amount_text(F.col("paid_amount")).alias("paid"),
                    "case_reserve", clean_amount_text(F.col("case_reserve")).alias("outstanding"))


@register("synth_incurred", O.claims_with(f"""
SELECT s.row_id, {dbl('s.paid')} AS paid, {dbl('s.outstanding')} AS outstanding, {dbl('s.incurred')} AS incurred
FROM std s JOIN (SELECT row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber) AS rid,
                        total_incurred FROM raw) r ON s.row_id = r.rid
WHERE r.total_incurred IS NULL AND s.paid IS NOT NULL AND s.outstanding IS NOT NULL"""))
def q_synth_incurred(spark, sf):
    """rows whose incurred was filled as paid + outstanding."""
    s = claims_std(spark, sf, keep_raw=("total_incurred",))
    filled = s.where(F.col("total_incurred").isNull() & F.col("paid").isNotNull()
                     & F.col("outstanding").isNotNull())
    return filled.select("row_id", "paid", "outstanding", "incurred")


@register("mask_claimant", O.claims_with(
    "SELECT row_id, regexp_replace(claimant, '[A-Za-z]', 'x', 'g') AS claimant_masked FROM std"))
def q_mask_claimant(spark, sf):
    """claimant letters masked."""
    return std(spark, sf).select("row_id", mask_claimant(F.col("claimant")).alias("claimant_masked"))


def _hmac_sql(x: str, key: str) -> str:
    block = key.encode().ljust(64, b"\0")  # the keys here are shorter than a hash block
    ipad, opad = (bytes(x ^ pad for x in block) for pad in (0x36, 0x5C))
    inner = f"unhex(sha256(unhex('{ipad.hex()}') || encode({x})))"
    return f"sha256(unhex('{opad.hex()}') || {inner})"


@register("hmac_policy", O.claims_with(
    "SELECT row_id, policy_number, CASE WHEN policy_number IS NULL OR policy_number = '' THEN policy_number "
    f"ELSE {_hmac_sql('policy_number', FIXTURE_SALT)} END AS policy_hash FROM std"))
def q_hmac_policy(spark, sf):
    """F8: keyed HMAC-SHA256 pseudonym of the policy number (NULL/blank kept)."""
    from lossframe.functions.privacy import mask_policy
    return std(spark, sf).select("row_id", "policy_number",
                                 mask_policy(F.col("policy_number"), FIXTURE_SALT).alias("policy_hash"))


@register("scrub_names", f"""
SELECT page_id, {_hmac_sql('url', AUDIT_SALT)} AS url_hmac, 'redacted' AS url_redacted FROM pages""")
def q_scrub_names(spark, sf):
    """names in audit records either keyed-hashed or redacted."""
    p = table(spark, sf, "pages")
    return p.select("page_id", scrub_name(F.col("url"), True, AUDIT_SALT).alias("url_hmac"),
                    scrub_name(F.col("url"), True, "").alias("url_redacted"))


DEV_SQL = ("GREATEST(0, date_diff('month', date_trunc('month', loss_date), date_trunc('month', report_date)))")


@register("dev_lag", O.claims_with(
    f"SELECT row_id, CAST(year(loss_date) AS BIGINT) AS ay, CAST({DEV_SQL} AS BIGINT) AS dev_mon FROM std "
    "WHERE loss_date IS NOT NULL AND report_date IS NOT NULL"))
def q_dev_lag(spark, sf):
    """F16: accident year and development months (month floors, >= 0)."""
    s = std(spark, sf).where(F.col("loss_date").isNotNull() & F.col("report_date").isNotNull())
    return s.select("row_id", D.accident_year(F.col("loss_date")).alias("ay"),
                    D.dev_months(F.col("loss_date"), F.col("report_date")).alias("dev_mon"))


# ---------------------------------------------------------------------------
# Validation rules (V)
# ---------------------------------------------------------------------------

ISSUE_OUT = ["row", "claim_id", "issue", "detail"]


def _rule_query(rule: str, with_term: bool = False):
    def fn(spark, sf):
        cfg = V.RuleConfig.only(rule)
        if with_term:
            cfg = term_cfg(cfg)
        return V.validate(std(spark, sf), cfg).select(*ISSUE_OUT)
    fn.__doc__ = f"Issues raised by {rule} alone."
    return fn


def R_NUM(x: str) -> str:
    """R-style number text in SQL (no trailing zeros)."""
    s = f"CAST({x} AS VARCHAR)"
    return (f"CASE WHEN {x} = 0 THEN '0' WHEN contains({s}, '.') THEN "
            f"regexp_replace(regexp_replace({s}, '0+$', ''), '\\.$', '') ELSE {s} END")


DUP_KEY = f"{O.norm_id('claim_id')}, loss_date"
ALLOWED_SQL = ", ".join(O.q(c) for c in K.ALLOWED_CURRENCIES)
TERM_DETAIL = f"Policy: {POLICY_START.isoformat()} to {POLICY_END.isoformat()}"

FENCE_CTE = """fence AS (
  SELECT count(paid) AS n, quantile_cont(paid, 0.25) AS q1, quantile_cont(paid, 0.75) AS q3 FROM std
), fence2 AS (
  SELECT n, greatest(CAST(0 AS DECIMAL(28,6)), q1 - 1.5 * (q3 - q1)) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM fence
)"""

# (order, issue, SQL predicate over std-with-keys ``k``, SQL detail)
RULE_SQL = {
    "rule_required_fields": [(1, K.ISSUE_REQUIRED, f"{O.blank('claim_id')} OR loss_date IS NULL OR report_date IS NULL",
                              O.q(K.DETAIL_REQUIRED))],
    "rule_negative_values": [(2, K.ISSUE_NEG_PAID, "paid < 0", O.q(K.DETAIL_NEG_PAID)),
                             (3, K.ISSUE_NEG_INCURRED, "incurred < 0", O.q(K.DETAIL_NEG_INCURRED)),
                             (4, K.ISSUE_NEG_OUTSTANDING, "outstanding < 0", O.q(K.DETAIL_NEG_OUTSTANDING))],
    "rule_incurred_lt_paid": [(5, K.ISSUE_INC_LT_PAID, "incurred < paid", O.q(K.DETAIL_INC_LT_PAID))],
    "rule_reconcile": [(6, K.ISSUE_RECONCILE, "abs(incurred - (paid + outstanding)) > 0.01",
                        O.q(K.DETAIL_RECONCILE))],
    "rule_currency_list": [(7, K.ISSUE_CURRENCY, f"currency IS NOT NULL AND currency NOT IN ({ALLOWED_SQL})",
                            O.q(K.DETAIL_CURRENCY))],
    "rule_duplicates": [(8, K.ISSUE_DUPLICATE, "dup_rn > 1", O.q(K.DETAIL_DUPLICATE))],
    "rule_date_order": [(9, K.ISSUE_DATE_ORDER, "loss_date > report_date", O.q(K.DETAIL_DATE_ORDER))],
    "rule_policy_term": [(10, K.ISSUE_POLICY_TERM,
                          f"loss_date < DATE '{POLICY_START.isoformat()}' OR loss_date > DATE '{POLICY_END.isoformat()}'",
                          O.q(TERM_DETAIL))],
    "rule_missing_policy": [(11, K.ISSUE_MISSING_POLICY, O.blank("policy_number"), "''")],
    "rule_missing_currency": [(12, K.ISSUE_MISSING_CURRENCY, O.blank("currency"), "''")],
    "rule_paid_outliers": [(13, K.ISSUE_PAID_OUTLIER, "n >= 5 AND (paid > hi OR paid < lo)",
                            f"'IQR fence: [' || {R_NUM('round(lo, 2)')} || '..' || {R_NUM('round(hi, 2)')} "
                            "|| '] (mult=1.5)'")],
    "rule_high_ratio": [(14, K.ISSUE_HIGH_RATIO, "paid > 0 AND incurred IS NOT NULL AND incurred > paid * 2",
                         "'ratio > 2'")],
    "rule_missing_claimant": [(15, K.ISSUE_MISSING_CLAIMANT, O.blank("claimant"), "''")],
    "rule_zero_rows": [(16, K.ISSUE_ZERO_ROWS, "paid = 0 AND incurred = 0", "''")],
    "rule_parse_dates": [(17, K.ISSUE_UNPARSE_LOSS, "loss_date IS NULL", O.q(K.DETAIL_UNPARSE)),
                         (18, K.ISSUE_UNPARSE_REPORT, "report_date IS NULL", O.q(K.DETAIL_UNPARSE))],
    "rule_multi_rows_per_claim": [(19, K.ISSUE_MULTI_ROWS, "claim_n > 1", "'n=' || CAST(claim_n AS VARCHAR)")],
}

KEYED_CTE = f"""k AS (
  SELECT std.*, fence2.n, fence2.lo, fence2.hi,
         row_number() OVER (PARTITION BY {DUP_KEY} ORDER BY row_id) AS dup_rn,
         count(*) OVER (PARTITION BY claim_id) AS claim_n
  FROM std, fence2
)"""


def issues_sql(rules: list[str], with_order: bool = False) -> str:
    parts = []
    for r in rules:
        for order, issue, pred, detail in RULE_SQL[r]:
            extra = f", {order} AS rule_order" if with_order else ""
            parts.append(f"SELECT row_id AS row, claim_id, {O.q(issue)} AS issue, {detail} AS detail{extra} "
                         f"FROM k WHERE {pred}")
    return O.claims_with("\nUNION ALL\n".join(parts), more_ctes=FENCE_CTE + ",\n" + KEYED_CTE)


for _flag, _key in [("rule_required_fields", "rule_required_fields"), ("rule_incurred_lt_paid", "rule_incurred_lt_paid"),
                    ("rule_reconcile", "rule_reconcile"), ("rule_currency_list", "rule_currency_list"),
                    ("rule_duplicates", "dup_claim_loss_date"), ("rule_date_order", "rule_date_order"),
                    ("rule_policy_term", "rule_policy_term"), ("rule_missing_policy", "rule_missing_policy"),
                    ("rule_missing_currency", "rule_missing_currency"), ("rule_paid_outliers", "rule_paid_outliers"),
                    ("rule_high_ratio", "rule_high_ratio"), ("rule_missing_claimant", "rule_missing_claimant"),
                    ("rule_zero_rows", "rule_zero_rows"), ("rule_parse_dates", "rule_parse_dates"),
                    ("rule_multi_rows_per_claim", "rule_multi_rows")]:
    register(_key, issues_sql([_flag]))(_rule_query(_flag, with_term=(_flag == "rule_policy_term")))


def _neg_query(which: str):
    def fn(spark, sf):
        iss = V.validate(std(spark, sf), V.RuleConfig.only("rule_negative_values"))
        return iss.where(F.col("issue") == which).select(*ISSUE_OUT)
    fn.__doc__ = f"V2-V4: {which}."
    return fn


for _i, (_key, _issue) in enumerate([("rule_negative_paid", K.ISSUE_NEG_PAID),
                                      ("rule_negative_incurred", K.ISSUE_NEG_INCURRED),
                                      ("rule_negative_outstanding", K.ISSUE_NEG_OUTSTANDING)]):
    _o, _iss, _pred, _det = RULE_SQL["rule_negative_values"][_i]
    register(_key, O.claims_with(
        f"SELECT row_id AS row, claim_id, {O.q(_iss)} AS issue, {_det} AS detail FROM std WHERE {_pred}"))(
        _neg_query(_issue))


@register("all_issues", issues_sql(K.RULE_FLAGS))
def q_all_issues(spark, sf):
    """Every rule on (default config + policy term), one explode pass."""
    return V.validate(std(spark, sf), term_cfg(V.RuleConfig())).select(*ISSUE_OUT)


for _pack in ("underwriter", "claims_qa", "lloyds"):
    def _pack_q(spark, sf, _p=_pack):
        cfg = V.RuleConfig.pack(_p)
        return V.validate(std(spark, sf), term_cfg(cfg)).select(*ISSUE_OUT)
    _pack_q.__doc__ = f"V20: the {_pack} rule pack."
    register(f"issues_{_pack}", issues_sql(K.RULE_PACKS[_pack]["rules"]))(_pack_q)


@register("run_metrics", O.claims_with(f"""
SELECT metric, value FROM (
  SELECT 1 AS o, 'n_rows' AS metric, CAST(count(*) AS VARCHAR) AS value FROM std
  UNION ALL SELECT 2, 'n_claims', CAST(count(DISTINCT claim_id) + max(CASE WHEN claim_id IS NULL THEN 1 ELSE 0 END) AS VARCHAR) FROM std
  UNION ALL SELECT 3, 'total_paid', CAST(CAST(coalesce(sum(paid), 0) AS {O.SUM}) AS VARCHAR) FROM std
  UNION ALL SELECT 4, 'total_incurred', CAST(CAST(coalesce(sum(incurred), 0) AS {O.SUM}) AS VARCHAR) FROM std
  UNION ALL SELECT 5, 'avg_severity', CAST(CAST(avg(paid) AS {O.SUM}) AS VARCHAR) FROM std
  UNION ALL SELECT 6, 'missing_required', CAST(count(*) AS VARCHAR) FROM k WHERE {RULE_SQL['rule_required_fields'][0][2]}
  UNION ALL SELECT 7, 'duplicates', CAST(count(*) AS VARCHAR) FROM k WHERE dup_rn > 1
  UNION ALL SELECT 8, 'outliers', CAST(count(*) AS VARCHAR) FROM k WHERE n >= 5 AND (paid > hi OR paid < lo)
)""", more_ctes=FENCE_CTE + ",\n" + KEYED_CTE))
def q_run_metrics(spark, sf):
    """The eight run metrics in long form (metric, value as text)."""
    return V.run_metrics(V.annotate(std(spark, sf), term_cfg(V.RuleConfig())), long=True)


ALL_ISSUES_ORDERED = issues_sql(K.RULE_FLAGS, with_order=True)


@register("row_flags", O.claims_with(f"""
SELECT s.row_id, s.claim_id, f.flags, f.flags_detail
FROM std s LEFT JOIN (
  SELECT row AS frow,
         string_agg(issue, '; ' ORDER BY rule_order) FILTER (WHERE first_issue) AS flags,
         coalesce(string_agg(detail, ' | ' ORDER BY rule_order) FILTER (WHERE first_detail AND detail <> ''), '')
           AS flags_detail
  FROM (SELECT *, row_number() OVER (PARTITION BY row, issue ORDER BY rule_order) = 1 AS first_issue,
               row_number() OVER (PARTITION BY row, detail ORDER BY rule_order) = 1 AS first_detail
        FROM issues)
  GROUP BY row
) f ON s.row_id = f.frow""", more_ctes=FENCE_CTE + ",\n" + KEYED_CTE + ",\nissues AS (" +
    ALL_ISSUES_ORDERED.split(KEYED_CTE, 1)[1].strip() + ")"))
def q_row_flags(spark, sf):
    """V22: 'why flagged' text per claims row (left join; NULL when clean)."""
    s = std(spark, sf)
    return V.row_flags_one_pass(s, term_cfg(V.RuleConfig())).select("row_id", "claim_id", "flags", "flags_detail")


@register("flagged_rows", O.claims_with(f"""
SELECT {STD_COLS_SQL} FROM std WHERE row_id IN (
  SELECT row_id FROM k WHERE {RULE_SQL['rule_reconcile'][0][2]} OR {RULE_SQL['rule_date_order'][0][2]})""",
    more_ctes=FENCE_CTE + ",\n" + KEYED_CTE))
def q_flagged_rows(spark, sf):
    """The claims rows behind selected issues (a filter on each row's issues)."""
    ann = V.annotate(std(spark, sf), V.RuleConfig.only("rule_reconcile", "rule_date_order"))
    return V.flagged_rows(ann).select("row_id", *K.STANDARD_SCHEMA.fieldNames(), "run_id")


TOP_ISSUES_SQL = O.claims_with(
    "SELECT row, claim_id, issue, detail FROM issues "
    "ORDER BY rule_order, CASE WHEN rule_order = 19 THEN claim_id END NULLS LAST, row LIMIT 30",
    more_ctes=FENCE_CTE + ",\n" + KEYED_CTE + ",\nissues AS (" +
    ALL_ISSUES_ORDERED.split(KEYED_CTE, 1)[1].strip() + ")")


@register("top_issues", TOP_ISSUES_SQL)
def q_top_issues(spark, sf):
    """The first 30 issues in report order (rule order, then row)."""
    s = std(spark, sf)
    return V.top_issues(V.validate(s, term_cfg(V.RuleConfig())), 30).select(*ISSUE_OUT)


# ---------------------------------------------------------------------------
# Quality summary (Q)
# ---------------------------------------------------------------------------

def _sum_sql(x: str) -> str:
    return dbl(f"CAST(coalesce(sum({x}), 0) AS {O.SUM})")


CLAIM_CTE = f"""clm AS (
  SELECT claim_id,
         CAST(sum(coalesce(paid, 0)) AS {O.SUM}) AS paid_c,
         CAST(sum(coalesce(incurred, 0)) AS {O.SUM}) AS incurred_c,
         CAST(sum(coalesce(incurred, 0) - coalesce(paid, 0)) AS {O.SUM}) AS os_c
  FROM std WHERE NOT {O.blank('claim_id')} GROUP BY claim_id
)"""


@register("claim_rollup", O.claims_with(
    f"SELECT claim_id, {dbl('paid_c')} AS paid_c, {dbl('incurred_c')} AS incurred_c, {dbl('os_c')} AS os_c FROM clm",
    more_ctes=CLAIM_CTE))
def q_claim_rollup(spark, sf):
    """Q2: per-claim paid, incurred and outstanding (incurred - paid)."""
    return Q.claim_rollup(std(spark, sf))


@register("open_closed", O.claims_with(f"""
SELECT count(*) FILTER (WHERE os_c > 0.01) AS open_n, count(*) FILTER (WHERE os_c <= 0.01) AS closed_n,
       {_sum_sql('CASE WHEN os_c > 0.01 THEN os_c END')} AS open_os,
       {_sum_sql('CASE WHEN os_c <= 0.01 THEN paid_c END')} AS closed_paid,
       count(*) FILTER (WHERE paid_c = 0 AND incurred_c = 0) AS zero_claims
FROM clm""", more_ctes=CLAIM_CTE))
def q_open_closed(spark, sf):
    """Q4 + Q6: open/closed split at 0.01 outstanding, zero-amount claims."""
    return Q.open_closed(std(spark, sf))


@register("incurred_lt_paid_summary", O.claims_with(f"""
SELECT count(*) AS inc_lt_rows_n,
       CAST(count(DISTINCT claim_id) + max(CASE WHEN claim_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS inc_lt_claims_n,
       {_sum_sql('paid - incurred')} AS inc_lt_variance
FROM std WHERE incurred < paid"""))
def q_incurred_lt_paid_summary(spark, sf):
    """Q7: rows, distinct claims and variance where incurred < paid."""
    return Q.incurred_lt_paid(std(spark, sf))


@register("recon_summary", O.claims_with(f"""
SELECT count(*) AS recon_rows_n, {_sum_sql('abs(incurred - (paid + coalesce(outstanding, 0)))')} AS recon_abs_delta
FROM std WHERE paid IS NOT NULL AND incurred IS NOT NULL
  AND abs(incurred - (paid + coalesce(outstanding, 0))) > 0.01"""))
def q_recon_summary(spark, sf):
    """Q8: reconciliation gaps with outstanding NULL read as 0."""
    return Q.row_aggregates(std(spark, sf)).select("recon_rows_n", "recon_abs_delta")


@register("outlier_summary", O.claims_with("""
SELECT CAST(count(*) FILTER (WHERE s.paid > f.fence) AS BIGINT) AS outliers_n,
       CAST(max(s.paid) FILTER (WHERE s.paid > f.fence) AS DOUBLE) AS top_loss,
       CAST(any_value(f.iqr) AS DOUBLE) AS iqr, CAST(any_value(f.q3) AS DOUBLE) AS q3
FROM std s, (SELECT q3 + 1.5 * (q3 - q1) AS fence, q3 - q1 AS iqr, q3 FROM (
    SELECT quantile_cont(paid, 0.25) AS q1, quantile_cont(paid, 0.75) AS q3 FROM std WHERE paid >= 0)) f"""))
def q_outlier_summary(spark, sf):
    """Q9: upper-fence outliers over non-negative paid (k = 1.5)."""
    s = std(spark, sf)
    d = Q.summary_outliers(s)
    return spark.createDataFrame([(d["outliers_n"], d["top_loss"], d["iqr"], d["q3"])],
                                 "outliers_n long, top_loss decimal(38,6), iqr decimal(38,6), q3 decimal(38,6)")


@register("policy_term_summary", O.claims_with(f"""
SELECT count(*) FILTER (WHERE loss_date < DATE '{POLICY_START}' OR loss_date > DATE '{POLICY_END}')
         AS outside_term_n,
       CAST(round(100.0 * count(*) FILTER (WHERE loss_date < DATE '{POLICY_START}' OR loss_date > DATE '{POLICY_END}')
             / count(*), 1) AS DOUBLE) AS outside_term_pct
FROM std"""))
def q_policy_term_summary(spark, sf):
    """Q11: rows with a loss date outside the policy term, count and percent."""
    s = std(spark, sf)
    r = Q.row_aggregates(s, POLICY_START, POLICY_END)
    return r.select("outside_term_n",
                    F.round(F.lit(100.0) * F.col("outside_term_n") / F.col("n_rows"), 1).alias("outside_term_pct"))


@register("currency_summary", O.claims_with(f"""
SELECT currency, count(*) AS n_rows, currency IN ({ALLOWED_SQL}) AS allowed
FROM std WHERE currency IS NOT NULL GROUP BY currency"""))
def q_currency_summary(spark, sf):
    """Q12: the distinct currency codes seen and whether each is allowed."""
    return Q.currency_summary(std(spark, sf))


EXACT_KEY_SQL = ", ".join([
    O.norm_id("claim_id"), "loss_date", "report_date",
    "CAST(round(coalesce(paid, 0), 2) AS DECIMAL(28,2))", "CAST(round(coalesce(incurred, 0), 2) AS DECIMAL(28,2))",
    "CAST(round(coalesce(outstanding, 0), 2) AS DECIMAL(28,2))", "upper(coalesce(currency, ''))",
    O.norm_id("policy_number"), O.norm_id("status"), O.norm_id("claimant")])


@register("exact_row_dups", O.claims_with(f"""
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS exact_dup_n
FROM (SELECT count(*) AS n FROM std GROUP BY {EXACT_KEY_SQL})"""))
def q_exact_row_dups(spark, sf):
    """Q14: rows repeating an earlier row on the normalised 10-field key."""
    return Q.exact_row_dups(std(spark, sf))


@register("dup_summary", O.claims_with("""
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS dup_claimid_lossdate_n
FROM (SELECT count(*) AS n FROM std GROUP BY claim_id, loss_date)"""))
def q_dup_summary(spark, sf):
    """Q15: 2nd+ rows on the raw (claim_id, loss_date) pair."""
    return Q.dup_claimid_lossdate(std(spark, sf))


@register("required_missing", O.claims_with(f"""
SELECT count(*) FILTER (WHERE {O.blank('claim_id')}) AS claim_id,
       count(*) FILTER (WHERE loss_date IS NULL) AS loss_date,
       count(*) FILTER (WHERE report_date IS NULL) AS report_date,
       count(*) FILTER (WHERE {O.blank('policy_number')}) AS policy_number,
       count(*) FILTER (WHERE {O.blank('currency')}) AS currency,
       count(*) FILTER (WHERE {O.blank('status')}) AS status
FROM std"""))
def q_required_missing(spark, sf):
    """Q16: null/blank counts of the required fields."""
    return Q.required_missing(std(spark, sf))


@register("dataset_recon", O.claims_with(f"""
SELECT CAST(gap AS DOUBLE) AS dataset_recon_gap, CAST(tol AS DOUBLE) AS dataset_recon_tol,
       gap <= tol AS dataset_recon_ok
FROM (SELECT abs(ti - (tp + tos)) AS gap,
             CAST(greatest(100, 0.001 * greatest(1, ti)) AS {O.SUM}) AS tol
      FROM (SELECT CAST(coalesce(sum(paid), 0) AS {O.SUM}) AS tp, CAST(coalesce(sum(incurred), 0) AS {O.SUM}) AS ti,
                   CAST(coalesce(sum(outstanding), 0) AS {O.SUM}) AS tos FROM std))"""))
def q_dataset_recon(spark, sf):
    """Q17: dataset-level sum(incurred) vs sum(paid + outstanding)."""
    return Q.dataset_recon(std(spark, sf))


def _quality_summary_sql() -> str:
    blank = O.blank
    term = f"(loss_date < DATE '{POLICY_START}' OR loss_date > DATE '{POLICY_END}')"
    ctes = CLAIM_CTE + f""",
ra AS (
  SELECT count(*) AS n_rows,
         CAST(coalesce(sum(paid), 0) AS {O.SUM}) AS tp, CAST(coalesce(sum(incurred), 0) AS {O.SUM}) AS ti,
         CAST(coalesce(sum(outstanding), 0) AS {O.SUM}) AS tos,
         count(*) FILTER (WHERE paid < 0) AS neg_paid_n,
         CAST(coalesce(sum(paid) FILTER (WHERE paid < 0), 0) AS {O.SUM}) AS neg_paid_sum,
         count(*) FILTER (WHERE outstanding < 0) AS neg_os_n,
         CAST(coalesce(sum(outstanding) FILTER (WHERE outstanding < 0), 0) AS {O.SUM}) AS neg_os_sum,
         count(*) FILTER (WHERE incurred < paid) AS inc_lt_rows_n,
         CAST(coalesce(sum(paid - incurred) FILTER (WHERE incurred < paid), 0) AS {O.SUM}) AS inc_lt_variance,
         count(*) FILTER (WHERE paid IS NOT NULL AND incurred IS NOT NULL
                          AND abs(incurred - (paid + coalesce(outstanding, 0))) > 0.01) AS recon_rows_n,
         CAST(coalesce(sum(abs(incurred - (paid + coalesce(outstanding, 0)))) FILTER (
              WHERE paid IS NOT NULL AND incurred IS NOT NULL
                AND abs(incurred - (paid + coalesce(outstanding, 0))) > 0.01), 0) AS {O.SUM}) AS recon_abs_delta,
         count(*) FILTER (WHERE loss_date IS NULL) AS unparse_loss,
         count(*) FILTER (WHERE report_date IS NULL) AS unparse_report,
         count(*) FILTER (WHERE report_date < loss_date) AS report_before_loss,
         count(*) FILTER (WHERE {term}) AS outside_term_n,
         coalesce(string_agg(DISTINCT currency, ', ' ORDER BY currency), '') AS currencies,
         coalesce(bool_and(currency IN ({ALLOWED_SQL})) FILTER (WHERE currency IS NOT NULL), true) AS currency_ok,
         coalesce(bool_and(paid = round(paid, 2)) FILTER (WHERE paid IS NOT NULL), true)
           AND coalesce(bool_and(incurred = round(incurred, 2)) FILTER (WHERE incurred IS NOT NULL), true)
           AS decimals_ok,
         count(*) FILTER (WHERE {blank('claim_id')}) AS req_claim_id,
         count(*) FILTER (WHERE loss_date IS NULL) AS req_loss_date,
         count(*) FILTER (WHERE report_date IS NULL) AS req_report_date,
         count(*) FILTER (WHERE {blank('policy_number')}) AS req_policy_number,
         count(*) FILTER (WHERE {blank('currency')}) AS req_currency,
         count(*) FILTER (WHERE {blank('status')}) AS req_status
  FROM std
),
cc AS (
  SELECT count(*) AS n_claims, count(*) FILTER (WHERE lt) AS inc_lt_claims_n
  FROM (SELECT claim_id, coalesce(bool_or(incurred < paid), false) AS lt FROM std GROUP BY claim_id)
),
oc AS (
  SELECT count(*) FILTER (WHERE os_c > 0.01) AS open_n, count(*) FILTER (WHERE os_c <= 0.01) AS closed_n,
         CAST(coalesce(sum(os_c) FILTER (WHERE os_c > 0.01), 0) AS {O.SUM}) AS open_os,
         CAST(coalesce(sum(paid_c) FILTER (WHERE os_c <= 0.01), 0) AS {O.SUM}) AS closed_paid,
         count(*) FILTER (WHERE paid_c = 0 AND incurred_c = 0) AS zero_claims
  FROM clm
),
ex AS (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS exact_dup_n
       FROM (SELECT count(*) AS n FROM std GROUP BY {EXACT_KEY_SQL})),
dp AS (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS dup_claimid_lossdate_n
       FROM (SELECT count(*) AS n FROM std GROUP BY claim_id, loss_date)),
qf AS (SELECT count(*) AS n_pos, quantile_cont(paid, 0.25) AS q1, quantile_cont(paid, 0.75) AS q3
       FROM std WHERE paid >= 0),
ol AS (SELECT count(*) FILTER (WHERE s.paid > qf.q3 + 1.5 * (qf.q3 - qf.q1)) AS outliers_n,
              max(s.paid) FILTER (WHERE s.paid > qf.q3 + 1.5 * (qf.q3 - qf.q1)) AS top_loss
       FROM std s, qf WHERE qf.n_pos >= 5)"""
    tail = f"""
SELECT ra.n_rows, cc.n_claims, {dbl('ra.tp')} AS total_paid, {dbl('ra.ti')} AS total_incurred,
       CASE WHEN cc.n_claims > 0 THEN round(CAST(ra.tp AS DOUBLE) / cc.n_claims, 6) END AS severity_claim,
       oc.open_n, oc.closed_n, {dbl('oc.open_os')} AS open_os, {dbl('oc.closed_paid')} AS closed_paid,
       ra.neg_paid_n, {dbl('ra.neg_paid_sum')} AS neg_paid_sum, ra.neg_os_n, {dbl('ra.neg_os_sum')} AS neg_os_sum,
       oc.zero_claims, ra.inc_lt_rows_n, cc.inc_lt_claims_n, {dbl('ra.inc_lt_variance')} AS inc_lt_variance,
       ra.recon_rows_n, {dbl('ra.recon_abs_delta')} AS recon_abs_delta,
       CAST(1.5 AS DOUBLE) AS outlier_k, coalesce(ol.outliers_n, 0) AS outliers_n, {dbl('ol.top_loss')} AS top_loss,
       CASE WHEN qf.n_pos >= 5 THEN {dbl('qf.q3 - qf.q1')} END AS iqr,
       CASE WHEN qf.n_pos >= 5 THEN {dbl('qf.q3')} END AS q3,
       ra.unparse_loss, ra.unparse_report, ra.report_before_loss,
       true AS pol_term_set, '{POLICY_START}' AS policy_start, '{POLICY_END}' AS policy_end,
       ra.outside_term_n, round(100.0 * ra.outside_term_n / ra.n_rows, 1) AS outside_term_pct,
       ra.currencies, ra.currency_ok, ra.decimals_ok, ex.exact_dup_n, dp.dup_claimid_lossdate_n,
       ra.req_claim_id, ra.req_loss_date, ra.req_report_date, ra.req_policy_number, ra.req_currency, ra.req_status,
       abs(ra.ti - (ra.tp + ra.tos)) <= greatest(100, 0.001 * greatest(1, ra.ti)) AS dataset_recon_ok,
       {dbl('abs(ra.ti - (ra.tp + ra.tos))')} AS dataset_recon_gap,
       {dbl(f'CAST(greatest(100, 0.001 * greatest(1, ra.ti)) AS {O.SUM})')} AS dataset_recon_tol
FROM ra, cc, oc, ex, dp, qf LEFT JOIN ol ON true"""
    return O.claims_with(tail, more_ctes=ctes)


@register("quality_summary", _quality_summary_sql())
def q_quality_summary(spark, sf):
    """Q1-Q17 in one row (policy term set)."""
    return Q.quality_summary(std(spark, sf), POLICY_START, POLICY_END)


# ---------------------------------------------------------------------------
# Pivots and triangles (T)
# ---------------------------------------------------------------------------

@register("ay_currency_pivot", O.claims_with(f"""
SELECT CAST(year(loss_date) AS BIGINT) AS ay, currency, count(*) AS rows,
       CAST(count(DISTINCT claim_id) + max(CASE WHEN claim_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS claims,
       {_sum_sql('paid')} AS paid, {_sum_sql('incurred')} AS incurred, {_sum_sql('outstanding')} AS outstanding
FROM std GROUP BY 1, 2 ORDER BY ay DESC NULLS LAST, currency ASC NULLS LAST"""))
def q_ay_currency_pivot(spark, sf):
    """Accident year x currency totals."""
    return TR.ay_currency_pivot(std(spark, sf))


DEV_CTE = f"""dev AS (
  SELECT *, CAST(year(loss_date) AS BIGINT) AS ay, CAST({DEV_SQL} AS BIGINT) AS dev_mon
  FROM std WHERE loss_date IS NOT NULL AND report_date IS NOT NULL
)"""


def _wide_sql(value_expr: str, src: str, cast_to: str) -> str:
    cols = ", ".join(f"{cast_to.format(f'coalesce(sum(CASE WHEN dev_mon = {k} THEN {value_expr} END), 0)')} AS \"{k}\""
                     for k in range(K.MAX_DEV_MONTHS + 1))
    return f"SELECT ay, {cols} FROM {src} WHERE dev_mon <= {K.MAX_DEV_MONTHS} GROUP BY ay ORDER BY ay"


@register("triangle_counts", O.claims_with(
    _wide_sql("1", f"(SELECT DISTINCT claim_id, ay, dev_mon FROM dev WHERE NOT {O.blank('claim_id')})",
              "CAST({} AS BIGINT)"), more_ctes=DEV_CTE))
def q_triangle_counts(spark, sf):
    """Distinct claims by accident year x report lag (0..36), zero-filled."""
    return TR.triangle_counts(std(spark, sf))


@register("triangle_paid", O.claims_with(
    _wide_sql("coalesce(paid, 0)", "dev", "CAST(CAST({} AS " + O.SUM + ") AS DOUBLE)"), more_ctes=DEV_CTE))
def q_triangle_paid(spark, sf):
    """Paid by accident year x report lag."""
    return TR.triangle_amounts(std(spark, sf), "paid")


@register("triangle_incurred", O.claims_with(
    _wide_sql("coalesce(incurred, 0)", "dev", "CAST(CAST({} AS " + O.SUM + ") AS DOUBLE)"), more_ctes=DEV_CTE))
def q_triangle_incurred(spark, sf):
    """T4: incurred by accident year x report lag."""
    return TR.triangle_amounts(std(spark, sf), "incurred")


_LATE = f"dev_mon > {K.MAX_DEV_MONTHS}"


@register("triangle_beyond", O.claims_with(
    f"SELECT ay, count(*) FILTER (WHERE {_LATE}) AS n_rows, "
    f"count(DISTINCT CASE WHEN {_LATE} AND NOT {O.blank('claim_id')} THEN claim_id || '|' || dev_mon END) AS n_claims, "
    + ", ".join(f"{_sum_sql(f'CASE WHEN {_LATE} THEN {f} END')} AS {f}" for f in ("paid", "incurred"))
    + " FROM dev GROUP BY ay ORDER BY ay", more_ctes=DEV_CTE))
def q_triangle_beyond(spark, sf):
    """Rows, claims and amounts of each accident year beyond the triangles' last lag."""
    return TR.triangle_beyond(std(spark, sf))


_CUBE = ("count(*) AS rows, CAST(count(DISTINCT claim_id) + coalesce(max(CASE WHEN claim_id IS NULL THEN 1 ELSE 0 END), 0) AS BIGINT) AS claims, "
         + ", ".join(f"{_sum_sql(f)} AS {f}" for f in ("paid", "incurred", "outstanding")))


@register("claim_cube_totals", O.claims_with(" UNION ALL ".join(
    f"SELECT '{level}' AS level, {ay} AS ay, {ccy} AS currency, {_CUBE} FROM std{group}" for level, ay, ccy, group in (
        ("ay,currency", "CAST(year(loss_date) AS BIGINT)", "currency", " GROUP BY year(loss_date), currency"),
        ("ay", "CAST(year(loss_date) AS BIGINT)", "NULL", " GROUP BY year(loss_date)"),
        ("currency", "CAST(NULL AS BIGINT)", "currency", " GROUP BY currency"), ("all", "CAST(NULL AS BIGINT)", "NULL", "")))))
def q_claim_cube_totals(spark, sf):
    """Rows, distinct claims and amounts by year and currency, and all their totals, from one stored cube of bitmaps."""
    cube = CC.build_cube(std(spark, sf))
    parts = []
    for by in (("ay", "currency"), ("ay",), ("currency",), ()):
        own = [F.col(c) if c in by else F.lit(None).cast(kind).alias(c) for c, kind in (("ay", "long"), ("currency", "string"))]
        parts.append(CC.roll_up(cube, by).select(F.lit(",".join(by) or "all").alias("level"), *own, "rows", "claims", *CC.AMOUNTS))
    return S.union_files(parts)


@register("triangles_by_runs", O.claims_with(
    f"SELECT ay, dev_mon, count(DISTINCT CASE WHEN NOT {O.blank('claim_id')} THEN claim_id END) AS n_claims, {_sum_sql('paid')} AS paid, "
    f"{_sum_sql('incurred')} AS incurred FROM dev WHERE dev_mon <= {K.MAX_DEV_MONTHS} GROUP BY ay, dev_mon", more_ctes=DEV_CTE))
def q_triangles_by_runs(spark, sf):
    """The claims saved as three runs, the first of them incomplete and saved again, one run too many withdrawn; the stored
    triangles equal those of all claims."""
    s, root = std(spark, sf), stores.folder(spark, "triangle-store")
    TS.save_run(s.where("row_id % 6 = 0"), "run-0", root)
    for i in (1, 2):
        TS.save_run(s.where(F.col("row_id") % 3 == i), f"run-{i}", root)
    TS.save_run(s.where("row_id % 2 = 0"), "run-wrong", root)
    TS.save_run(s.where("row_id % 3 = 0"), "run-0", root)
    TS.withdraw_run(spark, "run-wrong", root)
    TS.compact(spark, root)
    out = TS.triangles_long(spark, root)
    return out.select(F.col("ay").cast("long").alias("ay"), F.col("dev_mon").cast("long").alias("dev_mon"), "n_claims", "paid", "incurred")


# ---------------------------------------------------------------------------
# Exports (X)
# ---------------------------------------------------------------------------

def _au(x: str) -> str:
    return f"strftime({x}, '%d/%m/%Y')"


def _r2(x: str) -> str:
    return dbl(f"CAST(round({x}, 2) AS DECIMAL(28,2))")


MASKED_POLICY_SQL = (f"CASE WHEN policy_number IS NULL OR policy_number = '' THEN policy_number "
                     f"ELSE {_hmac_sql('policy_number', FIXTURE_SALT)} END")
MASKED_CLAIMANT_SQL = "regexp_replace(claimant, '[A-Za-z]', 'x', 'g')"


@register("export_standard", O.claims_with(f"""
SELECT run_id, tenant_id, claim_id, {iso('loss_date')} AS loss_date, {iso('report_date')} AS report_date,
       {dbl('paid')} AS paid, {dbl('incurred')} AS incurred, {dbl('outstanding')} AS outstanding, currency,
       {MASKED_POLICY_SQL} AS policy_number, status, {MASKED_CLAIMANT_SQL} AS claimant_masked,
       source_file, CAST(source_page AS BIGINT) AS source_page FROM std"""))
def q_export_standard(spark, sf):
    """standard_csv layout (masked)."""
    return X.transform_export(std(spark, sf), "standard_csv", masked=True, salt=FIXTURE_SALT)


@register("export_ebix", O.claims_with(f"""
SELECT claim_id AS ClaimNumber, {_au('loss_date')} AS DateOfLoss, {_au('report_date')} AS DateReported,
       {_r2('paid')} AS Paid, {_r2('incurred')} AS Incurred, {_r2('outstanding')} AS Outstanding,
       currency AS Currency, {MASKED_POLICY_SQL} AS PolicyNumber, status AS Status,
       {MASKED_CLAIMANT_SQL} AS ClaimantMasked FROM std"""))
def q_export_ebix(spark, sf):
    """ebix_v1 layout (AU dates, 2-place amounts, masked)."""
    return X.transform_export(std(spark, sf), "ebix_v1", masked=True, salt=FIXTURE_SALT)


@register("export_lloyds", O.claims_with(f"""
SELECT claim_id AS Claim_Reference, {iso('loss_date')} AS Loss_Date, {iso('report_date')} AS Report_Date,
       {_r2('paid')} AS Paid_To_Date, {_r2('incurred')} AS Incurred_To_Date,
       {_r2('incurred - paid')} AS Outstanding_Reserves, currency AS Currency,
       {MASKED_POLICY_SQL} AS Policy_Number FROM std"""))
def q_export_lloyds(spark, sf):
    """lloyds_v5_2 layout (outstanding = incurred - paid)."""
    return X.transform_export(std(spark, sf), "lloyds_v5_2", masked=True, salt=FIXTURE_SALT)


@register("export_sunrise", O.claims_with(f"""
SELECT claim_id AS ClaimID, {_au('loss_date')} AS LossDate, {_au('report_date')} AS ReportDate,
       {_r2('paid')} AS Paid, {_r2('incurred')} AS Incurred, {_r2('outstanding')} AS OS, currency AS CCY,
       {MASKED_POLICY_SQL} AS PolicyNo FROM std"""))
def q_export_sunrise(spark, sf):
    """sunrise_basic layout."""
    return X.transform_export(std(spark, sf), "sunrise_basic", masked=True, salt=FIXTURE_SALT)


@register("export_unmasked", O.claims_with(f"""
SELECT run_id, tenant_id, claim_id, {iso('loss_date')} AS loss_date, {iso('report_date')} AS report_date,
       {dbl('paid')} AS paid, {dbl('incurred')} AS incurred, {dbl('outstanding')} AS outstanding, currency,
       policy_number, status, claimant, source_file, CAST(source_page AS BIGINT) AS source_page FROM std"""))
def q_export_unmasked(spark, sf):
    """The opt-in unmasked standard export."""
    return X.transform_export(std(spark, sf), "standard_csv", masked=False)


# ---------------------------------------------------------------------------
# History, retention, audit (H)
# ---------------------------------------------------------------------------

@register("run_headers", O.claims_with(f"""
SELECT {O.q(FIXTURE_RUN)} AS run_id, {O.q(FIXTURE_TENANT)} AS tenant_id, count(*) AS n_rows,
       CAST(count(DISTINCT claim_id) + max(CASE WHEN claim_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_claims,
       {_sum_sql('paid')} AS total_paid, {_sum_sql('incurred')} AS total_incurred FROM std"""))
def q_run_headers(spark, sf):
    """H1: the run header row (without its wall-clock time)."""
    return H.run_header(std(spark, sf), FIXTURE_RUN, FIXTURE_TENANT).drop("ts_utc")


@register("retention_prune", f"""
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, user_id, event_type
FROM events WHERE ts IS NULL OR ts >= (SELECT max(ts) FROM events) - INTERVAL {K.RETENTION_DAYS} DAYS""")
def q_retention_prune(spark, sf):
    """H3: audit rows kept by the 30-day retention as of the log's latest time."""
    ev = table(spark, sf, "events")
    as_of = ev.select(F.max("ts")).scalar()
    return H.retention_filter(ev, "ts", as_of).select("event_id", "ts", "user_id", "event_type")


@register("orphan_prune", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders
                     WHERE o_orderdate IS NULL
                        OR o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL {K.RETENTION_DAYS} DAYS)""")
def q_orphan_prune(spark, sf):
    """H3 + H4: runs (orders) pruned by age, then their orphaned issues
    (line items) dropped with a semi join."""
    od = table(spark, sf, "orders")
    kept = H.retention_filter(od, "o_orderdate", od.select(F.max("o_orderdate")).scalar())
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return H.orphan_filter(li, kept, "l_orderkey", "o_orderkey")


@register("audit_json", f"""
SELECT event_id, json_object('ts', strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), 'event', event_type,
                             'detail', json(props), 'app_version', {O.q(__version__)})::VARCHAR AS json
FROM events""")
def q_audit_json(spark, sf):
    """H6: each event as an audit JSON line."""
    ev = table(spark, sf, "events")
    return H.audit_records(ev, "ts", "event_type", "props", keep=["event_id"])


# ---------------------------------------------------------------------------
# Files, stores and documents: written from the claims and read back
# ---------------------------------------------------------------------------

for _name, _fn, _sql in stores.registered(std, _sum_sql, issues_sql, _hmac_sql):
    register(_name, _sql)(_fn)


def queries() -> dict[str, Query]:
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle() -> dict[str, str]:
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}
