"""DuckDB twins of the registered queries (the correctness oracle).

Each Spark query in ``plans.catalog`` has an independent SQL statement
here, written against the driver's pre-registered views. The claims
fixture and its standardisation are expressed once as SQL CTEs with the
same definitions as the Spark column expressions (DECIMAL money, the same
date patterns guarded by the same shapes), and every claims query is a
tail over those CTEs.
"""

from __future__ import annotations

from lossframe import constants as K
from lossframe.sources.fixtures import CCY_BY_NATION_MOD8, FIXTURE_FILE, FIXTURE_RUN, FIXTURE_TENANT

# Written out here, not imported from the library, so that a fault there cannot hide itself.
SEPARATORS = "[ ,./-]+"
ISO_TS_SHAPE = "^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}.*$"
NUMERIC_SHAPE = "^[0-9]+([.][0-9]+)?$"

MONEY = "DECIMAL(28,6)"
SUM = "DECIMAL(38,6)"
PRICE = "DECIMAL(18,2)"


def q(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def trim_ws(x: str) -> str:
    return f"regexp_replace({x}, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')"


def norm_id(x: str) -> str:
    return f"lower({trim_ws(f'CAST({x} AS VARCHAR)')})"


def blank(x: str) -> str:
    return f"({x} IS NULL OR {x} = '')"


def parse_date(x: str, locale: str = "AU") -> str:
    s = trim_ws(f"CAST({x} AS VARCHAR)")
    c = f"regexp_replace({s}, '{SEPARATORS}', '-', 'g')"
    day_first = locale == "AU"
    numeric = "%d-%m" if day_first else "%m-%d"
    named = ["%d-%b-%Y", "%d-%B-%Y"] if day_first else ["%b-%d-%Y", "%B-%d-%Y"]
    formats = [(f"{numeric}-%Y", "[0-9]{4}$"), ("%Y-%m-%d", "^[0-9]{4}-"), *[(f, "[A-Za-z]") for f in named],
               (f"{numeric}-%y", "^[0-9]{1,2}-[0-9]{1,2}-[0-9]{2}$")]
    tries = [f"CASE WHEN regexp_matches({s}, '{ISO_TS_SHAPE}') THEN CAST(TRY_CAST({s} AS TIMESTAMP) AS DATE) END"]
    tries += [f"CASE WHEN regexp_matches({c}, '{has}') THEN CAST(try_strptime({c}, '{fmt}') AS DATE) END"
              for fmt, has in formats]
    num = f"TRY_CAST({s} AS DOUBLE)"
    tries.append(f"CASE WHEN regexp_matches({s}, '{NUMERIC_SHAPE}') AND {num} > {K.EXCEL_SERIAL_MIN} "
                 f"AND {num} < {K.EXCEL_SERIAL_MAX} THEN DATE '{K.EXCEL_ORIGIN}' + CAST(floor({num}) AS INTEGER) END")
    return "coalesce(" + ", ".join(tries) + ")"


def clean_amount(x: str) -> str:
    """An amount in text: the sign is negative inside parentheses, the value is the digits and the point."""
    raw = f"CAST({x} AS VARCHAR)"
    number = f"TRY_CAST(array_to_string(regexp_extract_all(translate({raw}, '−', '-'), '[0-9.-]'), '') AS {MONEY})"
    in_parens = f"(trim({raw}) LIKE '(%' AND trim({raw}) LIKE '%)')"
    plain = f"coalesce(TRY_CAST(CASE WHEN {raw} ILIKE '%e%' THEN trim({raw}) END AS {MONEY}), {number})"
    return f"CAST(CASE WHEN {in_parens} THEN -abs({number}) ELSE {plain} END AS {MONEY})"


def money_text(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} < 0 THEN '(' || CAST(abs({x}) AS VARCHAR) || ')' "
            f"ELSE '$ ' || CAST({x} AS VARCHAR) END")


def _ccy_case() -> str:
    whens = " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(CCY_BY_NATION_MOD8))
    return f"CASE c.c_nationkey % 8 {whens} END"


RAW_CTE = f"""
amt AS (
  SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_returnflag, l.l_linestatus,
         CAST(l.l_shipdate AS DATE) AS ship_d, CAST(o.o_orderdate AS DATE) AS order_d,
         c.c_custkey, c.c_name, c.c_nationkey,
         CAST(CASE WHEN l.l_orderkey % 61 = 0 THEN NULL
                   WHEN l.l_orderkey % 53 = 0 THEN 0
                   WHEN l.l_orderkey % 11 = 0 AND l.l_returnflag = 'R' THEN -CAST(l.l_extendedprice AS {PRICE})
                   WHEN l.l_suppkey % 50 = 0 THEN CAST(l.l_extendedprice AS {PRICE}) * 5
                   ELSE CAST(l.l_extendedprice AS {PRICE}) END AS {PRICE}) AS paid_v,
         CAST(l.l_tax AS {PRICE}) AS tax_v, CAST(l.l_discount AS {PRICE}) AS disc_v,
         {_ccy_case()} AS ccy
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
),
amt2 AS (
  SELECT *, CAST(CASE WHEN l_partkey % 41 = 0 THEN paid_v * 3 ELSE paid_v * (1 + tax_v - disc_v) END AS {PRICE})
            AS inc_v
  FROM amt
),
raw AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
    concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS row_key,
    CASE WHEN l_orderkey % 97 = 0 THEN NULL WHEN l_orderkey % 89 = 0 THEN '' ELSE 'C-' || l_orderkey END AS claim_no,
    CASE WHEN l_orderkey % 71 = 0 THEN 'n/a'
         WHEN l_linenumber % 3 = 0 THEN strftime(order_d, '%Y-%m-%d')
         WHEN l_linenumber % 3 = 1 THEN strftime(order_d, '%d/%m/%Y')
         ELSE strftime(order_d, '%-d-%b-%Y') END AS date_of_loss,
    CASE WHEN l_orderkey % 73 = 0 THEN NULL ELSE strftime(ship_d, '%Y-%m-%d') END AS reported_date,
    {money_text('paid_v')} AS paid_amount,
    CASE WHEN l_orderkey % 67 = 0 THEN NULL ELSE {money_text('inc_v')} END AS total_incurred,
    {money_text(f"CAST(CASE WHEN l_linenumber = 5 THEN inc_v - paid_v + 1 WHEN l_linenumber = 6 THEN NULL ELSE inc_v - paid_v END AS {PRICE})")} AS case_reserve,
    ccy,
    CASE WHEN c_custkey % 83 = 0 THEN NULL ELSE 'POL-' || c_custkey END AS policy_no,
    l_linestatus AS claim_status,
    CASE WHEN c_custkey % 79 = 0 THEN NULL ELSE c_name END AS insured_name,
    l_returnflag
  FROM amt2
)"""


def std_select(locale: str = "AU", raw: str = "raw", extra: str = "") -> str:
    p, i, o = clean_amount("paid_amount"), clean_amount("total_incurred"), clean_amount("case_reserve")
    return f"""
  SELECT CAST(row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber) AS BIGINT) AS row_id,
    CAST(claim_no AS VARCHAR) AS claim_id,
    {parse_date('date_of_loss', locale)} AS loss_date,
    {parse_date('reported_date', locale)} AS report_date,
    {p} AS paid,
    CAST(CASE WHEN {i} IS NULL AND {p} IS NOT NULL AND {o} IS NOT NULL THEN {p} + {o} ELSE {i} END AS {MONEY})
      AS incurred,
    {o} AS outstanding,
    upper({trim_ws('CAST(ccy AS VARCHAR)')}) AS currency,
    CAST(policy_no AS VARCHAR) AS policy_number,
    CAST(claim_status AS VARCHAR) AS status,
    CAST(insured_name AS VARCHAR) AS claimant,
    {q(FIXTURE_FILE)} AS source_file,
    CAST(NULL AS INTEGER) AS source_page,
    {q(FIXTURE_TENANT)} AS tenant_id,
    {q(FIXTURE_RUN)} AS run_id{extra}
  FROM {raw}"""


def claims_with(tail: str, locale: str = "AU", extra: str = "", more_ctes: str = "") -> str:
    """``WITH <fixture>, std AS (...) [, more] <tail>``."""
    ctes = RAW_CTE + ",\nstd AS (" + std_select(locale, extra=extra) + "\n)"
    if more_ctes:
        ctes += ",\n" + more_ctes
    return "WITH " + ctes + "\n" + tail
