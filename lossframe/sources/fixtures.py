"""Claims fixture: a bordereau-shaped raw view over the driver tables.

``lineitem ⋈ orders ⋈ customer`` becomes one raw loss-run row per line
item, with deliberately non-standard headers, mixed date spellings,
money as text with ``$`` and parentheses, and seeded gaps, so every
mapping, cleaning and validation path gets real work. The recipe is a
fixed definition (documented in FIXTURES.md §3), mirrored in DuckDB SQL by
``lossframe.plans.oracle``.

Both joins are plain equi-joins left to the optimizer. Orders meet their
customers first, so the line items, by far the most rows, are shuffled once
for the joins; adaptive execution switches the customer side to a broadcast at
runtime only when its measured size is under the broadcast threshold.

What is stored and sorted are the joined numbers; the texts of the raw view
are a projection of them, built where they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lossframe.operators.mapping import guess_schema
from lossframe.operators.numbering import number_stored
from lossframe.operators.standardize import standardize
from lossframe.session import persist_table

FIXTURE_TENANT = "demo-tenant"
FIXTURE_RUN = "run-fixture"
FIXTURE_FILE = "loss_run.csv"
ORDER_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
PRICE = "decimal(18,2)"

# Fixed values of the fixture recipe: nationkey % 8 -> currency text.
CCY_BY_NATION_MOD8 = ["AUD", "usd", " NZD ", "GBP", "EUR", "XXX", "", None]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _money_text(x: Column) -> Column:
    """Negative -> '(abs)', else '$ value'."""
    return (F.when(x.isNull(), F.lit(None))
            .when(x < 0, F.concat(F.lit("("), F.abs(x).cast("string"), F.lit(")")))
            .otherwise(F.concat(F.lit("$ "), x.cast("string"))))


def claims_joined(spark: SparkSession, sf_dir: str, ordered: bool = False) -> DataFrame:
    """What ``raw_texts`` reads, one row a line item: keys, amounts, dates without their time, and columns of the three tables.

    ``ordered``: in the order of the keys. The joined numbers are sorted, the amounts are built after it."""
    li = table(spark, sf_dir, "lineitem").select(
        *ORDER_KEYS, "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", F.to_date("l_shipdate").alias("_shipped"))
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("_ordered"))
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    # merged whatever their size: line items of equal keys stay in the order of their file, which the build side of a hash join does not keep
    of = od.join(cu, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey").hint("merge")
    money = [F.col(c).cast(PRICE).alias(c) for c in ("l_extendedprice", "l_discount", "l_tax")]
    j = li.join(of, F.col("l_orderkey") == F.col("o_orderkey")).select(
        *ORDER_KEYS, *money, "l_returnflag", "l_linestatus", "_shipped", "_ordered", "c_custkey", "c_name", "c_nationkey")
    if ordered:
        n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        j = j.repartitionByRange(n, *ORDER_KEYS).sortWithinPartitions(*ORDER_KEYS)
    ok, pk, sk, ln = (F.col(c) for c in ORDER_KEYS)
    # a column for each amount, so that none is computed again for every place it is used in
    price, paid, incurred = (F.col(f"_{c}") for c in ("price", "paid", "incurred"))
    j = j.select("*", F.col("l_extendedprice").alias("_price"), (1 + F.col("l_tax") - F.col("l_discount")).alias("_factor"))
    j = j.select("*", (F.when(ok % 61 == 0, F.lit(None))
                       .when(ok % 53 == 0, F.lit(0))
                       .when((ok % 11 == 0) & (F.col("l_returnflag") == "R"), -price)
                       .when(sk % 50 == 0, price * 5)
                       .otherwise(price)).cast(PRICE).alias("_paid"))
    j = j.select("*", F.when(pk % 41 == 0, paid * 3).otherwise(paid * F.col("_factor")).cast(PRICE).alias("_incurred"))
    j = j.select("*", (F.when(ln == 5, incurred - paid + 1)
                       .when(ln == 6, F.lit(None))
                       .otherwise(incurred - paid)).cast(PRICE).alias("_reserve"))
    return j.drop("l_extendedprice", "l_discount", "l_tax", "_price", "_factor")


def claims_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw loss-run rows (all text) plus the four ordering keys."""
    return raw_texts(claims_joined(spark, sf_dir))


def raw_texts(j: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The raw view of ``claims_joined``, and its columns ``keep``."""
    ok, pk, sk, ln = (F.col(c) for c in ORDER_KEYS)
    ck = F.col("c_custkey")
    paid, incurred, reserve = (F.col(f"_{c}") for c in ("paid", "incurred", "reserve"))
    odate = F.col("_ordered")
    loss_text = (F.when(ok % 71 == 0, F.lit("n/a"))
                 .when(ln % 3 == 0, F.date_format(odate, "yyyy-MM-dd"))
                 .when(ln % 3 == 1, F.date_format(odate, "dd/MM/yyyy"))
                 .otherwise(F.date_format(odate, "d-MMM-yyyy")))
    nk8 = F.col("c_nationkey") % 8
    ccy = F.lit(None).cast("string")
    for i in range(len(CCY_BY_NATION_MOD8) - 1, -1, -1):
        v = CCY_BY_NATION_MOD8[i]
        ccy = F.when(nk8 == i, F.lit(v).cast("string")).otherwise(ccy)
    return j.select(
        *ORDER_KEYS,
        F.concat_ws("-", ok, pk, sk, ln).alias("row_key"),
        (F.when(ok % 97 == 0, F.lit(None)).when(ok % 89 == 0, F.lit(""))
         .otherwise(F.concat(F.lit("C-"), ok.cast("string")))).alias("claim_no"),
        loss_text.alias("date_of_loss"),
        F.when(ok % 73 == 0, F.lit(None)).otherwise(F.date_format("_shipped", "yyyy-MM-dd"))
        .alias("reported_date"),
        _money_text(paid).alias("paid_amount"),
        F.when(ok % 67 == 0, F.lit(None)).otherwise(_money_text(incurred)).alias("total_incurred"),
        _money_text(reserve).alias("case_reserve"),
        ccy.alias("ccy"),
        F.when(ck % 83 == 0, F.lit(None)).otherwise(F.concat(F.lit("POL-"), ck.cast("string"))).alias("policy_no"),
        F.col("l_linestatus").alias("claim_status"),
        F.when(ck % 79 == 0, F.lit(None)).otherwise(F.col("c_name")).alias("insured_name"),
        "l_returnflag", *keep,
    )


RAW_HEADERS = ["row_key", "claim_no", "date_of_loss", "reported_date", "paid_amount", "total_incurred",
               "case_reserve", "ccy", "policy_no", "claim_status", "insured_name"]


_PERSISTED: dict = {}


def claims_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joined numbers written once per session, in row order (the uploaded 'file' as stored)."""
    key = ("raw", *_session_key(spark, sf_dir))
    if key not in _PERSISTED:
        _PERSISTED[key] = persist_table(claims_joined(spark, sf_dir, ordered=True), "raw")
    return _PERSISTED[key]


def claims_raw_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw view in row order, over the stored numbers."""
    return raw_texts(claims_stored(spark, sf_dir))


def _session_key(spark: SparkSession, sf_dir: str) -> tuple:
    """Application, folder, and the state of its tables' files: changed input is stored anew."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    state = []
    for name in ("lineitem", "orders", "customer"):
        p = hadoop.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
        s = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p)
        state += [s.getModificationTime(), s.getLen()]
    return (spark.sparkContext.applicationId, sf_dir.rstrip("/"), *state)


def claims_std(spark: SparkSession, sf_dir: str, locale: str = "AU", numbered: bool = True,
               run_id: str = FIXTURE_RUN, tenant_id: str = FIXTURE_TENANT,
               keep_raw: tuple[str, ...] = (), persisted: bool = True) -> DataFrame:
    """Standardised claims with ``row_id`` (file order = order keys) and ``run_id``.

    The standardised table is written once per session (``persist_table``
    in the checkpoint folder) and every later query scans it, as a real run
    reads its persisted standard table; ``persisted=False`` returns the
    lazy plan instead.
    """
    key = (*_session_key(spark, sf_dir), locale, numbered, run_id, tenant_id,
           tuple(keep_raw))
    if persisted and key in _PERSISTED:
        return _PERSISTED[key]
    mapping = guess_schema(RAW_HEADERS)
    if not numbered:
        std = standardize(claims_raw_table(spark, sf_dir) if persisted else claims_raw(spark, sf_dir), mapping,
                          locale=locale, source_file=FIXTURE_FILE, tenant_id=tenant_id, run_id=run_id,
                          keep=list(keep_raw))
        if persisted:
            std = persist_table(std, "std")
            _PERSISTED[key] = std
        return std
    # The stored rows have their order: number them at the scan and
    # standardise once into the stored table. No further copy.
    keep = ["row_id"] + [c for c in keep_raw if c != "row_id"]
    raw = raw_texts(number_stored(claims_stored(spark, sf_dir)), keep=("row_id",))
    std = standardize(raw, mapping, locale=locale, source_file=FIXTURE_FILE, tenant_id=tenant_id,
                      run_id=run_id, keep=keep)
    if not persisted:
        return std
    std = persist_table(std, "std")
    _PERSISTED[key] = std
    return std
