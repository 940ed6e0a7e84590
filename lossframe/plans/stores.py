"""Queries over what the library writes: CSV and Parquet sinks, exports, run history, mapping store, audit log.

Each writes the claims of the given tables (or what follows from them) into a
folder of its own under the checkpoint folder and returns what it reads back.
"""

from __future__ import annotations

import hashlib
import hmac
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lossframe import __version__
from lossframe import constants as K
from lossframe.functions.amounts import format_num
from lossframe.functions.names import norm_id
from lossframe.functions.privacy import choose_salt, mask_policy
from lossframe.operators import exports as X
from lossframe.operators import history as H
from lossframe.operators import mapping as M
from lossframe.operators import quality as Q
from lossframe.operators import rules as V
from lossframe.operators import versions
from lossframe.plans import claims_run as R
from lossframe.plans import oracle_sql as O
from lossframe.session import checkpoint_dir
from lossframe.sources import csv_intake as I
from lossframe.sources import files as S
from lossframe.sources import layout as L
from lossframe.sources.fixtures import FIXTURE_TENANT, table
from lossframe.streaming import claim_keys, ingest

MASTER_KEY = "fixture-master-key"
AS_OF = datetime(2024, 3, 10)
RUN_TIMES = {"run-old": datetime(2024, 1, 1), "run-new": datetime(2024, 3, 1), "run-edge": datetime(2024, 2, 9)}


def folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/lossframe-queries/{name}-{uuid.uuid4().hex}"


#: Customer keys of one layout document.
BLOCK_KEYS = 500


def nation_blocks(cu: DataFrame) -> DataFrame:
    """c_nationkey, c_custkey's block and doc_id, made of both, of every customer."""
    block = F.expr(f"c_custkey div {BLOCK_KEYS}")
    return cu.withColumn("block", block).withColumn("doc_id", F.concat_ws("-", "c_nationkey", "block"))


def nation_documents(cu: DataFrame) -> DataFrame:
    """doc_id, json: layout documents of at most ``BLOCK_KEYS`` customers of one nation, as a table of one or two columns."""
    cells = F.array_sort(F.collect_list(F.struct("c_custkey", "c_name", "c_mktsegment")))
    per = nation_blocks(cu).groupBy("doc_id", "c_nationkey").agg(cells.alias("r"))  # bounded by the block

    def column(i: int, field: str):
        return F.transform("r", lambda x, k: F.struct(k.alias("rowIndex"), F.lit(i).alias("columnIndex"),
                                                      x[field].alias("content")))

    wide = F.col("c_nationkey") % 2 == 0
    doc = F.struct(F.struct(F.array(F.struct(
        F.size("r").alias("rowCount"), F.when(wide, 2).otherwise(1).alias("columnCount"),
        F.when(wide, F.concat(column(0, "c_name"), column(1, "c_mktsegment"))).otherwise(column(0, "c_name")).alias("cells")
    )).alias("tables")).alias("analyzeResult"))
    return per.select("doc_id", F.to_json(doc).alias("json"))


def spanned_documents(cu: DataFrame) -> DataFrame:
    """doc_id, json: tables of four columns and two rows for each of a block's customers, and two blank rows at the end.

    One cell reaches over the whole first column and far beyond the table, each name stands in the upper one of its rows, a segment of an
    even key spans two rows and two columns; documents of odd nations end with a cell over everything.
    """
    cells = F.array_sort(F.collect_list(F.struct("c_custkey", "c_name", "c_mktsegment")))
    per = nation_blocks(cu).groupBy("doc_id", "c_nationkey").agg(cells.alias("r"))  # bounded by the block

    def cell(row, column, text, rows, columns):
        return F.struct(row.cast("int").alias("rowIndex"), F.lit(column).alias("columnIndex"), text.alias("content"),
                        rows.cast("int").alias("rowSpan"), columns.cast("int").alias("columnSpan"))

    one, two, far = F.lit(1), F.lit(2), F.lit(2_000_000_000)
    names = F.transform("r", lambda x, k: cell(2 * k, 1, x["c_name"], one, one))
    even = F.transform(F.filter(F.transform("r", lambda x, k: F.struct(x.alias("x"), k.alias("k"))), lambda p: p["x"]["c_custkey"] % 2 == 0),
                       lambda p: cell(2 * p["k"], 2, p["x"]["c_mktsegment"], two, two))
    first = F.array(cell(F.lit(0), 0, F.concat(F.lit("nation "), "c_nationkey"), far, one))
    last = F.when(F.col("c_nationkey") % 2 == 1, F.array(cell(F.lit(0), 0, F.lit("late"), far, far))).otherwise(F.slice(first, F.lit(1), F.lit(0)))
    doc = F.struct(F.struct(F.array(F.struct((2 * F.size("r") + 2).alias("rowCount"), F.lit(4).alias("columnCount"),
                                             F.concat(first, names, even, last).alias("cells"))).alias("tables")).alias("analyzeResult"))
    return per.select("doc_id", F.to_json(doc).alias("json"))


LAYOUT_SPANS = f"""
WITH c AS (
  SELECT concat(c_nationkey, '-', c_custkey // {BLOCK_KEYS}) AS doc_id, c_nationkey, c_custkey, c_name, c_mktsegment,
         row_number() OVER (PARTITION BY c_nationkey, c_custkey // {BLOCK_KEYS} ORDER BY c_custkey) - 1 AS k FROM customer),
grid AS (
  SELECT doc_id, c_nationkey, unnest(range(2 * count(*) + 2)) AS row_no FROM c GROUP BY doc_id, c_nationkey),
spot AS (
  SELECT g.doc_id, CAST(g.row_no AS INTEGER) AS row_no, g.c_nationkey, c.c_name, c.c_custkey, c.c_mktsegment,
         CASE WHEN g.c_nationkey % 2 = 1 THEN 'late' ELSE '' END AS rest
  FROM grid g LEFT JOIN c ON c.doc_id = g.doc_id AND c.k = g.row_no // 2)
SELECT doc_id, row_no, 'nation ' || c_nationkey AS V1,
       CASE WHEN row_no % 2 = 0 AND c_name IS NOT NULL THEN c_name ELSE rest END AS V2,
       CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE rest END AS V3,
       CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE rest END AS V4
FROM spot"""


def registered(std: Callable, sum_sql: Callable, issues_sql: Callable, hmac_sql: Callable) -> list[tuple]:
    """(name, query, DuckDB statement) of every query here."""
    zero_issues = ["rule_zero_rows"]

    def tricky(s: DataFrame, *more) -> DataFrame:
        """Claimant texts with commas, quotes and line breaks, and ``more`` columns."""
        name = F.concat("claimant", F.lit(', "'), F.coalesce("claim_id", F.lit("none")), F.lit('"\n'), "status")
        return s.select(F.col("row_id").cast("string").alias("row_id"), "claim_id", name.alias("claimant"), *more)

    tricky_sql = ("SELECT CAST(row_id AS VARCHAR) AS row_id, nullif(claim_id, '') AS claim_id, "
                  "claimant || ', \"' || coalesce(claim_id, 'none') || '\"' || chr(10) || status AS claimant FROM std")

    def csv_round_trip(spark, sf):
        """X5 then S1: quoted commas, doubled quotes and line breaks survive."""
        path = folder(spark, "csv")
        X.write_csv(tricky(std(spark, sf)), path)
        return S.read_csv(spark, path, with_lineage=False)

    def csv_two_headers(spark, sf):
        """S1 + S2: files whose headers name the same columns in another order, and one column more."""
        s, path = std(spark, sf), folder(spark, "headers")
        rows = s.select(F.col("row_id").cast("string").alias("row_id"), "claim_id", F.col("paid").cast("string").alias("paid"),
                        "currency")
        X.write_csv(rows.where("row_id % 2 = 0").select("row_id", "claim_id", "paid"), f"{path}/a")
        X.write_csv(rows.where("row_id % 2 = 1").select("paid", "currency", "row_id", "claim_id"), f"{path}/b")
        return S.read_csv(spark, [f"{path}/a", f"{path}/b"], with_lineage=False)

    def csv_rejects(spark, sf):
        """Every seventh record has a cell more than its header; rows read and records rejected, together all records."""
        s, path = std(spark, sf), folder(spark, "ragged")
        line = F.concat_ws(",", "row_id", F.coalesce("claim_id", F.lit("")), F.coalesce(F.col("paid").cast("string"), F.lit("")),
                           F.when(F.col("row_id") % 7 == 0, F.coalesce("currency", F.lit(""))))
        (s.select(line.alias("row_id,claim_id,paid")).write.option("header", True).option("sep", "\u0001").option("quote", "\u0000")
         .csv(path))  # one column of whole lines, so that they can be of unequal length
        read = S.read_csv(spark, path, with_lineage=False).select("row_id", "claim_id", "paid", F.lit(None).cast("string").alias("reason"))
        cells = F.split("record", ",")
        rejected = I.csv_rejects(spark, path).select(cells[0].alias("row_id"), F.nullif(cells[1], F.lit("")).alias("claim_id"),
                                                     F.nullif(cells[2], F.lit("")).alias("paid"), "reason")
        return read.unionByName(rejected)

    def csv_dialects(spark, sf):
        """The same claims in files of four delimiters and two quotes, decimal commas and quoted line breaks in the cells."""
        s, path = std(spark, sf), folder(spark, "dialects")
        rows = tricky(s, F.replace(F.col("paid").cast("string"), F.lit("."), F.lit(",")).alias("paid"))
        kinds = [(",", '"'), (";", '"'), ("\t", "'"), ("|", '"')]
        for i, (sep, quote) in enumerate(kinds):
            (rows.where(F.col("row_id").cast("long") % len(kinds) == i).write.option("header", True).option("sep", sep).option("quote", quote)
             .option("escape", quote).option("quoteAll", True).option("emptyValue", "").csv(f"{path}/{i}"))
        return S.read_csv(spark, [f"{path}/{i}" for i in range(len(kinds))], with_lineage=False)

    def header_promotion(spark, sf):
        """A header row in each of two files, with different names."""
        s = std(spark, sf).select(F.col("row_id").alias("line"), F.col("status").alias("file"), F.col("claim_id").alias("c1"),
                                  F.col("paid").cast("string").alias("c2"), F.col("currency").alias("c3"))
        heads = (s.select("file").distinct().select(
            F.lit(0).cast("long").alias("line"), "file", F.lit("Claim No").alias("c1"),
            F.when(F.col("file") == "O", "Paid").otherwise("Amount").alias("c2"), F.lit("Curr").alias("c3")))
        out = S.promote_header(s.unionByName(heads), True, "line", "file")
        return out.select("line", "file", F.col("`Claim.No`").alias("claim_no"), F.col("Paid").alias("paid"),
                          F.col("Amount").alias("amount"), F.col("Curr").alias("curr"))

    def layout_tables(spark, sf):
        """Layout documents of a nation's customers, block by block; rows are numbered through the nation's blocks."""
        cu = table(spark, sf, "customer")
        sizes = nation_blocks(cu).groupBy("doc_id", "c_nationkey", "block").agg(F.count(F.lit(1)).alias("n"))
        before = Window.partitionBy("c_nationkey").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.select("doc_id", F.col("c_nationkey").cast("long").alias("nation"),
                              F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
        return (L.layout_tables(nation_documents(cu)).join(starts, "doc_id")
                .select(F.col("nation").alias("doc_id"), (F.col("start") + F.col("row_no")).alias("row_no"), "V1", "V2"))

    def layout_spans(spark, sf):
        """Cells over several rows and columns, beyond the table's edge and over each other, and blank rows."""
        docs = spanned_documents(table(spark, sf, "customer"))
        return L.layout_tables(docs).select("doc_id", "row_no", "V1", "V2", "V3", "V4")

    def streamed_claim_issues(spark, sf):
        """V8 + V18 with keyed state: the claims land in three files, in two rounds; both streams run after each. Issues counted by
        normalised claim id (which spelling is first depends on the order of the lines)."""
        s, path = std(spark, sf), folder(spark, "stream")
        rows = s.select("row_id", F.col("claim_id").alias("claim"), F.col("loss_date").cast("string").alias("lost"))
        for i, part in enumerate(("row_id % 3 = 0", "row_id % 3 = 1", "row_id % 3 = 2")):
            X.write_csv(rows.where(part).drop("row_id"), f"{path}/land/{i}")
            if i:
                ingest.start(spark, f"{path}/land/*", ["claim", "lost"], {"claim_id": "claim", "loss_date": "lost"}, f"{path}/issues",
                             f"{path}/ck-intake", V.RuleConfig.only("rule_required_fields"), rows_path=f"{path}/rows").awaitTermination()
                claim_keys.start(spark, f"{path}/rows", f"{path}/sets", f"{path}/ck-keys").awaitTermination()
        return (claim_keys.set_issues(spark, f"{path}/sets").groupBy(norm_id(F.col("claim_id")).alias("claim"), "issue", "detail")
                .agg(F.count(F.lit(1)).alias("n_rows")))

    def run_issues(spark, sf):
        """H2: a run saved with issues, then again without; another one keeps its own."""
        s, root = std(spark, sf), folder(spark, "runs")
        found = V.validate(s, V.RuleConfig.only("rule_zero_rows"))
        for run in ("run-a", "run-b"):
            H.save_run(H.run_header(s, run, FIXTURE_TENANT), found, root)
        H.save_run(H.run_header(s, "run-a", FIXTURE_TENANT), found.limit(0), root)
        return H.read_table(spark, root, "issues", H.ISSUES_SCHEMA)

    def saved_runs(spark, sf, name):
        s, root = std(spark, sf), folder(spark, name)
        found = V.validate(s, V.RuleConfig.only("rule_zero_rows"))
        for run, ts in RUN_TIMES.items():
            H.save_run(H.run_header(s, run, FIXTURE_TENANT, F.lit(ts)), found, root)
        return root

    def history_prune(spark, sf):
        """H3 + H4: expired runs and their issues go, the others stay."""
        root = saved_runs(spark, sf, "prune")
        H.prune(spark, root, AS_OF)
        runs = H.read_table(spark, root, "runs", H.RUNS_SCHEMA)
        issues = H.read_table(spark, root, "issues", H.ISSUES_SCHEMA).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_issues"))
        return runs.join(issues, "run_id", "full").select("run_id", "n_rows", F.coalesce("n_issues", F.lit(0)).alias("n_issues"))

    def delete_all(spark, sf):
        """H5: every stored table is empty afterwards, and still readable."""
        root = saved_runs(spark, sf, "delete")
        H.append_audit(spark, root, "run_completed", {"n_rows": std(spark, sf).count()})
        H.delete_all(spark, root, confirm=True)
        tables = [("runs", H.RUNS_SCHEMA), ("issues", H.ISSUES_SCHEMA), ("audit_log", H.AUDIT_SCHEMA),
                  ("saved_mappings", M.MAPPING_STORE_SCHEMA)]
        counts = [H.read_table(spark, root, n, sch).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n, sch in tables]
        return S.union_files(counts)

    def audit_log_store(spark, sf):
        """H3 + H6: the events as an audit log, appended in three commits, pruned ten days after the last one, and read back."""
        root, ev = folder(spark, "audit"), table(spark, sf, "events")
        rows = ev.select("event_id", F.col("ts").alias("ts_utc"), F.col("event_type").alias("event"), F.col("props").alias("detail_json"),
                         F.lit(__version__).alias("app_version"))
        for i in range(3):
            versions.append(spark, f"{root}/audit_log", H.AUDIT_SCHEMA, rows.where(F.pmod("event_id", F.lit(3)) == i))
        last = ev.select(F.max("ts").cast("string")).first()[0]
        H.prune(spark, root, F.to_timestamp(F.lit(last)) + F.expr("INTERVAL 10 DAYS"))
        return (H.read_table(spark, root, "audit_log", H.AUDIT_SCHEMA).groupBy("ts_utc", "event", "detail_json")
                .agg(F.count(F.lit(1)).alias("n")))

    def mapping_store(spark, sf):
        """M5: two stored upserts; the newest mapping of each key wins."""
        root = folder(spark, "mappings")
        ev = table(spark, sf, "events")
        rows = ev.groupBy((F.col("user_id") % 10).cast("string").alias("tenant_id"), F.col("event_type").alias("counterparty"),
                          F.col("ts").alias("ts_utc")).agg(F.max("props").alias("mapping_json"))
        M.store_mappings(spark, root, rows.where("day(ts_utc) % 2 = 0"))
        M.store_mappings(spark, root, rows.where("day(ts_utc) % 2 = 1"))
        return H.read_table(spark, root, "saved_mappings", M.MAPPING_STORE_SCHEMA)

    def mapping_lookup(spark, sf):
        """M4 + M6: a mapping saved as JSON for each event type, looked up for the first one."""
        root = folder(spark, "lookup")
        kinds = table(spark, sf, "events").where("event_type IS NOT NULL").groupBy(F.col("event_type").alias("counterparty")).agg(
            F.lit("t1").alias("tenant_id"), F.lit(AS_OF).alias("ts_utc"))
        source = {"claim_id": F.concat("counterparty", F.lit(" no")), "paid": F.lit("Paid")}
        saved = F.to_json(F.struct(*[source.get(f, F.lit("")).alias(f) for f in K.STANDARD_FIELDS]))
        M.store_mappings(spark, root, kinds.withColumn("mapping_json", saved))
        store = H.read_table(spark, root, "saved_mappings", M.MAPPING_STORE_SCHEMA)
        found = M.load_mapping(store, "t1", store.agg(F.min("counterparty")).first()[0])
        return spark.createDataFrame(list(found.items()), "field string, source string")

    def salt_choice(spark, sf):
        """policies masked with the salt derived from a master key and the tenant."""
        salt = choose_salt(master_key=MASTER_KEY, tenant_id=FIXTURE_TENANT)
        return std(spark, sf).select("row_id", mask_policy(F.col("policy_number"), salt.value).alias("policy_hash"),
                                     F.lit(salt.source).alias("salt_source"))

    derived = "v1|" + hmac.new(MASTER_KEY.encode(), FIXTURE_TENANT.encode(), hashlib.sha256).hexdigest()
    long_key = hashlib.sha256(derived.encode()).digest() if len(derived) > 64 else derived.encode()

    def salt_sql() -> str:
        block = long_key.ljust(64, b"\0")
        ipad, opad = (bytes(x ^ pad for x in block) for pad in (0x36, 0x5C))
        inner = f"unhex(sha256(unhex('{ipad.hex()}') || encode(policy_number)))"
        return (f"SELECT row_id, CASE WHEN policy_number IS NULL OR policy_number = '' THEN policy_number "
                f"ELSE sha256(unhex('{opad.hex()}') || {inner}) END AS policy_hash, 'tenant' AS salt_source FROM std")

    def format_numbers(spark, sf):
        """amounts as display text."""
        return std(spark, sf).select("row_id", format_num(F.col("paid")).alias("shown"))

    def parquet_sink(spark, sf):
        """The claims as Parquet, partitioned by status, read back."""
        path = folder(spark, "parquet")
        s = std(spark, sf).select("row_id", "claim_id", F.col("paid").cast("double").alias("paid"), "status")
        X.write_parquet(s, path, partition_by=["status"])
        return spark.read.schema(s.schema).parquet(path)

    def bundle(spark, sf):
        """The tables of a bundle, with their rows."""
        s, path = std(spark, sf), folder(spark, "bundle")
        tables = {"clean": X.transform_export(s, "ebix_v1", masked=True, salt="s"),
                  "issues": V.validate(s, V.RuleConfig.only(*zero_issues)).drop("rule_order")}
        out = X.write_bundle(path, tables, "{}")
        return S.union_files([spark.read.parquet(out[n]).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n"))
                              for n in tables])

    def summary_document(spark, sf):
        """The summary document written and parsed again."""
        s, path = std(spark, sf), folder(spark, "summary")
        totals = Q.row_aggregates(s).select("n_rows", "total_paid", "neg_paid_n").first().asDict()
        X.write_bundle(path, {"metrics": spark.createDataFrame([(1,)], "n long")},
                       X.summary_json("run-1", {"n_rows": totals["n_rows"]}, totals, "ebix_v1"))
        text = spark.read.text(f"{path}/summary_json", wholetext=True)
        get = lambda p: F.get_json_object("value", p)
        return text.select(get("$.run_id").alias("run_id"), get("$.metrics.n_rows").cast("long").alias("n_rows"),
                           get("$.Q.total_paid").cast("double").alias("total_paid"),
                           get("$.Q.neg_paid_n").cast("long").alias("neg_paid_n"), get("$.export_format").alias("export_format"))

    def audited_run(spark, sf):
        """CSV files of the claims through intake, run and save, with their audit events."""
        s, root, path = std(spark, sf), folder(spark, "audited"), folder(spark, "landing")
        raw = s.select(F.col("claim_id").alias("Claim No"), F.col("loss_date").cast("string").alias("Date of Loss"),
                       F.col("paid").cast("string").alias("Paid"), F.col("currency").alias("Curr"))
        X.write_csv(raw, path)
        cfg = V.RuleConfig.only("rule_missing_currency")
        R.process(spark, path, root, cfg, tenant_id=FIXTURE_TENANT, run_id="run-x")
        events = H.read_table(spark, root, "audit_log", H.AUDIT_SCHEMA)
        get = lambda p: F.get_json_object("detail_json", p)
        stored = H.read_table(spark, root, "issues", H.ISSUES_SCHEMA).select(F.count(F.lit(1))).scalar()
        return events.select("event", get("$.run_id").alias("run_id"), get("$.files[0]").alias("file"),
                             get("$.n_rows").cast("long").alias("n_rows"), stored.alias("n_issues"))

    kept = [r for r, t in RUN_TIMES.items() if (AS_OF - t).days <= K.RETENTION_DAYS]
    zero = "paid = 0 AND incurred = 0"
    mapped = "CAST(user_id % 10 AS VARCHAR) AS tenant_id, event_type AS counterparty"
    fields = ", ".join(f"('{f}', " + {"claim_id": "(SELECT min(event_type) FROM events) || ' no'", "paid": "'Paid'"}.get(f, "''") + ")"
                       for f in K.STANDARD_FIELDS)
    return [
        ("csv_round_trip", csv_round_trip, O.claims_with(tricky_sql)),
        ("csv_two_headers", csv_two_headers, O.claims_with(
            "SELECT CAST(row_id AS VARCHAR) AS row_id, nullif(claim_id, '') AS claim_id, CAST(paid AS VARCHAR) AS paid, "
            "CASE WHEN row_id % 2 = 1 THEN nullif(currency, '') END AS currency FROM std")),
        ("csv_rejects", csv_rejects, O.claims_with(
            "SELECT CAST(row_id AS VARCHAR) AS row_id, nullif(claim_id, '') AS claim_id, CAST(paid AS VARCHAR) AS paid, "
            "CASE WHEN row_id % 7 = 0 THEN '4 cells under a header of 3' END AS reason FROM std")),
        ("csv_dialects", csv_dialects, O.claims_with(
            "SELECT t.*, replace(CAST(s.paid AS VARCHAR), '.', ',') AS paid FROM (" + tricky_sql + ") t "
            "JOIN std s ON t.row_id = CAST(s.row_id AS VARCHAR)")),
        ("header_promotion", header_promotion, O.claims_with(
            "SELECT row_id AS line, status AS file, claim_id AS claim_no, CASE WHEN status = 'O' THEN CAST(paid AS VARCHAR) END "
            "AS paid, CASE WHEN status <> 'O' THEN CAST(paid AS VARCHAR) END AS amount, currency AS curr FROM std")),
        ("layout_tables", layout_tables, """
SELECT CAST(c_nationkey AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS BIGINT)
         AS row_no, c_name AS V1, CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment END AS V2 FROM customer"""),
        ("layout_spans", layout_spans, LAYOUT_SPANS),
        ("streamed_claim_issues", streamed_claim_issues, O.claims_with(
            f"SELECT claim, {O.q(K.ISSUE_DUPLICATE)} AS issue, {O.q(K.DETAIL_DUPLICATE)} AS detail, CAST(sum(n - 1) AS BIGINT) AS n_rows "
            "FROM (SELECT claim, count(*) AS n FROM landed GROUP BY claim, loss_date) WHERE n > 1 GROUP BY claim UNION ALL "
            f"SELECT claim, {O.q(K.ISSUE_MULTI_ROWS)}, 'n=' || n, CAST(sum(n) AS BIGINT) FROM (SELECT claim, claim_id, count(*) AS n "
            "FROM landed GROUP BY claim, claim_id) WHERE n > 1 GROUP BY claim, n",
            more_ctes=f"landed AS (SELECT nullif({O.trim_ws('claim_id')}, '') AS claim_id, "
                      f"{O.norm_id("nullif(" + O.trim_ws('claim_id') + ", '')")} AS claim, loss_date FROM std)")),
        ("run_issues", run_issues, O.claims_with(
            f"SELECT 'run-b' AS run_id, row_id AS row, claim_id, {O.q(K.ISSUE_ZERO_ROWS)} AS issue, '' AS detail "
            f"FROM std WHERE {zero}")),
        ("history_prune", history_prune, O.claims_with(
            f"SELECT run_id, count(*) AS n_rows, count(*) FILTER (WHERE {zero}) AS n_issues FROM std, "
            f"(SELECT unnest([{', '.join(O.q(r) for r in kept)}]) AS run_id) r GROUP BY run_id")
            .replace("SELECT run_id, count(*) AS n_rows", "SELECT r.run_id, count(*) AS n_rows").replace("GROUP BY run_id", "GROUP BY r.run_id")),
        ("delete_all", delete_all,
         "SELECT name, CAST(0 AS BIGINT) AS n FROM (VALUES ('runs'), ('issues'), ('audit_log'), ('saved_mappings')) t(name)"),
        ("audit_log_store", audit_log_store, f"""
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_utc, event_type AS event, props AS detail_json, count(*) AS n FROM events
WHERE ts IS NULL OR ts >= (SELECT max(ts) FROM events) + INTERVAL 10 DAYS - INTERVAL {K.RETENTION_DAYS} DAYS
GROUP BY ts, event_type, props"""),
        ("mapping_store", mapping_store, f"""
SELECT tenant_id, counterparty, max(props) AS mapping_json, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_utc
FROM (SELECT {mapped}, ts, props, max(ts) OVER (PARTITION BY user_id % 10, event_type) AS latest FROM events)
WHERE ts = latest GROUP BY tenant_id, counterparty, ts"""),
        ("mapping_lookup", mapping_lookup, f"SELECT * FROM (VALUES {fields}) t(field, source)"),
        ("salt_choice", salt_choice, O.claims_with(salt_sql())),
        ("format_numbers", format_numbers, O.claims_with(
            "SELECT row_id, coalesce(regexp_replace(regexp_replace(format('{:,.2f}', CAST(paid AS DOUBLE)), '\\.00$', ''), "
            "'(\\.[0-9])0$', '\\1'), 'NA') AS shown FROM std")),
        ("parquet_sink", parquet_sink, O.claims_with(
            "SELECT row_id, claim_id, CAST(paid AS DOUBLE) AS paid, status FROM std")),
        ("export_bundle", bundle, O.claims_with(
            f"SELECT 'clean' AS name, count(*) AS n FROM std UNION ALL SELECT 'issues', count(*) FROM std WHERE {zero}")),
        ("summary_document", summary_document, O.claims_with(
            f"SELECT 'run-1' AS run_id, count(*) AS n_rows, {sum_sql('paid')} AS total_paid, "
            "count(*) FILTER (WHERE paid < 0) AS neg_paid_n, 'ebix_v1' AS export_format FROM std")),
        ("audited_run", audited_run, O.claims_with(
            "SELECT e.event, 'run-x' AS run_id, CASE WHEN e.event = 'run_requested' THEN 'redacted' END AS file, "
            "CASE WHEN e.event = 'run_completed' THEN n END AS n_rows, m AS n_issues FROM (SELECT count(*) AS n, "
            f"count(*) FILTER (WHERE {O.blank('currency')}) AS m FROM std) s, "
            "(SELECT unnest(['run_requested', 'run_completed']) AS event) e")),
    ]
