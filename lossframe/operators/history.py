"""Run history, retention and audit trail (H1-H6).

The four stored tables (runs, issues, saved mappings, audit log) are
Parquet folders. Runs and issues are partitioned by ``run_id`` and written
with dynamic partition overwrite (the writer's option, whatever the session
says), so saving a run twice replaces exactly that run's partitions.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lossframe import __version__ as APP_VERSION
from lossframe.constants import RETENTION_DAYS
from lossframe.functions.privacy import scrub_name
from lossframe.operators import versions
from lossframe.session import persist_table

RUNS_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("tenant_id", T.StringType()),
    T.StructField("ts_utc", T.TimestampType()), T.StructField("n_rows", T.LongType()),
    T.StructField("n_claims", T.LongType()), T.StructField("total_paid", T.DecimalType(38, 6)),
    T.StructField("total_incurred", T.DecimalType(38, 6)),
])
ISSUES_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("row", T.LongType()),
    T.StructField("claim_id", T.StringType()), T.StructField("issue", T.StringType()),
    T.StructField("detail", T.StringType()),
])
AUDIT_SCHEMA = T.StructType([
    T.StructField("ts_utc", T.TimestampType()), T.StructField("event", T.StringType()),
    T.StructField("detail_json", T.StringType()), T.StructField("app_version", T.StringType()),
])


def run_header(std: DataFrame, run_id: str, tenant_id: str, ts: Column | None = None) -> DataFrame:
    """H1 row: run id, tenant, time and headline totals, computed by one aggregate."""
    return std.agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.count_distinct("claim_id") + F.coalesce(F.max(F.col("claim_id").isNull().cast("int")), F.lit(0)))
        .cast("long").alias("n_claims"),
        F.coalesce(F.sum("paid"), F.lit(0)).cast("decimal(38,6)").alias("total_paid"),
        F.coalesce(F.sum("incurred"), F.lit(0)).cast("decimal(38,6)").alias("total_incurred"),
    ).select(F.lit(run_id).alias("run_id"), F.lit(tenant_id).alias("tenant_id"),
             (ts if ts is not None else F.current_timestamp()).alias("ts_utc"),
             "n_rows", "n_claims", "total_paid", "total_incurred")


def _fs_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs_path(spark, path)
    return fs.exists(p)


def _partition_path(table: str, run_id: str) -> str:
    """Folder of one run's partition, escaped as Spark's writer names it."""
    return f"{table}/run_id={''.join(_escaped(c) for c in run_id)}"


def _escaped(c: str) -> str:
    return f"%{ord(c):02X}" if ord(c) < 32 or c in "\x7f\"#%'*/:=?\\{[]^" else c


def _drop_partitions(spark: SparkSession, table: str, run_ids: list[str]) -> None:
    for r in run_ids:
        fs, p = _fs_path(spark, _partition_path(table, r))
        if fs.exists(p) and not fs.delete(p, True):
            raise OSError(f"could not delete {p}")


def _overwrite_partitions(df: DataFrame, path: str) -> None:
    """Replace the partitions that ``df`` has rows for; the mode is the writer's own, not the session's."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path))


def save_run(header: DataFrame, issues: DataFrame, root: str) -> None:
    """H1 + H2: upsert one run's header and replace its issues (none left if it has none now).

    The header goes last, so a run that is listed has its issues; a repeat after a failure gives the same.
    """
    run_ids = [r[0] for r in header.select("run_id").distinct().limit(2).collect()]
    if len(run_ids) != 1 or not run_ids[0]:
        raise ValueError("save_run stores exactly one run with a run_id")
    spark = header.sparkSession
    iss = issues.select(*[c for c in ISSUES_SCHEMA.fieldNames() if c != "run_id"]).withColumn("run_id", F.lit(run_ids[0]))
    stored = persist_table(iss.select(*ISSUES_SCHEMA.fieldNames()), "issues")
    _overwrite_partitions(stored, f"{root}/issues")
    if stored.isEmpty():
        _drop_partitions(spark, f"{root}/issues", run_ids)
    _overwrite_partitions(header.select(*RUNS_SCHEMA.fieldNames()), f"{root}/runs")


def read_table(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame:
    """A stored table; empty only where nothing was stored yet. Any failure to read is raised."""
    if not _exists(spark, f"{root}/{name}"):
        return spark.createDataFrame([], schema)
    if versions.is_versioned(spark, f"{root}/{name}"):
        return versions.read(spark, f"{root}/{name}", schema)
    return spark.read.schema(schema).parquet(f"{root}/{name}")


def retention_filter(df: DataFrame, ts_col: str, as_of: datetime | Column | None = None,
                     days: int = RETENTION_DAYS) -> DataFrame:
    """H3: keep rows whose time is NULL or within ``days`` of ``as_of``
    (a SQL ``DELETE ... WHERE ts < cutoff`` never deletes NULL times)."""
    if as_of is None:
        cutoff = F.current_timestamp() - F.expr(f"INTERVAL {int(days)} DAYS")
    elif isinstance(as_of, Column):
        cutoff = as_of - F.expr(f"INTERVAL {int(days)} DAYS")
    else:
        cutoff = F.lit(as_of - timedelta(days=days))
    ts = F.col(ts_col)
    return df.where(ts.isNull() | (ts >= cutoff))


def orphan_filter(children: DataFrame, parents: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """H4: keep child rows whose parent still exists (semi join, never a
    null-aware NOT IN anti join)."""
    pk = parent_key or key
    keys = parents.select(F.col(pk).alias(key)).where(F.col(key).isNotNull())
    return children.join(keys, key, "left_semi")


def prune(spark: SparkSession, root: str, as_of: datetime | Column | None = None, days: int = RETENTION_DAYS) -> dict[str, int]:
    """H3 + H4 over the stored tables: runs and audit rows by age, then issues whose run is gone.

    Nothing is rewritten: the partitions of expired runs and of issues without a run are deleted (their
    ids come to the driver, one short text for a run, not for a row), and expired audit rows go by
    a new version of the audit table only if there are any; events appended meanwhile stay. Whatever fails before a
    deletion is raised and leaves the tables as they were; a repeat finishes the rest.
    Returns how many partitions or rows went, by table.
    """
    if as_of is None:
        as_of = datetime.now(timezone.utc)  # one time for all counts and the audit log's new version
    runs = read_table(spark, root, "runs", RUNS_SCHEMA)
    kept = [r[0] for r in retention_filter(runs, "ts_utc", as_of, days).select("run_id").distinct().collect()]
    expired = sorted({r[0] for r in runs.select("run_id").distinct().collect()} - set(kept))
    issue_ids = {r[0] for r in read_table(spark, root, "issues", ISSUES_SCHEMA).select("run_id").distinct().collect()}
    orphans = sorted(issue_ids - set(kept))
    audit = read_table(spark, root, "audit_log", AUDIT_SCHEMA)
    gone = audit.count() - retention_filter(audit, "ts_utc", as_of, days).count()
    _drop_partitions(spark, f"{root}/runs", [r for r in expired if r is not None])
    _drop_partitions(spark, f"{root}/issues", [r for r in orphans if r is not None])
    if gone:
        versions.replace(spark, f"{root}/audit_log", AUDIT_SCHEMA, lambda log: retention_filter(log, "ts_utc", as_of, days))
        versions.drop_retired(spark, f"{root}/audit_log")
    return {"runs": len(expired), "issues": len(orphans), "audit_log": gone}


def delete_all(spark: SparkSession, root: str, confirm: bool = False) -> None:
    """H5: replace every stored table with an empty one (explicit confirmation)."""
    if not confirm:
        raise ValueError("delete_all needs confirm=True")
    from lossframe.operators.mapping import MAPPING_STORE_SCHEMA
    for name, schema in [("runs", RUNS_SCHEMA), ("issues", ISSUES_SCHEMA)]:
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{root}/{name}")
    for name, schema in [("audit_log", AUDIT_SCHEMA), ("saved_mappings", MAPPING_STORE_SCHEMA)]:
        versions.replace(spark, f"{root}/{name}", schema, lambda old: old.limit(0))
        versions.drop_retired(spark, f"{root}/{name}")


def audit_records(events: DataFrame, ts_col: str = "ts", event_col: str = "event", detail_col: str = "detail",
                  detail_is_json: bool = True, file_col: str | None = None, hide_filenames: bool = True,
                  audit_salt: str = "", keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """H6: one JSON line per event: ``{"ts", "event", "detail", "app_version"}``.

    ``detail`` is embedded as a JSON value (parsed, so it is re-emitted
    minified rather than as an escaped string). A file-name column, when
    given, is scrubbed (F10) and added to the record as ``file``.
    """
    detail = F.parse_json(F.col(detail_col)) if detail_is_json else F.col(detail_col)
    fields = [F.date_format(F.col(ts_col), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
              F.col(event_col).alias("event"), detail.alias("detail")]
    if file_col:
        fields.append(scrub_name(F.col(file_col), hide_filenames, audit_salt).alias("file"))
    fields.append(F.lit(APP_VERSION).alias("app_version"))
    return events.select(*keep, F.to_json(F.struct(*fields)).alias("json"))


def append_audit(spark: SparkSession, root: str, event: str, detail: dict) -> None:
    """Append one audit row (driver-built, a single small record)."""
    import json
    now = datetime.now(timezone.utc).replace(tzinfo=None)  # UTC wall time, session is UTC
    row = [(now, event, json.dumps(detail), APP_VERSION)]
    versions.append(spark, f"{root}/audit_log", AUDIT_SCHEMA, spark.createDataFrame(row, AUDIT_SCHEMA))
