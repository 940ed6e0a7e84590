"""Incremental intake of loss-run files with Structured Streaming.

Bordereaux arrive as files in a landing folder. The stream lists new files only; each
micro-batch reads its own files as the batch intake does: by each file's dialect and header,
so a column's values are found by its name wherever the file keeps it, quoted line breaks
included. It standardises every row and applies the row-local rules (everything except the
set-based duplicate, multi-row and outlier rules: the first two follow in ``claim_keys``, a stream with
keyed state over the claim keys that this one leaves in ``rows_path``; outliers need the whole run). Each micro-batch writes its issues into a folder of its own,
``batch_id=<n>``, and its rejected records into one beside it (``<out_path>-rejects``),
replacing whatever an earlier try left there. A batch that is replayed after a failure
between its write and its commit reads the same files again and so leaves the same rows once.

Rows are identified by ``(source_file, row_hash)``: a stream has no global
row order to number, and the hash of the raw cells is stable on replay. Equal
rows of one file share that identity. Files without a header line are passed over.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossframe.operators.numbering import BLOCK, FILE, POSITION
from lossframe.operators.rules import RuleConfig, rule_elements
from lossframe.operators.standardize import standardize
from lossframe.sources.csv_intake import by_place, csv_files, csv_records, csv_rows
from lossframe.streaming.claim_keys import publish_rows

ROW_LOCAL_ONLY = dict(rule_duplicates=False, rule_multi_rows_per_claim=False, rule_paid_outliers=False)


def landing_files(spark: SparkSession, folder: str, max_files_per_trigger: int = 100) -> DataFrame:
    """Streaming list of the files in a folder (path); their contents are not read."""
    return (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
            .option("maxFilesPerTrigger", max_files_per_trigger).load(folder).select("path"))


def read_landed(spark: SparkSession, paths: list[str], columns: list[str],
                with_position: bool = False) -> tuple[DataFrame, DataFrame] | None:
    """(rows with ``columns`` by name, in any case, and ``_file``; rejected records) of landed CSV files; a column that a file
    lacks is NULL. ``with_position`` adds ``BLOCK`` and ``POSITION``. None if no file has a header."""
    try:
        files = csv_files(spark, paths)
    except ValueError:
        return None
    wanted = {c.lower(): c for c in columns}
    places = {f.tag: {wanted[n.lower()]: i for i, n in enumerate(f.names) if n.lower() in wanted} for f in files}
    rows = by_place(csv_rows(spark, files), FILE, places, columns)
    rejects = csv_records(spark, files).where("rejected IS NOT NULL").select("source_file", "reason", F.col("rejected").alias("record"))
    place = [BLOCK, POSITION] if with_position else []
    return rows.select(*[F.col(f"`{c}`") for c in columns], F.col("source_file").alias("_file"), *place), rejects


def standard_rows(raw: DataFrame, mapping: dict[str, str], locale: str = "AU", tenant_id: str = "") -> DataFrame:
    """Standard claims of a raw frame with ``_file``, and ``row_hash`` of its data columns; positions are kept."""
    place = [c for c in (BLOCK, POSITION) if c in raw.columns]
    keyed = raw.withColumn("row_hash", F.xxhash64(*[F.col(f"`{c}`") for c in raw.columns if c not in ("_file", *place)]))
    return standardize(keyed, mapping, locale=locale, source_file=F.col("_file"), tenant_id=tenant_id, keep=["row_hash", *place])


def stream_issues(raw: DataFrame, mapping: dict[str, str], cfg: RuleConfig | None = None, locale: str = "AU",
                  tenant_id: str = "") -> DataFrame:
    """Standardise a (streaming) raw frame and emit its row-local issues."""
    cfg = replace(cfg or RuleConfig(), **ROW_LOCAL_ONLY)
    std = standard_rows(raw, mapping, locale, tenant_id)
    els = rule_elements(cfg, None)
    return (std.select("source_file", "row_hash", "claim_id", F.explode(F.array_compact(F.array(*els))).alias("i"))
            .select("source_file", "row_hash", "claim_id", F.col("i.issue").alias("issue"),
                    F.col("i.detail").alias("detail"), F.col("i.rule_order").alias("rule_order")))


def start(spark: SparkSession, folder: str, columns: list[str], mapping: dict[str, str], out_path: str,
          checkpoint_location: str, cfg: RuleConfig | None = None, locale: str = "AU", tenant_id: str = "",
          available_now: bool = True, max_files_per_trigger: int = 100, rows_path: str | None = None):
    """Run the intake stream; issues go to ``out_path`` as Parquet, partitioned by ``batch_id``, rejects to ``<out_path>-rejects``,
    claim keys for ``claim_keys.start`` to ``rows_path`` if given."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        paths = sorted(r["path"] for r in batch.collect())  # at most max_files_per_trigger
        landed = read_landed(spark, paths, columns, with_position=True) if paths else None
        if landed is None:
            return
        rows, rejects = landed
        stream_issues(rows, mapping, cfg, locale, tenant_id).write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
        rejects.write.mode("overwrite").parquet(f"{out_path}-rejects/batch_id={batch_id}")
        if rows_path:
            publish_rows(standard_rows(rows, mapping, locale, tenant_id), rows_path, batch_id)

    w = landing_files(spark, folder, max_files_per_trigger).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
