"""One validation run end to end (the reference's "Run" button).

    raw files -> standardise -> number rows -> persist ONCE
      -> rules (one explode)         -> issues
      -> summary (a few aggregates)  -> one row
      -> pivot + three triangles     -> small tables
      -> "why flagged" left join     -> clean rows with flags
      -> save run header + issues (idempotent partition overwrite)

The standard table is written once to the reliable checkpoint folder
(``persist_table``) and numbered from there, so every downstream plan starts
from persisted data and a lost executor only recomputes its own partitions
of the current stage.
"""

from __future__ import annotations

import hashlib
import time
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossframe.constants import STANDARD_FIELDS
from lossframe.operators import exports as X
from lossframe.operators import history as H
from lossframe.operators import quality as Q
from lossframe.operators import rules as V
from lossframe.operators import triangles as TR
from lossframe.functions.privacy import hmac_sha256_hex
from lossframe.operators.column_types import trained_dates
from lossframe.operators.mapping import guess_schema, identity_mapping
from lossframe.operators.numbering import BLOCK, FILE, POSITION, number_by_position, number_rows, number_stored
from lossframe.operators.standardize import standardize
from lossframe.sources.csv_intake import by_place, csv_files, csv_rows
from lossframe.sources.files import file_checks, union_files
from lossframe.session import persist_table


@dataclass
class RunResult:
    run_id: str
    std: DataFrame
    issues: DataFrame
    summary: dict
    metrics: DataFrame
    pivot: DataFrame
    tri_counts: DataFrame
    tri_paid: DataFrame
    tri_incurred: DataFrame
    flagged: DataFrame
    timings: dict = field(default_factory=dict)


def new_run_id() -> str:
    return hashlib.sha256(f"{time.time_ns()}".encode()).hexdigest()[:32]


def prepare(files: list[tuple[DataFrame, str | None]], mapping: dict[str, str] | list[dict[str, str]], locale: str = "AU",
            tenant_id: str = "", run_id: str | None = None, order_col: str | None = None,
            train_dates: bool = False) -> DataFrame:
    """Standardise each (raw frame, file name), union by name and number rows in (file order, row order).

    ``train_dates``: text dates are read by the type and date order that each file's column shows
    (``column_types.trained_dates``), not value by value.

    Frames read with their positions (``read_csv(with_position=True)``) are numbered in line order;
    else ``order_col`` (e.g. a line number) gives the order in each file; else rows keep the order of
    the frame's partitions. A file name of None takes the frame's ``source_file`` column."""
    run_id = run_id or new_run_id()
    maps = mapping if isinstance(mapping, list) else [mapping] * len(files)
    placed = all(POSITION in raw.columns for raw, _ in files)
    parts = []
    for i, ((raw, name), m) in enumerate(zip(files, maps)):
        if placed:
            keep = [FILE, BLOCK, POSITION]
        else:
            raw, keep = raw.withColumn("_file_ord", F.lit(i)), ["_file_ord", *([order_col] if order_col else [])]
        if train_dates:
            own = {m.get(f) for f in ("loss_date", "report_date")}
            dated = [c for c, kind in raw.dtypes if c in own and kind == "string"]
            key = FILE if placed else "source_file" if name is None else "_file_ord"
            raw = trained_dates(raw, dated, key, locale) if dated else raw
        parts.append(standardize(raw, m, locale=locale, source_file=F.col("source_file") if name is None else name,
                                 tenant_id=tenant_id, run_id=run_id, keep=keep))
    u = union_files(parts)
    if placed:
        return number_by_position(u)
    u = persist_table(u, "std_unnumbered")
    if order_col:
        return number_rows(u, ["_file_ord", order_col]).drop("_file_ord", order_col)
    return number_stored(u).drop("_file_ord")


def intake(spark: SparkSession, paths: str | list[str], mapping: dict[str, str] | None = None, locale: str = "AU",
           tenant_id: str = "", run_id: str | None = None, max_mb: float | None = None, multi_line: bool = True,
           promote: bool = False, train_dates: bool = False) -> tuple[DataFrame, DataFrame]:
    """Files to numbered standard claims in one call: checks, then only the accepted CSV files, each read in its own dialect and by
    its own header (promoted from the first data row if asked for) and mapped by it, unless a mapping is given. All files are
    standardised in one plan: a standard field is the cell at its file's place. Records with more cells than their header are left out;
    ``csv_rejects`` gives them. ``train_dates``: as in ``prepare``.

    Returns (claims, checks). Accepted files of other kinds are in the checks; their tables come from
    ``layout_tables`` or a converter."""
    checks = file_checks(spark, paths, max_mb)
    accepted = sorted(r["path"] for r in checks.where("ok AND ext = 'csv'").collect())
    if not accepted:
        raise ValueError("no acceptable CSV file")
    files = csv_files(spark, accepted, promote)
    guessed: dict[tuple, dict[str, int]] = {}
    for f in files:
        if f.names not in guessed:
            place = {n.lower(): i for i, n in enumerate(f.names)}
            own = mapping or guess_schema(list(f.names))
            guessed[f.names] = {k: place[c.lower()] for k, c in own.items() if c and c.lower() in place}
    placed = by_place(csv_rows(spark, files, multi_line), FILE, {f.tag: guessed[f.names] for f in files}, list(STANDARD_FIELDS))
    numbered = prepare([(placed, None)], identity_mapping(), locale, tenant_id, run_id, train_dates=train_dates)
    return numbered, checks


def run(std: DataFrame, cfg: V.RuleConfig | None = None, policy_start: date | None = None,
        policy_end: date | None = None, run_id: str | None = None, persist: bool = True, stored: bool = False) -> RunResult:
    """Validate, summarise and build triangles over a numbered standard table.

    ``stored``: ``std`` is numbered over a stored table, as ``prepare`` and ``intake`` return it, and is not written again. The
    claims with their issues are written if a rule has joined them with the claim keys; the rules of a row alone are as cheap as
    reading their result."""
    timings = {}
    t = time.perf_counter()
    cfg = (cfg or V.RuleConfig()).with_term(policy_start, policy_end)
    if persist and not stored:
        std = persist_table(std, "std")
    timings["persist"] = time.perf_counter() - t
    run_id = run_id or (std.select("run_id").first()[0] if "run_id" in std.columns else new_run_id())

    t = time.perf_counter()
    shared = V.paid_quartiles(std) if cfg.quantile_method == "exact" else None
    fences = None
    if cfg.rule_paid_outliers:
        fences = V.paid_fences(std, cfg, shared["all"] if shared else None)
    # one pass: claims + their issue arrays; issues and the
    # "why flagged" text are both projections of it
    ann = V.annotate(std, cfg, fences)
    if persist and (cfg.rule_duplicates or cfg.rule_multi_rows_per_claim):
        ann = persist_table(ann, "annotated")
    issues = ann.select(F.col("row_id").alias("row"), "claim_id", F.explode("_issues").alias("_i")).select(
        "row", "claim_id", F.col("_i.issue").alias("issue"), F.col("_i.detail").alias("detail"),
        F.col("_i.rule_order").alias("rule_order"))
    timings["validate"] = time.perf_counter() - t

    t = time.perf_counter()
    summary = Q.summary_dict(std, policy_start, policy_end, cfg.quantile_method,
                             shared["suffix"] if shared else None)
    metrics = V.run_metrics(ann, long=True)
    timings["summary"] = time.perf_counter() - t

    pivot = TR.ay_currency_pivot(std)
    tri_counts = TR.triangle_counts(std)
    tri_paid = TR.triangle_amounts(std, "paid")
    tri_incurred = TR.triangle_amounts(std, "incurred")
    flagged = V.flags_from_annotated(ann)
    return RunResult(run_id, std, issues, summary, metrics, pivot, tri_counts, tri_paid, tri_incurred, flagged,
                     timings)


def save(result: RunResult, root: str, tenant_id: str = "") -> None:
    """Persist the run header and issues (re-saving a run replaces it)."""
    header = H.run_header(result.std, result.run_id, tenant_id)
    H.save_run(header, result.issues, root)


def export_bundle(result: RunResult, path: str, fmt: str = "standard_csv", masked: bool = True,
                  salt: str | None = None) -> dict[str, str]:
    """Clean export, issues, pivots, triangles and metrics as a folder of tables."""
    clean = X.transform_export(result.std, fmt, masked=masked, salt=salt)
    tables = {"clean": clean, "issues": result.issues.drop("rule_order"), "pivots": result.pivot,
              "triangles_counts": result.tri_counts, "triangles_paid": result.tri_paid,
              "triangles_incurred": result.tri_incurred, "summary": result.metrics}
    metrics = {r["metric"]: r["value"] for r in result.metrics.collect()}
    doc = X.summary_json(result.run_id, metrics, result.summary, fmt)
    return X.write_bundle(path, tables, doc)


def process(spark: SparkSession, paths: str | list[str], root: str, cfg: V.RuleConfig | None = None,
            policy_start: date | None = None, policy_end: date | None = None, tenant_id: str = "",
            run_id: str | None = None, audit_salt: str = "", **intake_options) -> RunResult:
    """Intake, run, save, with the audit events requested, completed and failed (file names scrubbed)."""
    run_id = run_id or new_run_id()
    named = [paths] if isinstance(paths, str) else list(paths)
    names = [p.rstrip("/").rsplit("/", 1)[-1] for p in named]
    scrubbed = [hmac_sha256_hex(audit_salt, n) if audit_salt else "redacted" for n in names]
    H.append_audit(spark, root, "run_requested", {"run_id": run_id, "files": scrubbed})
    try:
        std, checks = intake(spark, paths, tenant_id=tenant_id, run_id=run_id, **intake_options)
        result = run(std, cfg, policy_start, policy_end, run_id, stored=True)
        save(result, root, tenant_id)
        H.append_audit(spark, root, "run_completed", {"run_id": run_id, "n_rows": result.summary["n_rows"],
                                                      "n_rejected_files": checks.where("NOT ok").count()})
    except Exception as e:
        H.append_audit(spark, root, "run_failed", {"run_id": run_id, "error": type(e).__name__})
        raise
    return result
