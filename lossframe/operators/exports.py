"""Export layouts and sinks.

Layouts are projections; the writers are plain DataFrame writers, one
task per output partition, never a driver-side file.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossframe import __version__ as APP_VERSION
from lossframe.constants import EXPORT_LAYOUTS
from lossframe.functions.amounts import round_money
from lossframe.functions.dates import format_date
from lossframe.functions.privacy import mask_claimant, mask_policy


def mask(std: DataFrame, salt: str) -> DataFrame:
    """Masked twin: claimant letters -> 'x', policy number -> keyed hash."""
    return (std.withColumn("claimant", mask_claimant(F.col("claimant")))
            .withColumn("policy_number", mask_policy(F.col("policy_number"), salt)))


def _sources(fill_outstanding: bool) -> dict[str, Column]:
    """Computed layout sources, by key."""
    less = F.col("incurred") - F.col("paid")
    return {"incurred_less_paid": less,
            "outstanding_filled": F.coalesce(F.col("outstanding"), less) if fill_outstanding else F.col("outstanding")}


_KINDS = {"text": lambda c: c, "amount": lambda c: c, "money": round_money,
          "iso": lambda c: format_date(c, "iso"), "au": lambda c: format_date(c, "au")}


def transform_export(std: DataFrame, fmt: str = "standard_csv", masked: bool = True, salt: str | None = None,
                     fill_outstanding: bool = False) -> DataFrame:
    """X1-X4 (+X9): one of the market layouts of ``EXPORT_LAYOUTS``, masked unless asked otherwise.

    An output name ``plain|masked`` depends on the masking."""
    if fmt not in EXPORT_LAYOUTS:
        raise ValueError(f"unknown export format {fmt!r}")
    if masked and salt is None:
        raise ValueError("a masking salt is required for a masked export")
    src = mask(std, salt) if masked else std
    if "run_id" not in src.columns:
        src = src.withColumn("run_id", F.lit(None).cast("string"))
    computed = _sources(fill_outstanding)
    return src.select(*[_KINDS[kind](computed.get(key, F.col(key))).alias(name.split("|")[-1 if masked else 0])
                        for name, key, kind in EXPORT_LAYOUTS[fmt]])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header, NULL written as empty, quotes doubled inside quoted cells."""
    (df.write.mode(mode).option("header", True).option("nullValue", "").option("emptyValue", "").option("escape", '"')
     .csv(path))


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Parquet sink."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def summary_json(run_id: str | None, metrics: dict, summary: dict, export_format: str) -> str:
    """The summary document (version, run id, metrics, summary, format)."""
    def enc(v):
        if v is None:
            return None
        if hasattr(v, "isoformat"):
            return v.isoformat()
        if isinstance(v, (int, float, str, bool)):
            return v
        return float(v)
    doc = {"app_version": APP_VERSION, "run_id": run_id or "N/A",
           "metrics": {k: enc(v) for k, v in metrics.items()},
           "Q": {k: enc(v) for k, v in summary.items()}, "export_format": export_format}
    return json.dumps(doc, indent=2)


def write_bundle(path: str, tables: dict[str, DataFrame], summary_doc: str | None = None,
                 fmt: str = "parquet") -> dict[str, str]:
    """One table per folder under ``path`` (clean, issues, pivots, triangles, summary)."""
    out = {}
    for name, df in tables.items():
        p = f"{path.rstrip('/')}/{name}"
        if fmt == "csv":
            write_csv(df, p)
        else:
            write_parquet(df, p)
        out[name] = p
    if summary_doc is not None and tables:
        spark = next(iter(tables.values())).sparkSession
        p = f"{path.rstrip('/')}/summary_json"
        spark.createDataFrame([(summary_doc,)], "value string").coalesce(1).write.mode("overwrite").text(p)
        out["summary_json"] = p
    return out
