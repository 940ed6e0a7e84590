"""Header mapping and the saved-mapping store (M1, M2, M4-M7).

A mapping is a plain ``dict`` of the ten standard fields to a source column
name (``""`` = unmapped). Guessing is driver-side over ``df.columns`` only;
no data is touched. The store is a DataFrame of
``(tenant_id, counterparty, mapping_json, ts_utc)`` rows kept as Parquet.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lossframe.constants import FIELD_ALIASES, STANDARD_FIELDS
from lossframe.functions.names import normalize_name
from lossframe.operators import versions
from lossframe.session import persist_table

MAPPING_STORE_SCHEMA = T.StructType([
    T.StructField("tenant_id", T.StringType()),
    T.StructField("counterparty", T.StringType()),
    T.StructField("mapping_json", T.StringType()),
    T.StructField("ts_utc", T.TimestampType()),
])


def guess_schema(columns: list[str]) -> dict[str, str]:
    """M2: for each field, the first source column (in column order) whose
    normalised name is one of the field's aliases, else ``""``."""
    normed = [normalize_name(c) for c in columns]
    out = {}
    for field, aliases in FIELD_ALIASES.items():
        hit = next((columns[i] for i, n in enumerate(normed) if n in aliases), "")
        out[field] = hit
    return out


def identity_mapping() -> dict[str, str]:
    """The sample mapping: every field from the column of the same name."""
    return {f: f for f in STANDARD_FIELDS}


def mapping_to_json(mapping: dict[str, str]) -> str:
    """M4 save: field order kept, unknown keys dropped."""
    return json.dumps({f: mapping.get(f, "") for f in STANDARD_FIELDS})


def mapping_from_json(text: str) -> dict[str, str]:
    """M4 load: missing fields become unmapped; non-string values are rejected."""
    raw = json.loads(text)
    if not isinstance(raw, dict):
        raise ValueError("mapping JSON must be an object")
    out = {}
    for f in STANDARD_FIELDS:
        v = raw.get(f, "")
        if isinstance(v, list):
            v = v[0] if v else ""
        if v is None:
            v = ""
        if not isinstance(v, str):
            raise ValueError(f"mapping for {f!r} must be a column name")
        out[f] = v
    return out


# ---------------------------------------------------------------------------
# Saved-mapping store
# ---------------------------------------------------------------------------

def empty_store(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MAPPING_STORE_SCHEMA)


def latest_per_key(df: DataFrame, keys: list[str], order_cols: list[str], value_cols: list[str]) -> DataFrame:
    """M5 core: one row per key holding the values of the latest row.

    ``max_by`` over a struct of the ordering columns is a single hash
    aggregate with map-side partial aggregation; no window, no sort.
    """
    order = F.struct(*[F.col(c) for c in order_cols])
    aggs = [F.max_by(F.col(v), order).alias(v) for v in value_cols]
    aggs += [F.max(order).getField(c).alias(c) for c in order_cols if c not in value_cols]
    return df.groupBy(*keys).agg(*aggs)


def upsert(store: DataFrame, new: DataFrame) -> DataFrame:
    """M5: rows of ``new`` replace those of the same (tenant_id, counterparty); among several the newest wins, and
    with equal times the one of ``new``, then the larger mapping text, so the winner is always defined."""
    both = store.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest_per_key(both, ["tenant_id", "counterparty"], ["ts_utc", "_new", "mapping_json"], ["mapping_json"]).select(
        *MAPPING_STORE_SCHEMA.fieldNames())


def save_mapping(store: DataFrame, tenant_id: str, counterparty: str, mapping: dict[str, str],
                 ts=None) -> DataFrame:
    """M5: upsert of one mapping on (tenant_id, counterparty); the newest entry wins."""
    spark = store.sparkSession
    new = spark.createDataFrame([(tenant_id, counterparty, mapping_to_json(mapping), ts)], MAPPING_STORE_SCHEMA)
    if ts is None:
        new = new.withColumn("ts_utc", F.current_timestamp())
    return upsert(store, new)


def store_mappings(spark: SparkSession, root: str, new: DataFrame) -> None:
    """M5 over the stored table ``saved_mappings``: merged into its newest version (``versions.replace``), so neither a crash
    nor a second writer loses a mapping."""
    rows = persist_table(new.select(*MAPPING_STORE_SCHEMA.fieldNames()), "mappings")  # the same rows if it is tried again
    versions.replace(spark, f"{root}/saved_mappings", MAPPING_STORE_SCHEMA, lambda store: upsert(store, rows))


def load_mapping(store: DataFrame, tenant_id: str, counterparty: str) -> dict[str, str] | None:
    """M6: look one mapping up (filters on both keys; returns at most one small row)."""
    rows = (store.where((F.col("tenant_id") == tenant_id) & (F.col("counterparty") == counterparty))
            .select("mapping_json").limit(1).collect())
    if not rows or not rows[0][0]:
        return None
    try:
        return mapping_from_json(rows[0][0])
    except ValueError:
        return None


def list_counterparties(store: DataFrame, tenant_id: str | None = None) -> DataFrame:
    """M7: distinct counterparties, sorted, for one tenant (or per tenant)."""
    if tenant_id is not None:
        return (store.where(F.col("tenant_id") == tenant_id).select("counterparty").distinct()
                .orderBy("counterparty"))
    return store.select("tenant_id", "counterparty").distinct().orderBy("tenant_id", "counterparty")
