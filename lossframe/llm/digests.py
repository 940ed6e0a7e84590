"""Digest columns of span results: counts by kind, hash of the base spans, all spans as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def span_digest(found: DataFrame, base: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_<kind> of each kind, base_sha256, spans. ``found.spans`` is sorted by start, then kind."""
    spans = F.col("spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    own = F.filter(spans, lambda s: s["kind"].isin(*base))
    return found.select("doc_id", *[count(k) for k in (*base, *more)],
                        F.sha2(joined(own).cast("binary"), 256).alias("base_sha256"), joined(spans).alias("spans"))
