"""Exact type-7 quantiles without sorting or shuffling the values.

Spark's exact ``percentile`` merges a value -> count map of the whole column
in one task. Here the order statistics are bracketed instead:

1. ``percentile_approx`` a little below and above each wanted rank gives an
   interval that should hold it (a mergeable sketch, no shuffle of values);
2. one aggregate counts the values below and up to each interval, which
   proves that the rank lies inside (or replaces the failed bound);
3. only the values inside are grouped and counted. If their distinct values
   are more than ``MAX_DISTINCT``, the interval is bracketed again, so what
   reaches the driver is bounded.

The result is exact (DECIMAL arithmetic, R type 7 / DuckDB
``quantile_cont``). ``method="approx"`` uses ``percentile_approx`` alone.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000
MAX_DISTINCT = 50_000


def _interpolate(value_at, n: int, probs: list[float], offset: int = 0) -> list[Decimal | None]:
    out = []
    for p in probs:
        if n == 0:
            out.append(None)
            continue
        h = Decimal(n - 1) * Decimal(str(p))
        lo = int(h)
        hi = lo if h == lo else lo + 1
        xl, xh = value_at(offset + lo), value_at(offset + hi)
        out.append(xl + (h - lo) * (xh - xl))
    return out


def _positions(n: int, probs: list[float], offset: int = 0) -> set[int]:
    ks = set()
    for p in probs:
        if n == 0:
            continue
        h = Decimal(n - 1) * Decimal(str(p))
        lo = int(h)
        ks |= {offset + lo, offset + (lo if h == lo else lo + 1)}
    return ks


def order_statistics(vals: DataFrame, ranks: list[int], n: int, accuracy: int = ACCURACY,
                     max_distinct: int = MAX_DISTINCT) -> dict[int, Decimal]:
    """The ``k``-th smallest (from 0) of the ``n`` non-null values ``v`` for every ``k`` in ``ranks``."""
    if not ranks:
        return {}
    # a rank of the sketch is off by n / accuracy at most
    slack = 2.0 / accuracy + 1.0 / n
    probs = [min(1.0, max(0.0, k / n + s)) for k in ranks for s in (-slack, slack)]
    row = vals.agg(F.percentile_approx("v", probs, accuracy).alias("q"), F.min("v").alias("lo"),
                   F.max("v").alias("hi")).first()
    bounds = [(row["q"][2 * i], row["q"][2 * i + 1]) for i in range(len(ranks))]
    counts = vals.agg(*[F.count_if(F.col("v") < F.lit(lo)).alias(f"b{i}") for i, (lo, _) in enumerate(bounds)],
                      *[F.count_if(F.col("v") <= F.lit(hi)).alias(f"u{i}") for i, (_, hi) in enumerate(bounds)]).first()
    below = {}
    for i, k in enumerate(ranks):
        lo, hi = bounds[i]
        below[k] = counts[f"b{i}"]
        if below[k] > k:
            lo, below[k] = row["lo"], 0
        if counts[f"u{i}"] <= k:
            hi = row["hi"]
        bounds[i] = (lo, hi)
    inside = [F.col("v").between(F.lit(lo), F.lit(hi)) for lo, hi in bounds]
    counted = (vals.where(reduce(lambda a, b: a | b, inside)).groupBy("v").agg(F.count(F.lit(1)).alias("c"))
               .limit(max_distinct + 1).collect())
    out = {}
    if len(counted) <= max_distinct:
        counted.sort(key=lambda r: r["v"])
        for k, (lo, hi) in zip(ranks, bounds):
            at = below[k]
            for r in counted:
                if lo <= r["v"] <= hi:
                    at += r["c"]
                    if at > k:
                        out[k] = Decimal(r["v"])
                        break
        return out
    for k, (lo, hi) in zip(ranks, bounds):  # narrower: each interval by itself
        part = vals.where(F.col("v").between(F.lit(lo), F.lit(hi)))
        m = part.count()
        finer = accuracy if m < n else accuracy * 10
        out[k] = order_statistics(part, [k - below[k]], m, finer, max_distinct)[k - below[k]]
    return out


def _values(df: DataFrame, col: str | Column) -> DataFrame:
    c = F.col(col) if isinstance(col, str) else col
    return df.select(c.alias("v")).where(F.col("v").isNotNull())


def quantiles_with_suffix(df: DataFrame, col: str | Column, probs: list[float], suffix_from=0
                          ) -> dict[str, tuple[int, list[Decimal | None]]]:
    """Exact quantiles of all non-null values AND of the values >= ``suffix_from``
    together: the subset is a suffix of the sorted order, so its k-th value is
    the overall (n_below + k)-th value.

    Returns ``{"all": (n, qs), "suffix": (n_suffix, qs)}``."""
    vals = _values(df, col)
    row = vals.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") < F.lit(suffix_from)).alias("below")).first()
    n, below = int(row["n"]), int(row["below"])
    if n == 0:
        return {"all": (0, [None] * len(probs)), "suffix": (0, [None] * len(probs))}
    found = order_statistics(vals, sorted(_positions(n, probs) | _positions(n - below, probs, below)), n)
    return {"all": (n, _interpolate(found.__getitem__, n, probs)),
            "suffix": (n - below, _interpolate(found.__getitem__, n - below, probs, below))}


def quantiles(df: DataFrame, col: str | Column, probs: list[float], method: str = "exact",
              accuracy: int = 1_000_000) -> tuple[int, list[Decimal | None]]:
    """Return ``(n, [q_p for p in probs])`` over the non-null values of ``col``."""
    vals = _values(df, col)
    if method == "approx":
        row = vals.agg(F.count(F.lit(1)).alias("n"),
                       F.percentile_approx("v", list(probs), accuracy).alias("q")).collect()[0]
        qs = [Decimal(str(x)) if x is not None else None for x in (row["q"] or [None] * len(probs))]
        return int(row["n"]), qs
    if method != "exact":
        raise ValueError(f"unknown quantile method {method!r}")
    n = vals.count()
    if n == 0:
        return 0, [None] * len(probs)
    found = order_statistics(vals, sorted(_positions(n, probs)), n)
    return n, _interpolate(found.__getitem__, n, probs)


def fences_from(n: int, q1, q3, multiplier: float, min_n: int = 5, lower_floor: bool = True) -> dict | None:
    """IQR fences from precomputed quartiles (None when fewer than ``min_n`` values)."""
    if n < min_n or q1 is None:
        return None
    m = Decimal(str(multiplier))
    iqr = q3 - q1
    lower = q1 - m * iqr
    if lower_floor:
        lower = max(Decimal(0), lower)
    return {"n": n, "q1": q1, "q3": q3, "iqr": iqr, "upper": q3 + m * iqr, "lower": lower}


def iqr_fences(df: DataFrame, col: str, multiplier: float, min_n: int = 5, lower_floor: bool = True,
               method: str = "exact") -> dict | None:
    """IQR fences as literals, or None when fewer than ``min_n`` values."""
    n, (q1, q3) = quantiles(df, col, [0.25, 0.75], method=method)
    return fences_from(n, q1, q3, multiplier, min_n, lower_floor)
