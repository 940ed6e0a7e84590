"""Stable row numbers.

A stored table has an order already: its files, and the rows in them. So a
number is the count of rows in the files before, plus the row's index in its
own file; the only extra work is one count per file. Nothing is shuffled.

* ``number_stored``: rows of a stored Parquet table, in file and row order;
* ``number_by_position``: rows that carry the position their reader gave
  them (``sources.files.read_csv``), in file and line order;
* ``number_rows``: rows in the order of given columns; these are sorted into
  a stored table first (one range shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossframe.session import persist_table

#: Files or blocks whose offsets are broadcast to the rows (some 100 bytes each); beyond it rows and offsets are shuffled.
BROADCAST_ROWS = 200_000

FILE, BLOCK, POSITION = "_lf_file", "_lf_block", "_lf_pos"


def _offsets(df: DataFrame, keys: list[str], order, name: str, low: str | None = None) -> DataFrame:
    """(keys, name): rows before each key's run, from one count per key, less the key's lowest ``low`` if given. The keys (files
    or file blocks, never rows) are summed up on the driver and broadcast to the rows: Spark does not know the size of such a table
    and would shuffle all rows by their file, of which there are few."""
    measures = [F.count(F.lit(1)).alias("n"), *([F.min(low).alias("low")] if low else [])]
    counted = df.groupBy(*keys).agg(*measures).collect()
    rows, before = [], 0
    for r in sorted(counted, key=order):
        rows.append((*[r[k] for k in keys], before - (r["low"] if low else 0)))
        before += r["n"]
    kinds = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]
    out = df.sparkSession.createDataFrame(rows, ", ".join([*kinds, f"`{name}` long"]))
    return F.broadcast(out) if len(rows) <= BROADCAST_ROWS else out


def _part_number(file: str) -> tuple[int, str]:
    """Writer's files sort by part number, also beyond five digits."""
    digits = file.removeprefix("part-").split("-")[0]
    return (int(digits) if digits.isdigit() else -1, file)


def number_stored(stored: DataFrame, name: str = "row_id") -> DataFrame:
    """``name`` = 1..n over a DataFrame read straight from Parquet, in the order of its part files and rows."""
    tagged = stored.select("*", F.col("_metadata.file_name").alias(FILE), F.col("_metadata.row_index").alias(POSITION))
    offsets = _offsets(tagged, [FILE], lambda r: _part_number(r[FILE]), "_lf_before")
    rid = (F.col("_lf_before") + F.col(POSITION) + 1).cast("long")
    return tagged.join(offsets, FILE).withColumn(name, rid).drop(FILE, POSITION, "_lf_before")


def number_by_position(df: DataFrame, name: str = "row_id", files: list[str] | None = None) -> DataFrame:
    """``name`` = 1..n in the order of ``files`` (paths; without it by path), then file block, then line.

    ``df`` carries ``FILE``, ``BLOCK`` and ``POSITION`` from the scan. It is stored once, so the positions
    cannot change between the count and the use.
    """
    place = {f: i for i, f in enumerate(files or [])}
    stored = persist_table(df, "numbered")
    # rows of a block keep their order in the stored table: the lowest position is its first row
    offsets = _offsets(stored, [FILE, BLOCK], lambda r: (place.get(r[FILE], len(place)), r[FILE], r[BLOCK]), "_lf_before", POSITION)
    rid = (F.col("_lf_before") + F.col(POSITION) + 1).cast("long")
    return stored.join(offsets, [FILE, BLOCK]).withColumn(name, rid).drop(FILE, BLOCK, POSITION, "_lf_before")


def number_rows(df: DataFrame, order_cols: list, name: str = "row_id", num_partitions: int | None = None) -> DataFrame:
    """``name`` = 1..n following ``order_cols``; ties follow input order.

    The input position (taken before any shuffle, so a rerun of a scan task
    gives the same value) is the last sort key. It makes the order total and
    lets the range partitioner split a hot tie, e.g. a third of all rows
    sharing one key or being exact copies, across many partitions instead
    of sorting it in one task. The range partitioner samples by evaluating
    the input, so pass a stored or cheap one.
    """
    n = num_partitions or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [*order_cols, "_lf_seq"]
    ranged = (df.withColumn("_lf_seq", F.monotonically_increasing_id())
              .repartitionByRange(n, *order).sortWithinPartitions(*order).drop("_lf_seq"))
    return number_stored(persist_table(ranged, "ordered"), name)


__all__ = ["number_rows", "number_stored", "number_by_position", "FILE", "BLOCK", "POSITION"]
