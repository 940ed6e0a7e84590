"""CSV files with headers of their own, read by position.

The driver reads the first bytes of each file: they give its dialect (by a vote over delimiters and quotes) and its
header. Files are then scanned as rows of cells, together where dialect and number of columns agree, so the plan has
one scan for each such pair and not one for each header. A small table, a row a file, says where each file keeps a
name; a field is the cell at that place. Ten standard fields or a thousand names cost no further scan.

No cell is lost silently: a record with more cells than its header goes, whole, to the rejects. A shorter one is
read, its missing cells NULL. Rows read and rows rejected together are the records of the files.
"""

from __future__ import annotations

import csv
import io
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lossframe.operators.numbering import BLOCK, FILE, POSITION
from lossframe.session import persist_table

HEADER_BYTES = 1 << 20
DELIMITERS, QUOTES = (",", ";", "\t", "|"), ('"', "'")
#: Records of a file's first bytes that vote on its dialect.
VOTES = 200
NA_STRINGS = ("NA",)
#: Files and places of names that are broadcast to the rows (at most some 40 MB).
BROADCAST_CELLS = 2_000_000


@dataclass(frozen=True)
class CsvFile:
    """A file's path for Spark's readers, the path its rows carry, its dialect and its header."""
    path: str
    tag: str
    delimiter: str
    quote: str
    names: tuple[str, ...]
    promoted: bool = False


def _records(head: bytes, delimiter: str, quote: str, most: int) -> list[list[str]]:
    """The first records that are not blank; the last one is left out where the bytes end inside the file."""
    text = head.decode("utf-8-sig", errors="replace")
    out = []
    for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, quotechar=quote):
        if any(c.strip() for c in r):
            out.append(r)
        if len(out) > most:
            return out[:most]
    return out[:-1] if len(head) >= HEADER_BYTES and len(out) > 1 else out


def detect_dialect(head: bytes) -> tuple[str, str]:
    """(delimiter, quote). The quote is the one that more cells begin with (a double one if equal); the delimiter that under which
    most records have as many cells, more than one, as the header.

    Ties go to the wider reading, then to the order of ``DELIMITERS``. A file of one column is read with commas.
    """
    text = head.decode("utf-8-sig", errors="replace")
    openings = {q: len(re.findall(f"(?:^|[{re.escape(''.join(DELIMITERS))}]) *{q}", text, re.MULTILINE)) for q in QUOTES}
    quote = max(QUOTES, key=lambda q: openings[q])
    best, found = (0.0, 0), DELIMITERS[0]
    for delimiter in DELIMITERS:
        sizes = [len(r) for r in _records(head, delimiter, quote, VOTES)]
        if not sizes or sizes[0] < 2:
            continue
        vote = (sum(n == sizes[0] for n in sizes) / len(sizes), sizes[0])
        if vote > best:
            best, found = vote, delimiter
    return found, quote


def unique_names(cells: Iterable[str]) -> list[str]:
    """Trimmed column names, unlike in any case; a nameless one is ``_c<i>``, a repeated one gets its place as a suffix."""
    out: list[str] = []
    seen: set[str] = set()
    for i, cell in enumerate(cells):
        name = cell.strip() or f"_c{i}"
        while name.lower() in seen:
            name = f"{name}{i}"
        seen.add(name.lower())
        out.append(name)
    return out


def csv_files(spark: SparkSession, paths: str | list[str], promote: bool = False) -> list[CsvFile]:
    """The files that have a header, in the order given (a folder's or pattern's by path).

    ``promote`` takes the first data row as the header where it has enough cells (S8) and a row follows it.
    """
    from lossframe.sources.files import make_names, promotes, read_heads

    tags: dict[str, str] = {}
    for p in [paths] if isinstance(paths, str) else paths:
        listed = spark.read.format("binaryFile").load(p).select("path", F.col("_metadata.file_path").alias("tag"))
        tags |= dict(sorted((r["path"], r["tag"]) for r in listed.collect()))
    out = []
    for path, head in read_heads(spark, list(tags), HEADER_BYTES).items():
        delimiter, quote = detect_dialect(head)
        first = _records(head, delimiter, quote, 3)
        if not first:
            continue
        names, own = unique_names(first[0]), [c.strip() for c in first[1]] if len(first) > 1 else []
        own += [""] * (len(names) - len(own))
        more = len(first) > 2 or len(head) >= HEADER_BYTES
        take = promote and more and promotes(own[:len(names)], len(names))
        out.append(CsvFile(path, tags[path], delimiter, quote, tuple(make_names(own[:len(names)]) if take else names), take))
    if not out:
        raise ValueError(f"no CSV file with a header under {paths}")
    return out


def _n_cells(record: Column, delimiter: str, quote: str) -> Column:
    """Cells of a record: its delimiters outside quoted cells, and one."""
    d, q = ("\\t" if delimiter == "\t" else f"\\{delimiter}" if delimiter == "|" else delimiter), quote
    bare = F.regexp_replace(F.regexp_replace(record, "[\\r\\n]+$", ""), f"(^|{d})\\s*{q}(?:[^{q}]|{q}{q})*{q}", "$1")
    return F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit(""))) + 1


def csv_records(spark: SparkSession, files: list[CsvFile], multi_line: bool = True) -> DataFrame:
    """cells, source_file, ``FILE``, ``BLOCK``, rejected (the record's text, if it has more cells than the header) and
    reason of every record; one scan for each (dialect, number of columns)."""
    groups: dict[tuple, list[str]] = {}
    for f in files:
        groups.setdefault((f.delimiter, f.quote, len(f.names)), []).append(f.path)
    out = None
    for (delimiter, quote, width), own in groups.items():
        places = [f"_p{i}" for i in range(width)]
        schema = T.StructType([T.StructField(c, T.StringType()) for c in [*places, "_record"]])
        df = (spark.read.schema(schema).option("header", True).option("sep", delimiter).option("quote", quote).option("escape", quote)
              .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("multiLine", multi_line)
              .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_record").option("maxColumns", 1 << 16).csv(own))
        n = _n_cells(F.col("_record"), delimiter, quote)
        cells = F.array(*[F.when(~F.col(c).isin(*NA_STRINGS), F.col(c)) for c in places])
        text = F.coalesce("_record", places[0])  # Spark refuses to read the record's text alone, so a cell goes with it
        part = (df.select(cells.alias("cells"), F.when(F.col("_record").isNotNull() & (n > width), text).alias("rejected"),
                          n.alias("n"), F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_path").alias(FILE),
                          F.col("_metadata.file_block_start").alias(BLOCK))
                .select("cells", "rejected", F.when(F.col("rejected").isNotNull(), F.concat(
                    F.col("n").cast("string"), F.lit(f" cells under a header of {width}"))).alias("reason"), "source_file", FILE, BLOCK))
        out = part if out is None else out.unionByName(part)
    return out


def csv_rows(spark: SparkSession, files: list[CsvFile], multi_line: bool = True) -> DataFrame:
    """cells, source_file, ``FILE``, ``BLOCK`` and ``POSITION`` of the records that fit their header; promoted
    header rows are left out."""
    rows = (csv_records(spark, files, multi_line).where(F.col("rejected").isNull())
            .select("cells", "source_file", FILE, BLOCK, F.monotonically_increasing_id().alias(POSITION)))
    heads = [(f.tag,) for f in files if f.promoted]
    if not heads:
        return rows
    # the first row of each such file; a row a file
    chosen = spark.createDataFrame(heads, f"`{FILE}` string")
    if len(heads) <= BROADCAST_CELLS:
        chosen = F.broadcast(chosen)
    first = (rows.join(chosen, FILE, "left_semi").groupBy(FILE)
             .agg(F.min(F.struct(BLOCK, POSITION)).alias("at")).select(FILE, f"at.{BLOCK}", f"at.{POSITION}"))
    return rows.join(first, [FILE, BLOCK, POSITION], "left_anti")


def csv_rejects(spark: SparkSession, paths: str | list[str], multi_line: bool = True) -> DataFrame:
    """source_file, record_no (from 1, counting all records below the header), reason and record of what ``read_csv``
    leaves out."""
    every = csv_records(spark, csv_files(spark, paths), multi_line)
    # stored once, without the cells, so that the places cannot change between count and use
    stored = persist_table(every.select(FILE, BLOCK, "source_file", "rejected", "reason",
                                        F.monotonically_increasing_id().alias(POSITION)), "records")
    blocks = stored.groupBy(FILE, BLOCK).agg(F.min(POSITION).alias("low"), F.count(F.lit(1)).alias("n"))
    earlier = (blocks.alias("a").join(blocks.alias("b"), (F.col(f"a.{FILE}") == F.col(f"b.{FILE}")) & (F.col(f"b.{BLOCK}") < F.col(f"a.{BLOCK}")), "left")
               .groupBy(F.col(f"a.{FILE}").alias(FILE), F.col(f"a.{BLOCK}").alias(BLOCK), F.col("a.low").alias("low"))
               .agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before")))
    return (stored.where(F.col("rejected").isNotNull()).join(earlier, [FILE, BLOCK])
            .select("source_file", (F.col("before") + F.col(POSITION) - F.col("low") + 1).cast("long").alias("record_no"), "reason",
                    F.regexp_replace("rejected", "[\\r\\n]+$", "").alias("record")))


def by_place(rows: DataFrame, key: str, places: dict, names: list[str], cells: str = "cells") -> DataFrame:
    """``rows`` with a column for each name: the cell at the place that the row's key (a file) has for it, else NULL.

    ``places``: key -> {name: place}. Two joined tables, key to layout and layout to its places, whatever the
    number of layouts; the plan does not grow with them. They come from the driver and are broadcast up to ``BROADCAST_CELLS``
    numbers, beyond it the rows are joined by key like any others.
    """
    spark = rows.sparkSession
    layouts: dict[tuple, int] = {}
    of = []
    for k, own in places.items():
        layout = tuple(own.get(n) for n in names)
        of.append((k, layouts.setdefault(layout, len(layouts))))
    kind = rows.schema[key].dataType.simpleString()
    keys = spark.createDataFrame(of, f"_lf_key {kind}, _lf_layout int")
    tables = spark.createDataFrame([(i, list(layout)) for layout, i in layouts.items()], "_lf_layout int, _lf_place array<int>")
    if len(of) + len(layouts) * len(names) <= BROADCAST_CELLS:
        keys, tables = F.broadcast(keys), F.broadcast(tables)
    met = rows.join(keys, F.col(f"`{key}`").eqNullSafe(F.col("_lf_key"))).join(tables, "_lf_layout")
    picked = [F.get(F.col(cells), F.get("_lf_place", F.lit(i))).alias(n) for i, n in enumerate(names)]
    return met.select(*[F.col(f"`{c}`") for c in rows.columns if c != cells], *picked)


def all_names(files: list[CsvFile]) -> tuple[list[str], dict[str, dict[str, int]]]:
    """(every name, in order of first appearance; each file's places). Names that differ in case only are one."""
    spelled: dict[str, str] = {}
    places = {}
    for f in files:
        places[f.tag] = {spelled.setdefault(n.lower(), n): i for i, n in enumerate(f.names)}
    return list(spelled.values()), places


def dialects(files: list[CsvFile]) -> Counter:
    """How many files have each (delimiter, quote)."""
    return Counter((f.delimiter, f.quote) for f in files)
