"""File intake.

Uploaded loss runs are read by Spark's own file sources, one task per file
split; the driver reads file listings, header lines and first bytes. Per-file
lineage comes from the hidden ``_metadata`` column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lossframe.constants import ALLOWED_EXTENSIONS, HEADER_PROMOTE_FRACTION, TEXT_MIN_CHARS
from lossframe.operators.numbering import BLOCK, FILE, POSITION
from lossframe.sources.csv_intake import BROADCAST_CELLS, all_names, by_place, csv_files, csv_rows


def read_heads(spark: SparkSession, paths: list[str], n_bytes: int) -> dict[str, bytes]:
    """The first bytes of each file, opened by Spark's file system client; no file is read further."""
    from concurrent.futures import ThreadPoolExecutor

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def head(path: str) -> bytes:
        p = jvm.org.apache.hadoop.fs.Path(path)
        stream = p.getFileSystem(conf).open(p)
        try:
            return bytes(stream.readNBytes(n_bytes))
        finally:
            stream.close()

    with ThreadPoolExecutor(16) as pool:
        return dict(zip(paths, pool.map(head, paths)))


def read_csv(spark: SparkSession, paths: str | list[str], with_lineage: bool = True, multi_line: bool = True,
             with_position: bool = False) -> DataFrame:
    """S1 + S2: header CSVs read as all-string columns, whitespace-trimmed, united by column name (of any case).

    Empty cells and the text ``NA`` become NULL. Each file is read in its own dialect and by its own header line; columns missing
    from a file are NULL. Doubled quotes and (with ``multi_line``, off for files known to have none, which Spark can then split)
    line breaks inside quotes are part of a cell. Records with more cells than their header are not among the rows but in
    ``csv_intake.csv_rejects``. Adds ``source_file`` (base name) per row, and with ``with_position`` where the row stands
    (see ``numbering``).
    """
    files = csv_files(spark, paths)
    names, places = all_names(files)
    rows = by_place(csv_rows(spark, files, multi_line), FILE, places, names)
    lineage = (["source_file"] if with_lineage else []) + ([FILE, BLOCK, POSITION] if with_position else [])
    return rows.select(*[F.col(f"`{n}`") for n in names], *lineage)


def union_files(frames: list[DataFrame]) -> DataFrame:
    """Union by column name; columns missing from a file become NULL."""
    if not frames:
        raise ValueError("no frames to union")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


# ---------------------------------------------------------------------------
# File checks (listing, and the first bytes of acceptable files)
# ---------------------------------------------------------------------------

def _ext(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1))


SIGNATURE_BYTES = 8
CHECK_SCHEMA = "path string, ext string, length long, detected string, ok boolean, reason string"


def _detected(head: bytes) -> str:
    for kind, magic in (("pdf", b"%PDF-"), ("zip", b"PK"), ("ole", bytes.fromhex("D0CF11E0A1B11AE1"))):
        if head.startswith(magic):
            return kind
    return "other"


#: Signatures that each extension may have.
SIGNATURES = {"pdf": {"pdf"}, "xlsx": {"zip"}, "xls": {"ole", "zip"}, "csv": {"ole", "other"}}


def file_checks(spark: SparkSession, path_glob: str | list[str], max_mb: float | None = None) -> DataFrame:
    """S3 + S4: extension filter, size guard (``max_mb``; none by default) and signature-vs-extension check.

    Returns ``(path, ext, length, detected, ok, reason)`` per file. The listing gives path and length; of files that
    pass the first two guards only the first bytes are read, and a rejected file is never opened.
    """
    listed = []
    for p in [path_glob] if isinstance(path_glob, str) else path_glob:
        listed += [(r["path"], r["ext"], r["length"]) for r in spark.read.format("binaryFile").load(p)
                   .select("path", _ext(F.col("path")).alias("ext"), "length").collect()]
    cap = None if max_mb is None else int(max_mb * 1024 * 1024)

    def early(ext: str, length: int) -> str | None:
        if ext not in ALLOWED_EXTENSIONS:
            return "unsupported type"
        return "file too large" if cap is not None and length > cap else None

    heads = read_heads(spark, [p for p, ext, n in listed if early(ext, n) is None], SIGNATURE_BYTES)
    rows = []
    for path, ext, length in listed:
        kind = _detected(heads[path]) if path in heads else None
        reason = early(ext, length)
        if reason is None and kind not in SIGNATURES[ext]:
            reason = "file signature does not match the extension"
        rows.append((path, ext, length, kind, reason is None, reason))
    return spark.createDataFrame(rows, CHECK_SCHEMA)


def content_hash_dups(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """Contents seen more than once, by SHA-256 (one hash aggregate)."""
    return (df.where(F.col(content_col).isNotNull())
            .select(F.col(id_col), F.sha2(F.col(content_col), 256).alias("content_hash"))
            .groupBy("content_hash")
            .agg(F.count(F.lit(1)).alias("n_docs"), F.min(id_col).alias("first_doc_id"))
            .where(F.col("n_docs") > 1))


def file_hashes(spark: SparkSession, path_glob: str) -> DataFrame:
    """S5 over files: ``(path, sha256)`` computed in the scan tasks."""
    return spark.read.format("binaryFile").load(path_glob).select("path", F.sha2("content", 256).alias("sha256"))


def text_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Split text into lines (a trailing newline adds no empty line; empty text has no lines)."""
    parts = F.split(F.col(text_col), "\n", -1)
    parts = F.when(F.col(text_col).endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return (df.where(F.col(text_col) != "")
            .select(F.col(id_col), F.posexplode(parts).alias("pos", "line"))
            .select(id_col, (F.col("pos") + 1).cast("long").alias("line_no"), "line"))


NONSPACE = "[\\t\\n\\x0B\\f\\r ]+"


def text_sufficiency(df: DataFrame, id_col: str, text_col: str, min_chars: int = TEXT_MIN_CHARS) -> DataFrame:
    """Non-whitespace characters and whether they reach ``min_chars``."""
    n = F.length(F.regexp_replace(F.col(text_col), NONSPACE, "")).cast("long")
    return df.select(F.col(id_col), n.alias("nonspace_chars"), (n >= min_chars).alias("has_text"))


# ---------------------------------------------------------------------------
# Header promotion
# ---------------------------------------------------------------------------

def promotes(cells: list[str], width: int) -> bool:
    """Whether a first row of so many columns is a header: enough of its cells are not empty."""
    return sum(c != "" for c in cells) >= max(2, int(HEADER_PROMOTE_FRACTION * width))


def promote_header(df: DataFrame, enabled: bool = True, order_col: str | None = None,
                   file_col: str | None = None) -> DataFrame:
    """When the first row of a file has enough non-empty cells
    (>= max(2, floor(0.6 * ncol))) use it as that file's header and drop it.

    ``order_col`` gives the row order, ``file_col`` the file (without it, all rows are one file). The first row of each
    file is found by one grouped minimum, so one row for a file reaches the driver. The rows are then scanned once, as
    arrays of text cells, and each column is the cell at its file's place for the name, however many headers there are. A row
    without an order value is never a header and stays. A file of one row has no data and keeps it.
    """
    if not enabled:
        return df
    if order_col is None:
        raise ValueError("promote_header needs the column that gives file order")
    lineage = [c for c in (order_col, file_col, "source_file") if c in df.columns]
    data = [c for c in df.columns if c not in lineage]
    file = F.col(f"`{file_col}`") if file_col else F.lit(0)
    text = F.array(*[F.col(f"`{c}`").cast("string") for c in data])
    cells = F.struct(F.col(f"`{order_col}`").alias("_at"), text.alias("_row"))
    firsts = (df.groupBy(file.alias("_file")).agg(F.count(F.lit(1)).alias("n"),
                                                  F.min_by(cells, F.col(f"`{order_col}`")).alias("first")).collect())
    names: dict[str, None] = {}
    places, heads = {}, []
    for r in firsts:
        row = [] if r["first"] is None else ["" if v is None else v.strip() for v in r["first"]["_row"]]
        own = data
        if r["n"] >= 2 and row and promotes(row, len(data)):
            own = make_names(row)
            heads.append((r["_file"], r["first"]["_at"]))
        places[r["_file"]] = {n: i for i, n in enumerate(own)}
        names |= dict.fromkeys(own)
    if not heads:
        return df
    tagged = df.select(*[F.col(f"`{c}`") for c in lineage], file.alias("_lf_file"), text.alias("cells"))
    kinds = {k: tagged.schema[k].dataType.simpleString() for k in ("_lf_file", order_col)}
    head = df.sparkSession.createDataFrame(heads, f"_h_file {kinds['_lf_file']}, _h_at {kinds[order_col]}")
    if len(heads) <= BROADCAST_CELLS:
        head = F.broadcast(head)
    same = F.col("_lf_file").eqNullSafe(F.col("_h_file")) & (F.col(f"`{order_col}`") == F.col("_h_at"))
    placed = by_place(tagged.join(head, same, "left_anti"), "_lf_file", places, list(names))
    return placed.select(*[F.col(f"`{c}`") for c in [*lineage, *names]])


def make_names(names: list[str]) -> list[str]:
    """Syntactic, unique column names (make.names(unique = TRUE))."""
    import re
    out, seen = [], {}
    for n in names:
        x = re.sub(r"[^A-Za-z0-9._]", ".", n) or "X"
        if not re.match(r"^([A-Za-z]|\.[A-Za-z._]|\.$)", x):
            x = "X" + x
        base, k = x, seen.get(x, 0)
        while x in seen:
            k += 1
            x = f"{base}.{k}"
        seen[base] = k
        seen[x] = 0
        out.append(x)
    return out
