"""Tables from document-layout JSON (an OCR service's analysis result).

Each JSON document holds ``analyzeResult.tables[]`` with ``rowCount``,
``columnCount``, ``cells[]`` (row/column index, content or text, spans) and
``boundingRegions[].pageNumber``. A cell is a rectangle, clipped to its table;
a position takes the first non-blank cell, in cell order, that covers it.

Rectangles are resolved by intervals, never by positions: the rows at which a
cell begins or ends cut a table into bands, and likewise its columns. A cell
without spans lies in one band each way; only a spanning one looks through the
table's bands. So a span costs as much as the cells that begin inside it, however
long it is. One aggregate by table and row band collects the cells of a band (no more
than the table has for it), a sweep over the columns fills them in, and the bands are
then unrolled into rows: as many as ``rowCount`` says, blank ones included.

Defined cases: a missing or null index or a negative one puts a cell outside; spans
below 1 count as 1; blank cells fill nothing; tables without rows, columns or cells
have no rows, nor has a document that is null or no layout JSON; documents with one
id are kept apart by their contents, equal ones repeat their rows; a table of more
than ``max_positions`` positions is an error that names the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELL = T.StructType([
    T.StructField("rowIndex", T.IntegerType()), T.StructField("columnIndex", T.IntegerType()),
    T.StructField("content", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("rowSpan", T.IntegerType()), T.StructField("columnSpan", T.IntegerType()),
])
TABLE = T.StructType([
    T.StructField("rowCount", T.IntegerType()), T.StructField("columnCount", T.IntegerType()),
    T.StructField("cells", T.ArrayType(CELL)),
    T.StructField("boundingRegions", T.ArrayType(T.StructType([T.StructField("pageNumber", T.IntegerType())]))),
])
LAYOUT = T.StructType([T.StructField("analyzeResult", T.StructType([
    T.StructField("tables", T.ArrayType(TABLE))]))])


#: Positions (rows times columns) from which a table's counts are taken for an error of the layout service.
MAX_POSITIONS = 100_000_000


def _bands(count: Column, cells: Column, low: str, high: str) -> Column:
    """(at, until) of the runs of rows (or columns) between which no cell begins or ends; they cover the whole table."""
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), count), F.transform(cells, lambda c: c[low]),
                                                  F.transform(cells, lambda c: c[high]))))
    starts = F.slice(cuts, F.lit(1), F.size(cuts) - 1)
    return F.transform(starts, lambda x, i: F.struct(x.alias("at"), F.get(cuts, i + 1).alias("until")))


def _covered(bands: Column, low: Column, high: Column) -> Column:
    """The bands from ``low`` to ``high``; a run of one is its own band."""
    one = F.array(F.struct(low.alias("at"), high.alias("until")))
    return F.when(high - low == 1, one).otherwise(F.filter(bands, lambda b: (b["at"] >= low) & (b["at"] < high)))


def layout_rows(docs: DataFrame, json_col: str = "json", doc_col: str = "doc_id",
                max_positions: int = MAX_POSITIONS) -> DataFrame:
    """``(doc, table_no, row_no, cells, source_page)``: every table row with its cells as one array."""
    parsed = docs.select(F.col(doc_col).alias("doc"), F.md5(F.col(json_col).cast("binary")).alias("part"),
                         F.from_json(F.col(json_col), LAYOUT).alias("j"))
    tables = (parsed.select("doc", "part", F.posexplode("j.analyzeResult.tables").alias("table_no", "t"))
              .select("doc", "part", "table_no", F.col("t.rowCount").cast("long").alias("nr"), F.col("t.columnCount").cast("long").alias("nc"),
                      F.col("t.cells").alias("cells"), F.col("t.boundingRegions")[0]["pageNumber"].alias("source_page"))
              .where((F.col("nr") > 0) & (F.col("nc") > 0) & (F.size("cells") > 0)))
    wrong = F.raise_error(F.concat(F.lit("layout document "), F.coalesce(F.col("doc").cast("string"), F.lit("NULL")), F.lit(", table "),
                                   F.col("table_no"), F.lit(": "), F.col("nr"), F.lit(" rows of "), F.col("nc"),
                                   F.lit(f" columns are more than max_positions={max_positions}"))).cast("long")
    tables = tables.withColumn("nr", F.when(F.col("nr") * F.col("nc") > max_positions, wrong).otherwise(F.col("nr")))

    def clipped(c: Column, i: Column) -> Column:
        def end(index: str, span: str, count: str) -> Column:
            return F.least(c[index].cast("long") + F.greatest(F.lit(1), F.coalesce(c[span], F.lit(1))), F.col(count))

        return F.struct(i.alias("no"), F.coalesce(c["content"], c["text"], F.lit("")).alias("value"),
                        c["rowIndex"].cast("long").alias("r0"), end("rowIndex", "rowSpan", "nr").alias("r1"),
                        c["columnIndex"].cast("long").alias("c0"), end("columnIndex", "columnSpan", "nc").alias("c1"))

    def inside(c: Column) -> Column:
        return F.coalesce((c["value"] != "") & (c["r0"] >= 0) & (c["r0"] < F.col("nr")) & (c["c0"] >= 0) & (c["c0"] < F.col("nc")),
                          F.lit(False))

    key = ["doc", "part", "table_no"]
    tables = tables.withColumn("cells", F.filter(F.transform("cells", clipped), inside))
    tables = (tables.withColumn("bands", _bands(F.col("nr"), F.col("cells"), "r0", "r1"))
              .withColumn("columns", _bands(F.col("nc"), F.col("cells"), "c0", "c1")))
    pieces = F.transform("cells", lambda c: F.struct(c["no"].alias("no"), c["value"].alias("value"),
                                                     _covered(F.col("bands"), c["r0"], c["r1"]).alias("rows"),
                                                     _covered(F.col("columns"), c["c0"], c["c1"]).alias("columns")))
    placed = (tables.select(*key, F.explode(pieces).alias("p"))
              .select(*key, F.explode("p.rows.at").alias("at"), "p.no", "p.value", "p.columns")
              .groupBy(*key, "at").agg(F.collect_set(F.struct("no", "value", "columns")).alias("met")))
    runs = F.array_sort(F.flatten(F.transform("met", lambda m: F.transform(m["columns"], lambda b: F.struct(
        b["at"].alias("at"), m["no"].alias("no"), b["until"].alias("until"), m["value"].alias("value"))))))
    first = F.filter(F.col("runs"), lambda r, i: (i == 0) | (r["at"] != F.get(F.col("runs"), i - 1)["at"]))
    filled = F.flatten(F.transform("runs", lambda r, i: F.concat(
        _blank(r["at"] - F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("runs"), i - 1)["until"])),
        F.array_repeat(r["value"], (r["until"] - r["at"]).cast("int")))))
    lines = (placed.withColumn("runs", runs).withColumn("runs", first)
             .select(*key, "at", F.element_at("runs", -1)["until"].alias("reach"), filled.alias("filled")))
    bands = tables.select(*key, "nc", "source_page", F.explode("bands").alias("b")).select(
        *key, "nc", "source_page", F.col("b.at").alias("at"), F.col("b.until").alias("until"))
    cells = F.when(F.col("filled").isNull(), _blank(F.col("nc"))).otherwise(F.concat("filled", _blank(F.col("nc") - F.col("reach"))))
    # a null id is an id like any other
    same = F.lit(True)
    for k in [*key, "at"]:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"l.{k}"))
    return (bands.alias("a").join(lines.alias("l"), same, "left").select("a.*", "filled", "reach")
            .select(F.col("doc").alias(doc_col), "table_no", F.explode(F.sequence("at", F.col("until") - 1)).alias("row_no"),
                    cells.alias("cells"), "source_page")
            .withColumn("row_no", F.col("row_no").cast("int")))


def _blank(n: Column) -> Column:
    return F.array_repeat(F.lit(""), n.cast("int"))


def layout_cells(docs: DataFrame, json_col: str = "json", doc_col: str = "doc_id",
                 max_positions: int = MAX_POSITIONS) -> DataFrame:
    """Long form: ``(doc, table_no, row_no, col_no, value, source_page)`` for every grid position."""
    rows = layout_rows(docs, json_col, doc_col, max_positions)
    return (rows.select(doc_col, "table_no", "row_no", F.posexplode("cells").alias("col_no", "value"), "source_page")
            .select(doc_col, "table_no", "row_no", "col_no", "value", "source_page"))


def layout_tables(docs: DataFrame, json_col: str = "json", doc_col: str = "doc_id",
                  max_columns: int | None = None, max_positions: int = MAX_POSITIONS) -> DataFrame:
    """Wide form: one row per table row, columns ``V1..Vn`` (NULL beyond a
    table's own width), plus ``table_no``, ``row_no`` and ``source_page``.

    The width is that of the widest table (one scalar aggregate over the counts).
    ``max_columns`` asks for at least so many columns; a wider table is an error, never cut."""
    parsed = docs.select(F.explode(F.from_json(F.col(json_col), LAYOUT)["analyzeResult"]["tables"]).alias("t"))
    known = parsed.where("t.rowCount > 0 AND t.columnCount > 0 AND size(t.cells) > 0")
    width = known.agg(F.max("t.columnCount")).first()[0] or 0
    if max_columns is not None and width > max_columns:
        raise ValueError(f"a table has {width} columns, more than max_columns={max_columns}")
    if width > MAX_WIDTH:
        name = docs.where(F.exists(F.from_json(F.col(json_col), LAYOUT)["analyzeResult"]["tables"],
                                   lambda t: t["columnCount"] == width)).select(doc_col).first()[0]
        raise ValueError(f"layout document {name}: a table of {width} columns is more than {MAX_WIDTH}")
    rows = layout_rows(docs, json_col, doc_col, max_positions)
    return rows.select(doc_col, "table_no", "row_no", *[F.get("cells", F.lit(i)).alias(f"V{i + 1}") for i in range(max(width, max_columns or 0))],
                       F.col("source_page").alias("..source_page.."))


#: Columns that a wide table may have; the long form has no such bound.
MAX_WIDTH = 10_000
