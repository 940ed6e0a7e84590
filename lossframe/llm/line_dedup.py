r"""Near-duplicate lines by an exact set-similarity join, in DataFrame functions only.

A line (\n-split) is the set of its words. A word's place in the global order
is its rarity, then its hash; rarity is the frequency of its hash bucket over
all documents in half powers of two, from a table of fixed size (four million
buckets, so that a rare word seldom shares one with a frequent word). Lines with equal sets are one
class with the first occurrence in front. Two sets at the similarity share a
word among their rarest ones; classes meet on those prefix words, within the
size bounds, and only where the words that can still follow reach the needed
overlap (positional filter) and the sets' 64-bit sketches, one bit a word, do
not differ in more bits than the sets may differ in words.

A line goes if an earlier line of the corpus has the similarity, whether that
one is kept or not. So one witness is enough: under the frequent prefix words
every class is first held against the earliest one of the word (linear in the
group); what that leaves is joined with all earlier ones, from one exchange of
the prefix words. Every pair is verified
on the full sets.

Defined cases: null text counts as empty; lines of fewer than ``min_words``
distinct words are always kept; a null id takes no part; rows that share an id
are one document whose lines at the same place are the same line; an empty
table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossframe.llm.common import id_and_text
from lossframe.session import persist_table, release_tables, stored_tables

#: Hash buckets of the frequency table: its size is fixed, one byte each, whatever the corpus.
BUCKETS = 1 << 22
#: Runs of buckets that one row of the table's making holds.
RUN = 4096
#: A prefix word of this level (it occurs 512 times or oftener) is frequent.
FREQUENT = 19
#: A 64-bit sketch of a word set: each word sets the bit that six bits of its hash name.
SKETCH = "aggregate(w, 0L, (s, x) -> s | shiftleft(1L, CAST({of} & 63 AS INT)))"
FIRST_BITS, SECOND_BITS = SKETCH.format(of="x"), SKETCH.format(of="shiftright(x, 6)")


def words_of(text: str) -> str:
    """SQL of the words of a text, empty ones among them: all breaks become blanks, for which Java needs no pattern to split."""
    for code in ("000A", "0009", "000B", "000C", "000D"):
        text = f"replace({text}, '\\u{code}', ' ')"  # SQL turns the escapes into the characters
    return f"split({text}, ' ')"


def frequency_levels(docs: DataFrame) -> DataFrame:
    """One row: a byte for each hash bucket, the frequency of its words over all documents in half powers of two."""
    words = docs.select(F.explode(F.expr(words_of("text"))).alias("w")).where("w <> ''")
    counts = words.groupBy(F.expr(f"CAST(xxhash64(w) & {BUCKETS - 1} AS INT)").alias("bucket")).count()
    known = counts.select(F.expr(f"bucket div {RUN}").cast("int").alias("run"), F.expr(f"bucket % {RUN}").alias("at"),
                          F.expr("CAST(least(127, 1 + floor(2 * log2(count))) AS TINYINT)").alias("level"))
    every = docs.sparkSession.range(BUCKETS // RUN).select(F.col("id").cast("int").alias("run"))
    runs = every.join(known.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("at", "level"))).alias("own")), "run", "left")
    one = "CAST(1 AS TINYINT)"
    # own buckets in order, ones between them and behind the last
    dense = F.expr(f"""IF(own IS NULL, array_repeat({one}, {RUN}), concat(
        flatten(transform(own, (x, i) -> concat(array_repeat({one}, x.at - IF(i = 0, 0, get(own, i - 1).at + 1)), array(x.level)))),
        array_repeat({one}, {RUN} - 1 - element_at(own, -1).at)))""")
    table = runs.select("run", dense.alias("levels")).agg(F.array_sort(F.collect_list(F.struct("run", "levels"))).alias("r"))
    return persist_table(table.select(F.flatten(F.col("r.levels")).alias("levels")), "levels")


def ordered_words(df: DataFrame, line: str, levels: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and w: the set of a line's words as ascending longs, level of frequency in the upper bits, then the hash."""
    hashed = df.select(*keep, F.expr(f"array_remove(array_distinct(transform({words_of(line)}, w -> xxhash64(w))), "
                                     "xxhash64(''))").alias("h"))
    # the table is a scalar subquery, read once a query; the optimizer moves it into the function, so no row carries it
    hashed = hashed.withColumn("_levels", levels.scalar())
    return hashed.select(*keep, F.sort_array(F.transform("h", lambda h: F.shiftleft(
        F.get("_levels", h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")).cast("long"), 56).bitwiseOR(F.shiftrightunsigned(h, 8)))).alias("w"))


def similar_lines(docs: DataFrame, percent: int = 90, min_words: int = 1) -> tuple[DataFrame, DataFrame]:
    """(lines: doc_id, line, n, k1, k2; removed: doc_id, line, similar) of the documents with an id.

    ``similar`` is false where the line's set itself stands earlier.
    """
    levels = frequency_levels(docs)
    split = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    words = ordered_words(split, "s", levels, "doc_id", "line")
    n = F.size("w")
    # a set's most alike other set has one word more; where that is too little, only equal sets count
    size = n.cast("long")  # products of sizes are longs: no size is capped
    pairs_up = (n >= min_words) & (100 * size >= percent * (size + 1))
    prefix = F.slice("w", F.lit(1), F.when(pairs_up, n - F.ceil(size * percent / 100).cast("int") + 1).otherwise(0))
    # a bit for each word: sets differ in at least as many words as their bits do
    bits = F.when(pairs_up, F.expr(FIRST_BITS))
    lines = persist_table(words.select("doc_id", "line", n.alias("n"), F.xxhash64("w").alias("k1"), F.hash("w").alias("k2"),
                                       prefix.alias("prefix"), bits.alias("bits")), "lines")

    own = lines.where(F.col("n") >= min_words)
    key = ["k1", "k2"]
    classes = persist_table(own.groupBy(*key).agg(F.min(F.struct("doc_id", "line", "n")).alias("first"),
                                                  F.any_value("prefix").alias("prefix"),
                                                  F.any_value("bits").alias("bits")), "classes")
    heads = classes.where(F.size("prefix") > 0).select(F.col("first.doc_id").alias("doc_id"), F.col("first.line").alias("line"),
                                                       F.col("first.n").cast("long").alias("n"), "bits", "prefix")

    def spread(df: DataFrame, *more: str) -> DataFrame:
        return df.select("doc_id", "line", "n", "bits", *more, F.posexplode("prefix").alias("pos", "t"))

    often = spread(heads.where(F.exists("prefix", lambda t: F.shiftrightunsigned(t, 56) >= FREQUENT))).where(
        F.shiftrightunsigned("t", 56) >= FREQUENT)
    lead = often.groupBy("t").agg(F.min(F.struct("doc_id", "line", "n", "pos", "bits")).alias("e"))
    pairs = _pairs(often, lead.select("t", "e.*"), percent).distinct()
    found = _verified(docs, persist_table(pairs, "pairs"), levels, percent)
    # both sides of the join are one exchange: they differ in nothing, and ``late`` is judged with a column of the other side
    open_ = heads.join(found.withColumn("hit", F.lit(True)), ["doc_id", "line"], "left").withColumn(
        "late", F.when(F.col("hit"), 0).otherwise(1)).drop("hit")
    every = spread(open_, "late")
    pairs = _pairs(every, every, percent, " AND a.late * 2 > e.late").distinct()
    found = found.union(_verified(docs, persist_table(pairs, "pairs"), levels, percent))

    front = classes.select(*key, F.col("first.doc_id").alias("f_doc"), F.col("first.line").alias("f_line"))
    gone = found.select(F.col("doc_id").alias("f_doc"), F.col("line").alias("f_line"), F.lit(True).alias("hit"))
    met = own.select("doc_id", "line", *key).join(front.join(gone, ["f_doc", "f_line"], "left"), key)
    removed = (met.withColumn("again", (F.col("doc_id") != F.col("f_doc")) | (F.col("line") != F.col("f_line")))
               .where("again OR hit").select("doc_id", "line", (~F.col("again")).alias("similar")))
    return lines.select("doc_id", "line", "n", *key), removed


def _pairs(late: DataFrame, early: DataFrame, percent: int, more: str = "") -> DataFrame:
    """doc_id, line, e_doc, e_line: pairs that meet on a prefix word and pass the size and positional filters.

    Of two sets the smaller one needs only its first n - ceil(2 t / (1 + t) n) + 1 words; t = percent / 100.
    """
    a, e, s = late.alias("a"), early.alias("e"), 100 + percent
    need = f"(({percent} * (a.n + e.n) + {s - 1}) div {s})"  # different sets of one size share less than all
    return (a.join(e, F.expr(f"""
        a.t = e.t AND (e.doc_id < a.doc_id OR (e.doc_id = a.doc_id AND e.line < a.line)){more}
        AND 100 * least(a.n, e.n) >= {percent} * greatest(a.n, e.n)
        AND IF(a.n < e.n, a.pos, e.pos) <= least(a.n, e.n) - ((2 * {percent} * least(a.n, e.n) + {s - 1}) div {s})
        AND {need} <= least(a.n, e.n) - IF(a.n = e.n, 1, 0)
        AND 1 + least(a.n - a.pos - 1, e.n - e.pos - 1) >= {need}
        AND bit_count(a.bits ^ e.bits) <= a.n + e.n - 2 * {need}"""))
        .select("a.doc_id", "a.line", F.col("e.doc_id").alias("e_doc"), F.col("e.line").alias("e_line")))


#: Lines whose numbers are broadcast to find their texts (at most some 30 MB); beyond it the texts are shuffled to them.
BROADCAST_LINES = 500_000


def _verified(docs: DataFrame, pairs: DataFrame, levels: DataFrame, percent: int) -> DataFrame:
    """doc_id, line of the later ones of the (stored) pairs whose full sets have the similarity; stored, what it takes is released."""
    spark = docs.sparkSession
    held = pairs.inputFiles()
    before = set(stored_tables(spark))
    needed = persist_table(pairs.select("doc_id", "line").union(pairs.select("e_doc", "e_line")).distinct(), "needed")
    every = F.posexplode(F.split("text", "\n")).alias("line", "s")
    if needed.count() <= BROADCAST_LINES:
        own = docs.join(F.broadcast(needed.select("doc_id").distinct()), "doc_id")
        lines = own.select("doc_id", every).join(F.broadcast(needed), ["doc_id", "line"])
    else:
        by_doc = needed.groupBy("doc_id").agg(F.collect_set("line").alias("own"))  # bounded by the document
        lines = docs.join(by_doc, "doc_id").select("doc_id", "own", every).where(F.array_contains("own", F.col("line")))
    words = ordered_words(lines, "s", levels, "doc_id", "line")
    sets = persist_table(words.withColumn("bits", F.expr(SECOND_BITS)).withColumn("n", F.size("w").cast("long")), "sets")
    early = ["e_doc", "e_line"]
    light = sets.select("doc_id", "line", "n", "bits")
    # a second sketch, from other bits, before the full sets are moved
    near = (pairs.join(light.withColumnsRenamed({"n": "a_n", "bits": "a_bits"}), ["doc_id", "line"])
            .join(light.toDF("e_doc", "e_line", "e_n", "e_bits"), early)
            .where(F.expr(f"bit_count(a_bits ^ e_bits) <= a_n + e_n - 2 * (({percent} * (a_n + e_n) + {99 + percent}) "
                          f"div {100 + percent})")).select("doc_id", "line", *early))
    full = sets.select("doc_id", "line", "w")
    both = near.join(full.withColumnRenamed("w", "a"), ["doc_id", "line"]).join(full.toDF("e_doc", "e_line", "e"), early)
    i = F.size(F.array_intersect("a", "e")).cast("long")
    out = persist_table(both.where(100 * i >= percent * (F.size("a") + F.size("e") - i)).select("doc_id", "line").distinct(), "similar")
    mine = [p for p in stored_tables(spark) if (p not in before and "/similar-" not in p) or any(f"{p.split('/')[-1]}/" in x for x in held)]
    release_tables(spark, mine)
    return out


def _with_id(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_and_text(docs, id_col, text_col).where("doc_id IS NOT NULL")


def line_report(docs: DataFrame, percent: int = 90, min_words: int = 1, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_equal, n_similar, removed_lines (numbers from 0, comma-joined) of every document."""
    lines, removed = similar_lines(_with_id(docs, id_col, text_col), percent, min_words)
    counts = lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))
    gone = removed.groupBy("doc_id").agg(
        F.count_if(~F.col("similar")).alias("n_equal"), F.count_if("similar").alias("n_similar"),
        F.array_join(F.transform(F.array_sort(F.collect_set("line")), lambda x: x.cast("string")), ",").alias("removed_lines"))
    none = (id_and_text(docs, id_col, text_col).where("doc_id IS NULL")
            .select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_equal"),
                    F.lit(0).cast("long").alias("n_similar"), F.lit("").alias("removed_lines")))
    return (counts.join(gone, "doc_id", "left").select(
        "doc_id", "n_lines", F.coalesce("n_equal", F.lit(0)).alias("n_equal"),
        F.coalesce("n_similar", F.lit(0)).alias("n_similar"), F.coalesce("removed_lines", F.lit("")).alias("removed_lines"))
        .unionByName(none))


def drop_lines(docs: DataFrame, percent: int = 90, min_words: int = 1, length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` (doc_id, text, any others) without the later lines; documents that lose their last word go.

    The length column, if any, is renewed where the text changes. A null text and rows without an id stay as they are.
    """
    _, removed = similar_lines(_with_id(docs, "doc_id", "text"), percent, min_words)
    gone = removed.groupBy("doc_id").agg(F.collect_set("line").alias("_gone"))  # bounded by the document
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda s, i: ~F.array_contains("_gone", i)), "\n")
    hit = F.col("_gone").isNotNull() & F.col("text").isNotNull()
    changed = docs.join(gone.withColumnRenamed("doc_id", "_id"), docs["doc_id"] == F.col("_id"), "left").withColumn("_hit", hit)
    out = changed.withColumn("text", F.when(F.col("_hit"), kept).otherwise(F.col("text")))
    out = out.where(~F.col("_hit") | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    if length_col and length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.when(F.col("_hit"), F.length("text").cast(kind)).otherwise(F.col(length_col)))
    return out.select(*docs.columns)
