"""Near-duplicate documents by min-max hashing.

Signatures. A document is its set of distinct word shingles (64-bit hashes).
Under each permutation both the smallest and the largest value are kept, so a
permutation gives two unbiased values for one evaluation; bands of values
from different permutations are the bucket keys.

Classes. Equal sets (size and two set hashes) form a class whose smallest id
stands for it. Only representatives go on.

Links. In each bucket every representative is held against the smallest one
on the full sets: a number of pairs linear in the bucket. Buckets that then
hold several components are finished exactly, without pairing their members:
their documents' shingles are ordered by rarity and joined on prefixes with
length and positional filters, which loses no link at the threshold. Every
link is confirmed on full sets. Components come from star contraction.

Defined cases: null or wordless text is empty and linked with nothing; fewer
words than a shingle give one shingle; a null id is linked with nothing (null
component, kept); rows that share an id are one node, each reported with its
own set size; an empty table gives an empty result; columns other than id and
text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lossframe.llm.common import id_and_text, map_arrow, mix, slices, text_buffers
from lossframe.llm.components import components
from lossframe.llm.shingles import band_keys, bounds_of, min_max_signature, shingle_sets
from lossframe.session import persist_table

#: 60 permutations give 120 values: 40 bands of 3. At similarity 0.75 a pair shares no band with
#: probability (1 - 0.75**3)**40 = 3e-10.
PERMUTATIONS, BAND_ROWS = 60, 3


def signatures(docs: DataFrame, width: int, permutations: int, band_rows: int) -> DataFrame:
    """doc_id, n (set size), s1, s2 (set hashes), bands."""
    bands = 2 * permutations // band_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1):
                raw, offs = text_buffers(part.column(1))
                h, of = shingle_sets(raw, offs, width)
                at = bounds_of(of, part.num_rows)
                n = np.diff(at)
                full = np.flatnonzero(n)
                keys = np.zeros((part.num_rows, bands), np.uint64)
                sums = np.zeros((2, part.num_rows), np.uint64)
                if len(full):
                    keys[full] = band_keys(min_max_signature(h, at[full], permutations), band_rows)
                    sums[0, full] = np.add.reduceat(mix(h), at[full])
                    sums[1, full] = np.add.reduceat(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at[full])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((n > 0) * bands)]), pa.int32()),
                                                 pa.array(keys[full].view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(sums[0].view(np.int64)),
                     pa.array(sums[1].view(np.int64)), lists], names=["doc_id", "n", "s1", "s2", "bands"])

    return map_arrow(id_and_text(docs), run, "doc_id long, n long, s1 long, s2 long, bands array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, shingles (distinct hashes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1):
                raw, offs = text_buffers(part.column(1))
                h, of = shingle_sets(raw, offs, width)
                lists = pa.ListArray.from_arrays(pa.array(bounds_of(of, part.num_rows), pa.int32()),
                                                 pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "shingles"])

    return map_arrow(id_and_text(docs), run, "doc_id long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union. b may be hot: it is joined last."""
    one = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    two = one.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return (two.select("a", "b", both.alias("i"), (F.size("sa") + F.size("sb") - both).alias("u"))
            .where(100 * F.col("i") >= percent * F.col("u")).select("a", "b"))


def prefix_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b), a > b in size order, of different components, by rarity-ordered prefixes.

    members: (rep, component). Two sets at the threshold share a shingle among the rarest of both: the first
    n - ceil(t n) + 1 of the larger and n - ceil(2 t / (1 + t) n) + 1 of the smaller one; where they
    share it, what can still follow must reach the needed overlap. Integers throughout: t = percent / 100.
    """
    rows = (members.join(sets, members["rep"] == sets["doc_id"])
            .select("rep", "component", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("x")))
    counts = (rows.groupBy("x").agg(F.count(F.lit(1)).alias("df"), F.min("component").alias("lo"),
                                    F.max("component").alias("hi")).where("df > 1"))
    shared = rows.join(counts, "x")  # shingles of one document only come first and need no rows
    own = Window.partitionBy("rep")
    placed = (shared.withColumn("pos", F.col("n") - F.count(F.lit(1)).over(own)
                                + F.row_number().over(own.orderBy("df", "x")) - 1)
              .where("lo < hi")
              .withColumn("probe", F.expr(f"n - (({percent} * n + 99) div 100) + 1"))
              .withColumn("idx", F.expr(f"n - ((2 * {percent} * n + {99 + percent}) div {100 + percent}) + 1"))
              .where("pos < probe").select("x", "rep", "component", "n", "pos", "idx"))
    placed = persist_table(placed, "prefixes")
    p, q = placed.alias("p"), placed.where("pos < idx").alias("q")
    need = f"(({percent} * (p.n + q.n) + {99 + percent}) div {100 + percent})"
    return (p.join(q, F.expr(f"""p.x = q.x AND p.component <> q.component
                                 AND (q.n < p.n OR (q.n = p.n AND q.rep < p.rep)) AND 100 * q.n >= {percent} * p.n
                                 AND 1 + least(p.n - p.pos - 1, q.n - q.pos - 1) >= {need}"""))
            .select(F.col("p.rep").alias("a"), F.col("q.rep").alias("b")).distinct())


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75, permutations: int = PERMUTATIONS,
                    band_rows: int = BAND_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    docs = id_and_text(docs, id_col, text_col)
    sigs = persist_table(signatures(docs, width, permutations, band_rows), "signatures")
    linkable = sigs.where("n > 0 AND doc_id IS NOT NULL")
    key = ["n", "s1", "s2"]
    classes = persist_table(linkable.groupBy(*key).agg(F.min("doc_id").alias("rep"),
                                                       F.any_value("bands").alias("bands")), "classes")

    banded = classes.select("rep", "n", F.explode("bands").alias("band"))
    lead = (banded.groupBy("band").agg(F.min(F.struct("rep", "n")).alias("first"), F.count(F.lit(1)).alias("size"))
            .where("size > 1").select("band", F.col("first.rep").alias("b"), F.col("first.n").alias("bn")))
    buckets = persist_table(banded.join(lead, "band"), "buckets")

    needed = persist_table(buckets.select(F.col("rep").alias("doc_id")).distinct(), "needed")
    sets = persist_table(full_sets(docs.join(needed, "doc_id"), width), "sets")

    fits = f"rep <> b AND 100 * least(n, bn) >= {percent} * greatest(n, bn)"
    first = buckets.where(fits).select(F.col("rep").alias("a"), "b").distinct()
    links = persist_table(confirmed(first, sets, percent), "links")
    joined = persist_table(components(links), "components")

    placed = (buckets.select("band", "rep").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
              .withColumn("component", F.coalesce("component", "rep")))
    mixed = (placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
             .where("lo < hi").select("band"))
    members = persist_table(placed.join(mixed, "band").select("rep", "component").distinct(), "members")
    more = persist_table(confirmed(prefix_pairs(members, sets, percent), sets, percent), "links")
    if not more.isEmpty():
        joined = persist_table(components(links.union(more)), "components")

    found = (sigs.select("doc_id", *key).join(classes.select(*key, "rep"), key, "left")
             .join(joined.withColumnRenamed("node", "rep"), "rep", "left"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` (doc_id, text, any others) with one document of each group, the one with the smallest id.

    Rows without an id stay; rows that share an id stay or go together.
    """
    dropped = near_duplicates(docs, width, percent).where("NOT kept").select("doc_id").distinct()
    return docs.join(persist_table(dropped, "dropped"), "doc_id", "left_anti").select(*docs.columns)
