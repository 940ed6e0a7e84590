"""Exact removal of repeated byte strings by prefix-free parsing.

Parsing. A rolling hash over ``GRAM`` bytes triggers where it is smallest among
the grams of some window of ``length`` bytes. The windows (all byte strings of
that length) with the same trigger are neighbours; the text they span is a
phrase. Phrases overlap, every window lies in exactly one, and since a trigger
depends on its window alone, equal windows have equal triggers at equal places.

Order of the parse. Phrase occurrences are sorted by trigger hash, phrase hash
and position: equal phrases become neighbours, first occurrence first. Every
window of a later occurrence is a repeat. Within a task equal phrases are
found before the shuffle, so a copied text sends its later phrases through as
finished intervals.

Order of the dictionary. Different phrases of one trigger may share windows.
For the first occurrence of each such phrase the windows, which are its
suffixes cut to ``length``, are sorted by hash and position: later ones are repeats.

Both orders sort by hashes instead of bytes (90 and 97 bits decide equality;
a phrase's 90 are all of the phrase, since its trigger's hash is the same for
every phrase of the trigger and tells none apart), as only equal strings must
meet; no suffix array is ever held whole. Both are
one shuffle, a sort within partitions and a streaming pass with one row of
carry; the texts are shuffled once, by id, and met by their intervals.

Defined cases: null text counts as empty; a null id takes no part and loses
nothing; of rows that share an id, the one with the smallest text takes part,
equal rows share its result and others lose nothing; an empty table gives an
empty result; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossframe.llm.common import BASES, SLICE_BYTES, Hasher, id_and_text, map_arrow, slices, text_buffers
from lossframe.session import persist_table

GRAM = 48
#: Bits of the packed phrase column: a second phrase hash (the first has a column of its own), start, windows.
START_BITS, COUNT_BITS = 31, 7
PHRASE_BITS = 64 - START_BITS - COUNT_BITS
#: Bits of the sliding minimum: the hash's upper ones decide, then the position.
POSITION_BITS = 24


def sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest value (upper 40 bits; leftmost of equal ones) of every ``width`` in a row."""
    n = len(h)
    position = np.uint64((1 << POSITION_BITS) - 1)
    key = (h & ~position) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // width)
    x = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    x[:n] = key
    x = x.reshape(blocks, width)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    behind = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n - width + 1], ahead[width - 1:n]) & position).astype(np.int64)


def pieces(raw: np.ndarray, offs: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, start in the text): the slice itself, or one long text in overlapping pieces."""
    if len(offs) > 2 or len(raw) <= 2 * SLICE_BYTES:
        yield raw, offs, 0
        return
    for at in range(0, len(raw) - length + 1, SLICE_BYTES):
        part = raw[at:at + SLICE_BYTES + length - 1]
        yield part, np.array([0, len(part)]), at


def phrases(raw: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, start, windows, trigger hash, phrase hash) of every phrase of a slice."""
    return phrase_hashes(raw, offs, length)[:5]


def phrase_hashes(raw: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """``phrases`` with a second phrase hash, of the other base."""
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64))
    if len(raw) < length:
        return empty
    at = np.arange(len(raw) - GRAM + 1)
    other = Hasher(raw, BASES[0])
    h = other(at, at + GRAM)
    trigger = sliding_argmin(h, length - GRAM + 1)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[:len(trigger)]
    whole = np.arange(len(trigger)) + length <= offs[doc + 1]
    new = np.ones(len(trigger), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (doc[1:] != doc[:-1]) | (whole[1:] != whole[:-1])
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(trigger)))
    start, count = start[whole[start]], count[whole[start]]
    if not len(start):
        return empty
    end = start + count + length - 1
    return (doc[start], start - offs[doc[start]], count, h[trigger[start]], Hasher(raw, BASES[1])(start, end),
            other(start, end))


def _parse(docs: DataFrame, length: int) -> DataFrame:
    """h, key, doc_id, packed, done: a row for each phrase; ``done`` where an earlier one of the batch is equal."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.asarray(b.column(0))
            rows, base = [], 0
            for part in slices(b, 1):
                raw, offs = text_buffers(part.column(1))
                own = ids[base:base + part.num_rows]
                base += part.num_rows
                for bytes_, bounds, first in pieces(raw, offs, length):
                    doc, start, count, h, key, more = phrase_hashes(bytes_, bounds, length)
                    packed = ((more >> np.uint64(64 - PHRASE_BITS)) << np.uint64(64 - PHRASE_BITS)
                              | (start + first).astype(np.uint64) << np.uint64(COUNT_BITS) | count.astype(np.uint64))
                    rows.append((h, key, own[doc], packed))
            if not rows:
                continue
            h, key, doc, packed = (np.concatenate(x) for x in zip(*rows))
            place = packed >> np.uint64(COUNT_BITS) & np.uint64((1 << START_BITS) - 1)
            kind = packed >> np.uint64(64 - PHRASE_BITS)
            order = np.lexsort((place, doc, kind, key, h))
            again = np.zeros(len(h), bool)
            x, y = order[1:], order[:-1]
            again[x] = (h[x] == h[y]) & (key[x] == key[y]) & (kind[x] == kind[y])
            # a finished interval goes to any partition: its position spreads it
            spread = np.where(again, (place * np.uint64(BASES[0])) ^ h, h)
            key = np.where(again, np.uint64(0), key)  # it needs no key any more
            yield pa.RecordBatch.from_arrays([pa.array(spread.view(np.int64)), pa.array(key.view(np.int64)), pa.array(doc),
                                              pa.array(packed.view(np.int64)), pa.array(again)],
                                             names=["h", "key", "doc_id", "packed", "done"])

    return map_arrow(docs, run, "h long, key long, doc_id long, packed long, done boolean")


def _order_parse(parse: DataFrame) -> DataFrame:
    """doc_id, packed, open: phrases that are repeats as a whole (open false) and first occurrences of phrases whose
    trigger has other phrases too (open true)."""
    kind = F.shiftrightunsigned("packed", 64 - PHRASE_BITS)
    dealt = (parse.repartition("h").withColumn("kind", kind)
             .sortWithinPartitions("done", "h", "key", "kind", "doc_id", "packed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (h, (key, kind), doc, packed, waiting) of the trigger that the last batch ended in; waiting: only one
        # phrase of it was seen, whose first occurrence (doc, packed) is not given out
        for b in batches:
            h, key, doc, packed, done, kind = (np.asarray(c) for c in b.columns)
            docs_out, packed_out, open_out = [doc[done]], [packed[done]], [np.zeros(int(done.sum()), bool)]
            h, key, doc, packed, kind = (x[~done] for x in (h, key, doc, packed, kind))
            if len(h):
                new_h, new_kind = np.ones(len(h), bool), np.ones(len(h), bool)
                new_h[1:] = h[1:] != h[:-1]
                new_h[0] = last is None or last[0] != h[0]
                new_kind[1:] = (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])
                new_kind[0] = new_h[0] or last[1] != (key[0], kind[0])
                new_kind |= new_h
                group = np.cumsum(new_h)  # 0: goes on from the last batch
                further = new_kind & ~new_h
                several = np.bincount(group, further, minlength=group[-1] + 1) > 0
                is_open = further | new_h & several[group]
                out = is_open | ~new_kind
                docs_out.append(doc[out])
                packed_out.append(packed[out])
                open_out.append(is_open[out])
                if last is not None and last[4] and several[0]:
                    docs_out.append(np.array([last[2]]))
                    packed_out.append(np.array([last[3]]))
                    open_out.append(np.ones(1, bool))
                if group[-1]:
                    f = int(np.flatnonzero(new_h)[-1])
                    last = (h[-1], (key[-1], kind[-1]), doc[f], packed[f], not several[-1])
                else:
                    last = (h[-1], (key[-1], kind[-1]), last[2], last[3], last[4] and not several[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs_out)), pa.array(np.concatenate(packed_out)),
                                              pa.array(np.concatenate(open_out))], names=["doc_id", "packed", "open"])

    return map_arrow(dealt.select("h", "key", "doc_id", "packed", "done", "kind"), run, "doc_id long, packed long, open boolean")


def _windows(docs: DataFrame, opened: DataFrame, length: int) -> DataFrame:
    """w, doc_id, x: a row for each window of the open phrases; w and the upper bits of x are its hashes."""
    by_doc = opened.groupBy("doc_id").agg(F.collect_list("packed").alias("packed"))  # bounded by the document

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for part in slices(b, 1):
                raw, offs = text_buffers(part.column(1))
                rows = b.column(2).slice(at, part.num_rows)
                own = np.repeat(np.arange(part.num_rows), np.asarray(rows.value_lengths()))
                packed = np.asarray(rows.flatten()).view(np.uint64)
                count = (packed & np.uint64((1 << COUNT_BITS) - 1)).astype(np.int64)
                first = (packed >> np.uint64(COUNT_BITS) & np.uint64((1 << START_BITS) - 1)).astype(np.int64)
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                place, doc = np.repeat(first, count) + step, np.repeat(own, count)
                start = offs[doc] + place
                w, check = (Hasher(raw, base)(start, start + length) for base in BASES)
                x = (check >> np.uint64(START_BITS)) << np.uint64(START_BITS) | place.astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(np.asarray(part.column(0))[doc]),
                                                  pa.array(x.view(np.int64))], names=["w", "doc_id", "x"])
                at += part.num_rows

    return map_arrow(docs.join(by_doc, "doc_id"), run, "w long, doc_id long, x long")


def _order_windows(windows: DataFrame, length: int) -> DataFrame:
    """doc_id, span: the windows that stand earlier too, as packed intervals."""
    dealt = (windows.repartition("w").withColumn("check", F.shiftrightunsigned("x", START_BITS))
             .sortWithinPartitions("w", "check", "doc_id", "x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            w, doc, x, check = (np.asarray(c) for c in b.columns)
            if not len(w):
                continue
            again = np.zeros(len(w), bool)
            again[1:] = (w[1:] == w[:-1]) & (check[1:] == check[:-1])
            again[0] = last == (w[0], check[0])
            last = (w[-1], check[-1])
            place = x[again].view(np.uint64) & np.uint64((1 << START_BITS) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(doc[again]), pa.array(_span(place.astype(np.int64), length))],
                                             names=["doc_id", "span"])

    return map_arrow(dealt.select("w", "doc_id", "x", "check"), run, "doc_id long, span long")


#: An interval as one long: start, then its length in the lower bits.
SPAN_BITS = 9


def _span(start, size):
    return start << SPAN_BITS | size


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans array<struct<start, end>> (maximal removed runs, bytes), kept binary, of every row."""
    if not GRAM < length < 1 << (SPAN_BITS - 1):
        raise ValueError(f"length must be over {GRAM} and under {1 << (SPAN_BITS - 1)}")
    rows = id_and_text(docs, id_col, text_col)
    repeated = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    odd = not repeated.isEmpty()
    part = rows.where("doc_id IS NOT NULL")
    if odd:
        ids = repeated.select("doc_id")
        one = part.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
        part = part.join(ids, "doc_id", "left_anti").unionByName(one)
    phrase = persist_table(_order_parse(_parse(part, length)), "phrases")
    size = F.col("packed").bitwiseAND((1 << COUNT_BITS) - 1) + length - 1
    start = F.shiftright("packed", COUNT_BITS).bitwiseAND((1 << START_BITS) - 1)
    whole = phrase.where("NOT open").select("doc_id", F.shiftleft(start, SPAN_BITS).bitwiseOR(size).alias("span"))
    shared = _order_windows(_windows(part, phrase.where("open").select("doc_id", "packed"), length), length)
    spans = whole.unionByName(shared).groupBy("doc_id").agg(F.collect_list("span").alias("span"))  # bounded by the document
    done = part.join(spans, "doc_id", "left").select("doc_id", "text", "span")
    none = F.lit(None).cast("array<long>").alias("span")
    if odd:
        twins = rows.join(repeated.select("doc_id"), "doc_id", "left_semi")
        texts = F.sha2("text", 256).alias("hash")
        known = done.join(repeated.select("doc_id"), "doc_id", "left_semi").select("doc_id", texts, "span")
        met = (twins.withColumn("hash", texts).join(known, ["doc_id", "hash"], "left").select("doc_id", "text", "span"))
        done = done.join(repeated.select("doc_id"), "doc_id", "left_anti").unionByName(met)
    others = rows.where("doc_id IS NULL")
    if not others.isEmpty():  # without this branch both joins read one shuffle of the texts
        done = done.unionByName(others.select("doc_id", "text", none))
    return _cut(done)


def _cut(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for b in batches:
            raw, offs = text_buffers(b.column(1))
            spans, kept = [], []
            for i, own in enumerate(b.column(2)):
                text = raw[offs[i]:offs[i + 1]]
                if not own.is_valid or not len(own.values):
                    spans.append([])
                    kept.append(text.tobytes())
                    continue
                packed = np.asarray(own.values)
                start, n = packed >> SPAN_BITS, packed & (1 << SPAN_BITS) - 1
                edge = np.zeros(len(text) + 1, np.int32)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + n, -1)
                gone = np.cumsum(edge[:-1]) > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                spans.append([{"start": s, "end": e} for s, e in zip(turn[::2].tolist(), turn[1::2].tolist())])
                kept.append(text[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offs)), pa.array(spans, pa.list_(kind)),
                                              pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return map_arrow(rows, run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def removal_digest(cut: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of the rows of ``remove_repeats``."""
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
