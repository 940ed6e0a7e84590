r"""Phrase collocations by a multikey three-way quicksort of suffix pointers.

Texts are cut into pieces at ``[.,;:!?\x0A-\x0D]`` and these into words; a suffix is a place in a piece with the
up to five words that follow. All counts are exact:

1. words of each language; those below the minimum cannot be part of a phrase and end every suffix. The scanning
   tasks know the others from a bitmap of fixed size; a word that shares a bit only lets suffixes through that the
   counts of the fourth step drop;
2. pairs, then triples of such pairs: their occurrences are summed up by a hash of ``gram_width`` bits, packed arrays of
   which are shuffled. One whose sum is below the minimum is below it, too, and ends every suffix as such a word does; one
   that shares its hash with others is dropped by the fourth step;
3. routes: suffixes go to tasks by their leading word. A leading word, then a leading pair and so on, that occurs
   oftener than a partition's fair share (all words / shuffle partitions, ``MOST_SHARE`` at most) is divided by the
   word that follows it, its own count coming from this table;
4. equal suffixes of a run of text chunks are summed up and routed, in packs of one part of the routes. Each task sorts its suffix pointers by a three-way
   quicksort over words as digits: the size of an equal partition is the count of its phrase, and partitions below
   the minimum are abandoned.

Phrases are scored at their weakest cut, those inside an equally frequent longer phrase are dropped, and the first
``top`` of each language are returned. Arithmetic is in DECIMAL(38), exact while 1000 * a * n and l * r stay below 1e38.

Defined cases: null text counts as empty, a null language as ``und``; languages without a word have no row;
repeated rows count each; an empty table gives an empty result; columns other than text and language are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lossframe.llm.common import LOWER, map_arrow, mix, string_hashes, text_buffers
from lossframe.session import persist_table

MAX_WORDS = 5
WORDS = [f"w{i}" for i in range(1, MAX_WORDS + 1)]
#: Bits of the bitmap of frequent words: 2 MB, whatever the corpus.
WORD_BITS = 24
#: Words of the phrases that have a bitmap of the frequent ones.
GRAMS = (2, 3)
#: Bits of such a bitmap, least and most (2 to 32 MB); they only decide how many rare phrases are dropped early.
GRAM_BITS = (24, 28)
#: Bits of a hash within one packed array.
PART_BITS = 15
#: Pairs or triples, and rows of suffixes, that a scanning task sums up at once.
HELD_GRAMS, HELD_ROWS = 2_000_000, 400_000
#: Phrases of a shuffled row, and words of the corpus for each of the parts that these rows are dealt by.
PACK, PART_WORDS = 100, 200_000
#: Bytes of text that a scanning task handles at once; a longer piece is alone.
CHUNK = 3 << 19
#: Suffixes that a sorting task holds at once; more only if one part of the routes has more.
BUFFER = 200_000
#: Occurrences that a route may have, whatever its share, and those that it may have at most: they bound a sorting task's memory.
LEAST_SHARE, MOST_SHARE = 1000, 1_000_000

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = 2


# ---------------------------------------------------------------------------
# Reading words in the scanning tasks
# ---------------------------------------------------------------------------

def chunks(raw: np.ndarray, offs: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of about ``limit`` bytes that end at a text's end or behind a piece's separator."""
    at = 0
    while at < len(raw):
        end, step = min(at + limit, len(raw)), limit
        while end < len(raw):
            text_end = int(offs[np.searchsorted(offs, end)])
            found = np.flatnonzero(_KIND[raw[end:min(end + step, text_end)]] == 2)
            if len(found):
                end += int(found[0]) + 1
                break
            if end + step >= text_end:
                end = text_end
                break
            end, step = end + step, 2 * step
        yield at, end
        at = end


class Chunk:
    """The words of one run of bytes: dictionary of (language, word), its number for every word, the word's piece."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, langs: np.ndarray):
        kind = _KIND[raw]
        word = kind == 0
        first = np.zeros(len(raw) + 1, bool)
        first[offs] = True
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1] | first[1:-1]
        ends[:-1] &= ~word[1:] | first[1:-1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        doc = np.searchsorted(offs, start, side="right") - 1
        self.piece = np.cumsum(kind == 2)[start] + doc if len(start) else doc
        places = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
        words = pa.StringArray.from_buffers(len(start), pa.py_buffer(places), pa.py_buffer(LOWER[raw[word]]))
        coded = words.dictionary_encode()
        key = langs[doc] * np.int64(max(1, len(coded.dictionary))) + np.asarray(coded.indices, np.int64)
        keys, self.ids = np.unique(key, return_inverse=True)
        self.lang, word_no = np.divmod(keys, max(1, len(coded.dictionary)))
        self.words = coded.dictionary.take(pa.array(word_no))

    def word_keys(self, lang_keys: np.ndarray) -> np.ndarray:
        """A 64-bit hash of every entry of the dictionary."""
        return hash_words(self.words) + lang_keys[self.lang]


def hash_words(words: pa.Array) -> np.ndarray:
    raw, offs = text_buffers(words)
    return string_hashes(raw, offs[:-1], offs[1:])


def lang_hashes(langs: pa.Array) -> np.ndarray:
    return mix(hash_words(langs) + np.uint64(1))


def word_bits(keys: np.ndarray) -> np.ndarray:
    return (mix(keys) >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def has_bit(bitmap: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def chunks_of(batch: pa.RecordBatch, limit: int) -> Iterator[tuple[Chunk, pa.Array]]:
    """The chunks of a batch (lang, text) and its distinct languages."""
    coded = batch.column(0).dictionary_encode()
    raw, offs = text_buffers(batch.column(1))
    of = np.asarray(coded.indices, np.int64)
    for start, end in chunks(raw, offs, limit):
        a, b = np.searchsorted(offs, start, side="right") - 1, np.searchsorted(offs, end, side="left")
        own = np.clip(offs[a:b + 1], start, end) - start
        yield Chunk(raw[start:end], own, of[a:b]), coded.dictionary


def _frequent_words(chunk: Chunk, langs: pa.Array, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every dictionary entry, whether it may be frequent)."""
    keys = chunk.word_keys(lang_hashes(langs))
    return keys, has_bit(bitmap, word_bits(keys))


def _summed(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a place of each distinct key, its number for every place, how often)."""
    _, at, of, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    return at, of, n


def gram_width(words: int, least: int) -> int:
    """Bits of the hashes: about eight times as many as there can be frequent phrases of a size, within ``GRAM_BITS``."""
    return int(min(max((8 * words // max(1, least)).bit_length(), GRAM_BITS[0]), GRAM_BITS[1]))


def gram_places(chunk: Chunk, frequent: np.ndarray, links: list[np.ndarray]) -> np.ndarray:
    """The places of phrases, a word longer than those of the last of ``links``, whose parts may all be frequent."""
    if links:
        return np.flatnonzero(links[-1][:-1] & links[-1][1:])
    may = frequent[chunk.ids]
    return np.flatnonzero((chunk.piece[1:] == chunk.piece[:-1]) & may[1:] & may[:-1])


def gram_bits(chunk: Chunk, keys: np.ndarray, at: np.ndarray, size: int, width: int) -> np.ndarray:
    out = keys[chunk.ids[at]]
    for k in range(1, size):
        out = mix(out * np.uint64(3) + keys[chunk.ids[at + k]])
    return (out >> np.uint64(64 - width)).astype(np.int64)


def linked(chunk: Chunk, keys: np.ndarray, frequent: np.ndarray, maps: list[np.ndarray]) -> list[np.ndarray]:
    """For each bitmap, of pairs, of triples: for every place whether the phrase there may be frequent."""
    links: list[np.ndarray] = []
    for size, bitmap in zip(GRAMS, maps):
        at = gram_places(chunk, frequent, links)
        own = np.zeros(len(chunk.ids), bool)
        own[at[has_bit(bitmap, gram_bits(chunk, keys, at, size, (8 * len(bitmap)).bit_length() - 1))]] = True
        links.append(own)
    return links


def suffixes(chunk: Chunk, links: list[np.ndarray], start: np.ndarray | None = None,
             size: int = MAX_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(dictionary numbers of the distinct suffixes of two words and more, -1 behind their end; how often).

    A suffix goes on as long as its last words, as many as each of ``links`` is about, may be frequent; ``start`` picks
    among the places, ``size`` ends a suffix earlier.
    """
    may = [np.append(own, np.zeros(size, bool)) for own in links]
    at = np.flatnonzero(links[0] if start is None else links[0] & start)
    ids = np.append(chunk.ids, np.full(size, -1, np.int64))
    rows = np.full((len(at), size), -1, np.int64)
    rows[:, 0] = ids[at]
    alive = np.ones(len(at), bool)
    for k in range(1, size):
        for words, own in zip(GRAMS, may):
            if k >= words - 1:
                alive &= own[at + k - words + 1]
        rows[alive, k] = ids[at[alive] + k]
    key = rows[:, 0]
    for k in range(1, size):
        _, of, _ = _summed(key)
        key = of * np.int64(len(chunk.words) + 1) + rows[:, k] + 1
    one, _, n = _summed(key)
    return rows[one], n


class Hot:
    """The prefixes that are divided: (language, words) of one word, of two and so on."""

    def __init__(self, levels: list[list[tuple[str, ...]]]):
        self.levels = levels
        self.words = pa.array(sorted({w for level in levels for p in level for w in p[1:]}), pa.string())

    def lengths(self, chunk: Chunk, langs: pa.Array, rows: np.ndarray) -> np.ndarray:
        """Words of the longest divided prefix of every row."""
        out = np.zeros(len(rows), np.int64)
        if not self.levels or not len(rows):
            return out
        at = np.flatnonzero(np.asarray(pc.is_in(chunk.words, value_set=self.words)))
        lang, word = langs.to_pylist(), chunk.words.take(pa.array(at)).to_pylist()
        no = {(lang[chunk.lang[i]], w): int(i) for i, w in zip(at, word)}
        wide = len(chunk.words) + 1
        of = {(p,): i for i, p in enumerate(lang)}  # prefix to its number, a level at a time
        state, alive = chunk.lang[rows[:, 0]], np.arange(len(rows))
        for k, level in enumerate(self.levels):
            known = sorted((of[p[:-1]] * wide + no[p[0], p[-1]], p) for p in level if p[:-1] in of and (p[0], p[-1]) in no)
            of = {p: i for i, (_, p) in enumerate(known)}
            keys = np.array([key for key, _ in known], np.int64)
            mine = state * wide + rows[alive, k]
            place = np.minimum(np.searchsorted(keys, mine), max(0, len(keys) - 1))
            hit = (rows[alive, k] >= 0) & (keys[place] == mine if len(keys) else False)
            alive, state = alive[hit], place[hit]
            out[alive] = k + 1
        return out


# ---------------------------------------------------------------------------
# Multikey quicksort
# ---------------------------------------------------------------------------

def count_prefixes(digits: np.ndarray, weight: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(a row, prefix length, weight) of every prefix of the digit rows whose weight reaches ``least``.

    Three-way partitions of row pointers, digit by digit: equal ones are a prefix; a partition below ``least`` holds
    none that reaches it and is abandoned. The digit -1 ends a row.
    """
    stack = [(np.arange(len(digits)), 0)]
    while stack:
        rows, k = stack.pop()
        if weight[rows].sum() < least:
            continue
        values = digits[rows, k]
        pivot = np.sort(values[[0, len(values) // 2, -1]])[1]
        below, above = values < pivot, values > pivot
        if below.any():
            stack.append((rows[below], k))
        if above.any():
            stack.append((rows[above], k))
        if pivot < 0:
            continue
        equal = rows[~(below | above)]
        n = int(weight[equal].sum())
        if n < least:
            continue
        yield int(equal[0]), k + 1, n
        if k + 1 < digits.shape[1]:
            stack.append((equal, k + 1))


def _sort_step(least: int):
    """Packs (part, depth, lang, phrases, n of each), sorted by part, to (lang, phrase, size, f) of the frequent prefixes.

    Only prefixes no shorter than the route's words are whole in a task, and only those are given.
    """
    def count(rows: pa.RecordBatch) -> pa.RecordBatch:
        of = np.repeat(np.arange(rows.num_rows), np.asarray(pc.list_value_length(rows.column(3))))
        langs = rows.column(2).take(pa.array(of))
        split = pc.split_pattern(rows.column(3).flatten(), " ")
        size = np.asarray(pc.list_value_length(split), np.int64)
        coded = split.flatten().dictionary_encode()
        no = np.full((len(size), MAX_WORDS), -1, np.int32)
        no[np.arange(MAX_WORDS)[None, :] < size[:, None]] = np.asarray(coded.indices)
        lang = np.asarray(langs.dictionary_encode().indices, np.int32)
        depth, weight = np.asarray(rows.column(1))[of], np.asarray(rows.column(4).flatten())
        found = [(r, k - 1, n) for r, k, n in count_prefixes(np.column_stack([lang, no]), weight, least)
                 if k - 1 >= max(2, depth[r])]
        at = np.array([r for r, _, _ in found], np.int64)
        size = np.array([k for _, k, _ in found], np.int64)
        words = [coded.dictionary.take(pa.array(np.where(size > i, no[at, i], 0), mask=size <= i)) for i in range(MAX_WORDS)]
        return pa.RecordBatch.from_arrays([langs.take(pa.array(at)), _joined(words), pa.array(size, pa.int32()),
                                           pa.array([n for *_, n in found], pa.int64())], names=["lang", "phrase", "size", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, limit = [], 0, BUFFER
        for b in batches:
            held.append(b)
            n += len(b.column(3).flatten())
            if n < limit:
                continue
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            part = np.asarray(rows.column(0))
            cut = int(np.searchsorted(part, part[-1]))  # the last part may go on
            if cut:
                yield count(rows.slice(0, cut))
            held = [rows.slice(cut)]
            n = len(held[0].column(3).flatten())
            limit = max(BUFFER, 2 * n)
        if n:
            yield count(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


# ---------------------------------------------------------------------------
# On Spark
# ---------------------------------------------------------------------------

def _bitmap(found: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of the rows (bit); reaches the driver as 2**bits bits at most."""
    part = 32768
    rows = (found.groupBy(F.expr(f"bit div {part}").alias("part"))
            .agg(F.bitmap_construct_agg(F.col("bit") % part).alias("bits")).collect())
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows:
        own = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[r["part"] * part // 8:r["part"] * part // 8 + len(own)] = own
    return out


def _gram_map(texts: DataFrame, word_map: np.ndarray, shorter: list[np.ndarray], width: int, least: int) -> np.ndarray:
    """The bitmap of the hashes that occur ``least`` times or more, of the phrases a word longer than the last of
    ``shorter`` (pairs without it); reaches the driver as 2**width bits at most.

    A row is a run of hashes with the same leading bits: their other bits and how often, each count ``least`` at most,
    which changes no comparison with it.
    """
    most = max(1, least)
    kind = np.min_scalar_type(most)
    parts, size = 1 << (width - PART_BITS), 1 << PART_BITS

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        bit, n = np.unique(np.concatenate(held), return_counts=True)
        part = bit >> PART_BITS
        at = np.searchsorted(part, np.arange(parts + 1))
        own = np.flatnonzero(np.diff(at))

        def column(values: np.ndarray) -> pa.Array:
            places = np.append(at[own], len(values)).astype(np.int32) * np.int32(values.itemsize)
            return pa.BinaryArray.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(places), pa.py_buffer(values)])

        return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), column((bit & (size - 1)).astype(np.uint16)),
                                           column(np.minimum(n, most).astype(kind))], names=["part", "bits", "n"])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for chunk, langs in chunks_of(b, CHUNK):
                keys, frequent = _frequent_words(chunk, langs, word_map)
                at = gram_places(chunk, frequent, linked(chunk, keys, frequent, shorter))
                held.append(gram_bits(chunk, keys, at, GRAMS[len(shorter)], width).astype(np.uint32))
                n += len(at)
                if n >= HELD_GRAMS:
                    yield packed(held)
                    held, n = [], 0
        if n:
            yield packed(held)

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(part: int, sums: np.ndarray) -> pa.RecordBatch:
            bits = np.packbits(sums >= least, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([bits], pa.binary())], names=["part", "bits"])

        now, sums = -1, np.zeros(size, np.int64)
        for b in batches:  # sorted by part
            for part, bits, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                if part != now:
                    if (sums >= least).any() and now >= 0:
                        yield found(now, sums)
                    now, sums = part, np.zeros(size, np.int64)
                sums[np.frombuffer(bits.as_buffer(), np.uint16)] += np.frombuffer(n.as_buffer(), kind)  # a hash is there once
        if now >= 0 and (sums >= least).any():
            yield found(now, sums)

    rows = map_arrow(texts, grams, "part int, bits binary, n binary").repartition("part").sortWithinPartitions("part")
    out = np.zeros((parts, size // 8), np.uint8)
    for r in map_arrow(rows, often, "part int, bits binary").collect():
        out[r["part"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.reshape(-1)


def _bits_of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:  # lang, w1
        yield pa.RecordBatch.from_arrays([pa.array(word_bits(hash_words(b.column(1)) + lang_hashes(b.column(0))))], names=["bit"])


def _joined(words: list[pa.Array]) -> pa.Array:
    return pc.binary_join_element_wise(*words, " ", null_handling="skip")


def _words_of(chunk: Chunk, rows: np.ndarray) -> list[pa.Array]:
    return [chunk.words.take(pa.array(np.maximum(rows[:, k], 0), mask=rows[:, k] < 0)) for k in range(rows.shape[1])]


def _summed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (.., n) with n summed up over equal ones, as far as ``HELD_ROWS`` rows go."""
    held, n = [], 0

    def summed() -> pa.Table:
        names = held[0].schema.names
        out = pa.Table.from_batches(held).group_by(names[:-1], use_threads=False).aggregate([("n", "sum")])
        return out.rename_columns(["n" if c == "n_sum" else c for c in out.column_names]).select(names)

    for b in batches:
        held.append(b)
        n += b.num_rows
        if n < HELD_ROWS:
            continue
        rows = summed()
        held, n = rows.to_batches(), rows.num_rows
        if 2 * n > HELD_ROWS:  # few equal ones: given as they are
            yield from held
            held, n = [], 0
    if n:
        yield from summed().to_batches()


def _packs(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows (route, depth, lang, phrase, n) as packs (part of the routes, depth, lang, phrases, n of each)."""
    for b in batches:
        part = (np.asarray(b.column(0)).view(np.uint64) % np.uint64(parts)).astype(np.int64)
        coded = b.column(2).dictionary_encode()
        key = (part * len(coded.dictionary) + np.asarray(coded.indices, np.int64)) * (MAX_WORDS + 1) + np.asarray(b.column(1))
        order = np.argsort(key, kind="stable")
        key = key[order]
        begins = np.append(True, key[1:] != key[:-1])
        since = np.arange(len(key)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
        first = np.flatnonzero(since % PACK == 0)
        places, one = pa.array(np.append(first, len(key)), pa.int32()), pa.array(order[first])
        yield pa.RecordBatch.from_arrays(
            [pa.array(part[order[first]]), b.column(1).take(one), b.column(2).take(one),
             *[pa.ListArray.from_arrays(places, b.column(c).take(pa.array(order))) for c in (3, 4)]],
            names=["part", "depth", "lang", "phrases", "n"])


def phrase_counts(docs: DataFrame, min_count: int = 100, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, n of all words; lang, phrase, size, f of every phrase of 1 to 5 words with f >= min_count)."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("text <> ''")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, langs in chunks_of(b, CHUNK):
                n = np.bincount(chunk.ids, minlength=len(chunk.words))
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(chunk.lang)), chunk.words, pa.array(n, pa.int64())],
                                                 names=["lang", "w1", "n"])

    every = persist_table(map_arrow(texts, words, "lang string, w1 string, n long").groupBy("lang", "w1")
                          .agg(F.sum("n").alias("n")), "words")
    totals = every.groupBy("lang").agg(F.sum("n").alias("total"))
    single = every.where(F.col("n") >= min_count)
    word_map = _bitmap(map_arrow(single.select("lang", "w1"), _bits_of_words, "bit long"), WORD_BITS)
    words_in_all = every.agg(F.sum("n")).first()[0] or 0
    maps: list[np.ndarray] = []
    for _ in GRAMS:
        maps.append(_gram_map(texts, word_map, list(maps), gram_width(words_in_all, min_count), min_count))
    hot, divided = _routes(texts, every, words_in_all, word_map, maps)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, langs in chunks_of(b, CHUNK):
                keys, frequent = _frequent_words(chunk, langs, word_map)
                rows, n = suffixes(chunk, linked(chunk, keys, frequent, maps))
                depth = 1 + hot.lengths(chunk, langs, rows)
                route = keys[rows[:, 0]]
                for k in range(1, MAX_WORDS):
                    own = np.where(rows[:, k] >= 0, keys[rows[:, k]], np.uint64(0))
                    route = np.where(depth > k, mix(route * np.uint64(3) + own), route)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mix(route).view(np.int64)), pa.array(depth, pa.int32()), langs.take(pa.array(chunk.lang[rows[:, 0]])),
                     _joined(_words_of(chunk, rows)), pa.array(n, pa.int64())], names=["route", "depth", "lang", "phrase", "n"])

    parts = max(8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), words_in_all // PART_WORDS)

    def longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packs(_summed_rows(routed(batches)), parts)

    sorted_ = (map_arrow(texts, longer, "part long, depth int, lang string, phrases array<string>, n array<long>")
               .repartition("part").sortWithinPartitions("part"))
    deep = map_arrow(sorted_, _sort_step(min_count), "lang string, phrase string, size int, f long")
    shapes = [single.select("lang", F.col("w1").alias("phrase"), F.lit(1).alias("size"), F.col("n").alias("f")), deep]
    rows = [(p[0], " ".join(p[1:]), len(p) - 1, n) for p, n in divided if n >= min_count]
    shapes.append(docs.sparkSession.createDataFrame(rows, "lang string, phrase string, size int, f long"))
    return totals, persist_table(reduce(DataFrame.unionByName, shapes), "phrases")


def _routes(texts: DataFrame, every: DataFrame, words_in_all: int, word_map: np.ndarray,
            maps: list[np.ndarray]) -> tuple[Hot, list[tuple[tuple[str, ...], int]]]:
    """(the prefixes that are divided, and those of two words and more with their counts).

    A prefix that occurs oftener than the share consists of words that do so, too, so a level's prefixes are counted
    only where that can be. All prefixes of a level together occur at most as often as there are words: fewer than
    partitions of them, or one in ``MOST_SHARE`` words, exceed the share and come to the driver.
    """
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(LEAST_SHARE, min(MOST_SHARE, words_in_all // partitions))
    levels: list[list[tuple[str, ...]]] = [[(r["lang"], r["w1"]) for r in every.where(F.col("n") > share).collect()]]
    divided: list[tuple[tuple[str, ...], int]] = []
    for size in range(2, MAX_WORDS):
        if not levels[-1]:
            break
        hot = Hot(levels)
        single = Hot(levels[:1])

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for chunk, langs in chunks_of(b, CHUNK):
                    every_word = np.arange(len(chunk.words))[:, None]
                    keys, frequent = _frequent_words(chunk, langs, word_map)
                    often = frequent & (single.lengths(chunk, langs, every_word) == 1)
                    rows, n = suffixes(chunk, linked(chunk, keys, often, maps), often[chunk.ids], size)
                    whole = (rows[:, -1] >= 0) & (hot.lengths(chunk, langs, rows) == size - 1)
                    rows, n = rows[whole], n[whole]
                    yield pa.RecordBatch.from_arrays([langs.take(pa.array(chunk.lang[rows[:, 0]])), *_words_of(chunk, rows),
                                                      pa.array(n, pa.int64())], names=["lang", *WORDS[:size], "n"])

        key = ["lang", *WORDS[:size]]
        found = (map_arrow(texts, step, ", ".join([f"{c} string" for c in key] + ["n long"])).groupBy(*key)
                 .agg(F.sum("n").alias("n")).where(F.col("n") > share).collect())
        levels.append([tuple(r)[:-1] for r in found])
        divided += [(tuple(r)[:-1], r["n"]) for r in found]
    return Hot(levels), divided


def collocations(docs: DataFrame, min_count: int = 100, top: int = 2000, lang_col: str = "lang",
                 text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first ``top`` phrases of each language."""
    totals, counts = phrase_counts(docs, min_count, lang_col, text_col)
    phrase = counts.where(F.col("size") >= 2).withColumn("w", F.split("phrase", " "))

    def joined(start, length):
        return F.array_join(F.slice("w", start, length), " ")

    def number(c: str) -> F.Column:
        return F.col(c).cast("decimal(38,0)")

    # every part of a counted phrase is counted itself, so no cut is lost in the joins
    cut = (phrase.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
           .select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("p1"),
                   joined(F.col("k") + 1, F.size("w") - F.col("k")).alias("p2")))
    left = counts.select("lang", F.col("phrase").alias("p1"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("p2"), F.col("f").alias("r"))
    scored = (cut.join(left, ["lang", "p1"]).join(right, ["lang", "p2"])
              .join(totals.select("lang", F.col("total").alias("n")), "lang")
              .withColumn("l_", number("l")).withColumn("r_", number("r")).withColumn("a_", number("a")).withColumn("n_", number("n"))
              .withColumn("score", F.expr("CAST((1000 * a_ * n_) div (l_ * r_) AS BIGINT)")))
    weakest = (scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("c"))
               .select("lang", "phrase", "c.*"))
    inside = (phrase.where(F.col("size") >= 3)
              .select("lang", "w", F.col("f").alias("longer"), F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
              .select("lang", "w", "longer", "m", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)).alias("at"))
              .select("lang", joined(F.col("at"), F.col("m")).alias("phrase"), "longer")
              .groupBy("lang", "phrase").agg(F.max("longer").alias("longer")))
    own = (weakest.join(inside, ["lang", "phrase"], "left")
           .where(F.col("longer").isNull() | (100 * number("longer") < 100 * number("a"))))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return (own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
