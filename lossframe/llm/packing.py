"""Packing documents into training sequences by minimum bin slack.

Each document is encoded, closed with a separator id and cut: whole windows of
the capacity are sequences by themselves, the rest is a remainder. Remainders
wait in a bounded pool. A sequence starts with the longest one; a bitset
subset-sum dynamic program over the multiset of remaining lengths then finds
the sum closest to the capacity that is left, and the counts of each length
are read back from the saved bitsets. Slack that no multiset fills is filled by
cutting a waiting piece. What a task has left at its end goes into sequences of
ever smaller powers of two, which need no padding.

Encoding and packing happen in one pass without a shuffle: a task packs the
documents of its own input split, so work and memory depend on the split and
not on the table, and a lost task is simply run again with the same result.

Defined cases: null text counts as empty (its document is the separator
alone); a repeated row is a document of its own; an empty table gives no
pieces; columns other than id and text are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lossframe.llm.bpe_fragments import library_ids, settled, tokenizer_path
from lossframe.llm.common import id_and_text, map_arrow

#: Remainders that wait at most; each holds under one window of ids.
POOL = 8192
ROWS_OUT = 20_000
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long")
FIELDS = [c.split()[0] for c in SCHEMA.split(", ")]


class ByteBpe:
    """Ids of a byte-level BPE file: the compiled encoder over the same vocabulary as ranks, or, for characters
    whose class depends on the Unicode version, the tokenizers library."""

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken

        self._json, self._known = tokenizer_path(name), set()
        with open(tokenizer_path(name.removesuffix(".json") + ".tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {"<|endoftext|>": len(ranks)}
        self._encode = tiktoken.Encoding("ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                         special_tokens=special).encode_to_numpy

    def ids(self, text: str) -> bytes:
        if not settled(text, self._known):
            return library_ids(self._json, text)
        return self._encode(text, allowed_special="all").astype("<u4").tobytes()


@lru_cache(maxsize=2)
def byte_bpe(name: str) -> ByteBpe:
    return ByteBpe(name)


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Counts of the multiset of lengths whose sum is closest to ``capacity`` from below."""
    mask, reach, saved = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        saved.append((length, reach))
        left, step = min(counts[length], capacity // length), 1
        while left:  # doubling steps cover every count up to ``left``
            take = min(step, left)
            reach |= (reach << (take * length)) & mask
            left, step = left - take, step * 2
        if reach >> capacity:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(saved):
        taken = 0
        while not before >> total & 1:
            total, taken = total - length, taken + 1
        if taken:
            chosen[length] = taken
    return chosen


class Packer:
    """Packs the documents of one task. ``first_sequence``: sequence ids count from here."""

    def __init__(self, capacity: int, first_sequence: int, pool: int = POOL):
        self.capacity, self._next, self._pool = capacity, first_sequence, pool
        self._waiting: dict[int, list] = defaultdict(list)  # length -> (doc_id, start, doc_tokens, ids)
        self._n, self._tokens, self.rows = 0, 0, []

    def _sequence(self, pieces: list[tuple]) -> None:
        """pieces: (doc_id, start, doc_tokens, ids), laid out one after the other."""
        at = 0
        for doc_id, start, doc_tokens, ids in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), doc_tokens, self._next, at))
            at += n
        self._next += 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n, size = len(ids) // 4, self.capacity
        for start in range(0, n - size + 1, size):
            self._sequence([(doc_id, start, n, ids[4 * start:4 * (start + size)])])
        if rest := n % size:
            self._wait((doc_id, n - rest, n, ids[4 * (n - rest):]))
            if self._n >= self._pool:
                self._pack(self._pool // 8)

    def _wait(self, piece: tuple) -> None:
        n = len(piece[3]) // 4
        self._waiting[n].append(piece)
        self._n, self._tokens = self._n + 1, self._tokens + n

    def _take(self, length: int) -> tuple:
        own = self._waiting[length]
        piece = own.pop()
        if not own:
            del self._waiting[length]
        self._n, self._tokens = self._n - 1, self._tokens - length
        return piece

    def _cut(self, length: int, room: int) -> tuple:
        """The first ``room`` ids of a waiting piece; the others wait on."""
        doc_id, start, doc_tokens, ids = self._take(length)
        self._wait((doc_id, start + room, doc_tokens, ids[4 * room:]))
        return doc_id, start, doc_tokens, ids[:4 * room]

    def _fill_sequence(self, capacity: int) -> None:
        pieces, room = [], capacity
        longest = max(self._waiting)
        if longest <= room:
            pieces.append(self._take(longest))
            room -= longest
        for length, k in fill({x: len(v) for x, v in self._waiting.items()}, room).items():
            pieces += [self._take(length) for _ in range(k)]
            room -= length * k
        if room:  # every waiting piece is longer than the slack
            pieces.append(self._cut(max(self._waiting), room))
        self._sequence(pieces)

    def _pack(self, keep: int) -> None:
        while self._n > keep and self._tokens >= self.capacity:
            self._fill_sequence(self.capacity)

    def finish(self) -> None:
        """Pack what waits: whole sequences, then ever smaller powers of two."""
        self._pack(0)
        while self._tokens:
            self._fill_sequence(1 << (self._tokens.bit_length() - 1))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, separator: int = 0, pool: int = POOL,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, end = byte_bpe(tokenizer), np.array([separator], "<u4").tobytes()
        packer = Packer(capacity, TaskContext.get().partitionId() << 32, pool)

        def out() -> pa.RecordBatch:
            columns = zip(*packer.rows) if packer.rows else [[] for _ in FIELDS]
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=FIELDS)
            packer.rows = []
            return batch

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                packer.add(doc_id, bpe.ids(text) + end)
                if len(packer.rows) >= ROWS_OUT:
                    yield out()
        packer.finish()
        yield out()

    return map_arrow(id_and_text(docs, id_col, text_col), run, SCHEMA)
