"""Helpers shared by the operators: tables, Arrow text batches, vectorised string hashes."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a numpy step handles at once; bounds a Python worker's memory.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python this package's code (once a session), so that jobs run where it isn't installed."""
    sc = spark.sparkContext
    if getattr(sc, "_lossframe_code", None) is None:
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="lossframe-code-")) / "lossframe.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(Path(root.name) / p.relative_to(root)))
        sc.addPyFile(str(archive))
        sc._lossframe_code = str(archive)


def map_arrow(df: DataFrame, step: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with this package available to the executors."""
    ship_package(df.sparkSession)
    return df.mapInArrow(step, schema)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns every text operator reads: null text counts as empty, other columns stay unread."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts back to back as uint8, offsets of each text) of an Arrow string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, text_index: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` bytes of text; a longer text is alone in its run."""
    _, offs = text_buffers(batch.column(text_index))
    start, n = 0, batch.num_rows
    while start < n:
        end = int(np.searchsorted(offs, offs[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield batch.slice(start, end - start)
        start = end


# ---------------------------------------------------------------------------
# Substring hashes mod 2**64 from prefix sums: h(s, e) = (P[e] - P[s]) * B**-s
# ---------------------------------------------------------------------------

#: Odd bases (3 mod 8, so of full multiplicative order); two give independent hashes.
BASES = (0x9E3779B97F4A7C13, 0xC2B2AE3D27D4EB4B)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done:done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit value over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Hasher:
    """Hashes of substrings of one byte buffer (or of any integer sequence)."""

    def __init__(self, values: np.ndarray, base: int = BASES[0]):
        n = len(values)
        self._inv = powers(pow(base, -1, 1 << 64), n + 1)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(base, n), out=prefix[1:])
        self._prefix = prefix

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._prefix[end] - self._prefix[start]) * self._inv[start])


# ---------------------------------------------------------------------------
# Hashes of whole strings: no sum over positions is linear in the bytes, so that no family of strings is known to meet
# ---------------------------------------------------------------------------

#: Bytes whose terms are held at once.
HASH_BLOCK = 1 << 17


def string_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = BASES[0]) -> np.ndarray:
    """64-bit hashes of the strings raw[start:end], which stand one behind the other without overlap.

    The sum mod 2**64 of one mixed term for each (place in the string, byte), finished with the length. A polynomial
    mod 2**64 (``Hasher``) is the same for certain strings of 1,024 bytes and more whatever its base is, so it
    is left to windows of bounded length. Memory is a block of terms beside 16 bytes a string.
    """
    n = len(start)
    if not n:
        return np.zeros(0, np.uint64)
    at_start, at_end = np.zeros(n, np.uint64), np.zeros(n, np.uint64)  # sums of all terms before either bound
    total = np.zeros(1, np.uint64)
    first, last = int(start[0]), int(end[-1])
    for lo in range(first, last, HASH_BLOCK):
        hi = min(lo + HASH_BLOCK, last)
        s0, s1 = np.searchsorted(start, (lo, hi))  # strings that begin in this block
        heads = start[s0:s1]
        origin = np.concatenate([start[max(s0 - 1, 0):max(s0, 1)], heads])
        place = np.arange(lo, hi, dtype=np.int64)
        place -= np.repeat(origin, np.diff(np.concatenate([[lo], heads, [hi]])))
        key = place.view(np.uint64)
        key <<= np.uint64(8)
        key |= raw[lo:hi]
        key += np.uint64(1)
        key *= np.uint64(seed)
        sums = np.concatenate([total, mix(key)])
        np.cumsum(sums, out=sums)
        at_start[s0:s1] = sums[heads - lo]
        e0, e1 = np.searchsorted(end, (lo, hi), side="right")  # bounds in lo + 1 .. hi
        at_end[e0:e1] = sums[end[e0:e1] - lo]
        total = sums[-1:]
    size = end - start
    full = size > 0  # an empty string may stand outside every block
    out = np.where(full, at_end - at_start, np.uint64(0))
    return mix(out + size.astype(np.uint64) * np.uint64(seed))


def window_hashes(values: np.ndarray, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """64-bit hashes of values[start:start + length] (64-bit values, short windows), mixed anew after every value."""
    length = np.broadcast_to(np.asarray(length), start.shape)
    out = length.astype(np.uint64)
    for k in range(int(length.max(initial=0))):
        inside = length > k
        if inside.all():
            out = mix(out * np.uint64(BASES[1]) + values[start + k])
        else:
            out[inside] = mix(out[inside] * np.uint64(BASES[1]) + values[start[inside] + k])
    return out


# ---------------------------------------------------------------------------
# Words: [^\x20\x09-\x0D]+
# ---------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_bounds(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document index) of every word; words never cross documents."""
    if len(raw) == 0:
        e = np.zeros(0, np.int64)
        return e, e, e
    word = ~_SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offs] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | first[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | first[1:-1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offs, start, side="right") - 1


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
