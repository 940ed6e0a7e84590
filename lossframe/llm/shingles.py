"""Word shingles and min-max hash signatures of text batches, in numpy."""

from __future__ import annotations

import numpy as np

from lossframe.llm.common import BASES, LOWER, mix, string_hashes, window_hashes, word_bounds


def word_hashes(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document index) of every word, A-Z lower-cased."""
    start, end, doc = word_bounds(raw, offs)
    return string_hashes(LOWER[raw], start, end), doc


def shingle_sets(raw: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document index) of the distinct shingles of every document, by document, then hash.

    A shingle is ``width`` words in a row; a document with fewer words is one shingle; without words none.
    """
    words, doc = word_hashes(raw, offs)
    if not len(words):
        return words, doc
    n_docs = len(offs) - 1
    count = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(count) - count
    length = np.minimum(count, width)[doc]
    at = np.arange(len(words))
    starts = at[at + length <= (first + count)[doc]]
    of = doc[starts]
    h = window_hashes(words, starts, length[starts])
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[fresh], of[fresh]


def bounds_of(of: np.ndarray, n_docs: int) -> np.ndarray:
    """Offsets of each document's run in a sorted index."""
    return np.searchsorted(of, np.arange(n_docs + 1))


def multipliers(n: int, seed: int = 20) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def min_max_signature(h: np.ndarray, starts: np.ndarray, permutations: int) -> np.ndarray:
    """(documents, 2 * permutations): smallest and largest value under each permutation, of non-empty sets."""
    out = np.empty((len(starts), 2 * permutations), np.uint64)
    for k, a in enumerate(multipliers(permutations)):
        v = h * a
        v ^= v >> np.uint64(32)
        out[:, 2 * k] = np.minimum.reduceat(v, starts)
        out[:, 2 * k + 1] = np.maximum.reduceat(v, starts)
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """(documents, bands): hash of each band of ``rows`` values. The values of a band come from
    different permutations."""
    n, size = signature.shape
    bands = size // rows
    out = np.empty((n, bands), np.uint64)
    for b in range(bands):
        key = np.full(n, b + 1, np.uint64)
        for r in range(rows):
            key = mix(key * np.uint64(BASES[0]) + signature[:, b + r * bands])
        out[:, b] = key
    return out
