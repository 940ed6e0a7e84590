"""Hashes of strings: the same as grouping the strings themselves, on families that meet under a polynomial mod 2**64."""

import random

import numpy as np
import pytest

from lossframe.llm import common
from lossframe.llm.common import BASES, Hasher, string_hashes, window_hashes
from lossframe.llm.near_dedup import near_duplicates
from lossframe.llm.quality_crf import judge


def thue_morse(n, flip=0):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def joined(strings):
    raw = np.frombuffer(b"".join(strings), np.uint8)
    offs = np.cumsum([0] + [len(s) for s in strings])
    return raw, offs[:-1], offs[1:]


@pytest.mark.parametrize("n", [1024, 2048, 8192])
def test_thue_morse_strings_differ(n):
    raw, start, end = joined([thue_morse(n).encode(), thue_morse(n, 1).encode()] * 2)
    poly = Hasher(raw, BASES[0])(start, end)
    assert poly[0] == poly[1]  # the family that the whole-string hash is for
    h = string_hashes(raw, start, end)
    assert h[0] != h[1] and h[0] == h[2] and h[1] == h[3]


@pytest.mark.parametrize("block", [1, 3, 7, 1 << 17])
def test_equal_exactly_where_the_strings_are(monkeypatch, block):
    monkeypatch.setattr(common, "HASH_BLOCK", block)
    rnd = random.Random(block)
    strings = [bytes(rnd.choice(b"\x00\x01a") for _ in range(rnd.choice([0, 0, 1, 2, 3, 5, 9]))) for _ in range(400)]
    raw, start, end = joined(strings)
    h = string_hashes(raw, start, end)
    assert len(set(h.tolist())) == len(set(strings)) == len(set(zip(strings, h.tolist())))
    gaps = [s + b"|" * rnd.randint(0, 3) for s in strings]  # bytes between strings belong to none
    raw, start, _ = joined(gaps)
    assert np.array_equal(string_hashes(raw, start, start + [len(s) for s in strings]), h)
    assert len(string_hashes(raw, start[:0], end[:0])) == 0


def test_windows_of_any_length():
    values = np.array([1, 2, 1, 2, 1, 0, 0], np.uint64)
    start, length = np.array([0, 2, 1, 0, 4, 5, 6]), np.array([2, 2, 2, 3, 1, 1, 1])
    h = window_hashes(values, start, length).tolist()
    keys = [tuple(values[s:s + n].tolist()) for s, n in zip(start, length)]
    assert h[0] == h[1] and h[5] == h[6] and len(set(h)) == len(set(keys))


def test_operators_tell_such_words_and_lines_apart(make_docs):
    texts = {}
    for i, n in enumerate((1024, 2048, 4096, 8192)):
        one, other = thue_morse(n), thue_morse(n, 1)
        tail = "q w e r " + " ".join(f"n{k}" for k in range(20))
        texts |= {10 * i: f"{one}\n{other}\n{tail}", 10 * i + 1: f"{one} {tail}", 10 * i + 2: f"{other} {tail}",
                  10 * i + 3: f"a b c d {one}", 10 * i + 4: f"a b c d {other}",
                  10 * i + 5: f"a b c d {one} a b c d {other} " + " ".join(f"m{k}" for k in range(80))}
    docs = make_docs(sorted(texts.items()))
    for r in judge(docs, None).collect():
        assert (r.n_dup_lines, r.n_repeat_words) == (0, 0), r.doc_id
    rows = {r.doc_id: r for r in near_duplicates(docs).collect()}
    for i in range(4):  # five words of which one differs are one shingle, and another one
        assert rows[10 * i + 3].component_id == 10 * i + 3 and rows[10 * i + 4].component_id == 10 * i + 4
        # 21 shingles each, the first of them different: 20 of 22 are shared
        assert rows[10 * i + 1].n_shingles == rows[10 * i + 2].n_shingles == 21
        assert rows[10 * i + 1].component_id == rows[10 * i + 2].component_id
