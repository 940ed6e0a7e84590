import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from lossframe.llm import catalog
from lossframe.llm.bpe_fragments import tokenizer_path
from lossframe.llm.packing import Packer, fill


def test_fill_is_optimal():
    rnd = random.Random(1)
    for _ in range(300):
        items = [rnd.randint(1, 30) for _ in range(rnd.randint(0, 9))]
        counts = defaultdict(int)
        for x in items:
            counts[x] += 1
        cap = rnd.randint(0, 60)
        best = max(sum(c) for r in range(len(items) + 1) for c in itertools.combinations(items, r) if sum(c) <= cap)
        got = fill(dict(counts), cap)
        assert sum(x * k for x, k in got.items()) == best
        assert all(k <= counts[x] for x, k in got.items())


def check(rows, want, capacity):
    """Every id in exactly one piece, sequences gapless and little padding."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r[0]].append(r)
        by_seq[r[5]].append(r)
    assert set(by_doc) == set(want)
    for d, pieces in by_doc.items():
        at = 0
        for _, start, length, crc, total, _, _ in sorted(pieces, key=lambda r: r[1]):
            assert start == at and total == len(want[d]) and length > 0
            assert crc == zlib.crc32(want[d][start:start + length].tobytes())
            at += length
        assert at == len(want[d])
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r[6]):
            assert r[6] == at
            at += r[2]
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_packer_pads_little():
    rnd = random.Random(2)
    p, want = Packer(64, 5, pool=100), {}
    for d in range(700):
        ids = np.array([rnd.randint(0, 9) for _ in range(rnd.choice([1, 7, 33, 40, 63, 64, 65, 200]))], "<u4")
        want[d] = ids
        p.add(d, ids.tobytes())
    p.finish()
    assert check(p.rows, want, 64) == 0
    cut = sum(r[1] % 64 != 0 for r in p.rows)  # pieces that start inside a remainder
    assert cut <= 0.1 * len(p.rows)
    assert min(r[5] for r in p.rows) == 5


def test_query(spark, make_docs, sf):
    rnd = random.Random(3)
    words = ["the", "of", "ñandú", "$$$", "日本", "x1", "\n"]
    texts = {i: " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 900))) for i in range(60)}
    texts |= {60: None, 61: "", 62: "word " * 9000, 63: "a<|endoftext|>b", 64: "Ⴧ Ꟃ 𐵀"}
    docs = make_docs(list(texts.items())).withColumnRenamed("source", "offset")
    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = {i: np.array(lib.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for i, t in texts.items()}
    rows = [tuple(r) for r in catalog.op10_packing(spark, sf(documents=docs)).collect()]
    assert check(rows, want, 1024) == 0
    assert catalog.op10_packing(spark, sf(documents=docs.limit(0))).count() == 0
