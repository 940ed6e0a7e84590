import hashlib
import random

import numpy as np
import pytest

from lossframe.llm import catalog, substring_dedup
from lossframe.llm.substring_dedup import phrases, remove_repeats, sliding_argmin


def brute(texts, length=100):
    """doc_id -> (n_bytes, n_removed, n_spans, kept)."""
    seen, out = set(), {}
    for i in sorted(texts):
        raw = (texts[i] or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - length + 1):
            w = raw[s:s + length]
            if w in seen:
                gone[s:s + length] = True
            seen.add(w)
        n_spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-1]])[:len(raw)]).sum()) if len(raw) else 0
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[i] = (len(raw), len(raw) - len(kept), n_spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.fixture(scope="module")
def corpus():
    """Copies, shared passages of many lengths around the limit, one common line, periodic and short texts."""
    rnd = random.Random(11)
    vocab = ["".join(rnd.choice("abcdefghij é") for _ in range(rnd.randint(1, 9))) for _ in range(500)]

    def text(n):
        return " ".join(rnd.choice(vocab) for _ in range(n))

    shared = [text(40) for _ in range(6)]
    line = text(25)
    out = []
    for _ in range(120):
        parts = []
        for _ in range(rnd.randint(1, 5)):
            p = rnd.choice(shared)
            cut = rnd.randint(0, len(p) - 1)
            parts += [text(rnd.randint(0, 20)), p[cut:cut + rnd.randint(60, 220)]]
        out.append(rnd.choice([" ", ""]).join(parts) + (f"\n{line}\n{rnd.random()}" if rnd.random() < 0.6 else ""))
    out += [out[3]] * 30 + [out[5][:400]] * 5 + ["x" * 3000, "x" * 99, "x" * 100, "ab" * 400, "abc" * 300 + "abd" * 200,
                                                 None, "", "é" * 120, out[7][1:], text(4000), text(10) * 60]
    rnd.shuffle(out)
    return {i * 3 - 40: t for i, t in enumerate(out)}


def digests(rows):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}


def test_query_equals_brute_force(spark, make_docs, sf, corpus):
    docs = make_docs(list(corpus.items())).withColumnRenamed("lang", "packed").repartition(5)
    rows = catalog.op2_parse_dedup(spark, sf(documents=docs)).collect()
    assert digests(rows) == brute(corpus) and len(rows) == len(corpus)


def test_batch_borders_and_long_texts(spark, make_docs, corpus, monkeypatch):
    """Small Arrow batches cut the sorted groups; texts longer than a slice are parsed in pieces."""
    own = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        few = dict(list(corpus.items())[:60])
        rows = catalog.removal_digest(remove_repeats(make_docs(list(few.items())))).collect()
        assert digests(rows) == brute(few)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", own)
    monkeypatch.setattr(substring_dedup, "SLICE_BYTES", 900)
    raw = np.frombuffer("".join(t or "" for t in few.values()).encode(), np.uint8)
    seen = set()
    for part, bounds, first in substring_dedup.pieces(raw, np.array([0, len(raw)]), 100):
        for _, s, n, _, _ in zip(*phrases(part, bounds, 100)):
            new = set(range(first + s, first + s + n))
            assert not seen & new
            seen |= new
    assert seen == set(range(len(raw) - 99))


def test_null_and_repeated_ids_and_empty_table(make_docs):
    long = "some words that go on and on " * 3 + "until a hundred bytes and a few more are reached, no repeats 123"
    docs = make_docs([(None, long), (1, long), (1, long), (2, "zz " + long), (2, "own"), (4, long)])
    got = sorted((r.doc_id or 0, len(r.kept), [(s.start, s.end) for s in r.spans]) for r in remove_repeats(docs).collect())
    n = len(long)
    # of id 2 the smallest text takes part, which is "own"
    assert got == [(0, n, []), (1, n, []), (1, n, []), (2, 3, []), (2, n + 3, []), (4, 0, [(0, n)])]
    assert remove_repeats(make_docs([])).count() == 0


def test_sliding_argmin():
    rnd = np.random.default_rng(0)
    h = rnd.integers(0, 9, 500).astype(np.uint64) << np.uint64(24)
    for width in (1, 2, 7, 500):
        want = [s + int(np.argmin(h[s:s + width])) for s in range(500 - width + 1)]
        assert sliding_argmin(h, width).tolist() == want


def test_many_phrases_of_one_trigger(spark):
    """Different texts around one common passage: all are one trigger's phrases, none holds another's window."""
    rnd = np.random.default_rng(5)
    grams = rnd.integers(33, 127, 200_000 + substring_dedup.GRAM).astype(np.uint8)
    at = np.arange(200_000)
    best = int(np.argmin(substring_dedup.Hasher(grams)(at, at + substring_dedup.GRAM)))
    passage = grams[best:best + substring_dedup.GRAM].tobytes().decode()
    n = 60_000
    own = rnd.integers(33, 127, (n, 52)).astype(np.uint8)
    texts = [passage.join((o[:26].tobytes().decode(), o[26:].tobytes().decode())) for o in own]
    triggers = phrases(np.frombuffer("".join(texts).encode(), np.uint8), np.arange(n + 1) * 100, 100)[3]
    assert len(set(texts)) == n and np.unique(triggers, return_counts=True)[1].max() > 0.99 * n
    docs = spark.createDataFrame(list(enumerate([*texts, texts[7]])), "doc_id long, text string").repartition(6)
    gone = remove_repeats(docs).where("size(spans) > 0").select("doc_id").collect()
    assert [r.doc_id for r in gone] == [n]
