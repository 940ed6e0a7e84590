import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lossframe.llm import catalog, collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=2000):
    """The contract over (lang, text)."""
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, 6):
                    if i + k <= len(w):
                        f[lang][tuple(w[i:i + k])] += 1
    out = set()
    for lang, count in f.items():
        cand = {p: a for p, a in count.items() if len(p) >= 2 and a >= least}
        found = []
        for p, a in cand.items():
            score, k = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            if any(len(q) > len(p) and 100 * b >= 100 * a and any(q[j:j + len(p)] == p for j in range(len(q) - len(p) + 1))
                   for q, b in cand.items()):
                continue
            found.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (s, a, p, le, r) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, p.decode(), -a, le, r, n[lang], -s))
    return out


def corpus(seed, docs):
    rnd = random.Random(seed)
    vocab = ["The", "of", "new", "york", "é", "日本", "a", "b"] + [f"w{i}" for i in range(30)]
    out = []
    for i in range(docs):
        parts = []
        for _ in range(rnd.randint(0, 12)):
            parts.append(rnd.choice(["New York city hall is", "of the of the of the", "one two three four five six", " ".join(
                rnd.choice(vocab) for _ in range(rnd.randint(0, 9)))]))
        out.append((rnd.choice(["en", "en", "fr", None]), rnd.choice([". ", "\n", "\t", "  ", "!", "\x0b"]).join(parts)))
    return out + [("en", None), ("en", ""), (None, "..\n"), ("de", "x y z " * 4000), ("fr", "hot pair " + "q " * 3000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, 1, "x") for i, (lang, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, n_chars long, rank long, phrase string")


def rows_of(df):
    return {tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


@pytest.mark.parametrize("chunk,buffer", [(4 << 20, 500_000), (200, 50)])
def test_equals_brute_force(spark, chunk, buffer, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", chunk)
    monkeypatch.setattr(C, "BUFFER", buffer)
    monkeypatch.setattr(C, "LEAST_SHARE", buffer)
    rows = corpus(3, 300)
    want = brute(rows, 8)
    got = C.collocations(frame(spark, rows), min_count=8)
    assert rows_of(got) == want and len(want) > 60
    few = C.collocations(frame(spark, rows), min_count=8, top=5)
    assert rows_of(few) == brute(rows, 8, 5)


def test_query_equals_brute_force(spark, sf):
    rows = corpus(5, 500)
    assert rows_of(catalog.op12_collocations(spark, sf(documents=frame(spark, rows)))) == brute(rows, 100) != set()


def test_empty(spark, sf):
    assert catalog.op12_collocations(spark, sf(documents=frame(spark, [("en", "a")]).limit(0))).count() == 0
    assert C.collocations(frame(spark, [("en", None), (None, " . ")])).count() == 0


def test_quicksort_counts():
    rnd = np.random.default_rng(1)
    digits = rnd.integers(0, 5, size=(3000, 4))
    digits[rnd.random(3000) < 0.2, 2:] = -1
    weight = rnd.integers(1, 4, size=3000)
    want = collections.Counter()
    for row, w in zip(digits.tolist(), weight.tolist()):
        for k in range(1, 5):
            if -1 not in row[:k]:
                want[tuple(row[:k])] += w
    got = {tuple(digits[r, :k].tolist()): n for r, k, n in C.count_prefixes(digits, weight, 60)}
    assert got == {p: n for p, n in want.items() if n >= 60}


def test_rare_pairs_of_frequent_words_end_suffixes(spark):
    """Words that are all frequent, in pairs of which few are: only those lead to rows, and the counts stay exact."""
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows = [("en", " ".join(rnd.choices(words, k=60)) + ". new york city") for _ in range(100)]
    texts = frame(spark, rows).select("lang", "text")
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 100), pa.array([t for _, t in rows])], names=["lang", "text"])
    (chunk, langs), = C.chunks_of(batch, C.CHUNK)
    keys, every = chunk.word_keys(C.lang_hashes(langs)), np.ones(len(chunk.words), bool)
    word_map = np.full((1 << C.WORD_BITS) // 8, 255, np.uint8)
    for least in (8, 300):  # counts of one and of two bytes
        pairs = C._gram_map(texts, word_map, [], C.gram_width(6300, least), least)
        triples = C._gram_map(texts, word_map, [pairs], 24, least)
        links = C.linked(chunk, keys, every, [pairs, triples])
        assert [int(own.sum()) for own in links] == ([200, 100] if least == 8 else [0, 0])
        found, n = C.suffixes(chunk, links)
        assert n.tolist() == ([100, 100] if least == 8 else []) and (found >= 0).sum() == (5 if least == 8 else 0)
    assert len(C.gram_places(chunk, every, [])) == 100 * 61
    assert rows_of(C.collocations(frame(spark, rows), min_count=8)) == brute(rows, 8) != set()


def test_route_is_bounded_on_few_partitions(spark, monkeypatch):
    """One partition: a leading word of more than MOST_SHARE occurrences is divided all the same."""
    monkeypatch.setattr(C, "MOST_SHARE", 1500)
    monkeypatch.setattr(spark.conf, "get", lambda name, *other: "1" if name.endswith("shuffle.partitions") else type(spark.conf).get(spark.conf, name, *other))
    docs = frame(spark, [("en", "x y z " * 2000)])
    every = spark.createDataFrame([("en", w, 2000) for w in "xyz"], "lang string, w1 string, n long")
    full = np.full((1 << C.WORD_BITS) // 8, 255, np.uint8)
    hot, divided = C._routes(docs.select("lang", "text"), every, 6000, full, [full, full])
    assert len(hot.levels[0]) == 3 and (("en", "x", "y"), 2000) in divided


def test_equal_rows_of_chunks_are_summed():
    def batch(n):
        return pa.RecordBatch.from_pydict({"route": [1, 2], "lang": ["en", "fr"], "phrase": ["a b", "c d"], "n": [n, 1]})
    rows = pa.Table.from_batches(C._summed_rows(iter([batch(3), batch(4)]))).to_pylist()
    assert sorted((r["phrase"], r["n"]) for r in rows) == [("a b", 7), ("c d", 2)]


def test_packs_keep_every_row():
    rng = np.random.default_rng(3)
    route, depth = rng.integers(-2**62, 2**62, 900), rng.integers(1, 3, 900)
    names = ["route", "depth", "lang", "phrase", "n"]
    rows = pa.RecordBatch.from_arrays([pa.array(route), pa.array(depth, pa.int32()), pa.array(["en", "fr", "de"] * 300),
                                       pa.array([f"a b{i}" for i in range(900)]), pa.array(np.arange(900))], names=names)
    packs = [p for b in C._packs(iter([rows]), 4) for p in b.to_pylist()]
    got = {(p["part"], p["depth"], p["lang"], w, n) for p in packs for w, n in zip(p["phrases"], p["n"], strict=True)}
    assert got == {(r["route"] % 2**64 % 4, *[r[c] for c in names[1:]]) for r in rows.to_pylist()} and len(got) == 900
    assert max(len(p["phrases"]) for p in packs) <= C.PACK and len(packs) < 40
