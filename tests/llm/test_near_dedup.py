import random
import re

import pytest

from lossframe.llm import catalog
from lossframe.llm.components import components
from lossframe.llm.near_dedup import near_duplicates

WORD = re.compile("[^\x20\x09-\x0d]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(UP))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(texts):
    ids = sorted(texts)
    sets, parent = {i: shingles(texts[i]) for i in ids}, {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies around the threshold, a passage that many share, chains, empty and short texts."""
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(400)]

    def text(n):
        return [rnd.choice(vocab) for _ in range(n)]

    out, base, passage = [], text(120), text(60)
    for _ in range(90):  # a hot group with 0 to 6 edits each
        w = list(base)
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        out.append(" ".join(w))
    out += [" ".join(text(rnd.randint(5, 60)) + passage + text(rnd.randint(0, 30))) for _ in range(60)]
    for _ in range(25):  # chains: each a little further from the first
        w = text(80)
        for _ in range(4):
            out.append("\n".join(w))
            w = w[6:] + text(6)
    out += [None, "", " \t\n", "a b", "A  b", "x", "x " * 20_000, "É é É é É é", "é É é É é É", out[0], out[0].upper()]
    rnd.shuffle(out)
    return dict(enumerate(out))


def test_query_equals_brute_force(spark, make_docs, sf, corpus):
    docs = make_docs(list(corpus.items())).withColumnRenamed("lang", "component_id")
    rows = catalog.op5_minmax_dedup(spark, sf(documents=docs)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == brute(corpus)
    assert len(rows) == len(corpus)


def test_null_and_repeated_ids_and_empty_table(make_docs):
    t = "one two three four five six"
    rows = near_duplicates(make_docs([(None, t), (3, t), (3, t), (5, t), (7, "other words here")])).collect()
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in rows)
    assert got == [(0, None, True), (3, 3, True), (3, 3, True), (5, 3, False), (7, 7, True)]
    assert near_duplicates(make_docs([])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 120), (7, 7), (None, 3), (200, 100)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "x long, y long")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 90 for i in (90, 100, 120, 200)}
