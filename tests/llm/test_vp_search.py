import math

import numpy as np
import pytest

from lossframe.llm import catalog
from lossframe.llm.vp_search import VpTree, distances, nearest

SCHEMA = "vec_id long, embedding array<float>, label int, rank int"


def brute(rows, asked, k=10):
    def ok(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and ok(v)]
    out = set()
    for q in asked:
        own = sorted((tuple(v) for i, v in good if i == q))
        if not own:
            continue
        near = sorted((distances(np.array([own[0]]), v[None])[0, 0], i) for i, v in good
                      if i != q and len(v) == len(own[0]))
        out |= {(q, r, i, d) for r, (d, i) in enumerate(near[:k], 1)}
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = np.random.default_rng(4)
    out = [(i, rnd.normal(size=8).tolist()) for i in range(700)]
    out += [(1000 + i, [1.0] + [0.0] * 7) for i in range(400)]  # one common vector
    out += [(2000, None), (2001, [0.0] * 8), (2002, [1.0, None] + [0.0] * 6), (2003, [float("nan")] * 8),
            (2004, [float("inf")] * 8), (2005, []), (2006, [1.0, 2.0]), (2100, [1.0, 2.5]), (5, out[5][1]),
            (100, rnd.normal(size=8).tolist()), (None, out[3][1])]
    return out


def test_exact_when_not_relaxed(spark, rows):
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], SCHEMA)
    asked = df.where("vec_id % 100 = 0")
    got = {tuple(r) for r in nearest(df, asked, relax=1.0, shard_rows=300).collect()}
    assert got == brute(rows, [i for i, _ in rows if i is not None and i % 100 == 0])


def test_distances_beyond_the_range_of_squares(spark):
    far = [[1e200, 0.0], [-1e200, 0.0], [1e200, 1e200], [1.7e308, 1.0], [-1.7e308, 1.0], [3.0, 4.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(far)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, df, k=10, shard_rows=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q, v in enumerate(far):
        want = sorted((math.hypot(v[0] - w[0], v[1] - w[1]), i) for i, w in enumerate(far) if i != q)
        assert [i for i, _ in got[q]] == [i for _, i in want]
        for (_, d), (e, _) in zip(got[q], want):
            assert d == e or abs(d - e) <= 1e-12 * e
    tree = VpTree(np.arange(600), np.random.default_rng(3).normal(size=(600, 2)) * 1e200, leaf=16)
    d, _ = tree.search(tree.vectors[:40], np.arange(40), 3, 1.0)
    assert np.array_equal(d, np.sort(distances(tree.vectors[:40], tree.vectors), axis=1)[:, 1:4])


def test_many_copies_of_one_row(spark):
    df = spark.createDataFrame([(7, [1.0, 2.0])] * 3000 + [(i, [float(i), 0.0]) for i in range(10, 60)],
                               "vec_id long, embedding array<double>")
    got = [tuple(r) for r in nearest(df, df.where("vec_id IN (7, 10)"), k=4, shard_rows=500).collect()]
    assert sorted(r[:3] for r in got if r[0] == 10) == [(10, 1, 11), (10, 2, 12), (10, 3, 13), (10, 4, 14)]
    assert sorted(r[:3] for r in got if r[0] == 7) == [(7, k, 9 + k) for k in (1, 2, 3, 4)]
    near = [tuple(r)[:3] for r in nearest(df, df.where("vec_id = 12"), k=30, shard_rows=500).collect()]
    assert sum(v == 7 for _, _, v in near) == 17 and len(near) == 30  # 10, 11 and 13 to 23 are nearer


def test_query_recall_and_empty(spark, rows, sf):
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], SCHEMA)
    got = {tuple(r) for r in catalog.op7_vp_search(spark, sf(embeddings=df)).collect()}
    want = brute(rows, [i for i, _ in rows if i is not None and i % 100 == 0])
    assert len(got & want) >= 0.9 * len(want) and {(q, r) for q, r, *_ in got} == {(q, r) for q, r, *_ in want}
    assert catalog.op7_vp_search(spark, sf(embeddings=df.limit(0))).count() == 0


def test_recall_on_given_table(spark):
    got = catalog.op7_vp_search(spark, "/root/testdata/sf0.01").collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    want = brute(rows, [i for i, _ in rows if i % 100 == 0])
    assert len({tuple(r) for r in got} & want) >= 0.9 * len(want)


def test_tree_prunes_when_relaxed():
    rnd = np.random.default_rng(1)
    v = rnd.normal(size=(3000, 3))
    tree = VpTree(np.arange(3000), v)
    exact = tree.search(v[:50], np.arange(50), 5, 1.0)
    full, tree.computed = tree.computed, 0
    tree.search(v[:50], np.arange(50), 5, 3.0)
    assert tree.computed < full < 50 * 3000
    want = np.sort(distances(v[:50], v), axis=1)[:, 1:6]
    assert np.allclose(exact[0], want)
