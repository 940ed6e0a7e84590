import random
import zlib

import numpy as np
import pytest

from lossframe.llm import catalog, toxicity as T
from lossframe.llm.common import text_buffers

LABELS = "doc_id long, quality int, toxic int, score double"


def text_of(rnd, toxic, words=40):
    out = ["".join(rnd.choice(["ba", "ko", "ri", "te", "lu", "sé"]) for _ in range(rnd.randint(1, 4))) for _ in range(words)]
    for _ in range(3 if toxic else 0):
        out[rnd.randrange(words)] = rnd.choice(["zwirg", "Gromph", "PLUXK"])
    return " ".join(out)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(13)
    rows = [(i, text_of(rnd, i % 6 == 0), int(i % 6 == 0)) for i in range(700)]
    return rows + [(700 + i, text_of(rnd, True, 30_000), 1) for i in range(2)]


def test_query_learns_and_separates(spark, make_docs, sf, corpus):
    rows = [(i, t) for i, t, _ in corpus] + [(5000, None), (5001, ""), (None, "zwirg"), (3, corpus[3][1])]
    # labels of held out rows are all wrong: they must not be learnt
    labels = [(i, 1, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y, 0.0) for i, _, y in corpus]
    labels += [(None, 1, 1, 0.0), (9999, 0, 1, 0.0), (1, 1, None, 0.0), (2, 1, 7, 0.0)]
    docs = make_docs(rows).withColumnRenamed("n_chars", "score").withColumnRenamed("source", "held_out")
    got = catalog.op13_toxicity(spark, sf(documents=docs, labels=spark.createDataFrame(labels, LABELS))).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    truth = {i: y for i, _, y in corpus}
    test = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    caught = np.mean([r.predicted for r in test if truth[r.doc_id]])
    alarms = np.mean([r.predicted for r in test if not truth[r.doc_id]])
    assert caught >= 0.95 and alarms <= 0.02
    by_id = {r.doc_id: r for r in got}
    assert by_id[5000].score == by_id[5001].score < 0.5 and not by_id[None].held_out


def test_given_table_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = catalog.op13_toxicity(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    rows = got.select("predicted", "toxic").collect()
    assert np.mean([r.predicted for r in rows if r.toxic == 0]) < 0.01
    assert np.mean([r.predicted for r in rows if r.toxic == 1]) > 0.8


def test_one_class_and_empty(spark, make_docs, sf):
    docs = make_docs([(1, "some text here"), (2, None)])
    labels = spark.createDataFrame([(1, 1, 0, 0.0), (2, 1, 1, 0.0)], LABELS)
    with pytest.warns(UserWarning, match="both classes"):
        model = T.train_toxicity(docs, labels)
    assert [round(r.score, 6) for r in T.score_toxicity(docs, model).collect()] == [0.5, 0.5]
    with pytest.warns(UserWarning):
        got = catalog.op13_toxicity(spark, sf(documents=docs.limit(0), labels=labels.limit(0)))
    assert got.count() == 0
    with pytest.warns(UserWarning):
        none = T.train_toxicity(docs, labels.limit(0))
    assert {r.score for r in T.score_toxicity(docs, none).collect()} == {0.0} or max(
        r.score for r in T.score_toxicity(docs, none).collect()) < 1e-100


def test_chunks_do_not_matter(monkeypatch):
    import pyarrow as pa

    rnd = random.Random(2)
    texts = ["", "ab", text_of(rnd, True, 60), "日本語éÀ" * 30, "", "abc" * 50]
    buffers = text_buffers(pa.array(texts))
    whole = T.elements(*buffers)
    monkeypatch.setattr(T, "CHUNK", 7)
    for a, b in zip(whole, T.elements(*buffers)):
        assert np.array_equal(a, b)
    one = [set(T.elements(*text_buffers(pa.array([t])))[1].tolist()) for t in texts]
    assert [set(whole[1][whole[0] == i].tolist()) for i in range(len(texts))] == one
