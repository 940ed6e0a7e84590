import random
import re
from collections import Counter

import numpy as np
import pytest

from lossframe.llm import catalog
from lossframe.llm.crf import Crf, train
from lossframe.llm.quality_crf import judge, keep_good, train_line_model

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed)


def stats(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


TEXTS = [None, "", " \n\t ", "a b c d e a b c d e", " é ß 日本 #*$%&|<>\n\nx\nx\n x", "word\n" * 30,
         "one two three four five six seven eight nine ten eleven. Twelve", "x" * 50_000, "# " * 20_000,
         "a b\r\na b\r\n", "s t u v w x s t u v w y s t u v w " + " ".join(f"n{i}" for i in range(80))]


def test_statistics_equal_brute_force(spark, make_docs):
    rnd = random.Random(2)
    texts = TEXTS + ["".join(rnd.choice(["a", "b", " ", "\n", "|", "é", "\x0b", "$ "]) for _ in range(rnd.randint(0, 200)))
                     for _ in range(300)]
    docs = make_docs(list(enumerate(texts)) + [(6, texts[6])]).withColumnRenamed("lang", "kept")
    rows = judge(docs, None).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert stats(r) == brute(texts[r.doc_id]), repr(texts[r.doc_id])[:200]
        assert r.kept == (not r.base_failed)


def test_query_held_out_accuracy(spark):
    """Trained on the sampled labels, judged on the given table: good documents stay, bad ones go."""
    rows = {r.doc_id: r for r in catalog.op9_quality_crf(spark, "/root/testdata/sf0.1").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = train_line_model(docs, labels.where("doc_id % 2 = 0"))
    odd = {r.doc_id: r.kept for r in judge(docs.where("doc_id % 2 = 1"), model).collect()}
    good = [r.doc_id for r in labels.where("quality = 1 AND doc_id % 2 = 1").collect()]
    bad = [r.doc_id for r in labels.where("quality = 0 AND doc_id % 2 = 1").collect()]
    assert all(odd[i] for i in good if not rows[i].base_failed)
    assert sum(odd[i] for i in bad) <= 0.05 * len(bad)
    assert len(rows) == 10000


def test_filter_passes_columns_and_cases(spark, make_docs):
    good = "This is a quiet line of twelve plain words that reads quite well."
    docs = make_docs([(1, good), (2, None), (None, good), (1, good), (3, "a")])
    got = keep_good(docs, None)
    assert got.schema == docs.schema and sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, good), (1, good), (1, good)]
    assert keep_good(docs.limit(0), None).count() == 0
    assert train_line_model(docs, labels_of(spark, [(1, 1, 0), (None, 0, 0), (3, None, 0)])) is None
    assert train_line_model(docs, labels_of(spark, [])) is None
    both = train_line_model(docs, labels_of(spark, [(1, 1, 0), (3, 0, 0), (1, 1, 1)]))
    assert keep_good(docs, both).count() >= 1


def test_viterbi_and_training():
    rnd = np.random.default_rng(0)
    crf = Crf(rnd.normal(size=(5, 3)), np.array([0, 2]), rnd.normal(size=(3, 3)), rnd.normal(size=3))
    lengths = np.array([1, 4, 0, 6, 3])
    features = np.stack([rnd.integers(0, 2, 14), rnd.integers(0, 3, 14)], axis=1)
    import itertools
    scores, want, at = crf.emissions(features), [], 0
    for n in lengths:
        best = max(itertools.product(range(3), repeat=n), default=(), key=lambda p: (
            crf.start[p[0]] + scores[at, p[0]] + sum(crf.transitions[p[i - 1], p[i]] + scores[at + i, p[i]] for i in range(1, n))
            if p else 0))
        want += best
        at += n
    assert crf.decode(features, lengths).tolist() == want
    # a hidden two-state chain is learned
    labels, x = [], []
    for _ in range(200):
        s = 0
        for _ in range(20):
            s = s if rnd.random() < 0.9 else 1 - s
            labels.append(s)
            x.append([s if rnd.random() < 0.8 else 1 - s])
    model = train(np.array(x), np.array(labels), np.full(200, 20), [2], 2)
    found = model.decode(np.array(x), np.full(200, 20))
    assert (found == labels).mean() > (np.array(x)[:, 0] == labels).mean() + 0.05


def test_long_document_leaves_both_classes(spark, make_docs):
    """A document with more lines than a class's budget, first in the order of the sample, leaves the others in."""
    first = min(range(1, 41), key=lambda i: spark.range(1).selectExpr(f"xxhash64({i}L)").first()[0])
    good = "This is a quiet line of twelve plain words that reads quite well."
    docs = make_docs([(i, "# | $ | %\n" * 500 if i == first else f"{good}\n{good} {i}") for i in range(1, 41)])
    labels = labels_of(spark, [(i, int(i != first), 0) for i in range(1, 41)])
    model = train_line_model(docs, labels, sample_lines=40)
    assert model is not None
    kept = {r.doc_id for r in judge(docs, model).where("content_words > n_words / 2").collect()}
    assert kept == set(range(1, 41)) - {first}
