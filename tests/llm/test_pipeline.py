"""Each stage on its own input against a brute-force version of it, and the whole run."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline as P
from lossframe.llm.bpe_fragments import tokenizer_path
from lossframe.llm.pii_crf import base_spans
from lossframe.llm.quality_crf import judge, train_line_model

from .test_line_dedup import WORD, brute as brute_lines
from .test_near_dedup import brute as brute_near

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Input and output of every stage, by name."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in P.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        done = spark.read.parquet(str(folder / name))
        out[name] = (docs, done)
        docs = done
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_names_columns_and_order(steps):
    assert [n for n, _ in P.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "personal_data", "packing"]
    for name, (_, done) in steps.items():
        if name != "packing":
            assert done.columns == COLUMNS
            assert all(r.n_chars == len(r.text) for r in done.collect()) or name == "quality_rules"


def test_quality(spark, steps):
    docs, done = steps["quality_rules"]
    model = train_line_model(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in judge(docs, model).where("kept").collect()}
    assert texts(done) == {i: t for i, t in texts(docs).items() if i in want} and 0 < len(want) < docs.count()
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    failed = {r.doc_id for r in judge(docs, None).where("base_failed").collect()}
    assert good - failed <= want


def test_line_dedup(steps):
    docs, done = steps["line_dedup"]
    before, gone = texts(docs), brute_lines(texts(docs))
    want = {i: "\n".join(s for k, s in enumerate(t.split("\n")) if k not in gone[i][1]) for i, t in before.items()}
    assert texts(done) == {i: t for i, t in want.items() if not gone[i][1] or WORD.search(t)}


def test_near_dedup(steps):
    docs, done = steps["near_dedup"]
    assert texts(done) == {i: t for i, t in texts(docs).items() if brute_near(texts(docs))[i][2]}


def test_personal_data(steps):
    docs, done = steps["personal_data"]
    after = texts(done)
    assert set(after) == set(texts(docs))
    for i, t in texts(docs).items():
        assert not base_spans(after[i])
        if not any(c.isdigit() or c == "@" for c in t):
            assert after[i] == t


def test_packing(steps):
    docs, done = steps["packing"]
    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = {i: np.array(lib.encode(t, add_special_tokens=False).ids + [0], "<u4") for i, t in texts(docs).items()}
    pieces, sequences = defaultdict(list), defaultdict(int)
    for r in done.collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id] += r.length
    assert set(pieces) == set(want) and max(sequences.values()) <= 1024
    for i, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want[i])
            assert r.ids_crc32 == zlib.crc32(want[i][at:at + r.length].tobytes())
            at += r.length
        assert at == len(want[i])


def test_run_equals_stages(spark, steps):
    whole = {(r.doc_id, r.start, r.ids_crc32) for r in E.queries()["pipeline"](spark, SF).collect()}
    got = defaultdict(int)
    for r in steps["packing"][1].collect():
        got[r.doc_id] += r.length
    again = defaultdict(int)
    for r in P.run(spark, SF).collect():
        again[r.doc_id] += r.length
    assert got == again and {i for i, _, _ in whole} == set(got)
    assert "pipeline" not in E.oracle_sql()


def test_empty_and_null(spark, make_docs, sf):
    docs = make_docs([(None, None), (1, None), (2, ""), (3, "a quiet line of more than ten plain words that says little")])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = P.run(spark, sf(documents=docs, labels=labels)).collect()
    assert {r.doc_id for r in rows} == {3}
    assert P.run(spark, sf(documents=docs.limit(0), labels=labels)).count() == 0


@pytest.fixture(autouse=True)
def small_rarity_table(monkeypatch):
    """The rarity table only orders the work; a small one is made faster (test_line_dedup.py has the full one)."""
    from lossframe.llm import line_dedup

    monkeypatch.setattr(line_dedup, "BUCKETS", 1 << 16)
