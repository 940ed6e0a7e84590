import hashlib
import random
import re

import pytest

from lossframe.llm import catalog
from lossframe.llm.pii_crf import BASE_KINDS, KINDS, base_spans, find_pii, luhn, read_examples, redact, train_field

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile("[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
PIECES = ["a", "b@", "@", ".", "x.y", "1", "22", "255", "256", "-", " ", "+", "(", "614", ")", "4111111111111111",
          "4929963689861572", "é", "\n", "%", "0"]


def digits(m):
    return re.sub("[^0-9]", "", m[0])


def brute(t):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


@pytest.fixture(scope="module")
def field():
    return train_field(read_examples())


def test_base_patterns_on_random_texts():
    rnd = random.Random(1)
    for _ in range(20_000):
        t = "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 22)))
        assert base_spans(t) == brute(t), repr(t)
    assert luhn("4111111111111111") and not luhn("4111111111111112")


def test_long_texts_stay_linear():
    for t in ("7" * 120_000, "a" * 120_000 + "@", "1." * 60_000, "+1" + " (" * 60_000, "1 " * 60_000):
        base_spans(t)


def test_field_learns_examples_and_generalises(field):
    hits = total = wrong = 0
    for text, spans in read_examples():
        got = field.spans([text])[0]
        total += len(spans)
        hits += sum(any(s < e2 and s2 < e for s2, _, e2 in got) for s, _, e in spans)
        wrong += 0 if spans else len(got)
    assert hits >= 0.9 * total and wrong == 0
    assert [(KINDS[k], s, e) for s, k, e in field.spans(["ring us at (212) 555-0199 ."])[0]] == [("field_phone", 11, 25)]
    for plain in ("it was 1987 when 40 came", "in 3.1 and 4.12 see", "4111111111111112 items of 3"):
        assert field.spans([plain])[0] == []


def test_query_keeps_base_spans(spark, make_docs, sf):
    texts = [None, "", "no data", "mail jane@mail.example.com, or +1 (614) 555-8001 ß 97.51.17.173",
             "é" * 9 + " 4417744351547343 4417744280351547 x", "ring (614) 555-8001 now", "9" * 30_000, "a@b.c a@b.c"]
    docs = make_docs([(i, t) for i, t in enumerate(texts)] + [(7, texts[7])]).withColumnRenamed("lang", "spans")
    rows = catalog.op3_pii_crf(spark, sf(documents=docs)).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        want = brute(texts[r.doc_id] or "")
        base = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for _, k, _ in want) for i in range(4))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) - {""} <= set(r.spans.split(","))
    assert catalog.op3_pii_crf(spark, sf(documents=docs.limit(0))).count() == 0


def test_held_out_agreement_with_patterns(spark):
    """On given documents the field alone finds what the patterns find."""
    from lossframe.llm.pii_crf import _labels, stretches, train_from
    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    field = train_from(docs.where("doc_id % 2 = 0"))
    texts = [r.text for r in docs.where("doc_id % 2 = 1").collect()]
    seq = stretches(texts)
    gold = _labels(seq, [base_spans(t) for t in texts])
    got = field.crf.decode(field.features(texts, seq), np.array(seq.lengths))
    own = gold > 0
    assert (got[own] == gold[own]).mean() > 0.95 and (got[~own] == 0).mean() > 0.98


def test_redact(spark, make_docs, field):
    docs = make_docs([(1, "to +1 (614) 555-8001, x"), (2, None), (3, "clean"), (None, "a@b.example")])
    got = redact(docs, field)
    assert got.schema == docs.schema
    rows = {r.doc_id: (r.text, r.n_chars) for r in got.collect()}
    assert rows == {1: ("to [phone], x", 13), 2: (None, None), 3: ("clean", 5), None: ("[email]", 7)}
    assert find_pii(docs.limit(0), field).count() == 0 and len(BASE_KINDS) == 4
