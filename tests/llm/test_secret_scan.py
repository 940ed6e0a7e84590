import hashlib
import random
import re

import pytest

from lossframe.llm import catalog
from lossframe.llm.automaton import Automaton
from lossframe.llm.secret_scan import RULES, Scanner, code_point_spans

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.I | re.A)
PIECES = ["token", "TOKEN", "secret", "passwd", "password", "api_key", "apikey", "API_key", " ", "  ", '"', "'", ":",
          "=", "==", "abc", "x", "AKIA", "AKIAABCDEFGH", "1234567890", "ABCDEF0123", "deadbeef", "é", "ß日", "_", "-",
          ".", "\n", "0a1b2c3d"]


def brute(text):
    checks = [("assign", ASSIGN, lambda m: len(m[2]) >= 6),
              ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
              ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(checks) for m in p.finditer(text) if ok(m)]
    return sorted(found)


@pytest.fixture(scope="module")
def scan():
    return Scanner()


def test_scanner_equals_regexes_on_random_texts(scan):
    rnd = random.Random(3)
    for _ in range(4000):
        text = "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 14)))
        raw = text.encode()
        assert [x for x in code_point_spans(raw, scan.spans(raw)) if x[1] < 3] == brute(text), text


def test_method_adds_kinds(scan):
    raw = b"ghp_" + b"a1B2" * 6 + b" xoxb-12345-abcdef -----BEGIN RSA PRIVATE KEY-----"
    assert {RULES[k].kind for _, k, _ in scan.spans(raw)} >= {"hubkey", "botkey", "pem"}


def test_automaton_is_minimal_and_finds_longest():
    a = Automaton([("(?:ab|cb)+", False)])
    assert len(a.rows) == 4  # start, after a/c, after b, dead
    assert a.longest(b"xababc".translate(a.classes), 1) == 5


def test_query_equals_brute_force(spark, make_docs, sf):
    texts = [None, "", "nothing", 'token = "abcdef0123456789abcdef0123" ß token=ab secret:xyz123',
             "é" * 50 + " AKIA" + "ABCD1234" * 3, "f" * 30_000, "token=token = abcdefgh", 'token = "abc123"']
    docs = make_docs([(i, t) for i, t in enumerate(texts)] + [(7, texts[7])]).withColumnRenamed("lang", "spans")
    rows = catalog.op1_secret_scan(spark, sf(documents=docs)).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        want = brute(texts[r.doc_id] or "")
        base = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in want)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in want) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) - {""} <= set(r.spans.split(","))
    assert catalog.op1_secret_scan(spark, sf(documents=docs.limit(0))).count() == 0
