import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from lossframe.llm import catalog
from lossframe.llm.bpe_fragments import FragmentBpe, byte_alphabet, encode_documents, tokenizer_path

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ALPHABET = "aA bB'sS tTreéÉßΣσςİ1٣²½Ⅷ\n\t 　é́<|>endoftext日本🙂\x1c\x85!?$$$ԱꟋ"


@pytest.fixture(scope="module", params=NAMES)
def pair(request):
    path = tokenizer_path(request.param)
    return FragmentBpe(path), Tokenizer.from_file(path)


def test_equals_library_on_random_texts(pair):
    bpe, lib = pair
    rnd = random.Random(5)
    tails = ["", "<|endoftext|>", "<|startoftext|> x", "a" * 900, "the" * 100]
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 40))) + rnd.choice(tails) for _ in range(3000)]
    for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False)):
        ids = bpe.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == e.ids, t
        assert bpe.decode(ids) == lib.decode(e.ids, skip_special_tokens=False), t


def test_every_token_is_what_its_bytes_merge_to(pair):
    """With this, merging by the rank of the joined bytes is the file's merging by pairs."""
    import json

    bpe, _ = pair
    with open(bpe._path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    suffix = model.get("end_of_word_suffix") or ""
    merges = {tuple(m.split(" ") if isinstance(m, str) else m): k for k, m in enumerate(model["merges"])}
    for a, b in merges:
        body = (a + b).removesuffix(suffix)
        symbols = list(body)
        if suffix and (a + b).endswith(suffix):
            symbols[-1] += suffix
        while len(symbols) > 1:
            ranked = [(merges.get(p, len(merges)), i) for i, p in enumerate(zip(symbols, symbols[1:]))]
            rank, i = min(ranked)
            if rank == len(merges):
                break
            symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
        assert symbols == [a + b]


def test_no_token_spans_a_certain_cut(pair):
    bpe, _ = pair
    byte_of = {c: b for b, c in enumerate(byte_alphabet())}
    assert any(any(row) for row in bpe.certain)
    for token in bpe.tokens[:49000:7]:
        body = bytes(byte_of[c] for c in token.removesuffix("</w>") if c in byte_of)
        if token not in bpe.specials:
            assert len(bpe.fragments(body)) <= 1 or "</w>" in token


def test_query_equals_library(spark, make_docs, sf):
    texts = [None, "", "  \n\t", "Hello wörld's 日本 $$$ 123", "x" * 40_000, "a<|endoftext|>b", "ǅ İstanbul ΑΣ"]
    docs = make_docs([(i, t) for i, t in enumerate(texts)] + [(3, texts[3])]).withColumnRenamed("lang", "n_tokens")
    lib = Tokenizer.from_file(tokenizer_path(NAMES[0]))
    rows = catalog.op8_bpe_fragments(spark, sf(documents=docs)).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        ids = lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert catalog.op8_bpe_fragments(spark, sf(documents=docs.limit(0))).count() == 0
    assert encode_documents(docs, NAMES[1]).count() == len(texts) + 1
