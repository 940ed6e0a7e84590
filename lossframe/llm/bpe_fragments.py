"""Byte-pair encoding by forced-boundary splitting.

A merge can only build tokens of the vocabulary. So where two adjacent bytes
of a word never stand side by side inside any token, no merge can cross: the
place is a certain cut, and what lies left and right of it is encoded
independently and concatenated. Texts are normalised and cut into words as the
tokenizer file says, words are cut at their certain boundaries, and each
fragment is merged by rank by a compiled encoder. (It merges the pair whose
joined bytes have the lowest rank. That is the file's pair merging, since every
token of the file is what its own bytes merge to; the tests check this.)

Memory: the vocabulary and a bounded cache of words; a cache that is full
starts anew, which never changes a result. A text with letters or digits newer
than Unicode 3.2, whose class may differ between Unicode versions, is encoded
by the tokenizers library itself.

Defined cases: null text counts as empty and has no ids; special tokens'
strings in a text become their ids, as the library has it by default; rows are
independent, so repeated rows repeat their result and an empty table gives an
empty one; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from lossframe.llm.common import id_and_text, map_arrow

CACHE_ENTRIES = 200_000
#: Stands for the end-of-word suffix; a byte that UTF-8 never has.
END = b"\xff"


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for
    itself, the others follow from U+0100 in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in own:
        out[b] = chr(b)
    for b in range(256):
        if not out[b]:
            out[b] = chr(spare)
            spare += 1
    return out


def settled(text: str, known: set) -> bool:
    """Whether every character has had its class since Unicode 3.2, so that all regex engines agree on it.
    ``known`` collects the characters found so."""
    if text.isascii():
        return True
    new = set(text) - known
    for c in new:
        now, old = unicodedata.category(c), unicodedata.ucd_3_2_0.category(c)
        if now == "Cn" or old == "Cn" and now[0] in "LN":
            return False
    known |= new
    return True


@lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def library_ids(path: str, text: str) -> bytes:
    """Ids by the tokenizers library, as little-endian unsigned 32-bit integers."""
    return np.array(_library(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class _Words(dict):
    """word -> its ids, through the fragments."""

    def __init__(self, bpe: FragmentBpe):
        super().__init__()
        self._bpe = bpe

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        ids = self[word] = self._bpe.encode_word(word.encode("utf-8"))
        return ids


class FragmentBpe:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        self._path, self._known = path, set()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self._read_rules(spec)
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        as_bytes = {t: bytes(byte_of[c] for c in t.removesuffix(suffix) if c in byte_of)
                    + (END if suffix and t.endswith(suffix) else b"") for t in vocab}
        self._end = END if suffix else b""
        # ranks: bytes, then bytes with the end mark, then the merges in their order
        ranks = {bytes([b]): b for b in range(256)}
        if suffix:
            ranks |= {bytes([b]) + END: 256 + b for b in range(255)}
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            ranks.setdefault(as_bytes[a] + as_bytes[b], len(ranks))
        self._core = tiktoken.Encoding("fragments", pat_str=r"(?s).+", mergeable_ranks=ranks,
                                       special_tokens={})._encode_single_piece
        self._id_of = np.zeros(len(ranks), "<u4")
        for token, k in vocab.items():
            if as_bytes[token] in ranks:
                self._id_of[ranks[as_bytes[token]]] = k
        inside = [set() for _ in range(256)]  # inside[x]: bytes that follow x in some token
        for body in as_bytes.values():
            for x, y in zip(body, body[1:]):
                inside[x].add(y)
        self.certain = [bytes(y not in inside[x] for y in range(256)) for x in range(256)]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.tokens = [""] * size
        for token, k in (vocab | self.specials).items():
            self.tokens[k] = token
        self._bytes_of = byte_of
        self._words = _Words(self)

    def _read_rules(self, spec: dict) -> None:
        normal = spec.get("normalizer")
        kinds = [n["type"] for n in normal["normalizers"]] if normal else []
        if kinds not in ([], ["NFC", "Replace", "Lowercase"]):
            raise ValueError(f"unsupported normalizer: {kinds}")
        self._normal = bool(kinds)
        pre = spec["pre_tokenizer"]
        if pre["type"] == "Sequence" and [p["type"] for p in pre["pretokenizers"]] == ["Split", "ByteLevel"]:
            pattern = pre["pretokenizers"][0]["pattern"]["Regex"]
        elif pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        else:
            raise ValueError(f"unsupported pre-tokenizer: {pre}")
        # White_Space is what the library's \s means; the control separators U+001C..1F are not part of it
        self._split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}")
                                    .replace(r"\s", r"\p{White_Space}")).findall
        decoder = spec.get("decoder")
        self._joined_by_space = decoder is None

    def normalise(self, text: str) -> str:
        if not self._normal:
            return text
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # capital sigma: lower-cased alone, not by its place in a word
        return text.lower()

    def fragments(self, word: bytes) -> list[bytes]:
        """The word cut wherever two adjacent bytes never stand together inside a token."""
        certain = self.certain
        cuts = [i for i, (x, y) in enumerate(zip(word, word[1:]), 1) if certain[x][y]]
        return [word[i:j] for i, j in zip([0, *cuts], [*cuts, len(word)])] if cuts else [word]

    def encode_word(self, word: bytes) -> bytes:
        """Ids of one word: its fragments, the last one with the end mark, encoded apart and put together."""
        *inner, last = self.fragments(word)
        ranks = [r for f in inner for r in self._core(f)] + self._core(last + self._end)
        return self._id_of[ranks].tobytes()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self._words.__getitem__, self._split(self.normalise(text))))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not settled(text, self._known):
            return library_ids(self._path, text)
        if self._special is None or not self._special.search(text):
            return self._plain(text)
        out, done = [], 0
        for m in self._special.finditer(text):
            out += [self._plain(text[done:m.start()]), np.array([self.specials[m[0]]], "<u4").tobytes()]
            done = m.end()
        return b"".join([*out, self._plain(text[done:])])

    def decode(self, ids: bytes) -> str:
        """Text of the ids, special tokens kept: byte-level decoding, or tokens joined by spaces without a decoder."""
        tokens = map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())
        if self._joined_by_space:
            return " ".join(tokens)
        out = bytearray()
        for t in tokens:
            out += t.encode("utf-8") if t in self.specials else bytes(map(self._bytes_of.__getitem__, t))
        return out.decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def load_bpe(path: str) -> FragmentBpe:
    """One encoder, with its caches, for each Python worker and file."""
    return FragmentBpe(path)


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids binary (little-endian unsigned 32-bit) of every row. ``tokenizer``: name of the file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_bpe(tokenizer_path(tokenizer))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(bpe.encode, b.column(1).to_pylist()),
                                                                    pa.binary())], names=["doc_id", "ids"])

    return map_arrow(id_and_text(docs, id_col, text_col), run, "doc_id long, ids binary")


def round_trip_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded, then decoded from the ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_bpe(tokenizer_path(tokenizer))
        for b in batches:
            n, hashes, decoded = [], [], []
            for text in b.column(1).to_pylist():
                ids = bpe.encode(text)
                n.append(len(ids) // 4)
                hashes.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(hashes, pa.string()),
                                              pa.array(decoded, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(id_and_text(docs, id_col, text_col), run,
                     "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
