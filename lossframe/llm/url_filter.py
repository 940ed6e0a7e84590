"""URL filter: site rules first, then a weighted vocabulary found by Aho-Corasick.

A url is cut into host and path with column functions. Rules (host, path,
verdict) are few and fixed, so the longest fitting one is a chain of column
conditions. All urls also go through one Aho-Corasick automaton over the
vocabulary: a term counts where it is bounded by non-alphanumerics (ASCII),
each distinct term once. The term weights decide: one strict term reaches the
limit alone, soft terms reach it together.

Defined cases: a null url, or one without ``://``, has empty host and path and
fits no rule; its verdict is the vocabulary's (null: allow). Rows are
independent, so repeated rows give repeated results; an empty table gives an
empty result; columns other than id and url are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossframe.llm.common import map_arrow


@dataclass(frozen=True)
class SiteRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Vocabulary:
    """Strict terms reject alone; ``soft_limit`` distinct soft terms reject together."""

    strict: tuple[str, ...]
    soft: tuple[str, ...]
    soft_limit: int = 2

    def weights(self) -> dict[str, int]:
        return {t: 1 for t in self.soft} | {t: self.soft_limit for t in self.strict}


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c):
    return F.translate(c, UPPER, UPPER.lower())


def split_url(url) -> tuple:
    """(host, path) of a url column; both empty without ``://``."""
    u = F.coalesce(url, F.lit(""))
    host = ascii_lower(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1))
    path = F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return host, path


def longest_rule(host, path, rules: Sequence[SiteRule]) -> tuple:
    """(rule name, rule verdict) of the longest fitting rule, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, r.name).otherwise(name)
        verdict = F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def _term_counter(weights: dict[str, int]):
    """A function from a lower-cased url to (weight of its distinct terms, sorted terms)."""
    import ahocorasick

    if not weights:  # nothing to look for
        return lambda url: (0, [])
    machine = ahocorasick.Automaton()
    for term in weights:
        machine.add_word(term, term)
    machine.make_automaton()

    def plain(ch: str) -> bool:
        return ch.isascii() and ch.isalnum()

    def count(url: str) -> tuple[int, list[str]]:
        found = set()
        for last, term in machine.iter(url):
            first = last - len(term) + 1
            if (first == 0 or not plain(url[first - 1])) and (last + 1 == len(url) or not plain(url[last + 1])):
                found.add(term)
        return sum(weights[t] for t in found), sorted(found)

    return count


_LOWER = str.maketrans(UPPER, UPPER.lower())


def filter_urls(pages: DataFrame, rules: Sequence[SiteRule], vocabulary: Vocabulary,
                id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, term_weight, terms for every row."""
    host, path = split_url(F.col("url"))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    weights, limit = vocabulary.weights(), vocabulary.soft_limit

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _term_counter(weights)
        for b in batches:
            found = [count((u or "").translate(_LOWER)) for u in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([w for w, _ in found], pa.int64()),
                 pa.array([",".join(t) for _, t in found], pa.string())],
                names=["page_id", "url", "term_weight", "terms"])

    scanned = map_arrow(base, scan, "page_id long, url string, term_weight long, terms string")
    parts = scanned.select("page_id", host.alias("host"), path.alias("path"), "term_weight", "terms")
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    return parts.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("term_weight") >= limit, "block").otherwise("allow")).alias("verdict"),
        "term_weight", "terms")
