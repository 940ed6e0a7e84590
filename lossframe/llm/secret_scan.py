"""Secret scan: all rules in one byte pass of one minimal deterministic automaton.

The rules' regexes, read backwards, form one automaton (subset construction,
then minimisation). One pass over a text's UTF-8 bytes from the last to the
first stops in an accepting state exactly where some rule's match can begin,
so the starts of all rules come out of that single pass. From each start in
turn, the rule's own forward automaton finds the longest end; matches of a
kind are taken leftmost first and never overlap. A rule is head + body: a
match whose body is too short is consumed and dropped.

Defined cases: null text counts as empty and has no spans; offsets are code
points, ends exclusive; spans are ordered by start, then by the rules' order;
each row is scanned by itself, so repeated rows repeat their result and an
empty table gives an empty one; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from lossframe.llm.automaton import Automaton
from lossframe.llm.common import id_and_text, map_arrow


@dataclass(frozen=True)
class SecretRule:
    """``head`` then one or more of the character set ``body``, of which at least ``min_body``. ``counted``: the
    automaton itself counts to the minimum (right where a shorter match hides no longer one, as in a plain run)."""

    kind: str
    head: str
    body: str
    min_body: int
    fold: bool = False
    counted: bool = False

    @property
    def pattern(self) -> str:
        return f"{self.head}{self.body}{{{self.min_body if self.counted else 1},}}"


#: Base rules (fixed values), then further kinds of credentials.
BASE_RULES = (
    SecretRule("assign", r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""",
               "[A-Za-z0-9+/_.=-]", 6, fold=True),
    SecretRule("access", "AKIA", "[A-Z0-9]", 16),
    SecretRule("hex", "", "[0-9a-f]", 24, counted=True),
)
MORE_RULES = (
    SecretRule("hubkey", "gh[pousr]_", "[A-Za-z0-9]", 20),
    SecretRule("botkey", "xox[abprs]-", "[A-Za-z0-9-]", 10),
    SecretRule("pem", "-----BEGIN(?: [A-Z]+)+ KEY", "-", 5),
)
RULES = BASE_RULES + MORE_RULES


class Scanner:
    """Spans of every rule in a text."""

    def __init__(self, rules: Sequence[SecretRule] = RULES):
        self.rules = tuple(rules)
        back = Automaton([(r.pattern, r.fold) for r in rules], anywhere=True, backwards=True)
        self._classes, self._start = back.classes, back.linked()[0]
        self._match = [Automaton([(r.pattern, r.fold)]) for r in rules]
        self._head = [Automaton([(r.head, r.fold)]) for r in rules]

    def starts(self, raw: bytes) -> dict[int, list[int]]:
        """For each rule index, all byte positions where one of its matches can begin, ascending."""
        out: dict[int, list[int]] = {}
        state = self._start
        steps = iter(raw.translate(self._classes)[::-1])
        for c in steps:
            state = state[c]
            if state[-1]:
                at = steps.__length_hint__()  # bytes still unread are those before this one
                for k in state[-1]:
                    out.setdefault(k, []).append(at)
        for found in out.values():
            found.reverse()
        return out

    def spans(self, raw: bytes) -> list[tuple[int, int, int]]:
        """(start, rule index, end) in bytes, sorted."""
        out = []
        for k, starts in self.starts(raw).items():
            rule, match, head = self.rules[k], self._match[k], self._head[k]
            coded, cursor = raw.translate(match.classes), 0
            head_coded = None if rule.counted else raw.translate(head.classes)
            for s in starts:
                if s < cursor:
                    continue
                cursor = match.longest(coded, s)
                if rule.counted or cursor - head.longest(head_coded, s) >= rule.min_body:
                    out.append((s, k, cursor))
        return sorted(out)


@lru_cache(maxsize=4)
def scanner(rules: tuple[SecretRule, ...] = RULES) -> Scanner:
    """Compiled once for each Python worker."""
    return Scanner(rules)


def code_point_spans(raw: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans with byte offsets turned to code points."""
    if raw.isascii() or not spans:
        return spans
    points, done, count = {}, 0, 0
    for at in sorted({x for s, _, e in spans for x in (s, e)}):
        count += len(raw[done:at].decode("utf-8"))
        points[at], done = count, at
    return [(points[s], k, points[e]) for s, k, e in spans]


def span_text(spans: list[tuple[int, int, int]], kinds: Sequence[str]) -> str:
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, rules: Sequence[SecretRule] = RULES, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>> (code points) of every row."""
    rules = tuple(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules)
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for b in batches:
            rows = []
            for raw in b.column(1).cast(pa.binary()).to_pylist():
                rows.append([{"kind": rules[k].kind, "start": s, "end": e}
                             for s, k, e in code_point_spans(raw, scan.spans(raw))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(kind))], names=["doc_id", "spans"])

    return map_arrow(
        id_and_text(docs, id_col, text_col), run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")
