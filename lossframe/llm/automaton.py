"""Regular expressions to one minimal deterministic automaton over bytes.

A pattern is read by the standard library's regex parser, turned into a
nondeterministic automaton, determinised by subset construction over byte
classes and minimised by partition refinement. Several patterns share one
automaton; a state carries the set of patterns that accept there.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from collections import defaultdict
from collections.abc import Sequence

MAX = int(rc.MAXREPEAT)


class _Nfa:
    def __init__(self):
        self.eps: list[list[int]] = []
        self.arcs: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.eps.append([])
        self.arcs.append([])
        return len(self.eps) - 1

    def arc(self, a: int, chars: frozenset, b: int) -> None:
        self.arcs[a].append((chars, b))


def _both_cases(chars) -> frozenset:
    out = set(chars)
    for c in list(out):
        if 65 <= c <= 90:
            out.add(c + 32)
        elif 97 <= c <= 122:
            out.add(c - 32)
    return frozenset(out)


def _char_set(items) -> frozenset:
    out, negate = set(), False
    for op, arg in items:
        if op is rc.LITERAL:
            out.add(arg)
        elif op is rc.RANGE:
            out.update(range(arg[0], arg[1] + 1))
        elif op is rc.NEGATE:
            negate = True
        else:
            raise ValueError(f"unsupported in a character set: {op}")
    if any(c > 127 for c in out):
        raise ValueError("only ASCII patterns are supported")
    return frozenset(range(256)) - out if negate else frozenset(out)


def _build(nfa: _Nfa, items, start: int, fold: bool, backwards: bool) -> int:
    """Add the items after ``start``; returns the end state. ``backwards`` reads the text right to left."""
    at = start
    for op, arg in (reversed(list(items)) if backwards else items):
        if op in (rc.LITERAL, rc.IN, rc.NOT_LITERAL):
            chars = (frozenset([arg]) if op is rc.LITERAL else _char_set(arg) if op is rc.IN
                     else frozenset(range(256)) - {arg})
            nxt = nfa.state()
            nfa.arc(at, _both_cases(chars) if fold else chars, nxt)
            at = nxt
        elif op is rc.SUBPATTERN:
            at = _build(nfa, arg[3], at, fold, backwards)
        elif op is rc.BRANCH:
            end = nfa.state()
            for option in arg[1]:
                first = nfa.state()
                nfa.eps[at].append(first)
                nfa.eps[_build(nfa, option, first, fold, backwards)].append(end)
            at = end
        elif op is rc.MAX_REPEAT:
            low, high, body = arg
            for _ in range(low):
                at = _build(nfa, body, at, fold, backwards)
            if high == rc.MAXREPEAT:
                loop, end = nfa.state(), nfa.state()
                nfa.eps[at] += [loop, end]
                nfa.eps[_build(nfa, body, loop, fold, backwards)] += [loop, end]
                at = end
            else:
                end = nfa.state()
                nfa.eps[at].append(end)
                for _ in range(int(high) - low):
                    at = _build(nfa, body, at, fold, backwards)
                    nfa.eps[at].append(end)
                at = end
        else:
            raise ValueError(f"unsupported regex element: {op}")
    return at


def _byte_classes(nfa: _Nfa) -> tuple[bytes, list[int]]:
    """(class of each byte, one byte of each class): bytes that no arc tells apart share a class."""
    sets = list({chars for arcs in nfa.arcs for chars, _ in arcs})
    seen: dict[tuple, int] = {}
    classes, sample = bytearray(256), []
    for b in range(256):
        key = tuple(b in s for s in sets)
        if key not in seen:
            seen[key] = len(sample)
            sample.append(b)
        classes[b] = seen[key]
    return bytes(classes), sample


class Automaton:
    """``classes`` maps a byte to its class; ``rows[state][class]`` is the next state;
    ``accepts[state]`` holds the indexes of the patterns that accept; state 0 starts."""

    def __init__(self, patterns: Sequence[tuple[str, bool]], anywhere: bool = False, backwards: bool = False):
        """patterns: (regex, fold ASCII case). anywhere: a match may begin at any position."""
        nfa = _Nfa()
        start = nfa.state()
        if anywhere:
            nfa.arc(start, frozenset(range(256)), start)
        ends: dict[int, int] = {}
        for k, (pattern, fold) in enumerate(patterns):
            first = nfa.state()
            nfa.eps[start].append(first)
            ends[_build(nfa, rp.parse(pattern), first, fold, backwards)] = k
        self.classes, sample = _byte_classes(nfa)
        self._determinise(nfa, start, ends, sample)
        self._minimise()

    def _determinise(self, nfa: _Nfa, start: int, ends: dict[int, int], sample: list[int]) -> None:
        closures: dict[int, frozenset] = {}

        def closure(s: int) -> frozenset:
            if s not in closures:
                seen, todo = {s}, [s]
                while todo:
                    for t in nfa.eps[todo.pop()]:
                        if t not in seen:
                            seen.add(t)
                            todo.append(t)
                closures[s] = frozenset(seen)
            return closures[s]

        moves = [[[t for chars, t in arcs if b in chars] for b in sample] for arcs in nfa.arcs]
        first = closure(start)
        index, todo, rows = {first: 0}, [first], []
        for subset in todo:
            row = []
            for k in range(len(sample)):
                target = frozenset().union(*(closure(t) for s in subset for t in moves[s][k]))
                if target not in index:
                    index[target] = len(todo)
                    todo.append(target)
                row.append(index[target])
            rows.append(row)
        self.rows = rows
        self.accepts = [tuple(sorted({ends[s] for s in subset if s in ends})) for subset in todo]

    def _minimise(self) -> None:
        """Split blocks by what they accept, then by the blocks their moves reach, until nothing splits."""
        block = self._numbered(self.accepts)
        while True:
            finer = self._numbered([(block[s], *(block[t] for t in row)) for s, row in enumerate(self.rows)])
            if max(finer) == max(block):
                break
            block = finer
        order: dict[int, int] = {}
        members = defaultdict(int)
        for s, b in enumerate(block):
            if b not in order:
                order[b] = len(order)
                members[order[b]] = s
        self.rows = [[order[block[t]] for t in self.rows[members[k]]] for k in range(len(order))]
        self.accepts = [self.accepts[members[k]] for k in range(len(order))]

    @staticmethod
    def _numbered(keys) -> list[int]:
        seen: dict = {}
        return [seen.setdefault(k, len(seen)) for k in keys]

    def linked(self) -> list:
        """The states as linked lists for fast stepping: state[class] is the next state, state[-1] its accepts."""
        states: list[list] = [[] for _ in self.rows]
        for s, row in enumerate(self.rows):
            states[s] += [states[t] for t in row] + [self.accepts[s]]
        return states

    def longest(self, coded: bytes, start: int) -> int:
        """End of the longest match that begins at ``start``, or -1. ``coded``: bytes mapped to classes."""
        if not hasattr(self, "_dead"):
            self._dead = {s for s, row in enumerate(self.rows) if set(row) == {s} and not self.accepts[s]}
        state, best = 0, start if self.accepts[0] else -1
        for i in range(start, len(coded)):
            state = self.rows[state][coded[i]]
            if self.accepts[state]:
                best = i + 1
            elif state in self._dead:
                break
        return best
