"""Deterministic character automata over many strings at once.

Patterns (a plain subset of regular expressions: literals, classes, groups,
``|``, ``*``, ``+``, ``?`` and ``{n,m}``) become one table-driven machine.  It
steps all strings of a batch together with array operations, so no interpreted
code runs per character, and a string leaves the batch when its state is dead.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np

_CLASSES = {"d": frozenset(b"0123456789"), "w": frozenset(b for b in range(128) if chr(b).isalnum() or b == 95), "n": frozenset(b"\n"), "t": frozenset(b"\t"), "r": frozenset(b"\r")}
_ANY = frozenset(range(256)) - {10}


class _Nfa:
    """Patterns as a graph with empty steps."""

    def __init__(self) -> None:
        self.eps: list[list[int]] = []
        self.on: list[list[tuple[frozenset[int], int]]] = []

    def node(self) -> int:
        self.eps.append([])
        self.on.append([])
        return len(self.eps) - 1

    def add(self, tree, start: int) -> int:
        """Add a parsed pattern behind ``start``; its end."""
        kind = tree[0]
        if kind == "set":
            end = self.node()
            self.on[start].append((tree[1], end))
            return end
        if kind == "seq":
            for x in tree[1]:
                start = self.add(x, start)
            return start
        if kind == "alt":
            end = self.node()
            for x in tree[1]:
                self.eps[self.add(x, start)].append(end)
            return end
        _, lo, hi, body = tree
        for _ in range(lo):
            start = self.add(body, start)
        if hi is None:
            loop = self.node()
            self.eps[start].append(loop)
            self.eps[self.add(body, loop)].append(loop)
            return loop
        end = self.node()
        self.eps[start].append(end)
        for _ in range(hi - lo):
            start = self.add(body, start)
            self.eps[start].append(end)
        return end

    def closed(self, nodes: set[int]) -> frozenset[int]:
        todo = list(nodes)
        while todo:
            for e in self.eps[todo.pop()]:
                if e not in nodes:
                    nodes.add(e)
                    todo.append(e)
        return frozenset(nodes)


def parse_pattern(p: str):
    """A pattern as a tree of ('set', bytes), ('seq', trees), ('alt', trees) and ('repeat', least, most or None, tree)."""
    at = 0

    def escaped() -> frozenset[int]:
        nonlocal at
        at += 2
        return _CLASSES.get(p[at - 1], frozenset([ord(p[at - 1])]))

    def one_class() -> frozenset[int]:
        nonlocal at
        at += 1
        negate = p[at] == "^"
        at += negate
        out: set[int] = set()
        first = True
        while first or p[at] != "]":
            first = False
            if p[at] == "\\":
                out |= escaped()
            elif p[at + 1] == "-" and p[at + 2] != "]":
                out |= set(range(ord(p[at]), ord(p[at + 2]) + 1))
                at += 3
            else:
                out.add(ord(p[at]))
                at += 1
        at += 1
        return frozenset(range(256)) - out if negate else frozenset(out)

    def item():
        nonlocal at
        c = p[at]
        if c == "(":
            at += 1
            out = alternatives()
            at += 1
        elif c == "[":
            out = ("set", one_class())
        elif c == "\\":
            out = ("set", escaped())
        else:
            at += 1
            out = ("set", _ANY if c == "." else frozenset([ord(c)]))
        while at < len(p) and p[at] in "*+?{":
            if p[at] == "{":
                end = p.index("}", at)
                lo, _, hi = p[at + 1 : end].partition(",")
                out = ("repeat", int(lo), (int(hi) if hi else None) if "," in p[at:end] else int(lo), out)
                at = end
            else:
                out = ("repeat", int(p[at] == "+"), 1 if p[at] == "?" else None, out)
            at += 1
        return out

    def sequence():
        items = []
        while at < len(p) and p[at] not in "|)":
            items.append(item())
        return ("seq", items)

    def alternatives():
        nonlocal at
        alts = [sequence()]
        while at < len(p) and p[at] == "|":
            at += 1
            alts.append(sequence())
        return ("alt", alts)

    return alternatives()


class Automaton:
    """One machine for several patterns: state 0 is dead, state 1 the start; ``accepts`` names the first pattern that ends in a state, or -1."""

    def __init__(self, patterns: list[str]):
        nfa = _Nfa()
        start = nfa.node()
        ends = {}
        for k, p in enumerate(patterns):
            s = nfa.node()
            nfa.eps[start].append(s)
            ends[nfa.add(parse_pattern(p), s)] = k
        begin = nfa.closed({start})
        states = {frozenset(): 0, begin: 1}
        rows, todo = [np.zeros(256, dtype=np.int32)], [begin]
        for s in todo:  # grows as states are found
            row, by_byte = np.zeros(256, dtype=np.int32), {}
            for n in s:
                for chars, to in nfa.on[n]:
                    for c in chars:
                        by_byte.setdefault(c, set()).add(to)
            for c, to in by_byte.items():
                key = nfa.closed(to)
                if key not in states:
                    states[key] = len(states)
                    todo.append(key)
                row[c] = states[key]
            rows.append(row)
        self.table = np.array(rows, dtype=np.int32)
        self.accepts = np.array([min((ends[n] for n in s if n in ends), default=-1) for s in states], dtype=np.int32)

    def whole(self, text: str) -> int:
        """The first pattern that matches the whole of one short text, or -1."""
        state = 1
        for b in text.encode("utf-8", "replace"):
            state = self.rows[state][b]
        return int(self.accepts[state])

    @cached_property
    def rows(self) -> list[list[int]]:
        return self.table.tolist()

    def longest(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each [start, end) of ``data`` (bytes) the pattern with the longest match from its start, or -1, and where that ends."""
        found, upto = np.full(len(starts), -1, dtype=np.int32), starts.astype(np.int64)
        live = np.flatnonzero(starts < ends)
        pos, state = upto[live], np.ones(len(live), dtype=np.int32)
        while len(live):
            state = self.table[state, data[pos]]
            pos = pos + 1
            hit = self.accepts[state]
            got = np.flatnonzero(hit >= 0)
            found[live[got]] = hit[got]
            upto[live[got]] = pos[got]
            keep = np.flatnonzero((state != 0) & (pos < ends[live]))
            if len(keep) < len(live):
                live, pos, state = live[keep], pos[keep], state[keep]
        return found, upto
