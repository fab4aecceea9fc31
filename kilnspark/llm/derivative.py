"""Memoised parsing with derivatives over token streams.

A grammar is a language; the derivative of a language by a token is what may
follow that token.  Languages are kept as sets of hash-consed chains of grammar
nodes (a chain is a concatenation, the set their union), so equal languages are
one object, and each state remembers its derivative by every token it has met:
over a corpus the walk is one dictionary access per token.  The empty language
marks the token at which a text fails; a language at the end that lacks the
empty word marks a text that breaks off.
"""

from __future__ import annotations

import re

LIMIT = 200_000  # states kept by a parser; its memo starts anew beyond it

_EBNF = re.compile(r'\s*(?:([a-z_]\w*)\s*:(?!:)|([a-z_]\w*)|([A-Z][A-Z0-9]*)|"([^"]+)"|([()|*+?,]))')


class Node:
    """A grammar node: tok, not, seq, alt, star or rule."""

    __slots__ = ("kind", "arg")

    def __init__(self, kind: str, arg):
        self.kind, self.arg = kind, arg


def parse_grammar(text: str) -> dict[str, Node]:
    """Rules of an EBNF text.  Names in capitals are token classes, ``list(x)`` is x (',' x)*, later rules of a name replace earlier ones."""
    toks = []
    for m in _EBNF.finditer(re.sub(r"#[^\n\"]*\n", "\n", text)):
        k = m.lastindex
        toks.append(("define rule class literal punct".split()[k - 1], m[k]))
    toks.append(("define", ""))
    rules: dict[str, Node] = {}
    at = 0

    def alternatives() -> Node:
        nonlocal at
        alts = [sequence()]
        while toks[at] == ("punct", "|"):
            at += 1
            alts.append(sequence())
        return alts[0] if len(alts) == 1 else Node("alt", alts)

    def sequence() -> Node:
        nonlocal at
        items = []
        while toks[at][0] != "define" and toks[at] not in (("punct", "|"), ("punct", ")"), ("punct", ",")):
            items.append(item())
        return items[0] if len(items) == 1 else Node("seq", items)

    def item() -> Node:
        nonlocal at
        kind, v = toks[at]
        at += 1
        if kind == "punct":
            node = alternatives()
            at += 1
        elif kind in ("class", "literal"):
            node = Node("tok", v)
        elif v in ("list", "other") and toks[at] == ("punct", "("):
            at += 1
            inner = alternatives()
            at += 1
            node = Node("seq", [inner, Node("star", Node("seq", [Node("tok", ","), inner]))]) if v == "list" else Node("not", frozenset(x.arg for x in (inner.arg if inner.kind == "alt" else [inner])))
        else:
            node = Node("rule", v)
        while toks[at][0] == "punct" and toks[at][1] in "*+?":
            op = toks[at][1]
            at += 1
            node = Node("star", node) if op == "*" else Node("seq", [node, Node("star", node)]) if op == "+" else Node("alt", [node, Node("seq", [])])
        return node

    while at < len(toks) - 1:
        name = toks[at][1]
        at += 1
        rules[name] = alternatives()
    return rules


class _Chain:
    """A concatenation: its first node, and the chain after it."""

    __slots__ = ("node", "rest", "next", "ends")

    def __init__(self, node: Node | None, rest: _Chain | None):
        self.node, self.rest = node, rest
        self.next: dict[str, frozenset[_Chain]] = {}
        self.ends: bool | None = None


class State(dict):
    """A language, and by token what it is after that token."""

    __slots__ = ("chains", "parser", "_ends")
    __hash__ = object.__hash__
    __eq__ = object.__eq__

    def __init__(self, chains: frozenset[_Chain], parser: Parser):
        self.chains, self.parser, self._ends = chains, parser, None

    def __missing__(self, token: str) -> State:
        to = self[token] = self.parser.derive(self, token)
        return to

    def nullable(self) -> bool:
        if self._ends is None:
            self._ends = any(self.parser.ends(c) for c in self.chains)
        return self._ends


class Parser:
    """Derivatives of the language of one rule of a grammar."""

    def __init__(self, rules: dict[str, Node], start: str):
        self.rules, self.start_rule = rules, start
        self.reset()

    def reset(self) -> None:
        self.chains: dict[tuple[int, int], _Chain] = {}
        self.states: dict[frozenset[_Chain], State] = {}
        self.done = _Chain(None, None)
        self.dead = self.state(frozenset())
        self.start = self.state(frozenset([self.chain(Node("rule", self.start_rule), self.done)]))
        self.empty: dict[int, bool] = {}

    def fresh(self) -> State:
        """The whole language; call it once per text, for here the memo may start anew."""
        if len(self.states) > LIMIT:
            self.reset()
        return self.start

    def chain(self, node: Node, rest: _Chain) -> _Chain:
        key = (id(node), id(rest))
        c = self.chains.get(key)
        if c is None:
            c = self.chains[key] = _Chain(node, rest)
        return c

    def state(self, chains: frozenset[_Chain]) -> State:
        s = self.states.get(chains)
        if s is None:
            s = self.states[chains] = State(chains, self)
        return s

    def union(self, states: list[State]) -> State:
        return self.state(frozenset().union(*(s.chains for s in states)))

    def node_nullable(self, node: Node, open_: frozenset[str] = frozenset()) -> bool:
        if node.kind in ("tok", "not"):
            return False
        if node.kind == "star":
            return True
        if node.kind == "rule":
            return node.arg not in open_ and self.node_nullable(self.rules[node.arg], open_ | {node.arg})
        if node.kind == "seq":
            return all(self.node_nullable(x, open_) for x in node.arg)
        return any(self.node_nullable(x, open_) for x in node.arg)

    def ends(self, c: _Chain) -> bool:
        while c.ends is None:
            if c.node is None:
                c.ends = True
            elif not self.node_nullable(c.node):
                c.ends = False
            else:
                c.ends = self.ends(c.rest)
        return c.ends

    def derive(self, state: State, token: str) -> State:
        out: set[_Chain] = set()
        for c in state.chains:
            out |= self._derive(c, token)
        return self.state(frozenset(out))

    def _derive(self, c: _Chain, token: str) -> frozenset[_Chain]:
        known = c.next.get(token)
        if known is not None:
            return known
        node, rest = c.node, c.rest
        out: frozenset[_Chain] = frozenset()
        if node is not None:
            kind, arg = node.kind, node.arg
            if kind == "tok":
                out = frozenset([rest]) if arg == token else out
            elif kind == "not":
                out = out if token in arg else frozenset([rest])
            elif kind == "rule":
                out = self._derive(self.chain(self.rules[arg], rest), token)
            elif kind == "alt":
                out = frozenset().union(*(self._derive(self.chain(x, rest), token) for x in arg))
            elif kind == "star":
                out = self._derive(self.chain(arg, c), token) | self._derive(rest, token)
            else:
                to = rest
                for x in reversed(arg):
                    to = self.chain(x, to)
                out = self._derive(to, token)
        c.next[token] = out
        return out
