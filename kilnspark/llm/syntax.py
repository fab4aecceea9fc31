"""Source files that do not parse in the language their extension names.

Each text becomes a stream of token classes, and the language of the grammar
(:mod:`kilnspark.llm.grammars`) is derived by one token after the other
(:mod:`kilnspark.llm.derivative`).  The derivative that is empty marks the failing
token; one that does not hold the empty word at the end marks a truncated file.

Conditional compilation is followed for every setting of the file's macros at
once: configurations that are in the same state walk as one, and the settings
that lead there, of macros that are still tested further on, are a decision
diagram, exact for any number of macros.  A macro that the file does not define
may stand for a name or for nothing.

Defined results: null and blank texts and other extensions get the status
'none' and are no cases; redelivered rows count once; a null repo is a group of
its own.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache, partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnspark.llm import grammars as G
from kilnspark.llm.derivative import Parser, State, parse_grammar

LANGUAGES = {".v": "verilog", ".vh": "verilog", ".sv": "systemverilog", ".svh": "systemverilog", ".py": "python", ".json": "json"}
TOKENS_KEPT = 300_000  # distinct tokens whose class is remembered


class _Classes(dict):
    """Token -> class, remembered."""

    def __init__(self, classify):
        self.classify = classify

    def __missing__(self, token: str) -> str:
        if len(self) > TOKENS_KEPT:
            self.clear()
        c = self[token] = self.classify(token)
        return c


# ------------------------------------------------------------------ hardware languages

_SKIP = r"(?:\s++|//[^\n]*+|/\*[\s\S]*?\*/)*+"
_BASED = (
    r"(?:\d[\d_]*\s*)?'[sS]?(?:[bB]\s*[01xXzZ?][01xXzZ?_]*|[oO]\s*[0-7xXzZ?][0-7xXzZ?_]*"
    r"|[hH]\s*[\da-fA-FxXzZ?][\da-fA-FxXzZ?_]*|[dD]\s*(?:\d[\d_]*|[xXzZ?]_*))"
)
_PLAIN = r"\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d[\d_]*)?"
_OPS = "<<< >>> === !== ** << >> <= >= == != && || ~& ~| ~^ ^~ -> +: -: => *>".split()
_SV_OPS = "<<<= >>>= <<= >>= ==? !=? += -= *= /= %= &= |= ^= ++ -- :: ->> <-> ## .* &&&".split()


@cache
def _lexer(system: bool) -> re.Pattern[str]:
    ops = sorted(_OPS + _SV_OPS * system, key=len, reverse=True)
    number = _BASED + (r"|'[01xXzZ](?!\w)|1step\b|" + _PLAIN + r"(?:[munpf]?s\b)?" if system else "|" + _PLAIN)
    body = "|".join(
        [r"[A-Za-z_][\w$]*", r"\(\s*\*\s*\)", r"\(\*(?!\))", r"\*\)", number, r'"(?:[^"\\\n]|\\[\s\S])*"', r"\\\S+", r"\$[\w$]+", r"`\w+", *map(re.escape, ops), r"\S"]
    )
    # the empty token at the end takes up a trailing comment, which else would be searched for tokens from within
    return re.compile(f"{_SKIP}({body}|\\Z)")


def _tokens(lexer: re.Pattern[str], text: str) -> list[str]:
    out = lexer.findall(text)
    while out and not out[-1]:
        out.pop()
    return out


def _hardware_class(system: bool):
    words = G.VERILOG_WORDS | G.SYSTEM_WORDS if system else G.VERILOG_WORDS
    classes = G.SYSTEM_CLASSES if system else G.VERILOG_CLASSES

    def classify(t: str) -> str:
        c = t[0]
        if c.isalpha() or c == "_":
            return classes.get(t, t) if t in words else "ID" if t.isascii() else "?"
        if c == "\\":
            return "ID" if len(t) > 1 else "?"
        if c.isdigit() or (c == "'" and len(t) > 1):
            return "NUM" if c.isascii() else "?"
        if c == '"':
            return "STR" if len(t) > 1 else "?"
        if c == "$" and len(t) > 1:
            return "SYS"
        return classes.get(t, t)

    return classify


_COMMENT = re.compile(r'("(?:[^"\\\n]|\\[\s\S])*")|//[^\n]*|/\*[\s\S]*?\*/')
_DIRECTIVE = re.compile(r"`(\w+)")
NESTED = 100  # expansions within expansions; a macro that holds itself is no macro
_TIMESCALE = re.compile(r"\s*\d+\s*[munpf]?s\s*/\s*\d+\s*[munpf]?s\s*$")
# Directives that take the rest of their line and leave no tokens.
_LINE = frozenset(
    "include default_nettype celldefine endcelldefine resetall line pragma unconnected_drive nounconnected_drive begin_keywords end_keywords default_decay_time default_trireg_strength protect endprotect undefineall".split()
)

_DIRECTIVES = _LINE | frozenset("ifdef ifndef elsif else endif define undef timescale".split())


def _rest_of_line(text: str, at: int) -> int:
    while True:
        end = text.find("\n", at)
        if end < 0:
            return len(text)
        if text[:end].rstrip("\r")[-1:] != "\\":
            return end
        at = end + 1


def _segments(text: str) -> list[tuple[str, str]] | None:
    """Text between directives, and the directives; uses of macros stay in the text.  None if a directive is malformed."""
    text = _COMMENT.sub(lambda m: m[1] or " ", text)
    out, at = [], 0
    for m in _DIRECTIVE.finditer(text):
        name = m[1]
        if m.start() < at or name not in _DIRECTIVES:
            continue
        if text[m.start() - 1 : m.start()] == "`" or text.count('"', text.rfind("\n", 0, m.start()) + 1, m.start()) % 2:
            continue  # not a directive: a run of backticks, or inside a string
        out.append(("text", text[at : m.start()]))
        at = m.end()
        if name in ("ifdef", "ifndef", "elsif", "undef"):
            n = re.compile(r"[ \t]*(\w+)").match(text, at)
            if n is None:
                return None
            out.append((name, n[1]))
            at = n.end()
        elif name in ("else", "endif"):
            out.append((name, ""))
        elif name == "define":
            end = _rest_of_line(text, at)
            n = re.compile(r"[ \t]*([A-Za-z_]\w*)").match(text, at)
            if n is None:
                return None
            out.append(("define", text[n.start(1) : end]))
            at = end
        elif name == "timescale":
            end = _rest_of_line(text, at)
            if not _TIMESCALE.match(text[at:end]):
                return None
            at = end
        else:
            at = _rest_of_line(text, at)
    out.append(("text", text[at:]))
    return out


def _closing(tokens: list[str], at: int) -> int:
    """Behind the bracket that closes the one at ``at``; -1 if none does."""
    depth = 0
    for k in range(at, len(tokens)):
        depth += (tokens[k] in ("(", "[", "{")) - (tokens[k] in (")", "]", "}"))
        if depth == 0:
            return k + 1
    return -1


def _by_comma(tokens: list[str]) -> list[list[str]]:
    """Tokens between commas outside brackets."""
    out, depth = [[]], 0
    for t in tokens:
        depth += (t in ("(", "[", "{")) - (t in (")", "]", "}"))
        if t == "," and depth == 0:
            out.append([])
        else:
            out[-1].append(t)
    return out


class _Macro:
    """A definition: names and defaults of its arguments (None without brackets) and the tokens of its body."""

    __slots__ = ("args", "body")

    def __init__(self, rest: str, lex):
        self.args: list[tuple[str, list[str]]] | None = None
        tokens = lex(rest.replace("\\\r\n", " ").replace("\\\n", " ").replace("``", "").replace('`\\`"', '"').replace('`"', '"'))
        if rest[:1] == "(":
            end = _closing(tokens, 0)
            if end > 0:
                self.args = [(a[0], a[2:]) for a in _by_comma(tokens[1 : end - 1]) if a]
                tokens = tokens[end:]
        self.body = tokens

    def expanded(self, given: list[str] | None) -> list[str] | None:
        """The body with the given tokens (brackets included) as arguments; None if they don't fit."""
        if self.args is None:
            return self.body + (given or [])
        if given is None:
            return None
        values = _by_comma(given[1:-1])
        if len(values) > max(1, len(self.args)):
            return None
        put = {name: (values[k] if k < len(values) and (values[k] or not default) else default) for k, (name, default) in enumerate(self.args)}
        return [x for t in self.body for x in put.get(t, (t,))]


def _walk(state: State, tokens: list[str], classes: _Classes) -> State:
    for c in map(classes.__getitem__, tokens):
        state = state[c]
    return state


class _Settings:
    """Sets of macro settings as reduced ordered decision diagrams: 0 is no setting, 1 is every one, another number a node (macro, unset, set)."""

    def __init__(self) -> None:
        self.nodes: list[tuple[float, int, int]] = [(float("inf"), 0, 0), (float("inf"), 1, 1)]
        self.ids: dict[tuple[float, int, int], int] = {}
        self.memo: dict[tuple, int] = {}

    def node(self, macro: float, unset: int, is_set: int) -> int:
        if unset == is_set:
            return unset
        key = (macro, unset, is_set)
        if key not in self.ids:
            self.ids[key] = len(self.nodes)
            self.nodes.append(key)
        return self.ids[key]

    def either(self, f: int, g: int) -> int:
        """Settings of f or of g."""
        if f > g:
            f, g = g, f
        if f == g or f == 0:
            return g
        if f == 1:
            return 1
        key = (f, g)
        if key not in self.memo:
            (a, f0, f1), (b, g0, g1) = self.nodes[f], self.nodes[g]
            m = min(a, b)
            self.memo[key] = self.node(m, self.either(f0 if a == m else f, g0 if b == m else g), self.either(f1 if a == m else f, g1 if b == m else g))
        return self.memo[key]

    def only(self, f: int, macro: int, value: bool) -> int:
        """Settings of f in which the macro has the value."""
        m, unset, is_set = self.nodes[f]
        if m >= macro:
            if m > macro:
                unset = is_set = f
            return self.node(macro, 0, is_set) if value else self.node(macro, unset, 0)
        key = (f, macro, value)
        if key not in self.memo:
            self.memo[key] = self.node(m, self.only(unset, macro, value), self.only(is_set, macro, value))
        return self.memo[key]

    def without(self, f: int, macro: int) -> int:
        """Settings of f, whatever the macro is."""
        m, unset, is_set = self.nodes[f]
        if m >= macro:
            return f if m > macro else self.either(unset, is_set)
        key = (f, macro, None)
        if key not in self.memo:
            self.memo[key] = self.node(m, self.without(unset, macro), self.without(is_set, macro))
        return self.memo[key]


class _Hardware:
    def __init__(self, system: bool):
        self.parser = Parser(parse_grammar(G.SYSTEM_VERILOG if system else G.VERILOG), "file")
        self.classes = _Classes(_hardware_class(system))
        self.lex = partial(_tokens, _lexer(system))

    def check(self, text: str) -> tuple[str, int, str]:
        if "`" in text:
            return self.configured(text)
        tokens = self.lex(text)
        start = self.parser.fresh()
        end = _walk(start, tokens, self.classes)
        if end.nullable():
            return "ok", -1, ""
        return _where(start, tokens, self.classes, self.parser)

    def configured(self, text: str) -> tuple[str, int, str]:
        segments = _segments(text)
        if segments is None:
            return "failed", -1, "`"
        left: dict[str, int] = {}  # tests of each macro that are still to come
        for kind, v in segments:
            if kind in ("ifdef", "ifndef", "elsif"):
                left[v] = left.get(v, 0) + 1
        macros = {v: k for k, v in enumerate(left)}
        walk = _Expansion(self, segments, len(macros))
        settings = walk.settings
        # (open conditionals (active, taken, outer active, else seen), state) -> the settings that lead there
        configs: dict[tuple[tuple, State], int] = {((), self.parser.fresh()): walk.start}
        count = 0
        for at, (kind, v) in enumerate(segments):
            out: dict[tuple[tuple, State], int] = {}

            def add(st: tuple, s: State, f: int, out=out) -> None:
                if f:
                    out[st, s] = settings.either(out.get((st, s), 0), f)

            if kind == "text":
                tokens = self.lex(v)
                if tokens:
                    by_place: dict[tuple, dict[State, int]] = {}
                    for (st, s), f in configs.items():
                        if not st or st[-1][0]:
                            by_place.setdefault(st, {})[s] = f
                        else:
                            add(st, s, f)
                    try:
                        for st, states in by_place.items():
                            for s, f in walk.run(states, tokens).items():
                                add(st, s, f)
                    except _Dead as e:
                        return "failed", count + e.args[0], e.args[1]
                    count += len(tokens)
                    configs = out
                continue
            if kind in ("define", "undef"):
                name = re.match(r"\w+", v)[0]
                for (st, s), f in configs.items():
                    if not st or st[-1][0]:
                        f = walk.defined(f, name, at if kind == "define" else None)
                        if left.get(name):
                            f = settings.only(settings.without(f, macros[name]), macros[name], kind == "define")
                    add(st, s, f)
                configs = out
                continue
            if kind in ("ifdef", "ifndef", "elsif"):
                left[v] -= 1
            for (st, s), f in configs.items():
                if kind in ("ifdef", "ifndef"):
                    outer = not st or st[-1][0]
                    if not outer:
                        add((*st, (False, False, False, False)), s, f)
                        continue
                    for val in (True, False):
                        on = val == (kind == "ifdef")
                        add((*st, (on, on, True, False)), s, settings.only(f, macros[v], val))
                    continue
                if not st or (kind in ("else", "elsif") and st[-1][3]):
                    return "failed", count, "`" + kind
                _, taken, outer, _ = st[-1]
                if kind == "endif":
                    add(st[:-1], s, f)
                elif kind == "else":
                    add((*st[:-1], (outer and not taken, True, outer, True)), s, f)
                elif outer and not taken:
                    for val in (True, False):
                        add((*st[:-1], (val, val, True, False)), s, settings.only(f, macros[v], val))
                else:
                    add((*st[:-1], (False, taken, outer, False)), s, f)
            if kind in ("ifdef", "ifndef", "elsif") and not left[v]:
                out = {k: settings.without(f, macros[v]) for k, f in out.items()}
            configs = out
        for st, s in configs:
            if st or not s.nullable():
                return "truncated", count, ""
        return "ok", -1, ""


class _Dead(Exception):
    """No derivative is left: the number of tokens before, and the token."""


class _Expansion:
    """Walks tokens with their macros expanded, each under the settings that lead to its definition.

    Each definition of a macro has a variable in the settings that tells whether
    it is the one in force, so that bodies belong to configurations.
    """

    def __init__(self, hardware: _Hardware, segments: list[tuple[str, str]], first: int):
        self.parser, self.classes, self.settings = hardware.parser, hardware.classes, _Settings()
        self.bodies: dict[str, list[tuple[int, int, _Macro]]] = {}  # name -> (place, variable, definition)
        used = {x for kind, v in segments if kind in ("text", "define") for x in _DIRECTIVE.findall(v)}
        var = first
        for at, (kind, v) in enumerate(segments):
            name = re.match(r"\w*", v)[0] if kind == "define" else ""
            if name in used:
                self.bodies.setdefault(name, []).append((at, var, _Macro(v[len(name) :], hardware.lex)))
                var += 1
        self.start = 1  # nothing is defined
        for k in range(var - 1, first - 1, -1):
            self.start = self.settings.node(k, self.start, 0)

    def defined(self, f: int, name: str, at: int | None) -> int:
        """Settings after the definition at a place, or after none is in force any more."""
        for place, var, _ in self.bodies.get(name, ()):
            f = self.settings.only(self.settings.without(f, var), var, place == at)
        return f

    def run(self, states: dict[State, int], tokens: list[str], depth: int = 0) -> dict[State, int]:
        at, uses = 0, [k for k, t in enumerate(tokens) if t[0] == "`" and len(t) > 1]
        for k in [*uses, len(tokens)]:
            if k < at:
                continue  # an argument of the use before
            plain = tokens[at:k]
            out: dict[State, int] = {}
            for s, f in states.items():
                to = _walk(s, plain, self.classes)
                if to is self.parser.dead:
                    _, n, token = _where(s, plain, self.classes, self.parser)
                    raise _Dead(at + n, token)
                self._add(out, to, f)
            states = out
            if k == len(tokens):
                break
            at = k + 1
            known = self.bodies.get(tokens[k][1:], ())
            given = None
            if any(m.args is not None for _, _, m in known) and tokens[at : at + 1] == ["("]:
                end = _closing(tokens, at)
                if end < 0:
                    raise _Dead(k, tokens[k])
                given, at = tokens[at:end], end
            out = {}
            for s, f in states.items():
                for _, var, macro in known:
                    on = self.settings.only(f, var, True)
                    f = self.settings.only(f, var, False)
                    if on:
                        body = macro.expanded(given) if depth < NESTED else None
                        if body is None:
                            raise _Dead(k, tokens[k])
                        self._expand(out, s, on, body, depth, k)
                if f:  # not defined here: a name or nothing
                    self._expand(out, self.parser.union([s, s["ID"]]), f, given or [], depth, k)
            states = out
        return states

    def _expand(self, out: dict[State, int], s: State, f: int, tokens: list[str], depth: int, place: int) -> None:
        try:
            for to, g in self.run({s: f}, tokens, depth + 1).items():
                self._add(out, to, g)
        except _Dead as e:
            raise _Dead(place, e.args[1]) from None

    def _add(self, out: dict[State, int], s: State, f: int) -> None:
        out[s] = self.settings.either(out.get(s, 0), f)


def _where(state: State, tokens: list[str], classes: _Classes, parser: Parser) -> tuple[str, int, str]:
    """The failing token of a refused stream, or its truncation."""
    for n, t in enumerate(tokens):
        state = state[classes[t]]
        if state is parser.dead:
            return "failed", n, t[:80]
    return "truncated", len(tokens), ""


# ------------------------------------------------------------------ JSON

_JSON_LEX = re.compile(r'[ \t\n\r]*("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|[^ \t\n\r])')


def _json_class(t: str) -> str:
    if t[0] == '"':
        return "STR" if len(t) > 1 else "?"
    if t[0] in "-0123456789":
        return "NUM" if t != "-" else "?"
    return t


class _Json:
    def __init__(self) -> None:
        self.parser = Parser(parse_grammar(G.JSON), "file")
        self.classes = _Classes(_json_class)

    def check(self, text: str) -> tuple[str, int, str]:
        tokens = _JSON_LEX.findall(text)
        start = self.parser.fresh()
        if _walk(start, tokens, self.classes).nullable():
            return "ok", -1, ""
        return _where(start, tokens, self.classes, self.parser)


# ------------------------------------------------------------------ Python

_PY_NUMBER = (
    r"(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)"
    r"(?=(?:and|else|for|if|in|is|not|or)\b|\W|\Z)"
)
_PY_STRING = (
    r"(?:[rR][bB]?|[bB][rR]?|[uU])?(?:"
    r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""|' + r"'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|" + r'"(?:[^"\\\n]|\\[\s\S])*"|' + r"'(?:[^'\\\n]|\\[\s\S])*')"
)
_PY_LEX = re.compile(
    r"[ \t\f]*(?:(#[^\n]*)|(\\\n)|((?:[fF][rR]?|[rR][fF])(?:" + '"""|' + "'''" + r"""|"|'))|("""
    + _PY_STRING
    + r"|[^\W\d]\w*|"
    + _PY_NUMBER
    + r"|\*\*=|//=|>>=|<<=|\.\.\.|[-+*/%&|^@=!<>:]=|->|\*\*|//|<<|>>|\n|.))"
)
_INDENT = re.compile(r"[ \t\f]*")
_STR_HEAD = re.compile(r"([A-Za-z]*)(\"\"\"|'''|\"|')")
_ESCAPE = re.compile(r"\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U(?:0010|000[0-9a-fA-F])[0-9a-fA-F]{4}|N\{([^{}]+)\}|([xuUN])|[\s\S])")


def _escapes_hold(body: str, in_bytes: bool) -> bool:
    """Whether the escapes of a string that is not raw are well formed."""
    for m in _ESCAPE.finditer(body):
        if m[2] and not (in_bytes and m[2] != "x"):
            return False
        if m[1] and not in_bytes:
            try:
                unicodedata.lookup(m[1])
            except KeyError:
                return False
    return True


def _python_class(t: str) -> str:
    c = t[0]
    if len(t) > 1 and t[-1] in "\"'" and (c in "\"'" or _STR_HEAD.match(t)):
        h = _STR_HEAD.match(t)
        prefix = h[1].lower()
        if "b" in prefix and not t.isascii():
            return "?"
        if "r" not in prefix and "\\" in t and not _escapes_hold(t[h.end() : -len(h[2])], "b" in prefix):
            return "?"
        return "BYTES" if "b" in prefix else "STR"
    if c.isalpha() or c == "_":
        if t in G.PYTHON_SOFT_WORDS:
            return t
        return G.PYTHON_CLASSES.get(t, t) if t in G.PYTHON_WORDS else "NAME" if unicodedata.normalize("NFKC", t).isidentifier() else "?"
    if c.isdigit() or (c == "." and len(t) > 1 and t != "..."):
        return "NUM" if t.isascii() and not re.match(r"0[\d_]*[1-9][\d_]*$", t) else "?"
    return G.PYTHON_CLASSES.get(t, t)


class _Python:
    """Python 3.12 and later: strings with fields may hold their own quotes, line ends and comments inside the fields."""

    def __init__(self) -> None:
        rules = parse_grammar(G.PYTHON)
        self.parser, self.field = Parser(rules, "file"), Parser(rules, "field")
        self.classes = _Classes(_python_class)

    def tokens(self, text: str) -> Iterator[str]:
        """Classes of the tokens, with NEWLINE, INDENT and DEDENT; '?' for what is no token."""
        if text and text[-1] != "\n":
            text += "\n"
        at, depth, levels, classes = 0, 0, [(0, 0)], self.classes
        new_line = True
        match = _PY_LEX.match
        end = len(text)
        while at < end:
            if new_line and depth == 0:
                m = _INDENT.match(text, at)
                at = m.end()
                if at >= end:
                    break
                if text[at] in "\n#":
                    at = text.index("\n", at) + 1
                    continue
                blank = m[0].rpartition("\f")[2]
                col = (len(blank.expandtabs(8)), len(blank.replace("\t", " ")))
                if col[0] > levels[-1][0] and col[1] > levels[-1][1]:
                    levels.append(col)
                    yield "INDENT"
                elif col != levels[-1]:
                    while levels and col[0] < levels[-1][0]:
                        levels.pop()
                        yield "DEDENT"
                    if not levels or levels[-1] != col:
                        yield "?"
                        return
            new_line = False
            m = match(text, at)
            if m is None:  # only blanks are left
                break
            at = m.end()
            if m[3]:
                at = self.fielded(text, at, m[3])
                if at < 0:
                    yield "?"
                    return
                yield "STR"
                continue
            t = m[4]
            if t is None:
                if m[2] and at >= end:  # nothing follows the backslash
                    yield "?"
                    return
                continue
            if t == "\n":
                if depth == 0:
                    yield "NEWLINE"
                    new_line = True
                continue
            c = classes[t]
            if c in ("(", "[", "{"):
                depth += 1
            elif c in (")", "]", "}"):
                depth = max(0, depth - 1)
            yield c
        if depth:
            return  # a bracket is open, so the last line has not ended
        if not new_line:
            yield "NEWLINE"
        for _ in levels[1:]:
            yield "DEDENT"

    def fielded(self, text: str, at: int, opening: str) -> int:
        """Where a string with fields ends whose opening has been read; -1 if it is broken."""
        quote = opening.lstrip("fFrR")
        return self._literal(text, at, quote, "r" in opening.lower(), False)

    def _literal(self, text: str, at: int, quote: str, raw: bool, spec: bool) -> int:
        """The end of the literal part: behind the closing quote, or (``spec``) at the brace that ends the field."""
        while at < len(text):
            c = text[at]
            if text.startswith(quote, at):
                return -1 if spec else at + len(quote)
            if c == "\\":
                if raw or text[at + 1 : at + 2] in ("{", "}"):
                    at += 1 if text[at + 1 : at + 2] in ("{", "}") else 2
                    continue
                m = _ESCAPE.match(text, at)
                if m is None or not _escapes_hold(m[0], False):
                    return -1
                at = m.end()
            elif c == "\n" and (len(quote) == 1 or spec and len(quote) == 1):
                return -1
            elif c == "{":
                if not spec and text[at + 1 : at + 2] == "{":
                    at += 2
                    continue
                at = self._field(text, at + 1, quote, raw)
                if at < 0:
                    return -1
            elif c == "}":
                if spec:
                    return at
                if text[at + 1 : at + 2] != "}":
                    return -1
                at += 2
            else:
                at += 1
        return -1

    def _field(self, text: str, at: int, quote: str, raw: bool) -> int:
        """The end of a replacement field whose brace has been read."""
        state, depth = self.field.fresh(), 0
        while True:
            m = _PY_LEX.match(text, at)
            if m is None:
                return -1
            start, at = m.start(m.lastindex), m.end()
            if m[3]:
                at = self.fielded(text, at, m[3])
                if at < 0:
                    return -1
                state = state["STR"]
                continue
            t = m[4]
            if t is None or t == "\n":
                continue
            if depth == 0 and (t in ("}", "!", ":", ":=") or (t in ("=", "==") and re.match(r"=\s*[!:}]", text[start:]))):
                at = start
                break
            depth += (t in "([{") - (t in ")]}")
            if depth < 0:
                return -1
            state = state[self.classes[t]]
            if state is self.field.dead:
                return -1
        if not state.nullable():
            return -1
        m = re.compile(r"(?:=\s*)?(?:!\s*[rsa]\s*)?").match(text, at)
        at = m.end()
        if text[at : at + 1] == ":":
            at = self._literal(text, at + 1, quote, raw, True)
            if at < 0:
                return -1
        return at + 1 if text[at : at + 1] == "}" else -1

    def check(self, text: str) -> tuple[str, int, str]:
        state, n, c = self.parser.fresh(), -1, ""
        for n, c in enumerate(self.tokens(text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n"))):
            state = state[c]
            if state is self.parser.dead:
                return "failed", n, c
        if "\0" in text:
            return "failed", n, "\0"
        return ("ok", -1, "") if state.nullable() else ("truncated", n + 1, "")


# ------------------------------------------------------------------ operator


@cache
def checker(language: str):
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 50_000))
    if language == "json":
        return _Json()
    return _Python() if language == "python" else _Hardware(language == "systemverilog")


def check_text(path: str | None, text: str | None) -> tuple[str, str, int, str]:
    """(language, status, token_no, token) of a file."""
    dot = (path or "").rfind(".")
    language = LANGUAGES.get((path or "")[dot:].lower(), "other") if dot >= 0 else "other"
    if language == "other" or text is None or not text.strip("﻿ \t\r\n\v\f"):
        return language, "none", -1, ""
    return (language, *checker(language).check(text))


def check_files(files: DataFrame) -> DataFrame:
    """(module_id, repo, language, status, token_no, token) of every row; narrow, the texts are not shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [check_text(p, t) for p, t in zip(b["rtl_path"], b["verilog"], strict=True)]
            out = b[["module_id", "repo"]].copy()
            for k, c in enumerate(["language", "status", "token_no", "token"]):
                out[c] = [r[k] for r in rows]
            yield out

    return files.select("module_id", "repo", "rtl_path", "verilog").mapInPandas(run, "module_id long, repo string, language string, status string, token_no int, token string")


def invalid_files(files: DataFrame) -> DataFrame:
    return check_files(files).filter(F.col("status").isin("failed", "truncated")).select("module_id").distinct()


def invalid_rates(files: DataFrame) -> DataFrame:
    """Files, invalid ones and their rate by repository and language; files without text are not counted."""
    each = check_files(files).filter("status <> 'none'").select("module_id", "repo", "language", "status").dropDuplicates(["module_id"])
    bad = F.col("status") != "ok"
    return each.groupBy("repo", "language").agg(
        F.count("*").alias("n_files"),
        F.count_if(bad).alias("n_invalid"),
        F.count_if(F.col("status") == "truncated").alias("n_truncated"),
        F.round(F.count_if(bad) / F.count("*"), 6).alias("invalid_rate"),
    )
