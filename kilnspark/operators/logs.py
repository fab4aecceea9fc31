"""Semi-structured log text into entries of timestamp, level, component and message.

A deterministic character automaton (:mod:`kilnspark.functions.automaton`) cuts
the heads of all lines of a batch into tokens: times, levels, names, strings in
quotes, brackets and delimiters.  A second automaton runs over the kinds of the
tokens; it is built from the grammars of the head layouts, and it looks ahead
over a line's tokens until no layout is left.  A line in which it accepts starts
an entry; any other line is a continuation of the entry above it.  The grammar of
the layout assigns the tokens to fields, escapes are resolved.

Defined results: null and empty texts give no entry; lines above the first
start belong to none; a head without time has '' as entry_ts, without a level ''
as level_name, without a logger or file '' as component; a time of day without
date or year stays as written; a JSON line that does not parse or has neither
time nor level is a continuation.  Redelivered rows count once.  Lines end in LF
or CRLF only.  A simulation time that is still unset (``-.--``) is no time.  The
first line of a tail may be cut, so there a level or time of day alone is no head.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import UTC, datetime
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnspark.functions.automaton import Automaton

LEVELS = {
    "trace": "DEBUG", "debug": "DEBUG", "info": "INFO", "notice": "INFO", "note": "INFO", "warn": "WARNING", "warning": "WARNING",
    "err": "ERROR", "error": "ERROR", "crit": "CRITICAL", "critical": "CRITICAL", "fatal": "CRITICAL", "panic": "CRITICAL", "emerg": "CRITICAL",
}

# Kind of token (a letter) -> pattern; the longest match counts, then the first.
_CLOCK = r"\d\d:\d\d:\d\d([.,]\d+)?"
TOKENS = {
    "T": rf"\d{{4}}-\d\d-\d\d[ T]{_CLOCK}( ?Z| ?[+\-]\d\d:?\d\d)?",
    "M": rf"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) +\d\d? {_CLOCK}",
    "K": _CLOCK,
    "Y": r"(-\.--|\d+(\.\d+)?)(fs|ps|ns|us|ms|s)",
    "U": "|".join(k.upper() for k in LEVELS),
    "C": "|".join(k.capitalize() for k in LEVELS),
    "L": "|".join(LEVELS),
    "R": "%(Error|Warning|Info)(-[A-Z0-9_]+)?: ",  # a level with its rule
    "W": r"time|ts|level|lvl|component|logger|msg",  # keys that a record of pairs begins with
    "B": r"[A-Za-z_][\w.]*",
    "I": r"\d+",
    "A": r"[A-Za-z][\w.\-]*",
    "N": "[A-Za-z0-9_./\\-\x80-\xff]+",
    "D": " - ",
    "S": " +",
    "Q": r'"([^"\\]|\\.)*"',
    "O": r"\[",
    "X": r"\]",
    "P": r"\(",
    "E": r"\)",
    "J": r"{",
    ":": ":",
    "=": "=",
    "*": r"\*\* ",
    "Z": r".",
}
_LV = "[ULC]"
_WORD = "[UCLWBIANTY]"  # a name of letters, digits, dots, slashes and dashes
_PLAIN = "[UCLWBI]"  # of letters, digits and dots
# Layout -> grammar of its head over kinds of tokens.  What follows the head is the message.
HEADS = {
    "dashed": rf"(?P<ts>T)D(?P<comp>[^SD]+)D(?P<lvl>{_LV})D",
    "bracket_time": rf"O(?P<ts>T)XS?OS?(?P<lvl>{_LV})S?XS(?:(?P<comp>{_WORD}):S)?",
    "time_bracket": rf"(?P<ts>T)SOS?(?P<lvl>{_LV})S?XS(?:(?P<comp>{_WORD}):S)?",
    "plain_time": rf"(?P<ts>T)S(?P<lvl>{_LV}):?S",
    "simulator": rf"S?(?P<ts>Y)S(?P<lvl>U)S(?P<comp>{_PLAIN}+)(?:S|$)",
    "level_file": rf"(?P<lvl>U)S(?P<comp>{_WORD}):{_WORD}:IS",
    "basic": rf"(?P<lvl>U):(?P<comp>{_WORD}):",
    "lint": rf"(?P<lvl>R)(?:(?P<comp>[^S:]+):I(?::I)?:S)?",
    "compiler": rf"(?P<comp>[^S:]+):I(?::I)?:S(?P<lvl>{_LV}):S",
    "daemon": rf"(?P<comp>[BAWUCL])(?:OIX)?:S(?P<lvl>{_LV}):S",
    "pairs": r"W=",
    "json": r"S?JS?Q",
    # heads of few parts
    "host": rf"(?P<ts>[MT])S{_WORD}S(?P<comp>{_WORD})(?:OIX)?:S(?:(?P<lvl>{_LV}):S|OS?(?P<lvl2>{_LV})S?XS)?",
    "clock": rf"O?(?P<ts>[KM])X?S(?:O?(?P<lvl>{_LV})X?:?S(?:(?P<comp>{_WORD}):S)?)?",
    "time": rf"(?P<ts>T):?S|O(?P<ts2>T)X:?S",
    "stars": rf"\*(?P<lvl>[UC])(?:S?P[^SE]+E)?:S(?:(?P<comp>[^SP:]+)PIE:S)?",
    "level_bracket": rf"OS?(?P<lvl>{_LV})S?X:?S(?:(?P<comp>{_WORD}):S)?",
    "level": r"(?P<lvl>U)(?::S|D|S)",
}
_NAMES = list(HEADS)
_FEW = frozenset(k for k, n in enumerate(_NAMES) if n in ("clock", "level_bracket", "level"))  # too few parts for a line that may be cut
_CONTROL = re.compile(r"\x1b(?:\[[0-?]*[ -/]*[@-~]|\][^\x07\x1b]*(?:\x07|\x1b\\)|[@-Z\\-_])")
_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|.)")
_KINDS = "".join(TOKENS)


class _Machine:
    """Tokens of the lines' heads, and the layouts that accept them."""

    def __init__(self) -> None:
        self.lexer = Automaton(list(TOKENS.values()))
        # groups have no names in the automaton, which does not see the end of a line: there an alternative is spelled out
        bare = [re.sub(r"\(\?(?:P<\w+>|:)", "(", h).replace("|$)", "|)") for h in HEADS.values()]
        self.grammar = Automaton(bare)
        self.code = np.frombuffer(_KINDS.encode(), dtype=np.uint8)
        self.heads = [re.compile(h) for h in HEADS.values()]
        self.known: dict[tuple[str, int], dict[str, tuple[int, int]]] = {}

    def starts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[int, tuple[int, str, list[int]]]:
        """Line -> (layout, kinds, places of the tokens) of the lines in which a layout accepts; the first layout of the list wins."""
        n = len(starts)
        layout, state = np.full(n, len(_NAMES), dtype=np.int32), np.ones(n, dtype=np.int32)
        live = np.flatnonzero(starts < ends)
        pos = starts.astype(np.int64)
        steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(live):
            kind, upto = self.lexer.longest(data, pos[live], ends[live])
            c = self.code[kind]
            steps.append((live, c, pos[live]))
            state[live] = self.grammar.table[state[live], c]
            hit = self.grammar.accepts[state[live]]
            got = np.flatnonzero(hit >= 0)
            layout[live[got]] = np.minimum(layout[live[got]], hit[got])
            pos[live] = upto
            # a record of pairs is cut to its end, other heads until no layout is left
            going = (state[live] != 0) | (layout[live] == _NAMES.index("pairs"))
            live = live[np.flatnonzero(going & (upto < ends[live]))]
        if not steps:
            return {}
        line, c, at = (np.concatenate(x) for x in zip(*steps, strict=True))
        sel = np.flatnonzero(layout[line] < len(_NAMES))
        if not len(sel):
            return {}
        sel = sel[np.argsort(line[sel], kind="stable")]
        line, c, at = line[sel], c[sel], at[sel]
        first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        kinds, places = c.tobytes().decode(), at.tolist()
        out = {}
        for k, lo, hi in zip(line[first].tolist(), first.tolist(), [*first[1:].tolist(), len(line)], strict=True):
            out[k] = (int(layout[k]), kinds[lo:hi], [*places[lo:hi], int(pos[k])])
        return out

    def fields(self, layout: int, kinds: str) -> dict[str, tuple[int, int]]:
        """Field -> its range of tokens, 'head' the whole, by the layout's grammar."""
        key = (kinds, layout)
        if key not in self.known:
            m = self.heads[layout].match(kinds)
            spans = {} if m is None else {f: m.span(f) for f, v in m.groupdict().items() if v is not None}
            self.known[key] = spans | ({} if m is None else {"head": m.span()})
        return self.known[key]


@cache
def _machine() -> _Machine:
    return _Machine()


def utc_text(ts: str) -> str:
    """Wall-clock text as UTC ``yyyy-MM-dd HH:mm:ss``, fractions cut off; a time without zone is UTC."""
    zone = ts[19:].lstrip("0123456789.,").strip()
    if zone in ("", "Z"):
        return f"{ts[:10]} {ts[11:19]}"
    try:
        t = datetime.fromisoformat(f"{ts[:10]}T{ts[11:19]}{zone}")
    except ValueError:
        return f"{ts[:10]} {ts[11:19]}"
    return t.astimezone(UTC).strftime("%Y-%m-%d %H:%M:%S")


@cache
def _stamp() -> Automaton:
    return Automaton([TOKENS["T"]])


def _any_time(v: object) -> str:
    if isinstance(v, bool) or v is None:
        return ""
    if isinstance(v, (int, float)):
        if v > 1e11:  # milliseconds
            v /= 1000
        try:
            return datetime.fromtimestamp(int(v // 1), UTC).strftime("%Y-%m-%d %H:%M:%S")
        except (OverflowError, ValueError, OSError):
            return ""
    s = str(v).strip()
    if _stamp().whole(s) == 0:
        return utc_text(s)
    try:
        return _any_time(float(s))
    except ValueError:
        return s


def _unescape(m: re.Match[str]) -> str:
    c = m[1]
    return chr(int(c[1:], 16)) if len(c) == 5 else {"n": "\n", "t": "\t", "r": "\r"}.get(c, c)


def _from_keys(d: dict) -> tuple[str, str, str, str] | None:
    """Fields of a record with named fields."""
    ts = next((d[k] for k in ("ts", "time", "timestamp", "asctime", "@timestamp") if d.get(k) is not None), None)
    lvl = next((d[k] for k in ("level", "levelname", "lvl", "severity") if d.get(k) is not None), None)
    if ts is None and str(lvl).lower() not in LEVELS:  # a word that is no level carries none
        return None
    comp = next((d[k] for k in ("logger", "component", "name", "program", "source", "file") if d.get(k)), "")
    msg = next((d[k] for k in ("message", "msg", "event", "text") if d.get(k) is not None), "")
    return _any_time(ts), LEVELS.get(str(lvl).lower(), "") if lvl is not None else "", str(comp), str(msg)


def _pairs(kinds: str, places: list[int], cut) -> tuple[dict[str, str], int]:
    """Keys and values of a record of pairs, and the token at which it ends."""
    d, k, n = {}, 0, len(kinds)
    while k < n:
        e = k
        while e < n and kinds[e] in "WBIANUCLTMKY":
            e += 1
        if e == k or e >= n or kinds[e] != "=":
            break
        v = e + 1
        if v < n and kinds[v] == "Q" and (v + 1 == n or kinds[v + 1] in "SD"):
            value = _ESCAPE.sub(_unescape, cut(places[v], places[v + 1])[1:-1])
            end = v + 1
        else:
            end = v
            while end < n and kinds[end] not in "SD":
                end += 1
            value = cut(places[v], places[end])
            if end < n and kinds[end] == "D" or "T" in kinds[v:end] or "M" in kinds[v:end]:  # tokens that hold blanks
                value = value.split(" ")[0]
        d[cut(places[k], places[e])] = value
        k = end
        if k < n and kinds[k] != "S":
            break
        k += k < n
    return d, k


def entries(texts: list[str | None], tail: list[bool] | None = None) -> Iterator[tuple[int, int, str, str, str, str]]:
    """(index of the text, line_no, entry_ts, level_name, component, message) of all entries; ``tail`` tells which texts may begin within a line."""
    machine = _machine()
    texts = [t if not t or "\x1b" not in t else _CONTROL.sub("", t) for t in texts]
    lines_of = [t.split("\n") if t else [] for t in texts]
    flat = [x for ls in lines_of for x in ls]
    if not flat:
        return
    raw = "\n".join(flat).encode("utf-8", "replace")
    data = np.frombuffer(raw, dtype=np.uint8)
    breaks = np.flatnonzero(data == 10)
    starts, ends = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(data)]])
    blank = np.isin(data, np.frombuffer(b" \t\r\f\v", dtype=np.uint8))
    filled = np.concatenate([[-1], np.flatnonzero(~blank & (data != 10))])
    last = filled[np.searchsorted(filled, ends, side="left") - 1] + 1  # without white space at the end
    found = machine.starts(data, starts, np.maximum(last, starts))
    cut = lambda a, b: raw[a:b].decode("utf-8", "replace")

    def head(no: int, first: bool, line: str) -> tuple[str, str, str, str] | None:
        if no not in found:
            return None
        layout, kinds, places = found[no]
        if first and layout in _FEW:
            return None
        name = _NAMES[layout]
        if name == "json":
            try:
                d = json.loads(line)
            except (ValueError, RecursionError):
                return None
            return _from_keys(d) if isinstance(d, dict) else None
        if name == "pairs":
            d, k = _pairs(kinds, places, cut)
            got, rest = _from_keys(d), cut(places[k], int(last[no]))
            return got and (got[0], got[1], got[2], got[3] + (" " + rest if rest.strip() else ""))
        f = machine.fields(layout, kinds)
        if not f:
            return None
        ts, lvl, comp = (next((cut(places[f[x][0]], places[f[x][1]]) for x in names if x in f), "") for names in (("ts", "ts2"), ("lvl", "lvl2"), ("comp",)))
        kind = kinds[f["ts"][0]] if "ts" in f else "T"
        if kind == "T" and ts:
            ts = utc_text(ts)
        elif kind == "Y" and ts[:1] == "-":
            ts = ""
        if kinds[f["lvl"][0]] == "R" if "lvl" in f else False:
            lvl = lvl[1:].partition(":")[0].partition("-")[0]
        return ts, LEVELS.get(lvl.lower(), ""), comp, cut(places[f["head"][1]], int(last[no]))

    at = 0
    for k, ls in enumerate(lines_of):
        cur = None
        parts: list[str] = []
        may_be_cut = tail is not None and tail[k]
        for no, line in enumerate(ls, 1):
            got = head(at, no == 1 and may_be_cut, line) if at in found else None
            at += 1
            if got is not None:
                if cur:
                    yield (k, *cur, _message(parts))
                cur, parts = (no, got[0], got[1], got[2]), [got[3]]
            elif cur:
                parts.append(line)
        if cur:
            yield (k, *cur, _message(parts))


def _message(parts: list[str]) -> str:
    if len(parts) == 1 and "\n" not in parts[0]:
        return parts[0].strip()
    return "\n".join(x.rstrip() for p in parts for x in p.split("\n")).strip()


ENTRY_SCHEMA = "origin string, row_id long, line_no int, entry_ts string, level_name string, component string, message string"


def parse_logs(texts: DataFrame, tails: tuple[str, ...] = ("iteration_log",)) -> DataFrame:
    """Entries of a frame of (origin, row_id, text); texts of the origins in ``tails`` may begin within a line."""
    cols = [c.split()[0] for c in ENTRY_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = list(entries(b["text"].tolist(), b["origin"].isin(tails).tolist()))
            if not rows:
                continue
            k = np.fromiter((r[0] for r in rows), dtype=np.int64, count=len(rows))
            out = pd.DataFrame({"origin": b["origin"].to_numpy()[k], "row_id": b["row_id"].to_numpy()[k]})
            for j, c in enumerate(cols[2:], 1):
                out[c] = [r[j] for r in rows]
            yield out

    return texts.select("origin", "row_id", "text").mapInPandas(run, ENTRY_SCHEMA)


def log_texts(raw_results: DataFrame, iteration_log: DataFrame) -> DataFrame:
    """The texts of both tables, each row once."""
    a = raw_results.select(F.lit("raw_results").alias("origin"), F.col("result_id").alias("row_id"), F.col("log").alias("text"))
    b = iteration_log.select(F.lit("iteration_log").alias("origin"), F.col("row_id"), F.col("output_tail").alias("text"))
    return a.unionByName(b).filter(F.length("text") > 0).distinct()


def level_counts(parsed: DataFrame) -> DataFrame:
    """Entries by origin, component and level."""
    return parsed.groupBy("origin", "component", "level_name").agg(F.count("*").alias("n_entries"), F.max(F.length("message")).cast("bigint").alias("longest"))
