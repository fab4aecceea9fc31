"""Personal information in free text: found, typed and replaced.

A skip-chain conditional random field labels the tokens of each document.  A
line's tokens form a chain; tokens of capitalised words that are repeated or
similar (case, accents, a final s, inner vowels) in runs of such words, wherever they
stand in the document, are tied through one node per word, which says whether the word is a
person's name there.  Loopy message passing goes between the chains (exact
forward and backward sums) and these nodes until the messages settle, so a name
that is certain in one place supports the same name in another, however far.

Observations are the tokens themselves: words, shapes, the tokens around them,
and for a run of numbers or of capitals what stands before and behind the run.
The weights are fitted here by gradient steps on the likelihood of
``TRAIN_DOCS`` made-up documents (:mod:`kilnspark.llm.pii_samples`, a seed and
a bounded number); the tie is fitted on the pairs of repeated words in them.
Labelled spans are trimmed and checked for what any mention of the type holds.

Defined results: null and empty texts have no mention and stay as they are; a
mention is reported once, at the code point of its first character; mentions
don't overlap.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnspark.llm.pii_samples import COMMON, FLATS, ROADS, THINGS, UNITS, training_documents

TYPES = ("email", "id_number", "phone", "address", "person")
TRAIN_DOCS = 1600  # made-up training documents
K = len(TYPES) + 1  # labels; 0 is none
PERSON = 5
DIM = 1 << 18  # hashed features
ROUNDS = 20  # of message passing at most; they end when the messages settle
SETTLED = 1e-2  # log odds
CERTAIN = 5.0  # log odds beyond which a place of a word is certain
KEPT = 400_000  # tokens remembered
CHARS_AT_ONCE = 1 << 21
LONG_RUN = 7  # digits of a run that may be a number of a person

_BLANK = " \t\r\f\v\xa0"
_TOKEN = re.compile(rf"[{_BLANK}]*+(?:[^\W\d_]++(?:['’][^\W\d_]++)*|\d++|[^\w{_BLANK}]|_)")
_AT_WORDS = frozenset(("at", "arroba", "chez"))
_DOT_WORDS = frozenset(("dot", "punkt", "point", "punto"))
_MARKS = ["\n", "@", ".", ",", "-", "(", ")", "+", "/", ":", ";", '"', "<", ">", "[", "]", "'", "_", "|", "#", "*", "=", "&", "\\"]
_LIKE = {"＠": "@", "–": "-", "‑": "-", "’": "'", "“": '"', "”": '"'}
_CLASSES = ["other", "lower", "common", "Cap", "CapCommon", "Initial", "UPPER", "mixed", "camel", "road", "flat", "thing", "unit", "at", "dot", "d1", "d2", "d3", "d4", "d5", "d6", "d8", *_MARKS]
_CLASS = {c: k for k, c in enumerate(_CLASSES)}
N_CLASS = 1 << (2 * len(_CLASSES) - 1).bit_length()
_FIRST_DIGIT = _CLASS["d1"]
_NUMBER_PARTS = frozenset(_CLASS[c] for c in ("d1", "d2", "d3", "d4", "d5", "d6", "d8", "+", "(", ")", "-", ".", "/"))


def _h(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) % DIM


_ELIDED = re.compile(r"(?i:[ldjnscmt]|qu|jusqu|lorsqu|puisqu)['’][a-zà-öø-ÿ]")  # an article or pronoun before a word


def class_of(t: str) -> str:
    """The class of a token, by its letters and by small fixed lists."""
    t = _LIKE.get(t, t)
    if t in _CLASS and not t.isalpha():
        return t
    if t.isdigit():
        return f"d{len(t) if len(t) < 6 else 6 if len(t) < 8 else 8}"
    if not t[0].isalpha():
        return "other"
    low = t.lower()
    if low in _AT_WORDS:
        return "at"
    if low in _DOT_WORDS:
        return "dot"
    if low in ROADS or low.endswith(("straße", "strasse", "gasse", "platz", "allee", "weg", "str")):
        return "road"
    if low in FLATS:
        return "flat"
    if t[0].isupper():
        if len(t) == 1:
            return "Initial"
        if _ELIDED.match(t):
            return "CapCommon"
        if low in COMMON:
            return "CapCommon"
        if t.isupper():
            return "UPPER"
        if low in THINGS:
            return "thing"
        return "Cap" if not any(map(str.isupper, re.sub(r"^\w|['’]\w", "", t))) or t[:2] == "Mc" else "mixed"
    if low in UNITS:
        return "unit"
    if low in THINGS:
        return "thing"
    if low in COMMON:
        return "common"
    return "lower" if t.islower() else "camel"


def name_key(t: str) -> str:
    """What similar spellings of a name share: no accents, no final s, no inner vowels in a long word."""
    s = "".join(c for c in unicodedata.normalize("NFKD", t.lower().removesuffix("'s").removesuffix("’s")) if c.isalnum())
    s = s.removesuffix("s")
    return s if len(s) < 6 else s[0] + re.sub("[aeiouy]", "", s[1:])


class _Tokens(dict):
    """Token with the blanks before it -> number; arrays by number hold its class, lengths and features."""

    OFFSETS = (-3, -2, -1, 0, 1, 2, 3)

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = weights
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.kind = np.zeros(1024, np.int64)
        self.length = np.zeros(1024, np.int64)
        self.gap = np.zeros(1024, np.int64)
        self.digits = np.zeros(1024, np.int64)
        self.words: list[str] = []
        self.features: list[list[list[int]]] = []
        # summed weights of a token at each place around another
        self.scores = np.zeros((1024, len(self.OFFSETS), K), np.float32)

    def __missing__(self, key: str) -> int:
        t = key.lstrip(_BLANK)
        if t.isdigit():  # digits differ by their number and by a zero in front only
            form = key[: len(key) - len(t)] + ("0" if t[0] == "0" else "9") + "9" * (len(t) - 1)
            if form != key:
                n = self[key] = self[form]
                return n
        gap = len(key) > len(t)
        n = self[key] = len(self.words)
        if n == len(self.kind):
            self.kind, self.length, self.gap, self.digits, self.scores = (np.concatenate([x, np.zeros_like(x)]) for x in (self.kind, self.length, self.gap, self.digits, self.scores))
        self.length[n], self.gap[n], self.digits[n] = len(t), len(key) - len(t), len(t) if t.isdigit() else 0
        self.words.append(t)
        if len(key) > len(t) + 1:  # more blanks tell no more than one
            m = self[" " + t]
            self.kind[n], self.scores[n] = self.kind[m], self.scores[m]
            if self.weights is None:
                self.features.append(self.features[m])
            return n
        c = class_of(t)
        self.kind[n] = 2 * _CLASS[c] + gap
        low = t.lower()
        # a capitalised word that is no common one tells by its shape, not by itself
        own = [f"c|{c}|{gap}"] + ([f"w|{low}", f"e|{low[-2:]}"] if c not in ("Cap", "UPPER") and not t.isdigit() else [f"l|{min(len(t), 9)}" if c == "Cap" else f"z|{t[:1] == '0'}"])
        near = own[:2] if c not in ("Cap", "UPPER") else own[:1]
        feats = [[_h(f"{o}|{f}") for f in (own if o == 0 else near)] for o in self.OFFSETS]
        if self.weights is None:
            self.features.append(feats)
        else:
            sizes = [len(f) for f in feats]
            self.scores[n] = np.add.reduceat(self.weights[[x for f in feats for x in f]], np.cumsum([0, *sizes[:-1]]), axis=0)
        return n


class _Batch:
    """Tokens of several texts in one array, cut into lines; only lines that may hold a mention are labelled."""

    def __init__(self, texts: list[str | None], tokens: _Tokens):
        if len(tokens) > KEPT:
            tokens.clear()
        codes: list[int] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        lookup = tokens.__getitem__
        for i, t in enumerate(texts):
            if not t:
                continue
            held = _TOKEN.findall(t)
            codes += map(lookup, held)
            counts[i] = len(held)
        self.tokens, self.texts = tokens, texts
        self.code = np.array(codes, dtype=np.int64)
        self.doc = np.repeat(np.arange(len(texts)), counts)
        ends = np.cumsum(counts)
        self.kind, length = tokens.kind[self.code], tokens.length[self.code]
        self.cls = self.kind >> 1
        total = np.cumsum(length + tokens.gap[self.code])
        base = np.concatenate([[0], total])[np.repeat(ends - counts, counts)] if len(codes) else total
        self.end = total - base  # code points from the document's start
        self.start = self.end - length
        self._lines()
        self._runs()
        self._active()

    def _is(self, *names: str) -> np.ndarray:
        return np.isin(self.cls, [_CLASS[c] for c in names])

    def _lines(self) -> None:
        n = len(self.code)
        new = np.ones(n, bool)
        if n:
            new[1:] = (self.doc[1:] != self.doc[:-1]) | (self.cls[:-1] == _CLASS["\n"])
        self.line = np.cumsum(new) - 1

    def _run(self, part: np.ndarray, tight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, last + 1) of the maximal runs of tokens with ``part`` in a line, and the run of each token or -1; ``tight`` tokens join only without a gap."""
        n = len(part)
        prev = np.zeros(n, bool)
        prev[1:] = part[:-1] & (self.line[1:] == self.line[:-1])
        begins = part & ~(prev & ~tight)
        first = np.flatnonzero(begins)
        number = np.where(part, np.cumsum(begins) - 1, -1)
        last = np.zeros(len(first), np.int64)
        at = np.flatnonzero(part)
        last[number[at]] = at + 1
        return first, last, number

    def _runs(self) -> None:
        """Features of a token's run of numbers or of capitals, as numbers; 0 is none."""
        n = len(self.code)
        self.extra = np.zeros((n, 4), np.int64)
        if not n:
            return
        words = self.tokens.words
        gap = (self.kind & 1) == 1
        glued = np.zeros(n, bool)  # letters right beside digits
        digit = np.isin(self.cls, [_CLASS[c] for c in ("d1", "d2", "d3", "d4", "d5", "d6", "d8")])
        letters = self._is("Initial", "UPPER", "Cap", "mixed")
        glued[1:] |= letters[1:] & digit[:-1] & ~gap[1:]
        glued[:-1] |= letters[:-1] & digit[1:] & ~gap[1:]
        ends = np.zeros(n, bool)  # a dot before a blank ends a sentence, and a run
        ends[:-1] = (self.cls[:-1] == _CLASS["."]) & gap[1:]
        part = (np.isin(self.cls, list(_NUMBER_PARTS)) | glued) & ~ends
        first, last, number = self._run(part, np.zeros(n, bool))
        total = np.zeros(len(first), np.int64)
        np.add.at(total, number[part], self.tokens.digits[self.code[part]])
        self.long = np.zeros(n, bool)
        code, line = self.code.tolist(), self.line
        for r in np.flatnonzero(total >= LONG_RUN).tolist():
            a, b = int(first[r]), int(last[r])
            while b > a and not words[code[b - 1]][-1].isalnum():
                b -= 1
            while a < b and self.cls[a] in (_CLASS[")"], _CLASS["-"], _CLASS["."], _CLASS["/"]):
                a += 1
            if self.cls[a] == _CLASS["("] and not any(self.cls[k] == _CLASS[")"] for k in range(a, b)):
                a += 1
            if a >= b:
                continue
            doc = int(self.doc[a])
            form = _form(self.texts[doc][int(self.start[a]) : int(self.end[b - 1])])
            before = [words[code[k]].lower() for k in range(max(0, a - 4), a) if line[k] == line[a]]
            after = words[code[b]].lower() if b < n and line[b] == line[a] else ""
            label = next((w for w in reversed(before) if w[0].isalpha() or w in "@#"), "")
            self.extra[a:b, 0] = _h(f"run|{form}")
            self.extra[a:b, 1] = _h(f"runb|{label}")
            self.extra[a:b, 2] = _h(f"runa|{after}|{form.count('9')}")
            self.extra[a:b, 3] = _h(f"rund|{min(form.count('9'), 16)}|{form[:1]}")
            self.long[a:b] = True
        # an address spelled out: a dot in words soon after an at in words
        ats, dots = np.flatnonzero(self._is("at")), np.flatnonzero(self._is("dot"))
        after = np.searchsorted(dots, ats)
        for a, d in zip(ats[after < len(dots)].tolist(), dots[after[after < len(dots)]].tolist(), strict=True):
            if d - a <= 8 and line[d] == line[a]:
                lo, hi = max(a - 4, 0), min(d + 2, n)
                free = np.flatnonzero((self.extra[lo:hi, 3] == 0) & (line[lo:hi] == line[a])) + lo
                self.extra[free, 3] = _h("spelled")
        # capitals, with initials, hyphens and commas between them
        cap = self._is("Cap", "Initial", "UPPER", "mixed")
        joint = self._is(".", ",", "-")
        near = np.zeros(n, bool)
        near[1:] |= cap[:-1]
        part = cap | (joint & near & np.concatenate([cap[1:], [False]]) & ~gap)
        part |= self._is(".") & near & ~gap & np.concatenate([[False], self._is("Initial")[:-1]])
        first, last, number = self._run(part, np.zeros(n, bool))
        long = last - first >= 2
        at = np.flatnonzero(part & (number >= 0))
        at = at[long[number[at]]]
        self.caps = np.zeros(n, bool)
        self.caps[at] = True
        if len(at):
            f, e = first[number[at]], last[number[at]]
            pad = np.concatenate([self.code, [-1]])
            # the words beside the run, in the lines beside where it is alone there
            filled = np.flatnonzero(self.cls != _CLASS["\n"])
            before = filled[np.maximum(np.searchsorted(filled, f) - 1, 0)]
            after = filled[np.minimum(np.searchsorted(filled, e), len(filled) - 1)]
            ahead = np.where((before < f) & (self.doc[before] == self.doc[f]), pad[before], -1)
            behind = np.where((after >= e) & (self.doc[after] == self.doc[f]), pad[after], -1)
            apart = 2 * ((ahead >= 0) & (line[before] != line[f])), 2 * ((behind >= 0) & (line[after] != line[f]))
            low: dict[int, str] = {-1: "^"}
            for c in np.unique(np.concatenate([ahead, behind])).tolist():
                if c >= 0:
                    w = words[c]
                    k = class_of(w)
                    low[c] = k if k in ("Cap", "UPPER") or k[0] == "d" and k[1:].isdigit() else w.lower()
            size = np.minimum(e - f, 7)
            m = {(c, s): _h(f"cap{s}|{low[c]}") for c in low for s in range(4)}
            free = self.extra[at, 0] == 0
            self.extra[at, 1] = np.where(free, [m[x] for x in zip(behind.tolist(), apart[1].tolist(), strict=True)], self.extra[at, 1])
            self.extra[at, 2] = np.where(free, [m[x] for x in zip(ahead.tolist(), (1 + apart[0]).tolist(), strict=True)], self.extra[at, 2])
            sizes = np.array([_h(f"capn|{k}") for k in range(8)])
            self.extra[at, 3] = np.where(free, sizes[size], self.extra[at, 3])

    def _active(self) -> None:
        """The tokens to label: those of lines in which something may be a mention."""
        n = len(self.code)
        if not n:
            self.at, self.offsets = np.zeros(0, np.int64), np.zeros(1, np.int64)
            return
        lines = int(self.line[-1]) + 1
        has = lambda mask: np.bincount(self.line[mask], minlength=lines) > 0
        number = np.isin(self.cls, [_CLASS[c] for c in ("d1", "d2", "d3", "d4")])
        keep = has(self.long) | has(self._is("@", "at")) | has(self.caps) | (has(self._is("road")) & has(number))
        sel = keep[self.line] & (self.cls != _CLASS["\n"])
        self.at = np.flatnonzero(sel)
        line = self.line[self.at]
        self.offsets = np.concatenate([[0], np.flatnonzero(line[1:] != line[:-1]) + 1, [len(line)]]) if len(line) else np.zeros(1, np.int64)

    def around(self, o: int) -> tuple[np.ndarray, np.ndarray]:
        """For the tokens to label, the place of the token ``o`` further and whether it is in the same line."""
        n = len(self.code)
        j = np.clip(self.at + o, 0, n - 1)
        return j, (self.at + o >= 0) & (self.at + o < n) & (self.line[j] == self.line[self.at])

    def trigrams(self) -> list[np.ndarray]:
        """Features of the classes of three tokens around each token."""
        kinds = []
        for o in (-2, -1, 0, 1, 2):
            j, same = self.around(o)
            kinds.append(np.where(same, self.kind[j], N_CLASS - 1))
        out = []
        for k in range(3):
            x = (kinds[k] * N_CLASS + kinds[k + 1]) * N_CLASS + kinds[k + 2]
            x = (x * 3 + k) * 0x9E3779B1 % (1 << 61)
            out.append((x >> 12) % DIM)
        return out


def _form(t: str) -> str:
    s = re.sub(r"\d", "9", t)
    s = re.sub(r"[a-z]", "a", s)
    return re.sub(r"[A-Z]", "A", s)[:32]


# ------------------------------------------------------------------ field


def _steps(offsets: np.ndarray) -> list[np.ndarray]:
    """For each place in a chain, the chains that are longer (by falling length) and their tokens there."""
    length = np.diff(offsets)
    order = np.argsort(-length, kind="stable")
    length, start = length[order], offsets[:-1][order]
    longest = int(length[0]) if len(length) else 0
    count = np.searchsorted(-length, -np.arange(longest), side="left")
    return [start[:c] + t for t, c in enumerate(count.tolist())]


class Field:
    """Weights of the features, of neighbouring labels, and of the tie between places of one word."""

    def __init__(self, w: np.ndarray, near: np.ndarray, tie: float):
        self.w, self.near, self.tie = w, near, tie

    def potentials(self, b: _Batch) -> np.ndarray:
        s = np.zeros((len(b.at), K), np.float32)
        for k, o in enumerate(_Tokens.OFFSETS):
            j, same = b.around(o)
            x = b.tokens.scores[b.code[j], k]
            s += x if o == 0 else np.where(same[:, None], x, 0)
        for f in b.trigrams():
            s += self.w[f]
        extra = b.extra[b.at]
        some = np.flatnonzero(extra.any(1))
        for k in range(4):
            x = extra[some, k]
            s[some] += np.where(x[:, None] > 0, self.w[x], 0)
        return s

    def marginals(self, score: np.ndarray, steps: list[np.ndarray], pairs: np.ndarray | None = None) -> np.ndarray:
        """Label probabilities of each token by sums forward and backward along the chains; ``pairs`` takes up the expected neighbours."""
        psi = np.exp(score - score.max(1, keepdims=True)).astype(np.float64)
        t = np.exp(self.near)
        fwd, bwd = np.empty_like(psi), np.ones_like(psi)
        for k, at in enumerate(steps):
            x = psi[at] if k == 0 else (fwd[steps[k - 1][: len(at)]] @ t) * psi[at]
            fwd[at] = x / x.sum(1, keepdims=True)
        for k in range(len(steps) - 1, 0, -1):
            at = steps[k]
            x = (bwd[at] * psi[at]) @ t.T
            before = steps[k - 1][: len(at)]
            bwd[before] = x / x.sum(1, keepdims=True)
            if pairs is not None:
                a, z = fwd[before], bwd[at] * psi[at]
                pairs += t * ((a / ((a @ t) * z).sum(1, keepdims=True)).T @ z)
        p = fwd * bwd
        return p / p.sum(1, keepdims=True)

    def infer(self, b: _Batch, skip: bool = True) -> np.ndarray:
        """Labels' probabilities after message passing between the chains and the words' nodes."""
        score = self.potentials(b)
        steps = _steps(b.offsets)
        p = self.marginals(score, steps)
        group, at = _names(b, p) if skip and self.tie else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if not len(at):
            return p
        # only the lines of tied tokens are summed again
        chain = np.repeat(np.arange(len(b.offsets) - 1), np.diff(b.offsets))
        chains = np.unique(chain[at])
        sizes = np.diff(b.offsets)[chains]
        sub = np.concatenate([[0], np.cumsum(sizes)])
        place = np.repeat(b.offsets[chains] - sub[:-1], sizes) + np.arange(int(sub[-1]))
        where = np.zeros(len(b.at), np.int64)
        where[place] = np.arange(len(place))
        local, steps, base = where[at], _steps(sub), score[place].astype(np.float64)
        down = np.zeros(len(at))  # message of a word's node to a token, as log odds of a person
        q = p[place]
        for _ in range(ROUNDS):
            odds = _logit(q[local, PERSON]) - down
            up = _through(odds, self.tie)
            total = np.bincount(group, weights=up)
            new = _through(total[group] - up, self.tie)
            moved = float(np.abs(new - down).max())
            down = new
            s = base.copy()
            np.add.at(s, (local, PERSON), down)
            q = self.marginals(s, steps)
            if moved < SETTLED:
                break
        p = p.copy()
        p[place] = q
        return p


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def _through(odds: np.ndarray, tie: float) -> np.ndarray:
    """Log odds that pass a tie of the given strength."""
    return 2 * np.arctanh(np.tanh(tie / 2) * np.tanh(np.clip(odds, -40, 40) / 2))


def _names(b: _Batch, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, token) of words in runs of capitals that are repeated or similar in a document and may be a name somewhere; a word alone is no mention whosever it is."""
    cap = np.flatnonzero(b.caps[b.at] & np.isin(b.cls[b.at], [_CLASS["Cap"], _CLASS["UPPER"]]) & (b.tokens.length[b.code[b.at]] >= 4) & (p[:, 1:PERSON].sum(1) < 0.5))
    if len(cap) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = b.code[b.at[cap]]
    kinds, back = np.unique(code, return_inverse=True)
    keys: dict[str, int] = {}
    key = np.array([keys.setdefault(name_key(b.tokens.words[c]), len(keys)) for c in kinds.tolist()], dtype=np.int64)[back]
    both = b.doc[b.at[cap]] * np.int64(len(keys)) + key
    _, group, size = np.unique(both, return_inverse=True, return_counts=True)
    # places that agree with certainty need no message: it would only confirm them
    odds = _logit(p[cap, PERSON])
    low, high = np.full(len(size), np.inf), np.full(len(size), -np.inf)
    np.minimum.at(low, group, odds)
    np.maximum.at(high, group, odds)
    open_ = (size > 1) & (low < CERTAIN) & (high > -CERTAIN)
    often = np.flatnonzero(open_[group])
    return np.unique(group[often], return_inverse=True)[1], cap[often]


# ------------------------------------------------------------------ spans

_DIGIT = re.compile(r"\d")
_TRIM_END = re.compile(r"[^\w)]+$")
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


class Mention:
    __slots__ = ("start", "end", "kind", "text")

    def __init__(self, start: int, end: int, kind: str, text: str):
        self.start, self.end, self.kind, self.text = start, end, kind, text


def _address(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    s = text[a:b]
    m = re.search(r"\w", s)
    if not (m and re.search(r"[@＠]|\b(?:at|AT)\b", s) and re.search(r"\.|\b(?:dot|DOT|punkt|point|punto)\b", s)):
        return
    begin, end = a + m.start(), a + len(_TRIM_END.sub("", s).rstrip(")"))
    if re.match(r"(?:at|AT)\b", text[begin:end]) or re.match(r"[^\w]*[@＠]", s):
        begin = a
        while begin and text[begin - 1] in " ([{<":
            begin -= 1
    # letters and marks of an address that touch it belong to it
    while begin and (text[begin - 1].isalnum() or text[begin - 1] in "._%+-"):
        begin -= 1
    while not text[begin].isalnum() and begin < end - 1:
        begin += 1
    yield begin, end


def _span(text: str, a: int, b: int, kind: str) -> Iterator[tuple[int, int]]:
    """Spans within [a, b) that hold what a mention of the type must hold, trimmed."""
    s = text[a:b]
    if kind == "email":
        for piece in re.finditer(r"[^;,|]+", s):  # addresses of a list
            yield from _address(text, a + piece.start(), a + piece.end())
        return
    if kind in ("phone", "id_number"):
        m = re.search(r"[+(\d]" if kind == "phone" else r"[A-Za-z0-9]", s)
        if not m:
            return
        s = _TRIM_END.sub("", s[m.start() :])
        a += m.start()
        if s.count(")") > s.count("("):
            s = s.rstrip(")")
        if s[:1] == "(" and ")" not in s:
            a, s = a + 1, s[1:]
        n = len(_DIGIT.findall(s))
        if (8 <= n <= 15) if kind == "phone" else (n >= 6 and 8 <= sum(map(str.isalnum, s)) <= 18):
            yield a, a + len(s)
        return
    m = re.search(r"\w", s)
    if not m:
        return
    a, s = a + m.start(), _TRIM_END.sub("", s[m.start() :]) + ("." if re.search(r"\b\w$", _TRIM_END.sub("", s)) and s.rstrip()[-1:] == "." else "")
    words = _WORDS.findall(s)
    if kind == "address":
        if _DIGIT.search(s) and any(len(w) > 2 and w[0].isupper() for w in words):
            yield a, a + len(s)
        return
    if len(words) >= 2 and any(len(w) > 1 and w[0].isupper() for w in words):
        yield a, a + len(s)


def mentions(b: _Batch, p: np.ndarray) -> list[list[Mention]]:
    """Mentions of each text of the batch: runs of one label in a line."""
    out: list[list[Mention]] = [[] for _ in b.texts]
    label = p.argmax(1)
    at, line = b.at, b.line[b.at]
    # the sign between the two halves of an address belongs to it
    sign = np.flatnonzero((label == 0) & np.isin(b.cls[at], [_CLASS["at"], _CLASS["@"]]))
    sign = sign[(sign > 0) & (sign < len(label) - 1)]
    sign = sign[(label[sign - 1] == 1) & (label[sign + 1] == 1) & (line[sign - 1] == line[sign]) & (line[sign + 1] == line[sign])]
    label[sign] = 1
    hit = np.flatnonzero(label)
    if not len(hit):
        return out
    new = np.concatenate([[True], (np.diff(hit) != 1) | (label[hit[1:]] != label[hit[:-1]]) | (line[hit[1:]] != line[hit[:-1]])])
    first = hit[new]
    last = hit[np.concatenate([new[1:], [True]])]
    for f, e in zip(first.tolist(), last.tolist(), strict=True):
        doc = int(b.doc[at[f]])
        kind = TYPES[int(label[f]) - 1]
        text = b.texts[doc]
        for a, z in _span(text, int(b.start[at[f]]), int(b.end[at[e]]), kind):
            out[doc].append(Mention(a, z, kind, text[a:z]))
    return out


def infer(texts: list[str | None], field: Field, tokens: _Tokens | None = None, skip: bool = True) -> list[list[Mention]]:
    """Mentions of each text; without ``skip`` the ties between places of a word are left out."""
    tokens = tokens if tokens is not None else _Tokens(field.w)
    out: list[list[Mention]] = []
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (chars < CHARS_AT_ONCE or end == at):
            chars += len(texts[end] or "")
            end += 1
        b = _Batch(texts[at:end], tokens)
        out += mentions(b, field.infer(b, skip)) if len(b.at) else [[] for _ in b.texts]
        at = end
    return out


# ------------------------------------------------------------------ training


def _gold(b: _Batch, docs: list[tuple[str, list[tuple[int, int, str]]]]) -> np.ndarray:
    y = np.zeros(len(b.at), np.int64)
    base = np.searchsorted(b.doc[b.at], np.arange(len(docs) + 1))
    for d, (_, gold) in enumerate(docs):
        lo, hi = base[d], base[d + 1]
        start = b.start[b.at[lo:hi]]
        for a, z, kind in gold:
            y[lo + np.searchsorted(start, a) : lo + np.searchsorted(start, z)] = TYPES.index(kind) + 1
    return y


@cache
def fit(n: int = TRAIN_DOCS, seed: int = 7, epochs: int = 7, docs_a_step: int = 50) -> Field:
    """Adaptive gradient steps on the chains' likelihood with a small ridge; then the tie on repeated words."""
    docs = training_documents(n, seed)
    tokens = _Tokens()
    w, near = np.zeros((DIM, K)), np.zeros((K, K))
    w2, n2 = np.full((DIM, K), 1e-4), np.full((K, K), 1e-4)
    parts = []
    for k in range(0, n, docs_a_step):
        some = docs[k : k + docs_a_step]
        b = _Batch([t for t, _ in some], tokens)
        y = _gold(b, some)
        rows, flat = [], []
        for j, o in enumerate(_Tokens.OFFSETS):
            place, same = b.around(o)
            for r in np.flatnonzero(same).tolist():
                f = tokens.features[b.code[place[r]]][j]
                flat += f
                rows += [r] * len(f)
        rows, flat = [np.array(rows)], [np.array(flat)]
        for f in b.trigrams():
            rows.append(np.arange(len(f)))
            flat.append(f)
        extra = b.extra[b.at]
        r, c = np.nonzero(extra)
        rows.append(r)
        flat.append(extra[r, c])
        row, f = np.concatenate(rows), np.concatenate(flat)
        used, f = np.unique(f, return_inverse=True)
        parts.append((b, y, row, f, used, _steps(b.offsets)))
    field = Field(w, near, 0.0)
    for epoch in range(epochs):
        for b, y, row, f, used, steps in parts:
            score = np.stack([np.bincount(row, weights=w[used, k][f], minlength=len(y)) for k in range(K)], 1)
            expected = np.zeros((K, K))
            p = field.marginals(score, steps, expected)
            miss = -p
            miss[np.arange(len(y)), y] += 1
            g = np.stack([np.bincount(f, weights=miss[row, k], minlength=len(used)) for k in range(K)], 1) - 0.02 * w[used]
            inside = np.ones(len(y), bool)
            inside[b.offsets[:-1]] = False
            at = np.flatnonzero(inside)
            gn = np.bincount(y[at - 1] * K + y[at], minlength=K * K).reshape(K, K) - expected
            w2[used] += g * g
            n2 += gn * gn
            w[used] += 0.4 * g / np.sqrt(w2[used])
            near += 0.1 * gn / np.sqrt(n2)
    field = Field(w.astype(np.float32), near, 0.0)
    return Field(field.w, near, _fit_tie(field, seed))


def _fit_tie(field: Field, seed: int) -> float:
    """Strength of the tie: Newton steps on how often places of one word agree beyond what their chains say, on further made-up documents."""
    docs = training_documents(400, seed + 1)
    b = _Batch([t for t, _ in docs], _Tokens(field.w))
    p = field.marginals(field.potentials(b), _steps(b.offsets))
    y = (_gold(b, docs) == PERSON).astype(float)
    group, at = _names(b, p)
    if not len(at):
        return 0.0
    odds = np.clip(_logit(p[at, PERSON]), -4, 4)
    yes = np.bincount(group, weights=2 * y[at] - 1)
    others = np.sign(yes[group] - (2 * y[at] - 1))  # what most of the other places are
    tie = 0.0
    for _ in range(30):
        q = 1 / (1 + np.exp(-(odds + tie * others)))
        tie += ((y[at] - q) * others).sum() / (1.0 + (q * (1 - q) * others**2).sum()) - 0.01 * tie
    return float(np.clip(tie, 0.0, 6.0))


# ------------------------------------------------------------------ operators


def _field(df: DataFrame):
    f = fit()
    return df.sparkSession.sparkContext.broadcast((f.w, f.near, f.tie))  # DIM x K weights, 6 MB


def find_mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, start_pos, pii_type) of all mentions; narrow but for the distinct of repeated rows."""
    model = _field(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field = Field(*model.value)
        tokens = _Tokens(field.w)
        for b in batches:
            rows = [(i, c.start, c.kind) for i, cs in zip(b["doc_id"].tolist(), infer(b["text"].tolist(), field, tokens), strict=True) for c in cs]
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "start_pos", "pii_type"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, start_pos long, pii_type string").distinct()


def mask(text: str | None, found: list[Mention]) -> str | None:
    """The text with a placeholder of its type for each mention."""
    if not text:
        return text
    out, at = [], 0
    for c in sorted(found, key=lambda c: c.start):
        out += [text[at : c.start], f"[{c.kind.upper()}]"]
        at = c.end
    return "".join([*out, text[at:]])


def mask_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_mentions) with the mentions replaced."""
    model = _field(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field = Field(*model.value)
        tokens = _Tokens(field.w)
        for b in batches:
            found = infer(b["text"].tolist(), field, tokens)
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [mask(t, f) for t, f in zip(b["text"], found, strict=True)], "n_mentions": np.fromiter(map(len, found), dtype=np.int64, count=len(found))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, text string, n_mentions long")
