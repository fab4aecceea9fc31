"""Corpus encoding with a public byte-level BPE vocabulary.

The encoder backtracks: an Aho-Corasick automaton gives the longest vocabulary
entry at each place of a word, and a token is kept only if the pair it forms
with the token before is one that merging could leave standing (checked by
unmerging both against the pair table).  Dead ends clear a position and step
back, so each position is given up at most once and the time is linear.
Words are cut by the vocabulary's public split pattern and their ids memoised.
Decoding copies byte ranges out of one buffer through an offset table.

Defined results: null and empty texts give an empty list; text that looks like
a special token is ordinary text; lone surrogates can't occur in Spark strings.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = os.environ.get("KILN_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the split pattern of the vocabulary.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO = 400_000  # words kept; the memo starts anew beyond it
MEMO_WORD = 64  # characters of a word that is kept; longer ones, which hardly come back, are encoded each time


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file: printable Latin-1 for itself, the rest from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(rest)}


@cache
def _plane_pattern() -> re.Pattern[str]:
    """The split pattern for texts of the basic plane, its classes spelled out from the character database.

    The standard library's matcher tests such classes by table, which is about
    twice as fast as property classes; texts beyond the plane take ``SPLIT``.
    """

    def ranges(holds) -> str:
        out, start = [], None
        for c in range(0x10001):
            y = c < 0x10000 and not 0xD800 <= c < 0xE000 and holds(chr(c))
            if y and start is None:
                start = c
            elif not y and start is not None:
                out.append(f"\\u{start:04x}-\\u{c - 1:04x}")
                start = None
        return "".join(out)

    letters = ranges(lambda c: unicodedata.category(c)[0] == "L")
    numbers = ranges(lambda c: unicodedata.category(c)[0] == "N")
    spaces = ranges(lambda c: regex.match(r"\s", c) is not None)
    return re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+")


class _Memo(dict):
    """Word -> ids; a word not seen yet is encoded."""

    def __init__(self, encode_word):
        self.encode_word = encode_word

    def __missing__(self, word: str) -> list[int]:
        ids = self.encode_word(word.encode("utf-8"))
        if len(word) <= MEMO_WORD:
            if len(self) >= MEMO:
                self.clear()
            self[word] = ids
        return ids


class BacktrackingEncoder:
    """Byte-level BPE by backtracking; ``tokens`` maps bytes to ids in merge order, ``merges`` a pair of ids to its merge."""

    def __init__(self, tokens: dict[bytes, int], merges: dict[tuple[int, int], int] | None = None):
        self.bytes_of = {i: b for b, i in tokens.items()}
        self.id_of = tokens
        # merge order decides validity, so ids are compared through their rank
        single = sorted((i for b, i in tokens.items() if len(b) == 1))
        self.rank = {i: k for k, i in enumerate(single)}
        for i in sorted(i for b, i in tokens.items() if len(b) > 1):
            self.rank[i] = len(self.rank)
        self.prefix: dict[int, int | None] = {}
        self.pair: dict[tuple[int, int], int] = {}
        self.split: dict[int, tuple[int, int]] = {i: (i, i) for i in single}
        if merges is None:
            self._derive()
        else:
            for (a, b), t in merges.items():
                self.pair[a, b] = self.rank[t]
                self.split.setdefault(t, (a, b))
        self.find = ahocorasick.Automaton()
        for b, i in tokens.items():
            self.find.add_word(b.decode("latin-1"), (len(b), i))
        self.find.make_automaton()
        self.memo = _Memo(self.encode_word)
        self.any_words = regex.compile(SPLIT).findall
        self.plane_words = _plane_pattern().findall

    def _derive(self) -> None:
        """Pair table out of ranks alone: a token's parts are its first split whose pair could stand."""
        for i in sorted((i for b, i in self.id_of.items() if len(b) > 1), key=self.rank.__getitem__):
            whole = self.bytes_of[i]
            left = self.shorter(i)
            while left is not None:
                right = self.id_of.get(whole[len(self.bytes_of[left]) :])
                if right is not None and max(self.rank[left], self.rank[right]) < self.rank[i] and self.compatible(left, right):
                    self.pair[left, right] = self.rank[i]
                    self.split[i] = (left, right)
                    break
                left = self.shorter(left)
            self.split.setdefault(i, (i, i))

    def shorter(self, token: int) -> int | None:
        """The next shorter token that begins ``token``."""
        if token not in self.prefix:
            b, found = self.bytes_of[token], None
            for n in range(len(b) - 1, 0, -1):
                found = self.id_of.get(b[:n])
                if found is not None:
                    break
            self.prefix[token] = found
        return self.prefix[token]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging would leave ``a`` and ``b`` side by side: undo merges, latest first, and look for an earlier one across."""
        rank, split, pair = self.rank, self.split, self.pair
        limit = 1 << 60
        while True:
            across = pair.get((a, b))
            if across is not None and across < limit:
                return False
            if rank[a] > rank[b]:
                limit = rank[a]
                nxt = split[a][1]
                if nxt == a:
                    limit, was = rank[b] + 1, b
                    b = split[b][0]
                    if b == was:
                        return True
                else:
                    a = nxt
            else:
                limit = rank[b] + 1
                nxt = split[b][0]
                if nxt == b:
                    limit, was = rank[a], a
                    a = split[a][1]
                    if a == was:
                        return True
                else:
                    b = nxt

    def encode_word(self, word: bytes) -> list[int]:
        whole = self.id_of.get(word)
        if whole is not None:
            return [whole]
        n = len(word)
        longest = [0] * n
        for end, (size, tid) in self.find.iter(word.decode("latin-1")):
            longest[end - size + 1] = tid  # ends grow, so the longest comes last
        open_ = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        pos, token = 0, longest[0]
        bytes_of, compatible = self.bytes_of, self.compatible
        while pos < n:
            last = out[-1] if out else None
            while True:
                end = pos + len(bytes_of[token])
                if open_[end] and (last is None or compatible(last, token)):
                    out.append(token)
                    pos = end
                    token = longest[end] if end < n else token
                    break
                less = self.shorter(token)
                if less is not None:
                    token = less
                    continue
                open_[pos] = 0
                out.pop()
                pos -= len(bytes_of[last])
                token = last
                break
        return out

    def words(self, text: str) -> list[str]:
        flat = text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)
        return self.plane_words(text) if flat else self.any_words(text)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, self.words(text)))) if text else []

    def offsets(self) -> tuple[bytes, np.ndarray]:
        """One buffer of all tokens' bytes and the place of each id in it."""
        top = max(self.bytes_of) + 1
        at = np.zeros(top + 1, dtype=np.int64)
        for i, b in self.bytes_of.items():
            at[i + 1] = len(b)
        return b"".join(self.bytes_of.get(i, b"") for i in range(top)), np.cumsum(at)


def decode_ids(ids: np.ndarray, buf: np.ndarray, at: np.ndarray) -> bytes:
    """Bytes of a list of ids by one gather out of the buffer."""
    if not len(ids):
        return b""
    size = at[ids + 1] - at[ids]
    ends = np.cumsum(size)
    where = np.repeat(at[ids] - (ends - size), size) + np.arange(ends[-1])
    return buf[where].tobytes()


_LOADED: dict[str, BacktrackingEncoder] = {}


def load_encoder(path: str) -> BacktrackingEncoder:
    """The encoder of a vocabulary file (.json with merges, or .tiktoken with ranks), once per worker."""
    if path not in _LOADED:
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                model = json.load(f)["model"]
            letter = _byte_letters()
            spelled = {t: bytes(letter[c] for c in t) for t in model["vocab"] if all(c in letter for c in t)}
            made = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            vocab = model["vocab"]
            reach = {a + b for a, b in made}
            tokens = {spelled[t]: i for t, i in vocab.items() if t in reach or len(t) == 1}
            merges = {(vocab[a], vocab[b]): vocab[a + b] for a, b in made}
            _LOADED[path] = BacktrackingEncoder(tokens, merges)
        else:
            import base64

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(i) for a, i in (line.split() for line in f if line.strip())}
            _LOADED[path] = BacktrackingEncoder(ranks)
    return _LOADED[path]


def encode_corpus(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", folder: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): every text as token ids, one row per input row.  Narrow: no shuffle."""
    path = os.path.join(folder or TOKENIZER_DIR, vocabulary)
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load_encoder(path)
        for b in batches:
            flat, ends = array("i"), [0]
            for t in b.column(1).to_pylist():
                if t:
                    flat.extend(chain.from_iterable(map(enc.memo.__getitem__, enc.words(t))))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[key, "ids"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {key_type}, ids array<int>")


def decode_corpus(encoded: DataFrame, vocabulary: str = "byte_bpe_50k.json", folder: str | None = None, key: str = "doc_id") -> DataFrame:
    """(key, text): the texts of lists of ids."""
    path = os.path.join(folder or TOKENIZER_DIR, vocabulary)
    key_type = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, at = load_encoder(path).offsets()
        buf = np.frombuffer(raw, dtype=np.uint8)
        for b in batches:
            texts = [decode_ids(np.asarray(x or [], dtype=np.int64), buf, at).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(F.col(key), F.col("ids")).mapInArrow(run, f"{key} {key_type}, text string")
