"""Evaluation passages inside training text.

Words are canonicalised to a template: numbers (also spelled out), units and
names become typed placeholders.  Windows of successive template words are
hashed on both sides and hash-joined; hits that follow one another on both
sides make a stretch, in which template and places agree word by word.  The
slots of a stretch then decide:

* a run of at least ``size`` words with equal slots is a verbatim leak;
* slots that map one to one to other values, consistently over all stretches of
  the document and the item, are a re-parameterised copy; the stretches have to
  cover ``LEAST`` words of the item.  A phrase of many items says the less about
  any of them the more values it stands with there.  A stretch that stands for
  more than ``SHARED`` different passages therefore has to be longer, by
  ``CHANCE`` words for each doubling of their number; copies of a passage are
  one, and a stretch that long counts for all its items, however many.

A word is a name by its spelling (underscore, digit, inner capital, a capital
after a small word, a code span) or because an item spells it so; a word that an
item also uses plainly is no name.  So equal words have equal templates,
whatever their case, and no verbatim passage is lost.

The held-out items are the stated query set.  They are carried to the executors
in blocks of ``BLOCK_WORDS`` words (32 MB); every block takes one narrow pass
over the documents, and nothing but the few results is shuffled.  Hot templates
cost hits within a task, not rows of one key.  Restatements are compared among
all items, so their index is one block; more than ``MOST_WORDS`` words (256 MB)
are refused with an error, never cut.

Defined results: null, empty and short texts share nothing; several items with
the same passage all count; repeated documents count each under its own id,
repeated rows once.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 13
SHARED = 3  # passages that a restated stretch of any length may stand for
LEAST = 20  # words of an item that a restatement covers
CHANCE = 4  # words by which a stretch may be longer by chance
BLOCK_WORDS = 1 << 20  # of items carried at once
MOST_WORDS = 1 << 23  # of items that restatements are looked for of
HITS = 1 << 21  # pairs of windows compared at once
KEPT = 1_000_000  # spellings remembered
_WORD = re.compile(r"\w+")
_SPAN = re.compile(r"`([^`\n]+)`")
_NAME_SHAPE = re.compile(r".*[_\d].*|.*[a-z][A-Z].*", re.S)
_AFTER_SMALL = re.compile(r"[a-zß-öø-ÿ] (?=[A-ZÀ-ÖØ-Þ])")
# Units of measure that a question may be restated in.
UNITS = frozenset(
    "s ms us ns ps fs hz khz mhz ghz v mv w mw a ma b kb mb gb kib mib gib bit bits byte bytes word words cycle cycles clock clocks "
    "percent degree degrees cell cells lut luts entry entries stage stages takte takt bitbreite octets octet".split()
)
# Numbers spelled out in the languages of the corpus.
NUMBER_WORDS = frozenset(
    "zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand "
    "null zwei drei vier fünf sechs sieben acht neun zehn elf zwölf sechzehn zwanzig zweiunddreißig hundert tausend deux trois quatre cinq sept huit neuf dix onze douze seize vingt trente cent mille "
    "cero dos tres cuatro cinco seis siete ocho nueve diez once doce dieciséis veinte treinta cien mil".split()
)
_NUMBER = re.compile(r"\d+(?:[eE]\d+)?$|0?[xX][0-9a-fA-F]+$|[bhdo][0-9a-f_xz]*\d[0-9a-f_xz]*$")
_NUMBER_SLOT, _UNIT_SLOT, _NAME_SLOT = "\x01number", "\x01unit", "\x01name"


def _h(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


def spelled(text: str) -> list[str]:
    """The words of a text as they are spelled; those that are names by their place have a mark before them."""
    low = text.lower()
    if len(low) != len(text):
        return _WORD.findall(low)
    if "`" in text:
        return [w for k, part in enumerate(_SPAN.split(text)) for w in (_WORD.findall(part) if k % 2 == 0 else ["`" + w for w in _WORD.findall(part)])]
    return _WORD.findall(text)


class Templates:
    """Canonical words; ``names`` are words that the items spell as names only, ``plain`` those that they also use plainly."""

    def __init__(self, names: frozenset[str], plain: frozenset[str]):
        self.names, self.plain = names, plain

    @classmethod
    def of(cls, texts: list[str]) -> Templates:
        names, plain = set(), set()
        for t in texts:
            proper = {t[m.end() :].split(None, 1)[0].strip(".,;:()[]").lower() for m in _AFTER_SMALL.finditer(t)}
            for w in spelled(t):
                low = w.lower().removeprefix("`")
                (names if w[0] == "`" or _NAME_SHAPE.match(w) or low in proper else plain).add(low)
        return cls(frozenset(names - plain), frozenset(plain))

    def canonical(self, word: str) -> str:
        low = word.lower().removeprefix("`")
        if _NUMBER.match(low) or low in NUMBER_WORDS:
            return _NUMBER_SLOT
        if low in UNITS:
            return _UNIT_SLOT
        if "_" in low or any(map(str.isdigit, low)) or low in self.names:
            return _NAME_SLOT
        if low not in self.plain and (word[0] == "`" or _NAME_SHAPE.match(word)):
            return _NAME_SLOT
        return low


class _Vocabulary(dict):
    """Spelling -> number, with the hash of its template word and of its lower-cased word by number."""

    def __init__(self, templates: Templates):
        self.templates = templates
        self.template, self.word = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        if n == len(self.word):
            self.template, self.word = (np.concatenate([x, np.zeros(n, np.uint64)]) for x in (self.template, self.word))
        self.template[n] = _h(self.templates.canonical(word))
        self.word[n] = _h(word.lower().removeprefix("`"))
        return n


def _rolled(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` successive hashes."""
    n = len(h) - size + 1
    acc = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(size if n > 0 else 0):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
        acc ^= acc >> np.uint64(29)
    return acc


class _Windows:
    """Windows of several texts over one array of words: their places, texts, and hashes of their templates and of their words."""

    def __init__(self, texts: list[str | None], vocabulary: _Vocabulary, size: int):
        if len(vocabulary) > KEPT:
            vocabulary.clear()
        lists = [spelled(t) if t else [] for t in texts]
        n = np.array([len(w) for w in lists], dtype=np.int64)
        code = np.fromiter((c for w in lists for c in map(vocabulary.__getitem__, w)), dtype=np.int64, count=int(n.sum()))
        self.lists, self.ends = lists, np.cumsum(n)
        self.starts = self.ends - n
        self.template_word, self.word = vocabulary.template[code], vocabulary.word[code]
        at = np.arange(max(len(code) - size + 1, 0))
        text = np.searchsorted(self.ends, at, side="right")
        inside = at + size <= self.ends[text] if len(at) else np.zeros(0, bool)
        self.at, self.text = at[inside], text[inside]
        self.template = _rolled(self.template_word, size)[inside]
        self.same = _rolled(self.word, size)[inside]

    def words(self, text: int, place: int, n: int) -> list[str]:
        lo = place - int(self.starts[text])
        return [w.lower().removeprefix("`") for w in self.lists[text][lo : lo + n]]


class Index:
    """Windows of a block of items, by template."""

    def __init__(self, ids: list[int], texts: list[str], templates: Templates, size: int):
        self.ids, self.texts, self.templates, self.size = ids, texts, templates, size

    @cached_property
    def windows(self) -> _Windows:
        return _Windows(self.texts, self.vocabulary, self.size)

    @cached_property
    def vocabulary(self) -> _Vocabulary:
        return _Vocabulary(self.templates)

    @cached_property
    def order(self) -> np.ndarray:
        return np.argsort(self.windows.template, kind="stable")

    @cached_property
    def sorted_templates(self) -> np.ndarray:
        return self.windows.template[self.order]

    def hits(self, docs: _Windows) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (document window, item window) with one template; a document's hits are in one block."""
        lo = np.searchsorted(self.sorted_templates, docs.template, side="left")
        hi = np.searchsorted(self.sorted_templates, docs.template, side="right")
        sel = np.flatnonzero(hi > lo)
        lo, many, text = lo[sel], (hi - lo)[sel], docs.text[sel]
        upto = np.cumsum(many)
        at = 0
        while at < len(sel):
            base = upto[at - 1] if at else 0
            end = int(np.searchsorted(upto, base + HITS, side="right"))
            end = int(np.searchsorted(text, text[min(max(end, at + 1), len(sel)) - 1], side="left")) if end < len(sel) else end
            if end <= at:  # a document with more hits than a block
                end = int(np.searchsorted(text, text[at], side="right"))
            m = many[at:end]
            left = np.repeat(sel[at:end], m)
            right = np.repeat(lo[at:end] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            yield left, self.order[right]
            at = end

    def verbatim(self, docs: _Windows) -> set[tuple[int, int]]:
        """(document, item id) that share a stretch of ``size`` words with equal slots."""
        held, out = self.windows, set()
        for d, i in self.hits(docs):
            equal = docs.same[d] == held.same[i]
            d, i = d[equal], i[equal]
            pair = docs.text[d] * np.int64(len(self.ids)) + held.text[i]
            for k in np.unique(pair, return_index=True)[1].tolist():
                doc, item = int(docs.text[d[k]]), int(held.text[i[k]])
                # hashes may meet by chance, the words decide
                same = pair == pair[k]
                if any(docs.words(doc, docs.at[x], self.size) == held.words(item, held.at[y], self.size) for x, y in zip(d[same].tolist(), i[same].tolist(), strict=True)):
                    out.add((doc, self.ids[item]))
        return out

    def restated(self, docs: _Windows) -> Iterator[tuple[int, int, int]]:
        """(document, item id, words covered) of re-parameterised copies."""
        held = self.windows
        for d, i in self.hits(docs):
            x, y = docs.at[d], held.at[i]
            order = np.lexsort((x, x - y))
            d, i, x, y = d[order], i[order], x[order], y[order]
            first = np.flatnonzero(np.concatenate([[True], (np.diff(x - y) != 0) | (np.diff(x) != 1)]))
            length = np.diff(np.concatenate([first, [len(x)]])) + self.size - 1
            equal = np.maximum.reduceat((docs.same[d] == held.same[i]).astype(np.int8), first) > 0
            least = _least_length(_passages(x, held.same[i], first))
            by_doc: dict[int, list[tuple[int, int, int, int, int]]] = {}
            for k in np.flatnonzero((length >= least) | equal).tolist():
                f = first[k]
                by_doc.setdefault(int(docs.text[d[f]]), []).append((int(length[k]), int(x[f]), int(y[f]), int(held.text[i[f]]), int(least[k])))
            for doc, stretches in by_doc.items():
                for item, n in self.covered(docs, doc, stretches):
                    if n >= LEAST:
                        yield doc, self.ids[item], n

    def covered(self, docs: _Windows, doc: int, stretches: list[tuple[int, int, int, int, int]]) -> Iterator[tuple[int, int]]:
        """(item, words of it that the document restates).

        Stretches are cut at their verbatim parts and where slots stop to map consistently, over all stretches
        of an item.  Words of the document belong to the items that have most of them in one piece, and to all
        others that have the same passage, word for word: what is copied from one item, verbatim or not, is no
        restatement of another that has part of the same phrases with values of its own.  The rest of a piece
        that belongs to others for the most part counts by itself.
        """
        slots: dict[int, _Slots] = {}
        claimed = np.zeros(len(docs.lists[doc]), dtype=np.int64)
        base = int(docs.starts[doc])
        given: dict[tuple[int, bytes], tuple[int, np.ndarray]] = {}
        places: dict[int, set[int]] = {}
        # the longest first: words in one piece, whether verbatim parts may be in it, places, item, words, words needed
        waiting = [(-n, True, x, y, item, n, least) for n, x, y, item, least in stretches]
        heapq.heapify(waiting)
        while waiting:
            one, uncut, x, y, item, n, least = heapq.heappop(waiting)
            one = -one
            held = claimed[x - base : x - base + n]
            own = held <= one + CHANCE
            words = self.windows.word[y : y + n]
            for at, others in () if own.all() else given.values():  # what has the words of a longer piece is the same passage
                lo, hi = max(x, at), min(x + n, at + len(others))
                for start, end in _runs(words[lo - x : hi - x] == others[lo - at : hi - at], self.size) if hi - lo >= self.size else ():
                    own[lo - x + start : lo - x + end] = True
            if not own.any():
                continue
            a, b = self.windows.words(item, y, n), docs.words(doc, x, n)
            equal = _runs(words == docs.word[x : x + n], self.size) if uncut else []
            equal = [k for k in equal if a[k[0] : k[1]] == b[k[0] : k[1]]]
            if equal:  # a verbatim part; its values tell nothing of those of a restated one
                cuts = list(zip([0, *(e for _, e in equal)], [*(s for s, _ in equal), n], strict=True)) if n >= least else []
            else:
                values = slots.setdefault(item, _Slots())
                cuts = values.consistent(a, b, self.size)
            if equal or cuts != [(0, n)]:
                for start, end in cuts:
                    k = one if equal or one > n else end - start  # beside a verbatim part the stretch stays one piece
                    if end - start >= self.size and k >= least:
                        heapq.heappush(waiting, (-k, False, x + start, y + start, item, end - start, least))
                if not equal:
                    continue
            for start, end in [(0, n)] if np.count_nonzero(own) * 2 >= n else _runs(own, self.size):
                part = held[start:end]
                part[part == 0] = one
                given[x + start, words[start:end].tobytes()] = x + start, words[start:end]
                if not equal:
                    places.setdefault(item, set()).update(range(y + start, y + end))
                    values.keep(a[start:end], b[start:end])
        for item, at in places.items():
            yield item, len(at)


def _runs(flags: np.ndarray, size: int) -> list[tuple[int, int]]:
    """(start, end) of the runs of at least ``size`` true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))).tolist()
    return [(s, e) for s, e in zip(edges[::2], edges[1::2], strict=True) if e - s >= size]


def _passages(x: np.ndarray, same: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each stretch, how many different passages of the items are as long or longer, at its window where fewest are.

    ``x`` and ``same`` are the document's place and the hash of the item's words by hit, ``first`` the first hit of each stretch.
    """
    many = np.diff(np.concatenate([first, [len(x)]]))
    within = np.arange(len(x)) - np.repeat(first, many)
    start, words = x[first], np.add.reduceat(same * (2 * within + 1).astype(np.uint64), first)
    order = np.lexsort((words, many, start))
    start, long, words = start[order], many[order], words[order]
    passage = np.empty(len(first), dtype=np.int64)
    passage[order] = np.cumsum(np.concatenate([[True], (start[1:] != start[:-1]) | (long[1:] != long[:-1]) | (words[1:] != words[:-1])]))
    long, passage = np.repeat(many, many), np.repeat(passage, many)
    by_window = np.lexsort((passage, -long, x))
    xs, ls, ps = x[by_window], long[by_window], passage[by_window]
    nth = np.cumsum(np.concatenate([[True], (xs[1:] != xs[:-1]) | (ps[1:] != ps[:-1])]))
    last = np.flatnonzero(np.concatenate([(xs[1:] != xs[:-1]) | (ls[1:] != ls[:-1]), [True]]))
    upto = nth[last] - nth[np.searchsorted(xs, xs[last], side="left")] + 1
    rivals = np.empty(len(x), dtype=np.int64)
    rivals[by_window] = np.repeat(upto, np.diff(np.concatenate([[-1], last])))
    return np.minimum.reduceat(rivals, first)


def _least_length(passages: np.ndarray) -> np.ndarray:
    """Words that a restated stretch must have which stands for so many passages."""
    return np.where(passages > SHARED, np.ceil(LEAST + CHANCE * np.log2(np.maximum(passages, SHARED) / SHARED)), 0).astype(np.int64)


@lru_cache(KEPT)
def _one_to_one(word: str) -> bool:
    return not (_NUMBER.match(word) or word in NUMBER_WORDS or word in UNITS)


class _Slots:
    """Values of an item's slots in a document: names map one to one, numbers and units to one value each."""

    def __init__(self) -> None:
        self.there: dict[str, str] = {}
        self.back: dict[str, str] = {}
        self.new: list[tuple[dict[str, str], str]] = []

    def take(self, a: str, b: str) -> bool:
        """Whether the value goes with those taken before; it is then taken too."""
        if self.there.get(a, b) != b:
            return False
        one_to_one = _one_to_one(a)
        if one_to_one and self.back.get(b, a) != a:
            return False
        for values, key, value in ((self.there, a, b), (self.back, b, a)):
            if key not in values and (one_to_one or values is self.there):
                values[key] = value
                self.new.append((values, key))
        return True

    def close(self, keep: bool) -> None:
        """End a stretch; without ``keep`` its new values are forgotten."""
        if not keep:
            for values, key in self.new:
                del values[key]
        self.new = []

    def keep(self, a: list[str], b: list[str]) -> None:
        for p, q in zip(a, b, strict=True):
            self.take(p, q)
        self.close(True)

    def consistent(self, a: list[str], b: list[str], size: int) -> list[tuple[int, int]]:
        """(start, end) of the longest parts of at least ``size`` words whose values go with one another and with those kept; they may overlap."""
        out, start = [], 0
        there: dict[str, tuple[str, int]] = {}
        back: dict[str, tuple[str, int]] = {}
        for k, (p, q) in enumerate(zip(a, b, strict=True)):
            one_to_one = _one_to_one(p)
            if self.there.get(p, q) != q or (one_to_one and self.back.get(q, p) != p):
                begin = k + 1
            else:  # behind the last word that word k does not go with
                value, at = there.get(p, (q, k))
                begin = at + 1 if value != q else 0
                if one_to_one:
                    value, at = back.get(q, (p, k))
                    begin = max(begin, at + 1) if value != p else begin
                    back[q] = p, k
                there[p] = q, k
            if begin > start:
                if k - start >= size:
                    out.append((start, k))
                start = begin
        return [*out, (start, len(a))] if len(a) - start >= size else out


def _indexes(items: DataFrame, size: int, words: int) -> list[Index]:
    """Items in blocks of some ``words``, an item's rows in one block."""
    held = items.filter(F.length("prompt") > 0).select(F.col("item_id").cast("long").alias("item_id"), "prompt").distinct()
    rows = [(r[0], r[1]) for r in held.orderBy("item_id").toLocalIterator()]
    templates = Templates.of([t for _, t in rows])
    blocks: list[list[tuple[int, str]]] = []
    n = words
    for k, (i, t) in enumerate(rows):
        if n >= words and (k == 0 or rows[k - 1][0] != i):
            blocks.append([])
            n = 0
        blocks[-1].append((i, t))
        n += len(_WORD.findall(t))
    return [Index([i for i, _ in b], [t for _, t in b], templates, size) for b in blocks]


def _over_documents(docs: DataFrame, indexes: list[Index], size: int, schema: str, find) -> DataFrame:
    """Rows that ``find`` (documents' windows, index) gives, (document's place, ...) for each document; one narrow pass a block of items."""
    spark, out = docs.sparkSession, None
    names = [c.split()[0] for c in schema.split(", ")]
    for index in indexes:
        carried = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pd.DataFrame], carried=carried) -> Iterator[pd.DataFrame]:
            held = carried.value
            for b in batches:
                ids = b["doc_id"].to_numpy()
                rows = [(ids[r[0]], *r[1:]) for r in find(_Windows(b["text"].tolist(), held.vocabulary, size), held)]
                if rows:
                    yield pd.DataFrame(rows, columns=names)

        got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, schema)
        out = got if out is None else out.unionByName(got)
    return spark.createDataFrame([], schema) if out is None else out.distinct()


def leaks(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, item_id) of documents and items with a stretch of at least ``size`` words whose template and slots are equal."""
    return _over_documents(docs, _indexes(items, size, BLOCK_WORDS), size, "doc_id long, item_id long", lambda w, index: index.verbatim(w))


def restated(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, verbatim, n_words): re-parameterised copies, whether the document also holds a verbatim passage of the item, and the words of the item covered."""

    def find(w: _Windows, index: Index) -> Iterator[tuple[int, int, bool, int]]:
        whole = index.verbatim(w)
        for doc, item, n in index.restated(w):
            yield doc, item, (doc, item) in whole, n

    indexes = _indexes(items, size, MOST_WORDS)
    if len(indexes) > 1:
        raise ValueError(f"restatements are compared among all items, which have more than {MOST_WORDS} words")
    return _over_documents(docs, indexes, size, "doc_id long, item_id long, verbatim boolean, n_words long", find)


def leaked_items(found: DataFrame, items: DataFrame) -> DataFrame:
    """Per item the number of documents it leaked into, items without a leak included."""
    return items.select("item_id", "problem_id").join(found, "item_id", "left").groupBy("item_id", "problem_id").agg(F.count("doc_id").alias("n_docs"))


# --- the same answer in SQL, without templates: every document's windows against every item's
_SQL_WINDOWS = """
  SELECT {key}, list_aggregate(list_slice(w, i, i + 12), 'string_agg', ' ') AS win
  FROM (SELECT {key}, w, unnest(range(1, len(w) - 11)) AS i
        FROM (SELECT {key}, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+') AS w FROM {table}) WHERE len(w) >= 13)
"""
P7_SQL = f"""
WITH d AS ({_SQL_WINDOWS.format(key="doc_id", text="text", table="documents")}),
     b AS ({_SQL_WINDOWS.format(key="item_id", text="prompt", table="benchmark_problems")})
SELECT DISTINCT d.doc_id, b.item_id FROM d JOIN b USING (win)
"""
P7_ITEMS_SQL = f"""
WITH f AS ({P7_SQL})
SELECT p.item_id, p.problem_id, count(f.doc_id) AS n_docs
FROM benchmark_problems p LEFT JOIN f ON p.item_id = f.item_id GROUP BY 1, 2
"""
