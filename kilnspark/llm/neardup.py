"""All pairs of texts whose sets of word shingles are similar: an exact set-similarity join.

Pivots and Voronoi regions were measured first and replicate nearly every text
to nearly every region (README), because texts of different origin are almost
equally far from all pivots.  So the regions here are those of single rare
shingles: under one order of all shingles two sets with Jaccard similarity of
at least t share one of the first n - ceil(t n) + 1 shingles of each, and at
least as many of these as the bound in :func:`least_shared` tells.  Texts meet in
the regions of these shingles only, whole regions are joined in blocks with the
length window 1/t, and the pairs that pass the bound are verified on the texts.

The order puts shingles that are frequent in the corpus last (heavy hitters,
counted over all rows), the rest by hash; it decides the cost, never the result.
Equal sets are one set: copies are joined once and expanded at the end.

Defined results: null, blank and short texts (fewer words than a shingle) form
no pair; redelivered rows count once; similarity is compared in integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnspark.session import cut, spread

CHUNK = 1 << 20  # characters hashed at once
HEAVY_PER_TASK = 1 << 18  # heavy hitters a task reports
HEAVY = 1 << 19  # heavy hitters kept for the order
REGIONS = 16  # regions at least, however small the input
GROUP = 64  # pairs that meet in one place of a split family
BLOCK = 1 << 21  # pairs expanded at once
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789_", dtype=np.uint8)] = True
DOC = np.dtype([("id", "<i8"), ("digest", "<u8"), ("n", "<u4"), ("home", "u1")])
_BASE = 0x9E3779B97F4A7C15 | 1


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray | None]:
    """For each text the sorted distinct hashes of its word shingles; None if it has fewer words.

    Words are the runs of [a-z0-9_] in the lower-cased text.  All texts of a
    chunk are cut and hashed together by array operations.
    """
    out: list[np.ndarray | None] = [None] * len(texts)
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (chars < CHUNK or end == at):
            chars += len(texts[end] or "")
            end += 1
        _shingle_chunk([t or "" for t in texts[at:end]], size, at, out)
        at = end
    return out


def _shingle_chunk(texts: list[str], size: int, base: int, out: list[np.ndarray | None]) -> None:
    parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    inside = _IS_WORD[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return
    # hash of a word: sum of byte * base ** (place in the word), by prefix sums over the chunk
    power, inverse = _powers(1 << max(CHUNK.bit_length(), int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(data * power[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    h ^= h >> np.uint64(32)
    h *= _MIX[1]
    h ^= h >> np.uint64(29)
    first = np.searchsorted(starts, np.cumsum([0] + [len(p) + 1 for p in parts]))  # each text's first word
    n = len(h) - size + 1
    if n <= 0:
        return
    acc = h[:n] * _MIX[0]
    for k in range(1, size):
        acc ^= acc >> np.uint64(31)
        acc = (acc + h[k : k + n]) * _MIX[k % 3]
    acc ^= acc >> np.uint64(29)
    for i, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if hi - lo >= size:
            s = np.sort(acc[lo : hi - size + 1])
            out[base + i] = s[np.concatenate([[True], s[1:] != s[:-1]])]


def prefix_size(n, num: int, den: int):
    return n - (num * n + den - 1) // den + 1


def least_shared(n, m, num: int, den: int):
    """How many of the first shingles of two similar sets must be common.

    Similar sets have ceil(t (n + m) / (1 + t)) shingles in common, and past the
    earlier of the two prefix ends at most the larger rest of both.
    """
    need = (num * (n + m) + num + den - 1) // (num + den)
    return np.maximum(1, need - np.maximum(n - prefix_size(n, num, den), m - prefix_size(m, num, den)))


def heavy_hitters(texts: DataFrame, size: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the most frequent shingles over all rows; at most ``HEAVY`` reach the driver.

    Shingles are counted in ``parts`` partitions by hash, and each gives its share of the table, so no
    task merges the others' tables, however many there are.
    """

    def top(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(h) > HEAVY_PER_TASK:
            keep = np.argpartition(c, len(c) - HEAVY_PER_TASK)[-HEAVY_PER_TASK:]
            h, c = h[keep], c[keep]
        return h, c

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            sets = [s for s in shingle_sets(b["text"].tolist(), size) if s is not None]
            if not sets:
                continue
            h, c = np.unique(np.concatenate(sets), return_counts=True)
            often = c > 1
            both = np.concatenate([held, h[often]])
            held, back = np.unique(both, return_inverse=True)
            counts = np.bincount(back, weights=np.concatenate([counts, c[often]])).astype(np.int64)
            if len(held) > 4 * HEAVY_PER_TASK:
                held, counts = top(held, counts)
                order = np.argsort(held)
                held, counts = held[order], counts[order]
        held, counts = top(held, counts)
        yield pd.DataFrame({"h": held.view(np.int64), "c": counts})

    local = texts.select("text").mapInPandas(run, "h long, c long")
    share = max(1, HEAVY // parts)

    def most(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h, c = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            h, c = np.concatenate([h, b["h"].to_numpy()]), np.concatenate([c, b["c"].to_numpy()])
            if len(h) > share:
                keep = np.lexsort((h, -c))[:share]
                h, c = h[keep], c[keep]
        yield pd.DataFrame({"h": h, "c": c})

    counted = local.repartition(parts, "h").groupBy("h").agg(F.sum("c").alias("c"))
    got = counted.mapInPandas(most, "h long, c long").toArrow()
    h, c = got["h"].to_numpy().astype(np.int64).view(np.uint64), got["c"].to_numpy().astype(np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def _places(texts: DataFrame, parts: int) -> list[int]:
    """For each of ``parts`` partitions a number that hash partitioning puts there, so that each region gets a partition of its own."""
    n = parts * (8 + parts.bit_length() * 4)
    spark = texts.sparkSession
    at = spark.range(n).select(F.col("id").cast("int").alias("k")).select("k", F.pmod(F.hash("k"), F.lit(parts)).alias("p")).groupBy("p").agg(F.min("k").alias("k")).collect()
    found = {r["p"]: r["k"] for r in at}
    return [found.get(p, p) for p in range(parts)]


def _postings(texts: DataFrame, size: int, num: int, den: int, heavy: tuple[np.ndarray, np.ndarray], regions: int) -> DataFrame:
    """Prefix shingles packed by region: (place, region, docs, hashes, owners), a row per input batch and region.

    Of a shingle 32 bits besides its region travel: what meets by chance only adds to the pairs that are verified.
    Of the equal sets of a batch only that with the least id is posted, so that many copies post no more than one
    set a batch; the others go to the home of the set, the region of its first shingle, by their ids alone.
    """
    places = _places(texts, regions)
    hot = texts.sparkSession.sparkContext.broadcast(heavy)  # at most HEAVY entries, 8 MB

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hh, hc = hot.value
        for b in batches:
            docs, firsts = [], []
            for i, s in zip(b["id"].tolist(), shingle_sets(b["text"].tolist(), size), strict=True):
                if s is None:
                    continue
                n = len(s)
                if len(hh):
                    at = np.minimum(np.searchsorted(hh, s), len(hh) - 1)
                    often = np.where(hh[at] == s, hc[at], 0)
                    first = s[np.argsort(often, kind="stable")[: prefix_size(n, num, den)]]
                else:
                    first = s[: prefix_size(n, num, den)]
                firsts.append(first)
                docs.append((i, xxhash.xxh3_64_intdigest(s.tobytes()), n, 0))
            if not docs:
                continue
            table = np.array(docs, dtype=DOC)
            order = np.lexsort((table["id"], table["n"], table["digest"]))
            same = np.concatenate([[False], (table["digest"][order][1:] == table["digest"][order][:-1]) & (table["n"][order][1:] == table["n"][order][:-1])])
            posted, copies = np.sort(order[~same]), np.sort(order[same])
            home = (np.array([f[0] for f in firsts], dtype=np.uint64) % np.uint64(regions)).astype(np.int64)
            h = np.concatenate([firsts[k] for k in posted.tolist()])
            o = np.repeat(posted, [len(firsts[k]) for k in posted.tolist()])
            region = (h % np.uint64(regions)).astype(np.int64)
            order = np.argsort(region, kind="stable")
            h, o, region = (h[order] >> np.uint64(32)).astype(np.uint32), o[order], region[order]
            ends = np.searchsorted(region, np.arange(regions + 1))
            out = []
            for r in range(regions):
                lo, hi = ends[r], ends[r + 1]
                if lo < hi:  # the home of a copy has its set's posting, too
                    used, local = np.unique(np.concatenate([o[lo:hi], copies[home[copies] == r]]), return_inverse=True)
                    held = table[used]
                    held["home"] = home[used] == r
                    out.append((places[r], r, held.tobytes(), h[lo:hi].tobytes(), local[: hi - lo].astype(np.uint16 if len(used) < 65536 else np.uint32).tobytes()))
            yield pd.DataFrame(out, columns=["place", "region", "docs", "hashes", "owners"])

    return texts.select("id", "text").mapInPandas(run, "place int, region int, docs binary, hashes binary, owners binary")


def _meetings(postings: DataFrame, num: int, den: int, regions: int) -> DataFrame:
    """(a, b, shared, na, nb): sets that meet in a region, and (a, b, 0, n, n) for a copy b of a."""

    def pairs_of(h: np.ndarray, doc: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (i, j, i's set no larger) that share a shingle and pass the length window."""
        n = size[doc]
        order = np.lexsort((doc, n, h))
        h, doc, n = h[order], doc[order], n[order]
        start = np.concatenate([[True], h[1:] != h[:-1]])
        run = np.cumsum(start)
        span = int(n.max()) + 2
        place = run * span + n
        hi = np.searchsorted(place, run * span + np.minimum(n * den // num, span - 1), side="right")
        many = hi - np.arange(len(h)) - 1
        sel = np.flatnonzero(many > 0)
        many = many[sel]
        upto = np.cumsum(many)
        at = 0
        while at < len(sel):
            base = upto[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(upto, base + BLOCK, side="right")))
            m = many[at:end]
            left = np.repeat(sel[at:end], m)
            right = left + 1 + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            yield doc[left], doc[right]
            at = end

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables, hashes, owners, base = [], [], [], 0
        for b in batches:
            for r, d, h, o in zip(b["region"].tolist(), b["docs"], b["hashes"], b["owners"], strict=True):
                t, hh = np.frombuffer(d, dtype=DOC), np.frombuffer(h, dtype=np.uint32)
                tables.append(t)
                hashes.append(hh.astype(np.int64) * regions + r)
                owners.append(np.frombuffer(o, dtype=np.uint16 if len(o) == 2 * len(hh) else np.uint32).astype(np.int64) + base)
                base += len(t)
        if not tables:
            return
        docs = np.concatenate(tables)
        # equal sets have equal prefixes, so each region sees all of them and picks the same one, that with the least id
        ids, size_of = docs["id"].astype(np.int64), docs["n"].astype(np.int64)
        order = np.lexsort((ids, size_of, docs["digest"]))
        digest = docs["digest"][order]
        new = np.concatenate([[True], (digest[1:] != digest[:-1]) | (size_of[order][1:] != size_of[order][:-1])])
        group = np.cumsum(new) - 1
        rep_id, size = ids[order][new], size_of[order][new]
        group_of = np.empty(len(docs), dtype=np.int64)
        group_of[order] = group
        copies = np.unique(np.stack([rep_id[group], ids[order]], 1)[(docs["home"][order] > 0) & (rep_id[group] != ids[order])], axis=0)
        if len(copies):
            yield pd.DataFrame({"a": copies[:, 0], "b": copies[:, 1], "shared": 0, "na": 0, "nb": 0})
        h, g = np.concatenate(hashes), group_of[np.concatenate(owners)]
        del hashes, owners, tables, docs
        order = np.lexsort((g, h))
        h, g = h[order], g[order]
        keep = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
        h, g = h[keep], g[keep]
        count = len(size)
        for i, j in pairs_of(h, g, size):
            code, c = np.unique(i * count + j, return_counts=True)
            i, j = code // count, code % count
            swap = rep_id[i] > rep_id[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            yield pd.DataFrame({"a": rep_id[i], "b": rep_id[j], "shared": c, "na": size[i], "nb": size[j]})

    return postings.mapInPandas(run, "a long, b long, shared long, na long, nb long")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, num: int, den: int, parts: int) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough.

    The texts of a pair come together at a meeting place.  That is the least
    partner both have, so that a family of texts meets in one place and each
    text travels once; pairs without such a partner meet at their first id, and
    so do those of a large family, there split into groups of some ``GROUP`` pairs.
    """
    lead = pairs.groupBy("b").agg(F.min("a").alias("lead"))
    named = (
        pairs.join(lead, "b")
        .join(lead.select(F.col("b").alias("a"), F.col("lead").alias("lead_a")), "a", "left")
        .select("a", "b", F.when(F.coalesce("lead_a", "a") == F.col("lead"), F.col("lead")).alias("family"))
    )
    many = named.groupBy("family").agg(F.count("*").alias("n")).filter((F.col("n") > 32 * GROUP) | F.col("family").isNull())
    by_a = pairs.groupBy("a").agg(F.count("*").alias("deg"))
    large = many.select("family", F.lit(True).alias("large"))
    at = named.join(large, "family", "left").join(by_a, "a")
    alone = F.col("family").isNull() | F.col("large")
    part = F.pmod(F.xxhash64("b"), F.ceil(F.col("deg") / GROUP)).cast("int") + 1
    placed = at.select("a", "b", F.when(alone, F.col("a")).otherwise(F.col("family")).alias("key"), F.when(alone, part).otherwise(F.lit(0)).alias("part"))
    wanted = placed.select(F.col("a").alias("id"), "key", "part").unionByName(placed.select(F.col("b").alias("id"), "key", "part")).distinct()
    rows = texts.join(wanted, "id").select("key", "part", F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), "text")
    both = rows.unionByName(placed.select("key", "part", "a", "b", F.lit(None).cast("string").alias("text")))
    met = both.repartition(parts, "key", "part").sortWithinPartitions("key", "part")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: tuple | None = None
        sets: dict[int, np.ndarray] = {}
        todo: list[tuple[int, int]] = []

        def judged() -> Iterator[tuple[int, int]]:
            for i, j in todo:
                x, y = sets[i], sets[j]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if den * both >= num * (len(x) + len(y) - both):
                    yield i, j

        for b in batches:
            out: list[tuple[int, int]] = []
            made = shingle_sets(b["text"].tolist(), size)
            for key, part, i, j, s in zip(b["key"].tolist(), b["part"].tolist(), b["a"].tolist(), b["b"].tolist(), made, strict=True):
                if (key, part) != at:
                    out += judged()
                    at, sets, todo = (key, part), {}, []
                if s is None:
                    todo.append((i, j))
                else:
                    sets[i] = s
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)
        yield pd.DataFrame(list(judged()), columns=["a", "b"], dtype=np.int64)

    # a redelivered row brings its text a second time, which changes nothing
    return met.mapInPandas(run, "a long, b long")


def _candidates(texts: DataFrame, size: int, num: int, den: int, parts: int) -> DataFrame:
    """Pairs that share enough of their first shingles, and copies; written once."""
    heavy = heavy_hitters(texts, size, parts)
    postings = _postings(texts, size, num, den, heavy, parts).repartition(parts, "place")
    met = _meetings(postings, num, den, parts).groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    n, m = F.col("na"), F.col("nb")
    rest = lambda c: F.floor((num * c + den - 1) / den) - 1  # noqa: E731  n - prefix_size(n)
    need = F.floor((num * (n + m) + num + den - 1) / (num + den)) - F.greatest(rest(n), rest(m))
    return cut(met.filter((n == 0) | (F.col("shared") >= F.greatest(F.lit(1), need))))


def similar_pairs(texts: DataFrame, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(pairs between distinct sets, copies): pairs (a, b) of similarity >= num/den, and copies (a, b) with b a copy of a.

    ``texts`` has columns id (long) and text.
    """
    texts = spread(texts.filter(F.length("text") > 0))
    parts = max(REGIONS, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), texts.rdd.getNumPartitions())
    met = _candidates(texts, size, num, den, parts)
    copies = met.filter("na = 0").select("a", "b")
    return cut(_verified(met.filter("na > 0").select("a", "b"), texts, size, num, den, parts)), copies


def expanded_pairs(pairs: DataFrame, copies: DataFrame) -> DataFrame:
    """All pairs (a < b) of ids: those between sets with their copies, and those among copies."""
    reps = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).unionByName(copies.select(F.col("a").alias("rep"))).distinct()
    member = copies.select(F.col("a").alias("rep"), F.col("b").alias("id")).unionByName(reps.select("rep", F.col("rep").alias("id")))
    ma, mb = member.select(F.col("rep").alias("a"), F.col("id").alias("ia")), member.select(F.col("rep").alias("b"), F.col("id").alias("ib"))
    across = pairs.join(ma, "a").join(mb, "b").select(F.least("ia", "ib").alias("module_id_a"), F.greatest("ia", "ib").alias("module_id_b"))
    held = copies.select(F.col("a").alias("rep")).distinct()
    twin = member.join(held, "rep", "left_semi")
    within = twin.select("rep", F.col("id").alias("module_id_a")).join(twin.select("rep", F.col("id").alias("module_id_b")), "rep").filter("module_id_a < module_id_b")
    return across.unionByName(within.select("module_id_a", "module_id_b"))


def near_duplicates(modules: DataFrame, size: int = 3, num: int = 7, den: int = 10) -> DataFrame:
    """(module_id_a, module_id_b), a < b, of all texts with similarity of at least num/den."""
    texts = modules.select(F.col("module_id").alias("id"), F.col("verilog").alias("text"))
    return expanded_pairs(*similar_pairs(texts, size, num, den))


def link_counts(modules: DataFrame, size: int = 3, num: int = 7, den: int = 10) -> DataFrame:
    """One row per module: its set's first id, its links to other sets and its copies, nothing expanded; without a near-duplicate its own id and zeros."""
    texts = modules.select(F.col("module_id").alias("id"), F.col("verilog").alias("text"))
    pairs, copies = similar_pairs(texts, size, num, den)
    ends = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_links"))
    same = copies.groupBy(F.col("a").alias("rep")).agg(F.count("*").alias("n_copies"))
    per_set = ends.join(same, "rep", "full").select("rep", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(0)).alias("n_copies"))
    member = copies.select(F.col("a").alias("rep"), F.col("b").alias("module_id")).unionByName(per_set.select("rep", F.col("rep").alias("module_id")))
    linked = member.join(per_set, "rep").select("module_id", F.col("rep").alias("class_id"), "n_links", "n_copies")
    zero = F.lit(0).cast("long")
    return (
        modules.select("module_id")
        .distinct()
        .join(linked, "module_id", "left")
        .select("module_id", F.coalesce("class_id", "module_id").alias("class_id"), F.coalesce("n_links", zero).alias("n_links"), F.coalesce("n_copies", zero).alias("n_copies"))
    )
