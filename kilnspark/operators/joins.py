"""Lookups and set-similarity joins."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from kilnspark.functions import text as T
from kilnspark.session import spread


def lookup(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left``, duplicates kept, that have a partner among the keys of ``right``; right keys are made unique."""
    return left.join(right.dropDuplicates([key]), key)


def cached_override(current: DataFrame, cache: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Rows that are in the cache, with the cache's values in place of their own."""
    return current.drop(*cols).join(cache.select(key, *cols).dropDuplicates([key]), key)


def not_done(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return todo.join(done.select(key), key, "left_anti")


def with_default(left: DataFrame, right: DataFrame, key: str, col: str, default: Column) -> DataFrame:
    got = right.select(key, col).dropDuplicates([key])
    return left.join(got, key, "left").withColumn(col, F.coalesce(col, default))


def first_by_priority(df: DataFrame, key: list[str], order: list[Column], filled: Column | None = None) -> DataFrame:
    """The first row of each key in the given order; with ``filled``, rows that don't fulfil it are passed over."""
    rows = df if filled is None else df.filter(filled)
    # an aggregate, so that a frequent key is reduced before the shuffle
    first = F.min_by(F.struct(*[c for c in df.columns if c not in key]), F.struct(*order)).alias("_first")
    return rows.groupBy(*key).agg(first).select(*key, "_first.*").select(*df.columns)


def overlay(base: DataFrame, winner: DataFrame, key: str, col: str) -> DataFrame:
    """``base`` with the winner's value wherever it has one."""
    w = winner.select(key, F.col(col).alias("_new")).dropDuplicates([key])
    return base.join(w, key, "left").withColumn(col, F.coalesce("_new", col)).drop("_new")


def pair_by_suffix(files: DataFrame, path: str, text: str, left: str, right: str) -> DataFrame:
    """(key, left text, right text) of files whose paths differ in their suffix only."""
    side = lambda suffix, name: files.filter(F.col(path).endswith(suffix)).select(
        F.expr(f"left({path}, length({path}) - {len(suffix)})").alias("key"), F.col(text).alias(name)
    )
    return side(left, "left_text").join(side(right, "right_text"), "key")


# Bounds of a right side that is carried to the executors; larger ones are joined.
CARRIED_TOKENS = 2_000_000  # postings, 16 MB
CARRIED_CHARS = 8_000_000  # of known texts in one automaton
PAIRS = 1 << 21  # (row, item) hits counted at once


def _postings(df: DataFrame, key: str, text: str, tag: str) -> DataFrame:
    """Postings of the token sets of distinct texts, named by the least key of each; equal texts meet by their digest."""
    sets = df.select(key, F.sha2(text, 256).alias("d"), T.tokens(F.col(text)).alias("t")).filter(F.size("t") > 0)
    uniq = sets.groupBy("d").agg(F.min_by(F.struct(F.col(key).alias("k"), "t"), key).alias("s"))
    return uniq.select(F.col("s.k").alias(f"{tag}_rep"), F.size("s.t").alias(f"n_{tag}"), F.explode("s.t").alias("tok"))


def _carried(right: DataFrame, rkey: str, rtext: str) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray] | None:
    """(tokens, ends of their postings, items, sizes) of the right side, None if it has more than ``CARRIED_TOKENS`` postings."""
    t = right.select(T.tokens(F.col(rtext)).alias("t")).filter(F.size("t") > 0).distinct()
    total = t.agg(F.sum(F.size("t")).alias("n")).first()["n"] or 0
    if total > CARRIED_TOKENS:
        return None
    lists = t.toArrow()["t"].combine_chunks()
    size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    flat = lists.flatten().dictionary_encode()
    flat = flat if isinstance(flat, pa.DictionaryArray) else flat.combine_chunks()
    code = flat.indices.to_numpy().astype(np.int64)
    items = np.repeat(np.arange(len(size)), size)[np.argsort(code, kind="stable")]
    ends = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(flat.dictionary)))]).astype(np.int64)
    return flat.dictionary, ends, items, size


def _best(tokens: pa.ListArray, held: tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The largest Jaccard similarity of each token set with any of the held ones."""
    words, ends, items, size = held
    n = len(tokens)
    best = np.zeros(n)
    length = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    code = pc.fill_null(pc.index_in(tokens.flatten(), value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(n), length)
    row, code = row[code >= 0], code[code >= 0]
    many = ends[code + 1] - ends[code]
    # blocks of whole rows, each of some PAIRS hits
    upto = np.concatenate([[0], np.cumsum(many)])
    first_of = np.searchsorted(row, np.arange(n + 1))
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(upto[first_of], upto[first_of[at]] + PAIRS, side="right")) - 1)
        lo, hi = first_of[at], first_of[end]
        m = many[lo:hi]
        if m.sum():
            place = np.repeat(ends[code[lo:hi]] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            pair, c = np.unique(np.repeat(row[lo:hi], m) * len(size) + items[place], return_counts=True)
            r, i = pair // len(size), pair % len(size)
            np.maximum.at(best, r, c / (length[r] + size[i] - c))
        at = end
    return best


def max_similarity(left: DataFrame, right: DataFrame, lkey: str, ltext: str, rkey: str, rtext: str, keep: Sequence[str] = ()) -> DataFrame:
    """Per left row the largest Jaccard similarity of its token set with any right row's, 0.0 where no token is shared; columns of ``keep`` stay.

    A right side of bounded size (checked) is carried to the executors as an
    inverted index, and one narrow pass counts the shared tokens; nothing is
    shuffled, and a frequent token costs no more than a rare one.  A larger
    right side is joined: see :func:`joined_similarity`.
    """
    held = _carried(right, rkey, rtext)
    if held is None:
        return joined_similarity(left, right, lkey, ltext, rkey, rtext, keep)
    carried = left.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = carried.value
        for b in batches:
            best = _best(b.column(b.num_columns - 1), index) if len(index[3]) else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(best)], names=[*b.schema.names[:-1], "max_similarity"])

    names = list(dict.fromkeys([lkey, *keep]))
    sets = spread(left.select(*names, F.col(ltext).alias("_t"))).select(*names, T.tokens(F.col("_t")).alias("_t"))
    schema = StructType([*sets.schema.fields[:-1], StructField("max_similarity", DoubleType())])
    return sets.mapInArrow(run, schema).withColumn("max_similarity", F.round("max_similarity", 6))


def joined_similarity(left: DataFrame, right: DataFrame, lkey: str, ltext: str, rkey: str, rtext: str, keep: Sequence[str] = (), salts: int = 16) -> DataFrame:
    """:func:`max_similarity` by an equi-join on tokens, for a right side of any size; left postings are salted, so that a frequent token is no hot key."""
    lp = _postings(left, lkey, ltext, "l").withColumn("salt", F.pmod(F.xxhash64("l_rep"), F.lit(salts)))
    rp = _postings(right, rkey, rtext, "r").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    shared = lp.join(rp, ["tok", "salt"]).groupBy("l_rep", "r_rep", "n_l", "n_r").agg(F.count("*").alias("c"))
    best = shared.groupBy("l_rep").agg(F.max(F.col("c") / (F.col("n_l") + F.col("n_r") - F.col("c"))).alias("s"))
    names = list(dict.fromkeys([lkey, *keep]))
    each = left.select(*names, F.sha2(ltext, 256).alias("_d"))
    rep_of = each.groupBy("_d").agg(F.min(lkey).alias("l_rep"))
    scored = rep_of.join(best, "l_rep").select("_d", "s")
    return each.join(scored, "_d", "left").select(*names, F.round(F.coalesce("s", F.lit(0.0)), 6).alias("max_similarity"))


def decontaminate(left: DataFrame, right: DataFrame, lkey: str, ltext: str, rkey: str, rtext: str, limit: float = 0.8, keep: Sequence[str] = ()) -> DataFrame:
    """Left rows less similar than ``limit`` to every right row; a similarity of exactly the limit is dropped."""
    return max_similarity(left, right, lkey, ltext, rkey, rtext, keep).filter(F.col("max_similarity") < limit)


def _blocks(known: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """(key, text) of the known texts in blocks of bounded size."""
    block, chars = [], 0
    for r in known.toLocalIterator():
        block.append((r[0], r[1]))
        chars += len(r[1])
        if chars > CARRIED_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def exact_then_contained(probe: DataFrame, known: DataFrame, pkey: str, ptext: str, kkey: str, ktext: str) -> DataFrame:
    """(probe key, known key, how): the known text equal to the probe, else the first (by key) that is contained in it.

    The known texts, a stated set, become automata of bounded size; each block of
    them takes one narrow pass over the probes, and several blocks meet by an
    aggregate of their few hits.  Null and empty texts match nothing.
    """
    sc = probe.sparkSession.sparkContext
    texts = spread(probe.filter(F.length(ptext) > 0).select(F.col(pkey).cast("long").alias("p"), F.col(ptext).alias("t")))
    distinct = known.filter(F.length(ktext) > 0).groupBy(ktext).agg(F.min(kkey).alias("k")).select("k", ktext)
    hits = None
    for block in _blocks(distinct):
        carried = sc.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], carried=carried) -> Iterator[pd.DataFrame]:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for k, t in carried.value:
                machine.add_word(t, (k, len(t)))
            machine.make_automaton()
            for b in batches:
                out = []
                for p, t in zip(b["p"].tolist(), b["t"].tolist(), strict=True):
                    found = {v for _, v in machine.iter(t)}
                    same = [k for k, n in found if n == len(t)]
                    if found:
                        out.append((p, not same, min(same or [k for k, _ in found])))
                yield pd.DataFrame(out, columns=["p", "inside", "k"])

        got = texts.mapInPandas(run, "p long, inside boolean, k long")
        hits = got if hits is None else hits.unionByName(got)
    if hits is None:
        return probe.sparkSession.createDataFrame([], f"{pkey} long, {kkey} long, how string")
    best = hits.groupBy("p").agg(F.min(F.struct("inside", "k")).alias("b"))
    return best.select(F.col("p").alias(pkey), F.col("b.k").alias(kkey), F.when(F.col("b.inside"), "contained").otherwise("exact").alias("how"))
