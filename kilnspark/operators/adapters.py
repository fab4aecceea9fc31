"""Models, judges and simulators as batch functions over a frame.

An adapter maps a pandas series of inputs to a series (or frame) of outputs.
Retries, time-outs and fallbacks belong to the adapter; a run replays recorded
answers by a join.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Batch = Callable[[pd.Series], pd.Series]


def with_retries(step: Callable[[str], str | None], tries: int = 3, wait: float = 1.0, fallback: str | None = None) -> Batch:
    """A batch function of a one-text function: failing texts are tried again after a doubling wait, then get the fallback."""

    def one(x: str | None) -> str | None:
        if x is None:
            return fallback
        for k in range(tries):
            try:
                return step(x)
            except Exception:  # noqa: BLE001
                if k + 1 < tries:
                    time.sleep(wait * 2**k)
        return fallback

    return lambda xs: xs.map(one)


def apply_batch(df: DataFrame, inp: Column, fn: Batch, out: str, kind: str = "string", fallback: object = None) -> DataFrame:
    """Adds ``out`` = fn(inp) a batch at a time; a batch that raises gets the fallback in all its rows."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b.pop("_in")
            try:
                y = fn(x)
            except Exception:  # noqa: BLE001
                y = pd.Series([fallback] * len(x), index=x.index)
            yield b.assign(**{out: y})

    return df.withColumn("_in", inp).mapInPandas(run, f"{fields}, `{out}` {kind}")


def apply_direct(df: DataFrame, inp: Column, fn: Batch) -> DataFrame:
    """Adds ``answer`` as a struct that holds the text under ``direct_text``, and ``ok``: whether there is one."""
    out = apply_batch(df, inp, fn, "_text")
    return out.withColumns({"answer": F.struct(F.col("_text").alias("direct_text")), "ok": F.col("_text").isNotNull()}).drop("_text")


def apply_steps(df: DataFrame, inp: Column, steps: dict[str, tuple[Callable[[str], str], str]], tries: int = 1) -> DataFrame:
    """Adds a struct (text, in_tok, out_tok, failed) for each named step, all steps in one pass.

    A step is a one-text function and the fallback that answers where it raises; tokens are words here.
    """
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    made = ", ".join(f"`{n}` struct<text:string,in_tok:bigint,out_tok:bigint,failed:boolean>" for n in steps)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b.pop("_in").fillna("")
            for name, (step, fallback) in steps.items():
                got = with_retries(step, tries, 0.0)(texts)
                said = got.where(got.notna(), fallback)
                count = lambda xs: xs.map(lambda t: len(t.split()))
                b[name] = [dict(text=t, in_tok=i, out_tok=o, failed=f) for t, i, o, f in zip(said, count(texts), count(said), got.isna(), strict=True)]
            yield b

    return df.withColumn("_in", inp).mapInPandas(run, f"{kept}, {made}")


def replay(df: DataFrame, recorded: DataFrame, key: str, answer: str, default: str = "") -> DataFrame:
    """Recorded answers in place of a model: a left join, the default where nothing was recorded."""
    got = recorded.select(key, answer).dropDuplicates([key])
    return df.join(got, key, "left").withColumn(answer, F.coalesce(answer, F.lit(default)))


_FACTORIES: dict[str, Callable[..., Batch]] = {}


def register(name: str, make: Callable[..., Batch]) -> None:
    _FACTORIES[name] = make


def create(name: str, **options: object) -> Batch:
    """A registered adapter, or one named ``package.module:function``."""
    if name not in _FACTORIES and ":" in name:
        module, _, attr = name.partition(":")
        return getattr(importlib.import_module(module), attr)(**options)
    return _FACTORIES[name](**options)


def length_judge() -> Batch:
    """A stand-in for a judge: 1 to 5 by the number of words, null without a text."""
    return lambda xs: xs.map(lambda t: None if t is None or not t.strip() else min(5, 1 + len(t.split()) // 12))


def headline_writer() -> Batch:
    """A stand-in for a generator of descriptions: names the first module and its ports."""

    def one(t: str | None) -> str | None:
        if not t:
            return None
        name = t.partition("module ")[2].partition("(")[0].split()
        return f"Module {name[0]} with {t.count('input')} inputs and {t.count('output')} outputs." if name else None

    return lambda xs: xs.map(one)


register("length_judge", length_judge)
register("headline_writer", headline_writer)
