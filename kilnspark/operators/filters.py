"""Predicates of the curation funnel and validators run by batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnspark.functions import text as T


def in_size(c: Column, low: int = 50, high: int = 3000, word: str | None = "module") -> Column:
    """Strictly between the bounds, in code points, and holding the keyword."""
    ok = (F.length(c) > low) & (F.length(c) < high)
    return F.coalesce(ok & c.contains(word) if word else ok, F.lit(False))


def is_design(c: Column) -> Column:
    """No mark of simulation code; the rules are the tables in :mod:`kilnspark.functions.text`."""
    bad = T.contains_any(c, T.SIM_TASKS + T.SIM_HEADERS)
    for p in T.SIM_PATTERNS:
        bad = bad | c.rlike(p)
    return F.coalesce(~bad, F.lit(False))


def is_refusal(c: Column) -> Column:
    return F.coalesce(T.contains_any(F.lower(c), T.REFUSAL_MARKERS), F.lit(False))


def is_opaque(log: Column) -> Column:
    """A failure that names nothing: no mismatch, no assertion and no such words at all."""
    said = (F.size(T.mismatches(log)) > 0) | (F.size(T.context_lines(log)) > 0) | log.rlike(r"(?i)expected.*got|AssertionError")
    return F.coalesce(~said, F.lit(True))


def is_short_error(log: Column, least: int = 20) -> Column:
    """Nothing was parsed from the log and hardly anything is in it."""
    nothing = (F.size(T.mismatches(log)) == 0) & (F.size(T.failed_tests(log)) == 0)
    return F.coalesce(nothing & (F.length(T.strip(log)) < least), F.lit(True))


def harness_passed(code: Column, out: Column) -> Column:
    """Exit code 0, some tests passed, none failed."""
    return (code == 0) & F.coalesce(out.rlike(r"\d+ passed") & ~out.rlike(r"\d+ failed"), F.lit(False))


def harness_passed_strict(code: Column, out: Column, failures: Column) -> Column:
    """Exit code 0, no failure in the result files, and the word FAILED nowhere."""
    return (code == 0) & (F.coalesce(failures, F.lit(0)) == 0) & ~F.coalesce(out.contains("FAILED"), F.lit(False))


Validator = Callable[[pd.Series], pd.Series]


def validate(df: DataFrame, text: str, check: Validator | None, out: str = "valid", on_missing: str = "fail") -> DataFrame:
    """Adds what an external validator says of each text, a batch at a time.

    ``check`` maps a series of texts to booleans; without one (the tool is not
    installed) every row gets ``on_missing`` ('pass' or 'fail').  A validator
    that raises fails the rows of its batch, as a crash of the tool would.
    """
    if check is None:
        return df.withColumn(out, F.lit(on_missing == "pass"))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, `{out}` boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                ok = check(b[text]).fillna(False).astype(bool).to_numpy()
            except Exception:  # noqa: BLE001
                ok = [False] * len(b)
            yield b.assign(**{out: ok})

    return df.mapInPandas(run, schema)


def balanced_module(texts: pd.Series) -> pd.Series:
    """A stand-in for a compiler: a module is opened and closed, brackets are even."""
    t = texts.fillna("")
    even = t.str.count(r"\(") == t.str.count(r"\)")
    return t.str.contains(r"\bmodule\b") & t.str.contains(r"\bendmodule\b") & even


def words(texts: pd.Series) -> pd.Series:
    """A stand-in for a tokenizer: the number of runs of letters, digits and underscores."""
    return texts.str.count(r"\w+")


def within_tokens(df: DataFrame, rendered: Column, most: int, count: Callable[[pd.Series], pd.Series] = words, out: str = "n_tokens") -> DataFrame:
    """Rows whose rendered text has at most ``most`` tokens by the given tokenizer, with the number; rows that can't be rendered (null) or counted are dropped."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, `{out}` bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b.pop("_rendered")
            try:
                n = count(texts)
            except Exception:  # noqa: BLE001  one text may break a batch, so each gets its own turn
                n = pd.Series([_counted(count, t) for t in texts], index=texts.index, dtype="Int64")
            yield b.assign(**{out: n})[lambda x: x[out].notna()]

    return df.withColumn("_rendered", rendered).filter("_rendered is not null").mapInPandas(run, schema).filter(F.col(out) <= most)


def _counted(count: Callable[[pd.Series], pd.Series], text: str) -> int | None:
    try:
        return int(count(pd.Series([text])).iloc[0])
    except Exception:  # noqa: BLE001
        return None


def funnel(df: DataFrame, key: str, stages: dict[str, Column]) -> DataFrame:
    """Keys that are left after each stage, in one pass: a stage counts those that pass it and all before.

    Of each row only the number of stages it passes in a row is shuffled; a redelivered row counts once.
    """
    passed = F.lit(0)
    for ok in reversed(stages.values()):  # nested, so that each stage is looked at once, and only by rows that come so far
        passed = F.when(ok, passed + 1).otherwise(0)
    each = df.select(key, passed.alias("n")).distinct()
    cols = [F.struct(F.lit(i).alias("stage_no"), F.lit(name).alias("stage"), F.count_if(F.col("n") > i).alias("n_rows")) for i, name in enumerate(stages)]
    return each.agg(F.array(*cols).alias("s")).select(F.explode("s").alias("s")).select("s.*")
