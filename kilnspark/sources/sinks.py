"""Writers: Spark's commit protocol makes each of them atomic."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnspark.functions import text as T
from kilnspark.session import ensure_checkpoint_dir
from kilnspark.sources.files import path_exists


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> str:
    """JSON lines, nulls left out."""
    df.write.mode("append" if append else "overwrite").json(path)
    return path


def append_safely(df: DataFrame, path: str, log: Callable[[str], None] = print) -> bool:
    """Append rows; a failure is logged and never stops the caller."""
    try:
        write_jsonl(df, path, append=True)
        return True
    except Exception as e:  # noqa: BLE001
        log(f"append to {path} failed: {e}")
        return False


def record_results(df: DataFrame, path: str) -> str:
    """Append keyed results to a table instead of rewriting all results after each key."""
    df.write.mode("append").parquet(path)
    return path


def remaining(todo: DataFrame, path: str, key: str) -> DataFrame:
    """Keys without a recorded result: what a restarted run still has to do."""
    spark = todo.sparkSession
    return todo.join(spark.read.parquet(path).select(key), key, "left_anti") if path_exists(spark, path) else todo


def stage_cache(name: str, make: Callable[[], DataFrame], df: DataFrame, version: str) -> DataFrame:
    """A stage's table, made once and named by the stage and its version; later calls read it."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/stage-{name}-{version}"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_texts(df: DataFrame, key: str, text: str, path: str) -> str:
    """One folder per key with its text, trimmed and ended by a line end; for as many keys as a file system likes."""
    df.select(F.col(key), T.strip(F.col(text)).alias("value")).repartition(F.col(key)).write.mode("overwrite").partitionBy(key).text(path)
    return path


def summary_text(rows: list[dict], title: str) -> str:
    """A fixed-format report of the few rows of a finished aggregate."""
    if not rows:
        return f"{title}\n(no rows)\n"
    names = list(rows[0])
    cell = lambda v: f"{v:.2f}" if isinstance(v, float) else "-" if v is None else str(v)
    width = {n: max(len(n), *(len(cell(r[n])) for r in rows)) for n in names}
    line = lambda vs: "  ".join(v.ljust(width[n]) for n, v in zip(names, vs, strict=True)).rstrip()
    return "\n".join([title, line(names), *(line([cell(r[n]) for n in names]) for r in rows)]) + "\n"


def event_frame(payload: Column) -> Column:
    """A server-sent event of a struct."""
    return F.concat(F.lit("data: "), F.to_json(payload), F.lit("\n\n"))


def parse_frame(frame: str) -> dict:
    return json.loads(frame.removeprefix("data: "))
