"""Operators that depend on the order of a key's rows.

A key may hold a large share of all rows, so no operator here sorts or collects
a key's rows in one task.  Rows are put into pieces by ranges of (key, order);
windows run inside a piece of a key, and what a piece needs from the pieces
before it, a few values, comes from a table of one row per key and piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnspark.functions import text as T
from kilnspark.session import cut

PIECE = "_piece"


def pieces(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows with the number of their range of (keys, order).  Written once: ranges are drawn from a sample, and all that follows must see the same ones."""
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cut(df.repartitionByRange(n, *keys, *order).withColumn(PIECE, F.spark_partition_id()))


def _latest(values: Column, k: int) -> Column:
    """The last k elements of an array."""
    return F.slice(values, F.greatest(F.size(values) - k + 1, F.lit(1)), k)


def with_last_k(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, k: int = 3) -> DataFrame:
    """Adds the values of the ``k`` rows of the key before each row, oldest first; nulls are no values."""
    d = pieces(df, keys, order)
    inside = Window.partitionBy(*keys, PIECE).orderBy(*order)
    end = Window.partitionBy(*keys, PIECE).orderBy(*[F.col(c).desc() for c in order])
    local = d.withColumn(out, F.collect_list(F.struct(F.lit(1).alias("row"), F.col(value).alias("v"))).over(inside.rowsBetween(-k, -1)))
    tails = d.withColumn("_n", F.row_number().over(end)).filter(F.col("_n") <= k)
    tail = tails.groupBy(*keys, PIECE).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v")))), lambda s: F.struct(F.lit(1).alias("row"), s["v"].alias("v"))).alias("_tail"))
    # the last k rows before a piece lie in the last k pieces of the key
    before = tail.withColumn("_carry", _latest(F.flatten(F.collect_list("_tail").over(Window.partitionBy(*keys).orderBy(PIECE).rowsBetween(-k, -1))), k)).drop("_tail")
    joined = _join(local, before, keys)
    rows = _latest(F.concat(F.coalesce("_carry", F.array().cast(joined.schema[out].dataType)), out), k)
    return joined.withColumn(out, F.filter(F.transform(rows, lambda s: s["v"]), lambda v: v.isNotNull())).drop("_carry", PIECE)


def with_best_so_far(df: DataFrame, keys: list[str], order: list[str], value: str, ok: str, out: str) -> DataFrame:
    """Adds the key's last value so far that was accepted and is not null, null before the first."""
    d = pieces(df, keys, order).withColumn("_v", F.when(F.col(ok), F.col(value)))
    inside = Window.partitionBy(*keys, PIECE).orderBy(*order)
    local = d.withColumn(out, F.last("_v", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    tail = d.filter(F.col("_v").isNotNull()).groupBy(*keys, PIECE).agg(F.max_by("_v", F.struct(*order)).alias("_tail"))
    every = _join(d.select(*keys, PIECE).distinct(), tail, keys)
    before = every.withColumn("_carry", F.last("_tail", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1))).drop("_tail")
    return _join(local, before, keys).withColumn(out, F.coalesce(out, "_carry")).drop("_carry", "_v", PIECE)


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys, nulls equal, and the piece."""
    cols = [*keys, PIECE]
    r = right.select(*[F.col(c).alias(f"_r{k}") for k, c in enumerate(cols)], *[c for c in right.columns if c not in cols])
    on = F.lit(True)
    for k, c in enumerate(cols):
        on = on & left[c].eqNullSafe(r[f"_r{k}"])
    return left.join(r, on, "left").drop(*[f"_r{k}" for k in range(len(cols))])


def first_oscillation(df: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """Of each key the first row whose text names the same cause as the row before it; at most one row a key."""
    told = with_last_k(df.filter(F.col(text).isNotNull()), keys, order, text, "_before", 1)
    fired = told.filter(T.same_cause(F.try_element_at("_before", F.lit(1)), F.col(text))).drop("_before")
    first = F.min_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order)).alias("_first")
    return fired.groupBy(*keys).agg(first).select(*keys, "_first.*")


def group_normalised(df: DataFrame, keys: list[str], reward: str, out: str) -> DataFrame:
    """Adds the deviation from the group's mean in units of its population deviation; 0 in a group that hardly deviates.

    Mean and deviation come from an aggregate; AQE splits a group that is too large for one task of the join.
    """
    stats = df.groupBy(*keys).agg(F.avg(reward).alias("_mean"), F.stddev_pop(reward).alias("_std"))
    on = F.lit(True)
    for k, c in enumerate(keys):
        stats = stats.withColumnRenamed(c, f"_r{k}")
        on = on & df[c].eqNullSafe(stats[f"_r{k}"])
    scaled = F.when(F.col("_std") > 1e-6, (F.col(reward) - F.col("_mean")) / (F.col("_std") + 1e-8)).otherwise(F.lit(0.0))
    return df.join(stats, on, "left").withColumn(out, scaled).drop("_mean", "_std", *[f"_r{k}" for k in range(len(keys))])


def first_success(df: DataFrame, key: str, step: str, ok: Column) -> DataFrame:
    return df.filter(ok).groupBy(key).agg(F.min(step).alias("first_step"))


def cumulative_solved(first: DataFrame, steps: DataFrame, step: str) -> DataFrame:
    """Keys solved up to each step; the window runs over the few steps, not over the keys."""
    per = first.groupBy(F.col("first_step").alias(step)).agg(F.count("*").alias("n_new"))
    every = steps.select(step).distinct().join(per, step, "left").fillna(0, ["n_new"])
    w = Window.orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    return every.withColumn("n_solved", F.sum("n_new").over(w))


def ordered_concat(df: DataFrame, keys: list[str], order: list[str], text: str, out: str, sep: str = "") -> DataFrame:
    """Per key its texts joined in order, nulls left out; pieces of a key are joined first, so its rows never meet in one task, only the joined texts do."""
    joined = lambda first, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*first, F.col(value).alias("v")))), lambda x: x["v"]), sep)
    parts = pieces(df, keys, order).groupBy(*keys, PIECE).agg(F.when(F.count(text) > 0, joined(order, text)).alias("_text"))
    return parts.groupBy(*keys).agg(joined([PIECE], "_text").alias(out))
