"""Deterministic sampling, shuffling, mixing and splitting by hash order.

The order of a row is the digest of a seed and its key, so a sample does not
depend on partitioning, and a larger table keeps the order of its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_of(key: Column, seed: int = 42) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed).cast("string"), key.cast("string")))


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows, or all if there are fewer.  A top-n by hash: partial in each task, no full sort."""
    return df.orderBy(order_of(F.col(key), seed), key).limit(n)


def shuffled_no(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Adds ``no``, the row's place (from 0) in the shuffled order.

    A global row number in one task would not scale: rows are cut into buckets
    by the digest's first digits, numbered inside their bucket, and moved by the
    counts of the buckets before, of which there are 4,096 at most.
    """
    d = df.withColumn("_o", order_of(F.col(key), seed)).withColumn("_b", F.substring("_o", 1, 3))
    sizes = d.groupBy("_b").agg(F.count("*").alias("_c"))
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    inside = d.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_o", key)) - 1)
    return inside.join(offsets, "_b").withColumn("no", (F.col("_r") + F.col("_off")).cast("bigint")).drop("_o", "_b", "_r", "_off")


def overlapping_slices(df: DataFrame, key: str, n: int, head: float = 0.6, tail: float = 0.4, seed: int = 42) -> DataFrame:
    """Adds ``in_head`` (the first int(head n) rows of the shuffle) and ``in_tail`` (from int(tail n) on)."""
    return shuffled_no(df, key, seed).withColumn("in_head", F.col("no") < int(n * head)).withColumn("in_tail", F.col("no") >= int(n * tail))


def mixed(df: DataFrame, kind: str, key: str, total: int, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """At most int(total share) rows of each kind, in hash order; kinds without a share are left out.

    The cut of a kind is found from bucket counts, so a kind with most rows is not sorted in one task.
    """
    caps = F.create_map(*[x for k, s in shares.items() for x in (F.lit(k), F.lit(int(total * s)))])
    d = df.filter(F.col(kind).isin(*shares)).withColumn("_o", order_of(F.col(key), seed)).withColumn("_b", F.substring("_o", 1, 3))
    sizes = d.groupBy(kind, "_b").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(kind).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_c").over(w), F.lit(0))).filter(F.col("_off") < caps[F.col(kind)]).drop("_c")
    inside = d.join(offsets, [kind, "_b"]).withColumn("_r", F.row_number().over(Window.partitionBy(kind, "_b").orderBy("_o", key)) + F.col("_off"))
    return inside.filter(F.col("_r") <= caps[F.col(kind)]).drop("_o", "_b", "_r", "_off")


def split_name(key: Column, held_out: int = 5, seed: int = 42) -> Column:
    """'eval' for about ``held_out`` percent of the keys, else 'train'."""
    bucket = F.conv(F.substring(order_of(key, seed), 1, 6), 16, 10).cast("int") % 100
    return F.when(bucket < held_out, "eval").otherwise("train")
