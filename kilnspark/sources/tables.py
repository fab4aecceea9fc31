"""Parquet table scans and redelivery handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan ``<sf_dir>/<name>.parquet`` (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, key: str, *cols: str | Column) -> DataFrame:
    """The key and the columns of each row once: redelivered rows repeat an earlier row whole, so all that is made of them is equal."""
    return df.select(key, *[c for c in cols if not isinstance(c, str) or c != key]).distinct() if cols else df.dropDuplicates([key])
