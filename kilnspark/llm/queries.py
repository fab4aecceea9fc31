"""Queries of the operators for training text, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kilnspark.llm import encode, leak, neardup, pairs, pii, syntax
from kilnspark.session import spread
from kilnspark.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.invalid_files(spread(table(spark, sf_dir, "raw_modules")))


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.invalid_rates(spread(table(spark, sf_dir, "raw_modules")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "raw_modules"))


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link_counts(table(spark, sf_dir, "raw_modules"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.pair_defects(spread(table(spark, sf_dir, "training_samples")))


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defect_rates(spread(table(spark, sf_dir, "training_samples")))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_corpus(table(spark, sf_dir, "documents"))


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again."""
    return encode.decode_corpus(p6_ids(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.leaks(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark_problems"))


def p7_restated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.restated(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark_problems"))


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.leaked_items(p7_found(spark, sf_dir), table(spark, sf_dir, "benchmark_problems"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_mentions(spread(table(spark, sf_dir, "documents")))


def p8_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.mask_documents(spread(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_rates": p1_rates,
    "p3_found": p3_found,
    "p3_links": p3_links,
    "p5_found": p5_found,
    "p5_rates": p5_rates,
    "p6_ids": p6_ids,
    "p6_round_trip": p6_round_trip,
    "p7_found": p7_found,
    "p7_restated": p7_restated,
    "p7_items": p7_items,
    "p8_found": p8_found,
    "p8_masked": p8_masked,
}
SQL: dict[str, str] = {"p6_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents", "p7_found": leak.P7_SQL, "p7_items": leak.P7_ITEMS_SQL}
