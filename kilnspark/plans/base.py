"""Registration of queries: a function (spark, sf_dir) -> DataFrame and its SQL, under one name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from kilnspark.sources.tables import once, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Short name -> (table, key); redelivered rows count once on both sides.
TABLES = {"rm": ("raw_modules", "module_id"), "rf": ("result_files", "file_id"), "rr": ("raw_results", "result_id"), "il": ("iteration_log", "row_id"), "ts": ("training_samples", "sample_id")}
WS = r"\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def scan(spark: SparkSession, sf_dir: str, short: str) -> DataFrame:
    """A table as it is delivered; for queries whose result is made unique (``each`` of :func:`query`)."""
    return table(spark, sf_dir, TABLES[short][0] if short in TABLES else {"bp": "benchmark_problems", "docs": "documents"}[short])


def rows(spark: SparkSession, sf_dir: str, short: str, *cols: str | Column, where: str | Column | None = None) -> DataFrame:
    """Columns of a table without redelivered rows; ``bp`` and ``docs`` have none.

    Filter and projection come first, so that only what a query needs of a row is
    compared: redelivered rows are whole copies, and what is made of them is equal.
    """
    df = scan(spark, sf_dir, short)
    if where is not None:
        df = df.filter(where)
    if short not in TABLES:
        return df.select(*cols) if cols else df
    return once(df, TABLES[short][1], *cols)


def expand(sql: str) -> str:
    """``@rm@`` and the like stand for the tables without redelivered rows, ``@WS@`` for white space in a class."""
    for short, (name, key) in TABLES.items():
        sql = sql.replace(f"@{short}@", f"(SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY {key}) = 1)")
    return sql.replace("@WS@", WS)


def query(sql: str | None = None, name: str | None = None, each: bool = False) -> Callable[[Query], Query]:
    """Register a query; with ``each`` it works row by row on :func:`scan` and holds the key, and its equal result rows count once."""

    def add(f: Query) -> Query:
        n = name or f.__name__
        assert n not in QUERIES, n
        QUERIES[n] = f if not each else lambda spark, sf: f(spark, sf).distinct()
        if sql:
            SQL[n] = expand(sql)
        return f

    return add
