"""All queries of the core by name, and the SQL of those that SQL can state."""

from __future__ import annotations

from kilnspark.operators import drift, logs
from kilnspark.plans import q_rows, q_sources, q_tables  # noqa: F401  they register their queries
from kilnspark.plans.base import QUERIES, SQL, query
from kilnspark.sources.tables import table

__all__ = ["QUERIES", "SQL"]


@query()
def p2_found(spark, sf_dir):
    return drift.schema_changes(table(spark, sf_dir, "result_files"))


@query()
def p2_table(spark, sf_dir):
    return drift.consistent_table(table(spark, sf_dir, "result_files"))


@query()
def p2_path_types(spark, sf_dir):
    return drift.path_statistics(table(spark, sf_dir, "result_files"))


@query()
def p4_found(spark, sf_dir):
    return logs.parse_logs(logs.log_texts(table(spark, sf_dir, "raw_results"), table(spark, sf_dir, "iteration_log")))


@query()
def p4_levels(spark, sf_dir):
    return logs.level_counts(p4_found(spark, sf_dir))
