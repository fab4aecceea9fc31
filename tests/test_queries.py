"""Every core query runs; those with SQL give the rows of their SQL on the smallest tables."""

import os

import duckdb
import pytest

from kilnspark.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, con, tmp_path, name):
    out = str(tmp_path / "out")
    registry.QUERIES[name](spark, SF).write.parquet(out)
    con.execute(f"CREATE OR REPLACE TEMP TABLE o AS {registry.SQL[name]}")
    cols = ", ".join(c[0] for c in con.execute("DESCRIBE o").fetchall())
    got = f"(SELECT {cols} FROM '{out}/*.parquet')"
    assert con.execute(f"SELECT * FROM o EXCEPT ALL SELECT * FROM {got} LIMIT 3").fetchall() == []
    assert con.execute(f"SELECT * FROM {got} EXCEPT ALL SELECT * FROM o LIMIT 3").fetchall() == []


# Queries without SQL, and the tests that check their rows.
ELSEWHERE = {
    "test_builders": {"prj_debug", "prj_edit", "prj_bug_offbyone", "prj_bug_state", "prj_bug_sens", "prj_mask_always", "prj_mask_assign", "prj_error_block", "prj_error_block_v2", "udf_bug_list", "udf_mask_list", "snk_text_report"},
    "test_drift": {"p2_found", "p2_table", "p2_path_types"},
    "test_logs": {"p4_found", "p4_levels"},
}


def test_every_query_is_checked_somewhere():
    assert set(registry.QUERIES) - set(registry.SQL) == set().union(*ELSEWHERE.values())


@pytest.mark.parametrize("name", sorted(set().union(*ELSEWHERE.values())))
def test_runs_over_the_table(spark, name):
    """Their rows are checked elsewhere; here each runs over a whole table and finds something, but for faults that no module has."""
    n = registry.QUERIES[name](spark, SF).count()
    assert n > 0 or name in ("prj_bug_state", "prj_bug_sens")
