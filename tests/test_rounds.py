"""Repair rounds: every policy against results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from kilnspark.operators import iterate
from kilnspark.plans.q_tables import fault_steps

# faults of the text -> (final text, passed, compile rounds, repair rounds, reset, restarts)
EVERY = {"": ("", True, 0, 1, False, 0), "a": ("", True, 0, 2, False, 0)}
WANT = {
    "full": {"s": ("", True, 1, 1, False, 0), "sab": ("", True, 1, 3, False, 0), "x": ("", True, 0, 2, False, 0), "k": ("", True, 0, 2, False, 0), "r": ("", True, 0, 4, True, 0), "abcde": ("e", False, 0, 4, False, 0), "B": ("B", False, 0, 4, True, 0), "ar": ("r", False, 0, 4, True, 0)},
    "plain": {"s": ("", True, 1, 1, False, 0), "x": ("x", False, 0, 4, False, 0), "k": ("k", False, 0, 4, False, 0), "r": ("r", False, 0, 4, False, 0), "B": ("B", False, 0, 4, False, 0)},
    "static_feedback": {"sab": ("b", False, 1, 4, True, 0), "abcde": ("bcde", False, 0, 4, True, 0), "x": ("", True, 0, 2, False, 0)},
    "single_step": {"s": ("", True, 0, 2, False, 0), "sab": ("", True, 0, 4, False, 0), "x": ("x", False, 0, 4, False, 0), "B": ("B", False, 0, 4, False, 0)},
    "class_loop": {"sab": ("", True, 0, 4, False, 0), "B": ("", True, 0, 4, False, 0), "abcde": ("", False, 0, 5, False, 0), "r": ("r", False, 0, 5, False, 0)},
    "coordinated": {"r": ("", True, 0, 4, True, 1), "ar": ("", True, 0, 5, True, 1), "x": ("x", False, 0, 5, True, 1), "B": ("", True, 0, 4, False, 0)},
    "fresh_start": {"r": ("", True, 0, 4, False, 0), "ar": ("", True, 0, 4, False, 0), "abcde": ("", True, 0, 6, False, 0), "x": ("x", False, 0, 7, False, 0), "B": ("B", False, 0, 7, False, 0)},
}


@pytest.mark.parametrize("policy", sorted(WANT))
def test_policy(spark, policy):
    want = EVERY | WANT[policy]
    keys = spark.createDataFrame([(i, t) for i, t in enumerate(want)], "id long, faults string")
    state, log = iterate.run_rounds(keys, "id", F.lit("task"), F.col("faults"), fault_steps(), iterate.POLICIES[policy])
    rows = {r["key"]: r for r in state.collect()}
    got = {t: tuple(rows[i][c] for c in ("final_text", "passed", "compile_no", "repair_no", "reset_done", "restarts")) for i, t in enumerate(want)}
    assert got == want
    assert all(len(r["history"]) <= iterate.HISTORY for r in rows.values())
    rounds = {i: 0 for i in rows}
    for r in log.collect():
        rounds[r["key"]] += 1
        assert r["action"] in ("compile_repair", "repair", "reset", "passed") and (r["action"] == "passed") == (r["passed"] is True)
    assert rounds == {i: r["compile_no"] + r["repair_no"] for i, r in rows.items()}


def test_failing_steps_count_as_failures(spark):
    """Answers that are null: nothing compiles, nothing passes, no text changes, and the loop ends."""
    none = lambda *cs: lambda df: df.withColumns({c: F.lit(None).cast("boolean" if c.startswith("ok") else "string") for c in cs})
    steps = iterate.Steps(none("ok_compile", "message"), none("ok_test", "message"), none("diagnosis", "fix"), none("new_text"))
    keys = spark.createDataFrame([(1, "t"), (2, None)], "id long, t string")
    state, log = iterate.run_rounds(keys, "id", F.lit("task"), F.col("t"), steps)
    assert {tuple(r) for r in state.select("key", "final_text", "passed", "compile_no", "repair_no").collect()} == {(1, "t", False, 3, 0), (2, None, False, 3, 0)}
    assert log.count() == 6
    empty, log = iterate.run_rounds(keys.limit(0), "id", F.lit("task"), F.col("t"), steps)
    assert empty.count() == 0 and log.count() == 0
