import json
from datetime import datetime, timedelta

from kilnspark.operators import drift

SCHEMA = "file_id long, runner string, written_at timestamp, body string"


def files(spark, *runs):
    rows, n = [], 0
    for runner, bodies in runs:
        for k, b in enumerate(bodies):
            n += 1
            rows.append((n, runner, datetime(2026, 1, 1) + timedelta(days=k), b if b is None or isinstance(b, str) else json.dumps(b)))
    return spark.createDataFrame(rows + rows[:1], SCHEMA)


def found(df):
    return {tuple(r) for r in drift.schema_changes(df).collect()}


def test_kinds(spark):
    df = files(
        spark,
        ("a", [{"p": {"id": "p", "x": 1, "y": 2}}, [{"id": "p", "x": 1.5, "z": 2}], [{"id": "p", "z": 3, "w": None}], [{"id": "p", "x": 1, "z": "3", "w": True}]]),
        ("b", [[{"id": "q"}], None, "not json", [{"id": "q", "n": 1}]]),
    )
    assert found(df) == {(2, "x", "type_changed"), (2, "z", "renamed"), (3, "x", "removed"), (3, "w", "added"), (4, "x", "added"), (4, "z", "type_changed"), (8, "n", "added")}


def test_null_keeps_type(spark):
    assert found(files(spark, ("a", [[{"id": "p", "x": 1}], [{"id": "p", "x": None}], [{"id": "p", "x": "s"}]]))) == {(3, "x", "type_changed")}


def test_one_long_runner_equals_sequence(spark):
    """A runner spread over all partitions gives what one pass gives."""
    bodies = [[{"id": "p", **{f"f{(k + j) % 7}": (None if (k + j) % 3 == 0 else k if j % 2 else str(k)) for j in range(k % 5)}}] for k in range(120)]
    df = files(spark, ("only", bodies))
    state, want = None, set()
    for n, b in enumerate(bodies, 1):
        recs = drift.records(json.dumps(b))
        state, ch = drift.step(state, [(k, drift.raw_type(v)) for k, v in recs[0][1].items()])
        want |= {(n, f, c) for f, c in ch}
    assert found(df) == want


def test_table(spark):
    df = files(spark, ("a", [[{"id": "p", "gen_in_tok": "1,651", "elapsed_s": "26.6s", "rtl_path": {"dir": "d", "file": "f.v"}, "passed": "no"}], [{"id": "p", "gen_in_tok": "many", "elapsed_s": 2, "rtl_path": ["a", "b"], "passed": True}]]))
    r = {x["file_id"]: x for x in drift.consistent_table(df).collect()}
    assert (r[1]["gen_in_tok"], r[1]["elapsed_s"], r[1]["rtl_path"], r[1]["passed"], r[1]["failed_casts"]) == (1651, 26.6, ["d/f.v"], False, [])
    assert (r[2]["gen_in_tok"], r[2]["rtl_path"], r[2]["failed_casts"]) == (None, ["a", "b"], ["gen_in_tok"])


def test_empty(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == set()


def test_path_statistics_and_nested_paths(spark):
    df = files(spark, ("a", [[{"id": "p", "x": 1, "rtl_path": {"dir": "d", "files": ["f", None]}}, {"id": "q", "x": None}], [{"id": "p", "x": 2.5}]]), ("b", [None]))
    got = {tuple(r) for r in drift.path_statistics(df).collect()}
    assert got == {
        ("id", "string", 3, 2), ("x", "integer", 1, 1), ("x", "null", 1, 1), ("x", "decimal", 1, 1), ("rtl_path", "object", 1, 1), ("rtl_path.dir", "string", 1, 1),
        ("rtl_path.files", "array", 1, 1), ("rtl_path.files[]", "string", 1, 1), ("rtl_path.files[]", "null", 1, 1),
    }
    assert [p for p, *_ in drift.paths_of({"b": {"z": [1, {"y": 2}]}, "a": None})] == ["b", "b.z", "b.z[]", "b.z[]", "b.z[].y", "a"]


def test_same_name_in_a_nested_object_is_no_field(spark):
    assert found(files(spark, ("a", [[{"id": "p", "o": {"x": 1}}], [{"id": "p", "o": {"x": "s", "y": 2}}]]))) == set()
