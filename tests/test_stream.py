import json

from kilnspark.streaming import logstream


def test_windowed(spark, tmp_path):
    rows = [{"row_id": i, "problem_id": "p", "iteration": "final" if i == 3 else str(i), "ts": f"2026-01-01T0{i}:00:00Z", "action_name": "saved", "passed": i == 1} for i in range(4)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows + rows[:1])))
    s = logstream.windowed_actions(logstream.once_only(logstream.read_log(spark, str(tmp_path / "in")), "10 minutes"), None)
    got = logstream.drain(s, "windowed", str(tmp_path / "cp")).collect()
    assert sorted((r["n"], r["n_passed"]) for r in got) == [(1, 0), (1, 1)]  # the last two windows are still open
