"""Readers and writers over files that the tests write."""

import json

import pytest
from pyspark.sql import functions as F

from kilnspark.sources import files, sinks


def test_paired_files(spark, tmp_path):
    for name, text in {"p1_prompt.txt": "say\na", "p1_ref.sv": "module a;", "p2_prompt.txt": "alone", "p3_ref.sv": "alone"}.items():
        (tmp_path / name).write_text(text)
    assert [tuple(r) for r in files.paired_files(spark, str(tmp_path), "_prompt.txt", "_ref.sv").collect()] == [("p1", "say\na", "module a;")]


def test_json_map(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"p1": {"n": 1}, "p2": None, "q": "x"}, indent=1))
    (tmp_path / "b.json").write_text("[1, 2]")
    got = {(r["path"].rsplit("/", 1)[1], r["key"], r["value"]) for r in files.json_map(spark, str(tmp_path)).collect()}
    assert got == {("a.json", "p1", '{"n":1}'), ("a.json", "p2", None), ("a.json", "q", "x")}


def test_xml_results(spark, tmp_path):
    (tmp_path / "r.xml").write_text(
        '<testsuites><testsuite name="s"><testcase name="t1" classname="c" time="0.5" sim_time_ns="12.5"/>'
        '<testcase name="t2" classname="c" time="1.5" sim_time_ns="3"><failure error_type="AssertionError" error_msg="a &lt; b"/></testcase></testsuite></testsuites>'
    )
    assert [tuple(r) for r in files.xml_results(spark, str(tmp_path)).collect()] == [("t1", "c", 0.5, 12.5, None), ("t2", "c", 1.5, 3.0, "a < b")]


def test_xml_failures_in_a_column(spark):
    xml = '<testsuite><testcase name="a"/><testcase name="b"><failure error_msg="x &lt; y&#10;z"/></testcase></testsuite>'
    df = spark.createDataFrame([(1, xml), (2, None), (3, "<testsuite></testsuite>")], "id long, x string")
    got = {r["id"]: r["m"] for r in df.select("id", files.xml_failures(F.col("x")).alias("m")).collect()}
    assert got[1] == ["x < y\nz"] and not got[2] and not got[3]


def test_record_and_resume(spark, tmp_path):
    todo = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "key string")
    path = str(tmp_path / "done")
    assert sinks.remaining(todo, path, "key").count() == 3
    sinks.record_results(spark.createDataFrame([("p2", True)], "key string, passed boolean"), path)
    sinks.record_results(spark.createDataFrame([("p3", False)], "key string, passed boolean"), path)
    assert [r["key"] for r in sinks.remaining(todo, path, "key").collect()] == ["p1"]


def test_stage_cache_is_hit_by_a_later_call(spark):
    df, calls = spark.range(3), []

    def make():
        calls.append(1)
        return df

    first = sinks.stage_cache("test_stage", make, df, "v1").count()
    assert first == sinks.stage_cache("test_stage", make, df, "v1").count() == 3
    assert len(calls) <= 1


def test_first_nonempty(spark):
    def broken():
        raise OSError("gone")

    assert files.first_nonempty([broken, lambda: spark.range(0), lambda: spark.range(2)]).count() == 2
    assert files.first_nonempty([broken, lambda: spark.range(0)]) is None
    with pytest.raises(FileNotFoundError):
        files.first_existing(spark, ["/no/such/a", "/no/such/b"])


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("k1", " a \n"), ("k2", "b")], "key string, text string")
    path = sinks.write_texts(df, "key", "text", str(tmp_path / "t"))
    assert {(r["key"], r["value"]) for r in spark.read.text(path, wholetext=True).collect()} == {("k1", "a\n"), ("k2", "b\n")}
    said = []
    assert sinks.append_safely(df, str(tmp_path / "j"), said.append) and not said
    assert files.jsonl(spark, str(tmp_path / "j"), "key string, text string, more int").where(F.col("more").isNull()).count() == 2
    assert not sinks.append_safely(df.select((F.lit(1) / F.col("text").cast("int")).alias("x")), "noscheme://x/y", said.append) and said
