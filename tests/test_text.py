"""Literal cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from kilnspark.functions import text as T
from kilnspark.operators import builders, filters, rewards, sampling, windows
from kilnspark.operators.joins import decontaminate, max_similarity


def one(spark, col, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(("a", "b", "want"), [("Größe der FIFO", "größe des fifo", 0.5), ("", "x", 0.0), ("a_b 1", "a_b 2", 1 / 3)])
def test_jaccard(spark, a, b, want):
    assert one(spark, T.jaccard(T.tokens(F.col("a")), T.tokens(F.col("b"))), a=a, b=b) == pytest.approx(want)


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("full flag compares wr_ptr with rd_ptr", "the full flag never compares wr_ptr against rd_ptr", True), ("full flag", "full flag", False), ("", "x", False)],
)
def test_same_cause(spark, a, b, want):
    assert one(spark, T.same_cause(F.col("a"), F.col("b")), a=a, b=b) is want


def test_fences(spark):
    f = "```"
    assert one(spark, T.fence(F.col("a")), a=f"x\n{f}verilog\nmodule a;\n{f}\nprose\n{f}\nb\n{f}") == "module a;"
    odd = f"{f}text\nnote\n{f}\n\n{f}\nmodule b;endmodule\n{f}"
    assert one(spark, T.fence(F.col("a")), a=odd) == ""
    assert "module b;endmodule" in one(spark, T.code_of(F.col("a")), a=odd)
    assert one(spark, T.code_of(F.col("a"), bare=True), a="see\nmodule q; endmodule\nend") == "module q; endmodule"


def test_log_patterns(spark):
    log = "FAILED src/test_run.py::test_b\nFAILED src/test_run.py::test_b\nFAILED src/t2.py::test_c\nAssertionError: Expected 32, got 0"
    assert one(spark, T.failed_tests(F.col("a")), a=log) == ["test_b", "test_c"]
    assert [tuple(r) for r in one(spark, T.mismatches(F.col("a")), a=log)] == [("32", "0")]
    e = one(spark, T.compile_errors(F.col("a")), a="/code/rtl/x.sv:42: error: bad thing ")[0]
    assert tuple(e) == ("x.sv", 42, "error", "bad thing")
    assert one(spark, T.lines(F.col("a")), a="a\r\nb\nc\n") == ["a", "b", "c"]
    ctx = one(spark, T.context_lines(F.col("a")), a="1\n2\n3\nAssertionError\n5\n6\n7")
    assert ctx == ["2\n3\nAssertionError\n5\n6"]


@pytest.mark.parametrize(("k", "base", "n"), [("a_b_0003", "a_b", 3), ("a_b", "a", 1), ("solo", "solo", 1)])
def test_key(spark, k, base, n):
    assert (one(spark, T.key_base(F.col("a")), a=k), one(spark, T.key_number(F.col("a")), a=k)) == (base, n)


def test_env_and_json(spark):
    assert one(spark, T.env_map(F.col("a")), a="# c\nA = 1\n B=x=y\nA = 2") == {"A": "2", "B": "x=y"}
    assert one(spark, T.toplevel(F.col("a")), a="TOPLEVEL_LANG = v\nTOPLEVEL = top") == "top"
    assert one(spark, T.quote_json_words(F.col("a")), a="{a: b c, d: true}") == '{"a": "b c", "d": true}'


@pytest.mark.parametrize(("n", "keep"), [(50, False), (51, True), (2999, True), (3000, False)])
def test_size(spark, n, keep):
    assert one(spark, filters.in_size(F.col("a")), a="module" + "x" * (n - 6)) is keep


def test_reward_order(spark):
    refusal = "I'm sorry\n```verilog\nmodule a; endmodule\n```"
    assert one(spark, rewards.tiered_reward(F.col("a"), F.lit(True), F.lit("")), a=refusal) == 0.0
    assert one(spark, rewards.tiered_reward(F.col("a"), F.lit(True), F.lit("")), a="module a; endmodule") == 1.0
    assert one(spark, rewards.tiered_reward(F.col("a"), F.lit(False), F.lit("x: Unknown port p")), a="module a; endmodule") == 0.3


def test_group_norm(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 0.3), ("a", 3, 0.0), ("a", 4, 1.0), ("b", 5, 1.0), ("b", 6, 1.0)], "g string, i int, r double")
    out = windows.group_normalised(df, ["g"], "r", "x").select("i", F.round("x", 6).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in out] == [0.970241, -0.627803, -1.312679, 0.970241, 0.0, 0.0]


@pytest.mark.parametrize(("n", "head", "tail"), [(5, 3, 2), (7, 4, 2)])
def test_slices(spark, n, head, tail):
    rows = sampling.overlapping_slices(spark.range(n), "id", n).collect()
    assert sorted(r["no"] for r in rows) == list(range(n))
    assert sum(r["in_head"] for r in rows) == head and min(r["no"] for r in rows if r["in_tail"]) == tail


def test_faults(spark):
    assert one(spark, builders.flip_edge(F.col("a")), a="@(posedge c or posedge r)") == "@(negedge c or posedge r)"
    assert one(spark, builders.off_by_one(F.col("a"), F.lit(1)), a="a < b; c > d; e <= f") == "a < b; c >= d; e <= f"
    assert one(spark, builders.swap_operator(F.col("a")), a="assign x = a & b | c;\nassign y = p & q;") == "assign x = a & b & c;\nassign y = p & q;"
    assert one(spark, builders.drop_sensitivity(F.col("a"), F.lit(0)), a="always @(a, b, c) x = 1;") == "always @(b, c) x = 1;"
    assert one(spark, builders.swap_states(F.col("a"), F.lit(1)), a="next_state = A; next_state = B;") == "next_state = B; next_state = A;"
    assert one(spark, builders.mask_assigns(F.col("a"), F.lit(1)), a="assign x = 1; assign y = 2;").count("TODO") == 1
    assert one(spark, builders.flip_edge(F.col("a")), a="none") is None


def test_similarity_limit(spark):
    left = spark.createDataFrame([(1, "a b c d"), (2, None), (3, "x"), (4, "a b c d e")], "id long, t string")
    right = spark.createDataFrame([(9, "a b c d")], "k long, p string")
    got = {r["id"]: r["max_similarity"] for r in max_similarity(left, right, "id", "t", "k", "p").collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.8}
    assert {r["id"] for r in decontaminate(left, right, "id", "t", "k", "p", 0.8).collect()} == {2, 3}
