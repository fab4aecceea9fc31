"""Faults, masks and prompts against plain expressions over the same texts."""

import os
import re

import pytest
from pyspark.sql import functions as F

from kilnspark.operators import builders
from kilnspark.plans import registry

SF = "/root/testdata/sf0.001"
FSM = "module f;\nalways @(a, b , c) begin\n case (s)\n  A: next_state = B;\n  B: next_state <= C ;\n  C: if (x < y) next_state = A;\n endcase\nend\nassign q = a & b;\nassign z = (c) ? d : e;\nassign w = q >= z;\nendmodule\n"
RST = "always @(posedge c) begin\n  if (!rst_n)\n    q <= 0;\n\n    r <= 1;\nend\n  x <= 2;\n"
NESTED = "always @(posedge c) begin\n  if (a) begin\n    first <= 1234;\n    second <= 5678;\n  end\n  third <= 9;\nend\n"
TEXTS = [FSM, RST, NESTED, "", "assign a = b;", "always @(*) begin\n x\nend", "if (a < b && c > d || e <= f) x << 2;", "next_state = A; next_state = A;", "always @(a) x;", "module m (input a);\n" + "wire w;\n" * 9 + "endmodule x"]


def texts(spark):
    out = list(TEXTS)
    if os.path.isdir(SF):
        out += [r["verilog"] for r in spark.read.parquet(f"{SF}/raw_modules.parquet").select("verilog").distinct().collect() if r["verilog"]]
    return out


def made(spark, column):
    """(text, result) of a builder over all texts, each with three seeds."""
    rows = [(t, s) for t in texts(spark) for s in (1, 2, 7)]
    df = spark.createDataFrame(rows, "c string, seed long")
    return [(r["c"], r["x"]) for r in df.select("c", column(F.col("c"), F.col("seed")).alias("x")).collect()]


def off_by_one(t):
    return {t[: m.end()] + "=" + t[m.end() :] for m in re.finditer(r"(?<![<>!])([<>])(?![=<>])", t)}


def swap_states(t):
    ms = list(re.finditer(r"next_state\s*(?:<=|=)\s*(\w+)\s*;", t))
    return {t[: a.start(1)] + b[1] + t[a.end(1) : b.start(1)] + a[1] + t[b.end(1) :] for i, a in enumerate(ms) for b in ms[i + 1 :] if a[1] != b[1]}


def drop_sensitivity(t):
    m = re.search(r"always\s*@\s*\(([^)]+)\)", t)
    names = [x.strip() for x in m[1].split(",")] if m else []
    return {t[: m.start(1)] + ", ".join(names[:k] + names[k + 1 :]) + t[m.end(1) :] for k in range(len(names))} if len(names) > 1 else set()


@pytest.mark.parametrize(("column", "plain"), [(builders.off_by_one, off_by_one), (builders.swap_states, swap_states), (builders.drop_sensitivity, drop_sensitivity)])
def test_drawn_faults(spark, column, plain):
    """The result is one of all that are possible; only state changes may draw two equal names and give none."""
    seen = set()
    for t, x in made(spark, column):
        want = plain(t)
        assert (x in want) if x is not None else (not want or column is builders.swap_states), t
        seen.add((t, x))
    assert len({x for t, x in seen if t == FSM}) > (1 if column is not builders.off_by_one else 0)


def mask_block(t):
    m = re.search(r"(always\s*@[^;]+begin\s*\n)(.*?)(^\s*end)", t, re.S | re.M)
    return None if not m or len(m[2].strip()) < 20 else t[: m.end(1)] + "    // TODO: implement this always block\n" + t[m.start(3) :]


def drop_reset(t):
    m = re.search(r"if\s*\([^)]*rst[^)]*\)\s*\n(\s+[^\n]+\n)+", t, re.I)
    return None if not m else t[: m.start()] + t[m.end() :]


def mask_module(t):
    m = re.search(r"(module\s+\w+[^;]+;)(.*?)(endmodule)", t, re.S)
    return None if not m or len(m[2].strip()) < 50 else t[: m.end(1)] + "\n\n// TODO: implement module logic\n\n" + t[m.start(3) :]


@pytest.mark.parametrize(("column", "plain"), [(builders.mask_block, mask_block), (builders.drop_reset, drop_reset), (builders.mask_module, mask_module)])
def test_fixed_results(spark, column, plain):
    got = made(spark, lambda c, _: column(c))
    assert [(t, x) for t, x in got if x != plain(t)] == []
    assert any(x for _, x in got)


def test_masked_assignments(spark):
    for t, x in made(spark, builders.mask_assigns):
        old = re.findall(r"assign\s+\w+\s*=\s*([^;]+);", t)
        if len(old) < 2:
            assert x is None
            continue
        new = re.findall(r"assign\s+\w+\s*=\s*([^;]+);", x)
        changed = [b for a, b in zip(old, new, strict=True) if a != b]
        assert changed == ["/* TODO */"] * max(1, len(old) // 2)
        assert re.sub(r"(assign\s+\w+\s*=\s*)[^;]+;", r"\1;", x) == re.sub(r"(assign\s+\w+\s*=\s*)[^;]+;", r"\1;", t)


def test_lists_and_samples(spark):
    """Every fault of a list is one that its kind allows, and samples hold one of them."""
    kinds = {"off by one": off_by_one, "wrong state transition": swap_states, "always sensitivity": drop_sensitivity, "missing reset": lambda t: {drop_reset(t)}, "posedge negedge": lambda t: {t.replace("posedge", "negedge", 1)}}
    for t, faults in made(spark, builders.faults):
        for f in faults:
            assert f["code"] != t and (f["kind"] not in kinds or f["code"] in kinds[f["kind"]](t))
        assert ("missing reset" in {f["kind"] for f in faults}) == (drop_reset(t) is not None)
    for t, m in made(spark, builders.masked):
        assert m is None or m["code"] != t and {"always": mask_block(t), "module": mask_module(t)}.get(m["kind"], m["code"]) == m["code"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_over_the_table(spark):
    code = {r["module_id"]: r["verilog"] for r in spark.read.parquet(f"{SF}/raw_modules.parquet").collect() if r["verilog"] is not None}
    run = lambda n: registry.QUERIES[n](spark, SF).collect()
    fenced = lambda x: f"```verilog\n{x}\n```"
    assert {r["module_id"]: r["code"] for r in run("prj_mask_always")} == {i: mask_block(t) for i, t in code.items() if mask_block(t) is not None}
    assert {r["module_id"] for r in run("prj_bug_offbyone")} == {i for i, t in code.items() if off_by_one(t)}
    assert {r["module_id"] for r in run("prj_bug_sens")} == {i for i, t in code.items() if drop_sensitivity(t)}
    lists = {r["module_id"]: r["kinds"] for r in run("udf_bug_list")}
    masks = {r["module_id"]: r["kind"] for r in run("udf_mask_list")}
    assert lists.keys() == masks.keys() == code.keys()
    debug, edit = run("prj_debug"), run("prj_edit")
    assert {r["module_id"] for r in debug} == {i for i, k in lists.items() if k} and all(r["bug_type"] in lists[r["module_id"]] for r in debug)
    assert {r["module_id"] for r in edit} == {i for i, k in masks.items() if k}
    for r in [*debug, *edit]:
        user, answer = r["messages"]
        assert (user["role"], answer["role"], answer["content"]) == ("user", "assistant", fenced(code[r["module_id"]]))
        assert "```verilog\n" in user["content"] and fenced(code[r["module_id"]]) not in user["content"]
    report = [r["line"] for r in registry.QUERIES["snk_text_report"](spark, SF).orderBy("line_no").collect()]
    tests = {r["result_id"]: r for r in spark.read.parquet(f"{SF}/raw_results.parquet").collect()}.values()
    assert report[0] == "Tests by category" and sum(int(x.split()[1]) for x in report[2:]) == len(tests)


def plain_lines(log):
    return [] if log == "" else re.split(r"\r\n|\n|\r", re.sub(r"(\r\n|\n|\r)\Z", "", log))


def error_block(log):
    failed = list(dict.fromkeys(re.findall(r"FAILED\s+[\w./]+::(\w+)", log)))[:5]
    pairs = [(a.strip(), b.strip()) for a, b in re.findall(r"(?i)expected\s+([^\n,]{1,80}),?\s*got:?\s*([^\n]{1,80})", log)][:5]
    ls = plain_lines(log)
    ctx = ["\n".join(ls[max(i - 2, 0) : i + 3]) for i, x in enumerate(ls) if "AssertionError" in x or ("assert " in x.lower() and "==" in x)][:4]
    tim = [x.strip() for x in ls if "WARNING" in x and any(w in x.lower() for w in ("glitch", "setup", "hold", "timing", "clock"))][:3]
    out = []
    if failed:
        out.append("Failed tests: " + ", ".join(failed))
    if pairs:
        out.append("Value mismatches (expected vs actual):\n" + "\n".join(f"  expected: {a}\n  actual:   {b}" for a, b in pairs))
    if ctx:
        out.append("Assertion failures (with context):\n" + "\n".join("  " + x.replace("\n", "\n  ") for x in ctx))
    if tim:
        out.append("Timing warnings:\n" + "\n".join("  " + x for x in tim))
    out.append("\nRaw output tail (last 1000 chars):\n" + log[-1000:] if out else "Full harness output (last 2500 chars):\n" + log[-2500:])
    return "\n".join(out)


def error_block_older(log, stage):
    errs = [f"  {f.split('/')[-1]} line {int(n)}: {k}: {m.strip()}" for f, n, k, m in re.findall(r"(\S+\.(?:sv|v)):(\d+):\s*(error|warning):\s*(.+)", log)][:5]
    failed = list(dict.fromkeys(re.findall(r"FAILED\s+[\w./]+::(\w+)", log)))[:5]
    bad = [(a.strip(), b.strip()) for a, b in re.findall(r"(?i)expected\s+([^\n,]+),?\s*got:?\s*([^\n]+)", log)]
    bad += [(b.strip(), a.strip()) for a, b in re.findall(r"assert\s+(.+?)\s*==\s*(.+)", log) if a.strip() != b.strip()]
    said = [x.strip() for x in plain_lines(log.strip()) if "AssertionError" in x or "assert " in x.lower()][:5]
    out = [f"Stage: {stage}"]
    if errs:
        out.append("\n".join(["iverilog errors:", *errs]))
    if failed:
        out.append("Failed tests: " + ", ".join(failed))
    if bad:
        out.append("\n".join(["Value mismatches:", *[f"  expected={a}  actual={b}" for a, b in bad[:5]]]))
    if said:
        out.append("\n".join(["Assertion failures:", *["  " + x for x in said]]))
    if not errs and not bad:
        out.append("Raw error tail (last 1500 chars):\n" + log.strip()[-2000:][-1500:])
    return "\n".join(out)


LOGS = ["", "x", "FAILED src/t.py::test_a\nExpected 3, got 4\n  assert a == b \nWARNING hold violated\n/w/x.sv:12: error: bad thing", "1\n2\nassert x == 3\nAssertionError\n5\n" + "y" * 3000, "warning: none\nassert q\n"]


def test_error_blocks(spark):
    logs = list(LOGS)
    if os.path.isdir(SF):
        logs += [r["log"] for r in spark.read.parquet(f"{SF}/raw_results.parquet").select("log").distinct().collect() if r["log"]]
    df = spark.createDataFrame([(x,) for x in logs], "log string")
    got = df.select("log", builders.error_block(F.col("log")).alias("a"), builders.error_block_older(F.col("log"), "test").alias("b")).collect()
    assert [(r["log"], r["a"]) for r in got if r["a"] != error_block(r["log"])] == []
    assert [(r["log"], r["b"]) for r in got if r["b"] != error_block_older(r["log"], "test")] == []
