import random
import re

import numpy as np
import pytest

from kilnspark.functions.automaton import Automaton
from kilnspark.operators.logs import entries, level_counts, log_texts, parse_logs


def parse(text):
    return [e[1:] for e in entries([text])]


def test_layouts():
    text = "\r\n".join(
        [
            "cut line",
            "2026-04-22 10:03:54,027 - harness.docker - INFO - hello  ",
            "  more",
            "2026-04-22 21:14:14,169 WARNING bare",
            "[2026-01-20T17:50:17+05:30] [err] rtl-sync: off",
            "  53.75ns \x1b[33mINFO    \x1b[0m cocotb.x        run",
            "   -.--ns ERROR    gpi   unset",
            "CRITICAL Runner:runner.py:785 down",
            "%Warning-WIDTH: rtl/a.sv:3:8: wide",
            "/code/rtl/b.v:9: error: bad",
            "srun: fatal: gone",
            'time="2026-02-01T04:42:14.800Z" level=warn component=compose msg="say \\"hi\\""',
            '{"message": "a\\nb", "logger": "score", "level": "FATAL", "ts": 1771216301.302}',
        ]
    )
    assert parse(text) == [
        (2, "2026-04-22 10:03:54", "INFO", "harness.docker", "hello\n  more"),
        (4, "2026-04-22 21:14:14", "WARNING", "", "bare"),
        (5, "2026-01-20 12:20:17", "ERROR", "rtl-sync", "off"),
        (6, "53.75ns", "INFO", "cocotb.x", "run"),
        (7, "", "ERROR", "gpi", "unset"),
        (8, "", "CRITICAL", "Runner", "down"),
        (9, "", "WARNING", "rtl/a.sv", "wide"),
        (10, "", "ERROR", "/code/rtl/b.v", "bad"),
        (11, "", "CRITICAL", "srun", "gone"),
        (12, "2026-02-01 04:42:14", "WARNING", "compose", 'say "hi"'),
        (13, "2026-02-16 04:31:41", "CRITICAL", "score", "a\nb"),
    ]


def test_odd_texts():
    assert parse("") == [] and parse("nothing here") == [] and parse('{"a": 1}') == []
    assert list(entries([None, "", "srun: info: x"])) == [(2, 1, "", "INFO", "srun", "x")]
    assert parse("srun: info: " + "x" * 100_000)[0][4] == "x" * 100_000


def test_redelivered_and_extra_columns(spark):
    r = spark.createDataFrame([(1, "srun: info: x", "o"), (1, "srun: info: x", "o"), (2, None, None)], "result_id long, log string, origin string")
    i = spark.createDataFrame([], "row_id long, output_tail string")
    assert [tuple(x) for x in parse_logs(log_texts(r, i)).collect()] == [("raw_results", 1, 1, "", "INFO", "srun", "x")]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("2026-01-02 03:04:05 starting up", ("2026-01-02 03:04:05", "", "", "starting up")),
        ("[2026-01-02 03:04:05] build started", ("2026-01-02 03:04:05", "", "", "build started")),
        ("ERROR something broke", ("", "ERROR", "", "something broke")),
        ("WARNING: foo bar", ("", "WARNING", "", "foo bar")),
        ("[ERROR] tool: x", ("", "ERROR", "tool", "x")),
        ("12:00:01 INFO tool: x", ("12:00:01", "INFO", "tool", "x")),
        ("Jan 12 10:00:00 host prog[12]: ERROR: bad thing", ("Jan 12 10:00:00", "ERROR", "prog", "bad thing")),
        ("2026-01-02T03:04:05Z host prog: [warn] x", ("2026-01-02 03:04:05", "WARNING", "prog", "x")),
        ("** Error: tb.sv(12): bad", ("", "ERROR", "tb.sv", "bad")),
        ("** Warning (suppressible): (vsim-12) bad", ("", "WARNING", "", "(vsim-12) bad")),
        ('level=info msg="a = \\"b\\" - c" time=2026-01-02T03:04:05Z rest', ("2026-01-02 03:04:05", "INFO", "", 'a = "b" - c rest')),
    ],
)
def test_heads_of_few_parts(line, want):
    assert parse(line) == [(1, *want)]


@pytest.mark.parametrize("line", ["error: none", "AssertionError: x", "  warning signs", "** leaf PASS 1.2 **", "12 passed in 3s", "INFORMATION desk", "   27 |  x", "[3:0] error", "levels=3", "level=575", "level=575 lag=3", '{"level": 30, "msg": "x"}'])
def test_no_head(line):
    assert parse(line) == [] and parse("srun: info: x\n" + line) == [(1, "", "INFO", "srun", "x\n" + line)]


def test_first_line_of_a_tail_may_be_cut():
    text = "ERROR - the rest\nERROR whole"
    assert [e[1:] for e in entries([text], [True])] == [(2, "", "ERROR", "", "whole")]
    assert [e[1] for e in entries([text], [False])] == [1, 2]


def test_automaton_against_expressions():
    r = random.Random(2)
    patterns = [r"ab*(c|d)+", r"[^a]{2,3}", r"a{2}.?", r"\d+\.\d*", "[a-c_.]+x"]
    machine = Automaton(patterns)
    texts = ["".join(r.choice("abcdx_.12") for _ in range(r.randint(0, 9))) for _ in range(400)]
    raw = "\n".join(texts).encode()
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    kind, upto = machine.longest(np.frombuffer(raw, dtype=np.uint8), ends - [len(t) for t in texts], ends)
    for t, k, n in zip(texts, kind.tolist(), (upto - ends + [len(t) for t in texts]).tolist(), strict=True):
        best = max(((i, j) for j in range(len(patterns)) for i in range(1, len(t) + 1) if re.fullmatch(patterns[j], t[:i])), key=lambda x: (x[0], -x[1]), default=(0, -1))
        assert (n, k) == best, t
        assert machine.whole(t) == next((j for j, p in enumerate(patterns) if t and re.fullmatch(p, t)), -1)


def test_level_counts(spark):
    r = spark.createDataFrame([(1, "srun: info: x\nsrun: error: yy\n z"), (2, "srun: info: xyz")], "result_id long, log string")
    got = level_counts(parse_logs(log_texts(r, spark.createDataFrame([], "row_id long, output_tail string"))))
    assert {tuple(x) for x in got.collect()} == {("raw_results", "srun", "INFO", 2, 3), ("raw_results", "srun", "ERROR", 1, 5)}
