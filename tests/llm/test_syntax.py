import ast
import json

import pytest

from kilnspark.llm.syntax import check_files, check_text


def status(path, text):
    return check_text(path, text)[1]


V = "module m #(parameter A = 1) (input wire clk, output reg [3:0] q);\n  always @(posedge clk) begin\n    if (A) q <= q + 4'd1; else q <= 0;\n  end\nendmodule\n"


@pytest.mark.parametrize(
    ("path", "text", "want"),
    [
        ("a.v", V, "ok"),
        ("a.V", V + "// cut comm", "ok"),
        ("a.v", V[:-12], "truncated"),
        ("a.v", V.replace("4'd1;", "4'd1"), "failed"),
        ("a.v", V.replace("input wire", "input logic"), "failed"),
        ("a.sv", V.replace("input wire", "input logic"), "ok"),
        ("a.sv", V.replace("output reg [3:0] q", "output reg [3:0] do"), "failed"),
        ("a.v", "<<<<<<< HEAD\n" + V, "failed"),
        ("a.v", "/* <<<<<<< HEAD\n begin case */" + V, "ok"),
        ("a.v", "module m;\n`ifdef A\n assign x = 1;\n`else\n assign x = ;\n`endif\nendmodule", "failed"),
        ("a.v", "module m;\n`ifdef A\n if (1) begin\n`else\n if (2) begin\n`endif\n end\nendmodule", "ok"),
        ("a.v", "module m;\n`ifdef A\n if (1) begin\n`endif\n assign x = 1;\n`ifdef A\n end\n`endif\nendmodule", "ok"),
        ("a.v", "module m;\n`ifdef A\n if (1) begin\n`endif\n assign x = 1;\n`ifdef B\n end\n`endif\nendmodule", "failed"),
        ("a.v", "module m;\n`ifdef A\nendmodule", "truncated"),
        ("a.v", "`define W 4\nmodule m; wire [`W:0] x; endmodule", "ok"),
        ("a.json", '{"a": [1, -2.5e3, null, "x\\u00e9"]}', "ok"),
        ("a.json", '{"a": 1,}', "failed"),
        ("a.json", '{"a": [1', "truncated"),
        ("a.json", "NaN", "failed"),
        ("a.py", "def f(x, *a, k=1, **kw):\n    return [y for y in x if y] + {**kw}\n", "ok"),
        ("a.py", "async def f():\n\tawait g(f'{x!r:>{w}} {{}}')\n\tif a: pass\n\telif b:\n\t\tx: int = 3\n", "ok"),
        ("a.py", "def f(:\n  pass\n", "failed"),
        ("a.py", "if x:\n    y = (1,\n", "truncated"),
        ("a.py", "if x:\n    a\n  b\n", "failed"),
        ("a.txt", "(((", "none"),
        ("a.v", " \n", "none"),
        ("a.v", None, "none"),
        (None, "x", "none"),
    ],
)
def test_cases(path, text, want):
    assert status(path, text) == want


@pytest.mark.parametrize("n", [13, 60])
def test_many_macros(n):
    opens = "".join(f"`ifdef A{k}\n if (1) begin\n`endif\n" for k in range(n))
    ends = "".join(f"`ifdef A{k}\n end\n`endif\n" for k in range(n))
    ports = "".join(f"`ifdef A{k}\n input a{k},\n`endif\n" for k in range(n)) + "input z"
    assert status("a.v", f"module m({ports});\n{opens} assign x = 1;\n{ends}endmodule") == "ok"
    assert status("a.v", f"module m({ports});\n{opens} assign x = 1;\n{ends.replace('A1\n', 'B\n')}endmodule") == "failed"
    assert status("a.v", "module m;\n" + opens + " assign x = 1;\n`undef A1\n" + ends + "endmodule") == "failed"


SPECIFY = "module m(input a, c, output q);\nspecify\n specparam t = 1:2:3, PATHPULSE$a$q = (1, 2);\n (a => q) = (t, 2);\n if (c) (posedge a *> (q +: c)) = 3;\n ifnone (a, c *> q) = 1;\n $setup(c, posedge a &&& c, t);\nendspecify\nendmodule"
PRIMITIVE = "primitive p(output reg q, input a, b);\n initial q = 1'b0;\n table\n  0 1 : ? : 0;\n  (01) * : 0 : 1;\n  r ? : x : -;\n endtable\nendprimitive"
CLASS = "class c;\n rand int x, y[];\n constraint k { soft x inside {[1:4], 7}; x dist {1 := 2, [2:3] :/ 4}; if (x > 1) { y.size() == x; } else y.size() < 9; x == 1 -> { y[0] == 2; } foreach (y[i]) y[i] > 0; solve x before y; unique {x, y}; }\n extern function void f(int a);\n pure virtual task g();\n function int h(); return this.randomize() with { x > local::x; }; endfunction\nendclass"
COVER = "module m;\n covergroup g(int n) @(posedge c iff e);\n  option.weight = 2;\n  A: coverpoint x iff (e) { bins lo[] = {[0:3]}; wildcard bins w = {4'b1?}; illegal_bins bad = {9}; bins t = (0 => 1[*2] => 2), (3 => 4); bins d = default; }\n  B: coverpoint y;\n  AB: cross A, B { ignore_bins z = binsof(A.lo) intersect {1} && !binsof(B); }\n endgroup : g\nendmodule"
PROPERTY = "module m;\n property p(a, b);\n  int v;\n  @(posedge clk) disable iff (!rst) (a, v = b) ##[1:$] b[*2] |-> not (a and ##1 b[->1]) or s_eventually a;\n endproperty\n sequence s; a ##1 (b throughout c[=2]) within first_match(a ##[*] b); endsequence\n assert property (@(posedge clk) a |=> p(a, b) until $past(a, 1)) else $error(\"x\");\n cover property (if (a) b else c #-# d);\nendmodule"
CLOCKING = "module m;\n clocking cb @(posedge clk);\n  default input #1step output negedge;\n  input a, b = c;\n  output #2 d;\n endclocking\n default clocking e @(posedge clk); endclocking\n default disable iff (rst);\n let mx(a, b = 1) = a > b ? a : b;\n initial begin wait_order(a, b) x = 1; else x = 2; randcase 1: x = 1; x + 2: begin end endcase end\nendmodule"
EXTERN = "package p; export *::*; export q::a, r::*; endpackage\nextern module m #(parameter W = 1) (input [W-1:0] a);\nextern primitive u(output q, input a);\ninterface i; extern forkjoin task t(int a); endinterface"
SWALLOWED = [("a.v", SPECIFY, "(a => q)"), ("a.sv", SPECIFY, "ifnone (a"), ("a.v", PRIMITIVE, "0 1 :"), ("a.sv", PRIMITIVE, "(01) *"), ("a.sv", CLASS, "x inside"), ("a.sv", CLASS, "foreach (y"), ("a.sv", CLASS, "int a"), ("a.sv", CLASS, "x > local"), ("a.sv", COVER, "[0:3]"), ("a.sv", COVER, "B: cover"),
             ("a.sv", COVER, "binsof(A"), ("a.sv", PROPERTY, "b[*2]"), ("a.sv", PROPERTY, "(b through"), ("a.sv", PROPERTY, "p(a, b) until"), ("a.sv", CLOCKING, "input a"), ("a.sv", CLOCKING, "iff (rst)"), ("a.sv", CLOCKING, "a > b ?"), ("a.sv", CLOCKING, "a, b) x"), ("a.sv", CLOCKING, "x + 2:"), ("a.sv", EXTERN, "q::a"), ("a.sv", EXTERN, "parameter W"), ("a.sv", EXTERN, "int a")]


@pytest.mark.parametrize(("path", "text", "at"), SWALLOWED)
def test_bodies_are_parsed(path, text, at):
    assert text.count(at) == 1 and check_text(path, text)[1:] == ("ok", -1, "")
    for bad in ("\n<<<<<<< HEAD\n", "(", "; ) "):
        assert status(path, text.replace(at, bad + at)) in ("failed", "truncated"), bad


def test_patterns():
    assert status("a.py", "match x:\n    case [1, *_] | {'a': b} if b:\n        pass\n") == "ok"
    assert status("a.py", "match x:\n    case <<<<<<< 1:\n        pass\n") == "failed"


def test_failing_token():
    assert check_text("a.v", "module m; assign = 3; endmodule")[1:] == ("failed", 4, "=")


PY = ["x = lambda a, b=2, *c, **d: (yield)", "a, *b = 1, 2", "with open(x) as f, g() as h: pass", "@d\nclass A(B, k=1):\n  x: int", "try:\n  a\nexcept* E as e:\n  b\nfinally:\n  c", "print(*a, **b)", "f(a for a in b)", "x[1:2, ::3]", "a = b = c", "a += 1",
      "for i in x, y:\n  break\nelse:\n  pass", "del a[0], b.c", "x if y else z", "not a in b is not c", "(a := 1)", "from . import x", "from .a import (b as c,)", "raise E from e", "global a", "assert a, b", "1 +", "f(a=1, b)", "def f(a, a.b): pass", "x = = 1", "a b", "[1, 2", "return", "{1: 2, 3}", "'abc", "if a\n  b", "else:\n  x", "\tx\n y"]


@pytest.mark.parametrize("text", PY)
def test_python_as_interpreter(text):
    try:
        ast.parse(text)
        ok = True
    except SyntaxError:
        ok = False
    assert (status("a.py", text) == "ok") is ok


@pytest.mark.parametrize("text", ["[]", "[1,2]", "[1 2]", '{"a"}', "01", "-", "tru", '"\t"', '"\\x"', "[[[[]]]]", "1.", " 3 "])
def test_json_as_library(text):
    try:
        json.loads(text)
        ok = True
    except ValueError:
        ok = False
    assert (status("a.json", text) == "ok") is ok


def test_frame(spark):
    df = spark.createDataFrame([(1, None, "a.v", "module m;", "z"), (1, None, "a.v", "module m;", "z"), (2, "r", None, None, None)], "module_id long, repo string, rtl_path string, verilog string, status string")
    assert sorted(r["status"] for r in check_files(df).collect()) == ["none", "truncated", "truncated"]


def test_deep_nesting():
    assert status("a.json", "[" * 5000 + "]" * 5000) == "ok"
    assert status("a.v", "module m; initial " + "if (1) " * 400 + ";" + " else ;" * 400 + " endmodule") == "ok"
