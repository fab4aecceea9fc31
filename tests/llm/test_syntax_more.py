import ast
import pathlib
import random
import textwrap
import warnings

import pytest

from kilnspark.llm.syntax import check_text, invalid_rates

warnings.simplefilter("ignore")


def status(path, text):
    return check_text(path, text)[1]


def parses(text):
    try:
        ast.parse(text)
        return True
    except (SyntaxError, ValueError):
        return False


PY = [
    "@a.b[c](d)\n@e\nasync def f(a, /, b: int = 1, *, c, **d) -> x: pass", "(a, b) += 1", "def f(a=1, b): pass", "def f(*): pass", "f(**a, *b)", "f(a)(b)[c].d: int = 1", "x = y := 1", "[a for b in c if d if e]", "[a for b in c if d if e else f]",
    "match = 1\nmatch(a, b)\nmatch[0]", "match (a, *b):\n case A.b | -1 | C(1, d=_) as e: x\n case {**k}: y", "match a:\n case b+c: x", "type X[T: int, *U] = V", "f'{a!r:>{w}.{p}}{b=}{{}}'", "f'{a['x']}'", "f'{a'", "f'}'", "f'{a b}'", "f'{}'",
    "f'''{\na #x\n}'''", "rf'\\d{a}'", "b'a' 'b'", "b'\\x4'", "'\\N{DIGIT ONE}\\u12'", "'\\N{no such}'", "1if a else 2", "0777", "1_0.e3j", "1__0", "import a.b as c, d", "from .... import *", "except a: b", "try: a\nexcept b: c\nexcept* d: e",
    "with (a as b, c): d", "return *a, b", "print 1", "lambda a=1, /, *b: c", "lambda a=1, b: c", "x[a:=1, *b]", "(*a)", "(*a,)", "del (a, b), c", "a <> b", "async for a in b: c", "await a ** -b", "if a: b; c\nelif d: e", "x = '''a\nb'''; y", "a \\\n + b", "a \\",
]


@pytest.mark.parametrize("text", PY)
def test_python_as_interpreter(text):
    assert (status("a.py", text) == "ok") is parses(text)


def test_python_library_and_pieces_of_it():
    """Whole files of the standard library, and pieces of them with a character more or less."""
    r, n = random.Random(4), 0
    for f in sorted(pathlib.Path(ast.__file__).parent.glob("*.py"))[::12]:
        text = f.read_text("utf-8")
        assert status("a.py", text) == "ok", f
        lines = text.split("\n")
        for _ in range(12):
            i = r.randrange(len(lines))
            piece = textwrap.dedent("\n".join(lines[i : i + r.randint(3, 30)]))
            k = r.randrange(len(piece) + 1)
            piece = piece[:k] + r.choice(["", *"()[]{}:,=.*'\"@\n", " if ", " as "]) + piece[k + r.randrange(2) :]
            assert (status("a.py", piece) == "ok") is parses(piece), piece
            n += 1
    assert n > 100


USE = "module m; wire x `T ; endmodule\n"
MAX = "`define MAX(a, b = 0) ((a) > (b) ? (a) : (b)%s\nmodule m(input [3:0] p, q, output [3:0] y); assign y = `MAX(p, {q[1:0], 2'b0}) + `MAX(`MAX(p, q)); endmodule"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("`ifdef A\n`define T (\n`else\n`define T\n`endif\n" + USE, "failed"),
        ("`ifdef A\n`define T\n`else\n`define T (\n`endif\n" + USE, "failed"),
        ("`ifdef A\n`define T\n`else\n`define T , y\n`endif\n" + USE, "ok"),
        ("`ifdef A\n`define T (\n`endif\n`ifndef A\n" + USE + "`endif\n", "ok"),
        ("`define W 8\n`define MSB (`W-1)\nmodule m; wire [`MSB:0] x; endmodule", "ok"),
        ("`define W 8)\n`define MSB (`W-1)\nmodule m; wire [`MSB:0] x; endmodule", "failed"),
        (MAX % ")", "ok"),
        (MAX % "", "failed"),
        ("`define E begin\n`undef E\n`define E end\nmodule m; initial begin `E endmodule", "ok"),
        ("`define E `E\nmodule m; initial `E; endmodule", "failed"),
        ("".join(f"`ifdef A{i}\n`define T{i} 3\n`else\n`define T{i} x[1]\n`endif\n" for i in range(40)) + "module m; assign y = " + "+".join(f"`T{i}" for i in range(40)) + "; endmodule", "ok"),
    ],
)
def test_macro_bodies_belong_to_configurations(text, want):
    assert status("a.v", text) == want


def test_rates(spark):
    rows = [(1, "r", "a.v", "module m;", 1), (1, "r", "a.v", "module m;", 1), (2, "r", "b.V", "module m; endmodule", 1), (3, None, "a.json", "[1 2]", 1), (4, "r", "x.v", " ", 1), (5, "r", "c.v", "assign", 1)]
    df = spark.createDataFrame(rows, "module_id long, repo string, rtl_path string, verilog string, n_files int")
    assert {tuple(x) for x in invalid_rates(df).collect()} == {("r", "verilog", 3, 2, 1, 0.666667), (None, "json", 1, 1, 0, 1.0)}
