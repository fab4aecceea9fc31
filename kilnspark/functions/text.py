"""Column expressions over text, with the semantics of the usual string methods of Python.

All of these are built-in expressions and stay inside generated code.  Null in,
null out, unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as ``str.strip`` knows it, as the inside of a character class of Java and RE2.
WS = r"\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# Unicode word characters; ``\w`` itself is ASCII in Java.
WORD = r"[\p{L}\p{N}_]+"

# Markers of an answer that declines.
REFUSAL_MARKERS = ["i give up", "i cannot", "i'm sorry", "as an ai", "i apologize", "unable to generate", "not able to"]
# Compiler messages that still earn a partial reward, and those that earn none.
SOFT_MARKERS = [
    "is not a net", "non-continuous assignment", "explicit cast required", "is not a constant", "out of range", "unknown port", "port mismatch",
    "wrong number of ports", "unable to bind", "implicit definition",
]
HARD_MARKERS = ["unknown module type", "no such file or directory"]
# Words that tell nothing about a cause.
CAUSE_STOPWORDS = [
    "the", "and", "for", "is", "in", "to", "of", "a", "an", "this", "that", "when", "which", "with", "from", "not", "are", "be", "has", "have",
    "should", "output", "input", "signal", "module", "always", "block", "register", "logic",
]
# Marks of simulation code.
SIM_TASKS = ["$write", "$display", "$finish", "$stop", "$monitor", "$dumpfile", "$dumpvars", "$readmem", "$strobe"]
SIM_PATTERNS = [r"\binitial\s+begin\b", r"\bfork\b", r"\binteger\s+cyc\b"]
SIM_HEADERS = ["placed into the Public Domain", "DESCRIPTION: Verilator"]


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode white space included."""
    return F.regexp_replace(c, rf"^[{WS}]+|[{WS}]+$", "")


def is_blank(c: Column) -> Column:
    """True for null and for white space only."""
    return c.isNull() | (F.length(strip(c)) == 0)


def first_filled(*cs: Column) -> Column:
    """The first column that is neither null nor empty, '' if none is."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))


def tokens(c: Column) -> Column:
    """Distinct lower-cased Unicode words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token arrays; 0.0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def cause_words(c: Column) -> Column:
    """Identifier-like words of a diagnosis without stop words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"\b([a-z_][a-z0-9_]{2,})\b"), F.lit(1)))
    return F.array_except(words, F.array(*[F.lit(w) for w in CAUSE_STOPWORDS]))


def same_cause(a: Column, b: Column) -> Column:
    """At least three cause words in common, and more than 0.4 of the larger set."""
    x, y = cause_words(a), cause_words(b)
    both = F.size(F.array_intersect(x, y))
    ok = (both >= 3) & (both / F.greatest(F.size(x), F.size(y), F.lit(1)) > 0.4)
    return F.coalesce((F.length(a) > 0) & (F.length(b) > 0) & ok, F.lit(False))


def contains_any(c: Column, words: list[str]) -> Column:
    """Whether the text holds any of the literal words."""
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def fence(c: Column) -> Column:
    """Body of the first fenced block of hardware code or without a tag, stripped; else the whole text stripped."""
    rx = r"(?s)```(?:verilog|systemverilog|sv)?\s*\n(.*?)```"
    return strip(F.when(c.rlike(rx), F.regexp_extract(c, rx, 1)).otherwise(c))


# How code stands in an answer.
TAGGED = r"(?is)```(?:verilog|systemverilog|sv)\n(.*?)```"
UNTAGGED = r"(?is)```\n(.*?(?:module|endmodule).*?)```"
BARE = r"(?s)((?:^|\n)(?:`timescale\s+\S+|module\s+\w+).*?endmodule)"


def code_of(c: Column, bare: bool = False) -> Column:
    """Code of an answer: a tagged fence, else an untagged one with a module, else (``bare``) a module outside fences, else the whole text."""
    out = F.when(c.rlike(TAGGED), F.regexp_extract(c, TAGGED, 1)).when(c.rlike(UNTAGGED), F.regexp_extract(c, UNTAGGED, 1))
    if bare:
        out = out.when(c.rlike(BARE), F.regexp_extract(c, BARE, 1))
    return strip(out.otherwise(c))


def lines(c: Column) -> Column:
    """Lines as ``str.splitlines`` gives them for CR, LF and CRLF: no empty last line."""
    parts = F.split(F.regexp_replace(c, r"(\r\n|\n|\r)$", ""), r"\r\n|\n|\r", -1)
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(parts)


def failed_tests(c: Column, most: int = 5) -> Column:
    """Names of failed tests, each once, in order of appearance."""
    return F.slice(F.array_distinct(F.regexp_extract_all(c, F.lit(r"FAILED\s+[\w./]+::(\w+)"), F.lit(1))), 1, most)


def mismatches(c: Column, most: int | None = 5, longest: int | None = 80) -> Column:
    """Expected and actual values of 'expected X, got Y' messages."""
    reach = f"{{1,{longest}}}" if longest else "+"
    rx = F.lit(rf"(?i)expected\s+([^\n,]{reach}),?\s*got:?\s*([^\n]{reach})")
    pairs = F.arrays_zip(F.regexp_extract_all(c, rx, F.lit(1)).alias("e"), F.regexp_extract_all(c, rx, F.lit(2)).alias("a"))
    out = F.transform(pairs, lambda p: F.struct(strip(p["e"]).alias("expected"), strip(p["a"]).alias("actual")))
    return F.slice(out, 1, most) if most else out


def unequal_asserts(c: Column) -> Column:
    """Sides of ``assert a == b`` that differ."""
    rx = F.lit(r"assert\s+(.+?)\s*==\s*(.+)")
    pairs = F.arrays_zip(F.regexp_extract_all(c, rx, F.lit(1)).alias("l"), F.regexp_extract_all(c, rx, F.lit(2)).alias("r"))
    out = F.transform(pairs, lambda p: F.struct(strip(p["r"]).alias("expected"), strip(p["l"]).alias("actual")))
    return F.filter(out, lambda p: p["expected"] != p["actual"])


def compile_errors(c: Column, most: int = 5) -> Column:
    """File (without folders), line, kind and message of compiler messages."""
    rx = F.lit(r"(\S+\.(?:sv|v)):(\d+):\s*(error|warning):\s*(.+)")
    col = lambda g, n: F.regexp_extract_all(c, rx, F.lit(g)).alias(n)
    rows = F.arrays_zip(col(1, "f"), col(2, "n"), col(3, "k"), col(4, "m"))
    out = F.transform(
        rows,
        lambda r: F.struct(
            basename(r["f"]).alias("file"), r["n"].cast("int").alias("line"), r["k"].alias("type"), strip(r["m"]).alias("message")
        ),
    )
    return F.slice(out, 1, most)


def error_lines(c: Column, file_name: Column | None = None, most: int = 5, head: int = 400) -> Column:
    """First lines that name an error or warning, what precedes the file's name cut; else the head of the text."""
    hit = F.filter(lines(c), lambda x: F.lower(x).contains("error") | F.lower(x).contains("warning"))
    cut = (lambda x: F.when(F.instr(x, file_name) > 1, F.substring(x, F.instr(x, file_name), F.length(x))).otherwise(x)) if file_name is not None else (lambda x: x)
    kept = F.transform(F.slice(hit, 1, most), lambda x: strip(cut(x)))
    return F.when(F.size(hit) > 0, F.array_join(kept, "\n")).otherwise(F.left(c, F.lit(head)))


# Words of warnings about timing.
TIMING_WORDS = ["glitch", "setup", "hold", "timing", "clock"]


def timing_lines(c: Column, most: int = 3) -> Column:
    """Warning lines about timing."""
    hit = F.filter(lines(c), lambda x: x.contains("WARNING") & contains_any(F.lower(x), TIMING_WORDS))
    return F.transform(F.slice(hit, 1, most), strip)


def context_lines(c: Column, around: int = 2, most: int = 4) -> Column:
    """Lines about assertions, each with its neighbours."""
    ls = lines(c)
    is_hit = lambda x: x.contains("AssertionError") | (F.lower(x).contains("assert ") & x.contains("=="))
    at = F.filter(F.transform(ls, lambda x, i: F.when(is_hit(x), i)), lambda i: i.isNotNull())
    take = lambda i: F.array_join(F.slice(ls, F.greatest(i - around, F.lit(0)) + 1, i + around - F.greatest(i - around, F.lit(0)) + 1), "\n")
    return F.transform(F.slice(at, 1, most), take)


def section(c: Column, title: str, until: str | None = None) -> Column:
    """Text below a heading up to the next one named, stripped; '' if the heading is missing."""
    end = rf"(?=\Q{until}\E|\z)" if until else r"\z"
    return strip(F.regexp_extract(c, rf"(?s)\Q{title}\E\s*\n(.+?){end}", 1))


def score_of(c: Column) -> Column:
    """First digit from 1 to 5; null if there is none."""
    return F.nullif(F.regexp_extract(c, "([1-5])", 1), F.lit("")).cast("int")


def key_base(c: Column) -> Column:
    """Key without its part after the last underscore."""
    return F.regexp_replace(c, r"_[^_]*$", "")


def key_number(c: Column) -> Column:
    """Number after the last underscore, 1 if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"_([0-9]+)$", 1), F.lit("")).try_cast("int"), F.lit(1))


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def env_map(c: Column) -> Column:
    """Settings ``KEY = value`` of a text, comment lines left out; the last of a key wins."""
    rows = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x.contains("=") & ~x.startswith("#"))
    pair = lambda x: F.struct(strip(F.substring_index(x, "=", 1)).alias("key"), strip(F.substring(x, F.instr(x, "=") + 1, F.length(x))).alias("value"))
    entries = F.transform(rows, pair)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def toplevel(c: Column) -> Column:
    """Value of the first line that starts with TOPLEVEL and has no LANG; '' if none."""
    hit = F.filter(F.split(c, r"\r?\n"), lambda x: x.startswith("TOPLEVEL") & ~x.contains("LANG"))
    first = F.try_element_at(hit, F.lit(1))
    return F.coalesce(strip(F.substring(first, F.instr(first, "=") + 1, F.length(first))), F.lit(""))


def pick_test(files: Column, longest: int = 3000) -> Column:
    """From a map of files the first test without 'runner' in its name, else the first test, cut to ``longest``; '' if none."""
    tests = F.filter(F.map_entries(files), lambda e: e["key"].startswith("src/test_") & e["key"].endswith(".py"))
    own = F.filter(tests, lambda e: ~e["key"].contains("runner"))
    picked = F.coalesce(F.try_element_at(own, F.lit(1))["value"], F.try_element_at(tests, F.lit(1))["value"], F.lit(""))
    return F.left(picked, F.lit(longest))


def quote_json_words(c: Column) -> Column:
    """JSON text with its bare keys and bare word values put in quotes."""
    keys = F.regexp_replace(c, r"([{,]\s*)([A-Za-z_]\w*)(\s*:)", '$1"$2"$3')
    return F.regexp_replace(keys, r"(:\s*)(?!(?:true|false|null)\b)([A-Za-z_][\w ./-]*?)(\s*[,}])", '$1"$2"$3')
