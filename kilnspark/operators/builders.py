"""Training samples: chat messages, injected faults, masked code and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kilnspark.functions import text as T


def turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def fenced(code: Column) -> Column:
    return F.concat(F.lit("```verilog\n"), code, F.lit("\n```"))


def sample(user: Column, assistant: Column) -> Column:
    return F.array(turn("user", user), turn("assistant", assistant))


def sections(intro: str, *parts: tuple[str, Column | None]) -> Column:
    """A prompt of an introduction and titled sections; a null part is left out with its title."""
    cols = [F.lit(intro)]
    for title, body in parts:
        if body is not None:
            cols.append(F.when(body.isNotNull(), F.concat(F.lit(f"## {title}\n"), body)))
    return F.concat_ws("\n\n", *cols)


def rendered(messages: Column) -> Column:
    """One templated string of a chat."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), F.coalesce(m["content"], F.lit("")), F.lit("\n"))), "")


# ---- faults.  Each gives null where it does not apply, so a row's faults are those that are not null.


def flip_edge(c: Column) -> Column:
    """The first rising edge becomes a falling one."""
    return F.when(c.contains("posedge"), F.regexp_replace(c, r"(?s)\A(.*?)posedge", "$1negedge"))


BARE_COMPARISON = r"(?<![<>!])([<>])(?![=<>])"


def off_by_one(c: Column, pick: Column) -> Column:
    """One bare comparison also admits equality; ``pick`` (any number) chooses which."""
    rx = r"(?<![<>!])(?:[<>])(?![=<>])"
    parts = F.split(c, rx, -1)
    ops = F.regexp_extract_all(c, F.lit(BARE_COMPARISON), F.lit(1))
    at = F.pmod(pick, F.greatest(F.size(ops), F.lit(1))).cast("int")
    glued = F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(ops, i), F.lit("")), F.when(i == at, F.lit("=")).otherwise(F.lit("")))), "")
    return F.when(F.size(ops) > 0, glued)


def swap_operator(c: Column) -> Column:
    """The last bitwise and/or of the first assignment that has one turns into the other."""
    rx = r"(?s)\A(.*?assign\s+\w+\s*=\s*[^;]+)([&|])([^;]+;)"
    first = r"(?s)\A((?:(?!assign\s+\w+\s*=\s*[^;]+[&|][^;]+;).)*assign\s+\w+\s*=\s*[^;]+)"
    op = F.regexp_extract(c, first + r"([&|])([^;]+;)", 2)
    new = F.when(op == "&", "|").otherwise("&")
    head, tail = F.regexp_extract(c, first + r"[&|][^;]+;", 1), F.regexp_extract(c, first + r"[&|]([^;]+;.*)\z", 2)
    return F.when(c.rlike(rx), F.concat(head, new, tail))


# Fixed value: a branch on a reset and its lines.
RESET_BRANCH = r"if\s*\([^)]*rst[^)]*\)\s*\n(?:\s+[^\n]+\n)+"


def drop_reset(c: Column) -> Column:
    """The first branch on a reset goes, with the lines below it that begin with white space, blank lines between them included."""
    rx = rf"(?is)\A(.*?){RESET_BRANCH}"
    return F.when(c.rlike(rx), F.regexp_replace(c, rx, "$1"))


def drop_sensitivity(c: Column, pick: Column) -> Column:
    """One signal leaves the first sensitivity list that has several, separated by commas."""
    rx = r"(?s)\A(.*?always\s*@\s*\()([^)]+)(\).*)\z"
    names = F.transform(F.split(F.regexp_extract(c, rx, 2), ","), T.strip)
    at = F.pmod(pick, F.greatest(F.size(names), F.lit(1))).cast("int")
    rest = F.array_join(F.filter(names, lambda x, i: i != at), ", ")
    return F.when(c.rlike(rx) & (F.size(names) >= 2), F.concat(F.regexp_extract(c, rx, 1), rest, F.regexp_extract(c, rx, 3)))


def swap_states(c: Column, pick: Column) -> Column:
    """Two different next states trade places; ``pick`` chooses which; null where there are fewer than two or both are equal."""
    rx = r"(next_state\s*(?:<=|=)\s*)(\w+)(\s*;)"
    heads, names, tails = (F.regexp_extract_all(c, F.lit(rx), F.lit(k)) for k in (1, 2, 3))
    between = F.split(c, r"next_state\s*(?:<=|=)\s*\w+\s*;", -1)
    n = F.size(names)
    i = F.pmod(F.xxhash64(pick, F.lit(1)), F.greatest(n, F.lit(1))).cast("int")
    j = F.pmod(i + 1 + F.pmod(F.xxhash64(pick, F.lit(2)), F.greatest(n - 1, F.lit(1))).cast("int"), F.greatest(n, F.lit(1)))
    name = lambda k: F.get(names, F.when(k == i, j).when(k == j, i).otherwise(k))
    glued = F.array_join(F.transform(between, lambda x, k: F.concat(x, F.coalesce(F.concat(F.get(heads, k), name(k), F.get(tails, k)), F.lit("")))), "")
    return F.when((n >= 2) & (F.get(names, i) != F.get(names, j)), glued)


def faults(c: Column, pick: Column) -> Column:
    """Array of (kind, code) of all faults that apply and change the text."""
    made = {"posedge negedge": flip_edge(c), "off by one": off_by_one(c, pick), "wrong operator": swap_operator(c), "missing reset": drop_reset(c), "wrong state transition": swap_states(c, pick), "always sensitivity": drop_sensitivity(c, pick)}
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("code")) for k, v in made.items()])
    return F.filter(rows, lambda r: r["code"].isNotNull() & (r["code"] != c))


def chosen(rows: Column, pick: Column) -> Column:
    """One of an array's elements, null of an empty one."""
    return F.get(rows, F.pmod(pick, F.greatest(F.size(rows), F.lit(1))).cast("int"))


# ---- masks.  Fixed values: the notes that stand for what was taken out.


def mask_block(c: Column) -> Column:
    """The body of the first clocked or combinational block becomes a note; bodies under 20 characters stay.

    The head reaches to the last ``begin`` before the first semicolon, the body to the first line with ``end``.
    """
    rx = r"(?smd)\A(.*?always\s*@[^;]+begin\s*\n)(.*?)(^\s*end.*)\z"
    body = F.regexp_extract(c, rx, 2)
    return F.when(c.rlike(rx) & (F.length(T.strip(body)) >= 20), F.concat(F.regexp_extract(c, rx, 1), F.lit("    // TODO: implement this always block\n"), F.regexp_extract(c, rx, 3)))


def mask_assigns(c: Column, seed: Column) -> Column:
    """The values of half of the assignments (at least one) become a note; fewer than two stay."""
    rx = r"(assign\s+\w+\s*=\s*)([^;]+)(?=;)"
    heads = F.regexp_extract_all(c, F.lit(rx), F.lit(1))
    values = F.regexp_extract_all(c, F.lit(rx), F.lit(2))
    between = F.split(c, r"assign\s+\w+\s*=\s*[^;]+(?=;)", -1)
    n = F.size(heads)
    drawn = F.slice(F.transform(F.array_sort(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.md5(F.concat_ws(":", seed.cast("string"), i.cast("string"))).alias("o"), i.alias("i")))), lambda s: s["i"]), 1, F.greatest(F.lit(1), F.floor(n / 2).cast("int")))
    glue = F.array_join(F.transform(between, lambda b, i: F.concat(b, F.coalesce(F.get(heads, i), F.lit("")), F.when(F.array_contains(drawn, i), F.lit("/* TODO */")).otherwise(F.coalesce(F.get(values, i), F.lit(""))))), "")
    return F.when(n >= 2, glue)


def mask_module(c: Column) -> Column:
    """All between a module's header and its end becomes a note; insides under 50 characters stay."""
    rx = r"(?s)\A(.*?module\s+\w+[^;]+;)(.*?)(endmodule.*)\z"
    return F.when(c.rlike(rx) & (F.length(T.strip(F.regexp_extract(c, rx, 2))) >= 50), F.concat(F.regexp_extract(c, rx, 1), F.lit("\n\n// TODO: implement module logic\n\n"), F.regexp_extract(c, rx, 3)))


def masked(c: Column, seed: Column) -> Column:
    """(kind, code) of the first mask, in an order drawn by the seed, that changes the text; null if none does."""
    made = {"always": mask_block(c), "assign": mask_assigns(c, seed), "module": mask_module(c)}
    order = lambda k: F.md5(F.concat_ws(":", seed.cast("string"), F.lit(k)))
    rows = F.array(*[F.struct(order(k).alias("o"), F.lit(k).alias("kind"), v.alias("code")) for k, v in made.items()])
    return F.get(F.array_sort(F.filter(rows, lambda r: r["code"].isNotNull() & (r["code"] != c))), F.lit(0))


def error_block(log: Column) -> Column:
    """Parsed errors as text: named parts, and the end of the log (2500 characters if nothing was parsed, else 1000)."""
    failed, mism, ctx, tim = T.failed_tests(log), T.mismatches(log), T.context_lines(log), T.timing_lines(log)
    nothing = (F.size(failed) == 0) & (F.size(mism) == 0) & (F.size(ctx) == 0) & (F.size(tim) == 0)
    block = lambda title, rows: F.when(F.size(rows) > 0, F.concat(F.lit(title), F.array_join(rows, "\n")))
    pairs = F.transform(mism, lambda m: F.concat(F.lit("  expected: "), m["expected"], F.lit("\n  actual:   "), m["actual"]))
    return F.concat_ws(
        "\n",
        F.when(F.size(failed) > 0, F.concat(F.lit("Failed tests: "), F.array_join(failed, ", "))),
        block("Value mismatches (expected vs actual):\n", pairs),
        block("Assertion failures (with context):\n", F.transform(ctx, lambda x: F.concat(F.lit("  "), F.replace(x, F.lit("\n"), F.lit("\n  "))))),
        block("Timing warnings:\n", F.transform(tim, lambda x: F.concat(F.lit("  "), x))),
        F.when(nothing, F.concat(F.lit("Full harness output (last 2500 chars):\n"), F.right(log, F.lit(2500)))).otherwise(
            F.concat(F.lit("\nRaw output tail (last 1000 chars):\n"), F.right(log, F.lit(1000)))
        ),
    )


def error_block_older(log: Column, stage: str) -> Column:
    """The older form: compiler messages first, the end of the log (1500 characters) only if neither these nor mismatches were found."""
    errs, failed = T.compile_errors(log), T.failed_tests(log)
    bad = F.slice(F.concat(T.mismatches(log, None, None), T.unequal_asserts(log)), 1, 5)
    said = F.slice(F.transform(F.filter(T.lines(T.strip(log)), lambda x: x.contains("AssertionError") | F.lower(x).contains("assert ")), T.strip), 1, 5)
    block = lambda title, rows: F.when(F.size(rows) > 0, F.concat(F.lit(title + "\n"), F.array_join(rows, "\n")))
    return F.concat_ws(
        "\n",
        F.lit(f"Stage: {stage}"),
        block("iverilog errors:", F.transform(errs, lambda e: F.concat(F.lit("  "), e["file"], F.lit(" line "), e["line"].cast("string"), F.lit(": "), e["type"], F.lit(": "), e["message"]))),
        F.when(F.size(failed) > 0, F.concat(F.lit("Failed tests: "), F.array_join(failed, ", "))),
        block("Value mismatches:", F.transform(bad, lambda m: F.concat(F.lit("  expected="), m["expected"], F.lit("  actual="), m["actual"]))),
        block("Assertion failures:", F.transform(said, lambda x: F.concat(F.lit("  "), x))),
        F.when((F.size(errs) == 0) & (F.size(bad) == 0), F.concat(F.lit("Raw error tail (last 1500 chars):\n"), F.right(F.right(T.strip(log), F.lit(2000)), F.lit(1500)))),
    )
