import random
import re

import numpy as np

from kilnspark.llm import leak


def grams(t):
    w = re.findall(r"\w+", (t or "").lower())
    return {tuple(w[i : i + 13]) for i in range(len(w) - 12)}


def test_against_brute_force(spark):
    r = random.Random(5)
    words = ["the", "fifo", "Größe", "rd_ptr", "12", "ns", "7", "clk"] + [f"v{k}" for k in range(30)]
    items = [(i, " ".join(r.choice(words) for _ in range(40))) for i in range(12)] + [(50, None), (51, "short one")]
    docs = []
    for d in range(150):
        t = [r.choice(words) for _ in range(r.randint(0, 50))]
        if d % 3 == 0:
            src = items[r.randrange(12)][1].upper().split()
            n = r.randint(9, 18)
            at = r.randrange(len(src) - n)
            t[5:5] = src[at : at + n]
        docs.append((d, r.choice([" ", ", ", "\n"]).join(t) or None))
    D = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, words string")
    I = spark.createDataFrame(items, "item_id long, prompt string")  # noqa: E741
    want = {(d, i) for d, t in docs for i, p in items if grams(t) & grams(p)}
    assert {tuple(x) for x in leak.leaks(D, I).collect()} == want and want


def test_blocks_and_case(spark, monkeypatch):
    p = "The counter alpha_q must reach txCarryOut before the signal Kogge falls for 12 ns each time"
    items = [(k, p.replace("12", str(k))) for k in range(5)] + [(3, p.replace("12", "77"))]
    docs = [(1, p.upper().replace("12", "3")), (1, p.upper().replace("12", "3")), (2, p.lower().replace("12", "77")), (3, "`" + p.replace("12", "4").replace(" ", "` `") + "`"), (4, p.replace("12", "99"))]
    D, I = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, prompt string")  # noqa: E741
    want = {(d, i) for d, t in docs for i, q in items if grams(t) & grams(q)}
    for words, hits in ((leak.BLOCK_WORDS, leak.HITS), (20, leak.HITS), (leak.BLOCK_WORDS, 2)):
        monkeypatch.setattr(leak, "BLOCK_WORDS", words)
        monkeypatch.setattr(leak, "HITS", hits)
        got = [tuple(x) for x in leak.leaks(D, I).collect()]
        assert set(got) == want and len(got) == len(want)


PHRASES = [
    "Every write to {n} is mirrored into {n} unless the guard {n} has been low for {k} {u} in a row.",
    "The arbiter grants {n} before {n}, but after {k} lost rounds it lets {n} pass and clears the {w} counters.",
    "A parity fault on {n} moves the machine to the state {n}, from which only {n} leads back within {k} {u}.",
    "Samples of {n} are averaged over {k} {u} and the mean is handed to {n} together with the flag {n}.",
    "If {n} stays high for more than {k} {u}, the watchdog drops {n} and counts the event in {n}.",
    "The divider feeds {n} at a rate of {k} per {w} pulses, and {n} follows it with a delay set by {n}.",
]


def made(r, phrase, names=None):
    """A phrase with values of its own; with ``names`` a one-to-one change of the values of another."""
    stem = lambda: r.choice(["rx", "tx", "cfg", "mem", "aux"]) + r.choice(["_", "_x_", "_y_"]) + r.choice(["beat", "lap", "ring", "cell", "dose", "link"]) + str(r.randrange(900))
    out = re.sub(r"\{n\}", lambda _: stem(), phrase)
    out = re.sub(r"\{k\}", lambda _: str(r.randrange(2, 4000)), out)
    return re.sub(r"\{u\}", lambda _: r.choice(["ns", "cycles", "us"]), re.sub(r"\{w\}", lambda _: r.choice(["sixteen", "four", "32"]), out))


def changed(r, text):
    values = {}

    def other(m):
        w = m[0]
        if w not in values:
            values[w] = f"gen{r.randrange(10**6)}_v" if "_" in w else r.choice(["twelve", str(r.randrange(2, 4000))])
        return values[w]

    return re.sub(r"\b\w*_\w*\b|\b\d+\b|\bsixteen\b|\bfour\b", other, text)


def test_restated_recall_and_precision(spark):
    r = random.Random(12)
    items = [(i, " ".join(made(r, p) for p in r.sample(PHRASES, 5))) for i in range(40)]
    filler = ["The board was shipped with a new fan.", "Nobody has asked for a second clock so far.", "See the notes of the last meeting for the open points."]
    docs, want = [], set()
    for d in range(400):
        parts = [r.choice(filler) for _ in range(4)]
        kind = d % 4
        if kind == 0:  # three successive phrases of an item with other values
            i, p = r.choice(items)
            at = r.randrange(3)
            parts[2:2] = [changed(r, " ".join(re.split(r"(?<=\.) ", p)[at : at + 3]))]
            want.add((d, i))
        elif kind == 1:  # the same stock phrases with values of their own, in no item's order
            parts[2:2] = [made(r, r.choice(PHRASES))]
        elif kind == 2:  # a verbatim copy restates nothing
            parts[2:2] = [r.choice(items)[1]]
        docs.append((d, " ".join(parts)))
    D, I = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, prompt string")  # noqa: E741
    found = leak.restated(D, I).collect()
    got = {(x["doc_id"], x["item_id"]) for x in found}
    # items may begin with the same phrases in the same order; all of them are restated then
    order = lambda t: [k for s in re.split(r"(?<=\.) ", t) for k, p in enumerate(PHRASES) if s.startswith(p.split("{")[0])]
    held = {i: order(p) for i, p in items}
    right = {(d, i) for d, i in got if d % 4 == 0 and any(order(docs[d][1]) == held[i][k : k + 3] for k in range(3))}
    assert len(want & got) / len(want) >= 0.9
    assert len(right) / len(got) >= 0.9
    assert not any(x["verbatim"] for x in found)


def plain(r, n):
    """Words of their own, every fifth a name."""
    return " ".join("".join(r.choices("bcdfghjklmnpqrstvwxz", k=7)) + ("_" + r.choice("abc") if k % 5 == 3 else "") for k in range(n))


def test_restated_passage_of_many_items_or_of_part_of_one(spark):
    r = random.Random(3)
    many, part, twice, one, common, two, lone = (plain(r, n) for n in (60, 60, 29, 35, 31, 29, 40))
    own = lambda t: changed(r, t)
    items = [(k, plain(r, 20) + " " + many) for k in range(6)]  # the same passage
    items += [(k, own(many) + " " + plain(r, 20)) for k in range(10, 30)]  # with values of their own
    items += [(30, plain(r, 20) + " " + " ".join(many.split()[:40]) + " " + plain(r, 20))]  # a shorter part of it, word for word
    items += [(40, lone)] * 2 + [(k, lone) for k in range(41, 46)]  # copies
    items += [(50, part), (60, "first_a " + " ".join(twice.split()[:8]) + " first_a " + " ".join(twice.split()[8:]))]
    items += [(70, one + " " + common), (71, own(common) + " " + two)]
    docs = [
        (1, own(many)),
        (2, own(lone)),
        (3, " ".join(part.split()[:20]) + " " + own(" ".join(part.split()[20:]))),
        (4, "other_a " + " ".join(own(twice).split()[:8]) + " another_a " + own(" ".join(twice.split()[8:]))),
        (5, own(one + " " + common) + " " + own(two)),
    ]
    D, I = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, prompt string")  # noqa: E741
    got = leak.restated(D, I).collect()
    want = {(1, k) for k in [*range(6), *range(10, 31)]} | {(2, k) for k in range(40, 46)} | {(3, 50), (4, 60), (5, 70), (5, 71)}
    assert {(x["doc_id"], x["item_id"]) for x in got} == want and len(got) == len(want)
    assert {(x["doc_id"], x["item_id"]) for x in got if x["verbatim"]} == {(3, 50)}
    n = {(x["doc_id"], x["item_id"]): x["n_words"] for x in got}
    assert n[1, 0] == n[1, 10] == 60 and n[1, 30] == 40 and n[2, 45] == 40 and n[3, 50] == 37 and n[4, 60] == 30 and n[5, 70] == 66 and n[5, 71] == 29


def test_passages_by_brute_force():
    r = np.random.default_rng(4)
    for _ in range(50):
        stretches = [(int(r.integers(8)), int(r.integers(1, 6)), int(r.integers(3))) for _ in range(int(r.integers(1, 25)))]
        x = np.array([s + k for s, n, _ in stretches for k in range(n)])
        same = np.array([v * 100 + k for _, n, v in stretches for k in range(n)], dtype=np.uint64)
        first = np.cumsum([0] + [n for _, n, _ in stretches[:-1]])
        want = [min(len({o for o in stretches if o[0] <= at < o[0] + o[1] and o[1] >= n}) for at in range(s, s + n)) for s, n, _ in stretches]
        assert leak._passages(x, same, first).tolist() == want
    need = leak._least_length(np.array([1, 3, 4, 6, 48]))
    assert need.tolist() == [0, 0, 22, 24, 36]


def test_consistent_parts():
    s = leak._Slots()
    s.keep(["z_1"], ["y_1"])
    a, b = ["a_1", "is", "b_1", "a_1", "or", "z_1", "of", "it", "all"], ["c_1", "is", "d_1", "e_1", "or", "x_1", "of", "it", "all"]
    assert s.consistent(a, b, 3) == [(0, 3), (1, 5), (6, 9)]
    assert s.there == {"z_1": "y_1"}
    r = random.Random(7)
    words = ["a_1", "b_1", "c_1", "7", "8", "ns", "of", "the"]
    for _ in range(200):
        other = {w: r.choice(words) for w in words}
        a = [r.choice(words) for _ in range(r.randrange(20))]
        b = [other[w] if r.random() < 0.9 else r.choice(words) for w in a]

        def goes(at):
            t = leak._Slots()
            return all(t.take(a[k], b[k]) for k in at)

        spans = [range(i, j) for i in range(len(a)) for j in range(i + 3, len(a) + 1) if goes(range(i, j))]
        want = [(p.start, p.stop) for p in spans if not any(p != q and q.start <= p.start and p.stop <= q.stop for q in spans)]
        assert leak._Slots().consistent(a, b, 3) == want


def test_slots():
    s = leak._Slots()
    assert all(s.take(a, b) for a, b in [("a_1", "b_2"), ("7", "9"), ("a_1", "b_2"), ("8", "9")])
    assert not s.take("a_1", "c_3") and not s.take("c_3", "b_2")
    s.close(False)
    assert s.take("c_3", "b_2")


def test_canonical():
    t = leak.Templates.of(["Set `clk` and txCoef to 7 ns in a Johnson counter with data_q. The word data is plain, Data too."])
    kinds = {w: t.canonical(w) for w in ["clk", "CLK", "TXCOEF", "johnson", "sixteen", "hff", "ns", "data", "otherName", "plain", "`new"]}
    names = {"clk", "CLK", "TXCOEF", "johnson", "otherName", "`new"}
    assert {w for w, k in kinds.items() if k == "\x01name"} == names
    assert kinds["sixteen"] == "\x01number" and kinds["ns"] == "\x01unit" and kinds["data"] == "data"


def test_empty(spark):
    e = spark.createDataFrame([], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, prompt string")
    some = spark.createDataFrame([(1, "a " * 20)], "item_id long, prompt string")
    assert leak.leaks(e, none).count() == leak.leaks(e, some).count() == leak.restated(e, some).count() == 0
    assert leak.leaks(spark.createDataFrame([(1, "a " * 20)], "doc_id long, text string"), none).count() == 0


def test_items_without_a_leak_count(spark):
    found = spark.createDataFrame([(1, 5), (2, 5)], "doc_id long, item_id long")
    items = spark.createDataFrame([(5, "p", 0), (6, "q", 0)], "item_id long, problem_id string, doc_id long").drop("doc_id")
    assert {tuple(x) for x in leak.leaked_items(found, items).collect()} == {(5, "p", 2), (6, "q", 0)}
