import random

import numpy as np

from kilnspark.llm import neardup


def sets_of(t, n=3):
    import re

    w = re.findall("[a-z0-9_]+", (t or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(rows, num=7, den=10):
    s = {i: sets_of(t) for i, t in rows}
    return {(a, b) for a in s for b in s if a < b and s[a] and s[b] and den * len(s[a] & s[b]) >= num * len(s[a] | s[b])}


def test_against_brute_force(spark):
    r = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    rows, base = [], []
    for i in range(260):
        if base and r.random() < 0.6:
            t = list(r.choice(base))
            for _ in range(r.randint(0, 6)):
                t[r.randrange(len(t))] = r.choice(words)
        else:
            t = ["module", "input", "wire", *[r.choice(words) for _ in range(r.randint(3, 60))]]
            base.append(t)
        rows.append((i, r.choice([" ", "\n", " ; "]).join(t)))
    rows += [(900, None), (901, ""), (902, "a b"), (903, "one two three"), (904, "One  TWO three"), (905, "Ünï x y z" * 3)]
    rows += rows[:20]  # redelivered
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "module_id long, verilog string, id string")
    got = [tuple(x) for x in neardup.near_duplicates(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(dict(rows).items())


def test_shingles_match_words():
    texts = ["a b c d a b c", "x", None, "", "é a_b 1 É c", "K kelvin sign q"]
    got = [0 if s is None else len(s) for s in neardup.shingle_sets(texts, 3)]
    assert got == [len(sets_of(t)) for t in texts]


def test_bound_never_loses():
    r = np.random.default_rng(1)
    for _ in range(300):
        u = r.permutation(60)
        x, y = set(u[: r.integers(1, 50)].tolist()), set(r.permutation(60)[: r.integers(1, 50)].tolist())
        if 10 * len(x & y) < 7 * len(x | y):
            continue
        n, m = len(x), len(y)
        px, py = sorted(x)[: neardup.prefix_size(n, 7, 10)], sorted(y)[: neardup.prefix_size(m, 7, 10)]
        assert len(set(px) & set(py)) >= neardup.least_shared(n, m, 7, 10)


def test_large_group_and_empty(spark):
    df = spark.createDataFrame([(i, "a b c d e f g h i j k l " + " ".join(f"t{i % 150}" for _ in range(1))) for i in range(300)], "module_id long, verilog string")
    assert {tuple(x) for x in neardup.near_duplicates(df).collect()} == brute([(r["module_id"], r["verilog"]) for r in df.collect()])
    assert neardup.near_duplicates(spark.createDataFrame([], "module_id long, verilog string")).count() == 0


def test_links_of_every_module(spark):
    a = "a b c d e f g h i j k l m"
    rows = [(1, a), (2, a.upper()), (3, a + " n o"), (4, "x y z u v w"), (5, None), (6, "p q"), (7, a + " n o r s t"), (4, "x y z u v w")]
    got = {r["module_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in neardup.link_counts(spark.createDataFrame(rows, "module_id long, verilog string")).collect()}
    assert got == {1: (1, 1, 1), 2: (1, 1, 1), 3: (3, 2, 0), 4: (4, 0, 0), 5: (5, 0, 0), 6: (6, 0, 0), 7: (7, 1, 0)}


def test_many_copies_post_once_a_batch(spark):
    """A third of all rows are copies of one text: their postings hold as many sets as there are batches."""
    texts = [(i, "alpha beta gamma delta epsilon zeta eta theta iota " * 3 if i % 3 == 0 else " ".join(f"w{i}x{k}" for k in range(20))) for i in range(900)]
    df = spark.createDataFrame(texts, "id long, text string").coalesce(2)
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    posted = held = 0
    for r in neardup._postings(df, 3, 7, 10, none, 16).collect():
        docs = np.frombuffer(r["docs"], dtype=neardup.DOC)
        width = np.uint16 if len(r["owners"]) * 2 == len(r["hashes"]) else np.uint32
        owners = {int(docs["id"][k]) for k in np.frombuffer(r["owners"], dtype=width)}
        posted += sum(i % 3 == 0 for i in owners)
        held += int(((docs["id"] % 3 == 0) & (docs["home"] > 0)).sum())
    assert held == 300 and posted <= 2 * 9
    pairs = neardup.near_duplicates(df.withColumnRenamed("id", "module_id").withColumnRenamed("text", "verilog"))
    assert pairs.count() == 300 * 299 // 2
