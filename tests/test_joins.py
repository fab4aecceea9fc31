import random

from kilnspark.operators import filters, joins
from kilnspark.sources import files, tables


def words(t):
    return set((t or "").lower().split())


def tables_of(spark, seed=3):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(40)] + ["the"] * 30
    left = [(i, r.choice([None, "", " ".join(r.choice(vocab) for _ in range(r.randint(1, 30)))]), "x") for i in range(300)]
    right = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(1, 30)))) for i in range(25)] + [(90, None), (91, "")]
    return left, right, spark.createDataFrame(left, "id long, text string, tok string"), spark.createDataFrame(right, "rid long, prompt string")


def test_similarity_carried_and_joined(spark):
    left, right, L, R = tables_of(spark)
    best = lambda t: max([len(words(t) & words(p)) / len(words(t) | words(p)) for _, p in right if words(t) & words(p)], default=0.0)
    want = {i: round(best(t), 6) for i, t, _ in left}
    assert {r["id"]: r["max_similarity"] for r in joins.max_similarity(L, R, "id", "text", "rid", "prompt", ["tok"]).collect()} == want
    assert {r["id"]: r["max_similarity"] for r in joins.joined_similarity(L, R, "id", "text", "rid", "prompt", ["tok"]).collect()} == want


def test_large_right_side_is_joined(spark, monkeypatch):
    _, _, L, R = tables_of(spark)
    want = {tuple(r) for r in joins.max_similarity(L, R, "id", "text", "rid", "prompt").collect()}
    monkeypatch.setattr(joins, "CARRIED_TOKENS", 10)
    got = joins.max_similarity(L, R, "id", "text", "rid", "prompt")
    assert {tuple(r) for r in got.collect()} == want


def test_empty_sides(spark):
    _, _, L, R = tables_of(spark)
    assert {r["max_similarity"] for r in joins.max_similarity(L, R.limit(0), "id", "text", "rid", "prompt").collect()} == {0.0}
    assert joins.max_similarity(L.limit(0), R, "id", "text", "rid", "prompt").count() == 0
    assert joins.exact_then_contained(L, R.limit(0), "id", "text", "rid", "prompt").count() == 0


def test_exact_then_contained_in_blocks(spark, monkeypatch):
    r = random.Random(8)
    make = lambda n: "".join(r.choice("ab ") for _ in range(n))
    probe = [(i, make(r.randint(0, 25)) or None) for i in range(200)]
    known = [(i, make(r.randint(1, 7))) for i in range(40)] + [(70, probe[3][1]), (71, None), (72, "")]
    want = set()
    for p, t in probe:
        same, inside = [k for k, x in known if t and x == t], [k for k, x in known if t and x and x in t]
        if same or inside:
            want.add((p, min(same or inside), "exact" if same else "contained"))
    P, K = spark.createDataFrame(probe, "id long, text string"), spark.createDataFrame(known, "k long, kt string")
    for chars in (joins.CARRIED_CHARS, 30):
        monkeypatch.setattr(joins, "CARRIED_CHARS", chars)
        assert {tuple(x) for x in joins.exact_then_contained(P, K, "id", "text", "k", "kt").collect()} == want


def test_first_rows(spark):
    df = spark.createDataFrame([(1, "b", 2, None), (1, "a", 9, "x"), (1, "a", 3, None), (2, None, None, "y")], "k long, path string, pos int, v string")
    assert {tuple(r) for r in files.merge_first(df, "k", "path", "pos").collect()} == {(1, "a", 3, None), (2, None, None, "y")}
    assert {tuple(r) for r in joins.first_by_priority(df, ["k"], [df["pos"]]).collect()} == {(1, "b", 2, None), (2, None, None, "y")}


def test_once_and_funnel(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 1.0), (2, None, 2.0), (3, "ab", None)], "id long, t string, x double")
    assert {tuple(r) for r in tables.once(df, "id", "t").collect()} == {(1, "a"), (2, None), (3, "ab")}
    got = filters.funnel(df, "id", {"all": df["id"] > 0, "text": df["t"].isNotNull(), "b": df["t"].contains("b")})
    assert [tuple(r) for r in got.orderBy("stage_no").collect()] == [(0, "all", 3), (1, "text", 2), (2, "b", 1)]


def test_flt_size_reads_and_shuffles_no_text(spark):
    from kilnspark.plans import registry

    plan = registry.QUERIES["flt_size"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    exchange = [line for line in plan.splitlines() if "Exchange" in line or "Sort" in line]
    assert exchange and not any("verilog" in line for line in exchange)
