import random

import pandas as pd
from pyspark.sql import functions as F

from kilnspark.operators import filters, windows


def table(spark):
    """One key with most rows, a null key, nulls among values."""
    r = random.Random(4)
    rows = []
    for i in range(600):
        k = r.choice(["hot"] * 6 + ["a", "b", None])
        rows.append((k, r.randrange(50), i, r.choice([None, f"v{i}"]), r.random() < 0.3, float(r.randrange(4))))
    return rows, spark.createDataFrame(rows, "k string, it int, id long, v string, ok boolean, x double")


def test_pieces_of_a_hot_key(spark):
    rows, df = table(spark)
    last, best = {}, {}
    for k in {r[0] for r in rows}:
        seen, top = [], None
        for _, _, i, v, ok, _ in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            last[i] = [x for x in seen[-3:] if x is not None]
            seen.append(v)
            top = v if ok and v is not None else top
            best[i] = top
    got = windows.with_last_k(df, ["k"], ["it", "id"], "v", "h").select("id", "h").collect()
    assert {r["id"]: r["h"] for r in got} == last and len(got) == len(rows)
    got = windows.with_best_so_far(df, ["k"], ["it", "id"], "v", "ok", "b").select("id", "b").collect()
    assert {r["id"]: r["b"] for r in got} == best and len(got) == len(rows)
    spread = windows.pieces(df, ["k"], ["it", "id"]).filter("k = 'hot'").select(windows.PIECE).distinct().count()
    assert spread > 1
    assert windows.with_last_k(df.limit(0), ["k"], ["it", "id"], "v", "h").count() == 0


def test_ordered_concat(spark):
    rows, df = table(spark)
    want = {k: ">".join(r[3] for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])) if r[3]) for k in {r[0] for r in rows}}
    assert {r["k"]: r["p"] for r in windows.ordered_concat(df, ["k"], ["it", "id"], "v", "p", ">").collect()} == want


def test_first_oscillation(spark):
    same, other = "the counter wraps before the enable falls", "some queue loses words at its upper bound"
    rows = [("p", 1, same), ("p", 2, None), ("p", 3, same), ("p", 4, same), ("q", 1, same), ("q", 2, other), ("q", 3, same), (None, 1, other), (None, 2, other)]
    df = spark.createDataFrame(rows, "k string, i int, d string")
    assert {(r["k"], r["i"]) for r in windows.first_oscillation(df, ["k"], ["i"], "d").collect()} == {("p", 3), (None, 2)}


def test_group_norm_of_null_key(spark):
    rows, df = table(spark)
    frame = pd.DataFrame(rows, columns=["k", "it", "id", "v", "ok", "x"])
    g = frame.groupby("k", dropna=False)["x"]
    want = dict(zip(frame["id"], ((frame["x"] - g.transform("mean")) / (g.transform(lambda s: s.std(ddof=0)) + 1e-8)).round(6), strict=True))
    got = {r["id"]: r["n"] for r in windows.group_normalised(df, ["k"], "x", "n").select("id", F.round("n", 6).alias("n")).collect()}
    assert all(abs(got[i] - w) < 2e-6 for i, w in want.items())


def test_within_tokens_by_any_tokenizer(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None), (3, "boom"), (4, "a b c d e"), (5, "")], "id long, t string")

    def count(texts):
        if (texts == "boom").any():
            raise ValueError("no template")
        return texts.str.len()

    assert {tuple(r) for r in filters.within_tokens(df, F.col("t"), 5, count).select("id", "n_tokens").collect()} == {(1, 5), (5, 0)}
    assert {tuple(r) for r in filters.within_tokens(df, F.col("t"), 3).select("id", "n_tokens").collect()} == {(1, 3), (3, 1), (5, 0)}
