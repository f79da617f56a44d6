"""Operators that split long series or large query sets: the parts give what the whole gives."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from splicefind.functions import text as X
from splicefind.operators import evaluate, retrieval
from splicefind.operators import timeseries as ts
from splicefind.session import ship_code


@pytest.mark.parametrize("width", [0.7, 3.0, 1000.0])
def test_ranges_give_what_the_whole_series_gives(spark, width):
    rng = random.Random(5)
    at = sorted({round(rng.uniform(0, 60) ** 2 / 40, 3) for _ in range(90)})  # dense and sparse stretches
    df = spark.createDataFrame([(k, t, float(rng.randrange(9))) for k in (1, 2) for t in at], "k int, t double, x double")

    def means(rows, keys):
        w = ts.over(keys, "t").rowsBetween(-3, 3)
        return rows.withColumn("s", F.concat_ws(",", F.collect_list(F.col("x").cast("string")).over(w))).withColumn("p", ts.is_peak("x", keys, "t"))

    got = ts.by_ranges(df, ["k"], "t", width, 3, means).select("k", "t", "s", "p").collect()
    assert sorted(got) == sorted(means(df, ["k"]).select("k", "t", "s", "p").collect())


def test_kendall_counts_pairs_by_a_fold(spark):
    ship_code(spark)
    rng = random.Random(2)
    rows = [(k, rng.randrange(8), float(rng.randrange(6))) for k in range(3) for _ in range(20)] + [(9, 1, 1.0)]
    got = {r["k"]: (r["concordant"], r["discordant"], r["pairs"]) for r in evaluate.kendall_tau(spark.createDataFrame(rows, "k int, i int, x double"), ["k"], "i", "x").collect()}
    want = {}
    for k in range(3):
        pairs = [(a, b) for _, i, a in [r for r in rows if r[0] == k] for _, j, b in [r for r in rows if r[0] == k] if i < j]
        want[k] = (sum(b > a for a, b in pairs), sum(b < a for a, b in pairs), len(pairs))
    assert got == want


@pytest.mark.parametrize("slice_rows", [7, 1000])
def test_nearest_apart_in_blocks(spark, monkeypatch, slice_rows):
    ship_code(spark)
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", slice_rows)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(30, 6))
    df = spark.createDataFrame([(i % 2, i, x.tolist()) for i, x in enumerate(v)], "k int, i long, feature array<double>").repartition(3)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = {r["i"]: r["nearest"] for r in retrieval.nearest_apart(df, ["k"], "i", 4).collect()}
    for i in range(30):
        assert got[i] == pytest.approx(max(u[i] @ u[j] for j in range(30) if j % 2 == i % 2 and abs(i - j) > 4), abs=1e-8)


@pytest.mark.parametrize("most", [40, 10**6])
def test_best_containment_in_slices(spark, monkeypatch, most):
    ship_code(spark)
    monkeypatch.setattr(retrieval, "ITEM_GRAMS", most)
    rng = random.Random(6)
    say = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    items = [(i, say(rng.randrange(0, 14))) for i in range(20)]
    docs = [(i, say(rng.randrange(0, 60)) + rng.choice(["", items[3][1]])) for i in range(40)] + [(100, None), (101, "zzzz"), (102, "ab")]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} int, t string").select(name, X.grams("t").alias("grams"))
    got = {r["d"]: (r["i"], r["sim"]) for r in retrieval.best_containment(frame(docs, "d"), frame(items, "i"), "d", "i").collect()}
    cut = lambda t: {t[k : k + 3] for k in range(len(t) - 2)} or ({t} if t else set())
    for d, t in docs:
        a = cut(t or "")
        sims = [(round((len(a & b) / len(a) + len(a & b) / len(b)) / 2, 9), -i) for i, x in items if (b := cut(x)) and a & b]
        if sims:
            assert got[d] == (-max(sims)[1], pytest.approx(max(sims)[0]))
        else:
            assert d not in got


def planted(spark):
    """200 unit vectors and queries that are noisy copies of some of them, two shots of very different size."""
    rng = np.random.default_rng(11)
    v = rng.normal(size=(200, 16))
    lib = spark.createDataFrame([(2.0 * i, x.tolist()) for i, x in enumerate(v)] + [(7.0, None), (None, v[0].tolist())], "t double, feature array<double>")
    at = [20 + i for i in range(10)] + [i % 5 for i in range(40)]
    q = [(1 if i < 10 else 2, 0.5 * i, (v[a] + rng.normal(size=16) * 1e-3).tolist()) for i, a in enumerate(at)]
    return v, at, lib, spark.createDataFrame(q, "shot_no long, t double, feature array<double>"), np.array([x[2] for x in q])


@pytest.mark.parametrize("block_rows", [13, 10**6])
def test_blocks_give_what_the_whole_product_gives(spark, monkeypatch, block_rows):
    ship_code(spark)
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", block_rows)
    v, at, lib, q, qv = planted(spark)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(unit(qv) @ unit(v).T, 9)
    got = {(r["q_t"], r["rank"]): (r["l_t"], r["sim"]) for r in retrieval.top_k(q, lib, 7).collect()}
    assert len(got) == 50 * 7
    for i, row in enumerate(sims):
        order = np.lexsort((np.arange(200), -row))[:7]
        assert [got[0.5 * i, k + 1][0] for k in range(7)] == [2.0 * j for j in order] and got[0.5 * i, 1][0] == 2.0 * at[i]
    assert retrieval.top_k(q, lib, 300).count() == 50 * 200 and retrieval.top_k(q, lib.limit(0), 3).count() == 0
    assert retrieval.top_k(q, lib, 3, floor=0.9).count() == 50
    for r in retrieval.set_similarity(q, lib).collect():
        own = sims[:10] if r["shot_no"] == 1 else sims[10:]
        assert r["forward"] == pytest.approx(own.max(axis=1).mean()) and r["backward"] == pytest.approx(own.max(axis=0).mean())
    best = {r["shot_no"]: (r["start"], r["mean_sim"]) for r in retrieval.best_windows(q, lib, 4, 6.0).collect()}
    for s, own in ((1, sims[:10]), (2, sims[10:])):
        mean = np.round(np.lib.stride_tricks.sliding_window_view(own.max(axis=0), 4).mean(axis=1), 9)
        assert best[s] == (2.0 * mean.argmax(), pytest.approx(mean.max()))
    windows = spark.createDataFrame([(1, 39.0, 45.0), (1, 44.0, 50.0), (2, 0.0, 3.0), (9, 0.0, 9.0)], "shot_no long, lo double, hi double")
    near = {(r["shot_no"], r["t"]): r["sim"] for r in retrieval.window_sims(windows, q, lib, "lo", "hi", 8.0).collect()}
    assert near == {(1, 2.0 * j): pytest.approx(sims[:10, j].max()) for j in range(20, 26)} | {(2, 2.0 * j): pytest.approx(sims[10:, j].max()) for j in range(0, 2)}


def test_equal_similarities_go_by_time(spark):
    ship_code(spark)
    lib = spark.createDataFrame([(float(t), [1.0, 0.0]) for t in range(30)], "t double, feature array<double>").repartition(5)
    q = spark.createDataFrame([(1, 0.0, [2.0, 0.0])], "shot_no long, t double, feature array<double>")
    assert [r["l_t"] for r in retrieval.top_k(q, lib, 5).orderBy("rank").collect()] == [0.0, 1.0, 2.0, 3.0, 4.0]


def test_nearest_apart_keeps_series_apart(spark):
    """Series of many keys, null among them: none sees another's rows."""
    ship_code(spark)
    rng = np.random.default_rng(13)
    rows = [(f"s{k}" if k else None, i, (np.eye(6)[k % 6] + rng.normal(size=6) * 0.01 + i * 0.1).tolist()) for k in range(12) for i in range(9)]
    got = {(r["k"], r["i"]): r["nearest"] for r in retrieval.nearest_apart(spark.createDataFrame(rows, "k string, i long, feature array<double>"), ["k"], "i", 6).collect()}
    unit = {(k, i): np.array(v) / np.linalg.norm(v) for k, i, v in rows}
    want = {(k, i): max((float(unit[k, i] @ unit[k, j]) for j in range(9) if abs(i - j) > 6), default=None) for k, i, _ in rows}
    assert got == {key: pytest.approx(x, abs=1e-8) for key, x in want.items() if x is not None}
