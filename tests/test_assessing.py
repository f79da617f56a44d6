"""Stage tables, splits, exact starts, ordered search, false hits: planted cases and plain loops beside the SQL of the queries."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from splicefind.operators import evaluate, ordered, shot_split, starts
from splicefind.sources.stage_cache import StageCache, fingerprint, span_key

ONE = "key long, t double, feature array<double>"


def unit(*x):
    v = np.array(x, dtype=float)
    return (v / np.linalg.norm(v)).tolist()


# ---- stage tables -----------------------------------------------------------------------------


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def part_files(root: Path, folder: str):
    return sorted(root.rglob(f"{folder}/*.parquet"))


def test_stage_is_built_once(spark, tmp_path):
    cache, calls = StageCache(spark, f"file://{tmp_path}/c", deep=True), []

    def build():
        calls.append(1)
        return spark.createDataFrame([(1, 2.0, None), (2, None, "b"), (2, None, "b")], "a int, b double, c string")

    first = rows_of(cache.stage("k", "shots", build).fillna({"b": -1.0, "c": ""}))
    again = rows_of(cache.stage("k", "shots", build).fillna({"b": -1.0, "c": ""}))
    assert first == again == [(1, 2.0, ""), (2, -1.0, "b"), (2, -1.0, "b")] and len(calls) == 1
    assert cache.load("k", "dense") is None and cache.load("other", "shots") is None


def test_killed_writer_is_a_miss_and_the_run_resumes(spark, tmp_path):
    cache = StageCache(spark, f"file://{tmp_path}/c")

    def killed():
        @F.udf("int")
        def fail(x):
            raise RuntimeError("killed")

        return spark.range(10).select(fail("id").alias("x"))

    with pytest.raises(Exception):
        cache.stage("k", "shots", killed)
    assert cache.load("k", "shots") is None
    assert cache.stage("k", "shots", lambda: spark.range(3)).count() == 3
    # data without a mark (killed between the two) is not read, the whole part beside it is
    spark.range(5).write.parquet(f"{tmp_path}/c/k/shots/half/data")
    assert StageCache(spark, f"file://{tmp_path}/c").load("k", "shots").count() == 3


@pytest.mark.parametrize("harm", ["cut", "gone", "more", "mark", "garbage"])
def test_damaged_part_is_a_miss(spark, tmp_path, harm):
    cache = StageCache(spark, f"file://{tmp_path}/c")
    cache.save("k", "s", spark.range(1000).repartition(3))
    data, mark = part_files(tmp_path, "data"), part_files(tmp_path, "mark")
    assert cache.load("k", "s").count() == 1000
    if harm == "cut":
        data[0].write_bytes(data[0].read_bytes()[:-40])
    elif harm == "gone":
        data[1].unlink()
    elif harm == "more":
        (data[0].parent / "part-zz.parquet").write_bytes(data[0].read_bytes())
    elif harm == "mark":
        (mark[0].parent / "_SUCCESS").unlink()
    else:
        data[0].write_bytes(b"x" * len(data[0].read_bytes()))
    assert cache.load("k", "s") is None
    assert cache.stage("k", "s", lambda: spark.range(7)).count() == 7 and cache.load("k", "s").count() == 7


def test_deep_check_finds_changed_values(spark, tmp_path):
    cache = StageCache(spark, f"file://{tmp_path}/c", deep=True)
    swapped = lambda a, b: spark.createDataFrame([(i, a if i % 2 else b) for i in range(50)], "x long, y string").coalesce(1)
    cache.save("k", "s", swapped("a", "b"))
    (file,) = part_files(tmp_path, "data")
    swapped("b", "a").write.parquet(str(tmp_path / "other"))
    body = next((tmp_path / "other").glob("*.parquet")).read_bytes()
    assert len(body) == file.stat().st_size
    file.write_bytes(body)
    (file.parent / f".{file.name}.crc").unlink()
    assert cache.load("k", "s") is None and StageCache(spark, f"file://{tmp_path}/c").load("k", "s") is not None


def test_only_missing_spans_are_built(spark, tmp_path):
    cache, asked = StageCache(spark, f"file://{tmp_path}/c"), []

    def build(spans):
        asked.append(sorted(r["span_key"] for r in spans.collect()))
        return spans.select("span_key", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("i"))

    spans = lambda *x: spark.createDataFrame(list(x), "start double, end double")
    assert rows_of(cache.fill("k", "dense", spans((0.0, 1.0), (1.0, 2.005), (None, 3.0)), build)) == [("0.00_1.00", 0), ("0.00_1.00", 1), ("1.00_2.01", 0), ("1.00_2.01", 1)]
    got = cache.fill("k", "dense", spans((0.0, 1.001), (5.0, 6.0), (5.0, 6.0)), build)
    assert rows_of(got) == [("0.00_1.00", 0), ("0.00_1.00", 1), ("5.00_6.00", 0), ("5.00_6.00", 1)]
    assert asked == [["0.00_1.00", "1.00_2.01"], ["5.00_6.00"]]
    assert cache.fill("k", "dense", spans((0.0, 1.0)), build).count() == 2 and len(asked) == 2
    assert cache.fill("empty", "dense", spans(), build).count() == 0
    assert spans((1.5, 2.0)).select(span_key("start", "end")).first()[0] == "1.50_2.00"


def test_fingerprint_follows_files_and_settings(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(f"{tmp_path}/t")
    one = fingerprint(spark, [f"{tmp_path}/t"], a=1, b="x")
    assert one == fingerprint(spark, [f"{tmp_path}/t"], b="x", a=1) and len(one) == 40
    assert one != fingerprint(spark, [f"{tmp_path}/t"], a=2, b="x")
    spark.range(11).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/t")
    assert one != fingerprint(spark, [f"{tmp_path}/t"], a=1, b="x")


# ---- splits -------------------------------------------------------------------------------------


def plain_shots(times, vectors, hard, depth):
    """The pieces of a series, one after the other."""
    sims = [round(float(np.dot(a, b)), 9) for a, b in zip(vectors, vectors[1:])]
    edges = [0]
    for k, s in enumerate(sims):
        inner = 0 < k < len(sims) - 1 and s < min(sims[k - 1], sims[k + 1]) - depth
        if s < hard or inner:
            edges.append(k + 1)
    edges.append(len(times))
    if len(times) == 1:
        return [(times[0], times[0])]
    out = []
    for a, b in zip(edges, edges[1:]):
        if b - a >= 2:
            out.append([times[a], times[b - 1]])
        elif out:
            out[-1][1] = times[b - 1]
    return [tuple(x) for x in out]


def test_shots_of_random_series(spark):
    rng, rows, want = np.random.default_rng(3), [], {}
    for key in range(40):
        n = int(rng.integers(1, 25))
        v = [unit(*rng.normal(size=3)) for _ in range(4)]
        f = [v[int(rng.integers(0, 4))] if rng.random() < 0.5 else v[key % 4] for _ in range(n)]
        times = sorted(rng.choice(200, n, replace=False).astype(float).tolist())
        rows += [(key, t, x) for t, x in zip(times, f)]
        want[key] = plain_shots(times, f, 0.3, 0.2)
    rows += rows[:30] + [(99, None, [1.0, 0.0, 0.0]), (98, 1.0, None)]  # repeated rows and nulls
    got: dict = {}
    for r in shot_split.cut_shots(spark.createDataFrame(rows, ONE).repartition(5), ["key"], 0.3, 0.2).orderBy("key", "shot").collect():
        got.setdefault(r["key"], []).append((r["start"], r["end"]))
    assert got == {k: w for k, w in want.items() if w}


def test_split_moves_the_shot_that_lies_elsewhere(spark):
    rng = np.random.default_rng(5)
    lib = [unit(*rng.normal(size=24)) for _ in range(200)]
    # rows 0-3 show 50..53, rows 4-7 show 70..73, where the parent says 54..57; the last row alone belongs to the second shot
    shown = [50, 51, 52, 53, 70, 71, 72, 73]
    smooth = lambda i: unit(*(np.array(lib[i]) + 2 * np.array(lib[150 if i < 60 else 160])))
    library = [(float(i), smooth(i) if i in shown else x) for i, x in enumerate(lib)]
    frames = [(1, 10.0 + k, smooth(i)) for k, i in enumerate(shown)] + [(2, 10.0 + k, smooth(50)) for k in range(6)]
    parents = [(1, 10.0, 18.0, 50.0, 58.0), (2, 10.0, 16.0, 50.0, 56.0), (3, 0.0, 5.0, 1.0, 6.0), (4, 0.0, 0.0, 1.0, 6.0), (5, None, 1.0, 0.0, 1.0)]
    parents += [(6, 10.0, 18.0, 5000.0, 5008.0)]
    frames += [(6, 10.0 + k, smooth(i)) for k, i in enumerate(shown)]
    p = spark.createDataFrame(parents, "key long, q_start double, q_end double, start double, end double")
    out = shot_split.split_shots(p, spark.createDataFrame(frames, ONE), spark.createDataFrame(library, "t double, feature array<double>"), "key")
    got = [tuple(r) for r in out.select("key", "child", "q_start", "q_end", "start", "end", "refined", "parent_end").orderBy("key", "child").collect()]
    assert got == [
        (1, 0, 10.0, 13.5, 50.0, 53.5, False, 58.0), (1, 1, 13.5, 18.0, 69.5, 74.0, True, 58.0), (2, 0, 10.0, 16.0, 50.0, 56.0, False, 56.0), (3, 0, 0.0, 5.0, 1.0, 6.0, False, 6.0),
        (4, 0, 0.0, 0.0, 1.0, 6.0, False, 6.0), (5, 0, None, 1.0, 0.0, 1.0, False, 1.0), (6, 0, 10.0, 18.0, 5000.0, 5008.0, False, 5008.0),
    ]


# ---- exact starts ---------------------------------------------------------------------------------


def test_mutual_matches_against_loops(spark):
    rng = np.random.default_rng(7)
    base = [unit(*rng.normal(size=6)) for _ in range(12)]
    frames = [(t / 10, [base[int(i)] for i in rng.choice(12, int(rng.integers(1, 9)))]) for t in range(0, 120)] + [(3.05, []), (3.15, None), (None, base[:2])]
    mains = [(1, 5.0, 20.0, 22.0), (2, 0.5, 30.0, 30.4), (3, None, 1.0, 2.0), (4, 500.0, 1.0, 2.0)]
    queries = [(1, base[:8]), (2, base[4:]), (3, base), (4, base)]
    m = spark.createDataFrame(mains, "shot_no long, start double, q_start double, q_end double")
    q = spark.createDataFrame(queries, "shot_no long, patches array<array<double>>")
    f = spark.createDataFrame(frames, "t double, patches array<array<double>>")
    got = {(r["shot_no"], round(r["candidate"], 6)): r["matches"] for r in starts.mutual_matches(m, q, f, margin=1.0).collect()}
    want = {}
    for shot, start, a, b in mains[:2]:
        own, anchor = np.array(dict(queries)[shot]), min(0.25, (b - a) * 0.1)
        for t, bag in frames:
            if t is None or not max(0.0, start - 1) <= t <= start + 1 + anchor + 0.1 or abs(t - anchor - start) > 1.051:
                continue
            n = 0
            if bag:
                s = np.round(own @ np.array(bag).T, 9)
                n = sum(1 for i in range(len(own)) for j in range(len(bag)) if s[i, j] >= 0.82 and j == int(np.argmax(s[i])) and i == int(np.argmax(s[:, j])))
            want[(shot, round(t - anchor, 6))] = n
    assert got == want and max(want.values()) > 3


def test_finalists_and_settled_start(spark):
    rows = [(1, 5.0, 4.0 + k / 4, 20 - abs(k - 6)) for k in range(9)] + [(2, 5.0, 5.0, 0), (2, 5.0, 5.5, 0)]
    df = spark.createDataFrame(rows, "shot_no long, start double, candidate double, matches long")
    got = {(r["shot_no"], r["candidate"]): (r["rank"], r["current"]) for r in starts.finalists(df, 2).collect()}
    assert got == {(1, 5.5): (1, False), (1, 5.25): (2, False), (1, 5.0): (4, True), (2, 5.0): (1, True), (2, 5.5): (2, False)}
    second = [(1, 5.0, 5.5, 14, 20, 0.7, False), (1, 5.0, 5.0, 10, 20, 0.5, True), (2, 5.0, 5.5, 13, 20, 0.65, False), (2, 5.0, 5.0, 10, 20, 0.5, True), (3, 5.0, 5.0, 30, 40, 0.75, True), (4, 5.0, 5.5, 14, 11, 0.9, False), (4, 5.0, 5.0, 1, 9, 0.1, True)]
    out = starts.settled_start(spark.createDataFrame(second, "shot_no long, start double, candidate double, inliers long, matches long, ratio double, current boolean"))
    assert {r["shot_no"]: (r["new_start"], r["moved"]) for r in out.collect()} == {1: (5.5, True), 2: (5.0, False), 3: (5.0, False), 4: (5.0, False)}


# ---- ordered search -------------------------------------------------------------------------------


def shot(*found, duration=10.0):
    return {"duration": duration, "candidates": [None if c is None else dict(zip(ordered.SCORES, c)) for c in found]}


def test_ordered_search_prefers_near_regions_and_locks():
    ok = lambda s, a=0.8: (s, a, 0.9, 0.9)
    rows = [shot(ok(100.0), ok(50.0)), shot(ok(115.0, 0.6), ok(4000.0, 0.9)), shot(ok(130.0)), shot(ok(20.0, 0.9), ok(700.0, 0.7)), shot(ok(20.0)), shot(None), shot(ok(5.0))]
    got = ordered.place_in_order(rows, 5000.0)
    assert [(r["placed"], r["region"], r["in_order"], r["locked"]) for r in got] == [
        (50.0, "global", 1, False), (115.0, "300", 2, False), (130.0, "300", 3, True), (700.0, "900", 4, True), (None, None, 0, False), (None, None, 0, False), (5.0, "global", 1, False),
    ]
    assert ordered.place_in_order(rows, 5000.0, lock=None)[4]["placed"] == 20.0
    assert [r["placed_end"] for r in ordered.place_in_order([shot(ok(4995.0))], 5000.0)] == [5000.0]
    weak = ordered.place_in_order([shot((1.0, 0.5, 1.0, 1.0), (2.0, None, 1.0, 1.0)), {"duration": None, "candidates": None}], 10.0)
    assert [r["placed"] for r in weak] == [None, None]


# ---- evaluation -----------------------------------------------------------------------------------


def test_false_hits_and_support_of_edges(spark):
    neg = spark.createDataFrame([(1, "a", 0.0, 10.0), (2, "a", 20.0, 20.0), (3, "b", 0.0, 10.0), (4, None, 0.0, 10.0)], "negative_id long, k string, q_start double, q_end double")
    res = spark.createDataFrame([(1, "a", 5.0, 30.0, 1.0, 2.0, False), (2, "a", 0.0, 10.0, 1.0, 1.005, False), (3, "b", 0.0, 10.0, 1.0, 2.0, True), (4, "b", 6.0, 12.0, 100.0, 110.0, None)], "row long, k string, q_start double, q_end double, start double, end double, rejected boolean")
    got = {r["negative_id"]: (r["spans"], r["false_hit"]) for r in evaluate.false_hits(neg, res, "k", 4.0).collect()}
    assert got == {1: (1, True), 2: (0, False), 3: (0, False), 4: (0, False)}
    truth = spark.createDataFrame([("a", 16.5, 18.0), ("b", 107.0, 500.0), ("b", 5.0, 4.0)], "k string, start double, end double")
    assert {r["row"]: r["supported"] for r in evaluate.supported(res, truth, "k", "row", 30.0).collect()} == {1: True, 4: True}
    assert not evaluate.supported(res.where("row = 1"), truth.withColumn("start", F.col("start") + 1.0), "k", "row", 30.0).first()["supported"]


def test_kendall_of_random_series_with_ties(spark):
    random.seed(4)
    rows = [(k, random.randrange(12), float(random.randrange(6))) for k in range(30) for _ in range(random.randrange(1, 40))]
    want = {}
    for k in range(30):
        mine = [(o, v) for x, o, v in rows if x == k]
        pairs = [(a[1], b[1]) for a in mine for b in mine if a[0] < b[0]]
        if pairs:
            want[k] = (sum(a < b for a, b in pairs), sum(a > b for a, b in pairs), len(pairs))
    df = spark.createDataFrame(rows + [(0, None, 1.0), (0, 3, None)], "k int, o int, v double")
    assert {r["k"]: (r["concordant"], r["discordant"], r["pairs"]) for r in evaluate.kendall_tau(df, ["k"], "o", "v").collect()} == want


def test_auc_of_scores_of_any_scale(spark):
    random.seed(5)
    for scale in (1.0, 1e-9, 1e9):
        rows = [(random.choice([-1, 1]) * round(random.random(), 2) * scale, random.randrange(2)) for _ in range(400)]
        pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
        want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
        assert abs(evaluate.auc(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()["auc"] - want) < 1e-12
