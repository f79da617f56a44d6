"""Late interaction against plain loops, on frames that are few, odd or missing; and what the plan reads."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from splicefind.operators import patches
from splicefind.session import ship_code


@pytest.fixture(scope="module")
def world(spark):
    ship_code(spark)
    rng = np.random.default_rng(4)
    unit = lambda *s: (lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True))(rng.normal(size=s))
    frames = [(float(t), unit(6), unit(int(rng.integers(1, 9)), 4)) for t in range(0, 200, 2)]
    shots = {s: [(i, unit(6), unit(5, 4)) for i in range(3)] for s in (1, 2, 7)}
    lib = [(t, f.tolist(), p.tolist()) for t, f, p in frames] + [(33.0, unit(6).tolist(), None), (35.0, unit(6).tolist(), [])]
    q = [(s, i, 10.0 * i, f.tolist(), p.tolist()) for s, own in shots.items() for i, f, p in own]
    return frames, shots, spark.createDataFrame(lib, "t double, feature array<double>, patches array<array<double>>"), spark.createDataFrame(q, "shot_no long, i int, at double, feature array<double>, patches array<array<double>>")


def score(own, frame, best):
    peaks = [(p @ frame[2].T).max(axis=1) for _, _, p in own]
    top = lambda x: np.sort(x)[-best:].mean()
    return np.mean([f @ frame[1] for _, f, _ in own]), top(np.concatenate(peaks)), np.mean([top(x) for x in peaks])


def at_or_after(frames, at):
    return next((f for f in frames if f[0] >= at), frames[-1])


@pytest.mark.parametrize("best", [2, 100])
def test_late_scores(world, spark, best):
    frames, shots, lib, q = world
    asks = [(s, a) for s in (1, 2, 99) for a in (-5.0, 0.0, 32.5, 34.5, 77.1, 77.1, 500.0)]
    got = {(r["shot_no"], r["at"]): r for r in patches.late_scores(q, spark.createDataFrame(asks, "shot_no long, at double"), lib, best, width=16.0).collect()}
    assert set(got) == {(s, a) for s, a in asks if s in shots and a not in (34.5,)}  # a frame with no patches scores nothing, one without is passed over
    for (s, a), r in got.items():
        frame = at_or_after(frames, a)
        assert r["l_t"] == frame[0] and np.allclose((r["cosine"], r["stacked"], r["per_frame"]), score(shots[s], frame, best), atol=1e-8)
    assert patches.late_scores(q, spark.createDataFrame([], "shot_no long, at double"), lib).count() == 0


def test_only_asked_frames_meet_a_shot(world, spark):
    _, _, lib, q = world
    asks = spark.createDataFrame([(1, 10.0), (2, 50.0)], "shot_no long, at double")
    plan = patches.late_scores(q, asks, lib)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_near_field_rescue(world, spark):
    frames, shots, lib, q = world
    mains = [(1, 99.0, 101.0, 0.0, 5.0), (2, 3.0, 5.0, 0.0, 5.0), (7, 60.0, 62.0, 0.0, 0.5), (50, 1.0, 2.0, 0.0, 9.0)]
    df = spark.createDataFrame(mains, "shot_no long, start double, end double, q_start double, q_end double")
    got = {r["shot_no"]: r for r in patches.nearfield_rescue(df, q, lib, margin=0.01).collect()}
    assert set(got) == {1, 2}  # the third is too short, the fourth has no frames
    for s, a, b, *_ in mains[:2]:
        now = (a + b) / 2
        grid = sorted({max(0.0, round(now + 4 * k, 2)) for k in range(-7, 8)})
        usable = [x for x in grid if x != 34.5]
        top = max(usable, key=lambda x: (round(score(shots[s], at_or_after(frames, x), 100)[1], 9), -x))
        lead = score(shots[s], at_or_after(frames, top), 100)[1] - score(shots[s], at_or_after(frames, now), 100)[1]
        assert got[s]["at"] == top and abs(got[s]["margin"] - lead) < 1e-8 and got[s]["moved"] == (lead > 0.01)


def test_windows_keep_the_evidence(spark):
    spans = spark.createDataFrame([(1, 0, 10.0, 12.0), (1, 1, 10.5, 11.5), (2, 0, 5.0, 7.0)], "shot_no long, place long, start double, end double")
    pool = spark.createDataFrame([(1, 11.0, 0.9), (1, 60.0, 0.8), (1, 64.0, 0.7), (1, 90.0, 0.6), (1, 30.0, 0.5)], "shot_no long, t double, sim double")
    got = sorted((r["shot_no"], r["mid"], r["a"], r["b"]) for r in patches.candidate_windows(spans, pool).collect())
    # 60 follows 11 by more than 8 s, 30 follows 90 backwards: a step back joins
    assert got == [(1, 11.0, 10.5, 11.5), (1, 60.0, 30.0, 91.0), (1, 62.0, 60.0, 65.0), (2, 6.0, 5.0, 7.0)]


def test_spaced_candidates_are_greedy_on_a_dense_library(spark):
    rng = np.random.default_rng(6)
    times = np.sort(rng.random(400) * 60)
    vectors = np.cumsum(rng.normal(size=(400, 5)) * 0.2, axis=0) + 1
    lib = spark.createDataFrame([(float(t), v.tolist()) for t, v in zip(times, vectors)], "t double, feature array<double>")
    q = rng.normal(size=5)
    got = patches.spaced_candidates(spark.createDataFrame([(3, 0.0, q.tolist())], "shot_no long, t double, feature array<double>"), lib, 5, 3.0).orderBy("place").collect()
    sims = np.round((vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ (q / np.linalg.norm(q)), 9)
    want = []
    for i in np.lexsort((times, -sims)):
        if len(want) < 5 and all(abs(times[i] - x) >= 3.0 for x in want):
            want.append(float(times[i]))
    assert [r["t"] for r in got] == want


def test_places_to_look_at(spark):
    mains = spark.createDataFrame([(1, 9.0, 11.0), (2, 9.0, 11.0), (3, 49.0, 51.0), (4, 0.0, 2.0)], "shot_no long, start double, end double")
    cands = spark.createDataFrame(
        [(1, 0, 11.0, 0.9), (1, 1, 30.0, 0.5), (1, 2, 70.0, 0.4), (2, 0, 10.2, 0.9), (2, 1, 30.0, 0.89), (3, 0, 10.0, 0.9), (3, 1, 20.0, 0.1)],
        "shot_no long, place int, t double, sim double",
    )
    got = {}
    for r in patches.evaluated(mains, cands).orderBy("shot_no", "place").collect():
        got.setdefault((r["shot_no"], r["is_clear"]), []).append(r["mid"])
    # clear and far from every candidate: itself and the first; unclear: all; the main middle comes first where nothing is near it
    assert got == {(1, True): [10.0, 11.0], (2, False): [10.2, 30.0], (3, False): [50.0, 10.0, 20.0], (4, False): [1.0]}


def test_refinement_moves_to_the_planted_copy(spark):
    """The shot's own frames lie at 100..119 of a library of scenes of 20 s; its main span lies at 40, by mistake."""
    rng = np.random.default_rng(8)
    f = np.repeat(rng.normal(size=(10, 6)), 20, axis=0) + rng.normal(size=(200, 6)) * 0.2
    p = np.repeat(rng.normal(size=(10, 6, 4)), 20, axis=0) + rng.normal(size=(200, 6, 4)) * 0.2
    rows = [(float(t), f[t].tolist(), p[t].tolist()) for t in range(200)]
    lib = spark.createDataFrame(rows, "t double, feature array<double>, patches array<array<double>>")
    own = spark.createDataFrame([(1, t - 100.0, *r) for t, *r in rows[100:120]], "shot_no long, t double, feature array<double>, patches array<array<double>>")
    mains = spark.createDataFrame([(1, 30.0, 50.0, 0.0, 20.0)], "shot_no long, start double, end double, q_start double, q_end double")
    reps = patches.representatives(mains, own, 5, None)
    assert [r["at"] for r in reps.orderBy("i").collect()] == [2.0, 6.0, 10.0, 14.0, 18.0]
    (r,) = patches.patch_refine(mains, reps, lib, lib).collect()
    assert r["moved"] and 97 <= r["mid"] <= 123 and r["lead"] > 0.05 and abs(r["end"] - r["start"] - 20) < 1e-6
