"""Parallel operators on long series against the sequential walks they replace, over ranges far narrower than the series."""

from __future__ import annotations

import bisect
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from splicefind.operators import folds, segments, suppress
from splicefind.session import ship_code


@pytest.fixture(scope="module")
def peaks(spark):
    """Three series of steep slopes, ties and noise."""
    ship_code(spark)
    rng = random.Random(1)
    rows = []
    for k in range(3):
        t = 0.0
        for _ in range(400):
            t += rng.choice([1, 1, 2, 3, 7])
            rows.append((k, t, t / 3000 if k == 2 else rng.choice([rng.random(), 0.5])))
    return rows, spark.createDataFrame(rows, "k int, t double, s double")


@pytest.mark.parametrize("apart, width", [(5.0, 40.0), (30.0, 20.0), (3.0, 1e6)])
def test_spaced_is_the_greedy_walk(peaks, apart, width):
    rows, df = peaks
    want = []
    for k in range(3):
        own = [r for r in rows if r[0] == k]
        want += [(k, own[i][1]) for i in folds.keep_strongest([r[1] for r in own], [r[2] for r in own], apart)]
    assert sorted((r["k"], r["t"]) for r in suppress.spaced(df, ["k"], "t", "s", apart, width).collect()) == sorted(want)


def test_spaced_of_nulls_ties_and_nothing(spark):
    rows = [(1, 0.0, 1.0, 1), (1, 1.0, 1.0, 0), (1, 2.0, None, 0), (None, 0.0, 1.0, 0), (None, 1.0, 2.0, 0)]
    df = spark.createDataFrame(rows, "k int, t double, s double, leg int")
    assert sorted(((r["k"], r["t"]) for r in suppress.spaced(df, ["k"], "t", "s", 2.0, 50.0, tie="leg").collect()), key=str) == [(1, 1.0), (None, 1.0)]
    assert suppress.spaced(df.limit(0), ["k"], "t", "s", 2.0, 50.0).count() == 0


def test_merging_in_pieces_is_the_walk(spark):
    rng = random.Random(2)
    cuts = []
    for k, least in enumerate((3, 9, 40)):
        cuts += [(k, p, rng.choice([1.0, 2.0, rng.random()]), 2000, least) for p in sorted(rng.sample(range(1, 2000), 300))]
    df = spark.createDataFrame(cuts, "k int, p int, s double, n int, least int")
    want = []
    for k in range(3):
        own = [c for c in cuts if c[0] == k]
        want += [(k, p) for p in folds.merge_short(2000, [c[1] for c in own], [c[2] for c in own], own[0][4])]
    assert sorted((r["k"], r["p"]) for r in suppress.merge_short(df, ["k"], "p", "s", "n", "least", 100.0).collect()) == sorted(want)


def protected_literally(points, marks, least, marked, margin):
    """The loop as it is described: thresholds of the segments as they stand, again until nothing changes."""
    points = list(points)
    need = lambda a, b: marked if any(a - margin <= m <= b + margin for m in marks) else least
    going = True
    while going:
        going, i = False, 1
        while i < len(points) - 1:
            left = points[i] - points[i - 1] - need(points[i - 1], points[i])
            right = points[i + 1] - points[i] - need(points[i], points[i + 1])
            if left < 0 or right < 0:
                del points[i if left <= right else i + 1]
                going = True
            else:
                i += 1
    return points


def test_protection_in_pieces_is_the_walk(spark):
    rng = random.Random(3)
    rows, want = [], []
    for k in range(4):
        points = sorted({0.0, 200.0, *(round(rng.random() * 200, 4) for _ in range(150)), *([199.9] if k == 3 else [])})
        marks = sorted(rng.random() * 200 for _ in range(40)) if k else []
        for x in points:
            j = bisect.bisect_left(marks, x - 0.25)
            rows.append((k, x, marks[j] if j < len(marks) else None, 0.0, 200.0))
        want += [(k, x) for x in protected_literally(points, marks, 0.5, 1.1, 0.25)]
    df = spark.createDataFrame(rows, "k int, t double, ahead double, a double, b double")
    assert sorted((r["k"], r["t"]) for r in suppress.protect_durations(df, ["k"], "t", "a", "b", 0.5, 1.1, 0.25, 20.0).collect()) == sorted(want)


def film(seed, n=260, step=0.5):
    """Times and vectors of a film: shots of random length around random directions."""
    rng = np.random.default_rng(seed)
    out, base, left = [], rng.normal(size=8), 0
    for i in range(n):
        if left == 0:
            base, left = rng.normal(size=8), int(rng.integers(2, 40))
        left -= 1
        v = base + rng.normal(size=8) * 0.25
        out.append((i * step, (v / np.linalg.norm(v)).tolist()))
    return out


@pytest.fixture(scope="module")
def films(spark):
    ship_code(spark)
    rows = {k: film(k) for k in range(3)} | {3: film(9, 1), 4: film(10, 2)}
    return rows, spark.createDataFrame([(k, t, v) for k, own in rows.items() for t, v in own], "k int, t double, feature array<double>")


@pytest.mark.parametrize("two_level, options", [(False, dict(cut_abs=0.3, z=1.5)), (True, dict(cut_abs=0.5, z=1.8)), (True, dict(cut_abs=0.3, z=1.0, smooth=3, fps=2.0, least_s=2.0))])
def test_shots_are_those_of_the_walk(films, two_level, options):
    rows, df = films
    want = []
    for k, own in rows.items():
        want += [(k, s["shot"], s["start"], s["end"], s["n"]) for s in folds.shots([{"t": t, "feature": v} for t, v in own], two_level, **options)]
    got = sorted((r["k"], r["shot"], r["start"], r["end"], r["n"]) for r in segments.shots(df, ["k"], 15.0, two_level, **options).collect())
    assert got == sorted(want) and len(got) > 20


def test_gates_tell_lasting_changes_from_flashes(spark):
    """A change that stays, one that goes back at once, and unrest: only the first opens; few histograms open all."""
    a, b = [1.0, 0.0], [0.0, 1.0]
    hist = {1: [a] * 6 + [b] * 10, 2: [a] * 6 + [b] + [a] * 9, 3: [a] * 6 + [a, b] * 5, 4: [a, b]}
    pixels = spark.createDataFrame([(k, i / 10, h) for k, own in hist.items() for i, h in enumerate(own)], "k int, t double, hist array<double>")
    marks = spark.createDataFrame([(k, 0.45) for k in (1, 2, 3, 4, 5)], "k int, t double")
    got = {r["k"]: r["pixel_ok"] for r in segments.pixel_gate(marks, pixels, ["k"], "t", 0.5).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: True}
    rows = pixels.select("k", F.col("t").alias("t"), F.col("hist").alias("feature")).where("k < 4")
    placed = suppress.numbered_rows(rows, ["k"], "t", 0.3)
    rate = spark.createDataFrame([(k, 1.0) for k in (1, 2, 3)], "k int, fps double")
    at = spark.createDataFrame([(k, 6) for k in (1, 2, 3)], "k int, p int")
    got = {r["k"]: r["semantic_ok"] for r in segments.semantic_gate(at, placed, ["k"], "p", rate).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_fusion_is_that_of_the_walk(films, spark):
    """With gates that are always open, bounds are those of the sequential fusion; starts take later pixel times."""
    rows, df = films
    rng = random.Random(5)
    marks = [(k, round(rng.random() * own[-1][0], 2)) for k, own in rows.items() if len(own) > 2 for _ in range(25)]
    nothing = spark.createDataFrame([], "k int, t double, hist array<double>")
    pix = spark.createDataFrame(marks, "k int, t double")
    bounds = segments.scene_bounds(df, pix, nothing, ["k"], 15.0, cut_abs=0.3, apart=1.2, least_s=2.0)
    want, starts = [], []
    for k, own in rows.items():
        t, v = [x for x, _ in own], np.array([x for _, x in own])
        if len(own) < 3:
            starts.append((k, t[0]))
            continue
        d = folds.lag_distance(v)
        cls = [(t[i + 1], d[i], True) for i in range(1, len(d) - 1) if d[i] >= d[i - 1] and d[i] >= d[i + 1] and d[i] >= 0.3]
        found = folds.fuse_bounds(cls, [(x, True) for kk, x in sorted(marks) if kk == k], t, 2.0, 2.0, 1.2)
        want += [(k, j) for j, _ in found]
        snapped = {}
        for kk, x in sorted(marks):
            if kk == k:
                snapped[min(range(len(t)), key=lambda i: (abs(t[i] - x), i))] = x
        starts += [(k, t[0])] + [(k, max(t[j], snapped.get(j, -1.0))) for j, _ in found]
    assert sorted((r["k"], r["place"]) for r in bounds.collect()) == sorted(want)
    out = segments.scenes(df, bounds, ["k"], 15.0).collect()
    assert sorted((r["k"], round(r["start"], 6)) for r in out) == sorted((k, round(s, 6)) for k, s in starts)
    assert all(r["end"] > r["start"] for r in out)


def two_pass_literally(rows, fps, coarse, window, step, least, marked, margin, share, **options):
    few = rows[::coarse]
    cuts = [few[i][0] for i in folds.detect_cuts([r[0] for r in few], np.array([r[1] for r in few]), fps=fps / coarse, **options)]
    flash = [r[0] for r in few if r[2]]
    spike = [b[0] for a, b in zip(few, few[1:]) if abs(a[3] - b[3]) >= 80 and max(a[3], b[3]) >= 180]
    cuts = [c for c in cuts if all(abs(m - c) > margin for m in flash + spike)]
    place = {r[0]: i for i, r in enumerate(rows)}
    moved = []
    for c in cuts:
        lo = max(0, place[c] - window)
        near = rows[lo : place[c] + window + 1][::step]
        to = c
        if len(near) >= 3:
            d = np.round(folds.lag_distance(np.array([r[1] for r in near])), 9)
            cand = near[int(np.argmax(d)) + 1][0]
            to = c if any(r[2] and abs(r[0] - cand) <= margin for r in near) else cand
        moved.append(to)
    points = protected_literally(sorted({0.0, *(round(x, 4) for x in moved), round(rows[-1][0], 4)}), flash, least, marked, margin)
    segs = folds.merge_marked([(a, b) for a, b in zip(points, points[1:]) if b - a >= least], flash, share)
    out = []
    for a, b in segs:
        own = [r for r in few if a - 1e-4 <= r[0] <= b + 1e-4]
        if own:
            flags = [r[4] for r in own]
            run = max(len(x) for x in "".join("x" if f else " " for f in flags).split(" "))
            out.append((a, b, len(own), round(sum(flags) / len(flags), 6), round(run / len(flags), 6)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_two_passes_are_those_of_the_walk(spark, seed):
    ship_code(spark)
    rng = random.Random(seed)
    films = {k: [(t, v, rng.random() < 0.03, float(rng.choice([40, 90, 210])) if rng.random() < 0.1 else 60.0, rng.random() < 0.3) for t, v in film(20 * seed + k, 900, 0.125)] for k in range(2)}
    df = spark.createDataFrame([(k, *r) for k, own in films.items() for r in own], "k int, t double, feature array<double>, flash boolean, mean double, card boolean")
    options = dict(coarse=6, window=20, step=2, least=1.0, marked=3.0, margin=0.25, share=0.05, cut_abs=0.3, z=1.0, least_s=1.5)
    want = sorted((k, *x) for k, own in films.items() for x in two_pass_literally(own, 8.0, **options))
    got = segments.two_pass(df, ["k"], 20.0, 8.0, **options).collect()
    assert sorted((r["k"], r["start"], r["end"], r["n"], round(r["card_ratio"], 6), round(r["card_run_ratio"], 6)) for r in got) == want and len(want) > 10
