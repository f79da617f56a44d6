"""Sequential operators: planted scenarios and invariants."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from splicefind.operators import folds


def test_strongest_are_spaced_and_maximal():
    rng = random.Random(1)
    at, strength = [rng.uniform(0, 50) for _ in range(60)], [rng.random() for _ in range(60)]
    kept = folds.keep_strongest(at, strength, 2.0)
    assert all(abs(at[a] - at[b]) >= 2.0 for a, b in itertools.combinations(kept, 2))
    for i in set(range(60)) - set(kept):  # each dropped one is near a stronger kept one
        assert any(abs(at[i] - at[k]) < 2.0 and strength[k] >= strength[i] for k in kept)


def test_merge_short_drops_the_weaker_side():
    assert folds.merge_short(20, [8, 10], [0.9, 0.5], 4) == [8]
    assert folds.merge_short(20, [8, 10], [0.5, 0.9], 4) == [10]
    assert folds.merge_short(20, [8, 10], [0.5, 0.5], 4) == [10]  # tie: the left one goes
    assert folds.merge_short(3, [1], [1.0], 4) == []


def test_planted_cuts_are_found():
    rng = np.random.default_rng(3)
    scenes = rng.normal(size=(4, 32))
    v = np.concatenate([s + 0.05 * rng.normal(size=(15, 32)) for s in scenes])
    assert folds.detect_cuts([float(i) for i in range(60)], v) == [15, 30, 45]
    assert folds.shots([]) == [] and len(folds.shots([{"t": 0.0, "feature": [1.0]}])) == 1


def test_continuity_bridges_only_forward_runs():
    hit = lambda q, t, s=0.9: {"q_t": q, "l_t": t, "sim": s}
    forward = [hit(0, 0), hit(1, 5), hit(2, 18)]
    assert [r["cluster"] for r in folds.continuity_clusters(forward)] == [0, 0, 0]
    backward = [hit(2, 0), hit(1, 5), hit(0, 18)]
    assert [r["cluster"] for r in folds.continuity_clusters(backward)] == [0, 0, 1]
    assert [r["cluster"] for r in folds.continuity_clusters([hit(i, 9.0 * i) for i in range(9)])] == [0] * 7 + [1] * 2


def test_alignment_finds_a_planted_copy():
    rng = np.random.default_rng(5)
    lib = rng.normal(size=(30, 64))
    q = lib[10:18] + 0.01 * rng.normal(size=(8, 64))
    got = folds.align_moments(q, lib, [float(i) for i in range(8)], [2.0 * i for i in range(30)])
    assert len(got) == 1 and 20 <= (got[0]["start"] + got[0]["end"]) / 2 <= 34 and got[0]["label"] == "high"
    assert folds.align_moments(rng.normal(size=(8, 64)), lib, list(range(8)), list(range(30))) == []
    assert folds.align_moments(q, lib, [0.0] * 8, [0.0] * 30, most_cells=10) == []


def test_path_score_is_no_worse_than_the_diagonal():
    rng = np.random.default_rng(6)
    s = rng.uniform(-0.2, 1, size=(6, 6))
    path = folds.monotone_path(s)
    assert all(b[0] > a[0] and b[1] > a[1] for a, b in itertools.pairwise(path))


def brute_rerank(rows, back=0.001, skip=0.30):
    live = [i for i, r in enumerate(rows) if len(r["candidates"]) >= 2]
    best, pick = -1e18, None
    for combo in itertools.product(*[[*range(len(rows[i]["candidates"])), None] for i in live]):
        total, prev = 0.0, "start"
        for i, k in zip(live, combo):
            c = rows[i]["candidates"]
            if k is None:
                total -= skip
                prev = None
                continue
            total += c[k][1] / max(s for _, s in c)
            if prev is None:
                total -= skip + back * max(0.0, rows[i]["edited_mid"] - c[k][0])
            elif prev != "start":
                total -= back * max(0.0, prev - c[k][0])
            prev = c[k][0]
        if total > best + 1e-12:
            best, pick = total, combo
    return best, pick


def test_sequence_rerank_is_optimal():
    rng = random.Random(2)
    for _ in range(30):
        rows = [{"edited_mid": float(i), "candidates": [(rng.uniform(0, 900), rng.uniform(0.2, 1)) for _ in range(rng.choice([1, 2, 3]))]} for i in range(4)]
        got = folds.sequence_rerank(rows)
        live = [i for i, r in enumerate(rows) if len(r["candidates"]) >= 2]
        if len(live) < 2:
            assert all(r["choice"] is None for r in got)
        else:
            assert tuple(got[i]["choice"] for i in live) == brute_rerank(rows)[1]


def spans(rng, n, wide=20.0):
    out = []
    for i in range(n):
        s = rng.uniform(0, 100)
        out.append({"q_start": float(i), "q_end": i + 1.0, "start": s, "end": s + rng.uniform(0.5, wide), "score": rng.random(), "level": "HIGH", "cover": rng.random(), "sim": rng.random()})
    return out


def test_iou_dedup_and_gate():
    rng = random.Random(4)
    rows = spans(rng, 30)
    got = folds.iou_dedup(rows)
    assert len(got) <= 4 and all(folds.hull_iou((a["start"], a["end"]), (b["start"], b["end"])) <= 0.6 for a, b in itertools.combinations(got, 2))
    low = [{**r, "cover": 0.1, "sim": 0.1} for r in rows]
    assert len(folds.gate_subspans(low)) == 1 and folds.gate_subspans(low, floor=False) == []


def test_claims_use_the_union_and_the_strongest_survives():
    a = {"q_start": 0, "q_end": 1, "start": 0.0, "end": 10.0, "score": 0.9, "level": "HIGH"}
    b = {**a, "q_start": 1, "start": 0.0, "end": 10.5, "score": 0.5}
    for order in ([a, b], [b, a]):
        got = {r["q_start"]: r for r in folds.claim_gate(order)}
        assert not got[0]["duplicate"] and got[1]["duplicate"] and got[1]["level"] == "LOW"
    assert folds.union_length([(0, 2), (1, 3), (5, 6), (6, 6)]) == 4
    assert folds.duplicate_share((0, 4), [(0, 2), (1, 3)]) == 0.75


@pytest.mark.parametrize("seed", range(12))
def test_trimming_keeps_the_union(seed):
    rng = random.Random(seed)
    rows = spans(rng, 8, 30.0)
    before = folds.union_length([(r["start"], r["end"]) for r in rows])
    got = folds.trim_overlaps(rows)
    assert abs(folds.union_length([(r["start"], r["end"]) for r in got]) - before) < 0.1
    assert all(r["end"] - r["start"] >= 1 / 25 - 2e-3 for r in got)


def brute_trim(rows, fps=25.0, gap=0.05):
    """The timeline repair in its literal steps: a list of clips, walked by pairs of neighbours."""
    frame = 1.0 / fps
    clips = [dict(r) for r in sorted(rows, key=lambda r: (r["q_start"], r["q_end"]))]
    k = 0
    while k < len(clips) - 1:
        one, two = clips[k : k + 2]
        k += 1
        if two["q_start"] - one["q_end"] > gap or min(one["end"], two["end"]) - max(one["start"], two["start"]) <= 0:
            continue
        lo, hi = (one, two) if one["start"] <= two["start"] else (two, one)
        if lo["end"] >= hi["end"]:
            total = lo["end"] - lo["start"]
            before, after = hi["start"] - lo["start"], lo["end"] - hi["end"]
            if before >= frame and after >= frame:
                at = lo["q_start"] + (lo["q_end"] - lo["q_start"]) * before / total
                clips.insert(clips.index(lo) + 1, {**lo, "start": hi["end"], "q_start": at})
                lo["end"], lo["q_end"] = hi["start"], at
            elif before >= frame:
                hi["end"], lo["end"] = lo["end"], hi["start"]
            elif after >= frame:
                hi["start"], lo["start"] = lo["start"], hi["end"]
            elif total >= 2 * frame:
                m = (lo["start"] + lo["end"]) / 2
                hi["start"], hi["end"], lo["end"] = m, lo["end"], m
        else:
            m = min(max((hi["start"] + lo["end"]) / 2, lo["start"] + frame), hi["end"] - frame)
            if m - lo["start"] >= frame and hi["end"] - m >= frame:
                lo["end"], hi["start"] = m, m
    return [tuple(round(c[x], 3) for x in ("q_start", "q_end", "start", "end")) for c in clips]


@pytest.mark.parametrize("seed", range(40))
def test_trimming_equals_its_steps(seed):
    rng = random.Random(seed)
    rows = spans(rng, 9, 40.0)
    for r in rows[::3]:  # clips that lie inside a neighbour, with and without a frame to spare
        r["start"], r["end"] = 20.0, 20.0 + rng.choice((0.03, 3.0, 60.0))
    got = [tuple(r[x] for x in ("q_start", "q_end", "start", "end")) for r in folds.trim_overlaps([dict(r) for r in rows])]
    assert got == brute_trim(rows)


def test_hole_shares_the_record_slot_by_source_width():
    outer = {"start": 0.0, "end": 10.0, "q_start": 0.0, "q_end": 10.0}
    got = folds.trim_overlaps([outer, {"start": 4.0, "end": 5.0, "q_start": 10.0, "q_end": 11.0}])
    assert [(r["start"], r["end"], r["q_end"]) for r in got] == [(0.0, 4.0, 4.0), (5.0, 10.0, 10.0), (4.0, 5.0, 11.0)]


def test_split_shares_record_time(spark):
    from splicefind.operators.intervals import split_at

    clips = spark.createDataFrame([(1, 7, 0.0, 10.0, 0.0, 5.0), (1, 8, 3.9, 4.9, 5.0, 6.0)], "k int, row int, start double, end double, q_start double, q_end double")
    marks = spark.createDataFrame([(1, x) for x in (0.3, 4.0, 4.2, 9.8)] + [(2, 5.0)], "k int, at double")
    got = sorted(split_at(clips, marks, ["k"], "row", 3.0).collect(), key=lambda r: (r["row"], r["start"]))
    assert [(r["start"], r["end"], r["piece"]) for r in got] == [(0.0, 4.2, 0), (4.2, 10.0, 1), (3.9, 4.9, -1)]
    assert got[0]["q_start"] == 0.0 and got[1]["q_end"] == 5.0 and got[0]["q_end"] == got[1]["q_start"] == pytest.approx(2.1)


def test_as_of_by_buckets_equals_whole_series(spark):
    from splicefind.operators.asof import around

    rng = random.Random(4)
    left = spark.createDataFrame([(i % 2, rng.randrange(300) / 4) for i in range(120)] + [(0, None)], "k int, t double")
    right = spark.createDataFrame([(i % 3, rng.randrange(300) / 4, i) for i in range(60)], "k int, r double, x int")
    plain = around(left, right, ["k"], "t", "r", ["x"])
    dealt = around(left, right, ["k"], "t", "r", ["x"], width=5.0)
    assert sorted(map(str, plain.where("t is not null").collect())) == sorted(map(str, dealt.where("t is not null").collect()))
    assert dealt.where("t is null").count() == 1


def test_shift_uses_the_shifted_row_before():
    rows = [{"start": 0.0, "end": 2.0}, {"start": 0.5, "end": 2.5}, {"start": 2.2, "end": 3.2}]
    got = folds.shift_repeats(rows)
    assert [r["start"] for r in got] == [0.0, 2.0, 4.0]


def test_one_to_one_and_average_precision():
    assert folds.match_one_to_one([1.0, 1.3], [1.1, 1.15], 0.5) == [(0, 0), (1, 1)]

    def find(start, q, score=0.5):
        return {"start": start, "q_start": q, "q_end": q + 1.0, "score": score}

    truth = [find(10.0, 0.0), find(11.0, 0.2), find(50.0, 5.0)]
    # the stronger find claims the first truth in reach, not the nearest; the second one is left with the other
    assert folds.boundary_precision([find(11.0, 0.0, 0.9), find(10.2, 0.0, 0.8)], truth, 2.0) == (2 / 3, 2 / 3)
    # in time but without enough overlap on the query side: neither claimed nor recalled
    assert folds.boundary_precision([find(50.0, 5.6)], truth, 2.0) == (0.0, 0.0)
    # one find recalls two truths and claims one
    assert folds.boundary_precision([find(10.5, 0.1)], truth, 1.0) == (1 / 3, 2 / 3)
    assert folds.boundary_precision([], truth, 1.0) == (0.0, 0.0) and folds.boundary_precision([find(1.0, 0.0)], [], 1.0) == (0.0, 0.0)


def test_debounce_emits_the_held_frame_first():
    f = lambda t, p, s="a": {"ts": t, "percent": p, "stage": s}
    got = folds.debounce([f(0, 1), f(0.1, 2), f(0.2, 3), f(0.9, 4), f(1.0, 5)])
    assert [r["percent"] for r in got] == [1, 3, 4, 5]
    assert folds.debounce([]) == []


def test_boxes():
    assert folds.box_nms([(0, 0, 9, 9, 0.5), (1, 1, 9, 9, 0.9), (30, 30, 39, 39, 0.1)]) == [1, 2]
