"""Sequential operators: each step depends on rows already accepted or changed.

A fold is a plain function on the ordered rows of one series (a shot, a video, a batch);
``fold`` deals the rows by key, sorts each partition and cuts the series inside the task, so
small series cost no set-up each.  Series are the unit of memory: one video's shots
or clips, never a source of the whole corpus.  Empty series give no rows.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BATCH_ROWS = 8192


def fold(df: DataFrame, keys: list[str], order: list[str], fn, extra: str = "", columns: list[str] | None = None) -> DataFrame:
    """Apply ``fn(rows: list of dicts) -> list of dicts`` to each ordered series.

    The result has the columns of ``df`` (or ``columns``) and those of ``extra`` ("name type, ...").
    """
    fields = [f for f in df.schema if columns is None or f.name in columns]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *([extra] if extra else [])])
    out_schema = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        rows = itertools.chain.from_iterable(b.to_pylist() for b in batches)
        done: list[dict] = []
        for _, series in itertools.groupby(rows, key=lambda r: tuple(r[k] for k in keys)):
            done += fn(list(series))
            if len(done) >= BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(done, out_schema)
                done = []
        yield pa.RecordBatch.from_pylist(done, out_schema)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """True where a row's keys differ from those of the row before; the first row's do."""
    new = np.zeros(len(table), bool)
    new[:1] = True
    for k in keys:
        c = table[k].combine_chunks()
        a, b = c.slice(1), c.slice(0, max(len(c) - 1, 0))
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(a.is_null(), b.is_null()))
        new[1:] |= differ.to_numpy(zero_copy_only=False).astype(bool)
    return new


def whole_keys(batches, keys: list[str]):
    """Tables of whole series from batches of rows sorted by their keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        both = pa.Table.from_batches([*(x.slice(x.num_rows - 1) for x in held[-1:]), batch])
        new = np.flatnonzero(changes(both, keys)[1:]) + (0 if held else 1)
        if len(new):  # the last series may go on in the next batch
            cut = int(new[-1])
            done = [*held, batch.slice(0, cut)]
            held = [batch.slice(cut)]
            if sum(x.num_rows for x in done):
                yield pa.Table.from_batches(done)
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


# ---- peaks and segments -------------------------------------------------------------------


def keep_strongest(at: list[float], strength: list[float], apart: float) -> list[int]:
    """Indices kept: strongest first (stable), each at least ``apart`` from all kept; in time order.

    A kept place silences its neighbourhood, found by bisection in time order.
    """
    t = np.asarray(at, float)
    by_time = np.argsort(t, kind="stable")
    line, rank = t[by_time], np.empty(len(t), np.int64)
    rank[by_time] = np.arange(len(t))
    silent = np.zeros(len(t), bool)
    kept = []
    for i in np.argsort(-np.asarray(strength, float), kind="stable"):
        if not silent[rank[i]]:
            kept.append(int(i))
            a, b = np.searchsorted(line, t[i] - apart), np.searchsorted(line, t[i] + apart, side="right")
            silent[a:b] |= np.abs(line[a:b] - t[i]) < apart
    return sorted(kept, key=lambda i: rank[i])


def merge_short(n: int, cuts: list[int], strength: list[float], least: int) -> list[int]:
    """Cuts left of 0..n: while a segment is too short, the weaker cut beside the first such goes (left on ties)."""
    order = np.argsort(np.asarray(cuts), kind="stable") if len(cuts) else np.zeros(0, np.int64)
    edge = np.concatenate([[0], np.asarray(cuts, np.int64)[order], [n]]).astype(np.int64)
    power = np.concatenate([[np.inf], np.asarray(strength, float)[order], [np.inf]])  # the ends never go
    while len(edge) > 2:
        short = np.flatnonzero(np.diff(edge) < least)
        if not len(short):
            break
        i = short[0]
        gone = i if power[i] <= power[i + 1] and i else i + 1
        if gone == len(edge) - 1:
            gone = i
        edge, power = np.delete(edge, gone), np.delete(power, gone)
    return edge[1:-1].tolist()


def padded_mean(x: np.ndarray, radius: int) -> np.ndarray:
    wide = np.pad(x, radius, mode="edge")
    return np.convolve(wide, np.ones(2 * radius + 1) / (2 * radius + 1), mode="valid")


def lag_distance(vectors: np.ndarray) -> np.ndarray:
    v = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-8)
    return 1 - (v[:-1] * v[1:]).sum(axis=1)


def detect_cuts(times: list[float], vectors: np.ndarray, cut_abs: float = 0.30, z: float = 2.0, smooth: int = 1, least_s: float = 1.0, fps: float | None = None) -> list[int]:
    """First rows of shots 2..n of one series."""
    if len(times) < 2:
        return []
    fps = fps or 1 / max(float(np.median(np.diff(times))), 1e-9)
    d = lag_distance(np.asarray(vectors, float))
    smooth |= 1
    s = padded_mean(d, smooth // 2)
    r = max(2 * smooth + 1, 7) // 2
    mu = padded_mean(s, r)
    sigma = np.sqrt(np.maximum(padded_mean(s * s, r) - mu * mu, 0))
    score = (s - mu) / np.maximum(sigma, 1e-4)
    peaks = [k for k in range(1, len(s) - 1) if s[k] >= s[k - 1] and s[k] >= s[k + 1] and s[k] >= cut_abs and score[k] >= z]
    gap = max(1, round(least_s * fps))
    kept = [peaks[i] for i in keep_strongest(peaks, [s[k] for k in peaks], gap)]
    return merge_short(len(times), [k + 1 for k in kept], [float(s[k]) for k in kept], gap)


def shots(rows: list[dict], two_level: bool = False, **options) -> list[dict]:
    """Rows (t, feature) -> shots (shot, start, end, n); ``two_level`` cuts shots over 8 s again, relaxed."""
    if not rows:
        return []
    t, v = [r["t"] for r in rows], np.array([r["feature"] for r in rows], float)
    edges = [0, *detect_cuts(t, v, **options), len(t)]
    if two_level:
        fine = {**options, "cut_abs": options.get("cut_abs", 0.30) * 0.75, "z": options.get("z", 2.0) * 0.85, "least_s": 0.6}
        for a, b in list(zip(edges, edges[1:])):
            if b - a >= 4 and t[b - 1] - t[a] > 8:
                edges += [a + c for c in detect_cuts(t[a:b], v[a:b], **fine)]
        edges = sorted(set(edges))
    head = {k: rows[0][k] for k in rows[0] if k not in ("t", "feature")}
    return [{**head, "shot": i, "start": t[a], "end": t[b - 1], "n": b - a} for i, (a, b) in enumerate(zip(edges, edges[1:]))]


def absorb_runs(flags: list[bool], least: int = 2) -> list[int]:
    """Cut flags between rows -> first rows of the pieces after the first; pieces under ``least`` rows join the one before."""
    cuts = [i + 1 for i, f in enumerate(flags) if f]
    out: list[int] = []
    n = len(flags) + 1
    for c, nxt in zip(cuts, [*cuts[1:], n]):
        if c - (out[-1] if out else 0) >= least and nxt - c >= least:
            out.append(c)
    return out


def fuse_bounds(cls: list[tuple[float, float, bool]], pix: list[tuple[float, bool]], times: list[float], least_s: float, fps: float, apart: float = 0.5) -> list[tuple[int, float]]:
    """Boundary rows with strength from two legs: (time, distance, gate) at 0.6 x distance, and (time, gate) at 1."""
    t = np.asarray(times)

    def snap(x: float) -> int:
        j = int(np.clip(np.searchsorted(t, x), 1, max(len(t) - 1, 1)))
        return j - 1 if x - t[j - 1] <= t[min(j, len(t) - 1)] - x else min(j, len(t) - 1)

    found = [(x, 0.6 * d) for x, d, ok in cls if ok] + [(float(t[snap(x)]), 1.0) for x, ok in pix if ok and 1 <= snap(x) < len(t)]
    kept = keep_strongest([x for x, _ in found], [s for _, s in found], apart)
    best: dict[int, float] = {}
    for i in kept:
        j = snap(found[i][0])
        best[j] = max(best.get(j, 0.0), found[i][1])
    rows = sorted(best)
    left = merge_short(len(t), rows, [best[j] for j in rows], max(1, round(least_s * fps)))
    return [(j, best[j]) for j in left]


def merge_marked(segments: list[tuple[float, float]], marks: list[float], share: float = 0.5) -> list[tuple[float, float]]:
    """Drop the segment after one that marks fill to ``share`` (itself when it is the last)."""
    drop = set()
    for i, (a, b) in enumerate(segments):
        inside = [m for m in marks if a <= m <= b]
        if inside:
            span = max(inside) - min(inside) if len(inside) > 1 else 0.05
            if min(1.0, span / max(1e-6, b - a)) >= share:
                drop.add(i + 1 if i + 1 < len(segments) else i)
    return [s for i, s in enumerate(segments) if i not in drop]


# ---- clusters -----------------------------------------------------------------------------


def continuity_ok(hits: list[dict], floor: float = 0.38, speed: tuple[float, float] = (0.0, 90.0)) -> bool:
    """Do the best hits of the query rows run forward, alike enough, at a plausible speed?"""
    best: dict[float, dict] = {}
    for h in hits:
        if h["q_t"] not in best or h["sim"] > best[h["q_t"]]["sim"]:
            best[h["q_t"]] = h
    reps = [best[q] for q in sorted(best)]
    if len(reps) == 1:
        return reps[0]["sim"] >= floor
    if any(b["l_t"] < a["l_t"] - 1e-6 for a, b in zip(reps, reps[1:])) or np.mean([r["sim"] for r in reps]) < floor:
        return False
    steps = [(b["l_t"] - a["l_t"]) / (b["q_t"] - a["q_t"]) for a, b in zip(reps, reps[1:]) if b["q_t"] - a["q_t"] > 0.01]
    return all(speed[0] <= s <= speed[1] for s in steps)


def continuity_clusters(rows: list[dict], base: float = 10.0, bridge: float = 15.0, most: float = 60.0, floor: float = 0.38) -> list[dict]:
    """Number hits (ordered by l_t) by cluster: gaps to ``base`` join, to ``bridge`` only if the whole runs on."""
    out, cur, no = [], [], 0
    for r in rows:
        if cur:
            gap = r["l_t"] - cur[-1]["l_t"]
            joins = gap <= base or (gap <= bridge and continuity_ok([*cur, r], floor))
            if not (joins and r["l_t"] - cur[0]["l_t"] <= most):
                no, cur = no + 1, []
        cur.append(r)
        out.append({**r, "cluster": no})
    return out


def spaced_best(rows: list[dict], k: int = 5, apart: float = 3.0) -> list[dict]:
    """Most similar rows at least ``apart`` seconds from each other, the first k."""
    out: list[dict] = []
    for r in sorted(rows, key=lambda r: -r["sim"]):
        if len(out) < k and all(abs(r["t"] - o["t"]) >= apart for o in out):
            out.append(r)
    return out


# ---- alignment ----------------------------------------------------------------------------


def monotone_path(sims: np.ndarray, least: float = 0.4, step: float = 1.0) -> list[tuple[int, int]]:
    """Diagonal moves of the best monotone alignment: match +sim, else -0.5 (diagonal, up, left on ties).

    Cells of one anti-diagonal do not depend on each other, so the table fills diagonal by diagonal.
    """
    n, m = sims.shape
    value = np.zeros((n + 1, m + 1))
    toll = np.where(sims >= least, 0.5 * step, 0.5)
    move = np.zeros((n, m), np.int8)
    for d in range(n + m - 1):
        i = np.arange(max(0, d - m + 1), min(n, d + 1))
        j = d - i
        choice = np.stack([value[i, j] + sims[i, j], value[i, j + 1] - toll[i, j], value[i + 1, j] - toll[i, j]])
        move[i, j] = choice.argmax(axis=0)
        value[i + 1, j + 1] = choice.max(axis=0)
    steps = {0: (1, 1), 1: (1, 0), 2: (0, 1)}
    at, path = (n - 1, m - 1), []
    while min(at) >= 0:
        kind = int(move[at])
        if kind == 0:
            path.append(at)
        at = (at[0] - steps[kind][0], at[1] - steps[kind][1])
    path.reverse()
    return path


def drop_drift(path: list[tuple[int, int]], most: int = 3) -> list[list[tuple[int, int]]]:
    """Pieces of a path without stretches of over ``most`` steps in one row or column.

    Paths of diagonal moves have none, so they stay in one piece.
    """
    out, cur, flat = [], [], 0
    for a, b in zip([None, *path], path):
        flat = flat + 1 if a is not None and (a[0] == b[0] or a[1] == b[1]) else 0
        if flat > most:
            if len(cur) > flat:
                out.append(cur[: len(cur) - flat])
            cur, flat = [], 0
        cur.append(b)
    return [*out, cur] if cur else out


def join_segments(segments: list[list[tuple[int, int]]], q_gap: int = 3, r_gap: int = 8) -> list[list[tuple[int, int]]]:
    out: list[list[tuple[int, int]]] = []
    for s in segments:
        if out and 0 <= s[0][0] - (out[-1][-1][0] + 1) <= q_gap and 0 <= s[0][1] - (out[-1][-1][1] + 1) <= r_gap:
            out[-1] = out[-1] + s
        else:
            out.append(s)
    return out


def align_moments(q: np.ndarray, r: np.ndarray, q_t: list[float], r_t: list[float], least: float = 0.40, hits: int = 2, least_s: float = 1.0, most_cells: int = 20_000) -> list[dict]:
    """Moments of a query inside a window: start and end +-1 s around the strongest column, score and label."""
    if not len(q) or not len(r) or len(q) * len(r) > most_cells:
        return []
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)
    sims = unit(np.asarray(q, float)) @ unit(np.asarray(r, float)).T
    out = []
    for s in join_segments(drop_drift(monotone_path(sims, least))):
        mean = float(np.mean([sims[i, j] for i, j in s]))
        i0, i1, j0, j1 = s[0][0], s[-1][0], s[0][1], s[-1][1]
        if len(s) < hits or mean < least or r_t[j1] - r_t[j0] < least_s:
            continue
        best = j0 + int(np.argmax(sims[i0 : i1 + 1, j0 : j1 + 1].sum(axis=0)))
        out.append({"q_start": q_t[i0], "q_end": q_t[i1], "start": max(0.0, r_t[best] - 1), "end": r_t[best] + 1, "score": mean, "label": "high" if mean >= 0.8 else "medium" if mean >= 0.6 else "low"})
    return out


def pair_scores(q: np.ndarray, r: np.ndarray) -> dict:
    """Centroid cosine, path mean, path sum by query rows and path share of two sequences."""
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-8)
    sims = unit(q) @ unit(r).T
    path = monotone_path(sims)
    v = [sims[i, j] for i, j in path]
    return {"centroid": float(unit(q.mean(axis=0)) @ unit(r.mean(axis=0))), "path_mean": float(np.mean(v)) if v else 0.0, "path_sum": float(np.sum(v)) / max(len(q), 1), "path_share": len(path) / max(len(q), 1)}


def sequence_rerank(rows: list[dict], back: float = 0.001, skip: float = 0.30, moved: float = 0.5) -> list[dict]:
    """Choose one candidate per shot over the whole sequence (or skip it).

    ``rows``: ordered shots with edited_mid and candidates [(mid, score), ...], the first one
    current.  Adds choice (index or None), norm and changed.  Shots with under two candidates
    stay out; a candidate after a skipped shot pays the skip again, measured from the edited time.
    """
    out = [{**r, "choice": None, "norm": None, "changed": False} for r in rows]
    live = [i for i, r in enumerate(rows) if len(r["candidates"]) >= 2]
    if len(live) < 2:
        return out
    layers, trace = [], []
    for place, i in enumerate(live):
        c = rows[i]["candidates"]
        top = max(s for _, s in c)
        norm = [s / top if top > 0 else 1.0 for _, s in c]
        if not place:
            layers.append([*norm, -skip])
            trace.append([None] * (len(c) + 1))
            continue
        before, prev = layers[-1], rows[live[place - 1]]["candidates"]
        values, back_to = [], []
        for (mid, _), n in zip(c, norm):
            best, at = -math.inf, None
            for k, v in enumerate(before):
                gain = v + n - back * max(0.0, prev[k][0] - mid) if k < len(prev) else v - skip + n - back * max(0.0, rows[i]["edited_mid"] - mid)
                if gain > best:
                    best, at = gain, k
            values.append(best)
            back_to.append(at)
        k = int(np.argmax(before))
        layers.append([*values, before[k] - skip])
        trace.append([*back_to, k])
    k = int(np.argmax(layers[-1]))
    for place in range(len(live) - 1, -1, -1):
        i = live[place]
        c = rows[i]["candidates"]
        if k < len(c):
            top = max(s for _, s in c)
            out[i] |= {"choice": k, "norm": c[k][1] / top if top > 0 else 1.0, "changed": abs(c[k][0] - c[0][0]) > moved}
        k = trace[place][k]
    return out


# ---- greedy claims and timelines ----------------------------------------------------------


def hull_iou(a: tuple[float, float], b: tuple[float, float]) -> float:
    hull = max(a[1], b[1]) - min(a[0], b[0])
    return max(0.0, min(a[1], b[1]) - max(a[0], b[0])) / hull if hull > 0 else 0.0


def iou_dedup(rows: list[dict], most: float = 0.60, keep: int = 4) -> list[dict]:
    """By cover x sim, spans that overlap no kept one by more than ``most``; the first ``keep``, in query order."""
    out: list[dict] = []
    for r in sorted(rows, key=lambda r: -(r["cover"] * r["sim"])):
        if len(out) < keep and all(hull_iou((r["start"], r["end"]), (o["start"], o["end"])) <= most for o in out):
            out.append(r)
    return sorted(out, key=lambda r: r["q_start"])


def gate_subspans(rows: list[dict], least_cover: float = 0.45, least_sim: float = 0.45, floor: bool = True, most: float = 0.60, keep: int = 4) -> list[dict]:
    """Drop spans low on both counts; with ``floor`` the best one stays if all would go; then IoU dedup."""
    good = [r for r in rows if not (r["cover"] < least_cover and r["sim"] < least_sim)]
    if not good and floor and rows:
        good = [max(rows, key=lambda r: r["cover"] * r["sim"])]
    return iou_dedup(good, most, keep)


def union_length(spans: list[tuple[float, float]]) -> float:
    total, end = 0.0, -math.inf
    for a, b in sorted(s for s in spans if s[1] > s[0]):
        total += max(0.0, b - max(a, end))
        end = max(end, b)
    return total


def duplicate_share(span: tuple[float, float], claims: list[tuple[float, float]]) -> float:
    width = span[1] - span[0]
    inside = union_length([(max(span[0], a), min(span[1], b)) for a, b in claims])
    return min(1.0, inside / width) if width > 0 else 0.0


def claim_gate(rows: list[dict], most: float = 0.8, reject: bool = True) -> list[dict]:
    """Strong rows claim first; a row covered by more than ``most`` of the claims is rejected (or only marked).

    Adds dup_share and duplicate; rejected rows get score 0 and level LOW and claim nothing.
    """
    claims: list[tuple[float, float]] = []
    out = []
    for r in sorted(rows, key=lambda r: (-r["score"], r["q_start"], r["q_end"])):
        share = duplicate_share((r["start"], r["end"]), claims)
        dup = share > most
        if not dup:
            claims.append((r["start"], r["end"]))
        out.append({**r, "dup_share": share, "duplicate": dup, **({"score": 0.0, "level": "LOW"} if dup and reject else {})})
    return sorted(out, key=lambda r: (r["q_start"], r["q_end"]))


def shift_repeats(rows: list[dict], near: float = 1.0, duration: float | None = None) -> list[dict]:
    """A row that starts within ``near`` of the row before (as shifted) moves to that row's end."""
    out: list[dict] = []
    for r in rows:
        r = {**r, "shifted": False}
        p = out[-1] if out else None
        if p and not r.get("manual") and abs(r["start"] - p["start"]) <= near:
            start, end = p["end"], p["end"] + (r["end"] - r["start"])
            if start > r["start"] and (duration is None or end <= duration):
                r |= {"start": start, "end": end, "shifted": True}
        out.append(r)
    return out


def timeline_prior(rows: list[dict], band: float = 45.0, drop: float = 0.10) -> list[dict]:
    """Rows with spans [(start, end, cover), ...] (first primary): off the last located midpoint by more than
    ``band``, the first span inside the band that loses at most ``drop`` of cover becomes primary."""
    out, anchor = [], None
    for r in rows:
        spans = list(r["spans"] or [])
        pick = 0
        if anchor is not None and len(spans) >= 2 and abs((spans[0][0] + spans[0][1]) / 2 - anchor) > band:
            pick = next((i for i, s in enumerate(spans) if i and abs((s[0] + s[1]) / 2 - anchor) <= band and spans[0][2] - s[2] <= drop), 0)
        if spans and r.get("located", True):
            anchor = (spans[pick][0] + spans[pick][1]) / 2
        out.append({**r, "pick": pick if spans else None})
    return out


class Clip:
    """A clip while its source span and record slot change."""

    __slots__ = ("added", "q", "row", "s")

    def __init__(self, row: dict, s: tuple[float, float], q: tuple[float, float], added: bool = False):
        self.row, self.s, self.q, self.added = row, s, q, added

    @property
    def width(self) -> float:
        return self.s[1] - self.s[0]

    def done(self) -> dict:
        (a, b), (p, q) = self.s, self.q
        return {**self.row, "start": round(a, 3), "end": round(b, 3), "q_start": round(p, 3), "q_end": round(q, 3), "inserted": self.added}


def punched(outer: Clip, inner: Clip, frame: float) -> Clip | None:
    """Take the inner clip's span out of the outer one; returns the tail, where head and tail both last a frame.

    A remainder under a frame goes to the inner clip; where neither side lasts a frame, both share the span evenly.
    """
    (a, b), (c, d) = outer.s, inner.s
    head, tail = c - a >= frame, b - d >= frame
    if head and tail:
        at = outer.q[0] + (outer.q[1] - outer.q[0]) * (c - a) / max(b - a, 1e-9)
        rest = Clip(outer.row, (d, b), (at, outer.q[1]), True)
        outer.s, outer.q = (a, c), (outer.q[0], at)
        return rest
    if head or tail:
        outer.s, inner.s = ((a, c), (c, b)) if head else ((d, b), (a, d))
    elif b - a >= 2 * frame:
        outer.s, inner.s = (a, (a + b) / 2), ((a + b) / 2, b)
    return None


def shared(first: Clip, second: Clip, frame: float) -> None:
    """Cut a partial overlap in its middle, if both keep a frame."""
    middle = (second.s[0] + first.s[1]) / 2
    middle = min(max(middle, first.s[0] + frame), second.s[1] - frame)
    if middle - first.s[0] >= frame and second.s[1] - middle >= frame:
        first.s, second.s = (first.s[0], middle), (middle, second.s[1])


def trim_overlaps(rows: list[dict], fps: float = 25.0, record_gap: float = 0.05) -> list[dict]:
    """Neighbours on the record line no longer share source time; their union stays covered.

    A tail that a punched hole leaves comes right after its head and is a neighbour of its own.
    """
    frame = 1.0 / fps
    todo = [Clip(r, (r["start"], r["end"]), (r["q_start"], r["q_end"])) for r in sorted(rows, key=lambda r: (r["q_start"], r["q_end"]))]
    todo.reverse()  # the next clip is the last
    out: list[Clip] = []
    while todo:
        clip = todo.pop()
        last = out[-1] if out else None
        if last and clip.q[0] - last.q[1] <= record_gap and min(last.s[1], clip.s[1]) > max(last.s[0], clip.s[0]):
            outer, other = (last, clip) if last.s[0] <= clip.s[0] else (clip, last)
            if outer.s[1] < other.s[1]:
                shared(outer, other, frame)
            elif (tail := punched(outer, other, frame)) is not None:
                if outer is clip:
                    todo.append(tail)
                else:  # head, tail, inner clip: the tail is met next, then the inner clip
                    todo += [clip, tail]
                    continue
        out.append(clip)
    return [c.done() for c in out]


def repair_conflicts(rows: list[dict], most_width: float = 8.0, least: float = 0.5, good: float = 0.60, drop: float = 0.25) -> list[dict]:
    """Move narrow clashing rows, lowest score first, to the best free place in the gap around them.

    The first row's ``series`` has (t, sim) of the library for these rows, as structs or as one struct of two arrays; other rows need
    none.  Positions change between steps.
    """
    out = [{**r, "moved": False} for r in rows]
    series = rows[0]["series"] or []
    t, sim = (series[c] if isinstance(series, dict) else [x[c] for x in series] for c in ("t", "sim"))
    t, sim = np.array(t, float), np.array(sim, float)
    order = np.argsort(t, kind="stable")
    t, sums = t[order], np.concatenate([[0.0], np.cumsum(sim[order])])

    def means(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Mean similarity in each [a, b]; nan without a row."""
        i, j = np.searchsorted(t, a), np.searchsorted(t, b, side="right")
        return np.where(j > i, (sums[j] - sums[i]) / np.maximum(j - i, 1), np.nan).round(9)

    for i in sorted(range(1, len(out) - 1), key=lambda i: out[i]["score"]):
        p, c, n = out[i - 1], out[i], out[i + 1]
        width = c["end"] - c["start"]
        over = [min(c["end"], o["end"]) - max(c["start"], o["start"]) for o in (p, n)]
        if not 0 < width <= most_width or max(over) < least:
            continue
        rival = n if over[1] >= least and (over[0] < least or over[1] >= over[0]) else p
        if c["score"] > rival["score"] or p["end"] > n["start"] or n["start"] - p["end"] < width:
            continue
        spots = np.unique(t[(t >= p["end"]) & (t + width <= n["start"])])
        for k, o in enumerate(out):
            if k != i:
                spots = spots[(spots + width <= o["start"]) | (spots >= o["end"])]
        worth = means(spots, spots + width)
        now = float(means(np.array([c["start"]]), np.array([c["end"]]))[0])
        if np.isfinite(worth).any() and np.isfinite(now):
            best = int(np.nanargmax(worth))
            if worth[best] >= good and now - worth[best] <= drop:
                out[i] |= {"start": float(spots[best]), "end": float(spots[best]) + width, "moved": True}
    return out


def box_nms(boxes: list[tuple[float, float, float, float, float]], most: float = 0.4) -> list[int]:
    """Boxes (x1, y1, x2, y2, score) kept, strongest first, by IoU with +1 pixel areas.

    Areas count to nine digits, so a box has the same area wherever it lies.
    """
    area = lambda b: round((b[2] - b[0] + 1) * (b[3] - b[1] + 1), 9)
    kept: list[int] = []
    for i in sorted(range(len(boxes)), key=lambda i: -boxes[i][4]):
        for j in kept:
            a, b = boxes[i], boxes[j]
            w, h = min(a[2], b[2]) - max(a[0], b[0]) + 1, min(a[3], b[3]) - max(a[1], b[1]) + 1
            inter = max(0.0, w) * max(0.0, h)
            if inter / (area(a) + area(b) - inter) > most:
                break
        else:
            kept.append(i)
    return kept


# ---- evaluation and progress --------------------------------------------------------------


def match_one_to_one(found: list[float], truth: list[float], tolerance: float) -> list[tuple[int, int]]:
    """(truth, found) pairs: each truth in order takes the nearest unused find within tolerance."""
    used: set[int] = set()
    out = []
    for i, g in enumerate(truth):
        best = min(((abs(p - g), j) for j, p in enumerate(found) if j not in used and abs(p - g) <= tolerance), default=None)
        if best:
            used.add(best[1])
            out.append((i, best[1]))
    return out


def boundary_precision(found: list[dict], truth: list[dict], tolerance: float, least: float = 0.5) -> tuple[float, float]:
    """(average precision, recall) of ranked finds at a tolerance; both have start, q_start and q_end.

    Down the ranks (score, then level, then place; the last two may be missing) each find claims the first unclaimed truth that it overlaps by ``least`` on the query side and meets within
    ``tolerance``.  A precision is counted at hits only, so it is 1 at each, and the average is the share of claimed truths.  Recall asks of each
    truth for its nearest overlapping find, claimed or not.
    """
    meets = lambda f, t: min(f["q_end"], t["q_end"]) - max(f["q_start"], t["q_start"]) >= least
    free = list(range(len(truth)))
    for f in sorted(found, key=lambda f: (-f["score"], -f.get("level", 0), f.get("place", 0))):
        mine = next((i for i in free if meets(f, truth[i]) and abs(f["start"] - truth[i]["start"]) <= tolerance), None)
        if mine is not None:
            free.remove(mine)
    near = [min((abs(f["start"] - t["start"]) for f in found if meets(f, t)), default=math.inf) for t in truth]
    n = len(truth)
    return ((n - len(free)) / n, sum(x <= tolerance for x in near) / n) if n else (0.0, 0.0)


def debounce(rows: list[dict], quiet: float = 0.5, flush: bool = True) -> list[dict]:
    """Frames (ts, stage, percent) published: the first, a new stage, the end, or after ``quiet`` seconds.

    A held frame comes out before the one that is due; ``flush`` emits the last held one.
    """
    out: list[dict] = []
    held = last = stage = None
    for r in rows:
        if last is None or r["percent"] >= 100 or r["stage"] != stage or r["ts"] - last >= quiet:
            if held is not None:
                out.append(held)
            out.append(r)
            held, last, stage = None, r["ts"], r["stage"]
        else:
            held = r
    return [*out, held] if flush and held is not None else out
