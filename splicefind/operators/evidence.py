"""Locating shots in full: frame clusters, recall pools of scenes and events, moments, rescue and assembly.

A *unit* is a place that some evidence points at: a cluster of a shot's best hits (kind FRAME), or a scene or an event alike to
the shot's mean (SCENE, EVENT).  All units of all shots go through one fine localisation, each with the query rows that speak for it
(a cluster's own rows, or the shot's mean): library rows of the units' windows come by a range join and meet the unit's rows in
one task a unit.  Which units stay is a short walk over one shot's units.  Scenes and events only add to what frames found; where frames
found nothing they take its place.  Shots are told apart by ``shot_no``, which may be any long, so parts of shots go the same way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from splicefind.functions.vectors import centroids, cosine
from splicefind.operators import grading
from splicefind.operators.asof import range_join
from splicefind.operators.components import reliable
from splicefind.operators.folds import align_moments, fold
from splicefind.operators.localize import coverage_runs
from splicefind.operators.repair import pool_frames
from splicefind.operators.retrieval import DIGITS, _matrix, top_k, topk_per_key
from splicefind.operators.timeseries import adjacent_distance, gap_clusters, over

FRAME, SCENE, EVENT = 0, 1, 2
KEYS = ["shot_no", "kind", "unit_no"]
PART = 1 << 20  # parts of a shot are numbered shot_no x PART + part


def frame_clusters(queries: DataFrame, library: DataFrame, gap: float = 15.0, least_rows: int = 2, least_sim: float = 0.40) -> tuple[DataFrame, DataFrame]:
    """(units, members): significant gap clusters of each shot's best hits, and their query rows (shot_no, unit_no, q_t)."""
    hits = reliable(gap_clusters(top_k(queries, library, 1), ["shot_no"], "l_t", gap, ["q_t"], "unit_no"))
    per = hits.groupBy("shot_no", "unit_no").agg(
        F.min("l_t").alias("c0"), F.max("l_t").alias("c1"), F.count("*").alias("n"), F.avg("sim").alias("_mean"), F.min("q_t").alias("q_start"), F.max("q_t").alias("q_end"), F.avg("l_t").alias("at")
    )
    units = per.where((F.col("n") >= least_rows) & (F.col("_mean") >= least_sim)).drop("_mean")
    return units, hits.join(units.select("shot_no", "unit_no"), ["shot_no", "unit_no"]).select("shot_no", "unit_no", "q_t")


def recall_units(middles: DataFrame, areas: DataFrame, library: DataFrame, best: int, budget: int, least_rows: int = 2, least_sim: float = 0.40, by_frames: bool = True) -> DataFrame:
    """(shot_no, unit_no, c0, c1, start, end, n): areas whose vectors are most like the shot's mean, frames taken up to a running budget.

    ``areas`` has scene_no, start, end, feature.  An area needs ``least_rows`` frames, and ``least_sim`` either of its frames' mean cosine
    (``by_frames``) or of its own vector; what it took from the budget stays taken.
    """
    rows = reliable(pool_frames(middles, areas, library, best, budget, -2.0))
    found = rows.groupBy("shot_no", "scene_no").agg(F.min("t").alias("c0"), F.max("t").alias("c1"), F.count("*").alias("n"), F.first("sim").alias("_sim"))
    if by_frames:
        vectors = rows.join(library.select(F.col("t"), F.col("feature").alias("_f")), "t").join(middles.select("shot_no", F.col("feature").alias("_q")), "shot_no")
        found = found.drop("_sim").join(vectors.groupBy("shot_no", "scene_no").agg(F.avg(cosine("_f", "_q")).alias("_sim")), ["shot_no", "scene_no"])
    kept = found.where((F.col("n") >= least_rows) & (F.round("_sim", DIGITS) >= least_sim))
    return kept.join(areas.select("scene_no", "start", "end"), "scene_no").select("shot_no", F.col("scene_no").cast("long").alias("unit_no"), "c0", "c1", "start", "end", "n")


def all_units(queries: DataFrame, library: DataFrame, scenes: DataFrame | None, events: DataFrame | None, pad: float = 15.0, gap: float = 15.0, least_rows: int = 2, least_sim: float = 0.40, best: int = 5, budget: int = 120, event_best: int = 3, event_budget: int = 240, area_sim: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(units, unit queries): units have the keys, c0, c1, lo, hi, n, nq, at and the edited interval; unit queries the keys and a feature.

    Frame clusters need ``least_sim``, areas ``area_sim`` (the same unless given).
    """
    frames, members = frame_clusters(queries, library, gap, least_rows, least_sim)
    lo, hi = F.greatest(F.lit(0.0), F.col("start") - pad).alias("lo"), (F.col("end") + pad).alias("hi")
    rest = ["c0", "c1", "lo", "hi", "n", "nq", "at", "q_start", "q_end"]
    units = frames.withColumns({"kind": F.lit(FRAME), "nq": F.col("n"), "start": F.col("c0"), "end": F.col("c1")}).select("*", lo, hi).select(*KEYS, *rest)
    mine = queries.select("shot_no", F.col("t").alias("q_t"), "feature").join(members, ["shot_no", "q_t"]).select("shot_no", F.lit(FRAME).alias("kind"), "unit_no", F.col("feature").cast("array<double>").alias("feature"))
    middles = reliable(centroids(queries, ["shot_no"], out="feature").withColumn("t", F.col("shot_no").cast("double")))
    whole = queries.groupBy("shot_no").agg(F.min("t").alias("q_start"), F.max("t").alias("q_end"))
    for kind, areas, few, rows in ((SCENE, scenes, best, budget), (EVENT, events, event_best, event_budget)):
        if areas is not None:
            found = reliable(recall_units(middles, areas, library, few, rows, least_rows, least_sim if area_sim is None else area_sim, kind == SCENE))
            found = found.join(whole, "shot_no").withColumns({"kind": F.lit(kind), "nq": F.lit(0).cast("long"), "at": F.lit(None).cast("double")})
            units = units.unionByName(found.select("*", lo, hi).select(*KEYS, *rest))
            mine = mine.unionByName(found.join(middles.select("shot_no", "feature"), "shot_no").select(*KEYS, "feature"))
    return units, mine


def unit_cover(units: DataFrame, unit_queries: DataFrame, library: DataFrame, width: float = 64.0) -> DataFrame:
    """(keys, t, lo, hi, cover): library rows of each unit's window with their best similarity to the unit's own query rows."""
    rows = range_join(library.where("feature is not null").select(F.col("t").cast("double").alias("t"), F.col("feature").alias("f")), units.select(*KEYS, "lo", "hi"), [], "t", "lo", "hi", width)
    names = [*KEYS, "t", "lo", "hi"]

    def task(key, rows, queries):
        cover = np.round((_matrix(rows["f"]) @ _matrix(queries["feature"]).T).max(axis=1), DIGITS) if len(rows) and len(queries) else np.zeros(0)
        return rows.select(names).slice(0, len(cover)).append_column("cover", pa.array(cover))

    return rows.select(*names, "f").groupBy(*KEYS).cogroup(unit_queries.withColumnsRenamed({k: f"_{k}" for k in KEYS}).groupBy(*(f"_{k}" for k in KEYS))).applyInArrow(task, "shot_no long, kind int, unit_no long, t double, lo double, hi double, cover double")


def located_units(units: DataFrame, cover: DataFrame, run_sim: float = 0.40) -> DataFrame:
    """``units`` with span, cover, sim, weak and the run's figures: a span is the pool's range and the longest run, for events the run alone."""
    out = units.join(coverage_runs(cover, KEYS, run_sim), KEYS, "left")
    whole = F.col("kind") != EVENT
    start = F.when(whole, F.least("c0", F.coalesce("run_start", "c0"))).otherwise(F.col("run_start"))
    end = F.when(whole, F.greatest("c1", F.coalesce("run_end", "c1"))).otherwise(F.col("run_end"))
    out = out.withColumns({"start": F.round(start, 2), "end": F.round(end, 2), "cover": F.round(F.coalesce("best_cover", F.lit(0.0)), 3), "sim": F.round("mean_sim", 3)})
    out = out.withColumn("weak", grading.weak("cover", "sim")).withColumn("run_s", F.col("run_end") - F.col("run_start"))
    return out.select(*units.columns, "start", "end", "cover", "sim", "weak", F.col("run_len").cast("long").alias("run_len"), "run_s", F.coalesce("stability", F.lit(0.0)).alias("stability"), F.round("tight_start", 2).alias("tight_start"), F.round("tight_end", 2).alias("tight_end"))


def settle(rows: list[dict], least_cover: float = 0.45, least_sim: float = 0.45, most: float = 0.60, keep: int = 4) -> list[dict]:
    """The units of one shot that stay, with rank (1 primary, 2 secondary, else 0), base (they carry the result) and the shot's counts.

    Weak units go; frame spans low on both counts go, but the best stays; overlaps of an IoU over ``most`` keep the stronger; scenes
    are held against the frames' spans, too, and events against both.
    """
    power = lambda r: r["cover"] * (r["sim"] or 0.0)
    strong = lambda r: not (r["cover"] < least_cover and (r["sim"] is None or r["sim"] < least_sim))

    def iou(a: dict, b: dict) -> float:
        if a["start"] is None or b["start"] is None:
            return 0.0
        whole = max(a["end"], b["end"]) - min(a["start"], b["start"])
        return max(0.0, min(a["end"], b["end"]) - max(a["start"], b["start"])) / whole if whole > 0 else 0.0

    def greedy(units: list[dict], against: list[dict]) -> list[dict]:
        out: list[dict] = []
        for r in sorted(units, key=power, reverse=True):
            if all(iou(r, k) <= most for k in out + against):
                out.append(r)
        return out[:keep]

    alive = [[r for r in rows if r["kind"] == kind and not r["weak"]] for kind in (FRAME, SCENE, EVENT)]
    frames = [r for r in alive[FRAME] if strong(r)] or sorted(alive[FRAME], key=power, reverse=True)[:1]
    frames = sorted(greedy(frames, []), key=lambda r: r["q_start"])
    scenes = greedy([r for r in alive[SCENE] if strong(r)], frames)
    events = greedy([r for r in alive[EVENT] if strong(r)], frames + scenes)
    base = frames or scenes or events
    if not base:
        return []
    first = max(base, key=lambda r: r["cover"])
    second = max((r for r in base if r is not first), key=lambda r: r["cover"], default=None)
    counts = {"n_strong": sum(r["kind"] == FRAME for r in rows), "rows_in": sum(r["nq"] for r in frames), "dispersion": float(np.std([r["at"] for r in frames])) if len(frames) > 1 else 0.0}
    return [{**r, "rank": 1 if r is first else 2 if r is second else 0, "base": r in base, **counts} for r in frames + scenes + events]


def settled_units(located: DataFrame) -> DataFrame:
    return fold(located, ["shot_no"], ["kind", "q_start", "unit_no"], settle, "rank int, base boolean, n_strong long, rows_in long, dispersion double")


def unit_moments(units: DataFrame, unit_queries: DataFrame, queries: DataFrame, library: DataFrame, pad: float = 15.0, most_s: float = 45.0, width: float = 64.0) -> DataFrame:
    """(keys, q_start, q_end, m_start, m_end, score, label): moments of each frame unit of at least two rows, by alignment around its place.

    The window is the unit's range and ``pad``, ``most_s`` at most around its middle.  Moments inside the unit's range need 0.40, others 0.20 and are low.
    """
    lo, hi = F.greatest(F.lit(0.0), F.col("c0") - pad), F.col("c1") + pad
    mid = (lo + hi) / 2
    wide = hi - lo > most_s
    few = units.where((F.col("kind") == FRAME) & (F.col("nq") >= 2)).select(*KEYS, "c0", "c1", F.col("q_start").alias("_q0"), F.col("q_end").alias("_q1"), F.when(wide, mid - most_s / 2).otherwise(lo).alias("_lo"), F.when(wide, mid + most_s / 2).otherwise(hi).alias("_hi"))
    rows = range_join(library.select(F.col("t").cast("double").alias("t"), "feature"), few, [], "t", "_lo", "_hi", width).select(*KEYS, "t", "feature")
    own = queries.select("shot_no", F.col("t").alias("q_t"), "feature").join(few, "shot_no").where((F.col("q_t") >= F.col("_q0") - 0.5) & (F.col("q_t") <= F.col("_q1") + 0.5))
    own = own.select(*(F.col(k).alias(f"_{k}") for k in KEYS), "q_t", F.col("feature").alias("q"))
    names = ["q_start", "q_end", "start", "end", "score", "label"]

    def task(key, rows, own):
        rows, own = rows.sort_by("t"), own.sort_by("q_t")
        found = align_moments(_matrix(own["q"]), _matrix(rows["feature"]), own["q_t"].to_pylist(), rows["t"].to_pylist()) if len(rows) and len(own) else []
        found = [{k: m[k] for k in names} | {"score": round(m["score"], DIGITS)} for m in found]
        head = {k: pa.array([v.as_py()] * len(found), kind) for k, v, kind in zip(KEYS, key, (pa.int64(), pa.int32(), pa.int64()))}
        return pa.table(head | {n: pa.array([m[n] for m in found], pa.string() if n == "label" else pa.float64()) for n in names})

    got = rows.groupBy(*KEYS).cogroup(own.groupBy(*(f"_{k}" for k in KEYS))).applyInArrow(task, "shot_no long, kind int, unit_no long, q_start double, q_end double, start double, end double, score double, label string")
    got = got.join(few.select(*KEYS, "c0", "c1"), KEYS)
    in_scope = (F.col("end") >= F.col("c0")) & (F.col("start") <= F.col("c1"))
    kept, label = grading.moment_gate("score", in_scope, "label")
    return got.where(kept).select(*KEYS, "q_start", "q_end", F.col("start").alias("m_start"), F.col("end").alias("m_end"), "score", label.alias("label"), in_scope.alias("in_scope"))


def locate(queries: DataFrame, library: DataFrame, scenes: DataFrame | None = None, events: DataFrame | None = None, run_sim: float = 0.40, moments: bool = True, **options) -> tuple[DataFrame, DataFrame | None]:
    """(settled units, moments of frame units) of every shot; ``options`` are those of `all_units`."""
    units, unit_queries = all_units(queries, library, scenes, events, **options)
    units = reliable(units)
    settled = reliable(settled_units(located_units(units, unit_cover(units, unit_queries, library), run_sim)))
    return settled, unit_moments(settled, unit_queries, queries, library) if moments else None


def assemble(shots: DataFrame, settled: DataFrame, moments: DataFrame | None) -> DataFrame:
    """One result a shot: the main span, its source, sub spans with provenance, score, level, reasons, failure.

    ``shots`` has shot_no, q_start, q_end, nq and, where they apply, card (a text card: not looked up) and failed (a reason).  A montage's main span is its
    primary unit's; else the best moment inside the primary's span comes first, then the best moment, the tight span, the span itself.
    """
    support = F.col("q_end") - F.col("q_start")
    main = settled.where("rank = 1").select("shot_no", *(F.col(c).alias(f"_{c}") for c in ("kind", "unit_no", "start", "end", "cover", "sim", "run_len", "run_s", "stability", "tight_start", "tight_end")), "n_strong", "rows_in", "dispersion")
    second = settled.where("rank = 2").select("shot_no", F.col("cover").alias("_second"))
    n_base = settled.where("base").groupBy("shot_no").agg(F.count("*").alias("_n_base"))
    out = shots.join(main, "shot_no", "left").join(second, "shot_no", "left").join(n_base, "shot_no", "left")
    if moments is not None:
        best = moments.join(settled.where("rank = 1").select(*KEYS, "start", "end"), KEYS)
        scope = (F.col("m_end") >= F.col("start")) & (F.col("m_start") <= F.col("end"))
        best = topk_per_key(best.withColumn("_scope", scope), ["shot_no"], [F.desc("_scope"), F.desc("score"), "m_start"], 1).select("shot_no", "m_start", "m_end")
        out = out.join(best, "shot_no", "left")
    else:
        out = out.withColumns({"m_start": F.lit(None).cast("double"), "m_end": F.lit(None).cast("double")})
    montage = F.coalesce((F.col("n_strong") >= 2) & (F.col("_n_base") >= 2) & (F.col("_kind") == FRAME), F.lit(False))
    core = [F.when(montage, F.col(f"_{e}")).otherwise(F.coalesce(f"m_{e}", f"_tight_{e}", f"_{e}")) for e in ("start", "end")]
    a, b = grading.bound_span(core[0], core[1], support)
    card, failed = (F.coalesce(F.col(c), F.lit(x)) if c in shots.columns else F.lit(x) for c, x in (("card", False), ("failed", None)))
    off = card | failed.isNotNull() if "failed" in shots.columns else card
    out = out.withColumns({
        "mode": F.when(F.col("_kind").isNull(), "empty").when(F.col("n_strong") >= 2, "montage").otherwise("clean"), "margin": grading.margin("_cover", "_second"), "qcov": F.round(F.coalesce("rows_in", F.lit(0)) / F.greatest(F.col("nq"), F.lit(1)), 3),
        "dispersion": F.round(F.coalesce("dispersion", F.lit(0.0)), 3), "n_strong": F.coalesce("n_strong", F.lit(0)), "best_cover": F.coalesce("_cover", F.lit(0.0)), "span_cover": F.col("_cover"), "best_sim": F.coalesce("_sim", F.lit(0.0)),
        "stability": F.coalesce("_stability", F.lit(0.0)), "run_len": F.col("_run_len"), "run_s": F.col("_run_s"), "width": F.col("_end") - F.col("_start"), "_a": F.round(a, 2), "_b": F.round(b, 2), "_off": off, "_card": card, "_montage": montage,
    })
    graded = grading.grade(out)
    source = F.when(montage, "cluster").when(F.col("m_start").isNotNull(), "moment").when(F.col("_kind") == FRAME, "cluster").when(F.col("_kind") == SCENE, "scene_pool").when(F.col("_kind") == EVENT, "event_pool")
    none = F.col("_off") | F.col("_kind").isNull()
    failure = F.when(F.col("_card"), "text_card_not_in_source").when(F.col("_off"), failed if "failed" in shots.columns else F.lit(None)).when(F.col("_kind").isNull(), "no_evidence")
    subs = settled.where((F.col("kind") != FRAME) | (F.col("n_strong") >= 2)).groupBy("shot_no").agg(F.array_sort(F.collect_list(F.struct("start", "end", "cover", "sim", (F.col("kind") == SCENE).alias("from_scene_pool"), (F.col("kind") == EVENT).alias("from_event_pool")))).alias("_subs"))
    graded = graded.join(subs, "shot_no", "left")
    return graded.select(
        "shot_no", F.when(none, None).otherwise(F.col("_a")).alias("start"), F.when(none, None).otherwise(F.col("_b")).alias("end"), F.when(~none, source).alias("source"), (F.col("_montage") & ~none).alias("montage"),
        F.when(none, 0.0).otherwise(F.col("score")).alias("score"), F.when(none, "LOW").otherwise(F.col("level")).alias("level"), F.when(none, F.array(failure)).otherwise(F.col("reasons")).alias("reasons"), F.when(none, failure).alias("failure"),
        F.col("_card").alias("not_in_source"), F.when(none, None).otherwise(F.col("_subs")).alias("sub_spans"),
    )


def sub_shots(queries: DataFrame, cut: float = 0.5, least_rows: int = 6, least_parts: int = 3) -> DataFrame:
    """The rows of shots that fall apart, with ``shot_no`` x PART + part as their shot and the shot as ``parent``.

    A part starts at a row whose distance to the row before is over ``cut``; of cuts at consecutive rows every other one counts.  Shots of under ``least_rows`` rows
    or ``least_parts`` parts have none.
    """
    w = over(["shot_no"], "t")
    rows = queries.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(W.partitionBy("shot_no")))
    d = adjacent_distance(rows.select("shot_no", "t", "feature", F.lead("_i").over(w).alias("_at"), "_n"), ["shot_no"]).where((F.round("distance", DIGITS) > cut) & (F.col("_n") >= least_rows))
    island = d.withColumn("_g", F.col("_at") - F.row_number().over(over(["shot_no"], "_at")))
    cuts = island.withColumn("_first", F.min("_at").over(W.partitionBy("shot_no", "_g"))).where((F.col("_at") - F.col("_first")) % 2 == 0)
    parts = rows.join(cuts.select("shot_no", F.col("_at").alias("_i"), F.lit(1).alias("_cut")), ["shot_no", "_i"], "left").withColumn("part", F.sum(F.coalesce("_cut", F.lit(0))).over(over(["shot_no"], "_i").rowsBetween(W.unboundedPreceding, 0)))
    parts = parts.withColumn("_parts", F.max("part").over(W.partitionBy("shot_no")) + 1).where((F.col("_parts") >= least_parts) & (F.col("_n") >= least_rows))
    return parts.select((F.col("shot_no") * PART + F.col("part")).alias("shot_no"), "t", "feature", F.col("shot_no").alias("parent"), F.col("part").cast("int").alias("part"))


def relocate_by_parts(queries: DataFrame, library: DataFrame, cut: float = 0.5, most_short: int = 6, least_parts: int = 3, run_sim: float = 0.40, **options) -> DataFrame:
    """(shot_no, part, start, end, cover, sim, best_sim): the best located part of each shot that falls apart, all parts in one pass.

    A part counts by the largest similarity of its units; of equal parts the first.  ``most_short`` and ``least_parts`` are the bounds of `sub_shots`, ``options`` those of
    `all_units`.
    """
    parts = reliable(sub_shots(queries, cut, most_short, least_parts))
    units, own = all_units(parts.select("shot_no", "t", "feature"), library, None, None, **options)
    units = reliable(units)
    located = reliable(located_units(units, unit_cover(units, own, library), run_sim))
    best = located.groupBy("shot_no").agg(F.max("sim").alias("best_sim"))
    main = settled_units(located).where("rank = 1 and start is not null").select("shot_no", "start", "end", "cover", "sim").join(best.where("best_sim is not null"), "shot_no")
    main = main.select(F.floor(F.col("shot_no") / PART).cast("long").alias("shot_no"), F.pmod("shot_no", F.lit(PART)).cast("int").alias("part"), "start", "end", "cover", "sim", "best_sim")
    return topk_per_key(main, ["shot_no"], [F.desc("best_sim"), "part"], 1).drop("rank")
