"""Whole chains: locating query shots in a library, and preparing an export plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from splicefind.operators import export, folds, grading, intervals, localize
from splicefind.operators.components import reliable
from splicefind.operators.retrieval import top_k


def locate(queries: DataFrame, library: DataFrame, gap: float = 15.0, least_rows: int = 2, least_sim: float = 0.40, pad: float = 15.0, run_sim: float = 0.4) -> DataFrame:
    """One row per shot: primary and secondary span, all kept spans, mode, confidence.

    Best hits -> gap clusters -> fine localisation in padded windows -> span = cluster or run hull ->
    weak spans go (both cover and similarity low) -> greedy overlap removal -> grading.  Shots without
    evidence come back with null spans and level LOW.
    """
    hits = top_k(queries, library, 1)
    clusters = localize.evidence_clusters(hits, gap, least_rows, least_sim)
    keys = ["shot_no", "cluster_no"]
    runs = localize.coverage_runs(localize.window_cover(clusters, queries, library, keys, pad=pad), keys, run_sim)
    rows = clusters.select(*keys, F.col("start").alias("c0"), F.col("end").alias("c1"), "n", F.col("mean_sim").alias("sim")).join(runs, keys, "left")
    rows = rows.withColumn("start", F.least("c0", F.coalesce("run_start", "c0"))).withColumn("end", F.greatest("c1", F.coalesce("run_end", "c1"))).withColumn("cover", F.coalesce("best_cover", F.lit(0.0)))
    rows = rows.where(~grading.weak("cover", "sim")).withColumn("q_start", F.col("start"))
    flat = rows.select("shot_no", "q_start", "start", "end", "cover", "sim", "n", F.coalesce("run_len", F.lit(0)).cast("long").alias("run_len"), (F.coalesce("run_end", "start") - F.coalesce("run_start", "start")).alias("run_s"), F.coalesce("stability", F.lit(0.0)).alias("stability"))
    kept = folds.fold(flat, ["shot_no"], ["start"], folds.gate_subspans)
    first = F.row_number().over(W.partitionBy("shot_no").orderBy(F.desc("cover"), "start"))
    ranked = kept.withColumn("rank", first)
    span = lambda k: F.max(F.when(F.col("rank") == k, F.struct("start", "end", "cover", "sim", "run_len", "run_s", "stability")))
    per = ranked.groupBy("shot_no").agg(span(1).alias("primary"), span(2).alias("secondary"), F.array_sort(F.collect_list(F.struct("start", "end", "cover", "sim"))).alias("spans"))
    mode = localize.evidence_mode(clusters, queries)
    out = mode.join(per, "shot_no", "left").withColumns(
        {
            "margin": grading.margin("primary.cover", "secondary.cover"), "best_cover": F.coalesce("primary.cover", F.lit(0.0)), "span_cover": F.col("primary.cover"), "best_sim": F.coalesce("primary.sim", F.lit(0.0)),
            "stability": F.coalesce("primary.stability", F.lit(0.0)), "run_len": F.col("primary.run_len"), "run_s": F.col("primary.run_s"), "width": F.col("primary.end") - F.col("primary.start"),
        }
    )
    return grading.grade(out).select("shot_no", "mode", "nq", "qcov", "primary", "secondary", "spans", "score", "level", "flags", "reasons")


def channel_plan(results: DataFrame, scenes: DataFrame, keys: list[str], width: float, least: str = "MEDIUM", tolerance: float = 1.0, fps: float = 25.0, low_policy: str = "exclude", snap: bool = True, split: bool = True, expand: bool = True) -> dict[str, DataFrame]:
    """plan, warnings, before and after (the two audits), in the fixed order.

    Flatten, warn of fragments, snap to scene edges, split at scene edges, expand to scenes (but split
    pieces), audit, trim overlaps, audit.  ``snap``, ``split`` and ``expand`` turn single steps off.  ``results`` and ``scenes`` carry ``keys`` (the source); see
    ``export.export_plan`` for the rest.
    """
    plan = export.export_plan(results, least, low_policy).join(results.select("seg_index", *keys), "seg_index")
    warnings = intervals.fragment_warnings(plan, keys)
    marks = intervals.boundaries(scenes, keys)
    renamed = {"new_start": "start", "new_end": "end"}
    row = (intervals.snap(plan, marks, keys, tolerance, width=width).drop("start", "end").withColumnsRenamed(renamed) if snap else plan).withColumn("_row", F.concat_ws(":", "seg_index", "sub_index"))
    subs = row.where("kind = 'sub'").withColumn("piece", F.lit(-1))
    mains = row.where("kind <> 'sub'")
    pieces = subs.unionByName(intervals.split_at(mains, marks, keys, "_row", width) if split else mains.withColumn("piece", F.lit(-1)), allowMissingColumns=True)
    whole = pieces.where("piece < 0")
    whole = intervals.expand(whole, scenes, keys, "_row", width, rel_cap=1.5).drop("start", "end").withColumnsRenamed(renamed) if expand else whole.withColumn("expanded", F.lit(False))
    # read by both audits and the trimming, so kept
    wide = reliable(whole.unionByName(pieces.where("piece >= 0").withColumn("expanded", F.lit(False))))
    mains = wide.where("kind <> 'sub'")
    before = intervals.overlap_audit(mains, keys, "q_start", width)
    trimmed = folds.fold(mains, keys, ["q_start", "q_end", "seg_index", "piece"], lambda r: folds.trim_overlaps(r, fps), "inserted boolean")
    return {"plan": trimmed.unionByName(wide.where("kind = 'sub'").withColumn("inserted", F.lit(False))), "warnings": warnings, "before": before, "after": intervals.overlap_audit(trimmed, keys, "q_start", width)}


def fcp_xml(plan: DataFrame, keys: list[str], title: str, fps: float) -> DataFrame:
    """One xmeml text per timeline: track 1 main clips, track 2 low ones, track 3 on the k-th sub spans."""
    f = lambda c: F.greatest(F.lit(0), F.bround(F.col(c) * fps)).cast("long").cast("string")
    track = F.when(F.col("kind") == "main", 1).when(F.col("kind") == "low", 2).otherwise(3 + F.col("sub_index"))
    item = F.concat(F.lit('<clipitem id="c'), F.col("seg_index").cast("string"), F.lit("-"), F.col("sub_index").cast("string"), F.lit('"><start>'), f("q_start"), F.lit("</start><end>"), f("q_end"), F.lit("</end><in>"), f("start"), F.lit("</in><out>"), f("end"), F.lit("</out></clipitem>"))
    tracks = plan.withColumn("track", track).groupBy(*keys, "track").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("q_start", "seg_index", item.alias("x")))), lambda s: s["x"]), "").alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("track", "x"))), lambda s: F.concat(F.lit("<track>"), s["x"], F.lit("</track>"))), "")
    head = f'<?xml version="1.0" encoding="UTF-8"?><!DOCTYPE xmeml><xmeml version="4"><sequence><name>{title}</name><rate><timebase>{round(fps)}</timebase><ntsc>{"TRUE" if abs(fps - round(fps)) > 0.01 else "FALSE"}</ntsc></rate><media><video>'
    return tracks.groupBy(*keys).agg(F.concat(F.lit(head), body, F.lit("</video></media></sequence></xmeml>")).alias("text"))


FORMATS = ("edl", "fcp7_xml", "draft")


def export_project(results: DataFrame, scenes: DataFrame | None, keys: list[str], fmt: str, title: str, source: str, fps: float = 25.0, least: str = "MEDIUM", low_policy: str = "exclude", snap: bool = True, material: str = "scene", width: float = 64.0) -> dict[str, DataFrame]:
    """files (keys, file, text), plan and warnings of each timeline in one format: ``edl``, ``fcp7_xml`` or ``draft`` (clips as JSON lines).

    All formats share one channel plan; only a draft widens its clips to whole scenes, and only with ``material`` = ``scene``.  Without ``scenes``
    nothing is snapped, split or widened.  Rows that are marked not_in_source or failed, and those without a span, are not exported.
    """
    for name, value, allowed in (("fmt", fmt, FORMATS), ("least", least, ("LOW", "MEDIUM", "HIGH")), ("low_policy", low_policy, ("exclude", "backup")), ("material", material, ("scene", "core"))):
        if value not in allowed:
            raise ValueError(f"invalid {name}: {value!r}, expected one of {allowed}")
    for mark in ("not_in_source", "failed"):
        if mark in results.columns:
            results = results.where(~F.coalesce(F.col(mark), F.lit(False)))
    known = scenes is not None
    none = results.sparkSession.createDataFrame([], ", ".join([*(f"`{k}` {results.schema[k].dataType.simpleString()}" for k in keys), "start double, end double"]))
    out = channel_plan(results, scenes if known else none, keys, width, least, fps=fps, low_policy=low_policy, snap=snap and known, split=known, expand=known and fmt == "draft" and material == "scene")
    plan = out["plan"]
    if fmt == "edl":
        text, ending = export.edl_text(plan, keys, title, source, fps), "loc.edl"
    elif fmt == "fcp7_xml":
        text, ending = fcp_xml(plan, keys, title, fps), "loc.xml"
    else:
        clips = export.reel_plan(plan, keys)
        line = F.to_json(F.struct("stem", "start", "end", "placed", "width"))
        text = clips.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("placed", line.alias("x")))), lambda c: c["x"]), "\n").alias("text"))
        ending = "draft.jsonl"
    name = F.concat_ws("-", *(F.regexp_replace(F.col(k).cast("string"), r"[^0-9A-Za-z_]", "_") for k in keys))
    return {"files": text.select(*keys, F.concat(name, F.lit(f".{ending}")).alias("file"), "text"), "plan": plan, "warnings": out["warnings"]}


def write_files(files: DataFrame, path: str) -> None:
    """One folder per file name under ``path``, each with its text."""
    files.select("file", "text").write.partitionBy("file").option("lineSep", "\n").text(path)
