"""Confidence terms, flags, levels, reasons and downgrades as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splicefind.functions.vectors import col

#: Weights of purity, margin, query coverage, cover, consistency, stability.
WEIGHTS = (0.30, 0.25, 0.15, 0.15, 0.08, 0.07)


def clip01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def margin(first: Column | str, second: Column | str) -> Column:
    """Relative lead over the runner-up, 1 without one."""
    first, second = col(first), col(second)
    return F.when(second.isNull(), 1.0).otherwise(clip01((first - second) / F.greatest(F.abs(first), F.lit(1e-6))))


def grade(df: DataFrame, width_lo: float = 1.0, width_hi: float = 60.0, least_run_s: float = 2.0) -> DataFrame:
    """Add score, flags, level, reasons to rows with the evidence columns.

    Needs mode, n_strong, margin, qcov, dispersion, best_cover, span_cover, best_sim, stability,
    run_len, run_s, width (null without a span).
    """
    cover = F.when(F.col("best_cover") > 0, F.col("best_cover")).otherwise(F.coalesce("span_cover", F.lit(0.0)))
    terms = (1 / F.greatest(F.col("n_strong"), F.lit(1)), F.col("margin"), clip01(F.col("qcov")), cover, clip01(F.col("best_sim")), F.col("stability"))
    raw = sum((w * t for w, t in zip(WEIGHTS[1:], terms[1:])), WEIGHTS[0] * terms[0])
    dark = (F.col("best_sim") >= 0.6) & ((cover < 0.3) | (F.col("mode") == "montage"))
    none = F.col("width").isNull()
    flags = F.array_compact(
        F.array(
            F.when(F.col("mode") == "montage", "montage"),
            F.when(F.coalesce((F.col("run_len") <= 1) | (F.col("run_s") < least_run_s), F.lit(True)), "finloc_unstable"),
            F.when((F.col("width") >= width_hi) | (F.col("width") < width_lo), "source_window_anomaly"),
            F.when((F.col("qcov") < 0.4) | (F.col("dispersion") >= 0.35), "query_coverage_dispersed"),
            F.when((F.col("n_strong") >= 2) & (F.col("margin") < 0.08), "low_candidate_margin"),
            F.when(F.col("n_strong") >= 2, "multiple_similar_candidates"),
        )
    )
    out = df.withColumn("_raw", F.when(none, 0.0).otherwise(raw * F.when(dark, 0.8).otherwise(1.0))).withColumn("flags", F.when(none, F.array(F.lit("no_evidence"))).otherwise(flags))
    level = F.when(none | (F.size("flags") > 0), "LOW").when((F.col("_raw") >= 0.75) & ~dark, "HIGH").when(F.col("_raw") >= 0.55, "MEDIUM").otherwise("LOW")
    out = out.withColumn("level", level).withColumn("score", F.round("_raw", 4)).drop("_raw")
    return out.withColumn("reasons", F.array_distinct(F.concat(F.when(dark & ~none, F.array(F.lit("dark_scene"))).otherwise(F.array().cast("array<string>")), "flags")))


def alternatives(spans: Column | str, primary: Column, band: float = 0.10) -> Column:
    """The spans (array of start, end, sim) but the one at index ``primary``: with relative similarity and level.

    MEDIUM within ``band`` of the primary's similarity, else LOW; empty without a primary.
    """
    spans = col(spans)
    best = F.coalesce(F.get(spans, primary)["sim"], F.lit(0.0))
    scale = F.greatest(F.abs(best), F.lit(1e-6))
    others = F.filter(spans, lambda s, i: i != primary)

    def graded(s: Column) -> Column:
        sim = F.coalesce(s["sim"], F.lit(0.0))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(best - sim <= band * scale, "MEDIUM").otherwise("LOW").alias("level"), F.round(clip01(sim / scale), 3).alias("relative"))

    return F.when(primary.isNull(), F.array()).otherwise(F.transform(others, graded))


def score_v2(local, coarse, consistency, margin_) -> Column:
    return clip01(0.4 * clip01(col(local)) + 0.3 * clip01(col(coarse)) + 0.2 * clip01(col(consistency)) + 0.1 * clip01(col(margin_)))


def reasons_v2(samples, local, consistency, margin_) -> Column:
    return F.array_compact(
        F.array(
            F.when(col(samples) < 3, "insufficient_samples"), F.when(clip01(col(consistency)) < 0.35, "weak_offset_support"),
            F.when(clip01(col(local)) < 0.55, "weak_local_consistency"), F.when(clip01(col(margin_)) < 0.03, "small_candidate_margin"),
        )
    )


def downgrade(level: Column | str, when: Column) -> Column:
    """One level down where ``when`` holds, never up."""
    level = col(level)
    return F.when(when & (level == "HIGH"), "MEDIUM").when(when & (level == "MEDIUM"), "LOW").otherwise(level)


def rank_of(level: Column | str) -> Column:
    level = col(level)
    return F.when(level == "HIGH", 2).when(level == "MEDIUM", 1).otherwise(0)


def accept_repair(alternative, current, least: float = 0.60, most_drop: float = 0.25) -> Column:
    return F.coalesce((col(alternative) >= least) & (col(current) - col(alternative) <= most_drop), F.lit(False))


def bound_span(start, end, support) -> tuple[Column, Column]:
    """Shrink around the centre to min(15, max(2, 4 * support)) seconds."""
    start, end = col(start), col(end)
    width = F.least(end - start, F.least(F.lit(15.0), F.greatest(F.lit(2.0), 4.0 * col(support))))
    mid = (start + end) / 2
    return mid - width / 2, mid + width / 2


def moment_gate(score, in_scope, level, least_in: float = 0.40, least_out: float = 0.20) -> tuple[Column, Column]:
    """(kept, level): in scope at 0.40; out of scope at 0.20 and then low."""
    kept = F.when(col(in_scope), col(score) >= least_in).otherwise(col(score) >= least_out)
    return kept, F.when(col(in_scope), col(level)).otherwise("low")


def weak(cover, sim, least_cover: float = 0.30, least_sim: float = 0.45) -> Column:
    """Both low: such spans are dropped."""
    return (col(cover) < least_cover) & F.coalesce(col(sim) < least_sim, F.lit(True))


def answerable(df: DataFrame) -> Column:
    """Not marked missing, failed, excluded or manual, and of positive width."""
    flags = [F.coalesce(F.col(c), F.lit(False)) for c in ("not_in_source", "failed", "excluded", "manual") if c in df.columns]
    out = F.coalesce(F.col("end") > F.col("start"), F.lit(False))
    for f in flags:
        out = out & ~f
    return out
