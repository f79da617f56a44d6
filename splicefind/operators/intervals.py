"""Interval algebra on (keys, start, end) rows: merge, cover, complement, conflicts, snapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from splicefind.functions.vectors import col
from splicefind.operators.asof import nearest, overlap_join, range_join
from splicefind.operators.components import connected_components


def overlap(s1, e1, s2, e2) -> Column:
    return F.greatest(F.lit(0.0), F.least(col(e1), col(e2)) - F.greatest(col(s1), col(s2)))


def overlap_share(s1, e1, s2, e2) -> Column:
    return overlap(s1, e1, s2, e2) / F.greatest(F.lit(1e-6), col(e1) - col(s1))


def iou(s1, e1, s2, e2) -> Column:
    """Overlap by the hull; 0 when a span is null."""
    hull = F.greatest(col(e1), col(e2)) - F.least(col(s1), col(s2))
    whole = col(s1).isNotNull() & col(e1).isNotNull() & col(s2).isNotNull() & col(e2).isNotNull()  # greatest and least skip nulls
    return F.when(whole & (hull > 0), overlap(s1, e1, s2, e2) / hull).otherwise(0.0)


def merge(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", eps: float = 0.0) -> DataFrame:
    """Islands of touching or overlapping intervals: keys, island, start, end, n; empty ones are ignored."""
    w = W.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = df.where(F.col(end) > F.col(start)).withColumn("_new", F.coalesce((F.col(start) > reach + eps).cast("int"), F.lit(0)))
    rows = rows.withColumn("island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n"))


def union_length(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    return merge(df, keys, start, end).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("union_s"))


def covered_share(spans: DataFrame, claims: DataFrame, keys: list[str], row: str, width: float) -> DataFrame:
    """(keys, row, share): part of each span inside the union of the claims of its key; 0 for empty spans."""
    islands = merge(claims, keys).select(*keys, F.col("start").alias("_s"), F.col("end").alias("_e"))
    met = overlap_join(spans, islands, keys, "start", "end", "_s", "_e", width).groupBy(*keys, row).agg(F.sum(overlap("start", "end", "_s", "_e")).alias("_in"))
    out = spans.join(met, [*keys, row], "left")
    size = F.col("end") - F.col("start")
    return out.select(*keys, row, F.when(size > 0, F.least(F.lit(1.0), F.coalesce("_in", F.lit(0.0)) / size)).otherwise(0.0).alias("share"))


def gaps(df: DataFrame, keys: list[str], least: float = 0.0) -> DataFrame:
    """Free sub-intervals between the islands of each key, at least ``least`` wide."""
    w = W.partitionBy(*keys).orderBy("start")
    rows = merge(df, keys).select(*keys, F.col("end").alias("start"), F.lead("start").over(w).alias("end"))
    return rows.where(F.col("end") - F.col("start") >= least)


def overlap_audit(df: DataFrame, keys: list[str], order: str, width: float | None = None) -> DataFrame:
    """Per key: overlapping pairs of neighbours in ``order`` and of others, seconds claimed and covered, empty spans.

    No pair is made: of m spans that are not empty, those pairs do not overlap in which one ends before or where the other starts, and
    a running count of ends gives their number.  All windows share one shuffle on ``keys``; ``width`` is not needed any more.
    """
    part = W.partitionBy(*keys)
    size, wide = F.col("end") - F.col("start"), F.coalesce(F.col("end") > F.col("start"), F.lit(False))
    s, e = (F.lead(c).over(part.orderBy(order, "start", "end")) for c in ("start", "end"))
    near = wide & F.coalesce(e > s, F.lit(False)) & (F.least("end", e) - F.greatest("start", s) > 0)
    reach = F.max(F.when(wide, F.col("end"))).over(part.orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1))
    rows = df.withColumns({"_near": near, "_wide": wide}).withColumn("_new", F.when(wide, F.greatest(F.lit(0.0), F.col("end") - F.greatest("start", reach))))
    # each span as its end and its start; ends come first where both meet
    ends = F.filter(F.array(F.struct(F.col("end").alias("at"), F.lit(0).alias("kind")), F.struct(F.col("start").alias("at"), F.lit(1).alias("kind"))), lambda x: F.col("_wide") | (x["kind"] == 1))
    rows = rows.select(*keys, "start", "end", "_near", "_wide", "_new", F.explode(ends).alias("_x"))
    rows = rows.withColumn("_apart", F.sum((F.col("_x.kind") == 0).cast("long")).over(part.orderBy("_x.at", "_x.kind").rowsBetween(W.unboundedPreceding, 0)))
    total = rows.where("_x.kind = 1").groupBy(*keys).agg(
        F.sum(F.greatest(size, F.lit(0.0))).alias("claimed_s"), F.sum((size <= 0).cast("long")).alias("zero_width"), F.sum((size < 0.15).cast("long")).alias("fragments"), F.coalesce(F.sum("_new"), F.lit(0.0)).alias("union_s"),
        F.sum(F.col("_near").cast("long")).alias("adjacent"), F.sum(F.col("_wide").cast("long")).alias("_m"), F.coalesce(F.sum(F.when(F.col("_wide"), F.col("_apart"))), F.lit(0)).alias("_apart"),
    )
    met = F.expr("_m * (_m - 1) div 2") - F.col("_apart")
    return total.select(*keys, "adjacent", (met - F.col("adjacent")).alias("reused"), "claimed_s", "union_s", "zero_width", "fragments")


def boundaries(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct starts and ends."""
    return df.select(*keys, F.explode(F.array("start", "end")).alias("at")).distinct()


def snap(clips: DataFrame, marks: DataFrame, keys: list[str], tolerance: float = 1.0, least: float = 0.05, duration: float | None = None, width: float | None = None) -> DataFrame:
    """Move both ends to the nearest mark in tolerance; ends that would collapse the clip fall back.

    Adds new_start, new_end, snap_in, snap_out.
    """
    m = marks.select(*keys, F.col("at").alias("_at"))
    out = nearest(clips, m, keys, "start", "_at", [], tolerance, width).withColumn("_in", F.col("match.at")).drop("match")
    out = nearest(out, m, keys, "end", "_at", [], tolerance, width).withColumn("_out", F.col("match.at")).drop("match")
    clamp = (lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(duration))) if duration else (lambda c: c)
    a, b = clamp(F.coalesce("_in", "start")), clamp(F.coalesce("_out", "end"))
    out = out.withColumn("_a", a).withColumn("_b", b)
    bad = F.col("_b") <= F.col("_a") + least
    keep_in, keep_out = F.col("end") > F.col("_a") + least, F.col("_b") > F.col("start") + least
    case = F.when(~bad, 0).when(keep_in, 1).when(keep_out, 2).otherwise(3)  # 1: end falls back, 2: start, 3: both
    out = out.withColumn("_c", case)
    a, b = F.when(F.col("_c").isin(0, 1), F.col("_a")).otherwise(F.col("start")), F.when(F.col("_c").isin(0, 2), F.col("_b")).otherwise(F.col("end"))
    moved_in = F.col("_in").isNotNull() & F.col("_c").isin(0, 1) & (F.abs(a - F.col("start")) > 1e-9)
    moved_out = F.col("_out").isNotNull() & F.col("_c").isin(0, 2) & (F.abs(b - F.col("end")) > 1e-9)
    out = out.withColumns({"new_start": F.round(a, 3), "new_end": F.round(b, 3), "snap_in": moved_in, "snap_out": moved_out})
    return out.drop("_in", "_out", "_a", "_b", "_c")


def split_at(clips: DataFrame, marks: DataFrame, keys: list[str], row: str, width: float, edge: float = 0.5) -> DataFrame:
    """Cut clips at marks that lie more than ``edge`` inside them; the record slot is shared by source width.

    A piece narrower than ``edge`` extends the one before, so a cut stays exactly where the next one (or
    the clip's end) is at least ``edge`` away.  Adds piece (-1 for whole clips).
    """
    inner = clips.where(F.col("end") - F.col("start") > 2 * edge).select(*keys, row, (F.col("start") + edge).alias("_s"), (F.col("end") - edge).alias("_e"))
    met = range_join(marks.select(*keys, F.col("at").alias("_at")), inner, keys, "_at", "_s", "_e", width).where("_at > _s and _at < _e")
    cuts = met.groupBy(*keys, row).agg(F.array_sort(F.collect_set("_at")).alias("_c"))  # the marks inside one clip
    out = clips.join(cuts, [*keys, row], "left").withColumn("_c", F.coalesce("_c", F.array().cast("array<double>")))
    stays = F.filter("_c", lambda c, i: F.coalesce(F.get("_c", i + 1), F.col("end").cast("double")) - c >= edge)
    out = out.withColumn("_p", F.concat(F.array(F.col("start").cast("double")), stays, F.array(F.col("end").cast("double"))))
    many = F.size("_p") > 2
    out = out.withColumn("_i", F.explode(F.sequence(F.lit(0), F.size("_p") - 2)))
    a, b = F.get("_p", F.col("_i")), F.get("_p", F.col("_i") + 1)
    place = lambda x: F.col("q_start") + (F.col("q_end") - F.col("q_start")) * (x - F.col("start")) / (F.col("end") - F.col("start"))
    first, last = F.col("_i") == 0, F.col("_i") == F.size("_p") - 2
    new = {"_a": a, "_b": b, "_qa": F.when(first, F.col("q_start")).otherwise(place(a)), "_qb": F.when(last, F.col("q_end")).otherwise(place(b)), "piece": F.when(many, F.col("_i")).otherwise(-1)}
    return out.withColumns(new).drop("start", "end", "q_start", "q_end", "_c", "_p", "_i").withColumnsRenamed({"_a": "start", "_b": "end", "_qa": "q_start", "_qb": "q_end"})


# The texts of the two warnings.
FRAGMENT_TEXT = "LOC-2001 导出清单中有 %d 个不足 %.2f 秒的极短片段，导入剪辑软件后可能表现为闪烁或无效素材；建议在这些位置改用完整镜头边界。"
CLAIM_TEXT = "LOC-2002 第 %s 段都指向原片同一区间 %.1f-%.1fs，导出工程里会出现重复素材；若是刻意的画面复用可忽略，否则建议在剪辑软件中合并为一条。"
CLAIM_SEPARATOR = "、"
CLAIM_SQL = f"format('{CLAIM_TEXT.replace('%s', '{}').replace('%.1f', '{:.1f}')}', string_agg(CAST(i + 1 AS VARCHAR), '{CLAIM_SEPARATOR}' ORDER BY i), min(s), max(e))"


def fragment_warnings(clips: DataFrame, keys: list[str], least: float = 0.15) -> DataFrame:
    """(keys, fragments, warning) for each plan with clips narrower than ``least`` seconds."""
    few = clips.where(F.col("end") - F.col("start") < least).groupBy(*keys).agg(F.count("*").alias("fragments"))
    return few.withColumn("warning", F.format_string(FRAGMENT_TEXT, F.col("fragments").cast("int"), F.lit(least)))


def duplicate_claims(clips: DataFrame, keys: list[str], row: str, seg: str, width: float, share: float = 0.8, alike: float = 0.5) -> DataFrame:
    """Clips in groups that claim the same span: (keys, row, members, warning), connected over pairs.

    Two clips claim the same when their overlap is at least ``share`` of the narrower one and the narrower
    at least ``alike`` of the wider.
    """
    size = F.col("end") - F.col("start")
    live = clips.where(size > 0).select(*keys, row, "start", "end")
    other = live.select(*keys, F.col(row).alias("_r"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    met = overlap_join(live, other, keys, "start", "end", "_s", "_e", width).where(F.col(row) < F.col("_r"))
    a, b = size, F.col("_e") - F.col("_s")
    same = (F.least(a, b) / F.greatest(a, b) >= alike) & (overlap("start", "end", "_s", "_e") / F.greatest(F.lit(1e-6), F.least(a, b)) >= share)
    edges = met.where(same).select(F.col(row).alias("a"), F.col("_r").alias("b"))
    nodes = edges.select(F.explode(F.array("a", "b")).alias(row)).distinct()
    group = connected_components(nodes, edges, row)
    held = clips.join(group, row)
    segs = F.array_join(F.transform(F.array_sort(F.collect_set(F.col(seg).cast("long") + 1)), lambda x: x.cast("string")), CLAIM_SEPARATOR)
    text = held.groupBy("component").agg(F.count("*").alias("members"), segs.alias("_n"), F.min("start").alias("_lo"), F.max("end").alias("_hi"))
    text = text.select("component", "members", F.format_string(CLAIM_TEXT, "_n", "_lo", "_hi").alias("warning"))
    return held.join(text, "component").select(*keys, row, "members", "warning")


def expand(clips: DataFrame, scenes: DataFrame, keys: list[str], row: str, width: float, most: float = 60.0, rel_cap: float = 0.0) -> DataFrame:
    """Hull of the scenes a clip overlaps, unless wider than ``most`` or than ``rel_cap`` times the clip."""
    s = scenes.select(*keys, F.col("start").alias("_s"), F.col("end").alias("_e"))
    hull = overlap_join(clips.where("end > start"), s, keys, "start", "end", "_s", "_e", width).groupBy(*keys, row).agg(F.round(F.min("_s"), 2).alias("_s"), F.round(F.max("_e"), 2).alias("_e"))
    out = clips.join(hull, [*keys, row], "left")
    core, wide = F.col("end") - F.col("start"), F.col("_e") - F.col("_s")
    ok = (wide <= most) & (wide > core + 1e-6)
    if rel_cap > 0:
        ok = ok & (wide <= core * rel_cap + 1e-6)
    ok = F.coalesce(ok, F.lit(False))
    return out.withColumns({"new_start": F.when(ok, F.col("_s")).otherwise(F.col("start")), "new_end": F.when(ok, F.col("_e")).otherwise(F.col("end")), "expanded": ok}).drop("_s", "_e")


def chunks(df: DataFrame, step: str, start: str = "start", end: str = "end", times: float = 1.5) -> DataFrame:
    """Fixed-step pieces of spans wider than ``times`` the step; others stay whole."""
    long_ = (F.col(end) - F.col(start)) > times * F.col(step)
    n = F.when(long_, F.ceil((F.col(end) - F.col(start)) / F.col(step))).otherwise(1).cast("int")
    out = df.withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("_long", long_)
    a = F.when(F.col("_long"), F.col(start) + F.col("piece") * F.col(step)).otherwise(F.col(start))
    return out.withColumn("piece_start", a).withColumn("piece_end", F.when(F.col("_long"), F.least(F.col(end), a + F.col(step))).otherwise(F.col(end))).drop("_long")


def neighbours(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Add the spans and scores of the previous and next row of each series as _p* and _n*."""
    w = W.partitionBy(*keys).orderBy(order)
    out = df.withColumn("_mid", (F.col("start") + F.col("end")) / 2)
    for c in ("start", "end", "_mid", *(["score"] if "score" in df.columns else [])):
        name = c.lstrip("_")
        out = out.withColumn(f"_p{name}", F.lag(c).over(w)).withColumn(f"_n{name}", F.lead(c).over(w))
    return out


def temporal_outliers(df: DataFrame, keys: list[str], order: str, near: float = 180.0, far: float = 600.0) -> DataFrame:
    """Rows far from both neighbours while these are near each other."""
    n = neighbours(df, keys, order)
    hit = (F.abs(F.col("_nmid") - F.col("_pmid")) <= near) & (F.least(F.abs(F.col("_mid") - F.col("_pmid")), F.abs(F.col("_mid") - F.col("_nmid"))) >= far)
    return n.where(hit).select(*df.columns)


def overlap_neighbours(df: DataFrame, keys: list[str], order: str, least: float = 0.5) -> DataFrame:
    """Inner rows that overlap the row before or after by more than ``least``."""
    n = neighbours(df, keys, order).where("_pstart is not null and _nstart is not null")
    before, after = F.least("end", "_pend") - F.greatest("start", "_pstart"), F.least("end", "_nend") - F.greatest("start", "_nstart")
    return n.where((before > least) | (after > least)).select(*df.columns)


def span_conflicts(df: DataFrame, keys: list[str], order: str, most_width: float = 8.0, least: float = 0.5) -> DataFrame:
    """Narrow rows that clash with a neighbour of no lower score and fit the gap around them: adds gap_start, gap_end."""
    n = neighbours(df, keys, order).where("_pstart is not null and _nstart is not null")
    width = F.col("end") - F.col("start")
    before, after = F.least("end", "_pend") - F.greatest("start", "_pstart"), F.least("end", "_nend") - F.greatest("start", "_nstart")
    rival = F.when((after >= least) & ((before < least) | (after >= before)), F.col("_nscore")).when(before >= least, F.col("_pscore"))
    ok = (width > 0) & (width <= most_width) & (F.col("score") <= rival) & (F.col("_pend") <= F.col("_nstart")) & (F.col("_nstart") - F.col("_pend") >= width)
    return n.where(ok).select(*df.columns, F.col("_pend").alias("gap_start"), F.col("_nstart").alias("gap_end"))


def spikes(df: DataFrame, keys: list[str], order: str, x: str, delta: float = 80.0, peak: float = 180.0) -> DataFrame:
    """Rows that differ from the row before by ``delta`` with one of both at ``peak`` or above."""
    before = F.lag(x).over(W.partitionBy(*keys).orderBy(order))
    return df.withColumn("_b", before).where((F.abs(F.col(x) - F.col("_b")) >= delta) & (F.greatest(x, "_b") >= peak)).drop("_b")


def drop_near(rows: DataFrame, marks: DataFrame, keys: list[str], at: str, mark_at: str, margin: float) -> DataFrame:
    """Rows without a mark within +-margin (closed)."""
    out = nearest(rows, marks, keys, at, mark_at, [])
    return out.where(F.coalesce(F.abs(F.col("match.at") - F.col(at)) > margin, F.lit(True))).drop("match")
