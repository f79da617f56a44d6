"""Located spans that hold several shots: cuts by steps and valleys, children placed one to one or by their own rows.

``parents`` has a key, q_start, q_end, start, end and one row a span; ``frames`` has the key, t and feature: the rows sampled from
the span's query side (tens, not the film).  All steps are windows over one span's rows, equi-joins on the key and banded range
joins with the library, so a library row meets a frame only inside the span's window.  Null times, features and keys take no part;
rows of one time and key are one frame (the smallest feature).  Similarities are rounded to DIGITS before they are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from splicefind.functions.vectors import cosine
from splicefind.operators.asof import range_join
from splicefind.operators.components import reliable
from splicefind.operators.retrieval import DIGITS
from splicefind.operators.timeseries import over

WIDTH = 64.0  # seconds of a bucket of the range joins


def shot_rows(frames: DataFrame, keys: list[str], hard: float = 0.55, depth: float = 0.10) -> DataFrame:
    """(keys, t, feature, shot): each frame with its shot's number from 0, null before the first shot.

    A cut lies before a row whose cosine with the row before is under ``hard``, or ``depth`` below both neighbouring cosines (not at
    the series' first and last one).  A piece of one row joins the shot before it; before any shot of two rows it belongs to none.
    """
    rows = frames.where(F.col("t").isNotNull() & F.col("feature").isNotNull()).groupBy(*keys, F.col("t").cast("double").alias("t")).agg(F.min("feature").alias("feature"))
    w = over(keys, "t")
    rows = rows.withColumn("_sim", F.round(cosine(F.lag("feature").over(w), "feature"), DIGITS))
    before, after = F.lag("_sim").over(w), F.lead("_sim").over(w)
    valley = F.coalesce(F.col("_sim") < F.least(before, after) - depth, F.lit(False)) & before.isNotNull() & after.isNotNull()
    cut = F.coalesce(F.col("_sim") < hard, F.lit(False)) | valley
    rows = rows.withColumn("_cut", cut.cast("int")).withColumn("_piece", F.sum("_cut").over(w))
    piece = W.partitionBy(*keys, "_piece")
    first = (F.row_number().over(piece.orderBy("t")) == 1) & (F.count("*").over(piece) >= 2)
    shot = F.sum(first.cast("int")).over(w) - 1
    return rows.withColumn("shot", F.when(shot >= 0, shot)).select(*keys, "t", "feature", F.col("shot").cast("int").alias("shot"))


def cut_shots(frames: DataFrame, keys: list[str], hard: float = 0.55, depth: float = 0.10) -> DataFrame:
    """(keys, shot, start, end, n): the shots of each series, by the times of their first and last rows.

    A series of one row is one shot; a series whose pieces are all of one row has none.
    """
    rows = shot_rows(frames, keys, hard, depth)
    lone = F.count("*").over(W.partitionBy(*keys)) == 1
    rows = rows.withColumn("shot", F.when(lone, F.lit(0)).otherwise(F.col("shot"))).where("shot is not null")
    return rows.groupBy(*keys, "shot").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n"))


def split_shots(parents: DataFrame, frames: DataFrame, library: DataFrame, key: str, hard: float = 0.55, depth: float = 0.10, radius: float = 30.0, agree: float = 0.5, near: float = 1.5, tolerance: float = 1.0, margin: float = 0.05, least_move: float = 0.5, width: float = WIDTH) -> DataFrame:
    """(key, child, q_start, q_end, start, end, refined, parent_start, parent_end): every parent as its shots.

    Children part the query span without gaps, halfway between one shot's last and the next one's first row, and lie one to one in the parent's place.  A child
    of two rows and more moves by the median offset of its rows' best library rows within +-``radius`` of the parent's middle, if a share of
    ``agree`` lies within ``near`` of the median, the move is ``least_move`` at least, and its mean similarity (per row the best
    within ``tolerance``, 0 without any) is ``margin`` higher there.  A parent with fewer than two shots, with an empty span on a side or
    without library rows around stays one child (0), unrounded; so does one with null times.
    """
    whole = parents.select(key, *[F.col(c).cast("double").alias(c) for c in ("q_start", "q_end", "start", "end")])
    fit = whole.where("end - start > 0.01 and q_end - q_start > 0.01")
    rows = shot_rows(frames.join(fit.select(key), key, "left_semi"), [key], hard, depth)
    # rows before the first shot count for the first child, but not for where its own span begins
    rows = rows.withColumn("_real", F.col("shot").isNotNull()).withColumn("shot", F.coalesce("shot", F.lit(0)))
    spans = rows.where("_real").groupBy(key, "shot").agg(F.min("t").alias("_s0"), F.max("t").alias("_s1"))
    spans = spans.withColumn("_next", F.lead("_s0").over(over([key], "shot"))).withColumn("_n", F.count("*").over(W.partitionBy(key))).where("_n >= 2")
    kids = spans.join(fit, key)
    upper = F.when(F.col("_next").isNotNull(), (F.col("_s1") + F.col("_next")) / 2)
    kids = kids.withColumn("_b1", F.coalesce(upper, F.col("q_end"))).withColumn("_b0", F.coalesce(F.lag(upper).over(over([key], "shot")), F.col("q_start")))
    kids = kids.withColumns({"_p0": F.col("start") + F.col("_b0") - F.col("q_start"), "_p1": F.col("start") + F.col("_b1") - F.col("q_start"), "_mid": (F.col("start") + F.col("end")) / 2})
    kids = reliable(kids)

    lib = library.where(F.col("t").isNotNull() & F.col("feature").isNotNull()).select(F.col("t").cast("double").alias("_lt"), F.col("feature").alias("_lf"))
    asks = rows.join(kids.select(key, "shot", "_mid", "_s0", "_s1", "_p0", "_p1", "q_start", F.col("start").alias("_cs")), [key, "shot"])
    asks = reliable(asks.withColumns({"_lo": F.col("_mid") - radius, "_hi": F.col("_mid") + radius}))
    sim = F.round(cosine("feature", "_lf"), DIGITS)
    best = range_join(lib, asks, [], "_lt", "_lo", "_hi", width).groupBy(key, "shot", "t").agg(F.max_by("_lt", F.struct(sim, -F.col("_lt"))).alias("_at"))
    best = best.withColumn("_off", F.col("_at") - F.col("t"))
    middle = best.groupBy(key, "shot").agg(F.percentile("_off", F.lit(0.5)).alias("_med"), F.collect_list("_off").alias("_offs"))  # one span's frames
    share = F.size(F.filter("_offs", lambda o: F.abs(o - F.col("_med")) <= near)) / F.size("_offs")
    middle = reliable(middle.where((F.size("_offs") >= 2) & (share >= agree)).select(key, "shot", "_med"))

    moves = asks.join(middle, [key, "shot"]).withColumn("_d", F.col("_med") - (F.col("_cs") - F.col("q_start"))).where(F.abs(F.col("_d")) >= least_move)
    along = (F.col("_p1") - F.col("_p0")) * (F.col("t") - F.col("_s0")) / F.greatest(F.lit(1e-9), F.col("_s1") - F.col("_s0"))
    tried = moves.withColumn("_way", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_pos", F.col("_p0") + along + F.col("_way") * F.col("_d"))
    # the window around the parent bounds what counts here, too
    tried = tried.withColumns({"_lo": F.greatest(F.col("_lo"), F.col("_pos") - tolerance), "_hi": F.least(F.col("_hi"), F.col("_pos") + tolerance)})
    met = range_join(lib, tried, [], "_lt", "_lo", "_hi", width).groupBy(key, "shot", "t", "_way").agg(F.max(sim).alias("_v"))
    scores = tried.select(key, "shot", "t", "_way", "_d").join(met, [key, "shot", "t", "_way"], "left")
    v = F.coalesce("_v", F.lit(0.0))
    scores = scores.groupBy(key, "shot").agg(F.avg(F.when(F.col("_way") == 1, v)).alias("_ref"), F.avg(F.when(F.col("_way") == 0, v)).alias("_proj"), F.min("_d").alias("_d"))
    taken = scores.where(F.round(F.col("_ref") - F.col("_proj"), DIGITS) > margin).select(key, "shot", "_d")

    seen = best.select(key).distinct().withColumn("_seen", F.lit(True))  # a parent without library rows around stays whole
    kids = kids.join(seen, key).join(taken, [key, "shot"], "left")
    move = F.coalesce("_d", F.lit(0.0))
    p0, p1 = F.col("_p0") + move, F.col("_p1") + move
    out = kids.select(key, F.col("shot").alias("child"), F.round("_b0", 3).alias("q_start"), F.round("_b1", 3).alias("q_end"), F.round(p0, 3).alias("start"), F.round(F.greatest(p1, p0 + 0.05), 3).alias("end"), F.col("_d").isNotNull().alias("refined"), F.col("start").alias("parent_start"), F.col("end").alias("parent_end"))
    out = reliable(out)
    rest = whole.join(out.select(key).distinct(), key, "left_anti")
    return out.unionByName(rest.select(key, F.lit(0).alias("child"), "q_start", "q_end", "start", "end", F.lit(False).alias("refined"), F.col("start").alias("parent_start"), F.col("end").alias("parent_end")))
