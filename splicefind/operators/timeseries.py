"""Ordered-series operators: lags, padded statistics, peaks, runs, sessions, block statistics.

All are window expressions over (keys, order); a series is one window partition.  Local operators (those that look at
a few rows around each) run on one long series in parallel through ``by_ranges``, which deals it by ranges of its order
and lends each range the rows around it.  Nothing sorts without a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from splicefind.functions.vectors import cosine, l1


def over(keys: list[str], order) -> W:
    return W.partitionBy(*keys).orderBy(*(order if isinstance(order, list) else [order]))


def by_ranges(df: DataFrame, keys: list[str], order: str, width: float, rows: int, fn) -> DataFrame:
    """``fn(df, keys)`` of an operator that looks at up to ``rows`` rows on either side, on ranges of ``width``.

    Each range gets copies of the ``rows`` rows before and after it, from as many ranges as these lie in; what ``fn`` makes of
    the copies is dropped.  ``fn`` must carry the columns of its input; the order has no ties.
    """
    part = [*keys, "_range"]
    dealt = df.withColumn("_range", F.floor(F.col(order) / width))
    row = F.struct(F.col(order).alias("o"), F.struct(*df.columns).alias("row"))

    def edge(by) -> DataFrame:
        near = dealt.withColumn("_n", F.row_number().over(W.partitionBy(*part).orderBy(by))).where(F.col("_n") <= rows)
        return near.groupBy(*part).agg(F.array_sort(F.collect_list(row)).alias("e"))  # at most ``rows`` rows

    ends = edge(F.col(order)).withColumnRenamed("e", "first").join(edge(F.desc(order)).withColumnRenamed("e", "last"), part)
    line = W.partitionBy(*keys).orderBy("_range")
    before, after = F.flatten(F.collect_list("last").over(line.rowsBetween(-rows, -1))), F.flatten(F.collect_list("first").over(line.rowsBetween(1, rows)))
    ends = ends.select(*part, before.alias("b"), after.alias("a"))
    lent = F.concat(F.slice("b", F.greatest(F.size("b") - rows + 1, F.lit(1)), rows), F.slice("a", 1, rows))
    lent = ends.select("_range", F.explode(lent).alias("x")).select("x.row.*", "_range", F.lit(False).alias("_own"))
    whole = dealt.withColumn("_own", F.lit(True)).unionByName(lent)
    return fn(whole, part).where("_own").drop("_own", "_range")


def adjacent_distance(df: DataFrame, keys: list[str], order="t", feature: str = "feature", out: str = "distance") -> DataFrame:
    """1 - cos of each row and the next of its series; the last row of a series goes."""
    w = over(keys, order)
    rows = df.withColumn("_next", F.lead(feature).over(w))
    return rows.where(F.col("_next").isNotNull()).withColumn(out, 1 - cosine(feature, "_next")).drop("_next")


def padded(x: str, keys: list[str], order, radius: int, square: bool = False) -> Column:
    """Mean of x (or of its square) over +-radius rows where the edge rows are repeated outwards."""
    w = over(keys, order)
    whole = W.partitionBy(*keys).orderBy(*(order if isinstance(order, list) else [order])).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    v = F.col(x) * F.col(x) if square else F.col(x)
    place, n = F.row_number().over(w) - 1, F.count("*").over(whole)
    left = F.greatest(F.lit(radius) - place, F.lit(0)) * F.first(v).over(whole)
    right = F.greatest(F.lit(radius) - (n - 1 - place), F.lit(0)) * F.last(v).over(whole)
    return (F.sum(v).over(w.rowsBetween(-radius, radius)) + left + right) / (2 * radius + 1)


def local_zscore(df: DataFrame, keys: list[str], order, x: str, smooth: int = 1, floor: float = 1e-4) -> DataFrame:
    """Add smoothed, mu, sigma, z: moving average, then local statistics of width max(2*smooth+1, 7)."""
    smooth |= 1
    wide = max(2 * smooth + 1, 7)
    out = df.withColumn("smoothed", padded(x, keys, order, smooth // 2))
    out = out.withColumn("mu", padded("smoothed", keys, order, wide // 2)).withColumn("_sq", padded("smoothed", keys, order, wide // 2, True))
    out = out.withColumn("sigma", F.sqrt(F.greatest(F.col("_sq") - F.col("mu") * F.col("mu"), F.lit(0.0)))).drop("_sq")
    return out.withColumn("z", (F.col("smoothed") - F.col("mu")) / F.greatest(F.col("sigma"), F.lit(floor)))


def is_peak(x: str, keys: list[str], order) -> Column:
    """Interior rows not below either neighbour (plateaus count)."""
    w = over(keys, order)
    before, after = F.lag(x).over(w), F.lead(x).over(w)
    return F.coalesce((F.col(x) >= before) & (F.col(x) >= after), F.lit(False))


def adaptive_peaks(df: DataFrame, keys: list[str], order, x: str, least: float, times: float = 3.0, radius: int = 8) -> DataFrame:
    """Peaks of at least ``least`` and ``times`` the median of +-radius rows (clamped, self included)."""
    w = over(keys, order).rowsBetween(-radius, radius)
    rows = df.withColumn("median", F.percentile(F.col(x), F.lit(0.5)).over(w)).withColumn("_peak", is_peak(x, keys, order))
    return rows.where(F.col("_peak") & (F.col(x) >= least) & (F.col(x) >= times * F.col("median"))).drop("_peak")


def parabola_offset(x: str, keys: list[str], order) -> Column:
    """Vertex of the parabola through a row and its neighbours, in steps from the row, within +-1."""
    w = over(keys, order)
    a, b, c = F.lag(x).over(w), F.col(x), F.lead(x).over(w)
    bend = a - 2 * b + c
    return F.when(F.abs(bend) > 1e-12, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 0.5 * (a - c) / bend))).otherwise(F.lit(0.0))


def smoothed3(x: str, keys: list[str], order) -> Column:
    """Mean of the existing neighbours and the row; series of fewer than 3 rows take their mean."""
    whole = W.partitionBy(*keys)
    return F.when(F.count("*").over(whole) < 3, F.avg(x).over(whole)).otherwise(F.avg(x).over(over(keys, order).rowsBetween(-1, 1)))


def runs(df: DataFrame, keys: list[str], order, flag: str) -> DataFrame:
    """Rows where ``flag`` holds, numbered by maximal run as column run (1, 2, ...)."""
    w = over(keys, order)
    start = (F.col(flag) & ~F.coalesce(F.lag(flag).over(w), F.lit(False))).cast("int")
    return df.withColumn("run", F.sum(start).over(w.rowsBetween(W.unboundedPreceding, 0))).where(flag)


def longest_run_share(df: DataFrame, keys: list[str], order, flag: str) -> DataFrame:
    """Per series: rows, flagged share and the longest run's share."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col(flag).cast("int")).alias("share"))
    best = runs(df, keys, order, flag).groupBy(*keys, "run").agg(F.count("*").alias("len")).groupBy(*keys).agg(F.max("len").alias("len"))
    return n.join(best, keys, "left").select(*keys, "n", "share", (F.coalesce("len", F.lit(0)) / F.col("n")).alias("run_share"))


def epoch_seconds(at: Column | str) -> Column:
    """Seconds since 1970 of a timestamp with or without zone, as double, whatever the session's zone."""
    at = F.col(at) if isinstance(at, str) else at
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at.cast("timestamp_ntz")) / F.lit(1e6)


def gap_clusters(df: DataFrame, keys: list[str], order: str, gap: float, ties: list[str] | None = None, out: str = "cluster_no") -> DataFrame:
    """Number the clusters of each series: a new one starts where the step is larger than ``gap``."""
    w = over(keys, [order, *(ties or [])])
    start = F.when(F.col(order) - F.lag(order).over(w) > gap, 1).otherwise(0)
    return df.withColumn(out, F.sum(start).over(w.rowsBetween(W.unboundedPreceding, 0)))


def sessions(df: DataFrame, key: str, at: str, gap_seconds: float, ties: list[str] | None = None) -> DataFrame:
    """(key, session_no, start, end, n): gap clusters of timestamps, in epoch seconds."""
    rows = df.withColumn("_s", epoch_seconds(at))
    return gap_clusters(rows, [key], "_s", gap_seconds, ties, "session_no").groupBy(key, "session_no").agg(F.min("_s").alias("start"), F.max("_s").alias("end"), F.count("*").alias("n"))


def block_means(vector: str, keys: list[str], order, lo: int, hi: int) -> Column:
    """Position-wise mean vector over rows lo..hi of the frame; null where the frame has none."""
    rows = F.collect_list(vector).over(over(keys, order).rowsBetween(lo, hi))
    n = F.size(rows)
    total = F.aggregate(rows, F.array_repeat(F.lit(0.0), 0), lambda acc, v: F.when(F.size(acc) == 0, v.cast("array<double>")).otherwise(F.zip_with(acc, v.cast("array<double>"), lambda x, y: x + y)))
    return F.when(n > 0, F.transform(F.arrays_zip(total.alias("s"), F.array_repeat(n, F.size(total)).alias("n")), lambda p: p["s"] / p["n"]))


def block_gate(df: DataFrame, keys: list[str], order, vector: str, before: int = 4, after: int = 4, skip: int = 2, cos: bool = False) -> DataFrame:
    """Add before/after block distance and the deviation inside the after block.

    L1 of mean histograms, or cosine distance (``cos``); without rows on a side (0, 9.9).
    """
    far = (lambda a, b: 1 - cosine(a, b)) if cos else l1
    w = over(keys, order)
    out = df.withColumn("_before", block_means(vector, keys, order, -before, -1)).withColumn("_after", block_means(vector, keys, order, skip, skip + after - 1))
    out = out.withColumn("_rows", F.collect_list(vector).over(w.rowsBetween(skip, skip + after - 1)))
    ok = F.col("_before").isNotNull() & F.col("_after").isNotNull()
    out = out.withColumn("block_distance", F.when(ok, far("_before", "_after")).otherwise(0.0))
    worst = F.array_max(F.transform("_rows", lambda v: far(v, F.col("_after"))))
    return out.withColumn("block_deviation", F.when(ok, worst).otherwise(9.9)).drop("_before", "_after", "_rows")


def similarity_runs(df: DataFrame, keys: list[str], gap: float = 8.0, t: str = "t", sim: str = "sim") -> DataFrame:
    """Number of each row's group in similarity order: a row joins while t - last t <= gap, negative steps included."""
    w = W.partitionBy(*keys).orderBy(F.desc(sim), t)
    new = F.coalesce((F.col(t) - F.lag(t).over(w) > gap).cast("int"), F.lit(0))
    rows = df.withColumn("_new", new)
    return rows.withColumn("run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("_new")


def every(df: DataFrame, keys: list[str], order, step: int) -> DataFrame:
    """Every ``step``-th row of each series, the first included."""
    return df.withColumn("_i", F.row_number().over(over(keys, order)) - 1).where(F.col("_i") % step == 0).drop("_i")


def evenly(df: DataFrame, keys: list[str], order, n: int) -> DataFrame:
    """``n`` evenly spaced rows of each series (places truncated), all rows of shorter ones."""
    rows = df.withColumn("_i", F.row_number().over(over(keys, order)) - 1)
    size = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    step = (F.col("_n") - 1) / max(n - 1, 1)
    k = F.ceil(F.col("_i") / step - 1e-9)  # the only k whose place can be this row
    hit = F.when(F.col("_n") <= n, True).when(F.lit(n == 1), F.col("_i") == 0).otherwise((k < n) & (F.floor(k * step + 1e-9) == F.col("_i")))
    return rows.join(size, keys).where(hit).drop("_i", "_n")
