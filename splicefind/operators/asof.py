"""As-of and range lookups as sorted unions and bucketed equi-joins.

As-of joins merge both sides into one ordered series per key and carry values along
with running maxima and minima: one shuffle on the key, no pair is made.  With ``width``
a key's time line is dealt in buckets, so a hot key splits; the edges of the buckets, one
row each, are carried over in a second, small step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def around(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, carry: list[str], width: float | None = None) -> DataFrame:
    """``left`` with structs _prev (last right row at or before) and _next (first at or after)."""
    row = F.struct(F.col(right_at).cast("double").alias("at"), *carry)
    a = left.withColumn("_left", F.struct(*left.columns)).select(*keys, F.col(at).cast("double").alias("_at"), "_left", F.lit(None).cast(right.select(row.alias("r")).schema["r"].dataType).alias("_r"))
    b = right.select(*keys, F.col(right_at).cast("double").alias("_at"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), row.alias("_r"))
    both = a.unionByName(b).withColumn("_b", F.floor(F.col("_at") / width) if width else F.lit(0).cast("long"))
    # both frames grow from one end of the series, so each row adds one value to a running aggregate
    back = W.partitionBy(*keys, "_b").orderBy("_at").rangeBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(*keys, "_b").orderBy(F.desc("_at")).rangeBetween(W.unboundedPreceding, 0)
    out = both.withColumn("_prev", F.max("_r").over(back)).withColumn("_next", F.min("_r").over(ahead)).where("_left is not null")
    if width:
        edges = both.groupBy(*keys, "_b").agg(F.max("_r").alias("_last"), F.min("_r").alias("_first"))
        before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
        after = W.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)
        edges = edges.select(*keys, "_b", F.max("_last").over(before).alias("_before"), F.min("_first").over(after).alias("_after"))
        out = out.join(edges, [*keys, "_b"], "left").withColumns({"_prev": F.coalesce("_prev", "_before"), "_next": F.coalesce("_next", "_after")})
    return out.select("_left.*", "_prev", "_next")


def asof_forward(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, carry: list[str], fallback_last: bool = True, width: float | None = None) -> DataFrame:
    """First right row with time >= left time; else (``fallback_last``) the last right row."""
    out = around(left, right, keys, at, right_at, carry, width)
    pick = F.coalesce("_next", "_prev") if fallback_last else F.col("_next")
    return out.withColumn("match", pick).drop("_prev", "_next")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, carry: list[str], tolerance: float | None = None, width: float | None = None) -> DataFrame:
    """Nearest right row, the lower on ties; null beyond ``tolerance``."""
    out = around(left, right, keys, at, right_at, carry, width)
    low, high = F.col(at) - F.col("_prev.at"), F.col("_next.at") - F.col(at)
    pick = F.when(F.col("_next").isNull() | (low <= high), F.col("_prev")).otherwise(F.col("_next"))
    if tolerance is not None:
        pick = F.when(F.least(F.coalesce(low, high), F.coalesce(high, low)) <= tolerance, pick)
    return out.withColumn("match", pick).drop("_prev", "_next")


def grid_sample(df: DataFrame, keys: list[str], at: str, step: float, origin: float = 0.0, ties: list[str] | None = None) -> DataFrame:
    """The first row of each cell [origin + k step, origin + (k+1) step), with its cell number."""
    rows = df.withColumn("cell", F.floor((F.col(at) - origin) / step))
    w = W.partitionBy(*keys, "cell").orderBy(at, *(ties or []))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def range_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, width: float, closed: bool = True, how: str = "inner") -> DataFrame:
    """Points in spans by buckets of ``width``: each span goes to the buckets it meets, points to one."""
    p = points.withColumn("_b", F.floor(F.col(at) / width))
    lo, hi = F.floor(F.col(start) / width), F.floor(F.col(end) / width)
    s = spans.where(F.col(end) >= F.col(start)).withColumn("_b", F.explode(F.sequence(lo, hi)))
    inside = (F.col(at) >= F.col(start)) & ((F.col(at) <= F.col(end)) if closed else (F.col(at) < F.col(end)))
    return p.join(s, [*keys, "_b"], how).where(inside).drop("_b")


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], sa: str, ea: str, sb: str, eb: str, width: float) -> DataFrame:
    """Pairs of spans that overlap by more than 0, each once: in the bucket where the later one starts."""
    def cells(df: DataFrame, s: str, e: str) -> DataFrame:
        return df.withColumn("_b", F.explode(F.sequence(F.floor(F.col(s) / width), F.greatest(F.floor(F.col(s) / width), F.floor(F.col(e) / width)))))

    met = cells(a, sa, ea).join(cells(b, sb, eb), [*keys, "_b"])
    overlap: Column = F.least(ea, eb) - F.greatest(sa, sb)
    return met.where((overlap > 0) & (F.floor(F.greatest(sa, sb) / width) == F.col("_b"))).drop("_b")
