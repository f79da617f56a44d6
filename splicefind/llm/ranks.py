"""Row numbers over a sorted table of any size, without one window over all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import parts_for, stored

ROWS = 1 << 20  # rows of a sorted range at most, but for rows that no order tells apart


def numbered(rows: DataFrame, group: list[str], order: list[Column | str]) -> DataFrame:
    """``rows`` with ``pos`` (long, from 0 by ``order`` within each group) and ``n`` (rows of the group).

    ``rows`` is a stored table (its ranges are sampled first) whose group columns are never null.  It is
    dealt by ranges of (group, order), so that a hot group fills many ranges; each range numbers its own
    rows, and the rows before it come from a table of one row per range and group.  Rows that
    ``order`` does not tell apart are numbered in any order.
    """
    spark = rows.sparkSession
    count = rows.count()
    parts = max(parts_for(count, ROWS), min(spark.sparkContext.defaultParallelism, parts_for(count, 1000)))
    keys = [*(F.col(g) for g in group), *order]
    ranged = stored(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), free=False)
    ranged = ranged.withColumn("_range", F.shiftright("_at", 33))
    ends = ranged.groupBy(*group, "_range").agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_rows"))
    own = W.partitionBy(*group)
    ends = ends.select(
        *group, "_range", F.sum("_rows").over(own).alias("n"),
        (F.coalesce(F.sum("_rows").over(own.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) - F.col("_from")).alias("_shift"),
    )
    return ranged.join(ends, [*group, "_range"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")
