"""Vector expressions over array<float|double> columns, computed in double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = 1e-8


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(v: Column | str) -> Column:
    return col(v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; a zero vector counts as of length FLOOR."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(FLOOR)) * F.greatest(norm(b), F.lit(FLOOR)))


def l2(v: Column | str) -> Column:
    """The vector at unit length."""
    return F.transform(F.arrays_zip(as_double(v).alias("x"), F.array_repeat(F.greatest(norm(v), F.lit(FLOOR)), F.size(v)).alias("n")), lambda p: p["x"] / p["n"])


def l1(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def centroids(df: DataFrame, keys: list[str], vector: str = "feature", out: str = "centroid", unit: bool = True) -> DataFrame:
    """Mean vector of each group, at unit length; sums are partial before the shuffle."""
    parts = df.select(*keys, F.posexplode(as_double(vector)).alias("pos", "x"))
    means = parts.groupBy(*keys, "pos").agg(F.avg("x").alias("x"))
    whole = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("p"))
    mean = F.transform("p", lambda p: p["x"])
    out_df = whole.select(*keys, mean.alias(out))
    return out_df.withColumn(out, l2(out)) if unit else out_df
