"""Evaluation metrics: recall tables, precision/recall/F1, AUC, Kendall tau, batch differences."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from splicefind.functions.vectors import col
from splicefind.operators.asof import overlap_join
from splicefind.operators.components import reliable
from splicefind.operators.folds import fold
from splicefind.operators.intervals import overlap, overlap_share


def prf(tp, fp, fn) -> tuple[Column, Column, Column]:
    """Precision, recall, F1; 0 where a denominator is."""
    tp, fp, fn = col(tp), col(fp), col(fn)
    p, r = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0), F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row (auc, n_pos, n_neg): P(pos > neg) + P(equal)/2 by rank sums.

    Ties are summed per distinct score first; the running counts go by ranges of about equally many
    distinct scores, so no task holds more than those of a range.
    """
    per = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(score).agg(F.sum((F.col(label) > 0).cast("long")).alias("p"), F.sum((F.col(label) <= 0).cast("long")).alias("q"))
    # ranges of about equally many scores split the running sum in two levels, whatever the scale of the scores
    per = reliable(per.repartitionByRange(score).withColumn("_b", F.spark_partition_id()))
    tops = per.groupBy("_b").agg(F.sum("q").alias("_q")).withColumn("_before", F.coalesce(F.sum("_q").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inner = F.coalesce(F.sum("q").over(W.partitionBy("_b").orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = per.withColumn("_in", inner).join(tops.select("_b", "_before"), "_b")
    total = rows.agg(F.sum(F.col("p") * (F.col("_before") + F.col("_in") + F.col("q") / 2)).alias("u"), F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"))
    return total.select((F.col("u") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"), "n_pos", "n_neg")


def kendall_tau(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Per series of two rows and more: pairs in order, inverted, all, and tau.

    Blocks of doubling length are counted against the sorted block before them, as in a merge sort, so no pair is made.
    """

    def count(rows: list[dict]) -> list[dict]:
        # ranks: two values are compared as integers; rows of one place are no pair
        _, v = np.unique(np.array([r[value] for r in rows], dtype=object), return_inverse=True)
        place = np.cumsum([0, *(a[order] != b[order] for a, b in zip(rows, rows[1:]))])
        up, down = (sum(int(n) for n in _before(v, place, right)) for right in (False, True))
        size = np.bincount(place)
        pairs = (len(rows) ** 2 - int((size.astype(object) ** 2).sum())) // 2
        return [{**rows[0], "concordant": up, "discordant": down, "pairs": pairs, "tau": (up - down) / pairs}] if pairs else []

    rows = df.where(F.col(order).isNotNull() & F.col(value).isNotNull())
    return fold(rows, keys, [order], count, "concordant long, discordant long, pairs long, tau double", keys)


def _before(v: np.ndarray, place: np.ndarray, above: bool):
    """Counts of pairs of an earlier and a later place whose earlier value is smaller (``above``: larger), block by block."""
    n, width = int(place[-1]) + 1, 1
    while width < n:
        block = place // width
        # a left block's rows sorted by value; right rows look themselves up in the left block next to them
        order = np.lexsort((v, block))
        code = block[order] * (int(v.max()) + 2) + v[order]
        right = block % 2 == 1
        base = (block[right] - 1) * (int(v.max()) + 2)
        lo, hi = np.searchsorted(code, base, "left"), np.searchsorted(code, base + int(v.max()) + 1, "left")
        if above:
            yield (hi - np.searchsorted(code, base + v[right], "right")).sum()
        else:
            yield (np.searchsorted(code, base + v[right], "left") - lo).sum()
        width *= 2


def recall(truth: DataFrame, results: DataFrame, key: str, width: float, slack: float = 2.0, share: float = 0.4, union: float = 0.5, scene: float = 15.0) -> DataFrame:
    """Per truth row (truth_id, key, q_start, q_end, start, end): strict, joint and scene hits.

    ``results`` has key, q_start, q_end, start, end.  A span counts for a truth row whose query
    span it overlaps.  Strict: inside the truth +-slack, or holding its midpoint, or covering
    ``share`` of it.  Joint: summed overlaps reach ``union`` on both sides (sums count twice).
    """
    r = results.where("end - start > 0.01").select(key, F.col("q_start").alias("_qs"), F.col("q_end").alias("_qe"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    met = overlap_join(truth, r, [key], "q_start", "q_end", "_qs", "_qe", width)
    mid, size = (F.col("start") + F.col("end")) / 2, F.greatest(F.col("end") - F.col("start"), F.lit(1e-6))
    inside = (F.col("_s") >= F.col("start") - slack) & (F.col("_e") <= F.col("end") + slack)
    hit = inside | ((F.col("_s") <= mid) & (F.col("_e") >= mid)) | (overlap("start", "end", "_s", "_e") / size >= share)
    near = ((F.col("_s") + F.col("_e")) / 2).between(F.col("start") - scene, F.col("end") + scene)
    qsize = F.greatest(F.col("q_end") - F.col("q_start"), F.lit(1e-6))
    per = met.groupBy("truth_id").agg(
        F.max(hit).alias("strict"), F.max(near).alias("scene"), F.sum(overlap("start", "end", "_s", "_e") / size).alias("_o"), F.sum(overlap("q_start", "q_end", "_qs", "_qe") / qsize).alias("_q"), F.count("*").alias("spans")
    )
    out = truth.join(per, "truth_id", "left")
    joint = F.coalesce((F.col("_o") >= union) & (F.col("_q") >= union), F.lit(False))
    return out.select("truth_id", F.coalesce("strict", F.lit(False)).alias("strict"), (F.coalesce("strict", F.lit(False)) | joint).alias("hit"), F.coalesce("scene", F.lit(False)).alias("scene"), F.coalesce("spans", F.lit(0)).alias("spans"))


def false_hits(negatives: DataFrame, results: DataFrame, key: str, width: float, share: float = 0.5) -> DataFrame:
    """Per negative row (negative_id, key, q_start, q_end): spans, and false_hit where one is found.

    ``results`` has key, q_start, q_end, start, end, one row a span, and rejected where a row may say that the query is not in the library. A span wider
    than 0.01 counts when its query side covers ``share`` of the negative's; rejected rows never do.
    """
    r = results if "rejected" in results.columns else results.withColumn("rejected", F.lit(False))
    r = r.where("end - start > 0.01 and not coalesce(rejected, false)").select(key, F.col("q_start").alias("_qs"), F.col("q_end").alias("_qe"))
    met = overlap_join(negatives.select("negative_id", key, "q_start", "q_end"), r, [key], "q_start", "q_end", "_qs", "_qe", width)
    per = met.where(overlap_share("q_start", "q_end", "_qs", "_qe") >= share).groupBy("negative_id").agg(F.count("*").alias("spans"))
    out = negatives.select("negative_id").join(per, "negative_id", "left").withColumn("spans", F.coalesce("spans", F.lit(0).cast("long")))
    return out.withColumn("false_hit", F.col("spans") > 0)


def supported(results: DataFrame, truth: DataFrame, key: str, row: str, width: float, share: float = 0.3, near: float = 15.0) -> DataFrame:
    """Per span of ``results`` (row: its id, key, start, end, perhaps rejected) whether a true place backs it: (row, supported).

    Backed: a true span (key, start, end) covers ``share`` of it, or holds its middle with ``near`` seconds to spare. Empty and rejected spans give no row.
    """
    r = results if "rejected" in results.columns else results.withColumn("rejected", F.lit(False))
    r = r.where("end - start > 0.01 and not coalesce(rejected, false)").select(row, key, "start", "end")
    t = truth.where("start <= end").select(key, F.col("start").alias("_s"), F.col("end").alias("_e")).withColumns({"_lo": F.col("_s") - near, "_hi": F.col("_e") + near})
    met = overlap_join(r, t, [key], "start", "end", "_lo", "_hi", width)
    ok = (overlap_share("start", "end", "_s", "_e") >= share) | ((F.col("start") + F.col("end")) / 2).between(F.col("_lo"), F.col("_hi"))
    backed = met.where(ok).select(row).distinct().withColumn("supported", F.lit(True))
    return r.select(row).join(backed, row, "left").withColumn("supported", F.coalesce("supported", F.lit(False)))


def level_counts(df: DataFrame, level: str = "level") -> DataFrame:
    """One row of counts by level and of unresolved rows (null level)."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return df.agg(*[n(F.col(level) == x).alias(x.lower()) for x in ("HIGH", "MEDIUM", "LOW")], n(F.col(level).isNull()).alias("unresolved"), F.count("*").alias("total"))


def batch_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows added, removed or changed between two batches."""
    a = old.select(key, F.lit(True).alias("_a"), *[F.col(c).alias(f"old_{c}") for c in columns])
    b = new.select(key, F.lit(True).alias("_b"), *[F.col(c).alias(f"new_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~same, "changed")
    return a.join(b, key, "full").withColumn("change", kind).where("change is not null").drop("_a", "_b")
