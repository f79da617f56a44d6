"""Export plans: flattening of results, confidence filter, EDL text, reel plan, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from splicefind.functions.scalars import timecode
from splicefind.functions.text import clip_stem, edl_reel, edl_title
from splicefind.operators.grading import rank_of


def export_plan(results: DataFrame, least: str = "MEDIUM", low_policy: str = "exclude", most_sub: int = 4, twin: float = 0.5) -> DataFrame:
    """Main clips of sufficient level (LOW ones on track ``low`` under policy ``backup``) and their sub spans.

    ``results`` has seg_index, q_start, q_end, start, end, level and subs (array of start, end).  Sub
    spans take record slots no longer than the main's; those equal to it within ``twin`` go.
    """
    rank = {"HIGH": 2, "MEDIUM": 1, "LOW": 0}[least]
    rows = results.where("end > start").withColumn("kind", F.when(rank_of("level") >= rank, "main").when(F.lit(low_policy == "backup"), "low")).where("kind is not null")
    main = rows.select("seg_index", F.lit(-1).alias("sub_index"), "kind", "q_start", "q_end", "start", "end", "level")
    sub = rows.where("kind = 'main'").select("seg_index", F.posexplode(F.slice("subs", 1, most_sub)).alias("sub_index", "s"), "q_start", "q_end", "start", "end", "level")
    twins = (F.abs(F.col("s.start") - F.col("start")) <= twin) & (F.abs(F.col("s.end") - F.col("end")) <= twin)
    sub = sub.where(~twins).select("seg_index", "sub_index", F.lit("sub").alias("kind"), "q_start", F.least(F.col("q_end"), F.col("q_start") + (F.col("s.end") - F.col("s.start"))).alias("q_end"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), "level")
    return main.unionByName(sub)


def edl_lines(plan: DataFrame, keys: list[str], source: str, fps: float, record_fps: float | None = None) -> DataFrame:
    """One text per clip of each timeline (keys), numbered by record time."""
    mains = plan.where(F.col("kind").isin("main", "low"))
    n = F.row_number().over(W.partitionBy(*keys).orderBy("q_start", "q_end", "seg_index"))
    rate = F.lit(fps)
    rec = F.lit(record_fps or fps)
    head = F.concat(F.format_string("%03d  ", n), edl_reel(F.lit(source)), F.lit(" V     C        "), F.concat_ws(" ", timecode("start", rate), timecode("end", rate), timecode("q_start", rec), timecode("q_end", rec)))
    note = F.concat(F.lit("* FROM CLIP NAME: "), F.lit(source))
    return mains.withColumn("event_no", n).withColumn("line", F.concat_ws("\n", head, note))


def edl_text(plan: DataFrame, keys: list[str], title: str, source: str, fps: float) -> DataFrame:
    """The whole list of each timeline as one text."""
    lines = edl_lines(plan, keys, source, fps)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_no", "line"))), lambda x: x["line"]), "\n\n")
    return lines.groupBy(*keys).agg(F.concat(F.lit("TITLE: "), edl_title(F.lit(title)), F.lit("\nFCM: NON-DROP FRAME\n\n"), body, F.lit("\n")).alias("text"))


def reel_plan(plan: DataFrame, keys: list[str], floor: float = 0.1) -> DataFrame:
    """Clips in record order without immediate repeats, with unique stems and cumulative placement."""
    w = W.partitionBy(*keys).orderBy("q_start", "q_end", "seg_index")
    rows = plan.where("kind <> 'sub'").withColumn("_same", F.coalesce((F.lag("start").over(w) == F.col("start")) & (F.lag("end").over(w) == F.col("end")), F.lit(False))).where("not _same")
    rows = rows.withColumn("_stem", clip_stem("start", "end")).withColumn("width", F.greatest(F.lit(floor), F.col("end") - F.col("start")))
    k = F.row_number().over(W.partitionBy(*keys, "_stem").orderBy("q_start", "q_end", "seg_index"))
    rows = rows.withColumn("stem", F.when(k > 1, F.concat("_stem", F.lit("#"), k.cast("string"))).otherwise(F.col("_stem")))
    placed = F.coalesce(F.sum("width").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return rows.withColumn("placed", placed).drop("_same", "_stem")


def result_documents(df: DataFrame) -> DataFrame:
    """Each row as a JSON document, keys in column order, nulls left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("document"))


def apply_corrections(results: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """Manual spans replace automatic ones, which stay as auto_start and auto_end; excluded rows are marked.

    Corrections of empty or reversed spans are ignored.
    """
    c = corrections.where("excluded or new_end > new_start").select(key, "new_start", "new_end", F.col("excluded").alias("_x"))
    out = results.join(c, key, "left").withColumn("auto_start", F.col("start")).withColumn("auto_end", F.col("end"))
    out = out.withColumn("source", F.when(F.col("new_start").isNotNull(), "manual").otherwise("auto"))
    return out.withColumn("start", F.coalesce("new_start", "start")).withColumn("end", F.coalesce("new_end", "end")).withColumn("excluded", F.coalesce("_x", F.lit(False))).drop("new_start", "new_end", "_x")
