"""Derived tables that the registered queries share, as DataFrames and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splicefind.functions.vectors import centroids
from splicefind.operators.localize import evidence_clusters
from splicefind.operators.retrieval import top_k

#: Similarities of the test vectors are small; the operators keep their own defaults.
LEAST = 0.25


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def library(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.where("(vec_id div 20) % 5 <> 0").select(F.col("vec_id").cast("double").alias("t"), F.col("embedding").alias("feature"))


def shots(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.where("(vec_id div 20) % 5 = 0").select(F.expr("vec_id div 20").alias("shot_no"), F.col("vec_id").cast("double").alias("t"), F.col("embedding").alias("feature"))


def hits(spark: SparkSession, d: str, k: int) -> DataFrame:
    return top_k(shots(spark, d), library(spark, d), k)


def spans(spark: SparkSession, d: str) -> DataFrame:
    return evidence_clusters(hits(spark, d, 1), 15.0, 2, LEAST)


def scenes(spark: SparkSession, d: str) -> DataFrame:
    rows = library(spark, d).withColumn("scene_no", F.floor(F.col("t") / 20).cast("long"))
    span = rows.groupBy("scene_no").agg(F.min("t").alias("start"), (F.max("t") + 1).alias("end"))
    return span.join(centroids(rows, ["scene_no"], out="feature"), "scene_no")


def series(spark: SparkSession, d: str) -> DataFrame:
    """events.value per user, numbered by (ts, event_id)."""
    from pyspark.sql import Window as W

    e = table(spark, d, "events")
    return e.select("user_id", (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("seq"), F.col("value").alias("x"))


LIB = "lib AS (SELECT CAST(vec_id AS DOUBLE) AS t, CAST(embedding AS DOUBLE[]) AS f FROM embeddings WHERE (vec_id // 20) % 5 <> 0)"
QRY = "qry AS (SELECT vec_id // 20 AS shot_no, CAST(vec_id AS DOUBLE) AS t, CAST(embedding AS DOUBLE[]) AS f FROM embeddings WHERE (vec_id // 20) % 5 = 0)"


def hits_sql(k: int) -> str:
    sim = "round(list_cosine_similarity(q.f, l.f), 9)"
    return f"{LIB}, {QRY}, hits AS (SELECT * FROM (SELECT q.shot_no, q.t AS q_t, l.t AS l_t, {sim} AS sim, row_number() OVER (PARTITION BY q.t ORDER BY {sim} DESC, l.t) AS rank FROM qry q, lib l) WHERE rank <= {k})"


CLUSTERS = """clus AS (SELECT *, sum(s) OVER (PARTITION BY shot_no ORDER BY l_t, q_t ROWS UNBOUNDED PRECEDING) AS cluster_no FROM (SELECT *, CASE WHEN l_t - lag(l_t) OVER (PARTITION BY shot_no ORDER BY l_t, q_t) > 15 THEN 1 ELSE 0 END AS s FROM hits))"""
SPANS = f"{{hits}}, {CLUSTERS}, spans AS (SELECT shot_no, cluster_no, min(l_t) AS s, max(l_t) AS e, count(*) AS n, avg(sim) AS mean_sim FROM clus GROUP BY ALL HAVING count(*) >= 2 AND avg(sim) >= {LEAST})".replace("{hits}", hits_sql(1))
SERIES = "ser AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, value AS x FROM events)"
_UNIT = "list_transform(m, lambda z: z / greatest(sqrt(list_dot_product(m, m)), 1e-8))"
SCENES = f"""{LIB}, pos AS (SELECT CAST(floor(t / 20) AS BIGINT) AS scene_no, t, unnest(f) AS x, unnest(range(1, len(f) + 1)) AS p FROM lib),
means AS (SELECT scene_no, list(x ORDER BY p) AS m FROM (SELECT scene_no, p, avg(x) AS x FROM pos GROUP BY ALL) GROUP BY scene_no),
scenes AS (SELECT s.scene_no, s.s, s.e, {_UNIT} AS f FROM (SELECT CAST(floor(t / 20) AS BIGINT) AS scene_no, min(t) AS s, max(t) + 1 AS e FROM lib GROUP BY 1) s JOIN means USING (scene_no))"""
