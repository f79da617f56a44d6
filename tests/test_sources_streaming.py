from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from splicefind.operators import folds
from splicefind.session import ship_code
from splicefind.sources import documents, index_store
from splicefind.streaming import progress


def test_index_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/film.idx"
    f = spark.createDataFrame([("a", 0.0, [1.0, 0.0]), ("a", 1.0, [0.0, 1.0])], "source_id string, t double, feature array<double>")
    s = spark.createDataFrame([("a", 0, 0.0, 2.0)], "source_id string, scene_no int, start double, end double")
    assert index_store.load_index(spark, path)["meta"] is None
    for _ in range(2):
        out = index_store.write_index(f, s, s, path, model="m", dim=2, fps=1.0, duration=2.0, size=10)
    assert out.endswith("v000002") and index_store.latest(spark, path) == out
    got = index_store.load_index(spark, path)
    assert got["features"].count() == 2 and got["scenes"].count() == 1
    index_store.refresh_derived(spark, path, lambda x: (s.union(s), s))
    assert index_store.load_index(spark, path)["scenes"].count() == 2
    state = lambda **e: got["meta"].select(index_store.validity(e).alias("s")).first()["s"]
    assert state(size=10, duration=2.3, model="m", dim=2, fps=1.0) == "VALID"
    assert state(size=11, model="other") == "INVALID:size" and state(duration=3.0) == "INVALID:duration" and state(derived="scn5") == "INVALID:derived"


def test_result_documents_round_trip(spark, tmp_path):
    doc = {"schema_version": 1, "original_video": "o", "edited_video": "e", "later": 5, "results": [{"id": "b", "edited": {"start": 1, "end": 2}, "score": 0.5}, {"id": "a", "edited": {"start": 0, "end": 1}, "reasons": ["x"]}]}
    (tmp_path / "in.json").write_text(json.dumps(doc))
    rows = documents.read_batches(spark, f"file://{tmp_path}/in.json")
    assert rows.count() == 2 and rows.where("id = 'b'").first()["reasons"] is None
    documents.write_batches(rows, f"file://{tmp_path}/out")
    back = documents.read_batches(spark, f"file://{tmp_path}/out")
    assert sorted(back.select("id", "score").collect()) == sorted(rows.select("id", "score").collect())


@dataclass
class Inner:
    gap: float = 15.0
    on: bool = True


@dataclass
class Settings:
    top: int = 28
    inner: Inner = field(default_factory=Inner)


def test_config_is_cast_and_unknown_keys_go(spark):
    got = documents.merged_config(Settings(), {"top": "7", "inner": {"gap": 3, "no": 1}, "other": 2})
    assert got == Settings(7, Inner(3.0, True))
    assert documents.as_rows(spark, got).where("name = 'inner.gap'").first()["value"] == "3.0"


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def test_debounced_stream_equals_the_fold(spark, tmp_path):
    ship_code(spark)
    rows = [("x" if i % 3 else "y", i * 0.2, "a" if i < 12 else "b", float(i)) for i in range(30)]
    for k in range(3):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], progress.FRAME).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(progress.FRAME).parquet(f"file://{tmp_path}/in")
    drain(progress.debounced(stream), "debounced")
    got = sorted((r["task_id"], r["ts"]) for r in spark.table("debounced").collect())
    want = []
    for key in "xy":
        frames = [{"ts": t, "stage": s, "percent": p} for k, t, s, p in rows if k == key]
        want += [(key, r["ts"]) for r in folds.debounce(frames, flush=False)]
    assert got == sorted(want)


def test_change_scores_stream(spark, tmp_path):
    schema = "source_id string, t double, hist array<double>, gray array<double>"
    spark.createDataFrame([("a", 0.0, [1.0, 0.0], [0.0, 0.0]), ("a", 1.0, [0.0, 1.0], [255.0, 255.0]), ("a", 2.0, [0.0, 1.0], [255.0, 255.0])], schema).coalesce(1).write.parquet(f"file://{tmp_path}/px")
    drain(progress.change_scores(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/px")), "changes")
    assert [(r["t"], r["score"]) for r in spark.table("changes").orderBy("t").collect()] == [(1.0, 1.5), (2.0, 0.0)]


def test_sessions_stream(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    e.coalesce(1).write.parquet(f"file://{tmp_path}/ev")
    drain(progress.session_counts(spark.readStream.schema(e.schema).parquet(f"file://{tmp_path}/ev"), late="1 day"), "sessions_out")
    assert 0 < spark.table("sessions_out").agg(F.sum("n")).first()[0] <= e.count()
