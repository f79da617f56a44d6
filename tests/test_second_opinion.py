"""The second feature's index (round trip, damage, what a window reads) and the second opinion on planted copies."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from splicefind.operators import opinion
from splicefind.session import ship_code
from splicefind.sources import second_index


@pytest.fixture(scope="module")
def frames(spark):
    """Two films at 2 rows a second; one has no readable frame from 120 to 250 s, and a late start."""
    ship_code(spark)
    rows = [("a", i / 2, [float(i), 1.0]) for i in range(2 * 9000)]
    rows += [("b", 3.25 + i / 2, None if 240 <= i < 500 else [float(i), 2.0]) for i in range(1000)]
    return spark.createDataFrame(rows, "source_id string, t double, feature array<double>")


def test_grid_leaves_out_dead_clusters(frames, spark):
    got = {(r["source_id"], r["t"]): r["feature"] for r in second_index.grid_rows(frames, 1.0).collect()}
    assert {t for s, t in got if s == "a"} == {float(k) for k in range(9000)}
    mine = sorted(t for s, t in got if s == "b")
    # targets 0..3 find 3.25; 124..239 lie in a cluster without frames after them, from 240 on the next one has some from 253.25 on
    assert mine[:5] == [0, 1, 2, 3, 4] and not [t for t in mine if 123 < t < 240] and 240.0 in mine
    assert got["b", 240.0] == [500.0, 2.0] and got["b", 4.0] == [2.0, 2.0]
    cut = second_index.grid_rows(frames, 1.0, spark.createDataFrame([("a", 100.0)], "source_id string, duration double"))
    assert cut.where("source_id = 'a'").count() == 100


def test_round_trip_and_damage(frames, spark, tmp_path):
    path = f"file://{tmp_path}/second"
    assert second_index.load_second_index(spark, path, 2) is None
    rows = second_index.grid_rows(frames, 1.0)
    out = second_index.write_second_index(rows, path, 1.0, "h1")
    back = second_index.load_second_index(spark, path, 2, "h1")
    assert back.select("source_id", "t", "feature").exceptAll(rows).count() == 0 and back.count() == rows.count()
    assert second_index.load_second_index(spark, path, 3) is None and second_index.load_second_index(spark, path, 2, "h2") is None
    # a newer version without metadata, as a build that was cut short leaves it, is passed over
    rows.limit(5).write.parquet(f"{path}/v000002/rows")
    assert second_index.load_second_index(spark, path, 2, "h1").count() == rows.count()
    # rows that went missing, and columns of another name
    local = out.removeprefix("file://")
    meta = spark.read.parquet(f"{out}/meta")
    for k, change in enumerate((lambda r: r.where("t < 50"), lambda r: r.withColumnRenamed("feature", "vector"))):
        v = f"{path}/v00000{3 + k}"
        change(back).write.partitionBy("source_id", "part").parquet(f"{v}/rows")
        meta.write.parquet(f"{v}/meta")
        assert second_index.load_second_index(spark, path, 2) is None
    assert local.endswith("v000001")


def test_a_window_reads_its_own_files(frames, spark, tmp_path):
    path = f"file://{tmp_path}/second"
    second_index.write_second_index(second_index.grid_rows(frames, 1.0), path, 1.0, "h")
    index = second_index.load_second_index(spark, path, 2)
    windows = spark.createDataFrame([("a", 7300.0, 7305.5, 1), ("a", 8000.0, 8001.0, 2)], "source_id string, lo double, hi double, w int")
    got = second_index.in_windows(index, windows)
    assert sorted((r["w"], r["t"]) for r in got.collect()) == [(1, float(t)) for t in range(7300, 7306)] + [(2, 8000.0), (2, 8001.0)]
    assert len(index.inputFiles()) == 4
    scan = next(line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line)
    assert "PartitionFilters" in scan and "IN (2)" in scan.replace("part#", "").replace("= 2", "IN (2)") or " = 2)" in scan


def test_second_opinion_finds_what_the_first_cannot_see(spark):
    """By the first feature the shot lies at 40; the second one has its copy at 97. Only a wide scan gets there."""
    ship_code(spark)
    rng = np.random.default_rng(3)
    first, second = rng.normal(size=(300, 8)), np.repeat(rng.normal(size=(60, 8)), 5, axis=0) + rng.normal(size=(300, 8)) * 0.1
    lib = spark.createDataFrame([(float(t), v.tolist()) for t, v in enumerate(first)], "t double, feature array<double>")
    frames = spark.createDataFrame([(float(t), v.tolist()) for t, v in enumerate(second)], "t double, feature array<double>")
    q = spark.createDataFrame([(1, i, float(i), first[39 + i].tolist(), second[95 + i].tolist()) for i in range(3)], "shot_no long, i int, at double, feature array<double>, second array<double>")
    mains = spark.createDataFrame([(1, 38.5, 41.5, 0.0, 3.0)], "shot_no long, start double, end double, q_start double, q_end double")
    (r,) = opinion.second_opinion(mains, q, lib, frames).collect()
    assert r["moved"] and r["wide"] and abs(r["mid"] - 97) <= 4 and r["lead"] > 0.3
    (r,) = opinion.second_opinion(mains, q, lib, frames, index=frames).collect()
    assert r["moved"] and abs(r["mid"] - 97) <= 4
    near = opinion.second_opinion(mains, q, lib, frames, radius=20.0).collect()
    assert all(abs(r["mid"] - 97) > 4 for r in near)
    assert opinion.second_opinion(mains.limit(0), q, lib, frames).count() == 0


def test_peaks_lie_apart_from_what_is_known(spark):
    t = np.arange(0, 100)
    frames = spark.createDataFrame([(float(x), [1.0, float(abs(x - 50) + 1)]) for x in t], "t double, feature array<double>")  # best at 50, falling on both sides
    q = spark.createDataFrame([(1, 0, [1.0, 0.0], [1.0, 0.0])], "shot_no long, i int, feature array<double>, second array<double>")
    mids = spark.createDataFrame([(1, 50.0, 50.0), (1, 50.0, 54.0)], "shot_no long, now double, mid double")
    got = [r["mid"] for r in opinion.wide_peaks(mids, q, frames, 20.0).orderBy("pick").collect()]
    assert len(got) == 3 and got[0] == 47.5 and all(abs(a - b) > 1 for i, a in enumerate(got) for b in got[:i])
