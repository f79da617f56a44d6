"""Export dispatch: what is refused, what each format holds, what the steps change, and files that come back."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from splicefind.plans import pipelines
from splicefind.session import ship_code

SCHEMA = "tl string, seg_index long, q_start double, q_end double, start double, end double, level string, subs array<struct<start:double,end:double>>, not_in_source boolean, failed boolean"


@pytest.fixture(scope="module")
def results(spark):
    ship_code(spark)
    rows = [
        ("a/1", 1, 0.0, 4.0, 10.3, 14.3, "HIGH", [(40.0, 42.0)], False, None),
        ("a/1", 2, 4.0, 6.0, 30.0, 32.0, "MEDIUM", [], None, False),
        ("a/1", 3, 6.0, 8.0, 50.0, 52.0, "LOW", [], False, False),
        ("a/1", 4, 8.0, 9.0, 70.0, 71.0, "HIGH", [], True, False),
        ("a/1", 5, 9.0, 10.0, 80.0, 81.0, "HIGH", [], False, True),
        ("a/1", 6, 10.0, 11.0, None, None, "LOW", [], False, False),
        ("b", 7, 0.0, 1.0, 5.0, 6.0, "HIGH", [], False, False),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def scenes(spark):
    return spark.createDataFrame([("a/1", 10.0, 14.0), ("a/1", 14.0, 28.0), ("a/1", 29.5, 33.0), ("b", 0.0, 9.0)], "tl string, start double, end double")


@pytest.mark.parametrize("wrong", [{"fmt": "mp4"}, {"least": "SOME"}, {"low_policy": "keep"}, {"material": "wide"}])
def test_refusals(results, wrong):
    with pytest.raises(ValueError, match=next(iter(wrong))):
        pipelines.export_project(results, None, ["tl"], **{"fmt": "edl", "title": "t", "source": "s.mkv", **wrong})


def test_edit_lists(results, scenes):
    out = pipelines.export_project(results, scenes, ["tl"], "edl", "cut", "film.mkv")
    files = {r["tl"]: (r["file"], r["text"]) for r in out["files"].collect()}
    assert {k: f for k, (f, _) in files.items()} == {"a/1": "a_1.loc.edl", "b": "b.loc.edl"}
    # two clips of the first timeline: LOW, marked and empty ones stay out; the first start is snapped to its scene
    assert files["a/1"][1].count(" V     C ") == 2 and "00:00:10:00" in files["a/1"][1] and "00:00:50:00" not in files["a/1"][1]
    bare = {r["tl"]: r["text"] for r in pipelines.export_project(results, None, ["tl"], "edl", "cut", "film.mkv")["files"].collect()}
    assert "00:00:10:08" in bare["a/1"] and "00:00:30:00" in bare["a/1"]
    low = pipelines.export_project(results, None, ["tl"], "edl", "cut", "film.mkv", low_policy="backup")["plan"]
    assert {(r["seg_index"], r["kind"]) for r in low.where("kind <> 'sub'").collect()} == {(1, "main"), (2, "main"), (3, "low"), (7, "main")}
    assert pipelines.export_project(results, None, ["tl"], "edl", "cut", "f", least="HIGH")["plan"].where("seg_index = 2").count() == 0
    assert pipelines.export_project(results.limit(0), scenes, ["tl"], "edl", "cut", "f")["files"].count() == 0


def test_markup_and_drafts(results, scenes):
    xml = {r["tl"]: r["text"] for r in pipelines.export_project(results, scenes, ["tl"], "fcp7_xml", "cut", "film.mkv")["files"].collect()}
    assert xml["a/1"].count("<clipitem") == 3 and xml["b"].count("<clipitem") == 1  # with the sub span
    wide, core = (pipelines.export_project(results, scenes, ["tl"], "draft", "cut", "film.mkv", material=m)["files"].where("tl = 'b'").first()["text"] for m in ("scene", "core"))
    wide, core = json.loads(wide), json.loads(core)
    assert core["start"] == 5.0 and core["end"] == 6.0 and core["placed"] == 0.0
    assert wide["start"] <= core["start"] and wide["end"] >= core["end"]
    lines = pipelines.export_project(results, scenes, ["tl"], "draft", "cut", "f", material="core")["files"].where("tl = 'a/1'").first()["text"].split("\n")
    placed = [json.loads(x) for x in lines]
    assert all(abs(b["placed"] - a["placed"] - a["width"]) < 1e-9 for a, b in zip(placed, placed[1:])) and len(placed) >= 2


def test_files_come_back(results, spark, tmp_path):
    files = pipelines.export_project(results, None, ["tl"], "edl", "cut", "film.mkv")["files"]
    pipelines.write_files(files, f"file://{tmp_path}/out")
    back = spark.read.text(f"file://{tmp_path}/out", wholetext=True)
    assert sorted((r["file"], r["value"].rstrip("\n")) for r in back.collect()) == sorted((r["file"], r["text"].rstrip("\n")) for r in files.collect())
    assert back.where(F.col("file").contains("/")).count() == 0
