"""The full localiser on planted films: clusters, pools and their budgets, rescue, provenance, cards, failures and parts of shots."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from splicefind.functions.vectors import centroids
from splicefind.operators import evidence
from splicefind.session import ship_code

SCHEMA = "shot_no long, t double, feature array<double>"


def noisy(rng, v, k=0.05):
    v = v + rng.normal(size=v.shape) * k
    return (v / np.linalg.norm(v, axis=-1, keepdims=True)).tolist()


@pytest.fixture(scope="module")
def film(spark):
    """300 s of scenes of 20 s, one direction each; shots copied from it, mixed, or made of nothing."""
    ship_code(spark)
    rng = np.random.default_rng(21)
    base = rng.normal(size=(15, 24))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = np.repeat(base, 20, axis=0) + rng.normal(size=(300, 24)) * 0.12
    lib = spark.createDataFrame([(float(t), noisy(rng, v, 0)) for t, v in enumerate(rows)], "t double, feature array<double>")
    shots = {
        1: noisy(rng, rows[100:108]),  # one scene
        2: noisy(rng, np.concatenate([rows[40:45], rows[240:246]])),  # two scenes: a montage
        3: noisy(rng, rng.normal(size=(6, 24))),  # nothing
        4: noisy(rng, np.concatenate([rows[60:63], rows[200:203], rows[20:23]])),  # three parts
    }
    q = spark.createDataFrame([(s, i * 0.5, v) for s, own in shots.items() for i, v in enumerate(own)], SCHEMA)
    areas = lib.withColumn("scene_no", F.floor(F.col("t") / 20).cast("long"))
    scenes = areas.groupBy("scene_no").agg(F.min("t").alias("start"), (F.max("t") + 1).alias("end")).join(centroids(areas, ["scene_no"], out="feature"), "scene_no")
    return base, rows, lib, q, scenes


def test_frames_lead_to_their_scenes(film, spark):
    _, _, lib, q, _ = film
    units, moments = evidence.locate(q, lib, least_sim=0.6)
    main = {r["shot_no"]: r for r in units.where("rank = 1").collect()}
    assert set(main) == {1, 2, 4} and 95 <= main[1]["start"] <= 101 and 107 <= main[1]["end"] <= 125
    two = units.where("shot_no = 2").collect()
    assert len(two) == 2 and {r["n_strong"] for r in two} == {2} and {r["rank"] for r in two} == {1, 2} and {r["rows_in"] for r in two} == {11}
    own = moments.where("shot_no = 1").collect()
    # the strongest column of the scene counts; beyond the cluster's own range it is out of scope and low
    assert len(own) == 1 and own[0]["m_end"] - own[0]["m_start"] == 2 and 99 <= own[0]["m_start"] <= 119 and (own[0]["in_scope"] or own[0]["label"] == "low")


def test_assembly_names_its_sources(film, spark):
    _, _, lib, q, scenes = film
    shots = q.groupBy("shot_no").agg(F.min("t").alias("q_start"), (F.max("t") + 0.5).alias("q_end"), F.count("*").alias("nq"))
    shots = shots.withColumns({"card": F.col("shot_no") == 4, "failed": F.lit(None).cast("string")})
    extra = spark.createDataFrame([(8, 0.0, 1.0, 0, False, "unreadable"), (9, 0.0, 1.0, 0, None, None)], shots.schema)
    units, moments = evidence.locate(q, lib, scenes, least_sim=0.6)
    got = {r["shot_no"]: r for r in evidence.assemble(shots.unionByName(extra), units, moments).collect()}
    assert got[1]["source"] == "moment" and 99 <= got[1]["start"] <= 119 and got[1]["end"] - got[1]["start"] == 2 and not got[1]["montage"]
    assert got[2]["montage"] and got[2]["source"] == "cluster" and len(got[2]["sub_spans"]) >= 2 and got[2]["level"] == "LOW" and "montage" in got[2]["reasons"]
    assert got[3]["failure"] == "no_evidence" and got[3]["start"] is None and got[3]["score"] == 0
    assert got[4]["not_in_source"] and got[4]["failure"] == "text_card_not_in_source" and got[4]["start"] is None
    assert got[8]["failure"] == "unreadable" and got[8]["reasons"] == ["unreadable"] and got[9]["failure"] == "no_evidence" and not got[9]["not_in_source"]
    bare = evidence.assemble(shots.drop("card", "failed"), units, None).where("shot_no = 1").first()
    assert bare["source"] == "cluster" and bare["failure"] is None


def test_pools_rescue_what_frames_miss(film, spark):
    """Frames are held to a threshold that nothing passes: the scene, or else the event, takes their place, and says so."""
    _, _, lib, q, scenes = film
    one = q.where("shot_no = 1")
    units, _ = evidence.locate(one, lib, scenes, scenes, least_sim=1.1, area_sim=0.5)
    (main,) = units.where("rank = 1").collect()
    assert main["kind"] == evidence.SCENE and main["n_strong"] == 0 and main["start"] <= 100 and main["end"] >= 119
    assert units.where("kind = 2").count() == 0  # the event is the same place: its span overlaps the scene's
    units, moments = evidence.locate(one, lib, None, scenes, least_sim=1.1, area_sim=0.5)
    (main,) = units.where("rank = 1").collect()
    assert main["kind"] == evidence.EVENT and 99 <= main["start"] <= 101 and 118 <= main["end"] <= 120
    shots = one.groupBy("shot_no").agg(F.min("t").alias("q_start"), (F.max("t") + 0.5).alias("q_end"), F.count("*").alias("nq"))
    r = evidence.assemble(shots, units, moments).first()
    assert r["source"] == "event_pool" and [s["from_event_pool"] for s in r["sub_spans"]] == [True] and r["level"] == "LOW"
    assert evidence.locate(one, lib, None, None, least_sim=1.1)[0].count() == 0


def test_pools_keep_to_their_budget(film, spark):
    base, _, lib, _, scenes = film
    middle = (base[3] + 0.6 * base[7] + 0.3 * base[1]) / 2
    m = spark.createDataFrame([(5, 5.0, middle.tolist())], SCHEMA)
    got = {r["unit_no"]: r for r in evidence.recall_units(m, scenes, lib, 3, 25, 2, -1.0).collect()}
    assert {k: r["n"] for k, r in got.items()} == {3: 20, 7: 5} and (got[7]["c0"], got[7]["c1"]) == (140.0, 159.0)
    # a scene that the frames' gate rejects has used its share up
    assert set(r["unit_no"] for r in evidence.recall_units(m, scenes, lib, 3, 21, 2, -1.0).collect()) == {3}
    assert set(r["unit_no"] for r in evidence.recall_units(m, scenes, lib, 3, 60, 2, 0.4).collect()) < {3, 7, 1}


def unit(kind, no, start, end, cover, sim, weak=False, q=0.0, nq=2, at=0.0):
    return {"shot_no": 1, "kind": kind, "unit_no": no, "start": start, "end": end, "cover": cover, "sim": sim, "weak": weak, "q_start": q, "nq": nq, "at": at}


def test_settling():
    rows = [unit(0, 0, 0, 10, 0.9, 0.9, q=5, at=3), unit(0, 1, 1, 10, 0.8, 0.8, q=1), unit(0, 2, 50, 60, 0.2, 0.2, q=0), unit(0, 3, 80, 90, 0.5, 0.6, q=2, at=7), unit(1, 4, 0, 9, 0.9, 0.9), unit(1, 5, 200, 210, 0.6, None), unit(2, 6, 201, 210, 0.6, 0.6), unit(2, 7, None, None, 0.9, 0.1)]
    got = {r["unit_no"]: (r["rank"], r["base"]) for r in evidence.settle(rows)}
    # 1 overlaps 0, 2 is low on both counts, 4 overlaps 0; 6 overlaps 5
    assert got == {3: (2, True), 0: (1, True), 5: (0, False), 7: (0, False)}
    assert {(r["n_strong"], r["rows_in"], r["dispersion"]) for r in evidence.settle(rows)} == {(4, 4, 2.0)}
    only = evidence.settle([unit(0, 2, 50, 60, 0.2, 0.2), unit(0, 3, 70, 80, 0.1, 0.3)])
    assert [(r["unit_no"], r["rank"]) for r in only] == [(2, 1)]  # the best stays where all would go
    assert evidence.settle([unit(0, 2, 50, 60, 0.2, 0.2, weak=True)]) == []
    assert [r["unit_no"] for r in evidence.settle([unit(1, 4, 0, 9, 0.2, 0.2)])] == []  # pools have no such floor


def test_parts_of_shots(film, spark):
    base, _, lib, q, _ = film
    parts = evidence.sub_shots(q, 0.5)
    assert sorted((r["parent"], r["part"], r["n"]) for r in parts.groupBy("parent", "part").agg(F.count("*").alias("n")).where("parent <> 3").collect()) == [(4, 0, 3), (4, 1, 3), (4, 2, 3)]
    got = {r["shot_no"]: r for r in evidence.relocate_by_parts(q, lib, 0.5, least_sim=0.6).collect()}
    assert 4 in got and 1 not in got and 2 not in got
    start = (60, 200, 20)[got[4]["part"]]
    assert start - 3 <= got[4]["start"] <= start + 1 and got[4]["best_sim"] > 0.7
    # cuts at consecutive rows: every other one counts
    flip = [base[i].tolist() for i in (0, 0, 1, 2, 3, 3, 3, 4)]
    df = spark.createDataFrame([(6, float(i), v) for i, v in enumerate(flip)], SCHEMA)
    assert [r["part"] for r in evidence.sub_shots(df, 0.5).orderBy("t").collect()] == [0, 0, 1, 1, 2, 2, 2, 3]
