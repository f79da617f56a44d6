"""Finding F1 of round 4: aligned_scores and its SQL."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_findings_r03 import against_sql

from splicefind.functions import scalars
from splicefind.operators import retrieval
from splicefind.plans import repairing

#: Similarities of nine digits that end in 500 and that SQL rounds down to six, since the scaled double is below the half.
DOWN = [0.1250005, 0.1285545, 0.2510185, 0.2516535, 0.2530975, 0.2545685, 0.2580975, 0.2616455, 0.5030275, 0.5065715]


def embeddings(rows):
    """Vectors of the given cosines to the first axis; a row is (vec_id, cosine)."""
    return pd.DataFrame({"vec_id": [k for k, _ in rows], "embedding": [[c, math.sqrt(1 - c * c)] for _, c in rows]})


def shot(*ids):
    return [(k, 1.0) for k in ids]


def test_f1_halves_are_rounded_as_in_sql(spark, tmp_path):
    """Each position's best similarity lies between two values of six digits."""
    library = [(k, DOWN[k // 7 % len(DOWN)]) for k in range(20, 460) if k // 20 % 5]
    against_sql(spark, tmp_path, repairing.aligned_scores, repairing.SQL["aligned_scores"], embeddings=embeddings(shot(*range(20), *range(500, 520)) + library))


def test_f1_repeated_keys(spark, tmp_path):
    """Library rows of one time count all, in either order; a position is answered once."""
    library = [(k, c) for k in range(20, 100) for c in ((0.3, 0.6), (0.7, 0.2))[k % 2]]
    against_sql(spark, tmp_path, repairing.aligned_scores, repairing.SQL["aligned_scores"], embeddings=embeddings(shot(*range(20), *range(20), 7) + library))


def test_f1_keys_below_zero(spark, tmp_path):
    """The remainder has its dividend's sign, so these positions lie before 0."""
    library = [(k, 0.5 + k / 1000) for k in [*range(-99, -19), *range(20, 100), *range(320, 400)]]
    against_sql(spark, tmp_path, repairing.aligned_scores, repairing.SQL["aligned_scores"], embeddings=embeddings(shot(*range(-19, 20), *range(-119, -99)) + library))


@pytest.mark.parametrize("order", [1, -1])
def test_f1_window_sims_takes_the_larger_of_equal_times(spark, order):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "shot_no long, feature array<double>")
    lib = spark.createDataFrame([(5.0, [0.6, 0.8]), (6.0, [0.0, 1.0]), (5.0, [0.8, 0.6])][::order], "t double, feature array<double>").coalesce(1)
    windows = spark.createDataFrame([(1, 4.0, 6.0), (1, 5.0, 7.0)], "shot_no long, lo double, hi double")
    got = retrieval.window_sims(windows, q, lib, "lo", "hi", 4.0).collect()
    assert sorted(tuple(r) for r in got) == [(1, 5.0, 0.8), (1, 6.0, 0.0)]


def test_f1_round_like_sql(spark):
    """Halves and other values of both signs, and null."""
    values = [s * x for x in [*DOWN, 0.0000005, 0.0000015, 2.5, 1 / 3, 0.49999999999999994, 123456.7890125] for s in (1, -1)] + [0.0, None]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").orderBy("i").select(scalars.sql_round(F.col("x"), 6)).collect()]
    assert got == [None if x is None else duckdb.execute("select round(?::double, 6)", [x]).fetchone()[0] for x in values]
