"""Every registered query of the engine against its SQL (or, without one, that it runs)."""

from __future__ import annotations

import pytest
from compare import rows

from splicefind.plans import applied, assessing, editing, locating, matching, misc, refining, repairing, segmenting, sequences

PARTS = (matching, editing, repairing, misc, sequences, applied, refining, segmenting, locating, assessing)
QUERIES = {k: f for p in PARTS for k, f in p.QUERIES.items()}
SQL = {k: s for p in PARTS for k, s in p.SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(name, spark, sf, duck):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_without_text_operators(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(SQL) <= set(e.oracle_sql())
    assert e.entry(spark).count() > 0
