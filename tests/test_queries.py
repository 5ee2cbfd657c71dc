"""Every registered query of the library against its SQL at the smallest size."""

from __future__ import annotations

import pytest

from corvane.plans import COVERS, ORACLE_SQL, QUERIES
from corvane.sources.tables import results
from support import rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, sf, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs_without_sql(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_every_query_says_what_it_covers():
    assert set(COVERS) == set(QUERIES) and all(COVERS.values())


def test_event_groups_take_every_scan(spark, sf):
    assert QUERIES["event_groups"](spark, sf).agg({"frames": "sum"}).first()[0] == results(spark, sf).count()
