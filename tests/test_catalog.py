"""Every core query against its SQL, on the smallest tables."""

import pytest

from promptmill.plans import catalog

from .conftest import DATA
from .oracle import connect, rows, sql_rows

NO_SQL = {"kmeans_minibatch", "clock_evict"}


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


def test_every_query_has_sql_or_a_reason():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == NO_SQL
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, DATA)) == sql_rows(duck, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(NO_SQL))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_index_recall(spark):
    got = {r["sixths"]: r["recall"] for r in catalog.QUERIES["ivf_recall"](spark, DATA).collect()}
    assert got[5] >= 0.9 > got[0]
    hits = {r["search"]: r["recall"] for r in catalog.QUERIES["lookup_recall"](spark, DATA).collect()}
    assert hits["lookup_decision"] >= 0.9 > hits["nprobe1"]
    exact = catalog.QUERIES["lookup_decision_exact"](spark, DATA)
    assert exact.where("decision = 'HIT'").count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(r["decision"] for r in e.entry(spark).collect()) == {"HIT", "MISS"}
