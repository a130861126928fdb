"""The text queries against their SQL on the smallest tables."""

import pytest

from promptmill.llm import queries

from ..oracle import connect, rows, sql_rows
from .conftest import DATA

NO_SQL = {"p1_forms", "p1_decided", "p2_found", "p2_shares", "p3_found", "p6_packing", "p6_fill", "p8_pieces"}


def test_which_have_sql():
    assert set(queries.QUERIES) - set(queries.ORACLES) == NO_SQL


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    assert rows(queries.QUERIES[name](spark, DATA)) == sql_rows(connect(DATA), queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(NO_SQL))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_truncated_pairs_are_the_cut_records(spark):
    cut = {r["row_id"] for r in queries.p2_found(spark, DATA).where("origin = 'cache_records'").collect()}
    found = {r["record_id"]: r["defect"] for r in queries.p3_found(spark, DATA).collect()}
    truncated = {i for i, d in found.items() if d == "truncated"}
    assert truncated <= cut and all(found.get(i) in ("truncated", "echo", "empty") for i in cut)
