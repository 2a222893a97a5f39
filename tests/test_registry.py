"""Every registered query with checking SQL agrees with it on the smallest tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from policylake.registry import QUERIES
from tests.oracle_compare import compare, connect

SLOW_SQL = {"question_search", "answers_cited", "answer_contexts"}


@pytest.fixture(scope="session")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW_SQL])
def test_query(spark, sf, con, name):
    ok, message = compare(con, spark, name, queries()[name], oracle_sql().get(name), sf)
    assert ok, message


def test_entry(spark):
    assert entry(spark).count() > 0


def test_names():
    assert set(oracle_sql()) <= set(queries())
