"""Every query with SQL gives DuckDB's rows; the others give rows."""

import pytest
from compare import connect, same

from siltstone import queries_domain  # noqa: F401 registers its queries
from siltstone.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, sf, con, name):
    same(QUERIES[name](spark, sf), con, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
