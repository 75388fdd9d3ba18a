"""The queries that have SQL give its rows."""

import pytest

from folio.llm import queries
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, con, name):
    assert compare(queries.queries()[name](spark, SF), con, queries.oracle_sql()[name]) is None
