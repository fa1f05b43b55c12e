"""Every registered query against its DuckDB statement on the same tables."""

import pytest

from tests.compare import actual, duck, expected
from tests.conftest import SF_DIR
from tillmart.oracle import ORACLE
from tillmart.registry import QUERIES


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, connection, name):
    got = actual(QUERIES[name](spark, SF_DIR))
    want = expected(connection, ORACLE[name])
    assert got[0] == want[0]
    assert got[1] == want[1]
