"""Every llm query against its SQL, where it has one."""

import pytest

from skein.llm.queries import QUERIES, SQL
from tests.oracle import both, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf, con, name):
    if name in SQL:
        got, want = both(con, spark, sf, QUERIES[name], SQL[name])
        assert got == want and want
    else:
        assert QUERIES[name](spark, sf).count() > 0
