"""Every registered query against its SQL, at the smallest scale."""

import os

import pytest

from checks import oracle, queries
from checks.compare import differences, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_each_query_has_sql():
    assert set(queries.queries()) == set(oracle.oracle_sql())


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, con, name):
    got = queries.queries()[name](spark, SF).toPandas()
    want = con.execute(oracle.oracle_sql()[name]).df()
    assert len(got) > 0
    assert differences(got, want) == []
