"""Every query of the core against its SQL on the smallest tables."""

from pathlib import Path

import pytest
from compare import compare, connect

from inkspark.bindings import QUERIES, SQL

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(D).exists(), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    return connect(D)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, D, name, QUERIES[name], SQL.get(name)) == ""
