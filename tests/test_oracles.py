"""Every registered query against its SQL over the driver's small tables."""

import os

import pytest

import oracle
from quillspark import registry

FOLDER = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, FOLDER)
    if name in registry.ORACLE_SQL:
        assert oracle.compare(df, con, registry.ORACLE_SQL[name]) == ""
    else:
        assert df.count() >= 0 and df.columns
