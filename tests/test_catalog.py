import os

import oracle
import pytest

from quarrylight.plans import catalog

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.TABLES), reason="no tables")


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, name):
    oracle.same(spark, catalog.QUERIES[name], catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, oracle.TABLES).count() > 0
