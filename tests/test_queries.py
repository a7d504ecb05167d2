"""Every query of the library beside its SQL, on the smallest tables."""

import pytest

from tests.compare import connect, differences
from tidegate.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    query = catalog.queries()[name]
    if name in catalog.oracle_sql():
        assert not differences(spark, query, catalog.oracle_sql()[name], SF, con)
    else:
        assert query(spark, SF).columns


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 8
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_prunes_and_pushes_down(spark):
    plan = catalog.flagship(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "CartesianProduct" not in plan
    scan = catalog.QUERIES["a1_parquet_scan"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThan(l_shipdate" in scan
