"""Every registered query against its SQL, on the smallest tables."""

import pytest

from checks.catalogue import QUERIES, SQL
from checks.compare import compare, duck


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    verdict = compare(spark, sf, name, QUERIES[name], SQL.get(name), con)
    assert verdict.startswith(("equal", "rows only")), verdict


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
