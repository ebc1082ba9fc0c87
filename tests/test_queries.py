"""Every query of the core against its SQL, on the smallest tables."""

import pytest

from loomspan.plans import catalogue
from tests.conftest import by_duckdb, compared


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_as_sql(spark, data, name):
    mine = catalogue.QUERIES[name](spark, data).toPandas()
    theirs = by_duckdb(catalogue.ORACLE[name], data)
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert compared(mine) == compared(theirs)


@pytest.mark.parametrize("name", ["parsed_counts"])
def test_rows(spark, data, name):
    assert catalogue.QUERIES[name](spark, data).count() > 0


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
