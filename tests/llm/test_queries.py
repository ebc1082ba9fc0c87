import pytest

from loomspan.llm import queries
from tests.conftest import by_duckdb, compared


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, data, name):
    assert compared(queries.QUERIES[name](spark, data).toPandas()) == compared(by_duckdb(queries.ORACLE[name], data))


@pytest.mark.parametrize("name, columns", [("p4_found", ["qualified_name"]), ("p6_found", ["path"]), ("p7_ids", ["doc_id", "ids"]), ("p8_found", ["doc_id", "item_id"]), ("p9_found", ["doc_id", "lang"])])
def test_columns(spark, data, name, columns):
    rows = queries.QUERIES[name](spark, data)
    assert rows.columns == columns and rows.count() > 0
