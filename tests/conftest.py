import os
import sys
from pathlib import Path

import pandas
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = os.environ.get("LOOMSPAN_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not Path(DATA).exists():
        pytest.skip("no test tables here")
    return DATA


TABLES = "region nation customer supplier part orders lineitem events documents embeddings sources source_files sections chunks code_entities db_tables eval_items".split()


def compared(frame):
    """Rows of a pandas frame with sorted columns, in an order of their own, values as text."""
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("" if x is None or x is pandas.NA or x != x else str(x) for x in row) for row in frame.itertuples(index=False))


def by_duckdb(sql, folder):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{folder}/{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c.execute(sql).df()
