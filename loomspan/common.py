"""What every operator shares: reading tables, cutting lineage, current rows of a versioned table."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# The white space of Python's str.split(), as a class that Java and RE2 read alike.
WHITE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, or that was set by setCheckpointDir();
    where there is none, a temporary one if all runs on this machine (master local), else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    jsc = context._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="loomspan-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that its lineage ends there and the loss of
    an executor costs nothing that is already done."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_counting(df: DataFrame, **stats: Column) -> tuple[DataFrame, dict]:
    """cut(df) and statistics over its rows, taken by the same job."""
    seen = Observation(uuid.uuid4().hex)
    return cut(df.observe(seen, *(c.alias(n) for n, c in stats.items()))), seen.get


def _spills(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/spills-{spark.sparkContext.applicationId}"


def clear_spills(spark: SparkSession) -> bool:
    """Deletes what spill() has written for this application, once no result that reads it is needed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_spills(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spill(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """df as a written table in the shared folder: columns can be pruned when it's read again. It lies in
    the folder of this application's spills, which clear_spills() deletes."""
    path = f"{_spills(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)  # the schema, as an empty table may have no file


def spilled_table(first: DataFrame, label: str, partition_by: list[str]) -> tuple[Callable[[DataFrame], None], Callable[[], DataFrame]]:
    """A written table that grows: what adds rows to it, and what reads all that it holds so far."""
    path, spark = f"{_spills(first.sparkSession)}/{label}-{uuid.uuid4().hex}", first.sparkSession

    def add(rows: DataFrame) -> None:
        rows.select(*first.columns).write.mode("append").partitionBy(*partition_by).parquet(path)

    add(first)
    return add, lambda: spark.read.schema(first.schema).parquet(path)


def blank(c: Column) -> Column:
    """True for null and for text of white space alone."""
    return c.isNull() | (F.regexp_replace(c, WHITE, "") == "")


def words(c: Column) -> Column:
    """The words of a text as Python's str.split() gives them; null for null."""
    return F.filter(F.split(c, WHITE), lambda w: w != "")


def current_rows(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per key: `columns` of the row with the latest ingested_at, with `live` (its deleted_at is
    null) and `first_at`, the smallest ingested_at of the key.

    Rows without a key drop out. A null ingested_at counts as older than any time. Ties are copies by
    contract; if they differ, the larger row wins, so the result never depends on order. Partial
    aggregation on the map side makes a hot key cheap. Columns of df not named don't travel.
    """
    row = F.struct(
        F.col("ingested_at").alias("_at"),
        F.col("deleted_at").isNull().alias("live"),
        *(F.col(c).alias(c) for c in columns),
    )
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).alias(key))
        .agg(F.max(row).alias("_row"), F.min("ingested_at").alias("first_at"))
        .select(key, *(F.col(f"_row.{c}").alias(c) for c in columns), F.col("_row.live").alias("live"), "first_at")
    )
