"""References to records that do not exist (problem 3).

Keys become integers: a key is a stem and the number it ends in, so the keys of one stem and width are
sorted integers, which compress into contiguous runs. A reference is matched to the run that starts at
or before its number; if its number lies beyond the end of that run, its target is missing. Numbers
are cut into blocks, so that no stem, however many keys it holds, is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.common import blank, current_rows

BLOCK = 4096  # numbers of one block: the most rows that a window sorts at once, but for references
_SLOT = ["ref_table", "stem", "width", "block"]


def _encode(df: DataFrame, key: Column) -> DataFrame:
    """key as stem, width, block and number; one to one. Keys without final digits have the number 0."""
    tail = F.regexp_extract(key, "[0-9]{1,15}$", 0)
    return df.withColumns(
        {
            "stem": F.expr("substring(ref_key, 1, length(ref_key) - length(regexp_extract(ref_key, '[0-9]{1,15}$', 0)))"),
            "width": F.length(tail),
            "number": F.coalesce(F.when(tail != "", tail).cast("long"), F.lit(0).cast("long")),
        }
    ).withColumn("block", F.floor(F.col("number") / BLOCK))


def folded_name(c: Column) -> Column:
    """A table name as references compare it: lower case, without outer blanks and quoting marks."""
    return F.lower(F.trim(F.regexp_replace(c, r'["`\[\]]', "")))


def runs(targets: DataFrame) -> DataFrame:
    """Contiguous runs of the live keys (ref_table, ref_key, first_at): slot, run_start, run_end and the
    latest first_at within."""
    by = Window.partitionBy(*_SLOT).orderBy("number")
    return (
        _encode(targets, F.col("ref_key"))
        .withColumn("_island", F.col("number") - F.row_number().over(by))
        .groupBy(*_SLOT, "_island")
        .agg(F.min("number").alias("run_start"), F.max("number").alias("run_end"), F.max("first_at").alias("latest"))
        .drop("_island")
    )


def as_of(refs: DataFrame, run: DataFrame) -> DataFrame:
    """refs (ref_table, ref_key, ..., unique in the first two) with run_end and latest of the run that
    starts last at or before them; null where none does. Both sides are laid in one order and the run
    is carried forward: no pair of rows is tried."""
    encoded = _encode(refs, F.col("ref_key"))
    cols = [c for c in encoded.columns if c not in (*_SLOT, "number")]
    both = encoded.select(*_SLOT, "number", F.lit(1).alias("_kind"), F.struct(*cols).alias("_ref")).unionByName(
        run.select(*_SLOT, F.col("run_start").alias("number"), F.lit(0).alias("_kind"), F.struct("run_end", "latest").alias("_run")),
        allowMissingColumns=True,
    )
    order = Window.partitionBy(*_SLOT).orderBy("number", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return (
        both.withColumn("_run", F.last("_run", ignorenulls=True).over(order))
        .filter("_kind = 1")
        .select("ref_table", "number", "_ref.*", "_run.run_end", "_run.latest")
    )


def orphans(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """The references without a target that was there in time, with why.

    refs: src_table, src_key, src_first_at, ref_table, target_key. targets: ref_table, ref_key,
    first_at, live; unique in the first two. The result has the columns of refs and reason, one of
    absent, deleted and late, each triple once. Null and blank references are none; a null first_at is
    never later, and nothing is later than it. Empty tables give no rows. Columns besides these are
    ignored, so clashing names do no harm.

    Distinct targets are checked, not references: a target that a third of all rows name is one row.
    A run's latest first_at settles most of the question of late targets; only the rest is looked up.
    """
    refs = refs.filter(~blank(F.col("target_key"))).select("src_table", "src_key", "src_first_at", "ref_table", "target_key").distinct()
    wanted = refs.groupBy("ref_table", F.col("target_key").alias("ref_key")).agg(F.min("src_first_at").alias("earliest"))
    placed = as_of(wanted, runs(targets.filter("live")))
    gone = F.col("run_end").isNull() | (F.col("number") > F.col("run_end"))
    doubtful = placed.withColumn("gone", gone).filter(F.col("gone") | (F.col("latest") > F.col("earliest")))
    facts = targets.select("ref_table", "ref_key", F.col("first_at").alias("target_first_at"), F.lit(True).alias("_known"))
    doubtful = doubtful.join(facts, ["ref_table", "ref_key"], "left").select(
        "ref_table", F.col("ref_key").alias("target_key"), "gone", "target_first_at", "_known"
    )
    return (
        refs.join(doubtful, ["ref_table", "target_key"])
        .filter(F.col("gone") | (F.col("target_first_at") > F.col("src_first_at")))
        .select(
            "src_table", "src_key", "src_first_at", "ref_table", "target_key",
            F.when(~F.col("gone"), "late").when(F.col("_known"), "deleted").otherwise("absent").alias("reason"),
        )
    )


def knowledge_refs(sections: DataFrame, code_entities: DataFrame, db_tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References and targets of the three tables, for orphans()."""
    refs, targets = [], []
    for name, df, key, parent in (
        ("sections", sections, "id", "parent_id"),
        ("code_entities", code_entities, "qualified_name", "parent_qualified_name"),
    ):
        now = current_rows(df, key, parent)
        refs.append(
            now.filter("live").select(
                F.lit(name).alias("src_table"), F.col(key).alias("src_key"), F.col("first_at").alias("src_first_at"),
                F.lit(name).alias("ref_table"), F.col(parent).alias("target_key"),
            )
        )
        targets.append(now.select(F.lit(name).alias("ref_table"), F.col(key).alias("ref_key"), "first_at", "live"))
    now = current_rows(db_tables, "qualified_name", "ref_tables")
    refs.append(
        now.filter("live").select(
            F.lit("db_tables").alias("src_table"), F.col("qualified_name").alias("src_key"), F.col("first_at").alias("src_first_at"),
            F.lit("db_tables").alias("ref_table"), F.explode("ref_tables").alias("target_key"),
        ).withColumn("target_key", folded_name(F.col("target_key")))
    )
    targets.append(
        now.groupBy(folded_name(F.col("qualified_name")).alias("ref_key"))
        .agg(F.min("first_at").alias("first_at"), F.max("live").alias("live"))
        .select(F.lit("db_tables").alias("ref_table"), "ref_key", "first_at", "live")
    )
    union = lambda dfs: dfs[0].unionByName(dfs[1]).unionByName(dfs[2])
    return union(refs), union(targets)


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphan references per table, month of the referring key's first ingested_at, and reason."""
    return found.groupBy("src_table", F.date_format("src_first_at", "yyyy-MM").alias("month"), "reason").agg(
        F.count(F.lit(1)).alias("n_refs"), F.countDistinct("src_key").alias("n_keys")
    )
