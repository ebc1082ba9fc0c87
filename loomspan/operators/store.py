"""Keeping typed tables up to date: upserts, reconciliation, sweeps, folding of aliases."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.common import cut


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new, and those of old whose key new doesn't hold. Keys of new must be unique; a null key
    is one that no other equals, so its old row stays."""
    return new.unionByName(old.join(new.select(*key), key, "left_anti"), allowMissingColumns=True)


def coalescing_upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """As upsert(), but a null or an empty string or array of new doesn't replace what old has."""
    rest = [c for c in new.columns if c != key]
    renamed = old.select(F.col(key), *(F.col(c).alias(f"_old_{c}") for c in rest))

    def kept(c: str) -> Column:
        kind = new.schema[c].dataType.simpleString()
        says = F.col(c).isNotNull()
        if kind == "string":
            says = says & (F.col(c) != "")
        elif kind.startswith("array"):
            says = says & (F.size(c) > 0)
        return F.when(says, F.col(c)).otherwise(F.coalesce(F.col(f"_old_{c}"), F.col(c))).alias(c)

    return new.join(renamed, key, "full_outer").select(key, *(kept(c) for c in rest))


def changed(files: DataFrame, known: DataFrame, path: str = "path", digest: str = "content_hash") -> DataFrame:
    """Files whose path and content aren't known yet: what an ingest has to read."""
    return files.join(known.select(path, digest).distinct(), [path, digest], "left_anti")


def reconcile(old: DataFrame, new: DataFrame, source: str, key: list[str]) -> DataFrame:
    """Rows of old to delete: those of a source that was taken in again, which new doesn't hold."""
    again = old.join(new.select(source).distinct(), source, "left_semi")
    return again.join(new.select(*key), key, "left_anti")


def replace_by_source(old: DataFrame, new: DataFrame, source: str, sources: DataFrame | None = None) -> DataFrame:
    """old with all rows of new's sources replaced. sources: what was read, for sources left without rows."""
    read = (sources if sources is not None else new).select(source).distinct()
    return old.join(read, source, "left_anti").unionByName(new, allowMissingColumns=True)


def stubs(edges: DataFrame, nodes: DataFrame, target: str, key: str) -> DataFrame:
    """Keys that edges point to and no node has."""
    return edges.select(F.col(target).alias(key)).filter(F.col(key).isNotNull()).distinct().join(nodes.select(key), key, "left_anti")


def orphans(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Nodes that no edge (src, dst) touches."""
    ends = edges.select(F.col("src").alias(key)).union(edges.select(F.col("dst").alias(key))).distinct()
    return nodes.join(ends, key, "left_anti")


def last_edges(edges: DataFrame, by: list[str], order: str) -> DataFrame:
    """One edge per key, with the properties of the last by `order`."""
    rest = [c for c in edges.columns if c not in by]
    return edges.groupBy(*by).agg(F.max(F.struct(order, *(c for c in rest if c != order))).alias("_e")).select(*by, *(F.col(f"_e.{c}").alias(c) for c in rest))


def unique_match(pairs: DataFrame, src: str, dst: str) -> DataFrame:
    """(src, dst, matches): the one match of each src, or null, and whether there are none, one or several. The smallest
    and largest match are compared, so that no list of matches is gathered."""
    found = pairs.groupBy(src).agg(F.min(dst).alias("_low"), F.max(dst).alias("_high"))
    return found.select(src, F.when(F.col("_low") == F.col("_high"), F.col("_low")).alias(dst), F.when(F.col("_low").isNull(), "none").when(F.col("_low") == F.col("_high"), "one").otherwise("several").alias("matches"))


def resolve_or_stub(names: DataFrame, nodes: DataFrame, name: str, key: str) -> DataFrame:
    """(name, key): the only node of that simple name, else a stub's key."""
    simple = nodes.select(F.regexp_extract(F.lower(key), r"[^.]*$", 0).alias("_simple"), F.col(key).alias("_key"))
    match = unique_match(simple, "_simple", "_key")
    return (
        names.select(name).distinct()
        .join(match, F.lower(F.regexp_extract(name, r"[^.]*$", 0)) == F.col("_simple"), "left")
        .select(name, F.coalesce("_key", F.concat(F.lit("__stub__."), F.col(name))).alias(key))
    )


def fallback_match(refs: DataFrame, nodes: DataFrame, ref: str, key: str) -> DataFrame:
    """(ref, key): the node with that very key, else the only one with that simple name, else null."""
    exact = nodes.select(F.col(key).alias(ref), F.col(key).alias("_exact")).distinct()
    simple = unique_match(nodes.select(F.regexp_extract(key, r"[^.]*$", 0).alias("_simple"), F.col(key).alias("_by_name")).distinct(), "_simple", "_by_name")
    return (
        refs.select(ref).distinct().join(exact, ref, "left")
        .join(simple, F.regexp_extract(ref, r"[^.]*$", 0) == F.col("_simple"), "left")
        .select(ref, F.coalesce("_exact", "_by_name").alias(key))
    )


def fold_aliases(edges: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """edges (src, dst, ...) with a bare dst replaced by the only full name that ends in it."""
    full = names.filter(F.col(name).contains(".")).select(F.regexp_extract(name, r"[^.]*$", 0).alias("dst"), F.col(name).alias("_full")).distinct()
    one = unique_match(full, "dst", "_full").filter("_full IS NOT NULL").select("dst", "_full")
    rest = [c for c in edges.columns if c != "dst"]
    return edges.join(one, "dst", "left").select(*rest, F.coalesce("_full", "dst").alias("dst")).distinct()


def nearest_prefix(paths: DataFrame, modules: DataFrame, path: str, module: str) -> DataFrame:
    """(path, module): the longest module that is an ancestor folder of each path; null if none is. Paths
    are exploded to their ancestors, so it's an equality join."""
    parts = F.split(path, "/")
    ancestors = paths.select(path).distinct().withColumn("_a", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))))
    best = ancestors.join(modules.select(F.col(module).alias("_a")).distinct(), "_a").groupBy(path).agg(F.max_by("_a", F.length("_a")).alias(module))
    return paths.select(path).distinct().join(best, path, "left")


def enclosing(points: DataFrame, spans: DataFrame, group: str, at: str, start: str, end: str, name: str, levels: int = 24) -> DataFrame:
    """points with `name` of the shortest span [start, end] of their group that holds them, or null.

    A span of length up to 2^k touches at most two cells of 2^k; a point has one cell per level that
    occurs. So the join is one of equality, whatever a group holds. Ties go to the later start, then
    the smaller name; spans with a null or negative extent hold nothing.
    """
    length = F.col(end) - F.col(start)
    level = F.when(length <= 1, 0).otherwise(F.least(F.lit(levels), F.ceil(F.log2(F.greatest(length, F.lit(1))))))
    cell = lambda c: F.floor(c / F.pow(F.lit(2.0), F.col("_level"))).cast("long")
    held = (
        spans.filter(F.col(start).isNotNull() & (F.col(end) >= F.col(start)))
        .select(group, F.col(start).alias("_start"), F.col(end).alias("_end"), F.col(name).alias(name), level.cast("int").alias("_level"))
        .withColumn("_cell", F.explode(F.sequence(cell(F.col("_start")), cell(F.col("_end")))))
    )
    used = held.select("_level").distinct().agg(F.collect_set("_level").alias("l"))  # at most `levels` values
    asked = points.select(group, at).distinct().withColumn("_used", used.scalar()).withColumn("_level", F.explode("_used")).withColumn("_cell", cell(F.col(at)))
    best = (
        asked.join(held, [group, "_level", "_cell"])
        .filter((F.col("_start") <= F.col(at)) & (F.col(at) <= F.col("_end")))
        .groupBy(group, at)
        .agg(F.min(F.struct((F.col("_end") - F.col("_start")).alias("len"), (-F.col("_start")).alias("s"), F.col(name).alias("n"))).alias("_b"))
        .select(group, at, F.col("_b.n").alias(name))
    )
    return points.join(best, [group, at], "left")


def next_in_order(rows: DataFrame, by: str, order: list[str], key: str) -> DataFrame:
    """(key, next_<key>): the row that follows each within its group, for all but the groups' last rows; by
    `order` and then the key. Null groups are one group, and nulls come first.

    Rows are sorted over all tasks by ranges, so a group may span any number of them. Each task pairs its
    own rows, and one row is carried over each border."""
    sorted_ = cut(rows.select(by, *order, key).repartitionByRange(by, *order, key).sortWithinPartitions(by, *order, key)).select(by, key, F.spark_partition_id().alias("_p"))
    group, kind = rows.schema[by].dataType.simpleString(), rows.schema[key].dataType.simpleString()

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks()
            ahead, n = table.slice(1), table.num_rows - 1
            edge = pa.array([first and k == 0 for k in range(n)], pa.bool_())
            if n:
                yield pa.RecordBatch.from_arrays([table.column(0).slice(0, n).combine_chunks(), table.column(1).slice(0, n).combine_chunks(), ahead.column(0).combine_chunks(), ahead.column(1).combine_chunks(), table.column(2).slice(0, n).combine_chunks(), edge, pa.array([False] * n)], names=names)
                first = False
            held = table.slice(table.num_rows - 1).to_batches()[0]
        if held is not None:
            none = pa.nulls(1, held.column(0).type), pa.nulls(1, held.column(1).type)
            yield pa.RecordBatch.from_arrays([held.column(0), held.column(1), *none, held.column(2), pa.array([first]), pa.array([True])], names=names)

    names = ["group", "key", "next_group", "next_key", "part", "opens", "closes"]
    paired = cut(sorted_.mapInArrow(pair, f"group {group}, key {kind}, next_group {group}, next_key {kind}, part int, opens boolean, closes boolean"))
    within = paired.filter("NOT closes AND group <=> next_group").select(F.col("key").alias(key), F.col("next_key").alias(f"next_{key}"))
    borders = paired.filter("opens OR closes")  # two rows of each task at most
    last = borders.filter("closes").select("part", F.col("group").alias("g"), F.col("key").alias(key))
    opening = borders.filter("opens").select("part", F.col("group").alias("next_g"), F.col("key").alias("next_key"))
    both = last.join(opening, "part").withColumn("_next", F.lead(F.struct("next_g", "next_key")).over(Window.orderBy("part")))
    over = both.filter("_next IS NOT NULL AND g <=> _next.next_g").select(key, F.col("_next.next_key").alias(f"next_{key}"))
    return within.unionByName(over)


def rank_by_preference(rows: DataFrame, by: list[str], preference: Column, position: str) -> DataFrame:
    """The row of each group that comes first by preference, then by position."""
    order = Window.partitionBy(*by).orderBy(preference, position)
    return rows.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")
