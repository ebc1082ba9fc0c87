"""Structured lookups: policies of a resource, code by what it is wired to, endpoints and routes by pattern,
uniqueness of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.text import matches_glob


def policies_for(policies: DataFrame, resource_type: str) -> DataFrame:
    """Policies that apply to exactly this resource type, with all their types, in order of id."""
    return policies.filter(F.array_contains("resource_types", resource_type)).select("id", "name", "severity", F.array_sort("resource_types").alias("resource_types")).orderBy("id")


def allowed_code(
    entities: DataFrame, *, beans: DataFrame | None = None, stereotype: str | None = None, annotations: DataFrame | None = None, annotation: str | None = None, in_module: DataFrame | None = None, module: str | None = None,
    endpoints: DataFrame | None = None, endpoint: str | None = None, destinations: DataFrame | None = None, listens_to: str | None = None, behaviours: DataFrame | None = None, behaviour: str | None = None,
    invoked: DataFrame | None = None, route: str | None = None,
) -> DataFrame:
    """(qualified_name) of the entities that fit every filter set; each is one left semi join, and a class
    also fits by its members. Search the result: filtering comes before the cut to candidates."""
    out = entities.select("qualified_name", "parent_qualified_name", "file_path")

    def keep(out: DataFrame, owners: DataFrame) -> DataFrame:
        named = owners.select(F.col(owners.columns[0]).alias("qualified_name")).distinct()
        parents = out.join(named, "qualified_name", "left_semi").select(F.col("parent_qualified_name").alias("qualified_name")).filter("qualified_name IS NOT NULL")
        return out.join(named.union(parents).distinct(), "qualified_name", "left_semi")

    if stereotype:
        out = keep(out, beans.filter(F.col("stereotype") == stereotype).select("code_qn"))
    if annotation:
        out = keep(out, annotations.filter((F.col("name") == annotation) | (F.col("fqn") == annotation)).select("owner"))
    if module:
        files = in_module.filter((F.col("module") == module) | F.col("module").endswith("/" + module)).select(F.col("path").alias("file_path"))
        out = out.join(files, "file_path", "left_semi")
    if endpoint:
        out = keep(out, endpoints.filter(matches_glob(F.col("path"), endpoint)).select("handler"))
    if listens_to:
        out = keep(out, destinations.filter(F.col("name") == listens_to).select("consumer"))
    if route:  # invoked: (route, target)
        out = keep(out, invoked.filter(F.col("route") == route).select("target"))
    if behaviour:
        out = keep(out, behaviours.filter(F.array_contains("behaviours", behaviour)).select("owner"))
    return out.select("qualified_name").distinct()


def endpoints_by(endpoints: DataFrame, path_glob: str | None = None, http_method: str | None = None, limit: int = 100) -> DataFrame:
    """Inbound endpoints by path and method, in order of path and method."""
    out = endpoints.filter("NOT outbound")
    if path_glob:
        out = out.filter(matches_glob(F.col("path"), path_glob))
    if http_method:
        out = out.filter(F.col("http_method") == http_method.upper())
    return out.orderBy("path", "http_method", "handler").limit(limit)


def routes_by(routes: DataFrame, uri_glob: str | None = None, limit: int = 100) -> DataFrame:
    """Routes with a start or target that fits, and their targets and steps in order."""
    out = routes
    if uri_glob:
        out = out.filter(matches_glob(F.coalesce("from_uri", F.lit("")), uri_glob) | F.exists("to_uris", lambda u: matches_glob(u["uri"], uri_glob)))
    pick = lambda conditional: F.array_sort(F.transform(F.filter("to_uris", lambda u: u["conditional"] == conditional), lambda u: u["uri"]))
    steps = F.transform("steps", lambda s: F.concat(s["kind"], F.lit("("), F.coalesce(s["uri"], s["ref"], F.lit("")), F.lit(")")))
    return out.select("id", "route_id", "from_uri", pick(False).alias("to_uris"), pick(True).alias("conditional_to_uris"), steps.alias("steps")).orderBy("route_id", "id").limit(limit)


def section_texts(chunks: DataFrame, most: int) -> DataFrame:
    """section_id, text (its chunks in order, parted by empty lines, cut to `most` characters) and truncated, of
    chunks (section_id, chunk_order, id, text), one row per id. Null texts are empty.

    Each chunk takes the two characters that part it from the next, so of a section of any size no more than
    most / 2 + 1 begin before the cut; that many are picked within each task before they are shuffled.
    Lengths of all are added up apart. Sections without chunks have no row."""
    n = F.length(F.coalesce("text", F.lit("")))
    size = chunks.groupBy("section_id").agg((F.sum(n) + 2 * (F.count(F.lit(1)) - 1)).alias("_n"))
    first = F.row_number().over(Window.partitionBy("section_id").orderBy(F.col("chunk_order").asc_nulls_first(), "id"))
    kept = chunks.withColumn("_k", first).filter(F.col("_k") <= most // 2 + 1)
    held = kept.groupBy("section_id").agg(F.array_sort(F.collect_list(F.struct("_k", F.substring(F.coalesce("text", F.lit("")), 1, most).alias("text")))).alias("_c"))
    text = F.array_join(F.transform("_c", lambda x: x["text"]), "\n\n")
    return held.join(size, "section_id").select("section_id", F.substring(text, 1, most).alias("text"), (F.col("_n") > most).alias("truncated"))


def repeated_keys(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that several rows have: what a uniqueness constraint would refuse."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
