"""Queries of ingestion: parsing the source files, streaming, and the rules derived from what was parsed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.common import cut, shared_folder, table
from loomspan.operators import answers as A
from loomspan.operators import derive as D
from loomspan.plans.samples import PROJECT
from loomspan.sources import files as S
from loomspan.sources.sqlscan import table_mentions
from loomspan.streaming import ingest as I


def parsed_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.parse(table(spark, d, "source_files")).groupBy("parser", "tag").agg(F.count(F.lit(1)).alias("n"))


def parsed_entities(spark: SparkSession, d: str) -> DataFrame:
    return S.records(S.parse(table(spark, d, "source_files")), "entity").select("qualified_name", "name", "kind", "language", "file_path", "start_line", "end_line", "signature", "docstring")


def parsed_columns(spark: SparkSession, d: str) -> DataFrame:
    return S.records(S.parse(table(spark, d, "source_files").filter(F.col("path").endswith(".sql"))), "db_column")


def parsed_xml_beans(spark: SparkSession, d: str) -> DataFrame:
    return S.records(S.parse(table(spark, d, "source_files").filter(F.col("path").endswith(".xml"))), "xml_bean").select("file_path", "bean_id", "class_name")


def parsed_sections(spark: SparkSession, d: str) -> DataFrame:
    """Documents read as Markdown files."""
    docs = table(spark, d, "documents").select(F.format_string("doc-%d.md", "doc_id").alias("path"), F.col("text").alias("content"))
    return S.records(S.parse(docs), "section").select("id", "title", "level", "breadcrumb", "parent_id")


def streaming_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every table of a stream of files, in two rounds of which the second changes and adds some;
    those of entities by language and kind."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    files = table(spark, d, "source_files").filter("content IS NOT NULL").select("path", "content", F.sha2("content", 256).alias("content_hash"))
    again = files.withColumn("content", F.concat("content", F.lit("\n"))).withColumn("content_hash", F.sha2("content", 256))
    second = files.filter(F.length("path") % 3 == 0).unionByName(again.filter(F.length("path") % 3 == 1))
    store = I.TableStore(spark, f"{folder}/tables")
    for arriving in (files.filter(F.length("path") % 3 > 0), second):
        arriving.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(files.schema).parquet(f"{folder}/in").writeStream.option("checkpointLocation", f"{folder}/progress")
        stream.foreachBatch(lambda rows, n: I.merge_batch(store, rows, n)).trigger(availableNow=True).start().awaitTermination()
    n = F.count(F.lit(1)).alias("n")
    counts = store.read("entity", I.stored_schema("entity")).groupBy(F.lit("entity").alias("table"), "language", "kind").agg(n)
    for name in I.TABLES:
        if name != "entity":
            rows = store.read(name, I.stored_schema(name)).agg(n)
            counts = counts.unionByName(rows.select(F.lit(name).alias("table"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("string").alias("kind"), "n"))
    return counts


def stream_activity(spark: SparkSession, d: str) -> DataFrame:
    return I.activity(table(spark, d, "events")).select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "accesses")


class Project:
    """The tables of the sample project and, with a folder, of its source files, parsed; copies of a path count once."""

    def __init__(self, spark: SparkSession, d: str = ""):
        files = spark.createDataFrame(sorted(PROJECT.items()), "path string, content string")
        if d:
            files = files.unionByName(table(spark, d, "source_files").select("path", "content"))
            files = files.filter("path IS NOT NULL").groupBy("path").agg(F.max("content").alias("content"))
        parsed = cut(S.parse(files))
        self.t = {tag: S.records(parsed, tag) for tag in S.SCHEMAS}
        self.sources = files.select("path")
        members = D.lombok_members(self.t["entity"], self.t["field"], self.t["annotation"])
        self.annotations = self.t["annotation"]
        self.entities = cut(self.t["entity"].unionByName(members, allowMissingColumns=True))
        self.beans = cut(D.beans(self.entities, self.annotations))


def resolver_modules(spark: SparkSession, d: str) -> DataFrame:
    p = Project(spark, d)
    return D.in_module(p.sources, p.t["module"])


def resolver_dependencies(spark: SparkSession, d: str) -> DataFrame:
    p = Project(spark, d)
    return D.module_dependencies(p.t["module"], p.t["dependency"])


def resolver_beans(spark: SparkSession, d: str) -> DataFrame:
    return Project(spark, d).beans.select("id", "name", "stereotype", "bean_type")


def resolver_injections(spark: SparkSession, d: str) -> DataFrame:
    p = Project(spark, d)
    points = D.injection_points(p.entities, p.annotations, p.t["field"], p.beans)
    return D.injections(points, p.beans, D.supertypes(p.entities)).select("bean", "type", "via", "multiplicity", "target", "reason")


def resolver_bindings(spark: SparkSession, d: str) -> DataFrame:
    p = Project(spark, d)
    bound = D.bound_properties(p.annotations, p.t["field"], p.t["config_property"], p.beans)
    return bound.join(p.t["config_property"].select(F.col("id").alias("property"), "key"), "property").select("bean", "key")


def resolver_persistence(spark: SparkSession, d: str) -> DataFrame:
    p = Project(spark, d)
    repos, persistent = D.repositories(p.t["type_binding"], p.annotations), D.persistent_types(p.entities, p.annotations)
    a = D.manages(repos, persistent).select(F.col("repository").alias("src"), F.lit("MANAGES").alias("type"), F.col("entity").alias("dst"))
    b = D.persists_as(persistent, p.t["db_table"]).select(F.col("entity").alias("src"), F.lit("PERSISTS_AS").alias("type"), F.col("table_qn").alias("dst"))
    c = D.relates_to(persistent, p.t["field"], p.annotations, p.entities).select(F.col("entity").alias("src"), F.lit("RELATES_TO").alias("type"), F.col("target").alias("dst"))
    return a.unionByName(b).unionByName(c)


def resolver_endpoints(spark: SparkSession, d: str) -> DataFrame:
    p = Project(spark, d)
    return D.endpoints(p.entities, p.annotations).select("handler", "http_method", "path", "outbound")


def resolver_service_calls(spark: SparkSession, d: str) -> DataFrame:
    p = Project(spark, d)
    e = D.endpoints(p.entities, p.annotations)
    name = e.select("id", "handler")
    calls = D.service_calls(e)
    return calls.join(name.toDF("outbound_id", "caller"), "outbound_id").join(name.toDF("inbound_id", "handler"), "inbound_id").select("caller", "handler")


def resolver_advice(spark: SparkSession, d: str) -> DataFrame:
    p = Project(spark, d)
    hits, _ = D.advises(D.advice(p.annotations), p.entities, p.annotations)
    return hits.select("method")


def resolver_mappers(spark: SparkSession, d: str) -> DataFrame:
    p = Project(spark, d)
    return D.mapped_statements(p.t["sql_statement"], p.entities).select("method")


def resolver_routes(spark: SparkSession, d: str) -> DataFrame:
    p = Project(spark, d)
    return D.route_targets(p.t["route"], p.entities, p.beans).select("index", "target")


def resolver_destinations(spark: SparkSession, d: str) -> DataFrame:
    return D.destinations(Project(spark, d).annotations)


def _publications(p: Project) -> DataFrame:
    return D.publications(p.t["message_site"])


def resolver_publications(spark: SparkSession, d: str) -> DataFrame:
    return _publications(Project(spark, d))


def resolver_parameters(spark: SparkSession, d: str) -> DataFrame:
    """What fills the parameters of endpoints' handlers, and what handlers of exceptions take."""
    p = Project(spark, d)
    bound = D.parameter_bindings(p.annotations, p.entities).select("handler", "kind", "name")
    return bound.unionByName(D.exception_handlers(p.annotations).select("handler", F.lit("exception").alias("kind"), F.col("exception").alias("name")))


def resolver_statements(spark: SparkSession, d: str) -> DataFrame:
    """Tables that SQL in annotations reads and writes."""
    p = Project(spark, d)
    rows = cut(D.annotated_statements(p.annotations, p.entities))
    return table_mentions(rows, "statement", "text").join(rows.select("statement", "method"), "statement").select("method", "name", "mode")


def _invoked(p: Project) -> DataFrame:
    ids = p.t["route"].select(F.col("id").alias("_id"), F.coalesce("route_id", "id").alias("_route"))
    steps = D.route_targets(p.t["route"], p.entities, p.beans).withColumnRenamed("route", "_id").join(ids, "_id").select("target", F.col("_route").alias("route"))
    return steps.unionByName(D.consumed_routes(p.annotations, p.entities).select("target", F.col("route_id").alias("route"))).distinct()


def resolver_architecture(spark: SparkSession, d: str) -> DataFrame:
    p = Project(spark, d)
    ends = D.endpoints(p.entities, p.annotations)
    return A.architecture(p.beans, ends, p.t["route"], A.listeners(p.annotations, p.entities), D.behaviours(p.annotations), p.entities, D.in_module(p.sources, p.t["module"]), p.t["module"])


def resolver_surroundings(spark: SparkSession, d: str) -> DataFrame:
    """Everything around every bean."""
    p = Project(spark, d)
    injected = cut(D.injections(D.injection_points(p.entities, p.annotations, p.t["field"], p.beans), p.beans, D.supertypes(p.entities)))
    bound = D.bound_properties(p.annotations, p.t["field"], p.t["config_property"], p.beans)
    ends = D.endpoints(p.entities, p.annotations)
    calls = ends.filter("outbound").select(F.col("handler").alias("caller"), F.concat_ws(" ", "http_method", "path").alias("service"))
    return A.bean_surroundings(p.beans, injected, bound, _publications(p), A.listeners(p.annotations, p.entities), calls, _invoked(p), D.behaviours(p.annotations), p.entities)


QUERIES = {
    f.__name__: f
    for f in (parsed_counts, parsed_entities, parsed_columns, parsed_xml_beans, parsed_sections, streaming_upsert, stream_activity, resolver_modules, resolver_dependencies, resolver_beans, resolver_injections,
              resolver_bindings, resolver_persistence, resolver_endpoints, resolver_service_calls, resolver_advice, resolver_mappers, resolver_routes, resolver_destinations, resolver_publications, resolver_parameters,
              resolver_statements, resolver_architecture, resolver_surroundings)
}
ORACLE = {"stream_activity": "SELECT user_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS accesses FROM events GROUP BY 1, 2"}
