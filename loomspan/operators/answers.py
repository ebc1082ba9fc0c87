"""Answers over the knowledge base: search with variants, filters and reranking; outlines; what surrounds a bean
or a module. Embedders, rewriters and scorers are callables that the caller gives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.common import cut
from loomspan.operators import derive as D
from loomspan.operators import retrieval as R

Embedder = Callable[[list[str]], list]
Rewriter = Callable[[str], list[str]]
MOST_CANDIDATES = 1000


def asked_variants(query: str, rewrite: Rewriter | None = None, most: int = 3) -> list[str]:
    """The query and its rewritings, in order and without repeats. Without a rewriter only the query; one that
    fails or says nothing leaves the query."""
    try:
        more = list(rewrite(query)) if rewrite else []
    except Exception:  # noqa: BLE001 - a rewriter may be a service that is down
        more = []
    return R.normal_variants([query, *(v for v in more if isinstance(v, str))], most)


def prose_document() -> Column:
    """What a scorer reads of a chunk."""
    return F.concat(F.coalesce("breadcrumb", F.lit("")), F.lit("\n\n"), F.coalesce("text", F.lit("")))


def joined_document(*columns: str) -> Column:
    """What a scorer reads of code (name, signature, docstring) or of a policy (name, guideline)."""
    return F.concat_ws(" ", *(F.when(F.col(c) != "", F.col(c)) for c in columns))


def search(
    rows: DataFrame, key: str, text: str, embedding: str, query: str, embed: Embedder, *, k: int = 5, rewrite: Rewriter | None = None, keep: Column | None = None,
    allowed: DataFrame | None = None, scorer: Callable[[Column], Column] | None = None, document: Column | None = None, copies: bool = False,
) -> DataFrame:
    """(key, score, and with a scorer rerank_score and position): the k best rows for a query and its variants.

    keep: a filter behind the vector's cut to candidates, as for a source or its type. allowed (key): rows
    that may be found at all, filtered before any cut; then as many candidates are taken as there are
    allowed rows and 4 * k more, MOST_CANDIDATES at most; none allowed, none found. A scorer orders the
    candidates anew by a document; their score stays.
    """
    n = k * R.CANDIDATES
    if allowed is not None:
        allowed = allowed.select(key).distinct()
        n = min(allowed.count() + n, MOST_CANDIDATES)
        rows = rows.join(allowed, key, "left_semi")
    variants = asked_variants(query, rewrite)
    vectors = embed(variants)
    each = [R.hybrid(rows, key, text, embedding, v, [float(x) for x in vector], max(1, n // R.CANDIDATES), keep, keep is None, copies, whole=True) for v, vector in zip(variants, vectors, strict=True)]
    found = R.fold_variants(each, key)
    if scorer is None:
        return R.top_k(found, k, key)
    best = cut(R.top_k(found, n, key))
    texts = rows.join(F.broadcast(best.select(key)), key, "left_semi").groupBy(key).agg(F.max(document).alias("_document"))  # n keys at most
    return R.rerank(best.join(texts, key), key, F.col("_document"), scorer).filter(F.col("position") <= k).drop("_document")


def in_named_module(rows: DataFrame, placed: DataFrame, modules: DataFrame, path: str, module: str | None = None) -> DataFrame:
    """rows with the artifact and folder of their file's module (`unassigned` where it has none), of one module
    if named, by artifact or by the end of its folder. placed: (path, module) of in_module()."""
    named = modules.select(F.col("path").alias("module_path"), F.coalesce("artifact_id", "path").alias("module"))
    out = rows.join(placed.select(F.col("path").alias(path), F.col("module").alias("module_path")), path, "left").join(named, "module_path", "left")
    out = out.withColumn("module", F.coalesce("module", F.lit("unassigned")))
    return out.filter((F.col("module") == module) | F.coalesce(F.col("module_path").endswith("/" + module), F.lit(False))) if module else out


def architecture(beans: DataFrame, endpoints: DataFrame, routes: DataFrame, listeners: DataFrame, behaviours: DataFrame, entities: DataFrame, placed: DataFrame, modules: DataFrame, module: str | None = None) -> DataFrame:
    """module, category (bean, endpoint, route, listener, scheduled) and item, each once: a row per item, as a
    module may have any number. listeners: (name, consumer)."""
    files = entities.select(F.col("qualified_name").alias("_qn"), "file_path").filter("file_path IS NOT NULL").distinct()

    def of_code(rows: DataFrame, owner: str, category: str, item: Column) -> DataFrame:
        return rows.join(files, F.col(owner) == F.col("_qn"), "left").select("file_path", F.lit(category).alias("category"), item.alias("item"))

    parts = [
        of_code(beans, "code_qn", "bean", F.concat("name", F.lit(" ["), F.coalesce("stereotype", F.lit("?")), F.lit("]"))),
        of_code(endpoints.filter("NOT outbound"), "handler", "endpoint", F.concat_ws(" ", "http_method", F.col("path"))),
        routes.select("file_path", F.lit("route").alias("category"), F.concat(F.coalesce("route_id", "id"), F.lit(": "), F.coalesce("from_uri", F.lit(""))).alias("item")),
        of_code(listeners, "consumer", "listener", F.concat("consumer", F.lit(" <- "), F.col("name"))),
        of_code(behaviours.filter(F.array_contains("behaviours", "scheduled")), "owner", "scheduled", F.col("owner")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return in_named_module(rows.filter("item IS NOT NULL"), placed, modules, "file_path", module).select("module", "category", "item").distinct()


def bean_surroundings(beans: DataFrame, injected: DataFrame, bound: DataFrame, publications: DataFrame, consumed: DataFrame, calls: DataFrame, invoked: DataFrame, behaviours: DataFrame, entities: DataFrame, key: str | None = None) -> DataFrame:
    """bean, relation and other, each once: what a bean injects, is injected into, produces, was produced by and
    binds, and what its class and members publish, listen_to, call, are invoked by and behave as. A row
    each, so no list is without bound. key: one bean, by id or by its code. consumed: (name, consumer);
    calls: (caller, service); invoked: (target, route)."""
    own = beans.filter((F.col("id") == key) | (F.col("code_qn") == key)) if key else beans
    ids = own.select("id")
    rel = lambda rows, bean, name, other: rows.select(F.col(bean).alias("bean"), F.lit(name).alias("relation"), F.col(other).alias("other"))
    edges = injected.filter("target IS NOT NULL").select(F.col("bean").alias("_from"), F.col("target").alias("_to"))
    made = beans.filter("factory IS NOT NULL").select(F.col("factory").alias("_from"), F.col("id").alias("_to"))
    direct = rel(edges, "_from", "injects", "_to").unionByName(rel(edges, "_to", "injected_by", "_from")).unionByName(rel(made, "_from", "produces", "_to")).unionByName(rel(made, "_to", "produced_by", "_from")).unionByName(rel(bound, "bean", "binds", "property"))
    code = own.select("id", F.col("code_qn").alias("member"))
    code = code.unionByName(code.join(entities.select(F.col("parent_qualified_name").alias("member"), F.col("qualified_name").alias("_inner")), "member").select("id", F.col("_inner").alias("member")))
    of_code = lambda rows, member, name, other: rel(rows.join(code, F.col(member) == code["member"]).withColumn("_other", F.col(other)), "id", name, "_other")
    around = (
        of_code(publications.withColumnRenamed("member", "publisher"), "publisher", "publishes", "name")
        .unionByName(of_code(consumed, "consumer", "listens_to", "name"))
        .unionByName(of_code(calls, "caller", "calls_services", "service"))
        .unionByName(of_code(invoked, "target", "invoked_by_routes", "route"))
        .unionByName(of_code(behaviours.withColumn("marker", F.explode("behaviours")), "owner", "behaves", "marker"))
    )
    return direct.join(ids.withColumnRenamed("id", "bean"), "bean", "left_semi").unionByName(around).filter("other IS NOT NULL").distinct()


def outline(sections: DataFrame, tree: DataFrame) -> DataFrame:
    """source_path, id, title, depth, parent_id and place: the contents of every source. Sorting a source by place
    puts each section behind the one it belongs to. tree: hierarchy() of the sections."""
    at = tree.select(F.col("node_key").alias("id"), "depth", F.array_join("path", " / ").alias("place"))
    return sections.join(at, "id").select(F.regexp_extract("id", "^(.*)::s[0-9]+$", 1).alias("source_path"), "id", "title", "depth", "parent_id", "place")


def listeners(annotations: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, consumer) of events and destinations."""
    events = D.event_listeners(entities, annotations).select(F.col("event").alias("name"), "consumer")
    return events.unionByName(D.destinations(annotations).select("name", "consumer")).distinct()
