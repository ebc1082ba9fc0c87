"""Queries of the store, the graph and agent memory, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.common import current_rows, cut, table
from loomspan.functions.embed import hashing_embedder
from loomspan.operators import answers as A
from loomspan.operators import graph as G
from loomspan.operators import hierarchy as H
from loomspan.operators import memory as M
from loomspan.operators import retrieval as R
from loomspan.operators import store as S
from loomspan.operators.orphan_refs import folded_name
from loomspan.plans import lineage as L
from loomspan.plans.retrieval import _bm25

NOW = "2024-02-15 12:00:00"
RECALLED = "the report of the service"


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return current_rows(table(spark, d, "code_entities"), "qualified_name", "name", "kind", "language", "file_path", "start_line", "end_line", "docstring", "parent_qualified_name", "calls").filter("live")


def _tables(spark: SparkSession, d: str) -> DataFrame:
    return current_rows(table(spark, d, "db_tables"), "qualified_name", "name", "file_path", "ref_tables").filter("live")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """type, src, dst over code entities and database tables."""
    e, t = _entities(spark, d), _tables(spark, d)
    rows = lambda df, kind, src, dst: df.select(F.lit(kind).alias("type"), src.alias("src"), dst.alias("dst")).filter("src IS NOT NULL AND dst IS NOT NULL AND trim(dst) <> ''")
    return (
        rows(e, "DEFINES", F.col("file_path"), F.col("qualified_name"))
        .unionByName(rows(e, "CONTAINS", F.col("parent_qualified_name"), F.col("qualified_name")))
        .unionByName(rows(e.withColumn("call", F.explode("calls")), "CALLS", F.col("qualified_name"), F.col("call")))
        .unionByName(rows(t.withColumn("ref", F.explode("ref_tables")), "REFERENCES", F.col("qualified_name"), folded_name(F.col("ref"))))
        .distinct()
    )


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    e = _entities(spark, d).select(F.lit("CodeEntity").alias("label"), F.col("qualified_name").alias("key"), "name", F.coalesce("docstring", "name").alias("summary"))
    t = _tables(spark, d).select(F.lit("DbTable").alias("label"), F.col("qualified_name").alias("key"), "name", F.col("name").alias("summary"))
    s = table(spark, d, "sources").select(F.lit("Source").alias("label"), F.col("path").alias("key"), F.col("path").alias("name"), F.col("path").alias("summary")).distinct()
    return e.unionByName(t).unionByName(s)


def edge_counts(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def neighbors_both(spark: SparkSession, d: str) -> DataFrame:
    """Of every class: what it is joined to, either way."""
    nodes = _nodes(spark, d)
    asked = _entities(spark, d).filter("lower(trim(kind)) = 'class'").select(F.col("qualified_name").alias("node"))
    return G.neighbours(nodes, _edges(spark, d), asked, ["CONTAINS", "DEFINES"]).withColumn("summary", F.md5("summary"))


def exists_filters(spark: SparkSession, d: str) -> DataFrame:
    """Documented functions of classes that are called by something of their own file."""
    e = _entities(spark, d)
    calls = _edges(spark, d).filter("type = 'CALLS'").select("src", F.col("dst").alias("qualified_name"))
    inner = calls.join(e.select(F.col("qualified_name").alias("src"), F.col("file_path").alias("caller_file")), "src")
    called = e.join(inner, "qualified_name").filter("caller_file = file_path").select("qualified_name")
    classes = e.filter("lower(trim(kind)) = 'class'").select(F.col("qualified_name").alias("parent_qualified_name"))
    return e.filter("docstring <> ''").join(called, "qualified_name", "left_semi").join(classes, "parent_qualified_name", "left_semi").select("qualified_name")


def two_hop(spark: SparkSession, d: str) -> DataFrame:
    """Files and the functions their functions call, with the number of ways."""
    e = _edges(spark, d)
    defined = e.filter("type = 'DEFINES'").select(F.col("src").alias("path"), F.col("dst").alias("via"))
    return defined.join(e.filter("type = 'CALLS'").select(F.col("src").alias("via"), F.col("dst").alias("called")), "via").groupBy("path", "called").agg(F.count(F.lit(1)).alias("ways"))


def varlength_closure(spark: SparkSession, d: str) -> DataFrame:
    """All tables that a table references by any number of steps."""
    return G.closure(_edges(spark, d).filter("type = 'REFERENCES'"))


def pagerank(spark: SparkSession, d: str) -> DataFrame:
    """Centrality over calls, one way, and containment, both ways."""
    return G.pagerank(G.projection(_edges(spark, d), ["CALLS"], ["CONTAINS"])).withColumn("pagerank", F.round("pagerank", 6))


def central_entities(spark: SparkSession, d: str) -> DataFrame:
    ranks = G.pagerank(G.projection(_edges(spark, d), ["CALLS"], [])).withColumn("pagerank", F.round("pagerank", 6))
    named = ranks.join(_entities(spark, d).select(F.col("qualified_name").alias("node"), "name", "kind"), "node").filter("name IS NOT NULL")
    return named.orderBy(F.desc("pagerank"), "node").limit(10)


def architecture_outline(spark: SparkSession, d: str) -> DataFrame:
    """Per repository its classes, modules and tables, a row each: a repository may have any number."""
    of = lambda rows, category: rows.select(F.coalesce(F.split_part("file_path", F.lit("/"), F.lit(1)), F.lit("unassigned")).alias("repository"), category.alias("category"), F.col("name").alias("item"))
    code = of(_entities(spark, d), F.lower(F.trim("kind"))).filter("category IN ('class', 'module')")
    return code.unionByName(of(_tables(spark, d), F.lit("table"))).filter("item IS NOT NULL").distinct()


CODE_QUERY, CODE_TOP = "where is the db config read again", 10


def search_called_code(spark: SparkSession, d: str) -> DataFrame:
    """Code that something calls, by a query whose acronyms are written out in variants."""
    rows = current_rows(table(spark, d, "code_entities"), "qualified_name", "embed_text", "embedding").filter("live")
    called = _edges(spark, d).filter("type = 'CALLS'").select(F.col("dst").alias("qualified_name"))
    found = A.search(rows, "qualified_name", "embed_text", "embedding", CODE_QUERY, hashing_embedder(64), k=CODE_TOP, rewrite=R.query_variants, allowed=rows.select("qualified_name").join(called, "qualified_name", "left_semi"))
    return found.withColumn("score", F.round("score", 6))


def source_outline(spark: SparkSession, d: str) -> DataFrame:
    """The contents of every source: its live sections, each behind the one it belongs to."""
    sections = current_rows(table(spark, d, "sections"), "id", "title", "parent_id").filter("live")
    return A.outline(sections, H.hierarchy(H.live_links(table(spark, d, "sections"), "sections", "id", "parent_id")))


def _takes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The first and the last time each path was taken in."""
    s = table(spark, d, "sources").filter("path IS NOT NULL").groupBy("path")
    row = F.struct("ingested_at", "content_hash", "source_type")
    pick = lambda agg: s.agg(agg(row).alias("r")).select("path", "r.content_hash", "r.source_type")
    return pick(F.min), pick(F.max)


def ingest_skip_unchanged(spark: SparkSession, d: str) -> DataFrame:
    old, new = _takes(spark, d)
    return S.changed(new, old).select("path", "content_hash")


def upsert_sources(spark: SparkSession, d: str) -> DataFrame:
    old, new = _takes(spark, d)
    return S.upsert(old, new.join(S.changed(new, old).select("path"), "path", "left_semi"), ["path"])


def coalesce_upsert(spark: SparkSession, d: str) -> DataFrame:
    old, new = _takes(spark, d)
    return S.coalescing_upsert(old, new.withColumn("source_type", F.when(F.length("path") % 2 == 0, F.col("source_type"))), "path")


def reconcile_stale(spark: SparkSession, d: str) -> DataFrame:
    """Sections of files taken in again that these no longer hold: all keys ever seen against the live ones."""
    path = F.regexp_extract("id", "^(.*)::s[0-9]+$", 1)
    rows = table(spark, d, "sections").filter("id IS NOT NULL").select(path.alias("path"), "id")
    live = current_rows(table(spark, d, "sections"), "id", "title").filter("live").select(path.alias("path"), "id")
    return S.reconcile(rows.distinct(), live, "path", ["id"])


def orphan_sweep(spark: SparkSession, d: str) -> DataFrame:
    return S.orphans(_nodes(spark, d), _edges(spark, d), "key").select("label", "key")


def stub_targets(spark: SparkSession, d: str) -> DataFrame:
    """Tables that others refer to and that don't exist."""
    refs = _edges(spark, d).filter("type = 'REFERENCES'")
    return S.stubs(refs, _tables(spark, d).select(folded_name(F.col("qualified_name")).alias("qualified_name")), "dst", "qualified_name")


def unique_match_or_none(spark: SparkSession, d: str) -> DataFrame:
    """Simple names of entities: the only one that has it, or that several do."""
    e = _entities(spark, d).filter("name IS NOT NULL")
    return S.unique_match(e, "name", "qualified_name")


def fallback_key_match(spark: SparkSession, d: str) -> DataFrame:
    """Table references by full name, else by the only table of that simple name."""
    refs = _edges(spark, d).filter("type = 'REFERENCES'").select(F.when(F.length("dst") % 2 == 0, F.col("dst")).otherwise(F.regexp_extract("dst", "[^.]*$", 0)).alias("ref"))
    return S.fallback_match(refs, _tables(spark, d).select("qualified_name"), "ref", "qualified_name")


def alias_fold_unique(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d).filter("type = 'REFERENCES'").select("src", F.when(F.length("src") % 3 == 0, F.regexp_extract("dst", "[^.]*$", 0)).otherwise(F.col("dst")).alias("dst"))
    return S.fold_aliases(edges, _tables(spark, d).select("qualified_name"), "qualified_name").select("src", "dst")


def nearest_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The innermost folder with two files or more that holds each source file."""
    files = table(spark, d, "source_files").filter("path IS NOT NULL")
    folders = files.groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("module")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("module")
    roots = files.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("module"))
    return S.nearest_prefix(files, folders.unionByName(roots).distinct(), "path", "module")


def interval_enclosing(spark: SparkSession, d: str) -> DataFrame:
    """The innermost class that holds each function's line."""
    e = _entities(spark, d)
    classes = e.filter("lower(trim(kind)) = 'class'").select("file_path", F.col("start_line").alias("s"), F.col("end_line").alias("e"), F.col("qualified_name").alias("class_name"))
    functions = e.filter("lower(trim(kind)) IN ('function', 'method', 'constructor')").select("qualified_name", "file_path", "start_line").filter("start_line IS NOT NULL")
    return S.enclosing(functions, classes, "file_path", "start_line", "s", "e", "class_name").select("qualified_name", "class_name")


def _memories(spark: SparkSession, d: str) -> DataFrame:
    """One memory per user of events."""
    e = table(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("id")).agg(
        F.count(F.lit(1)).alias("access_count"), F.max(F.col("ts").cast("timestamp")).alias("last_accessed_at"), F.min(F.col("ts").cast("timestamp")).alias("created_at"),
        (F.max("value") > 490).alias("importance"), F.expr("CASE WHEN user_id % 7 = 0 THEN max(CAST(ts AS TIMESTAMP)) END").alias("archived_at"),
        F.avg("value").alias("weight"),
    )


def _now():
    return F.lit(NOW).cast("timestamp")


def memory_reinforcement(spark: SparkSession, d: str) -> DataFrame:
    return _memories(spark, d).select("id", F.round(M.reinforcement(F.col("access_count") % 20, F.col("last_accessed_at"), _now()), 6).alias("reinforcement"))


def memory_recall(spark: SparkSession, d: str) -> DataFrame:
    m = _memories(spark, d)
    m = m.withColumn("access_count", F.col("access_count") % 20)
    texts = table(spark, d, "documents").join(m.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")  # a memory's text is the document of its number
    relevance = R.min_max(cut(R.bm25(texts, "doc_id", "text", RECALLED)), "score").select(F.col("doc_id").alias("id"), F.round("score", 6).alias("score"))
    return M.recall(m, relevance, _now(), 20).select("id", F.round("final_score", 6).alias("final_score"))


def memory_prune(spark: SparkSession, d: str) -> DataFrame:
    return M.prune(_memories(spark, d).withColumn("access_count", F.col("access_count") % 5), F.lit("2024-03-15 12:00:00").cast("timestamp"), below=1.2)


def memory_important(spark: SparkSession, d: str) -> DataFrame:
    return M.important(_memories(spark, d)).select("id")


QUERIES = {
    f.__name__: f
    for f in (edge_counts, neighbors_both, exists_filters, two_hop, varlength_closure, pagerank, central_entities, architecture_outline, search_called_code, source_outline, ingest_skip_unchanged, upsert_sources, coalesce_upsert, reconcile_stale,
              orphan_sweep, stub_targets, unique_match_or_none, fallback_key_match, alias_fold_unique, nearest_prefix, interval_enclosing, memory_reinforcement, memory_recall, memory_prune, memory_important)
}

_FOLD = "lower(trim(regexp_replace({0}, '[\"`\\[\\]]', '', 'g')))"
_E = """e AS (SELECT qualified_name, r.* FROM (SELECT qualified_name, arg_max(struct_pack(name := name, kind := kind, file_path := file_path, start_line := start_line, end_line := end_line, docstring := docstring,
parent := parent_qualified_name, calls := calls, gone := deleted_at IS NOT NULL), ingested_at) AS r FROM code_entities WHERE qualified_name IS NOT NULL GROUP BY 1) WHERE NOT r.gone)"""
_T = """t AS (SELECT qualified_name, r.* FROM (SELECT qualified_name, arg_max(struct_pack(name := name, file_path := file_path, refs := ref_tables, gone := deleted_at IS NOT NULL), ingested_at) AS r FROM db_tables
WHERE qualified_name IS NOT NULL GROUP BY 1) WHERE NOT r.gone)"""
_G = f"""{_E}, {_T}, g AS (SELECT DISTINCT * FROM (SELECT 'DEFINES' AS type, file_path AS src, qualified_name AS dst FROM e UNION ALL SELECT 'CONTAINS', parent, qualified_name FROM e
UNION ALL SELECT 'CALLS', qualified_name, unnest(calls) FROM e UNION ALL SELECT 'REFERENCES', qualified_name, {_FOLD.format("x")} FROM (SELECT qualified_name, unnest(refs) AS x FROM t))
WHERE src IS NOT NULL AND dst IS NOT NULL AND trim(dst) <> '')"""
_N = """n AS (SELECT 'CodeEntity' AS label, qualified_name AS key, name, coalesce(docstring, name) AS summary FROM e UNION ALL SELECT 'DbTable', qualified_name, name, name FROM t
UNION ALL SELECT DISTINCT 'Source', path, path, path FROM sources)"""
_TAKES = """o AS (SELECT path, min((ingested_at, content_hash, source_type)) AS r FROM sources WHERE path IS NOT NULL GROUP BY 1),
w AS (SELECT path, max((ingested_at, content_hash, source_type)) AS r FROM sources WHERE path IS NOT NULL GROUP BY 1)"""
_M = """m AS (SELECT user_id AS id, count(*) AS access_count, max(ts) AS last_accessed_at, min(ts) AS created_at, max(value) > 490 AS importance, CASE WHEN user_id % 7 = 0 THEN max(ts) END AS archived_at FROM events GROUP BY user_id)"""
_AGE = "greatest((epoch_us(TIMESTAMP '{1}') - epoch_us({0})) / 86400000000.0, 0.0)"
_REINF = f"least(ln(1 + CAST(access_count % 20 AS DOUBLE)) / ln(11.0), 1.0) * exp(-{_AGE.format('last_accessed_at', NOW)} / 30.0)"


def _pagerank_sql(projected: str, rounds: int = G.ROUNDS) -> str:
    parts = [f"p AS ({projected})", "l AS (SELECT src, dst, count(*) AS w FROM p GROUP BY 1, 2)", "s AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM l)",
             "v AS (SELECT src AS node FROM l UNION SELECT dst FROM l)", "r0 AS (SELECT node, 1 - 0.85 AS pr FROM v)"]
    parts += [
        f"r{i} AS MATERIALIZED (SELECT v.node, (1 - 0.85) + 0.85 * coalesce(x.s, 0.0) AS pr FROM v LEFT JOIN (SELECT s.dst AS node, sum(s.share * r.pr) AS s FROM s JOIN r{i - 1} r ON r.node = s.src GROUP BY 1) x ON x.node = v.node)"
        for i in range(1, rounds + 1)
    ]
    return ", ".join(parts)


def _search_sql() -> str:
    """search_called_code: each variant's halves over the called code, laid between 0 and 1, weighted; the best over variants."""
    variants = A.asked_variants(CODE_QUERY, R.query_variants)
    dot = "list_sum(list_transform(list_zip({0}, {1}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
    ok = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
    parts = [_G, """c AS (SELECT qualified_name, r.* FROM (SELECT qualified_name, arg_max(struct_pack(embed_text := embed_text, embedding := embedding, gone := deleted_at IS NOT NULL), ingested_at) AS r FROM code_entities WHERE qualified_name IS NOT NULL GROUP BY 1)
WHERE NOT r.gone AND qualified_name IN (SELECT dst FROM g WHERE type = 'CALLS'))""", f"n AS (SELECT least(count(*) + {CODE_TOP * R.CANDIDATES}, {A.MOST_CANDIDATES}) // {R.CANDIDATES} * {R.CANDIDATES} AS n FROM c)"]  # fmt: skip
    scale = lambda s: f"CASE WHEN max(score) OVER () = min(score) OVER () THEN 1.0 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS {s}"
    for i, (text, vector) in enumerate(zip(variants, hashing_embedder(64)(variants), strict=True)):
        q = "[" + ", ".join(repr(float(x)) for x in vector) + "]"
        parts += [
            f"va{i} AS (SELECT qualified_name, round((1 + {dot.format('embedding', q)} / sqrt({dot.format('embedding', 'embedding')} * {dot.format(q, q)})) / 2, 9) AS score FROM c WHERE {ok})",
            _bm25(f"ta{i}", "c", "qualified_name", text, "embed_text"),
            f"v{i} AS (SELECT qualified_name, {scale('v')} FROM (SELECT * FROM va{i} ORDER BY score DESC, qualified_name LIMIT (SELECT n FROM n)))",
            f"t{i} AS (SELECT qualified_name, {scale('t')} FROM (SELECT * FROM ta{i} ORDER BY score DESC, qualified_name LIMIT (SELECT n FROM n)))",
            f"f{i} AS (SELECT qualified_name, round(0.7 * v + 0.3 * coalesce(t, 0.0), 9) AS score FROM v{i} LEFT JOIN t{i} USING (qualified_name))",
        ]
    union = " UNION ALL ".join(f"SELECT * FROM f{i}" for i in range(len(variants)))
    return f"WITH {', '.join(parts)} SELECT qualified_name, round(max(score), 6) AS score FROM ({union}) GROUP BY 1 ORDER BY max(score) DESC, qualified_name LIMIT {CODE_TOP}"


ORACLE = {
    "edge_counts": f"WITH {_G} SELECT type, count(*) AS n FROM g GROUP BY 1",
    "neighbors_both": f"""WITH {_G}, {_N}, a AS (SELECT qualified_name AS node FROM e WHERE lower(trim(kind)) = 'class'), f AS (SELECT DISTINCT a.node, n.key AS of FROM a JOIN n ON n.key = a.node OR n.name = a.node),
x AS (SELECT node, type AS rel, 'out' AS direction, dst AS key FROM f JOIN g ON g.src = f.of WHERE type IN ('CONTAINS', 'DEFINES') UNION SELECT node, type, 'in', src FROM f JOIN g ON g.dst = f.of WHERE type IN ('CONTAINS', 'DEFINES'))
SELECT node, rel, direction, label, x.key, md5(substring(summary, 1, 100)) AS summary FROM x LEFT JOIN n ON n.key = x.key""",
    "exists_filters": f"""WITH {_G} SELECT qualified_name FROM e WHERE docstring <> '' AND EXISTS (SELECT 1 FROM g JOIN e c ON c.qualified_name = g.src WHERE g.type = 'CALLS' AND g.dst = e.qualified_name AND c.file_path = e.file_path)
AND EXISTS (SELECT 1 FROM e k WHERE k.qualified_name = e.parent AND lower(trim(k.kind)) = 'class')""",
    "two_hop": f"WITH {_G} SELECT a.src AS path, b.dst AS called, count(*) AS ways FROM g a JOIN g b ON b.src = a.dst AND b.type = 'CALLS' WHERE a.type = 'DEFINES' GROUP BY 1, 2",
    "varlength_closure": f"WITH RECURSIVE {_G}, c AS (SELECT src, dst FROM g WHERE type = 'REFERENCES' UNION SELECT c.src, g.dst FROM c JOIN g ON g.src = c.dst AND g.type = 'REFERENCES') SELECT DISTINCT src, dst FROM c",
    "pagerank": f"WITH {_G}, {_pagerank_sql(chr(10).join(['SELECT src, dst FROM g WHERE type IN (', repr('CALLS') + ', ' + repr('CONTAINS'), ') UNION ALL SELECT dst, src FROM g WHERE type = ' + repr('CONTAINS')]))} SELECT node, round(pr, 6) AS pagerank FROM r20",
    "central_entities": f"WITH {_G}, {_pagerank_sql('SELECT src, dst FROM g WHERE type = ' + repr('CALLS'))} SELECT node, round(pr, 6) AS pagerank, name, kind FROM r20 JOIN e ON e.qualified_name = node WHERE name IS NOT NULL ORDER BY 2 DESC, node LIMIT 10",
    "architecture_outline": f"""WITH {_E}, {_T}, b AS (SELECT file_path, lower(trim(kind)) AS category, name AS item FROM e WHERE lower(trim(kind)) IN ('class', 'module') UNION ALL SELECT file_path, 'table', name FROM t)
SELECT DISTINCT coalesce(split_part(file_path, '/', 1), 'unassigned') AS repository, category, item FROM b WHERE item IS NOT NULL""",
    "search_called_code": _search_sql(),
    "source_outline": f"""WITH RECURSIVE {L._P2_PAIRS}, {L._P2_RING}, title AS (SELECT id, arg_max(title, ingested_at) AS title, arg_max(struct_pack(p := parent_id), ingested_at) AS parent FROM sections WHERE id IS NOT NULL GROUP BY 1),
up AS (SELECT t, d AS k, count(*) AS depth, string_agg(a, ' / ' ORDER BY distance DESC) AS above FROM pairs GROUP BY 1, 2)
SELECT regexp_extract(l.k, '^(.*)::s[0-9]+$', 1) AS source_path, l.k AS id, i.title, CAST(coalesce(u.depth, 0) AS INTEGER) AS depth, i.parent.p AS parent_id, coalesce(u.above || ' / ', '') || l.k AS place
FROM links l JOIN title i ON i.id = l.k LEFT JOIN up u ON u.t = l.t AND u.k = l.k WHERE l.t = 'sections'""",
    "ingest_skip_unchanged": f"WITH {_TAKES} SELECT w.path, w.r[2] AS content_hash FROM w WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.path = w.path AND o.r[2] = w.r[2])",
    "upsert_sources": f"WITH {_TAKES} SELECT w.path, CASE WHEN o.r[2] = w.r[2] THEN o.r[2] ELSE w.r[2] END AS content_hash, CASE WHEN o.r[2] = w.r[2] THEN o.r[3] ELSE w.r[3] END AS source_type FROM w JOIN o USING (path)",
    "coalesce_upsert": f"WITH {_TAKES} SELECT w.path, w.r[2] AS content_hash, coalesce(CASE WHEN length(w.path) % 2 = 0 THEN w.r[3] END, o.r[3]) AS source_type FROM w JOIN o USING (path)",
    "reconcile_stale": """WITH s AS (SELECT id, regexp_extract(id, '^(.*)::s[0-9]+$', 1) AS path, arg_max(deleted_at IS NOT NULL, ingested_at) AS gone FROM sections WHERE id IS NOT NULL GROUP BY 1)
SELECT path, id FROM s WHERE gone AND path IN (SELECT path FROM s WHERE NOT gone)""",
    "orphan_sweep": f"WITH {_G}, {_N} SELECT label, key FROM n WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.src = n.key) AND NOT EXISTS (SELECT 1 FROM g WHERE g.dst = n.key)",
    "stub_targets": f"WITH {_G} SELECT DISTINCT dst AS qualified_name FROM g WHERE type = 'REFERENCES' AND dst NOT IN (SELECT {_FOLD.format('qualified_name')} FROM t)",
    "unique_match_or_none": f"WITH {_E} SELECT name, CASE WHEN count(DISTINCT qualified_name) = 1 THEN min(qualified_name) END AS qualified_name, CASE WHEN count(DISTINCT qualified_name) = 1 THEN 'one' ELSE 'several' END AS matches FROM e WHERE name IS NOT NULL GROUP BY 1",
    "fallback_key_match": f"""WITH {_G}, q AS (SELECT DISTINCT CASE WHEN length(dst) % 2 = 0 THEN dst ELSE regexp_extract(dst, '[^.]*$') END AS ref FROM g WHERE type = 'REFERENCES'),
u AS (SELECT regexp_extract(qualified_name, '[^.]*$') AS simple, min(qualified_name) AS k FROM t GROUP BY 1 HAVING count(DISTINCT qualified_name) = 1)
SELECT q.ref, coalesce(t.qualified_name, u.k) AS qualified_name FROM q LEFT JOIN t ON t.qualified_name = q.ref LEFT JOIN u ON u.simple = regexp_extract(q.ref, '[^.]*$')""",
    "alias_fold_unique": f"""WITH {_G}, q AS (SELECT src, CASE WHEN length(src) % 3 = 0 THEN regexp_extract(dst, '[^.]*$') ELSE dst END AS dst FROM g WHERE type = 'REFERENCES'),
u AS (SELECT regexp_extract(qualified_name, '[^.]*$') AS simple, min(qualified_name) AS k FROM t WHERE contains(qualified_name, '.') GROUP BY 1 HAVING count(DISTINCT qualified_name) = 1)
SELECT DISTINCT q.src, coalesce(u.k, q.dst) AS dst FROM q LEFT JOIN u ON u.simple = q.dst""",
    "nearest_prefix": """WITH m AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS module FROM source_files WHERE path IS NOT NULL GROUP BY 1 HAVING count(*) > 1 UNION SELECT split_part(path, '/', 1) FROM source_files)
SELECT f.path, (SELECT arg_max(module, length(module)) FROM m WHERE f.path = m.module OR starts_with(f.path, m.module || '/')) AS module FROM (SELECT DISTINCT path FROM source_files WHERE path IS NOT NULL) f""",
    "interval_enclosing": f"""WITH {_E}, c AS (SELECT file_path, start_line AS s, end_line AS e, qualified_name AS class_name FROM e WHERE lower(trim(kind)) = 'class' AND start_line IS NOT NULL AND end_line >= start_line)
SELECT f.qualified_name, (SELECT arg_min(c.class_name, (c.e - c.s, -c.s, c.class_name)) FROM c WHERE c.file_path = f.file_path AND f.start_line BETWEEN c.s AND c.e) AS class_name
FROM e f WHERE lower(trim(kind)) IN ('function', 'method', 'constructor') AND start_line IS NOT NULL""",
    "memory_reinforcement": f"WITH {_M} SELECT id, round({_REINF}, 6) AS reinforcement FROM m",
    "memory_recall": f"""WITH {_M}, x AS (SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT id FROM m)), {_bm25("w", "x", "doc_id", RECALLED)},
y AS (SELECT doc_id AS id, round(CASE WHEN max(score) OVER () = min(score) OVER () THEN 1.0 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END, 6) AS rel FROM w),
f AS (SELECT id, round(rel + CASE WHEN importance THEN 0.15 ELSE 0.0 END + 0.15 * {_REINF}, 9) AS s FROM m JOIN y USING (id) WHERE archived_at IS NULL) SELECT id, round(s, 6) AS final_score FROM f ORDER BY s DESC, id LIMIT 20""",
    "memory_prune": f"""WITH {_M}, a AS (SELECT id, CASE WHEN archived_at IS NULL AND NOT importance AND (1 + access_count % 5) * exp(-{_AGE.format("last_accessed_at", "2024-03-15 12:00:00")} / 30.0) < 1.2 THEN 'archive'
WHEN archived_at <= TIMESTAMP '2024-03-15 12:00:00' - INTERVAL 30 DAYS THEN 'delete' END AS action FROM m) SELECT * FROM a WHERE action IS NOT NULL""",
    "memory_important": f"WITH {_M} SELECT id FROM m WHERE archived_at IS NULL AND importance ORDER BY created_at, id",
}
