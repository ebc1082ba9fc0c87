"""Queries of retrieval over chunks, sections and documents, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.common import WHITE, cut, table
from loomspan.functions import text as T
from loomspan.operators import lookup as L
from loomspan.operators import retrieval as R
from loomspan.operators import store as S
from loomspan.sources import sqlscan

QUERY = "which service keeps the lookup tables in memory"
VARIANTS = ("which service keeps the lookup tables in memory", "the report calls a rename", "compare the build reports")
TOP = 10


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """The rows with an id; several may share one, and then are copies."""
    return table(spark, d, "chunks").filter("id IS NOT NULL")


def _once(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per chunk id of the columns asked for, so that no more is shuffled."""
    return rows.groupBy("id").agg(*(F.max(c).alias(c) for c in columns))


def _vector(spark: SparkSession, d: str, vec_id: int = 7) -> DataFrame:
    return table(spark, d, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding")


def _finish(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return _finish(R.top_k(R.vector_scores(_chunks(spark, d), "id", "embedding", _vector(spark, d), copies=True), TOP, "id"))


def fulltext_topk(spark: SparkSession, d: str) -> DataFrame:
    return _finish(R.top_k(R.bm25(_chunks(spark, d), "id", "text", QUERY, copies=True), TOP, "id"))


def fulltext_scores(spark: SparkSession, d: str) -> DataFrame:
    return _finish(R.bm25(table(spark, d, "documents"), "doc_id", "text", "heartbeats checked again"))


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return _finish(R.hybrid(_chunks(spark, d), "id", "text", "embedding", QUERY, _vector(spark, d), TOP, copies=True))


def _in_docs():
    return F.col("section_id").contains("/docs/")


def hybrid_search_filtered_pre(spark: SparkSession, d: str) -> DataFrame:
    return _finish(R.hybrid(_chunks(spark, d), "id", "text", "embedding", QUERY, _vector(spark, d), TOP, _in_docs(), copies=True))


def hybrid_search_filtered_post(spark: SparkSession, d: str) -> DataFrame:
    return _finish(R.hybrid(_chunks(spark, d), "id", "text", "embedding", QUERY, _vector(spark, d), TOP, _in_docs(), filter_first=False, copies=True))


def hybrid_multi_variant(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d)
    each = [R.hybrid(rows, "id", "text", "embedding", q, _vector(spark, d, 7 + i), TOP, copies=True) for i, q in enumerate(VARIANTS)]
    return _finish(R.top_k(R.fold_variants(each, "id"), TOP, "id"))


def hybrid_rerank_length(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d)
    best = cut(R.hybrid(rows, "id", "text", "embedding", QUERY, _vector(spark, d), TOP, copies=True))
    found = best.join(_once(rows.join(F.broadcast(best.select("id")), "id", "left_semi"), "text"), "id")  # TOP ids at most
    return _finish(R.rerank(found, "id", F.col("text"), F.length)).select("id", "score", F.col("rerank_score").cast("long").alias("rerank_score"), "position")


def minmax_by_source(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", F.col("n_chars").cast("double").alias("score"))
    known = docs.filter("score IS NOT NULL").withColumn("source", F.coalesce("source", F.lit("")))
    return R.min_max(known, "score", ["source"]).select("doc_id", F.round("score", 6).alias("scaled"))


def escaped_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").select("file_id", T.escape_query(F.col("path")).alias("escaped"))


def glob_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").filter(T.matches_glob(F.col("path"), "src/*/??*a*.py$")).select("path")


def query_expansions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "source_files").select("file_id", F.translate(F.regexp_replace("path", r"\.[a-z]+$", ""), "/-_", "   ").alias("query"))
    return R.expanded(rows, "query").select("file_id", "variant")


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    parts = T.word_chunks(table(spark, d, "documents"), "text", ["doc_id"])
    return parts.select("doc_id", "chunk_order", "token_count", F.sha2("chunk_text", 256).alias("content_hash"))


def chunk_next(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_extract("section_id", "^(.*)::s[0-9]+$", 1)
    rows = _once(_chunks(spark, d), "section_id", "chunk_order").withColumn("path", path)
    return S.next_in_order(rows, "path", ["section_id", "chunk_order"], "id")


def _sections(spark: SparkSession, d: str) -> DataFrame:
    from loomspan.common import current_rows

    return current_rows(table(spark, d, "sections"), "id", "title", "level", "breadcrumb", "section_order", "parent_id").filter("live")


def section_text(spark: SparkSession, d: str, most: int = 8000) -> DataFrame:
    """Sections with their whole text, cut to `most` characters, and how many children they have."""
    sections = _sections(spark, d)
    texts = L.section_texts(_once(_chunks(spark, d), "section_id", "chunk_order", "text"), most)
    children = sections.filter("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    return (
        sections.join(texts.withColumnRenamed("section_id", "id"), "id", "left")
        .join(children, "id", "left")
        .select("id", "title", F.md5(F.coalesce("text", F.lit(""))).alias("text_hash"), F.coalesce("truncated", F.lit(False)).alias("truncated"), F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"))
    )


def citations(spark: SparkSession, d: str) -> DataFrame:
    crumbs = table(spark, d, "sections").filter("id IS NOT NULL").groupBy(F.col("id").alias("section_id")).agg(F.max("breadcrumb").alias("breadcrumb"))
    path = F.regexp_extract("section_id", "^(.*)::s[0-9]+$", 1)
    rows = _once(_chunks(spark, d), "section_id", "start_page", "end_page").join(crumbs, "section_id")
    return rows.select("id", T.citation(path, F.col("breadcrumb"), F.col("start_page"), F.col("end_page")).alias("citation"))


def source_list(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sources").groupBy("path").agg(F.max_by("content_hash", F.struct("ingested_at", "content_hash")).alias("content_hash"), F.max("ingested_at").alias("ingested_at"))
    return rows.select("path", "content_hash", F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss").alias("ingested_at"))


def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """One row per document with a text: its class and the number of copies."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("h"))
    classes = docs.groupBy("h").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_copies")).filter("n_copies > 1")
    return docs.join(classes, "h").select("doc_id", "class_id", "n_copies")


def eval_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Every fiftieth vector as a case: rank of the first of its label among the ten nearest others."""
    e = table(spark, d, "embeddings")
    cases = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("case_id"), F.col("embedding").alias("q"), F.col("label").alias("wanted"))
    ranked = R.by_cases(e, cases, 10, "vec_id", "embedding", "q").withColumnRenamed("vec_id", "id")
    labels = e.select(F.col("vec_id").alias("id"), "label")
    hits = ranked.join(labels, "id").join(cases.select("case_id", "wanted"), "case_id").filter("label = wanted").select("case_id", "id")
    found = R.first_hits(ranked, hits, cases.select("case_id", F.lit(True).alias("expect_match")))
    return found.withColumn("first_rank", F.coalesce("first_rank", F.lit(0)))  # 0: none


def sql_table_scan(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "source_files").filter(F.col("path").endswith(".sql"))
    return sqlscan.table_mentions(files, "file_id", "content")


def redacted_props(spark: SparkSession, d: str) -> DataFrame:
    """Values of event properties, keys that name secrets redacted."""
    props = table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return props.select("event_id", "key", T.redacted(F.concat(F.lit("app."), F.col("key")), F.col("value")).alias("shown"))


QUERIES = {
    f.__name__: f
    for f in (vector_topk, fulltext_topk, fulltext_scores, hybrid_search, hybrid_search_filtered_pre, hybrid_search_filtered_post, hybrid_multi_variant, hybrid_rerank_length, minmax_by_source,
              escaped_titles, glob_paths, query_expansions, chunk_documents, chunk_next, section_text, citations, source_list, exact_duplicates, eval_ranks, sql_table_scan, redacted_props)
}

_C = "chunk AS (SELECT id, max(section_id) AS section_id, max(chunk_order) AS chunk_order, max(text) AS text, max(embedding) AS embedding, max(start_page) AS start_page, max(end_page) AS end_page FROM chunks WHERE id IS NOT NULL GROUP BY id)"
_S = """section AS (SELECT id, r.title, r.breadcrumb, r.parent_id FROM (SELECT id, arg_max(struct_pack(title := title, breadcrumb := breadcrumb, parent_id := parent_id, gone := deleted_at IS NOT NULL), ingested_at) AS r
FROM sections WHERE id IS NOT NULL GROUP BY id) WHERE NOT r.gone)"""
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


def _vec(name: str, source: str, vec_id: int, where: str = "true") -> str:
    ok = "len(e.embedding) = 64 AND len(list_filter(e.embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e.embedding, lambda x: x <> 0)) > 0"
    return f"""{name} AS (SELECT e.id, round((1 + {_DOT.format("e.embedding", "q.embedding")} / sqrt({_DOT.format("e.embedding", "e.embedding")} * {_DOT.format("q.embedding", "q.embedding")})) / 2, 9) AS score
FROM (SELECT * FROM {source} WHERE {where}) e, (SELECT embedding FROM embeddings WHERE vec_id = {vec_id}) q WHERE {ok})"""


def _bm25(name: str, source: str, key: str, query: str, text: str = "text") -> str:
    terms = sorted(set(query.split()))
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(CASE WHEN tf{i} > 0 THEN 1 END) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"CASE WHEN tf{i} > 0 THEN ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} / (tf{i} + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) ELSE 0 END" for i in range(len(terms)))
    return f"""{name}_t AS (SELECT {key}, len(t) AS dl, {tf} FROM (SELECT {key}, regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}_]+') AS t FROM {source})),
{name}_s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM {name}_t),
{name} AS (SELECT * FROM (SELECT {key}, round({score}, 9) AS score FROM {name}_t, {name}_s) WHERE score > 0)"""


def _fused(tag: str, query: str, vec_id: int, pre: str = "true", post: str = "true") -> str:
    n = TOP * R.CANDIDATES
    keep = f"id IN (SELECT id FROM chunk WHERE {pre} AND {post})"
    scale = lambda s: f"CASE WHEN max(score) OVER () = min(score) OVER () THEN 1.0 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS {s}"
    return f"""{_vec(f"va{tag}", "chunk", vec_id, pre)}, {_bm25(f"ta{tag}", "chunk", "id", query)},
v{tag} AS (SELECT id, {scale("v")} FROM (SELECT * FROM (SELECT * FROM va{tag} ORDER BY score DESC, id LIMIT {n}) WHERE {keep})),
t{tag} AS (SELECT id, {scale("t")} FROM (SELECT * FROM ta{tag} WHERE {keep} ORDER BY score DESC, id LIMIT {n})),
f{tag} AS (SELECT id, round(0.7 * v + 0.3 * coalesce(t, 0.0), 9) AS score FROM v{tag} LEFT JOIN t{tag} USING (id) ORDER BY 2 DESC, id LIMIT {TOP})"""


_WS = f"list_filter(string_split_regex(coalesce(text, ''), '{WHITE}'), lambda w: w <> '')"
_SYN = ", ".join(f"('{k}', '{v}')" for k, v in R.SYNONYMS.items())
# Comments and literals in one pass, whichever opens first, as a lexer reads them.
_NOISE = r"regexp_replace(content, '/\*.*?\*/|''(?:''''|[^''])*''|--[^\n]*', ' ', 'gs')"
_LAST = "list_transform({0}, lambda x: regexp_extract(x, '[^.]*$'))"
_SECRET = " OR ".join(f"contains(lower('app.' || key), '{m}')" for m in T.SECRET_MARKERS)
ORACLE = {
    "vector_topk": f"WITH {_C}, {_vec('v', 'chunk', 7)} SELECT id, round(score, 6) AS score FROM v ORDER BY v.score DESC, id LIMIT {TOP}",
    "fulltext_topk": f"WITH {_C}, {_bm25('t', 'chunk', 'id', QUERY)} SELECT id, round(score, 6) AS score FROM t ORDER BY t.score DESC, id LIMIT {TOP}",
    "fulltext_scores": f"WITH {_bm25('t', 'documents', 'doc_id', 'heartbeats checked again')} SELECT doc_id, round(score, 6) AS score FROM t",
    "hybrid_search": f"WITH {_C}, {_fused('1', QUERY, 7)} SELECT id, round(score, 6) AS score FROM f1",
    "hybrid_search_filtered_pre": f"WITH {_C}, {_fused('1', QUERY, 7, pre=chr(39).join(['contains(section_id, ', '/docs/', ')']))} SELECT id, round(score, 6) AS score FROM f1",
    "hybrid_search_filtered_post": f"WITH {_C}, {_fused('1', QUERY, 7, post=chr(39).join(['contains(section_id, ', '/docs/', ')']))} SELECT id, round(score, 6) AS score FROM f1",
    "hybrid_multi_variant": f"WITH {_C}, {', '.join(_fused(str(i), q, 7 + i) for i, q in enumerate(VARIANTS))} SELECT id, round(max(score), 6) AS score FROM (SELECT * FROM f0 UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2) GROUP BY id ORDER BY max(score) DESC, id LIMIT {TOP}",
    "hybrid_rerank_length": f"WITH {_C}, {_fused('1', QUERY, 7)} SELECT id, round(score, 6) AS score, length(text) AS rerank_score, CAST(row_number() OVER (ORDER BY length(text) DESC, score DESC, id) AS INTEGER) AS position FROM f1 JOIN chunk USING (id)",
    "minmax_by_source": """SELECT doc_id, round(CASE WHEN hi = lo THEN 1.0 ELSE (n - lo) / (hi - lo) END, 6) AS scaled FROM (SELECT doc_id, CAST(n_chars AS DOUBLE) AS n, min(CAST(n_chars AS DOUBLE)) OVER w AS lo,
max(CAST(n_chars AS DOUBLE)) OVER w AS hi FROM documents WHERE n_chars IS NOT NULL WINDOW w AS (PARTITION BY source))""",
    "escaped_titles": r"""SELECT file_id, regexp_replace(path, '([+\-!(){}\[\]^"~*?:\\/&|])', '\\\1', 'g') AS escaped FROM source_files""",
    "glob_paths": r"SELECT path FROM source_files WHERE regexp_matches(path, 'src/.*/..*.*a.*\.py$') AND regexp_matches(path, 'src/.*/...*a.*\.py$')",
    "query_expansions": f"""WITH q AS (SELECT file_id, translate(regexp_replace(path, '\\.[a-z]+$', ''), '/-_', '   ') AS query FROM source_files), s(term, repl) AS (VALUES {_SYN})
SELECT file_id, regexp_replace(query, '\\b' || term || '\\b', repl, 'gi') AS variant FROM q, s WHERE list_contains(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+'), term)""",
    "chunk_documents": f"""WITH w AS (SELECT doc_id, {_WS} AS ws FROM documents), p AS (SELECT doc_id, ws, unnest(range(0, 1 + greatest(0, CAST(ceil((len(ws) - 400) / 340.0) AS BIGINT)))) AS i FROM w WHERE len(ws) > 0)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_order, CAST(len(ws[340 * i + 1 : 340 * i + 400]) AS INTEGER) AS token_count, sha256(array_to_string(ws[340 * i + 1 : 340 * i + 400], ' ')) AS content_hash FROM p""",
    "chunk_next": f"""WITH {_C} SELECT * FROM (SELECT id, lead(id) OVER (PARTITION BY regexp_extract(section_id, '^(.*)::s[0-9]+$', 1) ORDER BY section_id, chunk_order, id) AS next_id FROM chunk) WHERE next_id IS NOT NULL""",
    "section_text": f"""WITH {_C}, {_S}, t AS (SELECT section_id, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY chunk_order NULLS FIRST, id) AS txt FROM chunk GROUP BY 1),
k AS (SELECT parent_id, count(*) AS n FROM section WHERE parent_id IS NOT NULL GROUP BY 1)
SELECT s.id, s.title, md5(substring(coalesce(t.txt, ''), 1, 8000)) AS text_hash, length(coalesce(t.txt, '')) > 8000 AS truncated, coalesce(k.n, 0) AS n_children
FROM section s LEFT JOIN t ON t.section_id = s.id LEFT JOIN k ON k.parent_id = s.id""",
    "citations": f"""WITH {_C}, b AS (SELECT id, max(breadcrumb) AS breadcrumb FROM sections WHERE id IS NOT NULL GROUP BY id)
SELECT c.id, regexp_extract(c.section_id, '^(.*)::s[0-9]+$', 1) || ' — ' || coalesce(b.breadcrumb, '') || CASE WHEN start_page IS NULL THEN '' WHEN end_page IS NULL OR start_page = end_page THEN ' (p. ' || start_page || ')'
ELSE ' (pp. ' || start_page || '–' || end_page || ')' END AS citation FROM chunk c JOIN b ON b.id = c.section_id""",
    "source_list": """SELECT path, arg_max(content_hash, (ingested_at, content_hash)) AS content_hash, strftime(max(ingested_at) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS ingested_at FROM sources GROUP BY path""",
    "exact_duplicates": """SELECT doc_id, class_id, n_copies FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id, count(*) OVER (PARTITION BY text) AS n_copies FROM documents WHERE text IS NOT NULL) WHERE n_copies > 1""",
    "eval_ranks": f"""WITH s AS (SELECT q.vec_id AS case_id, e.vec_id AS id, e.label = q.label AS hit, round((1 + {_DOT.format("e.embedding", "q.embedding")} / sqrt({_DOT.format("e.embedding", "e.embedding")} * {_DOT.format("q.embedding", "q.embedding")})) / 2, 9) AS score
FROM embeddings e JOIN embeddings q ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, id) AS rank FROM s)
SELECT c.vec_id AS case_id, CAST(coalesce(min(rank), 0) AS INTEGER) AS first_rank, min(rank) IS NOT NULL AS passed FROM (SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0) c LEFT JOIN r ON r.case_id = c.vec_id AND rank <= 10 AND hit GROUP BY 1""",
    "sql_table_scan": f"""WITH b AS (SELECT file_id, {_NOISE} AS sql FROM source_files WHERE path LIKE '%.sql'),
t AS (SELECT file_id, {_LAST.format("regexp_extract_all(sql, '(?i)" + chr(92) + "b(?:insert" + chr(92) + "s+into|update|delete" + chr(92) + "s+from|merge" + chr(92) + "s+into)" + chr(92) + "s+([A-Za-z_][" + chr(92) + "w.$]*)', 1)")} AS w,
{_LAST.format("regexp_extract_all(sql, '(?i)" + chr(92) + "b(?:from|join)" + chr(92) + "s+([A-Za-z_][" + chr(92) + "w.$]*)', 1)")} AS r FROM b)
SELECT DISTINCT file_id, unnest(w) AS name, 'write' AS mode FROM t UNION SELECT DISTINCT file_id, unnest(list_filter(r, lambda x: NOT list_contains(w, x))), 'read' FROM t""",
    "redacted_props": f"""WITH p AS (SELECT event_id, unnest(json_keys(props)) AS key, props FROM events)
SELECT event_id, key, CASE WHEN list_contains(string_split('app.' || lower(key), '.'), 'key') OR {_SECRET} THEN '***' ELSE json_extract_string(props, '$."' || key || '"') END AS shown FROM p""",
}
