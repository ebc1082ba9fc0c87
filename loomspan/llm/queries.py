"""Queries of the problems on training data; the SQL beside them where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.common import WHITE, table
from loomspan.llm import doc_pairs, languages, leaks, neighbours, splitting, syntax, tokenizer


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized_pieces(table(spark, d, "chunks"), table(spark, d, "sections"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_pieces(spark, d).select("chunk_id").distinct()


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    return doc_pairs.documented_pairs(*(table(spark, d, t) for t in ("code_entities", "source_files", "sources")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_pairs(spark, d).select("qualified_name")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    of = lambda t, key: table(spark, d, t).select(F.col(key).alias("key"), "embedding")
    return of("chunks", "id").unionByName(of("code_entities", "qualified_name")).unionByName(of("db_tables", "qualified_name"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    vectors = _vectors(spark, d)
    points = neighbours.indexed(vectors)
    return neighbours.close_pairs(vectors, points, neighbours.neighbour_graph(points)).select("key_a", "key_b")


def p5_nearest(spark: SparkSession, d: str) -> DataFrame:
    points = neighbours.indexed(_vectors(spark, d))
    return neighbours.nearest(points, neighbours.neighbour_graph(points))


def p5_search(spark: SparkSession, d: str) -> DataFrame:
    """Queries: every vector of embeddings whose id is divisible by 50, against all others."""
    points = neighbours.indexed(table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("key"), "embedding"))
    graph = neighbours.neighbour_graph(points)
    queries = points.filter("CAST(key AS BIGINT) % 50 = 0").select(F.col("key").alias("query"), "code")
    return neighbours.search(points, graph, queries, others=True)


def p6_files(spark: SparkSession, d: str) -> DataFrame:
    return syntax.syntax_report(table(spark, d, "source_files"), table(spark, d, "sources"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_files(spark, d).filter("n_errors > 0").select("path").distinct()


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.syntax_rates(p6_files(spark, d))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, d, "documents"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(_leaks(spark, d))


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    return languages.language_profiles(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.mislabelled(_profiles(spark, d)).select("doc_id", "lang")


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    return languages.own_languages(_profiles(spark, d))


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    return _profiles(spark, d).selectExpr("doc_id", "posexplode(segments) AS (segment, s)").selectExpr("doc_id", "segment", "s.lang", "s.confidence", "s.sentences", "s.text")


QUERIES = {f.__name__: f for f in (p1_pieces, p1_found, p4_pairs, p4_found, p5_found, p5_nearest, p5_search, p6_files, p6_found, p6_rates, p7_ids, p8_found, p8_spans, p8_items, p9_found, p9_documents, p9_segments)}


def _words(column: str) -> str:
    return f"len(list_filter(string_split_regex(coalesce({column}, ''), '{WHITE}'), lambda w: w <> ''))"


ORACLE: dict[str, str] = {
    "p5_found": """WITH v AS (SELECT id AS key, embedding AS e FROM chunks UNION ALL SELECT qualified_name, embedding FROM code_entities UNION ALL SELECT qualified_name, embedding FROM db_tables),
u AS (SELECT key, max(CAST(e AS DOUBLE[])) AS e FROM v WHERE key IS NOT NULL AND len(e) = 64 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0 GROUP BY 1)
SELECT a.key AS key_a, b.key AS key_b FROM u a JOIN u b ON a.key < b.key WHERE list_cosine_similarity(a.e, b.e) >= 0.95""",
    "p1_found": f"""SELECT DISTINCT c.id AS chunk_id FROM chunks c
LEFT JOIN (SELECT id, max(breadcrumb) AS breadcrumb FROM sections GROUP BY 1) s ON s.id = c.section_id
WHERE c.id IS NOT NULL AND c.text IS NOT NULL AND {_words("c.text")} + {_words("s.breadcrumb")} > 400""",
}
