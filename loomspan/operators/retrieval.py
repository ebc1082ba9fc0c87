"""Hybrid retrieval: exact vector scores, BM25, fusion, query variants, reranking, evaluation."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.text import tokens

VECTOR_WEIGHT, TEXT_WEIGHT = 0.7, 0.3
CANDIDATES = 4  # times the rows asked for that each half contributes
K1, B = 1.2, 0.75


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def usable(c: Column, width: int | Column) -> Column:
    """An embedding of `width` finite values that aren't all zero."""
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(c) == width) & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def index_score(a: Column, b: Column) -> Column:
    """Cosine as a vector index gives it: (1 + cosine) / 2, rounded so that ties break alike anywhere."""
    return F.round((1 + cosine(a, b)) / 2, 9)


def top_k(rows: DataFrame, k: int, key: str, score: str = "score", by: list[str] | None = None) -> DataFrame:
    """The k rows of the highest score, ties by key; per group if `by` is given, where a limit within
    each task comes before the shuffle."""
    if not by:
        return rows.orderBy(F.desc(score), key).limit(k)
    order = Window.partitionBy(*by).orderBy(F.desc(score), key)
    return rows.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k).drop("_rank")


def vector_scores(rows: DataFrame, key: str, embedding: str, query: DataFrame | list[float], width: int | None = None, copies: bool = False) -> DataFrame:
    """(key, score) of all usable rows. query: a vector, or one row, one column, of one; without a row no row scores.
    Rows are usable if they are as wide as the query, or `width` where given. copies: rows that repeat a key
    are copies and score once; only keys and scores are shuffled for it."""
    asked = rows.withColumn("_q", query.scalar() if isinstance(query, DataFrame) else F.array(*map(F.lit, query))).filter(usable(F.col(embedding), width if width else F.size("_q")))
    scores = asked.select(key, index_score(F.col(embedding), F.col("_q")).alias("score")).filter("score IS NOT NULL")
    return scores.groupBy(key).agg(F.max("score").alias("score")) if copies else scores


def _count(term: str) -> Column:
    return F.size(F.filter("_t", lambda x: x == F.lit(term)))


def bm25(rows: DataFrame, key: str, text: str, query: str, copies: bool = False) -> DataFrame:
    """(key, score) of the rows that hold a word of the query. Statistics cover all rows. One pass counts,
    one scores; nothing is shuffled but one row of counts per task. A query without words scores none.
    copies: rows that repeat a key are copies and count once; their counts are shuffled, not their texts."""
    terms = sorted(set(re.findall(r"[^\W]+", query.lower())))
    counted = (
        rows.select(key, tokens(F.coalesce(text, F.lit(""))).alias("_all"))
        .select(key, F.size("_all").alias("_dl"), F.filter("_all", lambda x: x.isin(*terms) if terms else F.lit(False)).alias("_t"))
        .select(key, "_dl", F.size("_t").alias("_hits"), *(_count(t).alias(f"_tf{i}") for i, t in enumerate(terms)))
    )
    if copies:
        counted = counted.groupBy(key).agg(*(F.max(c).alias(c) for c in counted.columns if c != key))
    if not terms:
        return counted.select(key, F.lit(0.0).alias("score")).limit(0)
    stats = counted.agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.avg("_dl").alias("avgdl"), *(F.count(F.when(F.col(f"_tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(terms)))).alias("s")
    )
    # A filter on the score would be pushed below the counts, which then were computed once per mention.
    scored = counted.filter("_hits > 0").withColumn("_s", stats.scalar())
    total = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"_tf{i}"), F.col(f"_s.df{i}")
        idf = F.log(1 + (F.col("_s.n") - df + 0.5) / (df + 0.5))
        total = total + F.when(tf > 0, idf * tf / (tf + K1 * (1 - B + B * F.col("_dl") / F.col("_s.avgdl")))).otherwise(0.0)
    return scored.select(key, F.round(total, 9).alias("score"))


def min_max(rows: DataFrame, score: str, by: list[str] | None = None) -> DataFrame:
    """rows with `score` laid between 0 and 1 over its group (over all without `by`); 1 where all are equal.
    Bounds are aggregated and joined, so that a group of any size costs one row per task."""
    bounds = F.struct(F.min(score).alias("low"), F.max(score).alias("high")).alias("_b")
    held = rows.join(rows.groupBy(*by).agg(bounds), by, "left") if by else rows.withColumn("_b", rows.agg(bounds).scalar())
    laid = F.when(F.col("_b.high") == F.col("_b.low"), 1.0).otherwise((F.col(score) - F.col("_b.low")) / (F.col("_b.high") - F.col("_b.low")))
    return held.withColumn(score, laid).drop("_b")


def fuse(vector: DataFrame, text: DataFrame, key: str) -> DataFrame:
    """(key, score) of the vector half's rows: both halves laid between 0 and 1 and weighted; text alone
    brings no row in. Both halves must lie behind a limit, as each is laid out within one task."""
    whole = Window.partitionBy(F.lit(0))
    low, high = F.min("score").over(whole), F.max("score").over(whole)
    laid = F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low))
    v, t = vector.select(key, laid.alias("_v")), text.select(key, laid.alias("_t"))
    return v.join(t, key, "left").select(key, F.round(VECTOR_WEIGHT * F.col("_v") + TEXT_WEIGHT * F.coalesce("_t", F.lit(0.0)), 9).alias("score"))


def hybrid(rows: DataFrame, key: str, text: str, embedding: str, query: str, vector: DataFrame | list[float], k: int = 5, keep: Column | None = None, filter_first: bool = True, copies: bool = False, whole: bool = False) -> DataFrame:
    """(key, score): the k best rows by vector and text; if whole, all candidates, CANDIDATES times as many. keep: a filter on rows; before the cut to
    candidates by default, else behind the vector's cut and before the text's, where it may leave fewer."""
    n = k * CANDIDATES
    of = rows.filter(keep) if keep is not None else rows
    v = top_k(vector_scores(of if filter_first else rows, key, embedding, vector, copies=copies), n, key)
    scores = bm25(rows, key, text, query, copies)
    if keep is not None:
        allowed = of.select(key)
        v = v if filter_first else v.join(allowed, key, "left_semi")
        scores = scores.join(allowed, key, "left_semi")
    fused = fuse(v, top_k(scores, n, key), key)
    return fused if whole else top_k(fused, k, key)


def fold_variants(results: list[DataFrame], key: str) -> DataFrame:
    """(key, score): the highest score of each row over several queries."""
    union = results[0]
    for r in results[1:]:
        union = union.unionByName(r)
    return union.groupBy(key).agg(F.max("score").alias("score"))


def rerank(found: DataFrame, key: str, document: Column, scorer: Callable[[Column], Column]) -> DataFrame:
    """found (key, score, ...) with rerank_score and position: by the scorer's value of the document, then
    by score, then by key. The scorer may be a pandas UDF; the score stays as it is."""
    scored = found.withColumn("rerank_score", scorer(document))
    order = Window.orderBy(F.desc("rerank_score"), F.desc("score"), key)
    return scored.withColumn("position", F.row_number().over(order))


# Expansions of acronyms that the rewriter starts from.
SYNONYMS = {
    "rag": "retrieval augmented generation", "mcp": "model context protocol", "iac": "infrastructure as code", "k8s": "kubernetes",
    "ci": "continuous integration", "cd": "continuous delivery", "auth": "authentication", "authz": "authorization", "db": "database",
    "vpc": "virtual private cloud", "iam": "identity and access management", "vuln": "vulnerability", "repo": "repository", "config": "configuration",
}


# What joins the parts of a query, and the words that a part must have.
CONNECTORS, PART_WORDS = (("and",), ("&",), (";",), (",",), ("as", "well", "as")), 3


def _query_parts(pieces: list[str]) -> list[str]:
    """Pieces of a query between connectors that stand by themselves."""
    parts, held, k = [], [], 0
    while k < len(pieces):
        joined = next((c for c in CONNECTORS if held and tuple(p.lower() for p in pieces[k : k + len(c)]) == c and k + len(c) < len(pieces)), ())
        if joined:
            parts.append(held)
            held = []
        else:
            held.append(pieces[k])
        k += len(joined) or 1
    return [" ".join(p) for p in [*parts, held] if p]


def query_variants(query: str, synonyms: dict[str, str] | None = None, most: int = 3) -> list[str]:
    """The query, one variant per acronym in order of place, and its parts if it joins several that have
    three words each; without repeats in any case, at most `most`."""
    known = SYNONYMS | {k.lower(): v for k, v in (synonyms or {}).items()}
    spans = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[a-z0-9]+(?:[-_][a-z0-9]+)*", query, re.I)]
    places: dict[str, list[tuple[int, int]]] = {}
    for start, end, word in spans:
        places.setdefault(word, []).append((start, end))
    variants = [query]
    for word in (w for w in places if w in known):
        text = query
        for start, end in reversed(places[word]):
            text = text[:start] + known[word] + text[end:]
        variants.append(text)
    parts = _query_parts(query.split())
    if len(parts) > 1 and min(len(re.findall(r"[A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)*", p)) for p in parts) >= PART_WORDS:
        variants += parts
    return normal_variants(variants, most)


def normal_variants(variants: list[str], most: int = 3) -> list[str]:
    """Variants without blanks around them, without empty ones and repeats in any case, at most `most` but one at least."""
    kept: dict[str, str] = {}
    for v in map(str.strip, variants):
        if v and v.casefold() not in kept:
            kept[v.casefold()] = v
    return list(kept.values())[: max(1, most)]


def expanded(rows: DataFrame, text: str) -> DataFrame:
    """rows with `variant`, one row per expansion of an acronym in `text`; JVM only."""
    pairs = F.array(*(F.struct(F.lit(k).alias("term"), F.lit(v).alias("full")) for k, v in SYNONYMS.items()))
    present = F.filter(pairs, lambda p: F.array_contains(tokens(F.col(text)), p["term"]))
    return rows.withColumn("hit", F.explode(present)).withColumn("variant", F.expr(f"regexp_replace({text}, concat('(?i)\\\\b', hit.term, '\\\\b'), hit.full)")).drop("hit")


def by_cases(rows: DataFrame, cases: DataFrame, k: int, key: str, embedding: str, asked: str, at_once: int = 500) -> DataFrame:
    """case_id, key, score and rank of the k nearest rows of each case (case_id, `asked` vector), other than
    itself: every case against every row, as stated questions. Cases are sent to the tasks in blocks of
    about at_once, by a hash of their id, one pass over the rows each; each task keeps k rows per case."""
    n = cases.count()
    blocks = max(1, -(-n // at_once))
    out = None
    for block in range(blocks):
        some = cases.filter(F.pmod(F.xxhash64("case_id"), F.lit(blocks)) == block).select("case_id", asked)
        scored = rows.join(F.broadcast(some), F.col(key) != F.col("case_id")).select("case_id", key, index_score(F.col(embedding), F.col(asked)).alias("score"))
        best = top_k(scored, k, key, by=["case_id"])
        out = best if out is None else out.unionByName(best)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), key)))


def first_hits(ranked: DataFrame, relevant: DataFrame, cases: DataFrame) -> DataFrame:
    """case_id, rank of the first relevant result (null if none) and passed (found as expected).
    ranked: case_id, id, rank. relevant: case_id, id. cases: case_id, expect_match."""
    first = ranked.join(relevant, ["case_id", "id"], "left_semi").groupBy("case_id").agg(F.min("rank").alias("first_rank"))
    return cases.join(first, "case_id", "left").select("case_id", "first_rank", (F.col("first_rank").isNotNull() == F.col("expect_match")).alias("passed"))
