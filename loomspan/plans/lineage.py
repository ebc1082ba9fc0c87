"""Queries of the problems that belong to the core: hierarchies and orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.common import table
from loomspan.operators import hierarchy as H
from loomspan.operators import orphan_refs as O


def _links(spark: SparkSession, d: str) -> DataFrame:
    return H.live_links(table(spark, d, "sections"), "sections", "id", "parent_id").unionByName(
        H.live_links(table(spark, d, "code_entities"), "code_entities", "qualified_name", "parent_qualified_name")
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return H.cycles(H.peel(_links(spark, d)))


def p2_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return H.hierarchy(_links(spark, d)).withColumns({"path": F.array_join("path", " / "), "height": F.coalesce("height", F.lit(-1))})


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    return H.descendants(H.hierarchy(_links(spark, d)))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return O.orphans(*O.knowledge_refs(*(table(spark, d, t) for t in ("sections", "code_entities", "db_tables"))))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("src_table", "src_key", "target_key")


def p3_by_month(spark: SparkSession, d: str) -> DataFrame:
    return O.orphan_report(_orphans(spark, d))


QUERIES = {f.__name__: f for f in (p2_found, p2_hierarchy, p2_descendants, p3_found, p3_by_month)}

# Current rows, as SQL: the latest row of each key with its first time.
_NOW = """SELECT {key} AS k, arg_max(struct_pack(v := {col}, gone := deleted_at IS NOT NULL), ingested_at) AS r,
min(ingested_at) AS first_at FROM {table} WHERE {key} IS NOT NULL GROUP BY 1"""
_FOLD = "lower(trim(regexp_replace({0}, '[\"`\\[\\]]', '', 'g')))"

_P3 = f"""WITH s AS ({_NOW.format(key="id", col="parent_id", table="sections")}),
c AS ({_NOW.format(key="qualified_name", col="parent_qualified_name", table="code_entities")}),
t AS ({_NOW.format(key="qualified_name", col="ref_tables", table="db_tables")}),
refs AS (SELECT 'sections' AS src_table, k AS src_key, first_at, r.v AS target_key FROM s WHERE NOT r.gone
 UNION ALL SELECT 'code_entities', k, first_at, r.v FROM c WHERE NOT r.gone
 UNION ALL SELECT 'db_tables', k, first_at, {_FOLD.format("x")} FROM (SELECT k, first_at, unnest(r.v) AS x FROM t WHERE NOT r.gone)),
targets AS (SELECT 'sections' AS tab, k, first_at, NOT r.gone AS live FROM s
 UNION ALL SELECT 'code_entities', k, first_at, NOT r.gone FROM c
 UNION ALL SELECT 'db_tables', {_FOLD.format("k")}, min(first_at), bool_or(NOT r.gone) FROM t GROUP BY 2),
found AS (SELECT DISTINCT r.src_table, r.src_key, r.target_key, r.first_at,
 CASE WHEN g.k IS NULL THEN 'absent' WHEN NOT g.live THEN 'deleted' ELSE 'late' END AS reason
 FROM refs r LEFT JOIN targets g ON g.tab = r.src_table AND g.k = r.target_key
 WHERE trim(coalesce(r.target_key, '')) <> '' AND (g.k IS NULL OR NOT g.live OR g.first_at > r.first_at))
"""

_P2_LINKS = f"""s AS ({_NOW.format(key="id", col="parent_id", table="sections")}),
c AS ({_NOW.format(key="qualified_name", col="parent_qualified_name", table="code_entities")}),
links AS (SELECT 'sections' AS t, k, CASE WHEN trim(coalesce(r.v, '')) <> '' THEN r.v END AS p FROM s WHERE NOT r.gone
 UNION ALL SELECT 'code_entities', k, CASE WHEN trim(coalesce(r.v, '')) <> '' THEN r.v END FROM c WHERE NOT r.gone)"""

# Walks up from every node and stops on a second meeting: a node that meets itself is on a circle.
_P2_RING = """round AS (SELECT t, k, k AS cur, [k] AS seen FROM links
 UNION ALL SELECT w.t, w.k, l.p, list_append(w.seen, l.p) FROM round w JOIN links l ON l.t = w.t AND l.k = w.cur
 JOIN links u ON u.t = l.t AND u.k = l.p WHERE len(w.seen) < 2 OR NOT list_contains(w.seen[1:-2], w.cur)),
ring AS (SELECT t, k, list_min(seen) AS least FROM round WHERE cur = k AND len(seen) > 1)"""
_P2_PAIRS = f"""{_P2_LINKS},
walk AS (SELECT l.t, l.k AS d, l.p AS a, 1 AS distance, [l.k, l.p] AS seen FROM links l JOIN links u ON u.t = l.t AND u.k = l.p
 WHERE l.p <> l.k
 UNION ALL SELECT w.t, w.d, l.p, w.distance + 1, list_append(w.seen, l.p) FROM walk w JOIN links l ON l.t = w.t AND l.k = w.a
 JOIN links u ON u.t = l.t AND u.k = l.p WHERE NOT list_contains(w.seen, l.p)),
ringed AS (SELECT DISTINCT w.t, w.d AS k FROM walk w JOIN links l ON l.t = w.t AND l.k = w.a AND l.p = w.d
 UNION SELECT t, k FROM links WHERE k = p),
pairs AS (SELECT w.* FROM walk w WHERE NOT EXISTS (SELECT 1 FROM ringed r WHERE r.t = w.t AND r.k = w.d)
 AND w.distance <= (SELECT coalesce(min(v.distance), 1000000) FROM walk v JOIN ringed r ON r.t = v.t AND r.k = v.a WHERE v.t = w.t AND v.d = w.d))"""
ORACLE = {
    "p2_found": f"WITH RECURSIVE {_P2_LINKS}, {_P2_RING} SELECT t AS node_table, k AS node_key, min(least) AS cycle_key FROM ring GROUP BY 1, 2",
    "p3_found": _P3 + "SELECT DISTINCT src_table, src_key, target_key FROM found",
    "p3_by_month": _P3
    + """SELECT src_table, strftime(first_at AT TIME ZONE 'UTC', '%Y-%m') AS month, reason, count(*) AS n_refs, count(DISTINCT src_key) AS n_keys
FROM found GROUP BY 1, 2, 3""",
    "p2_descendants": f"""WITH RECURSIVE {_P2_PAIRS}
SELECT t AS node_table, a AS ancestor_key, d AS descendant_key, CAST(distance AS INTEGER) AS distance FROM pairs""",
    "p2_hierarchy": f"""WITH RECURSIVE {_P2_PAIRS}, {_P2_RING}, circle AS (SELECT t, k, min(least) AS cycle_key FROM ring GROUP BY 1, 2),
up AS (SELECT t, d AS k, count(*) AS depth, string_agg(a, ' / ' ORDER BY distance DESC) AS above, arg_max(a, distance) AS top FROM pairs GROUP BY 1, 2),
down AS (SELECT t, a AS k, count(*) AS n, max(distance) AS height FROM pairs GROUP BY 1, 2)
SELECT l.t AS node_table, l.k AS node_key, l.p AS parent_key, coalesce(o.cycle_key, r.cycle_key, u.top, l.k) AS root_key, CAST(coalesce(u.depth, 0) AS INTEGER) AS depth,
 coalesce(u.above || ' / ', '') || l.k AS path, 1 + coalesce(b.n, 0) AS subtree_size, CASE WHEN o.k IS NULL THEN CAST(coalesce(b.height, 0) AS INTEGER) ELSE -1 END AS height, o.k IS NOT NULL AS on_cycle, o.cycle_key
FROM links l LEFT JOIN up u ON u.t = l.t AND u.k = l.k LEFT JOIN down b ON b.t = l.t AND b.k = l.k LEFT JOIN circle o ON o.t = l.t AND o.k = l.k LEFT JOIN circle r ON r.t = u.t AND r.k = u.top""",
}
