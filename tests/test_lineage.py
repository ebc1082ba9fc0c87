"""Hierarchies and orphan references: against brute force, and in all the odd cases."""

import random
from datetime import datetime

from pyspark.sql import functions as F

from loomspan.operators import hierarchy as H
from loomspan.operators import orphan_refs as O

LINKS = "node_table string, node_key string, parent_key string"


def brute(links):
    parents = {(t, k): p for t, k, p in links}
    out = {}
    for t, k in parents:
        path, at = [k], k
        while True:
            p = parents[(t, at)]
            if p is None or (t, p) not in parents or p in path:
                break
            path.append(p)
            at = p
        p = parents[(t, at)]
        ring = path[path.index(p) :] if p in path else None
        out[(t, k)] = (list(reversed(path)), ring)
    return out


def test_hierarchy_like_brute_force(spark):
    rng = random.Random(3)
    links = []
    for t in ("a", "b"):
        for n in range(120):
            parent = rng.choice([None, "gone", *(f"k{m:03d}" for m in (range(n) if rng.random() < 0.9 else range(120)))])
            links.append((t, f"k{n:03d}", parent))
    links += [("c", "x", "x"), ("c", "y", "x"), ("d", "only", None)]
    links += [("deep", f"{n:03d}", f"{n - 1:03d}" if n else None) for n in range(40)]
    df = spark.createDataFrame(links, LINKS)
    want = brute(links)
    rings = {(t, k): min(r) for (t, k), (_, r) in want.items() if r and k in r}
    tree = H.hierarchy(df).collect()
    assert {(r.node_table, r.node_key) for r in tree} == set(want)
    assert {(r.node_table, r.node_key): r.cycle_key for r in tree if r.on_cycle} == rings
    for r in tree:
        path, ring = want[(r.node_table, r.node_key)]
        if r.on_cycle:
            assert (r.path, r.depth, r.root_key) == ([r.node_key], 0, r.cycle_key)
        elif not ring:
            assert (r.path, r.depth, r.root_key) == (path, len(path) - 1, path[0])
        else:
            assert r.root_key == min(ring)
    found = {(r.node_table, r.ancestor_key, r.descendant_key, r.distance) for r in H.descendants(H.hierarchy(df)).collect()}
    plain = {(t, a, k, len(p) - 1 - i) for (t, k), (p, ring) in want.items() if not ring for i, a in enumerate(p[:-1])}
    assert plain <= found
    sizes = {(r.node_table, r.node_key): r.subtree_size for r in tree}
    assert sizes[("deep", "000")] == 40


def test_hot_parent_and_empty(spark):
    star = spark.range(3000).select(F.lit("s").alias("node_table"), F.col("id").cast("string").alias("node_key"), F.when(F.col("id") > 0, "0").alias("parent_key"))
    tree = H.hierarchy(star)
    assert tree.filter("depth = 1").count() == 2999 and tree.filter("node_key = '0'").first().subtree_size == 3000
    nothing = spark.createDataFrame([], LINKS)
    assert H.hierarchy(nothing).count() == 0 and H.cycles(H.peel(nothing)).count() == 0


T = lambda n: datetime(2025, 1, n)
ROWS = "id string, parent_id string, ingested_at timestamp, deleted_at timestamp, live string, first_at int"


def test_live_links(spark):
    rows = [
        ("a", None, T(1), None), ("a", None, T(1), None), ("b", " \t", T(1), None), ("c", "a", T(1), T(2)), ("c", "a", T(3), None),
        ("d", "a", T(1), None), ("d", "b", T(4), T(5)), (None, "a", T(1), None), ("e", "a", None, None),
    ]
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], ROWS)
    got = {r.node_key: r.parent_key for r in H.live_links(df, "sections", "id", "parent_id").collect()}
    assert got == {"a": None, "b": None, "c": "a", "e": "a"}


def test_orphans(spark):
    sections = spark.createDataFrame(
        [("p::s0000", None, T(1), None), ("p::s0001", "p::s0000", T(2), None), ("p::s0002", "p::s0009", T(2), None), ("p::s0003", "p::s0004", T(1), None), ("p::s0004", None, T(9), None),
         ("p::s0005", "p::s0006", T(3), None), ("p::s0006", None, T(1), T(2)), ("p::s0007", "", T(1), None), ("p::s0008", "P::s0000", T(1), None), ("p::s0010", "p::s00001", T(1), None), ("x", "y", T(1), None)],
        "id string, parent_id string, ingested_at timestamp, deleted_at timestamp",
    )
    entities = spark.createDataFrame([], "qualified_name string, parent_qualified_name string, ingested_at timestamp, deleted_at timestamp")
    tables = spark.createDataFrame([("s.t", ['"S"."T"', None, " ", "s.none", "S.None"], T(1), None), ("s.u", None, T(1), None), ("S.V", ["[s].[v]"], T(1), None)], "qualified_name string, ref_tables array<string>, ingested_at timestamp, deleted_at timestamp")
    got = {(r.src_key, r.target_key, r.reason) for r in O.orphans(*O.knowledge_refs(sections, entities, tables)).collect()}
    assert got == {
        ("p::s0002", "p::s0009", "absent"), ("p::s0003", "p::s0004", "late"), ("p::s0005", "p::s0006", "deleted"), ("p::s0008", "P::s0000", "absent"),
        ("p::s0010", "p::s00001", "absent"), ("x", "y", "absent"), ("s.t", "s.none", "absent"),
    }
    report = O.orphan_report(O.orphans(*O.knowledge_refs(sections, entities, tables))).collect()
    assert sum(r.n_refs for r in report) == 7 and {r.month for r in report} == {"2025-01"}


def test_runs_over_blocks(spark):
    keys = [f"k{n}" for n in (*range(4090, 4100), 5, 6, 9)]
    targets = spark.createDataFrame([("t", k, T(1), True) for k in keys], "ref_table string, ref_key string, first_at timestamp, live boolean")
    got = sorted((r.width, r.run_start, r.run_end) for r in O.runs(targets).collect())
    assert got == [(1, 5, 6), (1, 9, 9), (4, 4090, 4095), (4, 4096, 4099)]
