"""Retrieval, store, graph and memory on small rows with known results."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.operators import graph as G
from loomspan.operators import memory as M
from loomspan.operators import retrieval as R
from loomspan.operators import store as S
from loomspan.sources import sqlscan


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_fusion(spark):
    v = spark.createDataFrame([("a", 0.9), ("b", 0.5)], "id string, score double")
    t = spark.createDataFrame([("z", 3.0)], "id string, score double")
    assert pairs(R.fuse(v, t, "id")) == {("a", 0.7), ("b", 0.0)}
    assert pairs(R.fuse(v.limit(1), t, "id")) == {("a", 0.7)}
    assert R.fuse(v.limit(0), t, "id").count() == 0


def test_variants():
    assert R.query_variants("db and cd are slow") == ["db and cd are slow", "database and cd are slow", "db and continuous delivery are slow"]
    assert R.query_variants("find the old table and drop the new index") == ["find the old table and drop the new index", "find the old table", "drop the new index"]
    assert R.query_variants("  ", most=0) == [] and R.query_variants("x", most=0) == ["x"]


def test_rerank_and_folding(spark):
    found = spark.createDataFrame([("a", 0.9, "short"), ("b", 0.1, "much longer text"), ("c", 0.9, "short")], "id string, score double, doc string")
    ranked = {r.id: r.position for r in R.rerank(found, "id", F.col("doc"), F.length).collect()}
    assert ranked == {"b": 1, "a": 2, "c": 3}
    one, two = (spark.createDataFrame(x, "id string, score double") for x in ([("a", 0.4), ("b", 0.9)], [("a", 0.7), ("b", 0.2), ("c", 0.5)]))
    assert pairs(R.fold_variants([one, two], "id")) == {("a", 0.7), ("b", 0.9), ("c", 0.5)}


def test_bm25_edges(spark):
    rows = spark.createDataFrame([(1, "red fish"), (2, None), (3, ""), (4, "red red red")], "id int, text string")
    assert {r.id for r in R.bm25(rows, "id", "text", "RED").collect()} == {1, 4}
    assert R.bm25(rows, "id", "text", "?!").count() == 0 and R.bm25(rows.limit(0), "id", "text", "red").count() == 0


def test_usable(spark):
    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame([([1.0, 0.0],), ([0.0, 0.0],), ([nan, 1.0],), ([inf, 1.0],), ([1.0],), (None,), ([None, 1.0],)], "e array<double>")
    assert [r[0] for r in rows.select(R.usable(F.col("e"), 2)).collect()] == [True, False, False, False, False, False, False]


def test_text_helpers(spark):
    df = spark.createDataFrame([("a && b || !c",)], "q string")
    assert df.select(T.escape_query(F.col("q"))).first()[0] == r"a \&\& b \|\| \!c"
    assert [bool(__import__("re").search(T.glob_pattern(g), "web/orders/list.js")) for g in ("orders", "^orders", "orders$", "*/o?ders/*js$", "list.js$")] == [True, False, False, True, True]
    words = spark.createDataFrame([(" ".join(f"w{n}" for n in range(1000)),), ("   ",), (None,)], "t string").select(T.word_windows(F.col("t")).alias("c")).collect()
    assert [[(c.order, c.token_count) for c in r.c] for r in words] == [[(0, 400), (1, 400), (2, 320)], [], []]
    assert words[0].c[1].text.startswith("w340 ")
    routes = spark.createDataFrame([("/a/{id}/",), ("/",), (None,), ("",)], "p string").select(T.normal_route(F.col("p"))).collect()
    assert [r[0] for r in routes] == ["/a/{}", "/", "/", "/"]
    cites = spark.createDataFrame([("p", "A > B", 42, 42), ("p", None, 42, 44), ("p", "A", None, None)], "p string, b string, s int, e int").select(T.citation(F.col("p"), F.col("b"), F.col("s"), F.col("e"))).collect()
    assert [r[0] for r in cites] == ["p — A > B (p. 42)", "p —  (pp. 42–44)", "p — A"]
    red = spark.createDataFrame([("db.password", "x"), ("app.key", "x"), ("keyboard", "x"), ("a.token[0]", "x")], "k string, v string").select(T.redacted(F.col("k"), F.col("v"))).collect()
    assert [r[0] for r in red] == ["***", "***", "x", "***"]
    sql = spark.createDataFrame([(1, "INSERT INTO a.t SELECT * FROM b JOIN c ON 1=1 -- FROM d\n WHERE x = 'from e'"), (2, None), (3, ""), (4, "DELETE FROM a . x; UPDATE b.y SET z = 1; select 1 from y")], "k int, s string")
    assert sorted(tuple(r) for r in sqlscan.table_mentions(sql, "k", "s").collect()) == [(1, "b", "read"), (1, "c", "read"), (1, "t", "write"), (4, "a", "write"), (4, "y", "write")]


def test_store(spark):
    old = spark.createDataFrame([("a", "1", ["x"]), ("b", "2", ["y"])], "k string, v string, l array<string>")
    new = spark.createDataFrame([("b", "", []), ("c", "3", None)], "k string, v string, l array<string>")
    assert {(r.k, r.v) for r in S.upsert(old, new, ["k"]).collect()} == {("a", "1"), ("b", ""), ("c", "3")}
    assert {(r.k, r.v, tuple(r.l or [])) for r in S.coalescing_upsert(old, new, "k").collect()} == {("a", "1", ("x",)), ("b", "2", ("y",)), ("c", "3", ())}
    files = spark.createDataFrame([("p", "h1"), ("q", "h2")], "path string, content_hash string")
    assert pairs(S.changed(files, files.limit(1))) == {("q", "h2")}
    rows = spark.createDataFrame([("p", "k1"), ("p", "k2"), ("q", "k3")], "path string, k string")
    assert pairs(S.reconcile(rows, rows.filter("k = 'k1'"), "path", ["k"]).select("k")) == {("k2",)}
    assert pairs(S.replace_by_source(rows, rows.filter("k = 'k1'"), "path")) == {("p", "k1"), ("q", "k3")}
    match = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "1"), ("b", "2"), ("c", None)], "s string, d string")
    assert pairs(S.unique_match(match, "s", "d")) == {("a", "1", "one"), ("b", None, "several"), ("c", None, "none")}
    edges = spark.createDataFrame([("x", "Placed"), ("y", "a.Placed"), ("z", "Twice")], "src string, dst string")
    names = spark.createDataFrame([("a.Placed",), ("a.Twice",), ("b.Twice",)], "n string")
    assert pairs(S.fold_aliases(edges, names, "n").select("src", "dst")) == {("x", "a.Placed"), ("y", "a.Placed"), ("z", "Twice")}
    paths = spark.createDataFrame([("app/web/x.java",), ("app-legacy/y.java",), ("app/z.java",)], "path string")
    modules = spark.createDataFrame([("app",), ("app/web",)], "module string")
    assert pairs(S.nearest_prefix(paths, modules, "path", "module")) == {("app/web/x.java", "app/web"), ("app-legacy/y.java", None), ("app/z.java", "app")}


def test_enclosing(spark):
    import random

    rng = random.Random(5)
    spans = [("f", a, a + rng.choice([0, 1, 5, 40, 300]), f"n{k:02d}") for k, a in enumerate(rng.randrange(0, 400) for _ in range(60))]
    points = [("f", p) for p in range(0, 500, 7)] + [("g", 3)]
    got = {(r.g, r.at): r.n for r in S.enclosing(spark.createDataFrame(points, "g string, at int"), spark.createDataFrame([*spans, ("f", None, 3, "z"), ("f", 9, 3, "z")], "g string, s int, e int, n string"), "g", "at", "s", "e", "n").collect()}
    for g, p in points:
        held = [(e - s, -s, n) for h, s, e, n in spans if h == g and s <= p <= e]
        assert got[(g, p)] == (min(held)[2] if held else None)


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), (None, "q")], "src string, dst string")
    assert pairs(G.closure(edges)) == {(s, d) for s in "abc" for d in "abc"} | {("x", "y")}
    ranks = {r.node: r.pagerank for r in G.pagerank(edges).collect()}
    assert ranks["a"] == pytest.approx(1 - 0.85**21, abs=1e-6) and ranks["x"] == pytest.approx(0.15) and ranks["y"] == pytest.approx(0.15 + 0.85 * 0.15)
    assert G.pagerank(edges.limit(0)).count() == 0
    nodes = spark.createDataFrame([("L", "a", "n", "s" * 150), ("L", "b", "n", None), ("L", "c", "m", "")], "label string, key string, name string, summary string")
    typed = edges.withColumn("type", F.lit("T"))
    got = G.neighbours(nodes, typed, spark.createDataFrame([("n",)], "node string")).collect()
    assert {(r.direction, r.key) for r in got} == {("out", "b"), ("in", "c"), ("out", "c"), ("in", "a")} and max(len(r.summary or "") for r in got) == 100


def test_memory(spark):
    now = F.lit("2025-02-01 00:00:00").cast("timestamp")
    at = datetime(2025, 1, 27)
    rows = spark.createDataFrame(
        [("a", 0, at, False, None), ("b", 3, at, False, None), ("c", 0, at, True, None), ("d", 9, at, False, datetime(2024, 12, 1)), ("e", 0, datetime(2024, 1, 1), False, None), ("f", 0, datetime(2024, 1, 1), True, None)],
        "id string, access_count long, last_accessed_at timestamp, importance boolean, archived_at timestamp",
    )
    kept = {r.id: r[1] for r in rows.select("id", M.retention(F.col("access_count"), F.col("last_accessed_at"), now)).collect()}
    assert kept["b"] == pytest.approx(4 * math.exp(-5 / 30))
    assert pairs(M.prune(rows, now)) == {("d", "delete"), ("e", "archive")}
    relevance = spark.createDataFrame([(i, 0.5) for i in "abcdef"], "id string, score double")
    order = [r.id for r in M.recall(rows, relevance, now, 3).collect()]
    assert order[0] == "c" and "d" not in order
    touched = {r.id: r.access_count for r in M.touch(rows, spark.createDataFrame([("a", 0.9), ("b", 0.1)], "id string, raw_score double"), now).collect()}
    assert touched["a"] == 1 and touched["b"] == 3
    assert M.forget(rows, relevance.limit(1)).count() == 5
