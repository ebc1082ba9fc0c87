import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomspan.llm import neighbours as N
from loomspan.llm import queries


def frame(spark, x, prefix="k"):
    return spark.createDataFrame(pa.table({"key": [f"{prefix}{n:05d}" for n in range(len(x))], "embedding": list(np.asarray(x, np.float64))}))


def test_close_pairs_and_recall(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 64))
    for n in range(0, 300, 3):
        x[n + 1] = 3 * (x[n] + 0.02 * rng.normal(size=64))
    vectors = frame(spark, x)
    points = N.indexed(vectors)
    graph = N.neighbour_graph(points, trees=9, rounds=2, leaf=400)
    got = {(r.key_a, r.key_b) for r in N.close_pairs(vectors, points, graph).collect()}
    assert got == {(f"k{n:05d}", f"k{n + 1:05d}") for n in range(0, 300, 3)}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = unit @ unit.T
    np.fill_diagonal(sim, -2)
    best = np.argsort(-sim, axis=1)[:, :10]
    found: dict = {}
    for r in N.nearest(points, graph).collect():
        found.setdefault(r.key, set()).add(r.neighbour)
        assert abs(sim[int(r.key[1:]), int(r.neighbour[1:])] - r.cosine) < 0.01
    assert len(found) == 3000 and all(len(v) == 10 for v in found.values())
    assert np.mean([len(found[f"k{n:05d}"] & {f"k{m:05d}" for m in row}) / 10 for n, row in enumerate(best)]) >= 0.9
    queries = points.filter("key LIKE '%00'").select(F.col("key").alias("query"), "code")
    answers = N.search(points, graph, queries, beam=80, steps=8).collect()
    assert np.mean([r.key in found[r.query] | {r.query} for r in answers]) >= 0.6


def test_odd_vectors(spark):
    good = [1.0] * 64
    rows = [("a", good), ("a", good), ("b", [2.0] * 64), ("c", [0.0] * 64), ("d", [1.0] * 32), ("e", None), ("f", [float("nan")] + good[1:]), ("g", [float("inf")] + good[1:]), (None, good), ("h", [None] + good[1:]), ("i", [-1.0] * 64), ("j", [])]
    vectors = spark.createDataFrame([(*r, "clash") for r in rows], "key string, embedding array<double>, id string")
    points = N.indexed(vectors)
    assert {r.key for r in points.collect()} == {"a", "b", "i"}
    graph = N.neighbour_graph(points)
    assert {(r.key_a, r.key_b) for r in N.close_pairs(vectors, points, graph).collect()} == {("a", "b")}
    for few in (vectors.limit(0), vectors.filter("key = 'a'")):
        p = N.indexed(few)
        assert N.close_pairs(few, p, N.neighbour_graph(p)).count() == 0


def test_many_copies_are_cut_into_blocks(spark):
    x = np.vstack([np.ones((900, 64)), np.random.default_rng(1).normal(size=(300, 64))])
    points = N.indexed(frame(spark, x))
    graph = N.neighbour_graph(points, trees=3, rounds=1, leaf=100)
    assert graph.count() == 1200
    assert N.graph_edges(graph).join(points.filter("key < 'k00900'"), "id").groupBy("id").agg(F.min("cosine").alias("c")).filter("c > 0.99").count() == 900


def test_graph_does_not_follow_the_partitions(spark):
    vectors = frame(spark, np.random.default_rng(2).normal(size=(1500, 64)))
    graphs = []
    for n in (1, 5):
        points = N.indexed(vectors.repartition(n).sortWithinPartitions(F.xxhash64("key", F.lit(n))))
        graphs.append({tuple(r) for r in N.nearest(points, N.neighbour_graph(points, trees=2, rounds=1, leaf=300)).select("key", "neighbour", "rank").collect()})
    assert graphs[0] == graphs[1]


def test_all_queries_use_the_same_graph(spark, data, monkeypatch):
    asked, real = [], N.neighbour_graph
    monkeypatch.setattr(N, "neighbour_graph", lambda points, **given: asked.append(given) or real(points, **given))
    for query in (queries.p5_found, queries.p5_nearest, queries.p5_search):
        query(spark, data)
    assert asked == [{}, {}, {}]


def state_of(spark, points, named):
    """A state in which each id of `named` names the ids there, all fresh, with cosines of -1."""
    rows = []
    for r in points.collect():
        others = np.array(named.get(r.id, []), np.int64)
        near = N._packed(np.zeros(len(others), int), 1, np.full(len(others), r.id), others, np.full(len(others), -1, np.float32), np.ones(len(others), np.uint8), True)
        rows.append((r.id, r.code, bytearray(near.tobytes()), -2.0, len(others)))
    return spark.createDataFrame(rows, N._STATE)


def test_rounds_go_on_until_the_graph_settles(spark):
    x = np.random.default_rng(5).normal(size=(3000, 64))
    x[:, 8:] *= 0.3
    points = N.indexed(frame(spark, x))
    found: dict = {}
    for r in N.nearest(points, N.neighbour_graph(points, trees=3, rounds=1, leaf=50)).collect():
        found.setdefault(r.key, set()).add(r.neighbour)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = unit @ unit.T
    np.fill_diagonal(sim, -2)
    best = np.argsort(-sim, axis=1)[:, :10]
    assert np.mean([len(found[f"k{n:05d}"] & {f"k{m:05d}" for m in row}) / 10 for n, row in enumerate(best)]) >= 0.9


def test_whoever_names_a_vector_meets_all_that_it_names(spark):
    rng = np.random.default_rng(6)
    points = N.indexed(frame(spark, rng.normal(size=(402, 64))))
    ids = {r.key: r.id for r in points.collect()}
    hub, last = ids["k00400"], ids["k00401"]
    state = state_of(spark, points, {ids[f"k{n:05d}"]: [hub] for n in range(400)} | {hub: [last]})  # 400 name the hub, none names them
    met = {(r.id, r.other) for r in N.graph_edges(N._descend(state, 0)).collect()}
    assert {a for a, _ in met} == {*ids.values()} - {hub}
    assert len({a for a, b in met if b == last} | {b for a, b in met if a == last}) >= 10


def test_pairs_that_met_do_not_meet_again(spark):
    points = N.indexed(frame(spark, np.random.default_rng(7).normal(size=(40, 64))))
    ids = [r.id for r in points.orderBy("key").collect()]
    state = N._merged(state_of(spark, points, {ids[0]: ids[1:11]}), None, met=True)
    assert N._descend(state, 0).count() == 0


def test_rounds_run_on_small_collections_too(spark, monkeypatch):
    turns, real = [], N._descend
    monkeypatch.setattr(N, "_descend", lambda state, turn, *rest: turns.append(turn) or real(state, turn, *rest))
    N.neighbour_graph(N.indexed(frame(spark, np.random.default_rng(9).normal(size=(3000, 64)))))
    assert 0 in turns


def test_equal_vectors_parted_in_one_tree_meet_in_another():
    x = np.ones((5000, 64), np.float32) / 8
    cells, ids = N.Cells(x, 5000, 100, 2), np.arange(5000)
    first, second = cells.cells(x, ids, 0), cells.cells(x, ids, 1)
    assert 8 <= len(np.unique(first)) and np.unique(first, return_counts=True)[1].max() < 400
    together = (first[:, None] == first[None, :]) & ~np.eye(5000, dtype=bool)
    assert 0.5 < (second[:, None] == second[None, :])[together].mean() * len(np.unique(second)) < 2


def test_cells_do_not_grow_with_the_collection():
    sample = np.random.default_rng(3).normal(size=(2000, 64)).astype(np.float32)
    size = lambda n: sum(m.size for tree in N.Cells(sample, n, 4096, 1).marks for m in tree)
    assert size(10**12) <= size(10**6) + 3 * 256 * 64


def test_runs_are_cut_only_when_long_themselves():
    keys = np.repeat([1, 2, 3], [90, 90, 250])
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[a : a + 64]), pa.array(np.arange(a, min(a + 64, len(keys))))], names=["key", "n"]) for a in range(0, len(keys), 64)]
    parts = [first.tolist() for first, _ in N._whole_groups(batches, 1, 120)]
    assert sum(parts, []) == keys.tolist()
    assert [sum(k in part for part in parts) for k in (1, 2)] == [1, 1] and sum(3 in part for part in parts) > 1


def test_search_goes_on_until_beams_settle(spark):
    turn = np.arange(1500) * 2 * np.pi / 1500
    x = np.zeros((1500, 64))
    x[:, 0], x[:, 1] = np.cos(turn), np.sin(turn)  # a ring: far from the entries, a step goes five points on
    points = N.indexed(frame(spark, x))
    ids = [r.id for r in points.orderBy("key").collect()]
    graph = state_of(spark, points, {ids[n]: [ids[(n + k) % 1500] for k in (1, -1, 2, -2, 3, -3, 4, -4, 5, -5)] for n in range(1500)}).select("id", "near")
    queries_ = points.filter("key IN ('k00100', 'k00600')").select(F.col("key").alias("query"), "code")
    answers = N.search(points, graph, queries_, entries=1, beam=20, others=True).collect()
    assert len(answers) == 20 and all(r.key != r.query and r.cosine > 0.99 for r in answers)


def test_registered_search_against_brute_force(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("key"), "embedding").toPandas()
    x = np.array(rows.embedding.tolist(), np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found: dict = {}
    for r in queries.p5_search(spark, data).collect():
        found.setdefault(r.query, set()).add(r.key)
    hits = []
    for n in np.flatnonzero(rows.key.astype(int).to_numpy() % 50 == 0):
        sim = x @ x[n]
        sim[n] = -2
        assert rows.key[n] not in found[rows.key[n]]
        hits.append(len(found[rows.key[n]] & set(rows.key[np.argsort(-sim)[:10]])) / 10)
    assert np.mean(hits) >= 0.9


def test_parts_of_a_round_share_its_meeting_points(spark, monkeypatch):
    points = N.indexed(frame(spark, np.random.default_rng(10).normal(size=(460, 64))))
    ids = [r.id for r in points.orderBy("key").collect()]
    met = N._merged(state_of(spark, points, {ids[n]: ids[402:405] for n in range(405, 460)}), None, met=True)
    fresh = state_of(spark, points, {ids[n]: [ids[400]] for n in range(400)} | {ids[400]: [ids[401]]})
    state = N.cut(fresh.filter(F.col("id").isin(ids[:405])).unionByName(met.filter(F.col("id").isin(ids[405:]))))
    whole = {tuple(r) for r in N.graph_edges(N._merged(state, N._descend(state, 3), met=True)).collect()}
    passes, real = [], N._edges
    monkeypatch.setattr(N, "_edges", lambda *given: passes.append(given) or real(*given))
    meetings = N._meetings(state)
    assert meetings[1]["hot"] == 1 and meetings[1]["done"] >= 3
    found = None
    for part in range(3):
        rows = N._descend(state, 3, part, 3, meetings)
        found = rows if found is None else found.unionByName(rows)
    assert {tuple(r) for r in N.graph_edges(N._merged(state, found, met=True)).collect()} == whole
    assert len(passes) == 1 + 2 * 3


def test_pairs_of_a_block_come_with_their_exact_cosines():
    rng = np.random.default_rng(11)
    codes = rng.integers(-127, 128, size=(700, 64)).astype(np.int8)
    codes[600:] = codes[:100]
    known = np.where(np.arange(700) % 2, 0.2, -2).astype(np.float32)
    unit = N._floats(codes)
    sim = unit @ unit.T
    np.fill_diagonal(sim, -3)
    for some, worst in ((700, known), (700, np.full(700, -2, np.float32)), (300, known[:300])):
        i, j, cosine = N._near_in_block(codes[:some], worst)
        assert len(set(zip(i.tolist(), j.tolist(), strict=True))) == len(i) and (i != j).all()
        assert (cosine == N._cosines(codes[i], codes[j])).all() and (cosine > worst[i]).all()
        own = sim[:some, :some]
        bound = np.sort(own[:, :: 8], axis=1)[:, -3] if some > 512 else np.sort(own, axis=1)[:, -10]
        wanted = own > np.maximum(worst, bound - 1e-6)[:, None]  # the pair that gave the bound is among them
        assert set(zip(*np.nonzero(wanted & (own > worst[:, None] + 1e-6)), strict=True)) <= set(zip(i, j, strict=True))
