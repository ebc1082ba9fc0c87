"""The property graph as two generic tables, and what is asked of it: neighbours, closures, PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.common import cut, cut_counting

DAMPING, ROUNDS = 0.85, 20


def neighbours(nodes: DataFrame, edges: DataFrame, asked: DataFrame, types: list[str] | None = None) -> DataFrame:
    """node, rel, direction, label, key, summary: the edges of each asked node (column node), outgoing and
    incoming. nodes: label, key, name, summary; an asked node is found by key or name, and several nodes
    may share a name. Summaries have up to 100 characters."""
    found = asked.join(nodes, (F.col("node") == F.col("key")), "inner").select("node", F.col("key").alias("of")).union(
        asked.join(nodes, (F.col("node") == F.col("name")), "inner").select("node", F.col("key").alias("of"))
    ).distinct()
    chosen = edges.filter(F.col("type").isin(*types)) if types else edges
    out = found.join(chosen, F.col("of") == F.col("src")).select("node", F.col("type").alias("rel"), F.lit("out").alias("direction"), F.col("dst").alias("key"))
    back = found.join(chosen, F.col("of") == F.col("dst")).select("node", F.col("type").alias("rel"), F.lit("in").alias("direction"), F.col("src").alias("key"))
    about = nodes.select("key", "label", F.substring("summary", 1, 100).alias("summary"))
    return out.union(back).distinct().join(about, "key", "left").select("node", "rel", "direction", "label", "key", "summary")


def closure(edges: DataFrame, most: int = 10_000) -> DataFrame:
    """(src, dst): all pairs joined by a path of at most `most` edges; circles are no harm. Each step goes one
    edge on from the pairs that the step before found, and what was known drops out, so every pair is
    joined with the edges once. Steps are as many as the longest of all shortest paths has edges."""
    step, seen = cut_counting(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct(), n=F.count(F.lit(1)))
    onward = step.select(F.col("src").alias("dst"), F.col("dst").alias("_next"))
    known, parts = step, 1
    while seen["n"] and parts < most:
        further = step.join(onward, "dst").select("src", F.col("_next").alias("dst")).distinct().join(known, ["src", "dst"], "left_anti")
        step, seen = cut_counting(further, n=F.count(F.lit(1)))
        known, parts = known.unionByName(step), parts + 1
        if parts % 20 == 0:
            known = cut(known)
    return known


def projection(edges: DataFrame, natural: list[str], undirected: list[str]) -> DataFrame:
    """(src, dst) of the edge types that exist: natural ones once, undirected ones both ways."""
    one = edges.filter(F.col("type").isin(*natural, *undirected)).select("src", "dst")
    other = edges.filter(F.col("type").isin(*undirected)).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return one.union(other) if undirected else one


def pagerank(edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, cut_every: int = 5) -> DataFrame:
    """(node, pagerank) of all ends of edges (src, dst), not normalised: (1 - d) + d times what comes in.
    Repeated edges count repeatedly, and what reaches a node without edges is lost. A node's contributions
    are added up before the shuffle; the lineage is cut every few rounds. No edges give no rows."""
    links = cut(edges.filter("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w")))
    degree = links.groupBy("src").agg(F.sum("w").alias("_out"))
    shares = cut(links.join(degree, "src").select("src", "dst", (F.col("w") / F.col("_out")).alias("share")))
    nodes = cut(links.select(F.col("src").alias("node")).union(links.select("dst")).distinct())
    ranks = nodes.withColumn("pagerank", F.lit(1 - damping))
    for r in range(1, rounds + 1):
        sums = shares.join(ranks.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("share") * F.col("pagerank")).alias("_in"))
        ranks = nodes.join(sums, "node", "left").select("node", (F.lit(1 - damping) + damping * F.coalesce("_in", F.lit(0.0))).alias("pagerank"))
        if r % cut_every == 0 and r < rounds:
            ranks = cut(ranks)
    return ranks
