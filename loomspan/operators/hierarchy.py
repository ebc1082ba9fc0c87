"""Parent-child links to full hierarchies, with the circles among them (problem 2).

Leaves are peeled from the bottom: a node without unpeeled children sends its subtree size to its
parent and drops out. What never becomes a leaf lies on a circle. In reverse order of peeling the
paths, depths and roots go down again. Descendants are rows (ancestor, descendant, distance) made
from the paths: a list per ancestor has no bound where one root holds a third of all nodes.

Each wave is one small job over the nodes still unpeeled, whose number falls geometrically in any
bushy forest; the work of the way down is the sum of the nodes' heights.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.common import blank, current_rows, cut_counting, spill, spilled_table

KEYS = ["node_table", "node_key"]
_PARENT = ["node_table", "parent_key"]
FEW = 100_000  # unpeeled nodes that one task goes on with


def live_links(df: DataFrame, node_table: str, key: str, parent: str) -> DataFrame:
    """(node_table, node_key, parent_key) of the live keys of a versioned table; blank parents are null."""
    return (
        current_rows(df, key, parent)
        .filter("live")
        .select(
            F.lit(node_table).alias("node_table"),
            F.col(key).alias("node_key"),
            F.when(~blank(F.col(parent)), F.col(parent)).alias("parent_key"),
        )
    )


class Peeled:
    """waves: DataFrames (node_table, node_key, parent_key, subtree_size), leaves first; residual: the
    nodes on circles with their parent_key and subtree_size so far."""

    def __init__(self, waves: list[DataFrame], residual: DataFrame, n_residual: int):
        self.waves, self.residual, self.n_residual = waves, residual, n_residual


def _wave(state: DataFrame, wave: int) -> DataFrame:
    """One wave over state (KEYS, parent_key, subtree_size, unpeeled, wave): leaves get their number as
    wave and send their size. One shuffle, in which messages are added up before they travel."""
    own = f"struct(node_key, struct(parent_key) AS link, subtree_size, unpeeled, CASE WHEN leaf THEN {wave} ELSE wave END AS wave)"
    message = "struct(parent_key AS node_key, CAST(NULL AS struct<parent_key:string>) AS link, subtree_size, CAST(-1 AS bigint) AS unpeeled, CAST(NULL AS int) AS wave)"
    sent = state.selectExpr("*", "wave IS NULL AND unpeeled = 0 AS leaf").selectExpr("node_table", f"inline(CASE WHEN leaf AND parent_key IS NOT NULL THEN array({own}, {message}) ELSE array({own}) END)")
    summed = sent.groupBy(*KEYS).agg(*map(F.expr, ("max(link) AS link", "sum(subtree_size) AS subtree_size", "sum(unpeeled) AS unpeeled", "max(wave) AS wave")))
    return summed.filter("link IS NOT NULL").selectExpr(*KEYS, "link.parent_key", "subtree_size", "unpeeled", "wave")  # messages to parents that aren't nodes drop out


def peel(links: DataFrame, single_waves: int = 3, waves_a_job: int = 8) -> Peeled:
    """Bottom-up peeling of links (node_table, node_key, parent_key), node_key unique in node_table.

    A parent that isn't a node makes its child a root. Messages are added up per parent before they
    are shuffled, so that a parent of a third of all nodes gets one row per task. After the first
    waves, which drop most nodes, several waves share a job, and once no more than FEW nodes are left
    they are kept in one task, which needs no shuffle; neither changes a result.
    """
    nodes = links.select(*KEYS, "parent_key")
    totals = (
        nodes.filter(F.col("parent_key").isNotNull())
        .groupBy("node_table", F.col("parent_key").alias("node_key"))
        .agg(F.count(F.lit(1)).alias("unpeeled"))
    )
    open_ = F.col("wave").isNull()
    stats = {"n": F.count(F.when(open_, 1)), "leaves": F.count(F.when(open_ & (F.col("unpeeled") == 0), 1))}
    state, seen = cut_counting(
        nodes.join(totals, KEYS, "left").select(
            *KEYS, "parent_key", F.lit(1).cast("long").alias("subtree_size"),
            F.coalesce("unpeeled", F.lit(0).cast("long")).alias("unpeeled"), F.lit(None).cast("int").alias("wave"),
        ),
        **stats,
    )
    waves: list[DataFrame] = []
    while seen["leaves"]:
        first = len(waves)
        few = seen["n"] <= FEW
        n = 1 if first < single_waves and not few else waves_a_job
        state = state.filter(open_).coalesce(1) if few else state.filter(open_)
        for k in range(n):
            state = _wave(state, first + k)
        state, seen = cut_counting(state, **stats)
        waves += [state.filter(F.col("wave") == first + k).drop("unpeeled", "wave") for k in range(n)]
    return Peeled(waves, state.filter(open_).drop("unpeeled", "wave"), seen["n"])


def cycles(peeled: Peeled) -> DataFrame:
    """(node_table, node_key, cycle_key) of the nodes on circles; cycle_key is the smallest key of the
    circle by bytes. Windows of 1, 2, 4, ... steps are joined until none of their minima changes."""
    at = peeled.residual.select(*KEYS, F.col("parent_key").alias("next"), F.col("node_key").alias("least"))
    if not peeled.n_residual:
        return at.select(*KEYS, F.col("least").alias("cycle_key"))
    for _ in range(math.ceil(math.log2(peeled.n_residual + 1)) + 1):
        ahead = at.select("node_table", F.col("node_key").alias("next"), F.col("next").alias("_next"), F.col("least").alias("_least"))
        at, seen = cut_counting(
            at.join(ahead, ["node_table", "next"]).select(
                *KEYS,
                F.col("_next").alias("next"),
                F.least("least", "_least").alias("least"),
                (F.col("_least") < F.col("least")).alias("changed"),
            ),
            changed=F.count(F.when(F.col("changed"), 1)),
        )
        at = at.drop("changed")
        if not seen["changed"]:
            break
    return at.select(*KEYS, F.col("least").alias("cycle_key"))


def hierarchy(links: DataFrame, waves_a_job: int = 3) -> DataFrame:
    """node_table, node_key, parent_key, root_key, depth, path (root first, itself last), subtree_size,
    height, on_cycle, cycle_key: one row per node.

    Roots have depth 0. A node on a circle has on_cycle and the circle's key as root, depth 0 and a
    path of itself; nodes below a circle hang from it and have its key as root. A parent that isn't
    live leaves its child a root with that parent_key. height is that of the tree below a node, null on
    circles. An empty table gives no rows.

    On the way down each node is read once, with the wave of its parent, and written once, under its own
    wave, so work grows with the nodes and not with the depth. Several waves share a job.
    """
    peeled = peel(links)
    top, n = cycles(peeled), len(peeled.waves)
    nodes = peeled.residual.withColumn("height", F.lit(n))
    for wave, rows in enumerate(peeled.waves):
        nodes = nodes.unionByName(rows.withColumn("height", F.lit(wave)))
    parents = nodes.select("node_table", F.col("node_key").alias("parent_key"), F.col("height").alias("above"))
    waiting = spill(nodes.filter(F.col("height") < n).join(parents, _PARENT, "left").withColumn("above", F.coalesce("above", F.lit(-1))), "waiting", ["above"])
    none = F.lit(None).cast("string")
    roots = waiting.filter("above = -1").select(
        *KEYS, "parent_key", F.col("node_key").alias("root_key"), F.lit(0).alias("depth"), F.array("node_key").alias("path"), "subtree_size", F.lit(False).alias("on_cycle"), none.alias("cycle_key"), "height"
    )
    circles = peeled.residual.join(top, KEYS).select(
        *KEYS, "parent_key", F.col("cycle_key").alias("root_key"), F.lit(0).alias("depth"), F.array("node_key").alias("path"), "subtree_size", F.lit(True).alias("on_cycle"), "cycle_key", F.lit(n).alias("height")
    )

    def below(above: DataFrame, wave: int) -> DataFrame:
        given = above.select("node_table", F.col("node_key").alias("parent_key"), F.col("root_key").alias("_root"), F.col("depth").alias("_depth"), F.col("path").alias("_path"))
        return waiting.filter(F.col("above") == wave).join(given, _PARENT).select(
            *KEYS, "parent_key", F.col("_root").alias("root_key"), (F.col("_depth") + 1).alias("depth"), F.concat("_path", F.array("node_key")).alias("path"), "subtree_size",
            F.lit(False).alias("on_cycle"), none.alias("cycle_key"), "height",
        )

    placed, done = spilled_table(roots.unionByName(circles), "placed", ["height"])
    for first in range(n, 0, -waves_a_job):
        fresh: list[DataFrame] = []
        for wave in range(first, max(0, first - waves_a_job), -1):
            above = done().filter(F.col("height") == wave)
            for rows in fresh:
                above = above.unionByName(rows.filter(F.col("height") == wave))
            fresh.append(below(above, wave))
        job = fresh[0]
        for rows in fresh[1:]:
            job = job.unionByName(rows)
        placed(job)
    out = done()
    return out.withColumn("height", F.when(~F.col("on_cycle"), F.col("height")))


def descendants(tree: DataFrame) -> DataFrame:
    """(node_table, ancestor_key, descendant_key, distance): every pair of a node and one below it, by
    the paths of hierarchy(); no join and no list without bound."""
    up = F.expr("transform(slice(path, 1, size(path) - 1), (a, i) -> struct(a AS ancestor_key, size(path) - 1 - i AS distance))")
    return tree.select("node_table", F.explode(up).alias("a"), F.col("node_key").alias("descendant_key")).select(
        "node_table", "a.ancestor_key", "descendant_key", "a.distance"
    )
