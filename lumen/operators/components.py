"""Connected components of a graph given as edges, by alternating star contraction (Kiveris et al., 2014).

Each round is two windows over the edges, or with hubs two aggregations and two joins; the number of rounds grows with the
logarithm of the longest path. Nothing is gathered by the driver but three numbers a round, which say whether all is done;
rounds are cut by durable tables. The edges of a hub are dealt to many tasks when its least neighbour is joined back.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumen.plans.durable import join_hot, stored


#: Edges of a node that one task takes in any case.
HUB = 4096


def _large_star(edges: DataFrame, n: int, hubs: bool) -> DataFrame:
    """Every larger neighbour is tied to the smallest neighbour (the node itself included)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if hubs:
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        joined = join_hot(both, least.select("a", "m"), "a", least, 2 * n, F.xxhash64("b"), HUB)
    else:
        joined = both.withColumn("m", F.least(F.min("b").over(Window.partitionBy("a")), "a"))
    return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, n: int, hubs: bool) -> DataFrame:
    """Every node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    if hubs:
        least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        tied = join_hot(down, least.select("a", "m"), "a", least, n, F.xxhash64("b"), HUB)
        return tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
    tied = down.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    return tied.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple[int, int, int]:
    """Edges, the most that one node has, and nodes that keep the graph from being stars around their smallest nodes."""
    ends = edges.select(F.greatest("a", "b").alias("node"), F.lit(1).alias("up")).union(edges.select(F.least("a", "b"), F.lit(0)))
    by_node = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count("*").alias("n"))
    return tuple(x or 0 for x in by_node.agg(F.sum("ups"), F.max("n"), F.count_if((F.col("ups") > 1) | ((F.col("ups") == 1) & (F.col("n") > 1)))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge to another; root is the smallest node of its component.

    Edges with a null end and loops count for nothing; repeated edges and either order of the ends are the same edge;
    no edges give no rows. Raises if the rounds do not suffice, which 2 ** 30 nodes in a row would need.
    """
    now = stored(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    for _ in range(most_rounds):
        n, most, left = _state(now)
        if not left:
            # A star's edges lead from its nodes to its root, whichever end is written first.
            return now.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).union(now.select(F.least("a", "b"), F.least("a", "b")).distinct())
        now = stored(_small_star(_large_star(now, n, most > HUB), n, most > HUB))
    raise RuntimeError("components: no end after the given number of rounds")


def merged(known: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) after new edges (a, b): groups (node, root) that an edge ties become one, which keeps the smallest root.

    Only groups and new edges meet, the edges inside the groups are not needed: each end is replaced by its group's root,
    and the components of what is left say which roots are one. Nodes that `known` lacks are groups of their own.
    """
    root = lambda c: known.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    new = stored(edges.select("a", "b").where("a is not null and b is not null"))
    ties = new.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    moved = stored(components(ties))
    ends = new.select(F.col("a").alias("node")).union(new.select(F.col("b").alias("node"))).distinct()
    every = known.select("node", "root").unionByName(ends.join(known, "node", "left_anti").select("node", F.col("node").alias("root")))
    return every.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span what the pairs (a, b) connect: at most one for each end."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]
