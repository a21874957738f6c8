"""Connected components by alternating large-star and small-star rounds.

Each round is two keyed aggregations and two joins over the edges; a hub with a third of
all edges is reduced on the map side for its minimum, and the joins that carry its edges can
be split by the planner. Edges are written to the shared folder after every round, so the
plan stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import discard, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest one; an edge may come twice."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest one."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return moved.distinct()


def components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component): each node of ``links`` (a, b) and the smallest node it reaches.

    Nodes without a link are left out. Rows with a null end and loops are ignored.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a <> b").distinct()
    edges = materialise(edges, "edges")
    last = None
    for _ in range(max_rounds):
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == last or not mark.n:
            break
        last = mark
        before, edges = edges, materialise(_small_star(_large_star(edges)), "edges")
        discard(before)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def merged(known: DataFrame, links: DataFrame) -> DataFrame:
    """``known`` (node, component) after further ``links`` (a, b) between components.

    An end of a link is a component of ``known``, or a node that is in none. Only the graph of
    the components is solved, which is small where little was left apart.
    """
    links = materialise(links.select("a", "b"), "apart")
    if links.isEmpty():
        return known
    more = materialise(components(links), "more")
    moved = known.join(more.select(F.col("node").alias("component"), F.col("component").alias("__to")), "component", "left").select("node", F.coalesce("__to", "component").alias("component"))
    fresh = more.join(known.select("node"), "node", "left_anti")
    out = materialise(moved.unionByName(fresh), "known")
    discard(links, more)
    return out
