"""Connected components by randomised contraction, as joins and minima only.

Each round, every node points at the member of its closed neighbourhood with
the least keyed hash, and edges are rewritten to the nodes pointed at. A fresh
key each round makes the number of nodes shrink by a constant factor in
expectation, whatever the shape of the graph (a long chain included). Minima
combine before the shuffle, so a hub costs no task more than any other node.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def _canonical(edges: DataFrame) -> DataFrame:
    return (
        edges.filter(F.col("u") != F.col("v"))
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .distinct()
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(u, v) of one integral type -> (node, root), one row per node with an edge.

    Nodes have the same root if and only if a path joins them. The root is one
    of the component's nodes, not the smallest. Repeated edges and loops change
    nothing; null ends are dropped; no edges give no rows.
    """
    edges = stash(_canonical(edges.select("u", "v").dropna()), "edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        key = F.lit(len(maps) + 1)
        rank = lambda c: F.struct(F.xxhash64(F.col(c), key).alias("h"), F.col(c).alias("n"))
        both = edges.select("u", "v").union(edges.select("v", "u"))
        points = both.groupBy("u").agg(F.min(rank("v")).alias("m"))
        points = stash(points.select(F.col("u").alias("node"), F.least(rank("u"), F.col("m"))["n"].alias("rep")), "points")
        maps.append(points)
        to = lambda c: points.select(F.col("node").alias(c), F.col("rep").alias("r" + c))
        moved = edges.join(to("u"), "u").join(to("v"), "v").select(F.col("ru").alias("u"), F.col("rv").alias("v"))
        edges = stash(_canonical(moved), "edges")
    if not maps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))

    def follow(later: DataFrame, points: DataFrame) -> DataFrame:
        later = later.select(F.col("node").alias("rep"), "root")
        joined = points.join(later, "rep", "left")
        return stash(joined.select("node", F.coalesce("root", "rep").alias("root")), "roots")

    last = maps[-1].select("node", F.col("rep").alias("root"))
    return reduce(follow, reversed(maps[:-1]), last)
