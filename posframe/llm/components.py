"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posframe.llm.common import Scratch


def components(edges: DataFrame, rounds: int = 60, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the least node that
    can be reached. Other columns of edges are ignored; loops and repeated edges
    do no harm; an empty list has no components.

    Alternates hooking each node's larger neighbours to its least one with
    hooking its smaller neighbours (the star method), so the number of rounds
    grows with the logarithm of the longest chain. Each round's edges go to a
    written table; nothing of them reaches the driver but their number and sum.
    A hot node is no hot task: the aggregates combine before they shuffle, and
    the joins are plain equi-joins that AQE can split. The table that the result
    reads is one of `scratch`, which deletes it with its others.
    """
    ab = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    own = Scratch(edges.sparkSession)
    state = own.stored(ab)
    before = None
    for _ in range(rounds):
        # large star: neighbours larger than a node are tied to the least of its neighbours and itself
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        # small star: a node and its smaller neighbours are tied to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        state = own.kept(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    if scratch:
        scratch.made += own.made
    nodes = state.select("a", "b")
    return nodes.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(nodes.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
