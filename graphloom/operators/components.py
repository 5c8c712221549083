"""Connected components by hooking and shortcutting: every node points to a smaller one until all point to the smallest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.loop import settle
from .graph import nodes, symmetrise


def connected_components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """node, component: the smallest node that can be reached, edges taken both ways.

    A round sends the pointers' pointers over the edges: a node and what it points to take the smallest that
    arrives (minima are combined before the shuffle, so hubs and large components gather in no task), then
    pointers are shortened.  Ends when a round changes nothing; RuntimeError where ``rounds`` are not enough.
    """
    both = settle(symmetrise(edges.select("src", "dst").where("src <> dst")))
    f = settle(nodes(edges).select("node", F.col("node").alias("root")))
    for _ in range(rounds):
        up = f.select(F.col("node").alias("root"), F.col("root").alias("grand"))
        g = settle(f.join(up, "root").select("node", "root", "grand"))
        low = both.join(g.select(F.col("node").alias("dst"), "grand"), "dst").groupBy("src").agg(F.min("grand").alias("low"))
        near = low.join(g.select(F.col("node").alias("src"), "root"), "src")
        sent = near.select(F.explode(F.array("src", "root")).alias("node"), "low").union(g.select("node", "grand"))
        new = settle(sent.groupBy("node").agg(F.min("low").alias("root")))
        moved = new.join(f.withColumnRenamed("root", "old"), "node").where("root <> old").isEmpty()
        f = new
        if moved:
            return f.select("node", F.col("root").alias("component"))
    raise RuntimeError(f"components are not settled after {rounds} rounds")


def is_connected(edges: DataFrame) -> bool:
    return connected_components(edges).select("component").distinct().limit(2).count() <= 1
