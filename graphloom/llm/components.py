"""Connected components of an edge table: union-find inside each partition, then alternating stars.

Every partition first reduces its edges to a spanning forest by union-find, and once more after partitions
with few edges were put together.  What remains is contracted with the large-star / small-star steps, which only need per-key minima (summed up before
the shuffle) and equi-joins; the few hubs are joined by broadcast, so a hub is never gathered in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, split_join


#: Edges of a partition.
EDGES = 50_000


def find(parent: dict, x):
    root = x
    while parent.get(root, root) != root:
        root = parent[root]
    while parent.get(x, x) != root:
        parent[x], x = root, parent[x]
    return root


def union(parent: dict, a, b) -> None:
    """The smaller root wins."""
    a, b = find(parent, a), find(parent, b)
    parent.setdefault(a, a)
    parent.setdefault(b, b)
    if a < b:
        parent[b] = a
    elif b < a:
        parent[a] = b


def _forest(batches):
    """Spanning forest of a partition's edges; flushed when it has grown to a million nodes."""
    parent: dict = {}

    def flush():
        rows = [(x, find(parent, x)) for x in parent]
        rows = [(x, r) for x, r in rows if x != r]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["a", "b"]
        )

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            union(parent, a, b)
        if len(parent) > 1_000_000:
            yield flush()
            parent.clear()
    if parent:
        yield flush()


def packed(edges: DataFrame, rows: int) -> DataFrame:
    """The edges in no more partitions than their number asks for: few edges in many would be many small files."""
    return edges.coalesce(max(4, -(-rows // EDGES)))


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """``edges(a, b)`` -> ``(node, component_id)`` for every node with an edge to another node.

    ``component_id`` is the smallest node reachable.  Loops and repeated edges are harmless; an
    empty table gives an empty result.  Stops when a round changes nothing; with ``rounds`` it raises
    RuntimeError where so many rounds are not enough, and never returns an unfinished grouping.
    """
    now = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    now = cut(now.mapInArrow(_forest, "a long, b long"))
    now = cut(packed(now, now.count()).mapInArrow(_forest, "a long, b long"))
    mark, done = None, 0
    while True:
        n = 2 * now.count()
        both = packed(now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b"))), n)
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = split_join(both.where("b > a"), low, "a", "n", n).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(packed(large.where("a <> b"), n).distinct())
        large = packed(large, n)
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = split_join(large, low, "a", "n", n).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(packed(small.union(low.select("a", F.col("m").alias("b"))).where("a <> b"), n).distinct())
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark, done = seen, done + 1
        if rounds is not None and done >= rounds:
            raise RuntimeError(f"components are not settled after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component_id")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component_id")).distinct()
    )


def small_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable for 0..n-1 from in-memory edges (one leaf or block)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
    return root
