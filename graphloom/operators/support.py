"""Candidate pairs ``support(u, v)``: u of graph 1, v of graph 2."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import degree_counts, nodes, ring_sizes, wl_colors


def all_pairs(edges1: DataFrame, edges2: DataFrame) -> DataFrame:
    """Every pair of nodes: the one place where the result itself is a cross product."""
    return nodes(edges1).select(F.col("node").alias("u")).crossJoin(nodes(edges2).select(F.col("node").alias("v")))


def match_colors(colors1: DataFrame, colors2: DataFrame, color: str = "color") -> DataFrame:
    a, b = colors1.select(F.col("node").alias("u"), color), colors2.select(F.col("node").alias("v"), color)
    return a.join(b, color).select("u", "v")


def by_degree(edges1: DataFrame, edges2: DataFrame, offset: int = 0) -> DataFrame:
    """Pairs whose degrees differ by 2 * offset at most: the band is spread on one side of an equi-join, so no pair comes twice."""
    a = degree_counts(edges1).select(F.col("node").alias("u"), F.explode(F.sequence(F.col("deg") - 2 * offset, F.col("deg") + 2 * offset)).alias("deg"))
    return a.join(degree_counts(edges2).select(F.col("node").alias("v"), "deg"), "deg").select("u", "v")


def by_wl(edges1: DataFrame, edges2: DataFrame, depth: int = 10) -> DataFrame:
    return match_colors(wl_colors(edges1, depth), wl_colors(edges2, depth))


def by_rings(edges1: DataFrame, edges2: DataFrame, k: int = 10) -> DataFrame:
    """Equal ring-size vectors."""

    def vector(e):
        r = ring_sizes(e, k)
        return r.select("node", F.array(*[c for c in r.columns if c != "node"]).alias("color"))

    return match_colors(vector(edges1), vector(edges2))


def by_colors(colors1: DataFrame, colors2: DataFrame) -> DataFrame:
    """Equal sets of outside colours: ``colors(node, colors array)``."""

    def as_set(c):
        return c.select("node", F.array_sort(F.array_distinct("colors")).alias("color"))

    return match_colors(as_set(colors1), as_set(colors2))


def equalised(edges1: DataFrame, edges2: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The smaller graph padded with self-loops on ids n_small .. n_large - 1, and the identity pairs (u, v) of those ids."""
    spark = edges1.sparkSession
    n1, n2 = nodes(edges1).count(), nodes(edges2).count()
    kind = edges1.schema["src"].dataType
    pad = spark.range(min(n1, n2), max(n1, n2)).select(F.col("id").cast(kind).alias("src"), F.col("id").cast(kind).alias("dst"))
    first = edges1.select("src", "dst").union(pad) if n1 < n2 else edges1
    second = edges2.select("src", "dst").union(pad) if n2 < n1 else edges2
    return first, second, pad.select(F.col("src").alias("u"), F.col("dst").alias("v"))
