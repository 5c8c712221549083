"""Sinks: Parquet for tables, text for exchange formats.  A write replaces what was there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").parquet(path)


def edge_list(edges: DataFrame, path: str) -> None:
    edges.select(F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string")).alias("value")).write.mode("overwrite").text(path)


def pairs(support: DataFrame, path: str) -> None:
    value = F.format_string("('%s', '%s')", F.col("u").cast("string"), F.col("v").cast("string"))
    support.select(value.alias("value")).write.mode("overwrite").text(path)


def costs(cost: DataFrame, path: str) -> None:
    value = F.concat(F.format_string("(('%s', '%s'), ", F.col("u").cast("string"), F.col("v").cast("string")), F.col("d").cast("string"), F.lit(")"))
    cost.select(value.alias("value")).write.mode("overwrite").text(path)


def matrix(cells: DataFrame, path: str) -> None:
    """Tab-separated matrix of ``cells(row, col, val)``, one file, rows in order; absent cells are 0."""
    width = cells.agg(F.max("col")).first()[0]
    held = F.map_from_entries(F.collect_list(F.struct("col", "val")))
    rows = cells.groupBy("row").agg(held.alias("m"))
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(width)), lambda c: F.coalesce(F.col("m")[c.cast("int")], F.lit(0.0)).cast("string")), "\t")
    rows.orderBy("row").coalesce(1).select(line.alias("value")).write.mode("overwrite").text(path)


def partition_map(parts: DataFrame, path: str) -> None:
    """A JSON object ``{"('u', 'v')": part}`` on each line for ``parts(u, v, part_id)``, as ``readers.partition_map`` reads it."""
    key = F.format_string("('%s', '%s')", F.col("u").cast("string"), F.col("v").cast("string"))
    parts.select(F.to_json(F.create_map(key, F.col("part_id"))).alias("value")).write.mode("overwrite").text(path)


def weights(rows: DataFrame, path: str) -> None:
    """Lines ``i j w``, as ``readers.weights`` reads them."""
    rows.select(F.concat_ws(" ", F.col("i").cast("string"), F.col("j").cast("string"), F.col("w").cast("string")).alias("value")).write.mode("overwrite").text(path)


def permutation(mapping: DataFrame, path: str) -> None:
    """Lines ``u v`` of a matching."""
    edge_list(mapping.select(F.col("u").alias("src"), F.col("v").alias("dst")), path)


def trace(rows: DataFrame, path: str) -> None:
    """iteration, metric, value; one folder for each iteration, appended."""
    rows.write.mode("append").partitionBy("iteration").parquet(path)


def graph_export(edges: DataFrame, features: DataFrame, classes: DataFrame, prefix: str, split: DataFrame | None = None, walks: DataFrame | None = None) -> None:
    """A graph with its features under one prefix.

    -G: edges; -nodes: node, val, test (``split(node, val)``; without one all are for training); -id_map: node, row,
    its row in the features, by the order of nodes; -class_map: node and class; -feats: row and features; -walks:
    pairs ``start item`` as lines.
    """
    from ..operators.ranks import ranked

    rows = ranked(features.select("node", "features"), "node", out="row", start=0)
    flags = rows.select("node")
    flags = flags.withColumn("val", F.lit(False)) if split is None else flags.join(split.select("node", "val"), "node", "left").na.fill(False, ["val"])
    edges.write.mode("overwrite").json(f"{prefix}-G")
    flags.withColumn("test", F.lit(False)).write.mode("overwrite").json(f"{prefix}-nodes")
    rows.select("node", "row").write.mode("overwrite").json(f"{prefix}-id_map")
    classes.write.mode("overwrite").json(f"{prefix}-class_map")
    rows.select("row", "features").write.mode("overwrite").parquet(f"{prefix}-feats")
    if walks is not None:
        edge_list(walks.select(F.col("start").alias("src"), F.col("item").alias("dst")), f"{prefix}-walks")
