"""Readers of the text formats that graphs come in.  Nothing is evaluated; lines are parsed by patterns."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def edge_list(spark: SparkSession, path: str) -> DataFrame:
    """src, dst as text: blank-separated pairs; lines with # or % anywhere, or without exactly two tokens, are left out."""
    token = F.split(F.trim(F.col("value")), r"\s+")
    lines = spark.read.text(path).where(~F.col("value").rlike("[#%]")).select(token.alias("t")).where(F.size("t") == 2)
    return lines.select(F.col("t")[0].alias("src"), F.col("t")[1].alias("dst"))


def _item(n: int) -> str:
    return r"\s*,\s*".join([r"'?([^',()\[\]\s]+)'?"] * n)


def pairs(spark: SparkSession, path: str, names: tuple[str, str] = ("u", "v")) -> DataFrame:
    """Lines ``(a, b)`` or ``('a', 'b')``; other lines are left out."""
    pattern = r"^\s*\(\s*" + _item(2) + r"\s*\)\s*$"
    rows = spark.read.text(path).where(F.col("value").rlike(pattern))
    return rows.select(*[F.regexp_extract("value", pattern, i + 1).alias(c) for i, c in enumerate(names)])


def costs(spark: SparkSession, path: str) -> DataFrame:
    """u, v, d from lines ``(('u', 'v'), d)``."""
    pattern = r"^\s*\(\s*\(\s*" + _item(2) + r"\s*\)\s*,\s*([-+0-9.eE]+)\s*\)\s*$"
    rows = spark.read.text(path).where(F.col("value").rlike(pattern))
    return rows.select(*[F.regexp_extract("value", pattern, i).alias(c) for i, c in ((1, "u"), (2, "v"))], F.regexp_extract("value", pattern, 3).cast("double").alias("d"))


def features(spark: SparkSession, path: str) -> DataFrame:
    """node, features from lines ``('node', [a, b, ...])`` or ``node a b ...``."""
    literal = r"^\s*\(\s*'?([^',\s]+)'?\s*,\s*\[(.*)\]\s*\)\s*$"
    lines = spark.read.text(path).where("length(trim(value)) > 0")
    named = F.col("value").rlike(literal)
    plain = F.split(F.trim(F.col("value")), r"\s+")
    node = F.when(named, F.regexp_extract("value", literal, 1)).otherwise(plain[0])
    body = F.when(named, F.split(F.regexp_extract("value", literal, 2), r"\s*,\s*")).otherwise(F.slice(plain, 2, F.greatest(F.size(plain) - 1, F.lit(0))))
    return lines.select(node.alias("node"), F.transform(F.filter(body, lambda x: F.length(F.trim(x)) > 0), lambda x: F.trim(x).cast("double")).alias("features"))


def objectives(spark: SparkSession, path: str) -> DataFrame:
    """i, j, u, v, sign from lines ``(('i','j'), ([('k','j'), ...], [('i','k'), ...]))``."""
    head = r"^\s*\(\s*\(\s*" + _item(2) + r"\s*\)\s*,\s*\(\s*\[(.*)\]\s*,\s*\[(.*)\]\s*\)\s*\)\s*$"
    one = r"\(\s*" + _item(2) + r"\s*\)"
    rows = spark.read.text(path).where(F.col("value").rlike(head))
    sides = [
        rows.select(
            F.regexp_extract("value", head, 1).alias("i"), F.regexp_extract("value", head, 2).alias("j"),
            F.explode(F.regexp_extract_all(F.regexp_extract("value", head, g), F.lit(one), F.lit(0))).alias("x"), F.lit(sign).alias("sign"),
        ) for g, sign in ((3, 1), (4, -1))
    ]
    both = sides[0].union(sides[1])
    return both.select("i", "j", F.regexp_extract("x", one, 1).alias("u"), F.regexp_extract("x", one, 2).alias("v"), "sign")


def colors(spark: SparkSession, path: str) -> DataFrame:
    """node, colors from a JSON object of lists."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("node", "colors"))


def partition_map(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """u, v, part_id from JSON objects whose keys are ``('u', 'v')``, one or more on each line; ``whole``: one that spans lines."""
    pattern = r"\(\s*" + _item(2) + r"\s*\)"
    rows = spark.read.text(path, wholetext=whole).select(F.explode(F.from_json("value", "map<string,int>")).alias("k", "part_id"))
    return rows.select(F.regexp_extract("k", pattern, 1).alias("u"), F.regexp_extract("k", pattern, 2).alias("v"), "part_id")


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """row, col, val of a blank-separated matrix; rows are numbered in the order of the file's lines (one file)."""
    token = F.split(F.trim(F.col("value")), r"\s+")
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), r"\r?\n")).alias("row", "value"))
    return lines.select("row", F.posexplode(token).alias("col", "val")).withColumn("val", F.col("val").cast("double"))


def matlab(spark: SparkSession, path: str) -> DataFrame:
    """u, v, z from lines ``col row val`` that count from 1."""
    token = F.split(F.trim(F.col("value")), r"\s+")
    rows = spark.read.text(path).select(token.alias("t")).where(F.size("t") == 3)
    return rows.select((F.col("t")[1].cast("int") - 1).alias("u"), (F.col("t")[0].cast("int") - 1).alias("v"), F.col("t")[2].cast("double").alias("z"))


def numpy_rows(spark: SparkSession, array: np.ndarray) -> DataFrame:
    """node (row number as text), features."""
    return spark.createDataFrame([(str(i), [float(x) for x in row]) for i, row in enumerate(array)], "node string, features array<double>")


def weights(spark: SparkSession, path: str) -> DataFrame:
    """i, j, w from Parquet or from lines ``i j w``."""
    if re.search(r"\.parquet/?$", path):
        return spark.read.parquet(path).select("i", "j", "w")
    token = F.split(F.trim(F.col("value")), r"\s+")
    return spark.read.text(path).select(token.alias("t")).where(F.size("t") == 3).select(
        F.col("t")[0].cast("int").alias("i"), F.col("t")[1].cast("int").alias("j"), F.col("t")[2].cast("double").alias("w")
    )


def trace(spark: SparkSession, path: str) -> DataFrame:
    """iteration, metric, value as ``writers.trace`` appends them."""
    return spark.read.parquet(path).select("iteration", "metric", "value")


def solution(spark: SparkSession, path: str) -> DataFrame:
    """u, v, z of a start or solution: Parquet, or lines ``(('u', 'v'), z)``."""
    if re.search(r"\.parquet/?$", path):
        return spark.read.parquet(path).select("u", "v", "z")
    return costs(spark, path).withColumnRenamed("d", "z")


def graph_matrix(edges: DataFrame, directed: bool = False) -> DataFrame:
    """row, col, val of the adjacency matrix of ``edges(src, dst)``, or of ``(i, j, w)`` with weights.

    Cells that stand several times keep the largest; an undirected matrix takes the larger of a cell and its mirror.
    """
    weighted = "w" in edges.columns
    cells = edges.select(F.col("i" if weighted else "src").alias("row"), F.col("j" if weighted else "dst").alias("col"), (F.col("w").cast("double") if weighted else F.lit(1.0)).alias("val"))
    both = cells if directed else cells.union(cells.select(F.col("col").alias("row"), F.col("row").alias("col"), "val"))
    return both.groupBy("row", "col").agg(F.max("val").alias("val"))
