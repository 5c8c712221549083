"""One-pass greedy partitioning of a bipartite graph ``bip(l, r)``.

A left node goes where most of its second-degree neighbours already are, minus the growth of a convex
size cost.  The pass is sequential by definition, so it runs as one ordered fold over left nodes; what
it keeps is a counter for each (right node, part), and its input is a list of right nodes for each left
one, made in parallel.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(rows: Iterable[tuple[object, list]], parts: int, cost: Callable[[float], float] = lambda x: x * x) -> dict:
    """Left node -> part, in the order of ``rows``; ties go to the lowest part."""
    near: dict = defaultdict(lambda: [0] * parts)
    size, out = [0] * parts, {}
    for left, rights in rows:
        votes = [0] * parts
        for r in rights:
            if r in near:
                votes = [a + b for a, b in zip(votes, near[r])]
        score = [votes[k] - (cost(size[k] + 1) - cost(size[k])) for k in range(parts)]
        best = max(range(parts), key=lambda k: (score[k], -k))
        out[left] = best
        size[best] += 1
        for r in rights:
            near[r][best] += 1
    return out


def stream_partition(bip: DataFrame, parts: int, cost: Callable[[float], float] = lambda x: x * x) -> DataFrame:
    """node, part_id of every left node, taken in the order of their ids."""
    lists = bip.groupBy("l").agg(F.array_sort(F.collect_set("r")).alias("rs"))
    kind = bip.schema["l"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("l")
        got = fold(zip(pdf["l"], (list(r) for r in pdf["rs"])), parts, cost)
        return pd.DataFrame({"node": list(got), "part_id": list(got.values())})

    return lists.withColumn("g", F.lit(1)).groupBy("g").applyInPandas(run, f"node {kind}, part_id int")


def partition_right(bip: DataFrame, left: DataFrame) -> DataFrame:
    """node, part_id of every right node: the part that most of its left nodes have, ties to the lowest."""
    votes = bip.join(left.withColumnRenamed("node", "l"), "l").groupBy("r", "part_id").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy(F.col("r").alias("node")).agg(F.max_by("part_id", F.struct("n", -F.col("part_id"))).alias("part_id"))


def balance(left: DataFrame) -> DataFrame:
    """part_id, size of every part."""
    return left.groupBy("part_id").agg(F.count(F.lit(1)).alias("size"))


def objective_parts(terms: DataFrame, variables: DataFrame) -> DataFrame:
    """i, j, part_id for ``variables(u, v, part_id)``: each objective goes where most of its variables are, ties to the lowest."""
    rows = terms.select("i", "j", "u", "v").distinct().join(variables, ["u", "v"])
    votes = rows.groupBy("i", "j", "part_id").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("i", "j").agg(F.max_by("part_id", F.struct("n", -F.col("part_id"))).alias("part_id"))


def objectives_as_bipartite(terms: DataFrame, inverse: bool = False) -> DataFrame:
    """l, r as text keys: variables to objectives, or objectives to variables if inverse."""
    variable = F.concat_ws(",", F.col("u").cast("string"), F.col("v").cast("string"))
    objective = F.concat_ws(",", F.col("i").cast("string"), F.col("j").cast("string"))
    a, b = (objective, variable) if inverse else (variable, objective)
    return terms.select(a.alias("l"), b.alias("r")).distinct()
