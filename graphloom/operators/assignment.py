"""Frank-Wolfe and linear assignment."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.loop import settle
from .objective import gradient, linear_cost, value

#: Largest side of an assignment problem; it is solved in memory, so its size is checked.
LARGEST = 5000


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row at least total cost (rows <= columns), by shortest augmenting paths with potentials."""
    n, m = cost.shape
    row_of = np.full(m, -1)
    pot_r, pot_c = np.zeros(n), np.zeros(m)
    for start in range(n):
        dist, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, base, col = start, 0.0, -1
        while True:
            slack = base + cost[row] - pot_r[row] - pot_c
            better = ~done & (slack < dist)
            dist[better], via[better] = slack[better], row
            open_ = np.where(done, np.inf, dist)
            col = int(open_.argmin())
            done[col], base = True, dist[col]
            if row_of[col] < 0:
                break
            row = row_of[col]
        reached = np.flatnonzero(done)
        gain = base - dist[reached]
        owners = row_of[reached]
        pot_r[owners[owners >= 0]] += gain[owners >= 0]
        pot_r[start] += base
        pot_c[reached] -= gain
        while True:  # flip the path
            row = via[col]
            row_of[col], col = row, int(np.flatnonzero(row_of == row)[0]) if row != start else -1
            if row == start:
                break
    out = np.full(n, -1)
    out[row_of[row_of >= 0]] = np.flatnonzero(row_of >= 0)
    return out


def assignment(cost: DataFrame, x: str = "d", maximise: bool = False, perfect: bool = False) -> DataFrame:
    """u, v of the best matching of ``cost(u, v, x)`` that leaves as few nodes out as can be.

    Only given pairs are matched, whatever they cost: a missing pair costs more than all given ones together.
    ``perfect`` raises ValueError where a node of the larger side's size stays without a partner.
    """
    spark = cost.sparkSession
    n = [cost.agg(F.countDistinct(c)).first()[0] for c in "uv"]
    if max(n) > LARGEST:
        raise ValueError(f"an assignment of {max(n)} nodes does not fit in memory; the bound is {LARGEST}")
    rows = cost.select("u", "v", F.col(x).cast("double").alias("d")).toArrow()
    at_u, at_v = (rows.column(c).combine_chunks().dictionary_encode() for c in "uv")
    us, vs = at_u.dictionary.to_pylist(), at_v.dictionary.to_pylist()
    size = max(len(us), len(vs))
    d = rows.column("d").to_numpy() * (-1.0 if maximise else 1.0)
    given = np.zeros((size, size), bool)
    c = np.full((size, size), 2 * np.abs(d).sum() + 1)
    i, j = at_u.indices.to_numpy(), at_v.indices.to_numpy()
    given[i, j], c[i, j] = True, d
    found = assign(c) if size else []
    pairs = [(us[i], vs[j]) for i, j in enumerate(found) if given[i, j]]
    if perfect and len(pairs) < size:
        raise ValueError(f"the pairs hold no perfect matching: {len(pairs)} of {size} nodes can be matched")
    return spark.createDataFrame(pairs, cost.select("u", "v").schema)


def frank_wolfe(terms: DataFrame, z: DataFrame, p: float = 2.5, rounds: int = 10, cost: DataFrame | None = None, lam: float = 0.0) -> tuple[DataFrame, list[dict]]:
    """z after ``rounds`` steps of size 1 / (t + 2) towards the best assignment, and a trace.

    Steps go to perfect matchings of z's pairs, so a doubly stochastic z stays one; ValueError where there is
    none.  The trace has the norm (obj_nolin), the norm plus lam times the linear cost (obj) and the gap.
    """
    trace = []
    for t in range(rounds):
        g = settle(full_gradient(terms, z, p, cost, lam))
        best = assignment(g, "g", perfect=True).withColumn("s", F.lit(1.0))
        both = settle(z.join(g, ["u", "v"]).join(best, ["u", "v"], "left").select("u", "v", "z", "g", F.coalesce("s", F.lit(0.0)).alias("s")))
        norm = value(terms, z, p).first()[0] or 0.0
        linear = 0.0 if cost is None else linear_cost(z.select("u", "v"), cost, z).first()[0] or 0.0
        trace.append({"iteration": t, "obj_nolin": norm, "obj": norm + lam * linear, "gap": gap(both).first()[0]})
        size = 1.0 / (t + 2)
        z = both.select("u", "v", ((1 - size) * F.col("z") + size * F.col("s")).alias("z"))
    return z, trace


def full_gradient(terms: DataFrame, z: DataFrame, p: float, cost: DataFrame | None = None, lam: float = 0.0) -> DataFrame:
    g = z.select("u", "v").join(gradient(terms, z, p), ["u", "v"], "left").select("u", "v", F.coalesce("g", F.lit(0.0)).alias("g"))
    if cost is None:
        return g
    return g.join(cost, ["u", "v"], "left").select("u", "v", (F.col("g") + F.lit(lam) * F.coalesce("d", F.lit(0.0))).alias("g"))


def gap(rows: DataFrame) -> DataFrame:
    """<z - s, g> as one row."""
    return rows.agg(F.sum((F.col("z") - F.col("s")) * F.col("g")).alias("value"))
