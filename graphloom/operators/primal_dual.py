"""The linear program min ||AP - PB||_1 + sum d P over doubly stochastic P on a support.

As a saddle point it reads: P >= 0 against one multiplier in [-1, 1] for each objective and a free one for each
row and column.  Primal-dual rounds with diagonal step sizes need only sums over the sparse terms: what the
multipliers say about a variable, and what the variables make of an objective, a row and a column.  Nothing is
factorised or collected; a duality gap tells how far off a run is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.loop import iterate, settle
from .objective import coefficients


def initial(support: DataFrame, terms: DataFrame, cost: DataFrame | None = None) -> dict[str, DataFrame]:
    """State tables: p even in every row, multipliers 0, and step sizes one over the sums of |coefficients|.

    a(i, j, u, v, a) is constant; p(u, v, d, step, p), w(i, j, step, w), r(u, step, m) and c(v, step, m) move.
    A pair without a cost costs 0.
    """
    a = settle(coefficients(terms))
    pairs = support.select("u", "v").distinct()
    pairs = pairs.withColumn("d", F.lit(0.0)) if cost is None else pairs.join(cost.select("u", "v", "d"), ["u", "v"], "left").na.fill(0.0, ["d"])
    weight = a.groupBy("u", "v").agg(F.sum(F.abs("a")).alias("_s"))
    rows, columns = (pairs.groupBy(k).agg((F.lit(1.0) / F.count(F.lit(1))).alias("step")) for k in ("u", "v"))
    p = pairs.join(weight, ["u", "v"], "left").join(rows.withColumnRenamed("step", "p"), "u")
    return {
        "a": a,
        "p": settle(p.select("u", "v", "d", (1 / (F.coalesce("_s", F.lit(0.0)) + 2)).alias("step"), "p")),
        "w": a.groupBy("i", "j").agg((1 / F.sum(F.abs("a"))).alias("step")).withColumn("w", F.lit(0.0)),
        "r": rows.withColumn("m", F.lit(0.0)), "c": columns.withColumn("m", F.lit(0.0)),
    }


def reduced(state: dict[str, DataFrame]) -> DataFrame:
    """p with ``excess``: the cost of a variable less what the multipliers of its objectives, row and column pay for."""
    slope = state["a"].join(state["w"].select("i", "j", "w"), ["i", "j"]).groupBy("u", "v").agg(F.sum(F.col("a") * F.col("w")).alias("_g"))
    on = state["p"].join(slope, ["u", "v"], "left")
    on = on.join(state["r"].select("u", F.col("m").alias("_r")), "u").join(state["c"].select("v", F.col("m").alias("_c")), "v")
    return on.select("u", "v", "d", "step", "p", (F.col("d") + F.coalesce("_g", F.lit(0.0)) - F.col("_r") - F.col("_c")).alias("excess"))


def step(state: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """One round: a step of P, then of the multipliers at the extrapolated P."""
    moved = reduced(state).withColumn("new", F.greatest(F.lit(0.0), F.col("p") - F.col("step") * F.col("excess")))
    far = settle(moved.select("u", "v", "d", "step", F.col("new").alias("p"), (2 * F.col("new") - F.col("p")).alias("far")))
    f = state["a"].join(far.select("u", "v", "far"), ["u", "v"]).groupBy("i", "j").agg(F.sum(F.col("a") * F.col("far")).alias("_f"))
    w = state["w"].join(f, ["i", "j"])
    w = w.select("i", "j", "step", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("w") + F.col("step") * F.col("_f"))).alias("w"))
    sums = {}
    for k, name in (("u", "r"), ("v", "c")):
        total = far.groupBy(k).agg(F.sum("far").alias("_s"))
        sums[name] = state[name].join(total, k).select(k, "step", (F.col("m") + F.col("step") * (1 - F.col("_s"))).alias("m"))
    return {"a": state["a"], "p": far.drop("far"), "w": w, **sums}


def gap(state: dict[str, DataFrame]) -> DataFrame:
    """One row: primal (value at P), dual (a lower bound of the optimum) and infeasible (how far a row or column sum is from 1).

    The bound holds for any multipliers: what is left of a row's cheapest variable is charged to the row.
    """
    p = state["p"]
    f = state["a"].join(p.select("u", "v", "p"), ["u", "v"]).groupBy("i", "j").agg(F.abs(F.sum(F.col("a") * F.col("p"))).alias("x"))
    rows = reduced(state).groupBy("u").agg(F.least(F.lit(0.0), F.min("excess")).alias("x"))
    parts = [
        f.select(F.lit("primal").alias("k"), "x"), p.select(F.lit("primal").alias("k"), (F.col("d") * F.col("p")).alias("x")),
        rows.select(F.lit("dual").alias("k"), "x"), state["r"].select(F.lit("dual").alias("k"), F.col("m").alias("x")), state["c"].select(F.lit("dual").alias("k"), F.col("m").alias("x")),
        *[p.groupBy(k).agg(F.abs(F.sum("p") - 1).alias("x")).select(F.lit("sums").alias("k"), "x") for k in ("u", "v")],
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    total = lambda k: F.coalesce(F.sum(F.when(F.col("k") == k, F.col("x"))), F.lit(0.0)).alias(k)
    return every.agg(total("primal"), total("dual"), F.coalesce(F.max(F.when(F.col("k") == "sums", F.col("x"))), F.lit(0.0)).alias("infeasible"))


def solve(state: dict[str, DataFrame], rounds: int, tol: float = 0.0, check: int = 20) -> dict[str, DataFrame]:
    """Run the rounds; with ``tol`` until gap (relative) and infeasibility are at most that, looked at every ``check`` rounds.

    RuntimeError where the rounds are not enough for ``tol``.
    """
    for done in range(0, rounds, check):
        state = iterate(state, lambda now, _: step(now), min(check, rounds - done), settled=frozenset({"a", "p"}))
        if tol:
            g = gap(state).first()
            if abs(g["primal"] - g["dual"]) <= tol * (1 + abs(g["primal"])) and g["infeasible"] <= tol:
                return state
    if tol:
        raise RuntimeError(f"the gap is {g['primal'] - g['dual']:.3g} and the sums are off by {g['infeasible']:.3g} after {rounds} rounds")
    return state
