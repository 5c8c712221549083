"""How good a matching is, and views of a solver's trace."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .assignment import assignment


def reorder(z: DataFrame, permutation: DataFrame) -> DataFrame:
    """u, v, z with v replaced by the node u' that ``permutation(u, v)`` sends to v, so a perfect matching is the diagonal."""
    back = permutation.select(F.col("u").alias("w"), "v")
    return z.join(back, "v").select("u", F.col("w").alias("v"), "z")


def matching_stats(z: DataFrame, permutation: DataFrame) -> DataFrame:
    """metric, value: ell1_diff = sum |P - I| with absent diagonal entries as 1, and dpm = trace / n."""
    n = permutation.agg(F.count(F.lit(1)).alias("n"))
    flat = reorder(z, permutation)
    on = F.col("u") == F.col("v")
    sums = flat.agg(
        F.coalesce(F.sum(F.when(on, F.abs(F.col("z") - 1)).otherwise(F.abs("z"))), F.lit(0.0)).alias("d"),
        F.count(F.when(on, 1)).alias("there"), F.coalesce(F.sum(F.when(on, F.col("z"))), F.lit(0.0)).alias("trace"),
    ).crossJoin(F.broadcast(n))
    return sums.select(F.lit("ell1_diff").alias("metric"), (F.col("d") + F.col("n") - F.col("there")).alias("value")).union(
        sums.select(F.lit("dpm").alias("metric"), (F.col("trace") / F.col("n")).alias("value"))
    )


def recovered(z: DataFrame, permutation: DataFrame) -> float:
    """Share of the best assignment's pairs that are true ones (DPM-P); 1 - this is the mismatch."""
    n = permutation.count()
    best = assignment(z, "z", maximise=True)
    return best.join(permutation, ["u", "v"], "left_semi").count() / n if n else 0.0


def average(solutions: list[DataFrame]) -> DataFrame:
    """Mean of several solutions; a pair missing in one counts 0 there."""
    every = solutions[0]
    for s in solutions[1:]:
        every = every.union(s)
    return every.groupBy("u", "v").agg((F.sum("z") / len(solutions)).alias("z"))


def trace_transform(trace: DataFrame, lam: float, rho: float) -> DataFrame:
    """iteration, t_min, obj, res of ``trace(iteration, seconds, nolin, lin, residual)``: minutes so far, re-weighted objective, residual / (3 rho)."""
    upto = Window.orderBy("iteration").rowsBetween(Window.unboundedPreceding, 0)
    return trace.select(
        "iteration", (F.sum("seconds").over(upto) / 60).alias("t_min"),
        (F.col("nolin") + F.lit(lam) * F.col("lin")).alias("obj"), (F.col("residual") / F.lit(3 * rho)).alias("res"),
    )
