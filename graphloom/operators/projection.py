"""Projections and proximal operators over keyed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import euclid_shrink, newton_root, soft_threshold
from ..plans.loop import settle


def simplex(rows: DataFrame, by: str | tuple[str, ...], x: str, out: str, radius: float = 1.0, ties: tuple[str, ...] = ("u", "v")) -> DataFrame:
    """Euclidean projection of each group onto {y >= 0, sum y = radius}.

    Sorted descending, theta is the largest of (running sum - radius) / rank; y = max(x - theta, 0).
    """
    by = (by,) if isinstance(by, str) else by
    order = Window.partitionBy(*by).orderBy(F.col(x).desc(), *ties)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("_c", (F.sum(x).over(upto) - F.lit(radius)) / F.row_number().over(order))
    theta = F.max("_c").over(Window.partitionBy(*by))
    return ranked.withColumn(out, F.greatest(F.col(x) - theta, F.lit(0.0))).drop("_c")


def prox_l1(rows: DataFrame, x: str, rho: float, out: str = "y") -> DataFrame:
    """Soft threshold at 1 / rho."""
    return rows.withColumn(out, soft_threshold(F.col(x), 1.0 / rho))


def prox_l2(rows: DataFrame, x: str, rho: float, out: str = "y") -> DataFrame:
    """Shrinkage of the whole column at 1 / rho; its norm is one aggregate row beside every entry."""
    norm = rows.agg(F.sqrt(F.sum(F.col(x) * F.col(x))).alias("_norm"))
    return rows.crossJoin(F.broadcast(norm)).withColumn(out, euclid_shrink(F.col(x), 1.0 / rho, F.col("_norm"))).drop("_norm")


def _entry(n: Column, norm: Column, p: float) -> Column:
    """|y|: root of |y| + norm ** (1 - p) |y| ** (p - 1) = n for n >= 0."""
    # With y = n x, the equation is x + (x / a) ** (p - 1) = 1.
    return n * newton_root(norm * F.pow(n, F.lit((2 - p) / (p - 1))), p)


def prox_p(rows: DataFrame, x: str, p: float, rho: float, out: str = "y", passes: int = 100) -> DataFrame:
    """Prox of the p-norm (p > 1) with penalty rho: argmin ||y||_p + rho / 2 ||y - x||^2.

    Zero if the dual norm of rho x is 1 at most.  Otherwise the norm of the solution is the root of a decreasing
    function, found by Newton's method inside a bracket: each pass is one aggregate that gives the
    function and its slope, and each entry is solved by a fixed number of steps.  The input is read once for each pass, so
    it is settled first.
    """
    if p <= 1:
        raise ValueError("p must exceed 1; use prox_l1 for the 1-norm")
    rows = settle(rows)
    q, power = p / (p - 1), F.lit(float(p))
    n = F.abs(F.col(x)) * F.lit(float(rho))
    head = rows.agg(F.sum(F.pow(n, F.lit(q))).alias("dual"), F.pow(F.sum(F.pow(n, power)), F.lit(1.0 / p)).alias("top")).first()
    if head["dual"] is None or head["dual"] <= 1:
        return rows.withColumn(out, F.lit(0.0))
    lo, hi = 0.0, head["top"]
    at = hi / 2
    for _ in range(passes):
        y = _entry(n, F.lit(at), p)
        held = rows.where(F.col(x) != 0).select(y.alias("_y"))
        # d y / d norm for y + norm ** (1 - p) y ** (p - 1) = n
        slope = F.lit(p - 1.0) * F.pow(F.col("_y") / F.lit(at), power - 1) / (F.lit(at) * (1 / F.lit(at) * F.lit(p - 1.0) * F.pow(F.col("_y") / F.lit(at), power - 2) + 1))
        s, t = held.where("_y > 0").agg(F.sum(F.pow("_y", power)), F.sum(F.pow("_y", power - 1) * slope)).first()
        s, t = s or 0.0, t or 0.0
        norm = s ** (1 / p)
        lo, hi = (at, hi) if norm > at else (lo, at)
        if abs(norm - at) <= 1e-13 * at or hi - lo <= 1e-14 * hi:
            break
        step = at - (norm - at) / ((norm / s * t if s else 0.0) - 1)
        at = step if lo < step < hi else (lo + hi) / 2
    else:
        raise RuntimeError(f"the norm of the prox is not found after {passes} passes")
    return rows.withColumn(out, F.signum(F.col(x)) * F.when(n > 0, _entry(n, F.lit(at), p)).otherwise(F.lit(0.0)) / F.lit(float(rho)))
