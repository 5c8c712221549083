"""Scalar expressions of the solver: all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def loop_to_zero(u: Column, v: Column) -> Column:
    """0 for a self-loop, else 1."""
    return F.when(u == v, F.lit(0)).otherwise(F.lit(1))


def soft_threshold(x: Column, k: Column | float) -> Column:
    """sign(x) * max(|x| - k, 0)."""
    k = k if isinstance(k, Column) else F.lit(float(k))
    return F.signum(x) * F.greatest(F.abs(x) - k, F.lit(0.0))


def euclid_shrink(x: Column, k: Column | float, norm: Column) -> Column:
    """0 where norm <= k, else (1 - k / norm) * x."""
    k = k if isinstance(k, Column) else F.lit(float(k))
    return F.when(norm <= k, F.lit(0.0)).otherwise((1 - k / norm) * x)


def euclidean(a: Column, b: Column) -> Column:
    """Distance of two arrays of doubles of one length."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def p_norm(x: Column, p: float) -> Column:
    """Aggregate p-norm of a column."""
    return F.pow(F.sum(F.pow(F.abs(x), F.lit(float(p)))), F.lit(1.0 / p))


def merge_maps(a: Column, b: Column, op=lambda x, y: x + y, default: float = 0.0) -> Column:
    """Outer merge of two maps with a binary operation."""
    return F.map_zip_with(a, b, lambda _, x, y: op(F.coalesce(x, F.lit(default)), F.coalesce(y, F.lit(default))))


def scale_map(a: Column, by: float) -> Column:
    return F.transform_values(a, lambda _, x: x * F.lit(by))


def append(values: Column, x: Column) -> Column:
    """Array with one more entry; a missing one counts as 0."""
    return F.concat(values, F.array(F.coalesce(x, F.lit(0))))


def present(a: Column, b: Column) -> Column:
    """The non-null members of a pair."""
    return F.array_compact(F.array(a, b))


def pair_number(u: Column, v: Column, m: int) -> Column:
    """u * m + v; ``pair_of`` is its inverse for 0 <= v < m."""
    return u * F.lit(m) + v


def pair_of(n: Column, m: int) -> tuple[Column, Column]:
    return F.floor(n / F.lit(m)).cast("long"), n % F.lit(m)


def adapt_rho(rho: float, primal: float, dual: float, mu: float = 10.0, tau: float = 2.0) -> float:
    """Penalty for the next round from the two residuals."""
    if primal > mu * dual:
        return rho * tau
    return rho / tau if dual > mu * primal else rho


def newton_root(a: Column, p: float, steps: int = 12) -> Column:
    """Root of (x / a) ** (p - 1) + x = 1 on [0, min(a, 1)] by Newton's method; 0 where a <= 0.

    For p < 2 the left side is concave and the steps climb from below, for p > 2 it is convex and they come down
    from above, so they neither overshoot nor need a bracket.
    """
    half = F.lit(0.5 if p < 2 else 1.0)
    first = F.least(half, a * F.pow(half, F.lit(1.0 / (p - 1))))

    def better(x: Column, _: Column) -> Column:
        power = F.pow(x / a, F.lit(p - 1.0))
        return x - (power + x - 1) / (F.lit(p - 1.0) * power / x + 1)

    return F.when(a > 0, F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, better)).otherwise(F.lit(0.0))


def bisect_root(a: Column, p: float, steps: int = 60) -> Column:
    """Root of (x / a) ** (p - 1) + x = 1 on [0, min(a, 1)]; 0 where a <= 0.  Fixed number of halvings."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def half(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        low = F.pow(mid / a, F.lit(p - 1.0)) + mid < 1
        return F.struct(F.when(low, mid).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(mid).alias("hi"))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, half)
    return F.when(a > 0, F.least((done["lo"] + done["hi"]) / 2, a)).otherwise(F.lit(0.0))
