"""Proximal steps of the objective blocks.

With one block for each objective the step has a closed form that stays in Catalyst.  Larger blocks go
through ``applyInArrow``-style grouped kernels on dense matrices: one block is one group, and its size is
what ``block_ids`` deals to it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CLOSED = ("l1", "l2", "ls")


def closed_form(block: DataFrame, kind: str, rho: float, rho_in: float = 1.0) -> DataFrame:
    """Adds p to ``block(i, j, u, v, a, zbar)`` (``ls`` also reads y and ups of the objective).

    With m = a.a and s = a.zbar: l2 p = zbar - a s / (rho + m); l1 p = zbar - a / rho clip(rho s / m, -1, 1);
    ls the least-squares step towards y + ups.
    """
    own = Window.partitionBy("i", "j")
    if kind == "ls":
        block = block.withColumn("zbar", F.col("zbar") + F.lit(rho_in / rho) * F.col("a") * (F.col("y") + F.col("ups")))
    m, s = F.sum(F.col("a") * F.col("a")).over(own), F.sum(F.col("a") * F.col("zbar")).over(own)
    if kind == "l2":
        step = s / (F.lit(rho) + m)
    elif kind == "l1":
        step = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.lit(rho) * s / m)) / F.lit(rho)
    elif kind == "ls":
        step = F.lit(rho_in) * s / (F.lit(rho) + F.lit(rho_in) * m)
    else:
        raise ValueError(f"unknown block step {kind}")
    return block.withColumn("p", F.col("zbar") - F.col("a") * step)


def block_ids(coefficients: DataFrame, blocks: int) -> DataFrame:
    """Deals objectives to blocks by a hash; all terms of an objective stay together."""
    return coefficients.withColumn("block_id", F.pmod(F.xxhash64("i", "j"), F.lit(blocks)).cast("int"))


def placed(coefficients: DataFrame, placement: DataFrame) -> DataFrame:
    """Deals objectives to the blocks that ``placement(i, j, part_id)`` names; one that it does not name is an error."""
    parts = placement.select("i", "j", F.col("part_id").cast("int").alias("block_id")).dropDuplicates(["i", "j"])
    out = coefficients.join(parts, ["i", "j"], "left")
    lost = out.where("block_id is null").select("i", "j").distinct().count()
    if lost:
        raise ValueError(f"{lost} objectives have no part")
    return out


def copies_of(coefficients: DataFrame) -> DataFrame:
    """block_id, u, v: the variables that each block holds a copy of."""
    return coefficients.select("block_id", "u", "v").distinct()


def copy_counts(coefficients: DataFrame) -> DataFrame:
    """One row: blocks, objectives, variables, copies of them in all blocks, and copies in the largest block."""
    each = copies_of(coefficients).groupBy("block_id").agg(F.count(F.lit(1)).alias("n"))
    size = each.agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("copies"), F.max("n").alias("largest"))
    many = coefficients.agg(F.count_distinct("i", "j").alias("objectives"), F.count_distinct("u", "v").alias("variables"))
    return many.crossJoin(F.broadcast(size))  # one row each


def dense(pdf: pd.DataFrame) -> tuple[np.ndarray, pd.DataFrame, pd.DataFrame]:
    """Matrix D (objectives x variables) of a block with the order of both."""
    row = pdf.groupby(["i", "j"], sort=True).ngroup().to_numpy()
    col = pdf.groupby(["u", "v"], sort=True).ngroup().to_numpy()
    d = np.zeros((row.max() + 1, col.max() + 1))
    np.add.at(d, (row, col), pdf["a"].to_numpy())
    variables = pdf.drop_duplicates(["u", "v"]).sort_values(["u", "v"])
    objectives = pdf[["i", "j"]].drop_duplicates().sort_values(["i", "j"])
    return d, variables, objectives


def solve_l2(d: np.ndarray, zbar: np.ndarray, rho: float) -> np.ndarray:
    """argmin 1/2 ||D x||^2 + rho / 2 ||x - zbar||^2; the smaller of the two normal systems is solved."""
    m, n = d.shape
    if m < n:
        return zbar - d.T @ np.linalg.solve(rho * np.eye(m) + d @ d.T, d @ zbar)
    return np.linalg.solve(rho * np.eye(n) + d.T @ d, rho * zbar)


def solve_ls(d: np.ndarray, zbar: np.ndarray, target: np.ndarray, rho: float, rho_in: float) -> np.ndarray:
    """argmin rho / 2 ||x - zbar||^2 + rho_in / 2 ||D x - target||^2."""
    return zbar + d.T @ np.linalg.solve(rho / rho_in * np.eye(len(d)) + d @ d.T, target - d @ zbar)


def solve_l1(d: np.ndarray, zbar: np.ndarray, rho: float, sweeps: int = 2000) -> np.ndarray:
    """argmin ||D x||_1 + rho / 2 ||x - zbar||^2, by the path of its dual from infinity down to 1 / rho.

    The path is finite and exact, and checked by the duality gap; where rounding in a degenerate D spoils it,
    coordinate sweeps go on from the best dual found, and RuntimeError is raised if the gap stays open.
    """
    x, w = dual_path(d, zbar, 1 / rho)
    return x if gap(d, x, w) <= 1e-9 * (1 + np.abs(d @ x).sum()) else sweep_l1(d, zbar, rho, sweeps)


def gap(d: np.ndarray, x: np.ndarray, w: np.ndarray) -> float:
    """||D x||_1 - w'Dx, plus what |w| exceeds 1 by: 0 where x = zbar - D'w / rho is the solution."""
    f = d @ x
    return float(np.abs(f).sum() - w @ f + np.maximum(np.abs(w) - 1, 0).sum())


def dual_path(d: np.ndarray, zbar: np.ndarray, end: float, eps: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """x and w, |w| <= 1, of min 1/2 ||x - zbar||^2 + end ||D x||_1; x = zbar - end D'w.

    The dual min ||zbar - D'm|| over |m| <= t is followed down from t = infinity.  Rows with |m| = t are on the
    boundary with their sign, the others solve a least-squares problem, so that m = a - t b between kinks.  A row
    joins the boundary when |a - t b| reaches t, and leaves it when its value in D x is about to change its sign.
    """
    rows = len(d)
    sign = np.zeros(rows)  # 0: not on the boundary
    scale = eps * (1 + np.abs(zbar).sum())
    t, came = np.inf, -1
    for _ in range(20 * rows + 20):
        free, held = np.flatnonzero(sign == 0), np.flatnonzero(sign)
        pull = d[held].T @ sign[held]
        a, b = np.linalg.lstsq(d[free].T, np.c_[zbar, pull], rcond=1e-12)[0].T if len(free) else np.zeros((2, 0))
        joins = np.zeros(len(free))
        for s in (1.0, -1.0):
            speed = 1 + s * b
            ready = (speed > eps) & (s * a > scale)
            joins[ready] = np.maximum(joins[ready], np.minimum(s * a[ready] / speed[ready], t))
        # Values in D x of the rows on the boundary, as c - t e.
        c = sign[held] * (d[held] @ (zbar - d[free].T @ a))
        e = sign[held] * (d[held] @ (pull - d[free].T @ b))
        leaves, ready = np.zeros(len(held)), (c < -scale) & (e < -scale) & (held != came)
        leaves[ready] = np.minimum(c[ready] / e[ready], t)
        join, leave = joins.max(initial=0.0), leaves.max(initial=0.0)
        if max(join, leave) <= end:
            m = np.zeros(rows)
            m[held], m[free] = end * sign[held], a - end * b
            return zbar - d.T @ m, m / end
        if join >= leave:
            k = int(joins.argmax())
            t, came = join, free[k]
            sign[came] = 1.0 if a[k] - t * b[k] > 0 else -1.0
        else:
            t, came = leave, -1
            sign[held[leaves.argmax()]] = 0.0
    return zbar.copy(), np.zeros(rows)


def sweep_l1(d: np.ndarray, zbar: np.ndarray, rho: float, sweeps: int = 2000, tol: float = 1e-12) -> np.ndarray:
    """The same minimum by minimising the dual's coordinates in turn; RuntimeError if the gap stays open."""
    w, x = np.zeros(len(d)), zbar.copy()
    size = (d * d).sum(axis=1)
    for _ in range(sweeps):
        moved = 0.0
        for k in np.flatnonzero(size):
            new = min(1.0, max(-1.0, w[k] + rho * (d[k] @ x) / size[k]))
            if new != w[k]:
                x -= d[k] * ((new - w[k]) / rho)
                moved = max(moved, abs(new - w[k]))
                w[k] = new
        if moved < tol:
            break
    else:
        left = gap(d, x, w)
        if left > 1e-5 * (1 + np.abs(d @ x).sum()):
            raise RuntimeError(f"the l1 block is not solved after {sweeps} sweeps; its duality gap is {left:.3g}")
    return x


def block_step(block: DataFrame, kind: str, rho: float) -> DataFrame:
    """block_id, u, v, p of ``block(block_id, i, j, u, v, a, zbar)`` by the dense kernel ``kind``: l1 or l2.

    The p-norm is one norm over all blocks and has no step of its own here: see ``pnorm``.
    """
    if kind not in ("l1", "l2"):
        raise ValueError(f"unknown dense block step {kind}")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        d, variables, _ = dense(pdf)
        zbar = variables["zbar"].to_numpy()
        x = solve_l2(d, zbar, rho) if kind == "l2" else solve_l1(d, zbar, rho)
        return variables[["block_id", "u", "v"]].assign(p=x)

    kinds = {f.name: f.dataType.simpleString() for f in block.schema.fields}
    return block.groupBy("block_id").applyInPandas(solve, f"block_id int, u {kinds['u']}, v {kinds['v']}, p double")
