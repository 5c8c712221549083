"""The objectives under one p-norm: min ||Y||_p + rho / 2 sum |P - Zbar|^2 with Y = D P.

The norm is taken over the objectives of all blocks, so it does not matter how they are dealt.  Y is split
off and solved for by an inner ADMM: dual ascent and the prox of the norm on one row for each objective,
least squares on the copies of each block.  Y and its scaled dual Upsilon are tables that an alignment run carries
from one outer round to the next.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.loop import settle
from . import projection
from .blocks import closed_form, dense, solve_ls


def own(table: DataFrame) -> list[str]:
    """Columns that name an objective: with its block, where blocks hold several."""
    return [*(["block_id"] if "block_id" in table.columns else []), "i", "j"]


def values(copies: DataFrame, a: DataFrame) -> DataFrame:
    """block_id (if any), i, j, f: every objective's sum of coefficients times copies.

    One-objective blocks hold the coefficient ``a`` beside the copy; else it is joined from ``a``.
    """
    rows = copies if "a" in copies.columns else a.join(copies.select("block_id", "u", "v", "p"), ["block_id", "u", "v"])
    return rows.groupBy(*own(rows)).agg(F.sum(F.col("a") * F.col("p")).alias("f"))


def start(copies: DataFrame, a: DataFrame) -> DataFrame:
    """Y at the values of the first copies, Upsilon 0."""
    f = values(copies, a)
    return f.select(*own(f), F.col("f").alias("y"), F.lit(0.0).alias("ups"))


def prox(rows: DataFrame, x: str, p: float, rho: float, out: str) -> DataFrame:
    """Prox of the p-norm of the whole column; ``rows`` should be settled."""
    if p == 1:
        return projection.prox_l1(rows, x, rho, out)
    return projection.prox_l2(rows, x, rho, out) if p == 2 else projection.prox_p(rows, x, p, rho, out)


def least_squares(copies: DataFrame, a: DataFrame, target: DataFrame, rho: float, rho_in: float) -> DataFrame:
    """The copies with p = argmin rho / 2 |p - zbar|^2 + rho_in / 2 |D p - (y + ups)|^2, block by block."""
    if "a" in copies.columns:
        near = copies.drop("p").join(target.select("i", "j", "y", "ups"), ["i", "j"])
        # closed_form moves zbar towards the target; the given one is kept for the next round.
        return closed_form(near.withColumn("_zbar", F.col("zbar")), "ls", rho, rho_in).drop("zbar", "y", "ups").withColumnRenamed("_zbar", "zbar")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        d, variables, _ = dense(pdf)
        aim = pdf.drop_duplicates(["i", "j"]).sort_values(["i", "j"])["aim"].to_numpy()
        return variables[["block_id", "u", "v"]].assign(p=solve_ls(d, variables["zbar"].to_numpy(), aim, rho, rho_in))

    rows = a.join(copies.select("block_id", "u", "v", "zbar"), ["block_id", "u", "v"])
    rows = rows.join(target.select("block_id", "i", "j", (F.col("y") + F.col("ups")).alias("aim")), ["block_id", "i", "j"])
    kinds = {f.name: f.dataType.simpleString() for f in a.schema.fields}
    solved = rows.groupBy("block_id").applyInPandas(solve, f"block_id int, u {kinds['u']}, v {kinds['v']}, p double")
    return copies.drop("p").join(solved, ["block_id", "u", "v"])


def solve(
    copies: DataFrame, y: DataFrame, a: DataFrame, p: float, rho: float, rho_in: float, rounds: int, tol: float = 0.0, alpha: float = 1.0
) -> tuple[DataFrame, DataFrame]:
    """The copies and ``y(i, j, y, ups)`` after the inner rounds.

    ``copies`` have zbar and the p to go on from.  With ``tol`` the rounds end when |Y - D P| and what Y and P move by are
    under it, and RuntimeError is raised where ``rounds`` are not enough; without, all rounds are run.
    """
    for _ in range(rounds):
        f = values(copies, a)
        now = f.join(y, own(f)).withColumn("ups", F.col("ups") + F.lit(alpha) * (F.col("y") - F.col("f"))).withColumn("n", F.col("f") - F.col("ups"))
        now = settle(now)
        new = prox(now, "n", p, rho_in, "_y")
        y = new.select(*own(f), F.col("_y").alias("y"), "ups")
        keys = [c for c in ("block_id", "i", "j", "u", "v") if c in copies.columns]
        before = copies.select(*keys, F.col("p").alias("_old"))
        copies = settle(least_squares(copies, a, y, rho, rho_in))
        if tol:
            primal, dual = (x or 0.0 for x in new.agg(*[F.sqrt(F.sum(F.pow(c, F.lit(2.0)))) for c in (F.col("y") - F.col("f"), F.col("_y") - F.col("y"))]).first())
            dual += copies.join(before, keys).agg(F.sqrt(F.sum(F.pow(F.col("p") - F.col("_old"), F.lit(2.0))))).first()[0] or 0.0
            if primal < tol and dual < tol:
                return copies, y
    if tol:
        raise RuntimeError(f"the p-norm step is not solved after {rounds} inner rounds (residuals {primal:.3g} and {dual:.3g}, tolerance {tol:.3g})")
    return copies, y
