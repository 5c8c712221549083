"""Graph alignment by consensus ADMM on DataFrames.

Three families read the same Z: rows and columns (projected onto the simplex) and objective blocks
(prox of the norm).  Z is the weighted mean of all copies.  The state lives in tables; a round settles the
families and then Z, each once, and the coefficients never.  A run can stop by its residuals, write a trace,
and dump its state every few rounds to be taken up again.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import adapt_rho
from ..plans.loop import iterate, settle
from ..sources import writers
from . import blocks, pnorm, projection
from .objective import coefficients


@dataclass
class Options:
    norm: str = "l2"
    rho_p: float = 1.0
    rho_q: float = 1.0
    rho_t: float = 1.0
    alpha: float = 1.0
    lam: float = 1.0
    rho_in: float = 1.0
    #: For norm "p": the norm, inner rounds at most, their tolerance (0: run them all) and dual step.
    p: float = 1.5
    inner: int = 100
    inner_tol: float = 1e-6
    alpha_in: float = 1.0
    #: None: one closed-form block for each objective; else the number of dense blocks.
    blocks: int | None = None
    #: Dense blocks by a table (i, j, part_id) in place of a hash.
    placement: DataFrame | None = None
    adapt: bool = False
    #: Stop when every primal residual and the dual residual are at most this (0: run all rounds).
    tol: float = 0.0
    trace: list[dict] = field(default_factory=list)

    @property
    def dense(self) -> bool:
        return bool(self.blocks) or self.placement is not None


def initial(support: DataFrame, terms: DataFrame, n2: int, cost: DataFrame | None = None, options: Options | None = None) -> dict[str, DataFrame]:
    """All primals 1 / n2, all duals 0; a pair without a cost has cost 0."""
    options = options or Options()
    start, zero = F.lit(1.0 / n2), F.lit(0.0)
    pairs = support.select("u", "v").distinct()
    if cost is None:
        priced = pairs.withColumn("d", zero)
    else:
        priced = pairs.join(cost.select("u", "v", "d"), ["u", "v"], "left").select("u", "v", F.coalesce("d", zero).alias("d"))
    a = coefficients(terms)
    if options.dense:
        a = settle(blocks.block_ids(a, options.blocks) if options.placement is None else blocks.placed(a, options.placement))
        copies = blocks.copies_of(a)
    else:
        copies = a.select("i", "j", "u", "v", "a")
    copies = copies.withColumn("p", start).withColumn("phi", zero)
    split = {"y": pnorm.start(copies, a)} if options.norm == "p" else {}
    return {
        "z": priced.select("u", "v", start.alias("z")),
        "q": priced.select("u", "v", "d", start.alias("q"), zero.alias("xi")),
        "t": priced.select("u", "v", "d", start.alias("t"), zero.alias("psi")),
        "p": copies,
        "a": a,
        **split,
    }


def _family(rows: DataFrame, z: DataFrame, by: str, x: str, dual: str, rho: float, o: Options) -> DataFrame:
    on = rows.join(z, ["u", "v"]).withColumn(dual, F.col(dual) + F.lit(o.alpha) * (F.col(x) - F.col("z")))
    on = on.withColumn("zbar", F.col("z") - F.col(dual) - F.lit(0.5 * o.lam / rho) * F.col("d"))
    return projection.simplex(on, by, "zbar", x).select("u", "v", "d", x, dual)


def _blocks(state: dict[str, DataFrame], o: Options) -> dict[str, DataFrame]:
    """New copies p, and for the p-norm y."""
    on = state["p"].join(state["z"], ["u", "v"]).withColumn("phi", F.col("phi") + F.lit(o.alpha) * (F.col("p") - F.col("z")))
    on = on.withColumn("zbar", F.col("z") - F.col("phi")).drop("z")
    if o.norm == "p":
        p, y = pnorm.solve(settle(on), state["y"], state["a"], o.p, o.rho_p, o.rho_in, o.inner, o.inner_tol, o.alpha_in)
        return {"p": p.drop("zbar"), "y": settle(y)}
    on = on.drop("p")
    if not o.dense:
        return {"p": settle(blocks.closed_form(on, o.norm, o.rho_p, o.rho_in).drop("zbar"))}
    dealt = state["a"].join(on, ["block_id", "u", "v"])
    solved = blocks.block_step(dealt, o.norm, o.rho_p)
    return {"p": settle(on.drop("zbar").join(solved, ["block_id", "u", "v"]))}


def step(state: dict[str, DataFrame], o: Options) -> dict[str, DataFrame]:
    z = state["z"]
    # Settled before Z is made of them, so that no family is computed twice.
    q = settle(_family(state["q"], z, "u", "q", "xi", o.rho_q, o))
    t = settle(_family(state["t"], z, "v", "t", "psi", o.rho_t, o))
    own = _blocks(state, o)
    p = own["p"]
    parts = [
        q.select("u", "v", (F.col("q") + F.col("xi")).alias("x"), F.lit(o.rho_q).alias("rho")),
        t.select("u", "v", (F.col("t") + F.col("psi")).alias("x"), F.lit(o.rho_t).alias("rho")),
        p.select("u", "v", (F.col("p") + F.col("phi")).alias("x"), F.lit(o.rho_p).alias("rho")),
    ]
    every = parts[0].union(parts[1]).union(parts[2])
    mean = F.sum(F.col("x") * F.col("rho")) / F.sum("rho")
    return {"z": every.groupBy("u", "v").agg(mean.alias("z")), "q": q, "t": t, "a": state["a"], **own}


def align(
    state: dict[str, DataFrame], rounds: int, options: Options | None = None, folder: str | None = None, every: int = 10, done: int = 0
) -> dict[str, DataFrame]:
    """Run ``rounds`` rounds, or fewer with ``tol``; ``adapt`` lets the penalties follow each family's residuals.

    With ``adapt``, ``tol`` or ``folder`` the residuals of each round go to options.trace.  With ``folder`` (a
    shared one) they are appended to its trace as well, and the state is dumped every ``every`` rounds;
    ``done`` is the number of rounds that the given state has behind it.
    """
    o = options or Options()
    watched = o.adapt or o.tol > 0 or folder is not None
    small = False

    def one(now, n):
        nonlocal small
        new = step(now, o)
        if watched:
            new["z"] = settle(new["z"])
            r = {x["metric"]: x["value"] for x in residuals(now, new, o).collect()}
            small = o.tol > 0 and max(r.values()) <= o.tol
            if o.adapt:
                o.rho_p, o.rho_q, o.rho_t = (adapt_rho(x, r[k], r["dual"]) for x, k in ((o.rho_p, "pres"), (o.rho_q, "qres"), (o.rho_t, "tres")))
            o.trace.append({"iteration": done + n, **r})
            if folder is not None:
                spark = new["z"].sparkSession
                writers.trace(spark.createDataFrame([(done + n, k, float(v)) for k, v in r.items()], "iteration int, metric string, value double"), f"{folder}/trace")
                if (n + 1) % every == 0 or n + 1 == rounds or small:
                    dump(new, folder, done + n + 1, o)
        return new

    fixed = frozenset({"q", "t", "p", "y", "a", *(["z"] if watched else [])})
    return iterate(state, one, rounds, (lambda old, new: small) if o.tol > 0 else None, settled=fixed)


def residuals(old: dict[str, DataFrame], new: dict[str, DataFrame], o: Options | None = None) -> DataFrame:
    """metric, value: primal residuals of the new primals against the old Z, and the copy-weighted dual residual."""
    o = o or Options()
    moved = new["z"].join(old["z"].withColumnRenamed("z", "old"), ["u", "v"]).withColumn("dz", F.col("z") - F.col("old"))
    out, dual = None, None
    for name, table, x, rho in (("pres", "p", "p", o.rho_p), ("qres", "q", "q", o.rho_q), ("tres", "t", "t", o.rho_t)):
        copies = new[table].select("u", "v", F.col(x).alias("x")).join(moved, ["u", "v"])
        r = copies.agg(F.sqrt(F.sum(F.pow(F.col("x") - F.col("old"), F.lit(2.0)))).alias("value"), (F.lit(rho) * F.sqrt(F.sum(F.col("dz") * F.col("dz")))).alias("d"))
        row = r.select(F.lit(name).alias("metric"), "value", "d")
        out = row if out is None else out.union(row)
    dual = out.agg(F.sum("d").alias("value")).select(F.lit("dual").alias("metric"), "value")
    return out.select("metric", "value").union(dual)


def block_stats(old: dict[str, DataFrame], new: dict[str, DataFrame], o: Options | None = None) -> DataFrame:
    """metric, mean, least, most over the blocks of one round from ``old`` to ``new``.

    variables, objectives: copies and objectives of a block; pobj: its objectives at the new copies (half the
    squares, absolute values, or p-th powers, added up); rhoerr: rho / 2 times the squared distance of the copies
    from where they were drawn to; proximalobj: both; zobj: its objectives at the old Z.
    """
    o = o or Options()
    block = ["block_id"] if o.dense else ["i", "j"]
    near = new["p"].join(old["z"].select("u", "v", "z"), ["u", "v"]).withColumn("err", F.pow(F.col("p") - F.col("z") + F.col("phi"), F.lit(2.0)))
    own = near.groupBy(*block).agg(F.count_distinct("u", "v").cast("double").alias("variables"), (F.lit(o.rho_p / 2) * F.sum("err")).alias("rhoerr"))
    rows = near if not o.dense else new["a"].join(near.drop("a"), ["block_id", "u", "v"])
    f = rows.groupBy(*dict.fromkeys([*block, "i", "j"])).agg(F.sum(F.col("a") * F.col("p")).alias("f"), F.sum(F.col("a") * F.col("z")).alias("g"))
    power, half = {"l1": (1.0, 1.0), "l2": (2.0, 0.5), "p": (o.p, 1.0)}[o.norm]
    cost = [(F.lit(half) * F.sum(F.pow(F.abs(x), F.lit(power)))).alias(name) for x, name in (("f", "pobj"), ("g", "zobj"))]
    each = own.join(f.groupBy(*block).agg(F.count(F.lit(1)).cast("double").alias("objectives"), *cost), block).withColumn("proximalobj", F.col("pobj") + F.col("rhoerr"))
    names = ["variables", "objectives", "pobj", "rhoerr", "proximalobj", "zobj"]
    long = each.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("x")) for n in names])).alias("s")).select("s.*")
    return long.groupBy("metric").agg(F.avg("x").alias("mean"), F.min("x").alias("least"), F.max("x").alias("most"))


def simplex_condition(z: DataFrame, by: str) -> DataFrame:
    """Least and largest row (by u) or column (by v) sum."""
    sums = z.groupBy(by).agg(F.sum("z").alias("s"))
    return sums.agg(F.min("s").alias("min_sum"), F.max("s").alias("max_sum"))


def positivity(z: DataFrame) -> DataFrame:
    return z.agg(F.avg((F.col("z") >= 0).cast("double")).alias("frac"))


def family_stats(rows: DataFrame, by: str, x: str) -> DataFrame:
    """Entries below 0 and above 1, and groups that sum to more than 1."""
    sums = rows.groupBy(by).agg(F.sum(x).alias("s"), F.sum((F.col(x) < 0).cast("long")).alias("neg"), F.sum((F.col(x) > 1).cast("long")).alias("big"))
    return sums.agg(F.sum("neg").alias("vars_lt_zero"), F.sum("big").alias("vars_gt_one"), F.sum((F.col("s") > 1 + 1e-9).cast("long")).alias("groups_gt_one"))


def save(state: dict[str, DataFrame], folder: str) -> None:
    for name, df in state.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def resume(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a saved state: y is there for the p-norm only."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/y")
    split = ["y"] if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at) else []
    return {name: spark.read.parquet(f"{folder}/{name}") for name in ("z", "q", "t", "p", "a", *split)}


def dump(state: dict[str, DataFrame], folder: str, done: int, o: Options) -> None:
    """The state after ``done`` rounds with its penalties; listed in the folder's log once it is whole."""
    at = f"{folder}/round-{done:06d}"
    save(state, at)
    row = [(done, at, o.rho_p, o.rho_q, o.rho_t)]
    state["z"].sparkSession.createDataFrame(row, "done int, path string, rho_p double, rho_q double, rho_t double").write.mode("append").parquet(f"{folder}/log")


def latest(spark: SparkSession, folder: str, options: Options) -> tuple[dict[str, DataFrame], int]:
    """State of the last whole dump and its rounds; the penalties go to ``options``."""
    last = spark.read.parquet(f"{folder}/log").orderBy(F.col("done").desc()).first()
    options.rho_p, options.rho_q, options.rho_t = last["rho_p"], last["rho_q"], last["rho_t"]
    return resume(spark, last["path"]), last["done"]
