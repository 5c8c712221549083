"""Objective terms of AP - PB in long form: terms(i, j, u, v, sign)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def terms(edges1: DataFrame, edges2: DataFrame, support: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(A P)_ij holds +P_kj for edges i -> k, (P B)_ij holds -P_ik for edges k -> j; distinct on each side.

    With ``weights(i, j, w)`` B is the weighted matrix: its pairs take the place of ``edges2``, and the terms
    have a column w (1 on the plus side) that values, gradient and coefficients multiply by.
    """
    support, edges1 = support.select("u", "v").distinct(), edges1.select("src", "dst").distinct()
    plus = support.join(edges1.select(F.col("src").alias("i"), F.col("dst").alias("u")), "u").select("i", F.col("v").alias("j"), "u", "v", F.lit(1).alias("sign"))
    if weights is not None:
        b = weights.select(F.col("i").alias("v"), "j", F.col("w").cast("double").alias("w")).distinct()
        minus = support.join(b, "v").select(F.col("u").alias("i"), "j", "u", "v", F.lit(-1).alias("sign"), "w")
        return plus.withColumn("w", F.lit(1.0)).union(minus)
    minus = support.join(edges2.select("src", "dst").distinct().select(F.col("src").alias("v"), F.col("dst").alias("j")), "v").select(F.col("u").alias("i"), "j", "u", "v", F.lit(-1).alias("sign"))
    return plus.union(minus)


def _factor(terms_: DataFrame) -> Column:
    return F.col("sign") * F.col("w") if "w" in terms_.columns else F.col("sign")


def coefficients(terms_: DataFrame) -> DataFrame:
    """i, j, u, v, a: signs (times weights) summed, terms that cancel left out."""
    return terms_.groupBy("i", "j", "u", "v").agg(F.sum(_factor(terms_)).cast("double").alias("a")).where("a <> 0")


def support_sizes(terms_: DataFrame) -> DataFrame:
    n = [F.count(F.when(F.col("sign") == s, 1)).alias(c) for s, c in ((1, "n_plus"), (-1, "n_minus"))]
    return terms_.groupBy("i", "j").agg(*n)


def nested(terms_: DataFrame) -> DataFrame:
    """i, j, plus, minus as arrays of variables; an absent side is an empty array."""
    side = [F.array_sort(F.collect_set(F.when(F.col("sign") == s, F.struct("u", "v")))).alias(c) for s, c in ((1, "plus"), (-1, "minus"))]
    return terms_.groupBy("i", "j").agg(*side)


def violations(terms_: DataFrame, edges1: DataFrame, edges2: DataFrame, support: DataFrame) -> DataFrame:
    """Number of terms outside the support, on a wrong index or without their edge (0 if all is well)."""
    outside = terms_.join(support, ["u", "v"], "left_anti")
    plus, minus = terms_.where("sign = 1"), terms_.where("sign = -1")
    index = plus.where("j <> v").union(minus.where("i <> u"))
    e1 = edges1.select(F.col("src").alias("i"), F.col("dst").alias("u"))
    e2 = edges2.select(F.col("src").alias("v"), F.col("dst").alias("j"))
    edge = plus.join(e1, ["i", "u"], "left_anti").select(*terms_.columns).union(minus.join(e2, ["v", "j"], "left_anti").select(*terms_.columns))
    return outside.select(*terms_.columns).union(index).union(edge).agg(F.count(F.lit(1)).alias("violations"))


def variable_index(terms_: DataFrame) -> DataFrame:
    """u, v, plus, minus: the objectives (i, j) that hold a variable on either side; an absent side is an empty array."""
    side = [F.array_sort(F.collect_set(F.when(F.col("sign") == s, F.struct("i", "j")))).alias(c) for s, c in ((1, "plus"), (-1, "minus"))]
    return terms_.groupBy("u", "v").agg(*side)


def layouts(terms_: DataFrame, folder: str, name: str) -> tuple[DataFrame, DataFrame]:
    """The terms by variable and by objective, written as bucketed and sorted tables in a shared folder.

    What joins or groups them by (u, v) reads the first, by (i, j) the second, and neither is shuffled then: in a
    round only vectors move.  There are as many buckets as shuffle partitions.
    """
    spark = terms_.sparkSession
    buckets, out = int(spark.conf.get("spark.sql.shuffle.partitions")), []
    for by, keys in (("variable", ("u", "v")), ("objective", ("i", "j"))):
        held = f"{name}_by_{by}"
        rows = terms_.repartition(buckets, *keys)
        rows.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{folder.rstrip('/')}/{held}").mode("overwrite").format("parquet").saveAsTable(held)
        out.append(spark.table(held))
    return out[0], out[1]


def cooccurrence(terms_: DataFrame) -> DataFrame:
    """u1, v1, u2, v2, n: objectives in which two different variables meet on opposite sides or the same."""
    a = terms_.select("i", "j", F.col("u").alias("u1"), F.col("v").alias("v1")).distinct()
    b = a.select("i", "j", F.col("u1").alias("u2"), F.col("v1").alias("v2"))
    both = a.join(b, ["i", "j"]).where("u1 <> u2 or v1 <> v2")
    return both.groupBy("u1", "v1", "u2", "v2").agg(F.count(F.lit(1)).alias("n"))


def values(terms_: DataFrame, z: DataFrame) -> DataFrame:
    """i, j, f: the value of each objective at z(u, v, z)."""
    return terms_.join(z, ["u", "v"]).groupBy("i", "j").agg(F.sum(_factor(terms_) * F.col("z")).alias("f"))


def value(terms_: DataFrame, z: DataFrame, p: float) -> DataFrame:
    """The p-norm of AP - PB as one row."""
    f = values(terms_, z)
    return f.agg(F.pow(F.sum(F.pow(F.abs("f"), F.lit(float(p)))), F.lit(1.0 / p)).alias("value"))


def gradient(terms_: DataFrame, z: DataFrame, p: float, by_objective: DataFrame | None = None) -> DataFrame:
    """u, v, g: gradient of the p-norm at z; 0 where the norm is 0.

    ``by_objective``: the same terms laid out by (i, j), if there are such (see ``layouts``).
    """
    f = values(terms_, z)
    norm = f.agg(F.pow(F.sum(F.pow(F.abs("f"), F.lit(float(p)))), F.lit(1.0 / p)).alias("value"))
    terms_ = terms_ if by_objective is None else by_objective
    slope = F.when(F.col("value") > 0, F.signum("f") * F.pow(F.abs("f") / F.col("value"), F.lit(p - 1.0))).otherwise(F.lit(0.0))
    s = f.crossJoin(F.broadcast(norm)).select("i", "j", slope.alias("s"))  # one row beside every objective
    return terms_.join(s, ["i", "j"]).groupBy("u", "v").agg(F.sum(_factor(terms_) * F.col("s")).alias("g"))


def linear_cost(support: DataFrame, cost: DataFrame, z: DataFrame) -> DataFrame:
    """sum d * z over the support; a pair without a cost counts 0."""
    d = support.join(cost, ["u", "v"], "left").select("u", "v", F.coalesce("d", F.lit(0.0)).alias("d"))
    return d.join(z, ["u", "v"]).agg(F.sum(F.col("d") * F.col("z")).alias("value"))


def pair_distance(features1: DataFrame, features2: DataFrame, support: DataFrame | None = None, equalize: bool = False) -> DataFrame:
    """u, v, d: Euclidean distance of ``features(node, features)`` on the support, or of all pairs.

    ``equalize`` first gives the side with fewer nodes zero vectors for the ids from its size to the other's;
    nodes that already have such an id are an error.
    """
    from ..functions.scalars import euclidean

    if equalize:
        n1, n2 = features1.count(), features2.count()
        if n1 < n2:
            features1 = _padded(features1, features2, n1, n2)
        elif n2 < n1:
            features2 = _padded(features2, features1, n2, n1)
    a = features1.select(F.col("node").alias("u"), F.col("features").alias("fa"))
    b = features2.select(F.col("node").alias("v"), F.col("features").alias("fb"))
    both = a.crossJoin(b) if support is None else support.join(a, "u").join(b, "v")
    return both.select("u", "v", euclidean(F.col("fa"), F.col("fb")).alias("d"))


def _padded(few: DataFrame, many: DataFrame, low: int, high: int) -> DataFrame:
    if not few.where(F.col("node").cast("long").between(low, high - 1)).isEmpty():
        raise ValueError(f"nodes with ids from {low} to {high - 1} stand where padding goes; number nodes from 0")
    width = many.select(F.size("features")).first()[0]
    kind = few.schema["node"].dataType
    zeros = few.sparkSession.range(low, high).select(F.col("id").cast(kind).alias("node"), F.array_repeat(F.lit(0.0), width).alias("features"))
    return few.select("node", "features").union(zeros)
