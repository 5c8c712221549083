"""Graphs and vectors made from the driver's tables, each as a DataFrame and as DuckDB SQL.

Trade corridors: every customer nation points to its three supplier nations of highest lift; graph 1 uses
returned lines, graph 2 accepted ones.  The permuted pair is graph 1 with node x renamed (7 x + 3) % 25.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import symmetrise
from .loop import settle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flag, a, b, n: lines by nation of customer and supplier; counted by key before nations are joined."""
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("R", "A")).select("l_orderkey", "l_suppkey", F.col("l_returnflag").alias("flag"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    buyers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("a"))
    sellers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("b"))
    flat = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    flat = flat.join(sellers, F.col("l_suppkey") == F.col("s_suppkey")).where("a <> b")
    return flat.groupBy("flag", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def corridors(trade_: DataFrame, flag: str, hub: bool = False) -> DataFrame:
    """src, dst: three corridors out of each nation, by lift or by plain count."""
    t = trade_.where(F.col("flag") == flag)
    lift = F.col("n").cast("double") / F.sum(F.col("n").cast("double")).over(Window.partitionBy("b"))
    order = Window.partitionBy("a").orderBy(F.col("n" if hub else "lift").desc(), "b")
    ranked = t.withColumn("lift", lift).withColumn("rk", F.row_number().over(order)).where("rk <= 3")
    return ranked.select(F.col("a").alias("src"), F.col("b").alias("dst"))


def directed(spark: SparkSession, sf_dir: str, flag: str = "R", hub: bool = False) -> DataFrame:
    return settle(corridors(trade(spark, sf_dir), flag, hub))


def graph(spark: SparkSession, sf_dir: str, flag: str = "R") -> DataFrame:
    return settle(symmetrise(corridors(trade(spark, sf_dir), flag)))


def permuted(edges: DataFrame) -> DataFrame:
    return edges.select(((7 * F.col("src") + 3) % 25).alias("src"), ((7 * F.col("dst") + 3) % 25).alias("dst"))


def true_matching(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("u"), ((7 * F.col("src") + 3) % 25).alias("v")).distinct()


def pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    both = settle(trade(spark, sf_dir))
    return settle(symmetrise(corridors(both, "R"))), settle(symmetrise(corridors(both, "A")))


SQL = """WITH trade AS (
  SELECT l.l_returnflag AS flag, c.c_nationkey AS a, s.s_nationkey AS b, count(*) AS n
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
                  JOIN customer c ON o.o_custkey = c.c_custkey
                  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  WHERE c.c_nationkey <> s.s_nationkey AND l.l_returnflag IN ('R', 'A') GROUP BY 1, 2, 3),
lift AS (SELECT *, CAST(n AS DOUBLE) / sum(CAST(n AS DOUBLE)) OVER (PARTITION BY flag, b) AS lift FROM trade),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY flag, a ORDER BY lift DESC, b) AS rk,
         row_number() OVER (PARTITION BY flag, a ORDER BY n DESC, b) AS hk FROM lift),
d1 AS (SELECT a AS src, b AS dst FROM ranked WHERE rk <= 3 AND flag = 'R'),
d2 AS (SELECT a AS src, b AS dst FROM ranked WHERE rk <= 3 AND flag = 'A'),
hub AS (SELECT a AS src, b AS dst FROM ranked WHERE hk <= 3 AND flag = 'R'),
e1 AS (SELECT src, dst FROM d1 UNION SELECT dst, src FROM d1),
e2 AS (SELECT src, dst FROM d2 UNION SELECT dst, src FROM d2),
ep AS (SELECT (7 * src + 3) % 25 AS src, (7 * dst + 3) % 25 AS dst FROM e1),
g1 AS (SELECT src AS node, sum(CASE WHEN src = dst THEN 0 ELSE 1 END) AS deg FROM e1 GROUP BY 1),
g2 AS (SELECT src AS node, sum(CASE WHEN src = dst THEN 0 ELSE 1 END) AS deg FROM e2 GROUP BY 1),
support AS (SELECT g1.node AS u, g2.node AS v FROM g1 JOIN g2 ON abs(g1.deg - g2.deg) <= 2),
terms AS (
  SELECT DISTINCT e1.src AS i, s.v AS j, s.u, s.v, 1 AS sign FROM support s JOIN e1 ON e1.dst = s.u
  UNION ALL
  SELECT DISTINCT s.u AS i, e2.dst AS j, s.u, s.v, -1 AS sign FROM support s JOIN e2 ON e2.src = s.v),
bal AS (SELECT c_nationkey AS node, avg(c_acctbal) AS m FROM customer GROUP BY 1),
cost AS (SELECT a.node AS u, b.node AS v, abs(a.m - b.m) / 1000 AS d FROM bal a, bal b),
wb AS (SELECT src AS i, dst AS j, 1 + CAST((3 * src + 5 * dst) % 7 AS DOUBLE) / 10 AS w FROM e2),
wterms AS (
  SELECT DISTINCT e1.src AS i, s.v AS j, s.u, s.v, 1 AS sign, 1.0::DOUBLE AS w FROM support s JOIN e1 ON e1.dst = s.u
  UNION ALL
  SELECT DISTINCT s.u AS i, b.j, s.u, s.v, -1 AS sign, b.w FROM support s JOIN wb b ON b.i = s.v),
z0 AS (SELECT u, v, CAST(1 + (3 * u + 5 * v) % 7 AS DOUBLE) / 40 AS z FROM support)
"""


def sql(text: str) -> str:
    """The fixture's tables, then ``text``, which may go on with further tables."""
    text = text.strip()
    return SQL.rstrip() + (",\n" + text[1:].strip() if text.startswith(",") else "\n" + text)


def support(e1: DataFrame, e2: DataFrame) -> DataFrame:
    from ..operators.support import by_degree

    return settle(by_degree(e1, e2, 1))


def weights(e2: DataFrame) -> DataFrame:
    """i, j, w: a weight for every edge of graph 2."""
    return e2.select(F.col("src").alias("i"), F.col("dst").alias("j"), (1 + ((3 * F.col("src") + 5 * F.col("dst")) % 7).cast("double") / 10).alias("w"))


def cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u, v, d of every pair of nodes (25 x 25): the result is the product."""
    bal = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("node")).agg(F.avg("c_acctbal").alias("m"))
    a, b = bal.select(F.col("node").alias("u"), F.col("m").alias("ma")), bal.select(F.col("node").alias("v"), F.col("m").alias("mb"))
    return a.crossJoin(b).select("u", "v", (F.abs(F.col("ma") - F.col("mb")) / 1000).alias("d"))


def start(support_: DataFrame) -> DataFrame:
    return support_.select("u", "v", ((1 + (3 * F.col("u") + 5 * F.col("v")) % 7).cast("double") / 40).alias("z"))
