"""Registered queries: name -> (query, DuckDB SQL or None).  Doubles are rounded to 6 places."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import admm, assignment, blocks, components, evaluate, generate, graph, objective, primal_dual, projection, support
from ..sources import readers, writers
from ..streaming import partitioner
from . import fixtures as fx
from . import runtime
from .fixtures import sql
from .loop import settle, shared_folder

CATALOGUE: dict[str, tuple] = {}


def query(text: str | None, name: str | None = None):
    def add(f):
        CATALOGUE[name or f.__name__] = (f, text)
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) + F.lit(0.0) for c in columns})


def setting(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Both graphs, their support and the objective terms."""
    e1, e2 = fx.pair(s, d)
    sup = fx.support(e1, e2)
    return e1, e2, sup, settle(objective.terms(e1, e2, sup))


# Edges and nodes


@query(sql("SELECT src, dst FROM e1"))
def edges_symmetric(s, d):
    return fx.graph(s, d)


@query(sql("SELECT src AS node FROM d1 UNION SELECT dst FROM d1"))
def nodes(s, d):
    return graph.nodes(fx.directed(s, d))


@query(sql("SELECT dst AS src, src AS dst FROM d1"))
def reverse_edges(s, d):
    return graph.reverse(fx.directed(s, d))


@query(sql("SELECT node, CAST(deg AS BIGINT) AS deg FROM g1"))
def degree_counts(s, d):
    return graph.degree_counts(fx.graph(s, d))


@query("""WITH e AS (
  SELECT l_partkey AS id, (l_orderkey * 10 + l_linenumber) * 2 AS k FROM lineitem
  UNION ALL SELECT l_suppkey + 1000000, (l_orderkey * 10 + l_linenumber) * 2 + 1 FROM lineitem)
SELECT id AS old_id, row_number() OVER (ORDER BY k, id) - 1 AS new_id FROM (SELECT id, min(k) AS k FROM e GROUP BY id)""")
def id_compaction(s, d):
    lines = fx.table(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1000000).alias("dst"))
    return graph.compact_ids(lines)


@query(sql("SELECT src, dst FROM ep"))
def perturb_permute(s, d):
    e = fx.graph(s, d)
    return generate.relabel(e, fx.true_matching(e))


# Candidate pairs


@query(sql("SELECT a.node AS u, b.node AS v FROM g1 a, g2 b"))
def support_all(s, d):
    return support.all_pairs(*fx.pair(s, d))


@query(sql("SELECT u, v FROM support"))
def support_degree(s, d):
    return support.by_degree(*fx.pair(s, d), offset=1)


def wl_sql(edges: str, name: str, depth: int) -> str:
    """Refinement rounds over an undirected graph: the colour is the sorted list of the neighbours' colours."""
    out = f", {name}0 AS (SELECT src AS node, '1' AS c FROM {edges} GROUP BY 1)"
    for n in range(1, depth + 1):
        out += f"\n, {name}{n} AS (SELECT e.src AS node, md5(string_agg(k.c, ',' ORDER BY k.c)) AS c FROM {edges} e JOIN {name}{n - 1} k ON k.node = e.dst GROUP BY 1)"
    return out


@query(sql(wl_sql("e1", "x", 3) + "\n" + wl_sql("ep", "y", 3) + " SELECT x3.node AS u, y3.node AS v FROM x3 JOIN y3 USING (c)"))
def support_wl(s, d):
    e = fx.graph(s, d)
    return support.by_wl(e, fx.permuted(e), 3)


@query(sql(wl_sql("e1", "x", 3) + " SELECT CAST(n AS INTEGER) AS round, k AS n_colors FROM (SELECT 1 AS n, count(DISTINCT c) AS k FROM x1 UNION ALL SELECT 2, count(DISTINCT c) FROM x2 UNION ALL SELECT 3, count(DISTINCT c) FROM x3)"))
def wl_color_counts(s, d):
    return graph.wl_color_counts(fx.graph(s, d), 3)


def rings_sql(e: str, p: str) -> str:
    return f"""
, {p}n AS (SELECT src AS node FROM {e} UNION SELECT dst FROM {e})
, {p}s AS (SELECT DISTINCT src, dst FROM {e})
, {p}f2 AS (SELECT DISTINCT a.src, b.dst FROM {p}s a JOIN {p}s b ON a.dst = b.src WHERE a.src <> b.dst
    AND NOT EXISTS (SELECT 1 FROM {p}s x WHERE x.src = a.src AND x.dst = b.dst))
, {p}f3 AS (SELECT DISTINCT a.src, b.dst FROM {p}f2 a JOIN {p}s b ON a.dst = b.src WHERE a.src <> b.dst
    AND NOT EXISTS (SELECT 1 FROM {p}s x WHERE x.src = a.src AND x.dst = b.dst)
    AND NOT EXISTS (SELECT 1 FROM {p}f2 x WHERE x.src = a.src AND x.dst = b.dst))
, {p}r AS (SELECT n.node,
    (SELECT count(*) FROM {e} x WHERE x.src = n.node) AS r1,
    (SELECT count(*) FROM {p}f2 x WHERE x.src = n.node) AS r2,
    (SELECT count(*) FROM {p}f3 x WHERE x.src = n.node) AS r3 FROM {p}n n)"""


@query(sql(rings_sql("d1", "k") + " SELECT * FROM kr"))
def ring_sizes(s, d):
    return graph.ring_sizes(fx.directed(s, d), 3)


@query(sql(rings_sql("e1", "k") + rings_sql("ep", "m") + " SELECT kr.node AS u, mr.node AS v FROM kr JOIN mr USING (r1, r2, r3)"))
def support_neighbor(s, d):
    e = fx.graph(s, d)
    return support.by_rings(e, fx.permuted(e), 3)


@query("""WITH c AS (SELECT c_nationkey AS node, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS k FROM customer WHERE c_acctbal > 9000 GROUP BY 1)
SELECT a.node AS u, (7 * b.node + 3) % 25 AS v FROM c a JOIN c b USING (k)""")
def support_exog(s, d):
    c = fx.table(s, d, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("node")).agg(F.collect_set("c_mktsegment").alias("colors"))
    return support.by_colors(c, c.select(((7 * F.col("node") + 3) % 25).alias("node"), "colors"))


@query(sql(", small AS (SELECT DISTINCT a.n_regionkey AS src, b.n_regionkey AS dst FROM e1 JOIN nation a ON a.n_nationkey = e1.src JOIN nation b ON b.n_nationkey = e1.dst) SELECT u, v FROM support UNION SELECT CAST(range AS INTEGER), CAST(range AS INTEGER) FROM range((SELECT count(DISTINCT src) FROM small), (SELECT count(DISTINCT src) FROM e2))"))
def support_equalised(s, d):
    """Graph 2 against the smaller graph of the regions."""
    e1, e2 = fx.pair(s, d)
    region = fx.table(s, d, "nation").select(F.col("n_nationkey").cast("int").alias("n"), F.col("n_regionkey").cast("int").alias("r"))
    small = e1.join(region.select(F.col("n").alias("src"), F.col("r").alias("a")), "src").join(region.select(F.col("n").alias("dst"), F.col("r").alias("b")), "dst")
    _, _, same = support.equalised(small.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), e2)
    return fx.support(e1, e2).union(same).distinct()


# Features


@query(sql(""", s1 AS (SELECT DISTINCT src, dst FROM d1)
, b2 AS (SELECT src, dst FROM s1 UNION SELECT a.src, b.dst FROM s1 a JOIN s1 b ON a.dst = b.src)
, b3 AS (SELECT src, dst FROM b2 UNION SELECT a.src, b.dst FROM b2 a JOIN s1 b ON a.dst = b.src)
SELECT n.node, x.b1, y.b2, z.b3 FROM (SELECT src AS node FROM d1 UNION SELECT dst FROM d1) n
LEFT JOIN (SELECT src, count(*) AS b1 FROM s1 GROUP BY 1) x ON x.src = n.node
LEFT JOIN (SELECT src, count(*) AS b2 FROM b2 GROUP BY 1) y ON y.src = n.node
LEFT JOIN (SELECT src, count(*) AS b3 FROM b3 GROUP BY 1) z ON z.src = n.node"""))
def ball_sizes(s, d):
    return graph.ball_sizes(fx.directed(s, d), 3)


WALKS = """
, p1 AS (SELECT src, dst, count(*) AS n FROM {e} GROUP BY 1, 2)
, p2 AS (SELECT a.src, b.dst, sum(a.n * b.n) AS n FROM p1 a JOIN p1 b ON a.dst = b.src GROUP BY 1, 2)
, p3 AS (SELECT a.src, b.dst, sum(a.n * b.n) AS n FROM p2 a JOIN p1 b ON a.dst = b.src GROUP BY 1, 2)
, wk AS (SELECT n.node,
  CAST(coalesce((SELECT sum(n) FROM p1 WHERE src = node), 0) AS BIGINT) AS w1,
  CAST(coalesce((SELECT sum(n) FROM p2 WHERE src = node), 0) AS BIGINT) AS w2,
  CAST(coalesce((SELECT sum(n) FROM p3 WHERE src = node), 0) AS BIGINT) AS w3,
  CAST(coalesce((SELECT sum(n) FROM p1 WHERE src = node AND dst = node), 0) AS BIGINT) AS c1,
  CAST(coalesce((SELECT sum(n) FROM p2 WHERE src = node AND dst = node), 0) AS BIGINT) AS c2,
  CAST(coalesce((SELECT sum(n) FROM p3 WHERE src = node AND dst = node), 0) AS BIGINT) AS c3
  FROM (SELECT src AS node FROM {e} UNION SELECT dst FROM {e}) n)"""


@query(sql(WALKS.format(e="d1") + " SELECT * FROM wk"))
def walk_counts(s, d):
    return graph.walk_counts(fx.directed(s, d), 3)


def rank_sql(e: str, rounds: int, out: str) -> str:
    text = f"\n, rn AS (SELECT node, count(*) OVER () AS n FROM (SELECT src AS node FROM {e} UNION SELECT dst FROM {e}))"
    text += "\n, rk0 AS (SELECT node, 1.0::DOUBLE / n AS score FROM rn)"
    text += f"\n, rl AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS deg FROM {e})"
    for k in range(1, rounds + 1):
        text += f"\n, rk{k} AS MATERIALIZED (SELECT l.dst AS node, 0.85::DOUBLE * sum(r.score / l.deg) + 0.15::DOUBLE / (SELECT max(n) FROM rn) AS score FROM rl l JOIN rk{k - 1} r ON r.node = l.src GROUP BY 1)"
    return text + f"\n, {out} AS (SELECT rn.node, coalesce(k.score, 0.15::DOUBLE / rn.n) AS score FROM rn LEFT JOIN rk{rounds} k USING (node))"


@query(sql(rank_sql("hub", 5, "pr") + " SELECT node, round(score, 6) AS score FROM pr"))
def pagerank(s, d):
    return rounded(graph.pagerank(fx.directed(s, d, hub=True), rounds=5, eps=0.0), "score")


@query(sql(rings_sql("e1", "k") + WALKS.format(e="e1") + rank_sql("e1", 5, "pr") + """
, f AS (SELECT kr.node, [CAST(r1 AS DOUBLE), r2, r3, w1, w2, w3, c1, c2, c3, score] AS f FROM kr JOIN wk USING (node) JOIN pr USING (node))
SELECT node, CAST(generate_subscripts(f, 1) - 1 AS INTEGER) AS pos, round(unnest(f), 6) AS value FROM f"""))
def node_attributes(s, d):
    a = graph.attributes(fx.graph(s, d), 3, rounds=5, eps=0.0)
    return rounded(a.select("node", F.posexplode("features").alias("pos", "value")), "value")


def _simple_features(s, d, e):
    return e.groupBy(F.col("src").alias("node")).agg(F.array(F.count(F.lit(1)).cast("double"), F.sum("dst").cast("double")).alias("features"))


FEATURES = ", f1 AS (SELECT src AS node, count(*) AS x, sum(dst) AS y FROM e1 GROUP BY 1), f2 AS (SELECT src AS node, count(*) AS x, sum(dst) AS y FROM e2 GROUP BY 1)"
DISTANCE = " SELECT a.node AS u, b.node AS v, round(sqrt(CAST((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS DOUBLE)), 6) AS d FROM f1 a, f2 b"


@query(sql(FEATURES + DISTANCE + ", support s WHERE s.u = a.node AND s.v = b.node"))
def pair_distance(s, d):
    e1, e2 = fx.pair(s, d)
    return rounded(objective.pair_distance(_simple_features(s, d, e1), _simple_features(s, d, e2), fx.support(e1, e2)), "d")


@query(sql(FEATURES + DISTANCE))
def pair_distance_all(s, d):
    e1, e2 = fx.pair(s, d)
    return rounded(objective.pair_distance(_simple_features(s, d, e1), _simple_features(s, d, e2)), "d")


@query("""SELECT a.vec_id AS u, b.vec_id AS v, round(sqrt(list_sum([power(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE), 2) FOR i IN range(1, len(a.embedding) + 1)])), 5) AS d
FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id = a.vec_id + 10""")
def embedding_distance(s, d):
    e = fx.table(s, d, "embeddings").select(F.col("vec_id").alias("node"), F.transform("embedding", lambda x: x.cast("double")).alias("features"), "label")
    a, b = e.select(F.col("node").alias("u"), "label"), e.select(F.col("node").alias("v"), (F.col("node") - 10).alias("u"), "label")
    near = objective.pair_distance(e.select("node", "features"), e.select("node", "features"), a.join(b, ["u", "label"]).select("u", "v"))
    return near.withColumn("d", F.round("d", 5))


@query("""WITH p AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
SELECT CAST(pos AS INTEGER) AS pos, round(avg(x), 6) AS mean FROM p GROUP BY 1""")
def mean_attributes(s, d):
    e = fx.table(s, d, "embeddings").select(F.transform("embedding", lambda x: x.cast("double")).alias("features"))
    return rounded(graph.mean_attributes(e), "mean")


# Objectives


@query(sql("SELECT i, j, u, v, CAST(sign AS INTEGER) AS sign FROM terms"))
def objective_terms(s, d):
    return setting(s, d)[3]


@query(sql("SELECT i, j, count(*) FILTER (sign = 1) AS n_plus, count(*) FILTER (sign = -1) AS n_minus FROM terms GROUP BY 1, 2"))
def objective_support_sizes(s, d):
    return objective.support_sizes(setting(s, d)[3])


@query(sql("SELECT count(*) FILTER (u NOT IN (SELECT u FROM support)) AS violations FROM terms"))
def support_invariants(s, d):
    e1, e2, sup, t = setting(s, d)
    return objective.violations(t, e1, e2, sup)


@query(sql(", a AS (SELECT DISTINCT i, j, u, v FROM terms) SELECT x.u AS u1, x.v AS v1, y.u AS u2, y.v AS v2, count(*) AS n FROM a x JOIN a y USING (i, j) WHERE x.u <> y.u OR x.v <> y.v GROUP BY 1, 2, 3, 4"))
def variable_cooccurrence(s, d):
    return objective.cooccurrence(setting(s, d)[3])


F_SQL = ", f AS (SELECT i, j, sum(sign * z) AS f FROM terms JOIN z0 USING (u, v) GROUP BY 1, 2)"

for _p, _name in ((1.0, "l1"), (2.0, "l2"), (1.5, "p")):

    def _value(s, d, p=_p):
        sup, t = setting(s, d)[2:]
        return rounded(objective.value(t, fx.start(sup), p), "value")

    query(sql(F_SQL + f" SELECT round(power(sum(power(abs(f), {_p}::DOUBLE)), 1 / {_p}::DOUBLE), 6) AS value FROM f"), f"objective_value_{_name}")(_value)


W_SQL = ", f AS (SELECT i, j, sum(sign * w * z) AS f FROM wterms JOIN z0 USING (u, v) GROUP BY 1, 2)"


def _weighted(s, d):
    e1, e2 = fx.pair(s, d)
    sup = fx.support(e1, e2)
    return sup, settle(objective.terms(e1, e2, sup, fx.weights(e2)))


@query(sql(W_SQL + " SELECT round(sqrt(sum(f * f)), 6) AS value FROM f"))
def objective_value_weighted(s, d):
    sup, t = _weighted(s, d)
    return rounded(objective.value(t, fx.start(sup), 2.0), "value")


@query(sql("SELECT i, j, count(*) FILTER (sign = 1) AS n_plus, count(*) FILTER (sign = -1) AS n_minus, string_agg(u || ':' || v, ',' ORDER BY u, v) FILTER (sign = 1) AS plus, string_agg(u || ':' || v, ',' ORDER BY u, v) FILTER (sign = -1) AS minus FROM terms GROUP BY 1, 2"))
def objective_nested(s, d):
    named = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["u"].cast("string"), x["v"].cast("string"))), ",")
    n = objective.nested(setting(s, d)[3])
    return n.select("i", "j", *[F.size(c).cast("long").alias(f"n_{c}") for c in ("plus", "minus")], *[F.when(F.size(c) > 0, named(c)).alias(c) for c in ("plus", "minus")])


@query(sql("SELECT round(sum(coalesce(d, 0) * z), 6) AS value FROM z0 LEFT JOIN cost USING (u, v)"))
def linear_cost(s, d):
    sup = setting(s, d)[2]
    return rounded(objective.linear_cost(sup, fx.cost(s, d), fx.start(sup)), "value")


# Projections


def simplex_sql(source: str, by: str, x: str, out: str, extra: str = "") -> str:
    """SELECT with the projection of each group of ``source`` onto the unit simplex."""
    return f"""SELECT u, v, greatest({x} - max(th) OVER (PARTITION BY {by}), 0) AS {out}{extra} FROM (
  SELECT *, (sum({x}) OVER w - 1) / row_number() OVER w AS th FROM {source}
  WINDOW w AS (PARTITION BY {by} ORDER BY {x} DESC, u, v ROWS UNBOUNDED PRECEDING))"""


CELLS = """ cells AS (SELECT c_nationkey AS u, s_nationkey AS v, CAST(count(*) AS DOUBLE) / 100 AS x FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""


def _cells(s, d):
    flat = fx.table(s, d, "lineitem").join(fx.table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    flat = flat.join(fx.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(fx.table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return flat.groupBy(F.col("c_nationkey").alias("u"), F.col("s_nationkey").alias("v")).agg((F.count(F.lit(1)).cast("double") / 100).alias("x"))


@query("WITH" + CELLS + " SELECT u, v, round(q, 6) AS q FROM (" + simplex_sql("cells", "u", "x", "q") + ")")
def simplex_rows(s, d):
    return rounded(projection.simplex(_cells(s, d), "u", "x", "q").select("u", "v", "q"), "q")


@query("WITH" + CELLS + " SELECT u, v, round(q, 6) AS q FROM (" + simplex_sql("cells", "v", "x", "q") + ")")
def simplex_cols(s, d):
    return rounded(projection.simplex(_cells(s, d), "v", "x", "q").select("u", "v", "q"), "q")


def _vector(s, d):
    return fx.table(s, d, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_acctbal") / 1000).alias("n"))


@query("SELECT c_custkey AS key, round(sign(c_acctbal) * greatest(abs(c_acctbal / 1000) - 0.5, 0), 6) AS y FROM customer")
def soft_threshold(s, d):
    return rounded(projection.prox_l1(_vector(s, d), "n", 2.0).select("key", "y"), "y")


@query("SELECT c_custkey AS key, round(CASE WHEN k <= 0.5 THEN 0 ELSE (1 - 0.5 / k) * c_acctbal / 1000 END, 6) AS y FROM customer, (SELECT sqrt(sum(c_acctbal * c_acctbal)) / 1000 AS k FROM customer)")
def euclid_prox(s, d):
    return rounded(projection.prox_l2(_vector(s, d), "n", 2.0).select("key", "y"), "y")


def pnorm_sql(steps: int = 60) -> str:
    """Prox of the 1.5-norm with penalty 1: bisection for its norm, entries by the quadratic formula in sqrt(y)."""
    text = "WITH n AS (SELECT c_custkey AS key, sign(c_acctbal) AS s, abs(c_acctbal / 1000) AS n FROM customer)"
    text += "\n, k0 AS (SELECT 0.0::DOUBLE AS lo, power(sum(power(n, 1.5::DOUBLE)), 1 / 1.5::DOUBLE) AS hi FROM n)"
    root = "power((sqrt(2 / (lo + hi) + 4 * n) - sqrt(2 / (lo + hi))) / 2, 2)"
    for k in range(1, steps + 1):
        text += f"""
, c{k} AS MATERIALIZED (SELECT lo, hi, power(sum(power({root}, 1.5::DOUBLE)), 1 / 1.5::DOUBLE) > (lo + hi) / 2 AS low FROM n, k{k - 1} GROUP BY lo, hi)
, k{k} AS MATERIALIZED (SELECT CASE WHEN low THEN (lo + hi) / 2 ELSE lo END AS lo, CASE WHEN low THEN hi ELSE (lo + hi) / 2 END AS hi FROM c{k})"""
    return text + f"\nSELECT key, round(s * {root}, 6) AS y FROM n, k{steps} WHERE (SELECT sum(power(n, 3)) FROM n) > 1"


@query(pnorm_sql())
def pnorm_prox(s, d):
    return rounded(projection.prox_p(_vector(s, d), "n", 1.5, 1.0).select("key", "y"), "y")


# Consensus rounds


def admm_sql(norm: str, rounds: int, priced: bool, adds: str) -> str:
    """Rounds of the consensus loop with every penalty and step 1."""
    text = ", n2 AS (SELECT count(DISTINCT src) AS n FROM e2)"
    text += "\n, za0 AS (SELECT s.u, s.v, 1.0::DOUBLE / n AS z, coalesce(c.d, 0) AS d FROM support s CROSS JOIN n2 LEFT JOIN cost c ON c.u = s.u AND c.v = s.v)"
    if not priced:
        text = text.replace("coalesce(c.d, 0) AS d", "0.0::DOUBLE AS d")
    text += "\n, co AS (SELECT i, j, u, v, CAST(sum(sign) AS DOUBLE) AS a FROM terms GROUP BY 1, 2, 3, 4 HAVING sum(sign) <> 0)"
    text += "\n, q0 AS (SELECT u, v, z AS q, 0.0::DOUBLE AS xi FROM za0), t0 AS (SELECT u, v, z AS q, 0.0::DOUBLE AS xi FROM za0)"
    text += "\n, b0 AS (SELECT co.*, z AS p, 0.0::DOUBLE AS phi FROM co JOIN za0 USING (u, v))"
    for k in range(1, rounds + 1):
        for f, by in (("q", "u"), ("t", "v")):
            text += f"\n, {f}y{k} AS (SELECT u, v, d, xi + q - z AS xi, z - (xi + q - z) - 0.5 * d AS x FROM {f}{k - 1} JOIN za{k - 1} USING (u, v))"
            text += f"\n, {f}{k} AS MATERIALIZED ({simplex_sql(f'{f}y{k}', by, 'x', 'q', ', xi')})"
        text += f"\n, by{k} AS (SELECT i, j, u, v, a, phi + p - z AS phi, z - (phi + p - z) AS x FROM b{k - 1} JOIN za{k - 1} USING (u, v))"
        s, m = "sum(a * x) OVER (PARTITION BY i, j)", "sum(a * a) OVER (PARTITION BY i, j)"
        p = f"x - a * {s} / (1 + {m})" if norm == "l2" else f"x - a * greatest(-1, least(1, {s} / {m}))"
        text += f"\n, b{k} AS MATERIALIZED (SELECT i, j, u, v, a, phi, {p} AS p FROM by{k})"
        text += f"""\n, za{k} AS MATERIALIZED (SELECT u, v, z, d FROM (SELECT u, v, avg(x) AS z FROM (
  SELECT u, v, q + xi AS x FROM q{k} UNION ALL SELECT u, v, q + xi FROM t{k} UNION ALL SELECT u, v, p + phi FROM b{k}) GROUP BY 1, 2) JOIN (SELECT u, v, d FROM za0) USING (u, v))"""
    return sql(text + adds.format(k=rounds))


def pnorm_admm_sql(rounds: int, inner: int) -> str:
    """As ``admm_sql`` for the 2-norm of all objectives: Y and Upsilon go on from round to round, every penalty 1."""
    text = admm_sql("l2", rounds, False, Z)
    for k in range(1, rounds + 1):
        at = text.index(f"\n, b{k} AS MATERIALIZED")
        end = text.index("\n, za" + str(k), at)
        own = f"\n, yb{k}_0 AS (SELECT i, j, u, v, a, phi, x, p FROM by{k} JOIN (SELECT i, j, u, v, p FROM b{k - 1}) USING (i, j, u, v))"
        for r in range(1, inner + 1):
            last = f"ys{k}_{r - 1}" if r > 1 else f"ys{k - 1}_{inner}" if k > 1 else "ys0"
            own += f"""
, f{k}_{r} AS MATERIALIZED (SELECT i, j, f, y, ups + y - f AS ups, f - (ups + y - f) AS n FROM (SELECT i, j, sum(a * p) AS f FROM yb{k}_{r - 1} GROUP BY 1, 2) JOIN {last} USING (i, j))
, ys{k}_{r} AS MATERIALIZED (SELECT i, j, ups, CASE WHEN norm <= 1 THEN 0 ELSE (1 - 1 / norm) * n END AS y FROM f{k}_{r}, (SELECT sqrt(sum(n * n)) AS norm FROM f{k}_{r}))
, yb{k}_{r} AS MATERIALIZED (
  SELECT i, j, u, v, a, phi, x, x + a * (y + ups - sum(a * x) OVER o) / (1 + sum(a * a) OVER o) AS p
  FROM yb{k}_{r - 1} JOIN ys{k}_{r} USING (i, j) WINDOW o AS (PARTITION BY i, j))"""
        text = text[:at] + own + f"\n, b{k} AS MATERIALIZED (SELECT i, j, u, v, a, phi, p FROM yb{k}_{inner})" + text[end:]
    at = text.index("\n, qy1 AS")
    return text[:at] + "\n, ys0 AS (SELECT i, j, sum(a * p) AS y, 0.0::DOUBLE AS ups FROM b0 GROUP BY 1, 2)" + text[at:]


def _align(s, d, norm: str, rounds: int, priced: bool = False, apart: bool = False, **more) -> dict:
    _, e2, sup, t = setting(s, d)
    # One dense block for each objective has the solution of the closed form.
    placement = t.select("i", "j", (F.col("i") * 1000 + F.col("j")).alias("part_id")).distinct() if apart else None
    o = admm.Options(norm=norm, placement=placement, **more)
    first = admm.initial(sup, t, e2.select("src").distinct().count(), fx.cost(s, d) if priced else None, o)
    return admm.align(first, rounds, o)


Z = " SELECT u, v, round(z, 6) AS z FROM za{k}"


@query(admm_sql("l2", 2, False, Z))
def admm_l2_step(s, d):
    return rounded(_align(s, d, "l2", 2)["z"], "z")


@query(admm_sql("l1", 2, False, Z))
def admm_l1_step(s, d):
    return rounded(_align(s, d, "l1", 2)["z"], "z")


@query(admm_sql("l2", 1, True, Z))
def admm_linear_step(s, d):
    return rounded(_align(s, d, "l2", 1, priced=True)["z"], "z")


@query(admm_sql("l2", 1, False, Z))
def admm_dense_l2(s, d):
    return rounded(_align(s, d, "l2", 1, apart=True)["z"], "z")


@query(admm_sql("l1", 1, False, Z))
def admm_dense_l1(s, d):
    return rounded(_align(s, d, "l1", 1, apart=True)["z"], "z")


@query(pnorm_admm_sql(2, 2))
def admm_pnorm(s, d):
    return rounded(_align(s, d, "p", 2, p=2.0, inner=2, inner_tol=0.0)["z"], "z")


@query(pnorm_admm_sql(1, 2))
def admm_pnorm_dense(s, d):
    return rounded(_align(s, d, "p", 1, apart=True, p=2.0, inner=2, inner_tol=0.0)["z"], "z")


@query(admm_sql("l2", 1, True, """
, s AS (
  SELECT i, j, count(*) AS variables, 1 AS objectives, sum((p - z + phi) * (p - z + phi)) / 2 AS rhoerr,
         power(sum(a * p), 2) / 2 AS pobj, power(sum(a * z), 2) / 2 AS zobj
  FROM b1 JOIN za0 USING (u, v) GROUP BY 1, 2)
, l AS (
  SELECT 'variables' AS metric, CAST(variables AS DOUBLE) AS x FROM s UNION ALL SELECT 'objectives', objectives FROM s UNION ALL SELECT 'pobj', pobj FROM s
  UNION ALL SELECT 'rhoerr', rhoerr FROM s UNION ALL SELECT 'proximalobj', pobj + rhoerr FROM s UNION ALL SELECT 'zobj', zobj FROM s)
SELECT metric, round(avg(x), 6) AS mean, round(min(x), 6) AS least, round(max(x), 6) AS most FROM l GROUP BY 1"""))
def admm_block_stats(s, d):
    _, e2, sup, t = setting(s, d)
    first = admm.initial(sup, t, e2.select("src").distinct().count(), fx.cost(s, d))
    return rounded(admm.block_stats(first, admm.align(first, 1)), "mean", "least", "most")


@query(sql(""", co AS (SELECT i, j, u, v FROM terms GROUP BY 1, 2, 3, 4 HAVING sum(sign) <> 0)
, h AS (SELECT i, j, u, v, CAST(('0x' || substr(md5(i || ',' || j), 1, 8)) AS BIGINT) % 8 AS b FROM co)
, vt AS (SELECT i, j, (3 * u + v) % 8 AS b, count(*) AS n FROM (SELECT DISTINCT i, j, u, v FROM terms) GROUP BY 1, 2, 3)
, pt AS (SELECT i, j, b FROM (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY n DESC, b) AS k FROM vt) WHERE k = 1)
, p AS (SELECT co.*, pt.b FROM co JOIN pt USING (i, j))
, e AS (SELECT 'hash' AS placement, * FROM h UNION ALL SELECT 'partition', * FROM p)
, c AS (SELECT placement, b, count(DISTINCT (u, v)) AS n FROM e GROUP BY 1, 2)
SELECT placement, count(*) AS blocks, CAST(sum(n) AS BIGINT) AS copies, max(n) AS largest,
       (SELECT count(DISTINCT (i, j)) FROM co) AS objectives, (SELECT count(DISTINCT (u, v)) FROM co) AS variables
FROM c GROUP BY 1"""))
def admm_placement(s, d):
    """Copies of variables when objectives are dealt by a hash and by a partition map that was written and read back."""
    t = setting(s, d)[3]
    drawn = F.conv(F.substring(F.md5(F.concat_ws(",", "i", "j").cast("binary")), 1, 8), 16, 10).cast("long")
    by_hash = t.select("i", "j", (drawn % 8).cast("int").alias("part_id")).distinct()
    parts = t.select("u", "v", ((3 * F.col("u") + F.col("v")) % 8).cast("int").alias("part_id")).distinct()
    at = _folder(s, "parts")
    writers.partition_map(partitioner.objective_parts(t, parts).withColumnsRenamed({"i": "u", "j": "v"}), at)
    read = readers.partition_map(s, at).select(F.col("u").cast("int").alias("i"), F.col("v").cast("int").alias("j"), "part_id")
    a = objective.coefficients(t)
    counts = [blocks.copy_counts(settle(blocks.placed(a, x))).withColumn("placement", F.lit(name)) for name, x in (("hash", by_hash), ("partition", read))]
    return counts[0].union(counts[1])


@query(admm_sql("l2", 1, False, """
, dz AS (SELECT u, v, za1.z - za0.z AS dz, za0.z AS old FROM za1 JOIN za0 USING (u, v))
, r AS (
  SELECT 'pres' AS metric, sqrt(sum((p - old) * (p - old))) AS value, sqrt(sum(dz * dz)) AS d FROM b1 JOIN dz USING (u, v)
  UNION ALL SELECT 'qres', sqrt(sum((q - old) * (q - old))), sqrt(sum(dz * dz)) FROM q1 JOIN dz USING (u, v)
  UNION ALL SELECT 'tres', sqrt(sum((q - old) * (q - old))), sqrt(sum(dz * dz)) FROM t1 JOIN dz USING (u, v))
SELECT metric, round(value, 6) AS value FROM r UNION ALL SELECT 'dual', round(sum(d), 6) FROM r"""))
def admm_residuals(s, d):
    _, e2, sup, t = setting(s, d)
    first = admm.initial(sup, t, e2.select("src").distinct().count())
    return rounded(admm.residuals(first, admm.align(first, 1)), "value")


@query(sql("SELECT round(min(s), 6) AS min_sum, round(max(s), 6) AS max_sum FROM (SELECT sum(z) AS s FROM z0 GROUP BY u)"))
def simplex_condition(s, d):
    return rounded(admm.simplex_condition(fx.start(setting(s, d)[2]), "u"), "min_sum", "max_sum")


@query(sql("SELECT round(avg(CASE WHEN z - 0.05 >= 0 THEN 1.0 ELSE 0.0 END), 6) AS frac FROM z0"))
def positivity(s, d):
    return rounded(admm.positivity(fx.start(setting(s, d)[2]).withColumn("z", F.col("z") - 0.05)), "frac")


@query(sql(", g AS (SELECT u, sum(z) AS s, count(*) FILTER (z < 0) AS neg, count(*) FILTER (z > 0.1) AS big FROM z0 GROUP BY 1) SELECT CAST(sum(neg) AS BIGINT) AS vars_lt_zero, CAST(sum(big) AS BIGINT) AS vars_gt_one, count(*) FILTER (s > 0.1 + 1e-10) AS groups_gt_one FROM g"))
def family_stats(s, d):
    z = fx.start(setting(s, d)[2]).withColumn("z", F.col("z") * 10)
    return admm.family_stats(z, "u", "z")


# The linear program


def lp_sql(rounds: int, adds: str) -> str:
    """Primal-dual rounds, unrolled."""
    text = """, co AS (SELECT i, j, u, v, CAST(sum(sign) AS DOUBLE) AS a FROM terms GROUP BY 1, 2, 3, 4 HAVING sum(sign) <> 0)
, vs AS (SELECT u, v, sum(abs(a)) AS s FROM co GROUP BY 1, 2)
, p0 AS (SELECT s.u, s.v, coalesce(c.d, 0) AS d, 1 / (coalesce(vs.s, 0) + 2) AS step, 1.0::DOUBLE / count(*) OVER (PARTITION BY s.u) AS p
  FROM support s LEFT JOIN cost c USING (u, v) LEFT JOIN vs USING (u, v))
, w0 AS (SELECT i, j, 1 / sum(abs(a)) AS step, 0.0::DOUBLE AS w FROM co GROUP BY 1, 2)
, r0 AS (SELECT u, 1.0::DOUBLE / count(*) AS step, 0.0::DOUBLE AS m FROM support GROUP BY 1), c0 AS (SELECT v, 1.0::DOUBLE / count(*) AS step, 0.0::DOUBLE AS m FROM support GROUP BY 1)"""
    for k in range(rounds + 1):
        text += f"""
, sl{k} AS (SELECT u, v, sum(a * w) AS g FROM co JOIN w{k} USING (i, j) GROUP BY 1, 2)
, l{k} AS MATERIALIZED (SELECT p.u, p.v, d, p.step, p, d + coalesce(g, 0) - r.m - c.m AS left_ FROM p{k} p LEFT JOIN sl{k} USING (u, v) JOIN r{k} r USING (u) JOIN c{k} c USING (v))"""
        if k < rounds:
            text += f"""
, x{k} AS MATERIALIZED (SELECT u, v, d, step, greatest(0, p - step * left_) AS p, 2 * greatest(0, p - step * left_) - p AS far FROM l{k})
, p{k + 1} AS (SELECT u, v, d, step, p FROM x{k})
, w{k + 1} AS MATERIALIZED (SELECT i, j, step, greatest(-1, least(1, w + step * f)) AS w FROM w{k} JOIN (SELECT i, j, sum(a * far) AS f FROM co JOIN x{k} USING (u, v) GROUP BY 1, 2) USING (i, j))
, r{k + 1} AS MATERIALIZED (SELECT u, step, m + step * (1 - s) AS m FROM r{k} JOIN (SELECT u, sum(far) AS s FROM x{k} GROUP BY 1) USING (u))
, c{k + 1} AS MATERIALIZED (SELECT v, step, m + step * (1 - s) AS m FROM c{k} JOIN (SELECT v, sum(far) AS s FROM x{k} GROUP BY 1) USING (v))"""
    return sql(text + adds.format(k=rounds))


def _program(s, d, rounds: int) -> dict:
    sup, t = setting(s, d)[2:]
    return primal_dual.solve(primal_dual.initial(sup, t, fx.cost(s, d)), rounds)


@query(lp_sql(3, " SELECT u, v, round(p, 6) AS p, round(left_, 6) AS excess FROM l{k}"))
def lp_rounds(s, d):
    return rounded(primal_dual.reduced(_program(s, d, 3)).select("u", "v", "p", "excess"), "p", "excess")


@query(lp_sql(2, """
, f AS (SELECT abs(sum(a * p)) AS f FROM co JOIN p{k} USING (u, v) GROUP BY i, j)
SELECT round((SELECT sum(f) FROM f) + (SELECT sum(d * p) FROM p{k}), 6) AS primal,
       round((SELECT sum(m) FROM r{k}) + (SELECT sum(m) FROM c{k}) + (SELECT sum(least(0, x)) FROM (SELECT min(left_) AS x FROM l{k} GROUP BY u)), 6) AS dual,
       round(greatest((SELECT max(abs(s - 1)) FROM (SELECT sum(p) AS s FROM p{k} GROUP BY u)), (SELECT max(abs(s - 1)) FROM (SELECT sum(p) AS s FROM p{k} GROUP BY v))), 6) AS infeasible"""))
def lp_gap(s, d):
    return rounded(primal_dual.gap(_program(s, d, 2)), "primal", "dual", "infeasible")


# Frank-Wolfe


@query(sql(F_SQL + """, n AS (SELECT power(sum(power(abs(f), 2.5::DOUBLE)), 1 / 2.5::DOUBLE) AS n FROM f)
, sl AS (SELECT i, j, CASE WHEN n > 0 THEN sign(f) * power(abs(f) / n, 1.5::DOUBLE) ELSE 0 END AS s FROM f, n)
SELECT u, v, round(sum(sign * s), 6) AS g FROM terms JOIN sl USING (i, j) GROUP BY 1, 2"""))
def fw_gradient(s, d):
    sup, t = setting(s, d)[2:]
    return rounded(objective.gradient(t, fx.start(sup), 2.5), "g")


@query(sql(F_SQL + """, n AS (SELECT power(sum(power(abs(f), 2.5::DOUBLE)), 1 / 2.5::DOUBLE) AS n FROM f)
, sl AS (SELECT i, j, CASE WHEN n > 0 THEN sign(f) * power(abs(f) / n, 1.5::DOUBLE) ELSE 0 END AS s FROM f, n)
SELECT u, v, round(sum(sign * s), 6) AS g FROM terms JOIN sl USING (i, j) GROUP BY 1, 2"""))
def fw_gradient_bucketed(s, d):
    """As fw_gradient, from terms that are laid out once by variable and once by objective."""
    sup, t = setting(s, d)[2:]
    by_variable, by_objective = objective.layouts(t, _folder(s, "layouts"), f"terms_{uuid.uuid4().hex}")
    return rounded(objective.gradient(by_variable, fx.start(sup), 2.5, by_objective), "g")


@query(sql("""SELECT u, v, count(*) FILTER (sign = 1) AS n_plus, count(*) FILTER (sign = -1) AS n_minus,
  coalesce(string_agg(i || ',' || j, ';' ORDER BY i, j) FILTER (sign = 1), '') AS plus, coalesce(string_agg(i || ',' || j, ';' ORDER BY i, j) FILTER (sign = -1), '') AS minus
FROM terms GROUP BY 1, 2"""))
def variable_index(s, d):
    found = objective.variable_index(setting(s, d)[3])
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(",", x["i"].cast("string"), x["j"].cast("string"))), ";")
    return found.select("u", "v", *[F.size(c).cast("long").alias(f"n_{c}") for c in ("plus", "minus")], *[text(c).alias(c) for c in ("plus", "minus")])


@query(sql(W_SQL + """, n AS (SELECT power(sum(power(abs(f), 2.5::DOUBLE)), 1 / 2.5::DOUBLE) AS n FROM f)
, sl AS (SELECT i, j, CASE WHEN n > 0 THEN sign(f) * power(abs(f) / n, 1.5::DOUBLE) ELSE 0 END AS s FROM f, n)
SELECT u, v, round(sum(sign * w * s), 6) AS g FROM wterms JOIN sl USING (i, j) GROUP BY 1, 2"""))
def fw_gradient_weighted(s, d):
    sup, t = _weighted(s, d)
    return rounded(objective.gradient(t, fx.start(sup), 2.5), "g")


@query(None)
def fw_gap(s, d):
    """From the uniform matching of all pairs, the only support that surely holds a perfect matching."""
    e1, e2 = fx.pair(s, d)
    every = settle(support.all_pairs(e1, e2))
    n = every.select("u").distinct().count()
    t = settle(objective.terms(e1, e2, every))
    _, trace = assignment.frank_wolfe(t, every.withColumn("z", F.lit(1.0 / n)), rounds=2)
    return rounded(s.createDataFrame([(x["iteration"], float(x["gap"])) for x in trace], "iteration int, value double"), "value")


@query(None)
def assignment_best(s, d):
    e1, e2 = fx.pair(s, d)
    return assignment.assignment(rounded(objective.pair_distance(_simple_features(s, d, e1), _simple_features(s, d, e2)), "d"))


CATALOGUE["assignment"] = CATALOGUE.pop("assignment_best")


# Partitioning


def _bipartite(s, d):
    return fx.table(s, d, "lineitem").select(F.col("l_suppkey").alias("l"), F.col("l_partkey").alias("r")).distinct()


@query("""WITH b AS (SELECT DISTINCT l_suppkey AS l, l_partkey AS r FROM lineitem), n AS (SELECT r, l % 10 AS p, count(*) AS n FROM b GROUP BY 1, 2)
SELECT r AS node, CAST(p AS INTEGER) AS part_id FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY n DESC, p) AS k FROM n) WHERE k = 1""")
def partition_right_side(s, d):
    bip = _bipartite(s, d)
    return partitioner.partition_right(bip, bip.select(F.col("l").alias("node"), (F.col("l") % 10).cast("int").alias("part_id")).distinct())


@query(None)
def stream_partition(s, d):
    return partitioner.stream_partition(_bipartite(s, d), 10)


# Evaluation


@query(sql(""", p AS (SELECT DISTINCT src AS u, (7 * src + 3) % 25 AS v FROM e1), m AS (SELECT z.u, p.u AS w, z.z FROM z0 z JOIN p USING (v))
SELECT 'ell1_diff' AS metric, round(sum(CASE WHEN u = w THEN abs(z - 1) ELSE abs(z) END) + (SELECT count(*) FROM p) - count(*) FILTER (u = w), 6) AS value FROM m
UNION ALL SELECT 'dpm', round(sum(z) FILTER (u = w) / (SELECT count(*) FROM p), 6) FROM m"""))
def matching_stats(s, d):
    e1, e2 = fx.pair(s, d)
    return rounded(evaluate.matching_stats(fx.start(fx.support(e1, e2)), fx.true_matching(e1)), "value")


@query("""WITH t AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) / 1e6 AS nolin, count(*) AS sec FROM orders GROUP BY 1),
k AS (SELECT row_number() OVER (ORDER BY day) AS iteration, nolin, sec FROM t)
SELECT iteration, round(CAST(sum(sec) OVER (ORDER BY iteration) AS DOUBLE) / 60, 6) AS t_min, round(nolin + 0.5 * sec, 4) AS obj, round(sec / 15.0::DOUBLE, 6) AS res FROM k""")
def trace_transform(s, d):
    t = fx.table(s, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg((F.sum("o_totalprice") / 1e6).alias("nolin"), F.count(F.lit(1)).alias("sec"))
    t = t.withColumn("iteration", F.row_number().over(Window.orderBy("day")).cast("long"))
    t = t.select("iteration", F.col("sec").alias("seconds"), "nolin", F.col("sec").alias("lin"), F.col("sec").alias("residual"))
    return rounded(evaluate.trace_transform(t, 0.5, 5.0), "t_min", "res").withColumn("obj", F.round("obj", 4))


@query("""WITH w AS (SELECT user_id, event_type AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)
SELECT least(a.x, b.x) AS a, greatest(a.x, b.x) AS b, count(*) AS n FROM w a JOIN w b ON a.user_id = b.user_id AND b.pos > a.pos AND b.pos <= a.pos + 2 WHERE a.x <> b.x GROUP BY 1, 2""")
def walk_cooccurrence(s, d):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    w = fx.table(s, d, "events").select(F.col("user_id").alias("walk"), F.row_number().over(order).alias("pos"), F.col("event_type").alias("item"))
    return graph.walk_cooccurrence(w, 2)


# Generators


def _suppliers(s, d) -> int:
    """The generated graphs are as large as the supplier table."""
    return fx.table(s, d, "supplier").count()


N_SQL = "WITH n AS (SELECT count(*) AS n FROM supplier), i AS (SELECT unnest(range(0, n)) AS id, n FROM n)"


@query("""WITH n AS (SELECT CAST(ceil(log2(count(*))) AS INTEGER) AS b FROM supplier), i AS (SELECT unnest(range(0, CAST(power(2, b) AS BIGINT))) AS id, b FROM n)
SELECT id AS src, xor(id, CAST(1 << k AS BIGINT)) AS dst FROM (SELECT id, unnest(range(0, b)) AS k FROM i)""")
def generate_hypercube(s, d):
    return generate.hypercube(s, math.ceil(math.log2(_suppliers(s, d))))


@query(N_SQL + """, w AS (SELECT CAST(floor(sqrt(n)) AS BIGINT) AS c FROM n), g AS (SELECT unnest(range(0, c * (c + 1))) AS id, c FROM w)
, e AS (SELECT id AS a, id + 1 AS b FROM g WHERE id % (c + 1) < c UNION ALL SELECT id, id + c + 1 FROM g WHERE id < (c - 1) * (c + 1)) SELECT a AS src, b AS dst FROM e UNION SELECT b, a FROM e""")
def generate_grid(s, d):
    side = math.isqrt(_suppliers(s, d))
    return generate.grid(s, side, side + 1)


@query(N_SQL + """, g AS (
  SELECT id, n, k, 1 + CAST(floor(ln(greatest(CAST(('0x' || substr(md5(id || ',' || k || ',1'), 1, 13)) AS BIGINT), 1) / 4503599627370496.0::DOUBLE) / ln(0.95::DOUBLE)) AS BIGINT) AS gap
  FROM (SELECT id, n, unnest(range(1, least(n, CAST(floor(n * 0.05::DOUBLE + 8 * sqrt(n * 0.05::DOUBLE + 1) + 16) AS BIGINT)) + 1)) AS k FROM i)),
a AS (SELECT id, n, id + CAST(sum(gap) OVER (PARTITION BY id ORDER BY k) AS BIGINT) AS far FROM g),
e AS (SELECT id AS src, far AS dst FROM a WHERE far < n)
SELECT src, dst FROM e UNION SELECT dst, src FROM e""")
def generate_erdos_renyi(s, d):
    return generate.erdos_renyi(s, _suppliers(s, d), 0.05)


@query(N_SQL + """, w AS (SELECT CAST(ceil(sqrt(n)) AS BIGINT) AS c FROM n)
, g AS (SELECT id, id // c AS x, id % c AS y, c FROM (SELECT unnest(range(0, c * c)) AS id, c FROM w))
, e AS (SELECT id AS a, id + 1 AS b FROM g WHERE y < c - 1 UNION ALL SELECT id, id + c FROM g WHERE x < c - 1)
, q AS (
  SELECT id, x, y, c, d, t.k AS q, CASE t.k WHEN 0 THEN c - 1 - x WHEN 1 THEN c - 1 - y WHEN 2 THEN x ELSE y END AS a, CASE t.k WHEN 0 THEN c - 1 - y WHEN 1 THEN x WHEN 2 THEN y ELSE c - 1 - x END AS b
  FROM (SELECT *, unnest(range(1, 2 * (c - 1) + 1)) AS d FROM g), (SELECT unnest(range(0, 4)) AS k) t)
, h AS (SELECT *, greatest(0, least(a, d) - greatest(1, d - b) + 1) AS held FROM q)
, r AS (SELECT id, d, sum(held) AS ring, sum(held) * power(CAST(d AS DOUBLE), -2.0::DOUBLE) AS w FROM h GROUP BY 1, 2)
, cu AS (SELECT id, d, ring, w, sum(w) OVER (PARTITION BY id ORDER BY d) AS upto, sum(w) OVER (PARTITION BY id) AS total FROM r WHERE w > 0)
, ch AS (
  SELECT id, min(d) AS d FROM cu
  WHERE upto > CAST(('0x' || substr(md5(id || ',1,1'), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE * total GROUP BY 1)
, k AS (
  SELECT id, d, CAST(floor(CAST(('0x' || substr(md5(id || ',2,1'), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE * ring) AS BIGINT) AS k
  FROM ch JOIN r USING (id, d))
, p AS (
  SELECT *, k - coalesce(sum(held) OVER (PARTITION BY id ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS own FROM h JOIN k USING (id, d))
, f AS (
  SELECT id, c, x, y, CAST(greatest(1, d - b) + own AS BIGINT) AS s, CAST(d - greatest(1, d - b) - own AS BIGINT) AS o, q FROM p WHERE own >= 0 AND own < held)
SELECT a AS src, b AS dst FROM e UNION SELECT b, a FROM e
UNION SELECT id, (x + CASE q WHEN 0 THEN s WHEN 1 THEN -o WHEN 2 THEN -s ELSE o END) * c + y + CASE q WHEN 0 THEN o WHEN 1 THEN s WHEN 2 THEN -o ELSE -s END FROM f""")
def generate_small_world(s, d):
    return generate.small_world(s, math.ceil(math.sqrt(_suppliers(s, d))))


@query("""WITH n AS (SELECT l_partkey AS id FROM lineitem UNION SELECT l_suppkey + 1000000 FROM lineitem)
, a AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM n)
, b AS (SELECT id, row_number() OVER (ORDER BY CAST(('0x' || substr(md5(id || ',1'), 1, 13)) AS BIGINT), id) AS k FROM n)
SELECT a.id AS u, b.id AS v FROM a JOIN b USING (k)""")
def generate_permutation(s, d):
    return generate.permutation(fx.table(s, d, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1000000).alias("dst")))


@query("""WITH RECURSIVE e AS (
  SELECT c_custkey * 3 AS a, CAST(c_nationkey AS BIGINT) * 3 + 1 AS b FROM customer UNION SELECT CAST(n_nationkey AS BIGINT) * 3 + 1, CAST(n_regionkey AS BIGINT) * 3 + 2 FROM nation),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT DISTINCT a AS node, a AS root FROM s UNION SELECT s.b, r.root FROM r JOIN s ON s.a = r.node WHERE r.root < s.b OR s.b % 3 > 0)
SELECT node, min(root) AS component FROM r GROUP BY 1""")
def connected_components(s, d):
    """Customers, their nations and regions as one graph."""
    own = fx.table(s, d, "customer").select((F.col("c_custkey") * 3).alias("src"), (F.col("c_nationkey").cast("long") * 3 + 1).alias("dst"))
    up = fx.table(s, d, "nation").select((F.col("n_nationkey").cast("long") * 3 + 1).alias("src"), (F.col("n_regionkey").cast("long") * 3 + 2).alias("dst"))
    return components.connected_components(own.union(up))


def walks_sql(length: int, walks: int) -> str:
    """Walks over the undirected graph 1, step by step; a step's neighbour comes from an MD5."""
    text = f"""
, nb AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS at, count(*) OVER (PARTITION BY src) AS deg FROM e1)
, w0 AS (SELECT n.src AS start, k.range AS walk, n.src AS item FROM (SELECT DISTINCT src FROM e1) n, range(1, {walks + 1}) k)"""
    for k in range(1, length + 1):
        text += f"""
, w{k} AS (SELECT w.start, w.walk, nb.dst AS item FROM w{k - 1} w JOIN nb ON nb.src = w.item
  AND nb.at = CAST(('0x' || substr(md5(w.start || ',' || w.walk || ',{k},1'), 1, 13)) AS BIGINT) % nb.deg)"""
    every = " UNION ALL ".join(f"SELECT start, CAST(walk AS INTEGER) AS walk, item, {k} AS pos FROM w{k}" for k in range(length + 1))
    return text + f", walks AS ({every})"


@query(sql(walks_sql(5, 50) + " SELECT * FROM walks"))
def random_walks(s, d):
    e = fx.graph(s, d)
    return graph.random_walks(e, graph.nodes(e), length=5)


@query(sql(walks_sql(5, 50) + " SELECT start, item, count(*) AS n FROM walks WHERE pos > 0 AND item <> start GROUP BY 1, 2"))
def walk_pairs(s, d):
    e = fx.graph(s, d)
    return graph.walk_pairs(graph.random_walks(e, graph.nodes(e), length=5)).groupBy("start", "item").agg(F.count(F.lit(1)).alias("n"))


@query("WITH n AS (SELECT l_partkey AS id FROM lineitem UNION SELECT l_suppkey + 1000000 FROM lineitem) SELECT id AS old_id, row_number() OVER (ORDER BY id) AS new_id FROM n")
def id_order(s, d):
    lines = fx.table(s, d, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1000000).alias("dst"))
    return graph.sorted_ids(lines)


@query(sql(rank_sql("hub", 5, "pr") + " SELECT node, round(score, 6) AS score FROM pr ORDER BY score DESC, node"))
def pagerank_ordered(s, d):
    return graph.ordered(rounded(graph.pagerank(fx.directed(s, d, hub=True), rounds=5, eps=0.0), "score"))


@query(sql("""SELECT 'edges' AS step, 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM e1
UNION ALL SELECT 'edges', 'loops', CAST(count(*) FILTER (src = dst) AS DOUBLE) FROM e1
UNION ALL SELECT 'nodes', 'rows', CAST(count(*) AS DOUBLE) FROM g1 UNION ALL SELECT 'nodes', 'degrees', CAST(sum(deg) AS DOUBLE) FROM g1"""))
def runtime_rows(s, d):
    """Figures that the steps' own passes give; their seconds are left out here."""
    run = runtime.Runtime()
    at = _folder(s, "runtime")
    with run.timed("edges"):
        run.watched("edges", fx.graph(s, d), loops=F.count_if(F.col("src") == F.col("dst"))).write.parquet(f"{at}/edges")
    with run.timed("nodes"):
        run.watched("nodes", graph.degree_counts(s.read.parquet(f"{at}/edges")), degrees=F.sum("deg")).write.parquet(f"{at}/nodes")
    return run.rows(s).where("metric <> 'seconds'")


# Sources and sinks: what is written comes back


def _folder(s, name: str) -> str:
    return f"{shared_folder(s).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem")
def edge_list_round_trip(s, d):
    at = _folder(s, "edges")
    writers.edge_list(_bipartite(s, d).select(F.col("l").alias("src"), F.col("r").alias("dst")), at)
    return readers.edge_list(s, at).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))


@query(sql("SELECT u, v FROM support"))
def pairs_round_trip(s, d):
    at = _folder(s, "pairs")
    writers.pairs(fx.support(*fx.pair(s, d)), at)
    return readers.pairs(s, at).select(F.col("u").cast("int").alias("u"), F.col("v").cast("int").alias("v"))


@query(sql("SELECT u, v, round(d, 6) AS d FROM cost"))
def costs_round_trip(s, d):
    at = _folder(s, "costs")
    writers.costs(fx.cost(s, d), at)
    return rounded(readers.costs(s, at).select(F.col("u").cast("int").alias("u"), F.col("v").cast("int").alias("v"), "d"), "d")


@query("WITH b AS (SELECT DISTINCT l_suppkey AS l FROM lineitem) SELECT CAST(l % 10 AS INTEGER) AS part_id, count(*) AS size FROM b GROUP BY 1")
def partition_balance(s, d):
    return partitioner.balance(_bipartite(s, d).select("l", (F.col("l") % 10).cast("int").alias("part_id")).distinct())


@query(sql("SELECT u, v, round(sum(z) / 2, 6) AS z FROM (SELECT u, v, z FROM z0 UNION ALL SELECT u, v, 1 FROM support WHERE u = v) GROUP BY 1, 2"))
def average_solutions(s, d):
    z = fx.start(fx.support(*fx.pair(s, d)))
    return rounded(evaluate.average([z, z.where("u = v").withColumn("z", F.lit(1.0))]), "z")
