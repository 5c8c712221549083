"""Graph analytics on edge tables ``edges(src, dst)``; an undirected graph holds both directions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import loop_to_zero
from ..plans.loop import settle


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def symmetrise(edges: DataFrame, distinct: bool = True) -> DataFrame:
    both = edges.select("src", "dst").union(reverse(edges))
    return both.distinct() if distinct else both


def nodes(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node")))
    return ends.distinct()


def degree_counts(edges: DataFrame) -> DataFrame:
    """node, deg of every source; self-loops count 0 but keep their node, nodes that are only targets are absent."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.sum(loop_to_zero(F.col("src"), F.col("dst"))).cast("long").alias("deg"))


def wl_colors(edges: DataFrame, depth: int = 10) -> DataFrame:
    """node, color after ``depth`` refinement rounds.

    A round gives a node the multiset of its out-neighbours' and of its in-neighbours' colours; its own
    colour takes no part.  A multiset is known by its size and two sums of hashes, which add up before
    the shuffle, so a hub's neighbourhood is never gathered.  Colours compare across graphs.
    """
    colors = nodes(edges).withColumn("color", F.lit("1"))
    for n in range(depth):
        colors = _refine(edges, colors)
        if n % 3 == 2:
            colors = settle(colors)
    return colors


def _refine(edges: DataFrame, colors: DataFrame) -> DataFrame:
    def side(near: str, far: str, name: str) -> DataFrame:
        seen = edges.join(colors.withColumnRenamed("node", far), far)
        sums = [F.sum(F.xxhash64("color", F.lit(s)).cast("decimal(38,0)")).cast("string") for s in (1, 2)]
        return seen.groupBy(F.col(near).alias("node")).agg(F.concat_ws(":", F.count(F.lit(1)), *sums).alias(name))

    both = side("src", "dst", "o").join(side("dst", "src", "i"), "node", "full_outer")
    return both.select("node", F.md5(F.concat_ws("|", F.coalesce("o", F.lit("0")), F.coalesce("i", F.lit("0")))).alias("color"))


def wl_color_counts(edges: DataFrame, depth: int) -> DataFrame:
    """round, n_colors after each round."""
    out, colors = None, nodes(edges).withColumn("color", F.lit("1"))
    for n in range(1, depth + 1):
        colors = settle(_refine(edges, colors))
        one = colors.agg(F.countDistinct("color").alias("n_colors")).select(F.lit(n).alias("round"), "n_colors")
        out = one if out is None else out.union(one)
    return out


def ring_sizes(edges: DataFrame, k: int) -> DataFrame:
    """node, r1..rk: out-degree (with repeats), then nodes first reached at hop 2..k, the node itself left out."""
    every = nodes(edges)
    out = every.join(edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("r1")), "node", "left")
    step = edges.select("src", "dst").distinct()
    seen = front = step
    for r in range(2, k + 1):
        far = front.select("src", F.col("dst").alias("mid")).join(step.select(F.col("src").alias("mid"), "dst"), "mid")
        front = far.select("src", "dst").distinct().where("src <> dst").join(seen, ["src", "dst"], "left_anti")
        front = settle(front)
        seen = seen.union(front)
        out = out.join(front.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias(f"r{r}")), "node", "left")
    return out.select("node", *[F.coalesce(f"r{r}", F.lit(0)).cast("long").alias(f"r{r}") for r in range(1, k + 1)])


def ball_sizes(edges: DataFrame, k: int) -> DataFrame:
    """node, b1..bk: distinct nodes within 1..k hops (itself through a cycle too); null without out-edges."""
    step = edges.select("src", "dst").distinct()
    out, ball = nodes(edges), step
    for r in range(1, k + 1):
        if r > 1:
            far = ball.select("src", F.col("dst").alias("mid")).join(step.select(F.col("src").alias("mid"), "dst"), "mid")
            ball = settle(ball.union(far.select("src", "dst")).distinct())
        out = out.join(ball.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias(f"b{r}")), "node", "left")
    return out


def walk_counts(edges: DataFrame, k: int) -> DataFrame:
    """node, w1..wk, c1..ck: walks of each length that start at the node, and those that end there too.

    Pairs carry counts, so walks are never listed one by one.
    """
    step = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m"))
    out, walks = nodes(edges), step.select("src", "dst", F.col("m").alias("n"))
    for r in range(1, k + 1):
        if r > 1:
            on = walks.select("src", F.col("dst").alias("mid"), "n").join(step.select(F.col("src").alias("mid"), "dst", "m"), "mid")
            walks = settle(on.groupBy("src", "dst").agg(F.sum(F.col("n") * F.col("m")).alias("n")))
        closed = F.sum(F.when(F.col("src") == F.col("dst"), F.col("n")))
        out = out.join(walks.groupBy(F.col("src").alias("node")).agg(F.sum("n").alias(f"w{r}"), closed.alias(f"c{r}")), "node", "left")
    columns = [f"{c}{r}" for c in "wc" for r in range(1, k + 1)]
    return out.select("node", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in columns])


def pagerank(edges: DataFrame, gamma: float = 0.15, rounds: int = 50, eps: float = 1e-3, exact: bool = False) -> DataFrame:
    """node, score.  Dangling mass is lost.

    By default a node without in-edges leaves the table after the first round, stops giving, and gets
    gamma / n at the end; ``exact`` keeps it with gamma / n all along.  Stops when the scores of the nodes
    present before and after change by eps at most in total.
    """
    every = settle(nodes(edges))
    n = every.count()
    if not n:
        return every.withColumn("score", F.lit(None).cast("double"))
    out_degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    links = settle(edges.join(out_degree, "src").select("src", "dst", "deg"))
    score = every.withColumn("score", F.lit(1.0 / n))
    for _ in range(rounds):
        given = links.join(score.withColumnRenamed("node", "src"), "src")
        got = given.groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") / F.col("deg")).alias("s"))
        got = got.select("node", (F.lit(1.0 - gamma) * F.col("s") + F.lit(gamma / n)).alias("score"))
        if exact:
            got = every.join(got, "node", "left").select("node", F.coalesce("score", F.lit(gamma / n)).alias("score"))
        got = settle(got)
        if eps > 0:
            change = got.join(score.withColumnRenamed("score", "old"), "node").agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0]
            score = got
            if change is not None and change <= eps:
                break
        score = got
    late = every.join(score, "node", "left_anti").withColumn("score", F.lit(gamma / n))
    return score.union(late)


def attributes(edges: DataFrame, k: int, **rank) -> DataFrame:
    """node, features: rings, walks, closed walks and rank as one array of 3 k + 1 doubles."""
    parts = ring_sizes(edges, k).join(walk_counts(edges, k), "node").join(pagerank(edges, **rank), "node")
    order = [f"{c}{r}" for c in "rwc" for r in range(1, k + 1)] + ["score"]
    return parts.select("node", F.array(*[F.col(c).cast("double") for c in order]).alias("features"))


def mean_attributes(features: DataFrame) -> DataFrame:
    """pos, mean over all nodes."""
    return features.select(F.posexplode("features").alias("pos", "value")).groupBy("pos").agg(F.avg("value").alias("mean"))


def compact_ids(rows: DataFrame, line: str = "line", columns: tuple[str, str] = ("src", "dst")) -> DataFrame:
    """old_id, new_id: ids renumbered from 0 by first appearance in ``rows(line, src, dst)``.

    First appearances are ranked in two steps (count of each block of lines, then inside the block), so
    no single task orders all ids.
    """
    from pyspark.sql import Window

    ends = [rows.select(F.col(c).alias("old_id"), F.col(line).alias("l"), F.lit(i).alias("e")) for i, c in enumerate(columns)]
    first = ends[0].union(ends[1]).groupBy("old_id").agg(F.min(F.struct("l", "e")).alias("f")).withColumn("block", F.floor(F.col("f.l") / 65536))
    sizes = first.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = F.row_number().over(Window.partitionBy("block").orderBy("f", "old_id"))
    return first.withColumn("at", inner).join(bases, "block").select("old_id", (F.col("base") + F.col("at") - 1).cast("long").alias("new_id"))


def walk_cooccurrence(walks: DataFrame, width: int) -> DataFrame:
    """a, b, n from ``walks(walk, pos, item)``: unordered pairs of different items at most ``width`` apart."""
    there = walks.select("walk", F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + width)).alias("pos"), F.col("item").alias("x"))
    near = there.join(walks, ["walk", "pos"]).where(F.col("x") != F.col("item"))
    return near.groupBy(F.least("x", "item").alias("a"), F.greatest("x", "item").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def random_walks(edges: DataFrame, starts: DataFrame, length: int = 5, walks: int = 50, seed: int = 1) -> DataFrame:
    """start, walk, item, pos: uniform walks from ``starts(node)``; a step's neighbour is chosen by a seeded hash."""
    from pyspark.sql import Window

    from .generate import drawn

    ranked = edges.select("src", "dst").distinct().withColumn("at", F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1)
    sized = settle(ranked.join(edges.select("src", "dst").distinct().groupBy("src").agg(F.count(F.lit(1)).alias("deg")), "src"))
    degree = sized.select("src", "deg").distinct()
    now = starts.select(F.col("node").alias("start"), F.explode(F.sequence(F.lit(1), F.lit(walks))).alias("walk"), F.col("node").alias("item"))
    out = now.withColumn("pos", F.lit(0))
    for pos in range(1, length + 1):
        chosen = now.join(degree, now.item == degree.src).withColumn("at", drawn(F.col("start"), F.col("walk"), F.lit(pos), F.lit(seed)) % F.col("deg"))
        now = settle(chosen.select("start", "walk", "src", "at").join(sized.drop("deg"), ["src", "at"]).select("start", "walk", F.col("dst").alias("item")))
        out = out.unionByName(now.withColumn("pos", F.lit(pos)))
    return out


def walk_pairs(walks: DataFrame) -> DataFrame:
    """start, item: every other node that a walk from start visits, once for each visit."""
    return walks.where((F.col("pos") > 0) & (F.col("item") != F.col("start"))).select("start", "item")


def sorted_ids(edges: DataFrame, block: int = 65536) -> DataFrame:
    """old_id, new_id: integer nodes numbered from 1 in their order, ranked block by block of ids."""
    from pyspark.sql import Window

    every = nodes(edges).select(F.col("node").alias("old_id")).withColumn("block", F.floor(F.col("old_id") / block))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = every.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    bases = sizes.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = F.row_number().over(Window.partitionBy("block").orderBy("old_id"))
    return every.withColumn("at", inner).join(bases, "block").select("old_id", (F.col("base") + F.col("at")).cast("long").alias("new_id"))


def ordered(scores: DataFrame) -> DataFrame:
    """node, score from the highest score down, ties by node (a range sort)."""
    return scores.select("node", "score").orderBy(F.col("score").desc(), "node")


def exogenous(features: DataFrame, first: int, number: int) -> DataFrame:
    """node and ``number`` features from position ``first`` (from 0) on."""
    return features.select("node", F.slice("features", first + 1, number).alias("features"))
