"""Graph generators and perturbations as range expressions and seeded hashes.

Undirected families hold both directions.  Chance is a hash of seed and ids, so a graph is the same on
every run and however it is partitioned.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.loop import settle
from .components import is_connected
from .graph import nodes, symmetrise
from .ranks import ranked


def chance(seed: int, *columns: Column) -> Column:
    """Uniform in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def drawn(*columns: Column) -> Column:
    """Whole number below 2**52 from the MD5 of the values joined by commas: the same on every engine."""
    text = F.concat_ws(",", *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def normal(seed: int, *columns: Column) -> Column:
    u, w = (F.greatest(chance(s, *columns), F.lit(1e-12)) for s in (seed, seed + 1_000_003))
    return F.sqrt(-2 * F.log(u)) * F.cos(F.lit(2 * math.pi) * w)


def laplace(seed: int, *columns: Column) -> Column:
    u = chance(seed, *columns) - 0.5
    return -F.signum(u) * F.log(F.greatest(1 - 2 * F.abs(u), F.lit(1e-12)))


def _edges(spark: SparkSession, n: int, *targets: str, where: str = "true") -> DataFrame:
    """Both directions of id -> each target expression, for ids 0..n-1."""
    far = F.explode(F.array(*[F.expr(t) for t in targets]))
    one = spark.range(n).where(where).select(F.col("id").alias("src"), far.alias("dst"))
    return symmetrise(one.select("src", F.col("dst").cast("long").alias("dst")).where("dst is not null and dst <> src"))


def cycle(spark: SparkSession, n: int) -> DataFrame:
    return _edges(spark, n, f"(id + 1) % {n}")


def star(spark: SparkSession, n: int) -> DataFrame:
    """Node 0 with n leaves."""
    return _edges(spark, n + 1, "0", where="id > 0")


def grid(spark: SparkSession, rows: int, columns: int) -> DataFrame:
    return _edges(spark, rows * columns, f"if(id % {columns} < {columns - 1}, id + 1, null)", f"if(id < {(rows - 1) * columns}, id + {columns}, null)")


def balanced_tree(spark: SparkSession, branching: int, height: int) -> DataFrame:
    n = (branching ** (height + 1) - 1) // (branching - 1) if branching > 1 else height + 1
    return _edges(spark, n, f"floor((id - 1) / {branching})", where="id > 0")


def circular_ladder(spark: SparkSession, n: int) -> DataFrame:
    return _edges(spark, 2 * n, f"if(id < {n}, (id + 1) % {n}, {n} + (id - {n} + 1) % {n})", f"if(id < {n}, id + {n}, null)")


def lollipop(spark: SparkSession, clique: int, path: int) -> DataFrame:
    """A clique with a path hung on its last node."""
    whole = spark.range(clique).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(clique - 1).cast("long"))).alias("dst")).where("src <> dst")
    return whole.union(_edges(spark, clique + path, "id - 1", where=f"id >= {clique}"))


def hypercube(spark: SparkSession, dimensions: int) -> DataFrame:
    return _edges(spark, 1 << dimensions, *[f"id ^ {1 << d}" for d in range(dimensions)])


def expander(spark: SparkSession, side: int) -> DataFrame:
    """Margulis-Gabber-Galil graph on a side x side torus."""
    x, y = f"floor(id / {side})", f"(id % {side})"
    at = lambda a, b: f"pmod({a}, {side}) * {side} + pmod({b}, {side})"
    return _edges(spark, side * side, at(f"{x} + 2 * {y}", y), at(f"{x} + 2 * {y} + 1", y), at(x, f"{y} + 2 * {x}"), at(x, f"{y} + 2 * {x} + 1"))


#: Pairs that a task of ``erdos_renyi`` draws, about; pairs of a batch.
DRAWN, PIECE = 1 << 20, 1 << 16


def _ends(node: int, n: int, p: float, most: int, seed: int) -> Iterator[np.ndarray]:
    """Greater neighbours of a node in order, a piece at a time: its k-th gap, of at most ``most``, is geometric in ``drawn(node, k, seed)``."""
    at, k = node, 1
    while at < n - 1 and k <= most and p > 0:
        more = min(most - k + 1, PIECE, int(1.05 * p * (n - at)) + 16)
        if p >= 1:
            gaps = np.ones(more, np.int64)
        else:
            texts = [b"%d,%d,%d" % (node, j, seed) for j in range(k, k + more)]
            bits = np.frombuffer(b"".join([hashlib.md5(t, usedforsecurity=False).digest() for t in texts]), ">u8")[::2] >> 12
            u = np.maximum(bits, 1) / float(1 << 52)
            gaps = np.minimum(1 + np.floor(np.log(u) / math.log1p(-p)), n).astype(np.int64)
        far = at + np.cumsum(gaps)
        yield far[far < n]
        at, k = int(far[-1]), k + more


def erdos_renyi(spark: SparkSession, n: int, p: float, seed: int = 1, sparse: bool = False, with_cycle: bool = False) -> DataFrame:
    """Each pair with probability p; ``sparse`` takes (1 + p) ln n / n instead; ``with_cycle`` adds the cycle over all nodes.

    Pairs are not listed: a node's gaps to its next neighbours are geometric, drawn from hashes.  Gaps are at least 1,
    so no pair comes twice and nothing is shuffled; there are as many more tasks as there are more pairs.
    """
    p = (1 + p) * math.log(n) / n if sparse else p
    most = min(n, int(n * p + 8 * math.sqrt(n * p + 1) + 16))

    def pairs(batches):
        held, size = [], 0

        def batch():
            a, b = (np.concatenate(x) for x in zip(*held))
            return pa.RecordBatch.from_arrays([pa.array(np.r_[a, b]), pa.array(np.r_[b, a])], ["src", "dst"])

        for ids in batches:
            for i in ids.column(0).to_pylist():
                # A node and its mirror image, so that tasks draw alike.
                for node in sorted({i, n - 1 - i}):
                    for far in _ends(node, n, p, most, seed):
                        held.append((np.full(len(far), node, np.int64), far))
                        size += len(far)
                        if size >= PIECE:
                            yield batch()
                            held, size = [], 0
        if held:
            yield batch()

    half = (n + 1) // 2
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(min(p, 1) * n * (n - 1) / 2 / DRAWN))
    both = spark.range(0, half, 1, max(1, min(half, tasks))).mapInArrow(pairs, "src long, dst long")
    return symmetrise(both.union(cycle(spark, n))) if with_cycle else both


#: Edges that a family drawn on the driver may have.
LARGEST = 10_000_000


def _bounded(edges: int) -> None:
    if edges > LARGEST:
        raise ValueError(f"{edges} edges are too many to draw on the driver; the bound is {LARGEST}")


def _driver(spark: SparkSession, pairs: set[tuple[int, int]]) -> DataFrame:
    return symmetrise(spark.createDataFrame(sorted(pairs), "src long, dst long"))


def barabasi_albert(spark: SparkSession, n: int, m: int, seed: int = 1) -> DataFrame:
    """Preferential attachment; sequential by definition, so it is drawn on the driver."""
    _bounded(n * m)
    rng = np.random.default_rng(seed)
    ends, pairs = list(range(m)), set()
    for v in range(m, n):
        picked: set[int] = set()
        while len(picked) < m:
            picked.add(int(ends[rng.integers(len(ends))]))
        pairs |= {(v, u) for u in picked}
        ends += [*picked, *[v] * m]
    return _driver(spark, pairs)


def watts_strogatz(spark: SparkSession, n: int, k: int, p: float, seed: int = 1, tries: int = 100, rounds: int = 100) -> DataFrame:
    """A connected ring lattice of k neighbours whose edges are each moved with probability p.

    A moved edge (src, s) keeps its source and draws another end until it meets neither itself nor another edge; of
    several that draw one pair in a round the first (src, s) has it.  So n * (k // 2) edges stay whatever p is.  Graphs that fall
    apart are drawn again; RuntimeError after ``tries`` of them, ValueError where there is no room for the edges.  Where
    all pairs are edges none can be moved.
    """
    if k // 2 < 1 or 2 * (k // 2) >= n:
        raise ValueError("k must be at least 2, and below n")
    p = 0.0 if 2 * (k // 2) == n - 1 else p
    for t in range(tries):
        edges = _moved_lattice(spark, n, k // 2, p, seed + 1000 * t, rounds)
        if is_connected(edges):
            return edges
    raise RuntimeError(f"no connected graph in {tries} tries")


def _moved_lattice(spark: SparkSession, n: int, half: int, p: float, seed: int, rounds: int) -> DataFrame:
    unit = lambda *c: drawn(*c) / F.lit(float(1 << 52))
    lattice = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(half))).alias("s"))
    lattice = settle(lattice.withColumn("moved", unit(F.col("src"), F.col("s"), F.lit(seed)) < p))
    far = (F.col("src") + F.col("s")) % n
    have = settle(lattice.where("not moved").select(F.least("src", far).alias("a"), F.greatest("src", far).alias("b")))
    left = lattice.where("moved").select("src", "s")
    for turn in range(rounds):
        end = F.floor(unit(F.col("src"), F.col("s"), F.lit(seed + 1), F.lit(turn)) * n).cast("long")
        tried = left.withColumn("end", end).withColumn("a", F.least("src", "end")).withColumn("b", F.greatest("src", "end"))
        won = tried.where("a <> b").join(have, ["a", "b"], "left_anti").groupBy("a", "b").agg(F.min(F.struct("src", "s")).alias("w"))
        won = settle(won.select("a", "b", "w.src", "w.s"))
        have = settle(have.union(won.select("a", "b")))
        left = settle(left.join(won.select("src", "s"), ["src", "s"], "left_anti"))
        if left.isEmpty():
            return symmetrise(have.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    raise RuntimeError(f"edges are left to move after {rounds} rounds")


def _rings(side: int, power: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Function from nodes of a side x side grid and shares u in [0, 1) to distances: the first whose rings up to it weigh more than u of all.

    A quadrant of a steps along its open axis and b along the other holds t(d) - t(d - a) - t(d - b - 1) + t(d - a - b - 1)
    nodes at distance d, where t(m) is m and not below 0.  So the weight of all rings up to a distance is a few
    differences of two running sums that all nodes share, and the distance is found by bisection.
    """
    d = np.arange(1, 2 * side, dtype=np.float64)
    flat, slope = (np.r_[0.0, np.cumsum(d**e)] for e in (-power, 1 - power))

    def upto(d: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Sum of t(d' - c) * d' ** -power over d' up to d."""
        return np.where(d > c, slope[d] - slope[c] - c * (flat[d] - flat[c]), 0.0)

    def find(node: np.ndarray, u: np.ndarray) -> np.ndarray:
        x, y = node // side, node % side
        up, right, down, left = side - 1 - x, side - 1 - y, x, y
        quadrants = [(up, right), (right, down), (down, left), (left, up)]

        def weight(d: np.ndarray) -> np.ndarray:
            return sum(upto(d, 0 * a) - upto(d, a) - upto(d, b + 1) + upto(d, a + b + 1) for a, b in quadrants)

        # Every ring up to the farthest corner holds a node.
        high = np.maximum(up, down) + np.maximum(left, right)
        low = np.minimum(1, high)
        aim = u * weight(high)
        while (low < high).any():
            mid = (low + high) // 2
            over = (weight(mid) > aim) | (low == high)
            low, high = np.where(over, low, mid + 1), np.where(over, mid, high)
        return low

    return find


def small_world(spark: SparkSession, side: int, seed: int = 1, power: float = 2.0) -> DataFrame:
    """Directed: a grid (both ways), and for each node one long link to a node at grid distance d with probability ~ d ** -power.

    A ring of distance d is a node's choice with the number of its nodes that lie on the grid times d ** -power; the
    node in the ring is drawn evenly.  Rings are weighed by formula and found by bisection, so neither pairs nor rings are listed.
    """

    def chosen(batches):
        find = _rings(side, power)
        for batch in batches:
            node, u = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(find(node, u))], ["src", "d"])

    node = spark.range(side * side).select(F.col("id").alias("src"), (drawn(F.col("id"), F.lit(1), F.lit(seed)) / F.lit(float(1 << 52))).alias("u"))
    x, y = F.floor(F.col("src") / side).cast("long"), (F.col("src") % side).cast("long")
    node = node.mapInArrow(chosen, "src long, d long").where("d > 0").select("src", "d", x.alias("x"), y.alias("y"))
    # Four half-open quadrants (dx > 0, dy >= 0 and its turns): extent along the open axis and along the other.
    up, down, right, left = F.lit(side - 1) - F.col("x"), F.col("x"), F.lit(side - 1) - F.col("y"), F.col("y")
    quadrants = [(up, right), (right, down), (down, left), (left, up)]
    first = lambda d, b: F.greatest(F.lit(1).cast("long"), d - b)
    held = lambda d, a, b: F.greatest(F.lit(0).cast("long"), F.least(a, d) - first(d, b) + 1)
    ring = sum((held(F.col("d"), a, b) for a, b in quadrants[1:]), held(F.col("d"), *quadrants[0]))
    # Settled, lest a filter on the far end is pushed down through all of these expressions.
    node = settle(node.withColumn("k", F.floor(drawn(F.col("src"), F.lit(2), F.lit(seed)) / F.lit(float(1 << 52)) * ring).cast("long")))
    d, k, base, dx, dy = F.col("d"), F.col("k"), F.lit(0).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("long")
    for (a, b), (i, j) in zip(quadrants, ((1, 1), (-1, 1), (-1, -1), (1, -1))):
        n = held(d, a, b)
        here = (k >= base) & (k < base + n)
        along = first(d, b) + k - base
        # The open axis is x in the first and third quadrant, y in the others.
        step = (along * i, (d - along) * j) if i == j else ((d - along) * i, along * j)
        dx, dy = F.when(here, step[0]).otherwise(dx), F.when(here, step[1]).otherwise(dy)
        base = base + n
    far = node.select("src", ((F.col("x") + dx) * side + F.col("y") + dy).alias("dst"))
    return grid(spark, side, side).union(far).distinct()


def regular(spark: SparkSession, n: int, degree: int, seed: int = 1) -> DataFrame:
    """Random regular graph: a circulant one whose edges exchange ends at random, ten times for each edge.

    Every exchange keeps the degrees and a simple graph.  Drawn on the driver; LARGEST bounds the edges.
    """
    if n * degree % 2 or degree >= n:
        raise ValueError("n * degree must be even and degree below n")
    _bounded(n * degree // 2)
    rng = np.random.default_rng(seed)
    ends = [(v, (v + s) % n) for s in range(1, degree // 2 + 1) for v in range(n)]
    ends += [(v, v + n // 2) for v in range(n // 2)] if degree % 2 else []
    held = {(min(e), max(e)) for e in ends}
    for _ in range(10 * len(ends)):
        (a, b), (c, d) = ends[i := int(rng.integers(len(ends)))], ends[j := int(rng.integers(len(ends)))]
        if rng.random() < 0.5:
            c, d = d, c
        one, two = (min(a, c), max(a, c)), (min(b, d), max(b, d))
        if a == c or b == d or one == two or one in held or two in held:
            continue
        held -= {(min(a, b), max(a, b)), (min(c, d), max(c, d))}
        held |= {one, two}
        ends[i], ends[j] = (a, c), (b, d)
    return _driver(spark, held)


def powerlaw_tree(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """Tree grown by preferential attachment, whose degrees follow a power law."""
    return barabasi_albert(spark, n, 1, seed)


def permutation(edges: DataFrame, seed: int = 1) -> DataFrame:
    """u, v: nodes in order and the same nodes in the order of a seeded draw, ranked range by range."""
    every = nodes(edges)
    a = ranked(every.select(F.col("node").alias("u")), "u", out="k")
    b = ranked(every.select(F.col("node").alias("v"), drawn(F.col("node"), F.lit(seed)).alias("_draw")), "_draw", "v", out="k")
    return a.join(b, "k").select("u", "v")


def relabel(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with ids sent through ``mapping(u, v)``."""
    first = edges.join(mapping.select(F.col("u").alias("src"), F.col("v").alias("s")), "src")
    return first.join(mapping.select(F.col("u").alias("dst"), F.col("v").alias("d")), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))


def perturb(edges: DataFrame, keep: float, n: int, seed: int = 1) -> DataFrame:
    """Keep an undirected edge with probability ``keep``; add as many non-edges as 1 - keep of all pairs draws."""
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    stay = edges.where(chance(seed, a, b) < keep)
    added = erdos_renyi(edges.sparkSession, n, 1 - keep, seed + 7).join(edges, ["src", "dst"], "left_anti") if keep < 1 else None
    return stay if added is None else stay.select("src", "dst").union(added)


#: Outliers that are broadcast.
MOST_OUTLIERS = 100_000


def disturb(edges: DataFrame, outliers: DataFrame) -> DataFrame:
    """Outlier nodes (``outliers(node)``) lose their edges and are joined to every node.

    The result has nodes times outliers edges; more than ``MOST_OUTLIERS`` outliers are an error.
    """
    if outliers.limit(MOST_OUTLIERS + 1).count() > MOST_OUTLIERS:
        raise ValueError(f"more than {MOST_OUTLIERS} outliers")
    off = edges.join(outliers.withColumnRenamed("node", "src"), "src", "left_anti").join(outliers.withColumnRenamed("node", "dst"), "dst", "left_anti")
    every = nodes(edges).crossJoin(F.broadcast(outliers.withColumnRenamed("node", "o"))).where("node <> o")  # outliers are a given few
    return off.select("src", "dst").union(symmetrise(every.select(F.col("node").alias("src"), F.col("o").alias("dst")))).distinct()


def noise(edges: DataFrame, kind: str = "normal", scale: float = 1e-3, mix: float = 0.5, seed: int = 1) -> DataFrame:
    """i, j, w: one symmetric weight for each undirected edge; kind normal, laplace or mix."""
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    draws = {"normal": normal(seed, a, b), "laplace": laplace(seed + 2, a, b)}
    if kind == "mix":
        draws["mix"] = F.when(chance(seed + 3, a, b) < mix, draws["normal"]).otherwise(draws["laplace"])
    return edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), (1 + F.lit(scale) * draws[kind]).alias("w"))


def split(nodes_: DataFrame, share: float = 0.7, seed: int = 1) -> DataFrame:
    """node, val: a deterministic split of the nodes."""
    return nodes_.select("node", (chance(seed, F.col("node")) < share).alias("val"))
