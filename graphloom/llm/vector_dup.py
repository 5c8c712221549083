"""Near-duplicate vectors by a forest of random-projection trees with spill.

Every tree splits the unit vectors again and again along a random projection, near its median where few
vectors lie; vectors close to a split go to both sides.  The trees are fitted on a bounded sample, then every row is sent through
them.  Rows meet in leaves, where all pairs are compared in double precision.  A pair that meets in
several leaves counts in the first one only, so links are counted where they are found and never
travel: a leaf returns each member's number of links and one edge to its group in the leaf.

Equal vectors are one row with a number of copies.  A leaf that is too large for one comparison is
compared in blocks, every pair of blocks, so it loses nothing.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, sample_by_hash, split_join
from .components import components, small_components

#: Least and largest number of trees; share of close pairs that may stay apart in all trees.
TREES, MOST_TREES, LOST = 4, 12, 0.002
#: Share of close pairs (cosine 0.95) that a split with this spill keeps together, for isotropic vectors.
TOGETHER = 0.97
#: Half width of the spill around a split, times the root of the width, in units of cosine distance 1.
SPILL = 0.128
#: Random planes tried for a split, and the share of rows close to it from which a leaf is not split.
PLANES, DENSE = 4, 0.3
#: Sample that the trees are fitted on, rows of a leaf that are aimed at, and rows of one comparison.
SAMPLE, LEAF, BLOCK = 40_000, 400, 2_000
#: Sample rows that a split needs; further splits of a leaf beyond its tree at most.
LEAST_SAMPLE, FURTHER = 32, 24


def trees_for(rows: int, leaf: int = LEAF) -> int:
    """Trees that keep the share of lost pairs under ``LOST`` at the depth that so many rows need."""
    kept = TOGETHER ** max(1.0, np.log2(max(2, rows) / leaf))
    return int(np.clip(np.ceil(np.log(LOST) / np.log(1 - kept)), TREES, MOST_TREES))


class Forest:
    """Split planes of all trees; leaves are numbered over the whole forest.

    A leaf's number is its place among the leaves of the trees times 2**FURTHER plus the sides it takes in
    the further splits.
    """

    def __init__(self, sample: np.ndarray, rows: int, trees: int | None = None, leaf: int = LEAF, seed: int = 5):
        rng = np.random.default_rng(seed)
        width = sample.shape[1]
        share = max(1, rows) / max(1, len(sample))
        self.spill, self.seed, self.width = SPILL / width**0.5, seed, width
        self.planes, self.cuts, self.sides, self.roots = [], [], [], []
        self.leaves = 0
        #: Cuts of a leaf's further splits; NaN stands for a plane that is passed over.
        self.further: dict[int, list[float]] = {}

        def fewest(part: np.ndarray, planes, spans) -> tuple[float, np.ndarray, float] | None:
            """(share of rows close to it, plane, cut) that fewest rows lie close to."""
            best, chosen = DENSE, None
            for plane in planes:
                p = np.sort(part @ plane)
                cuts = p[(len(p) * spans).astype(int)]
                near = (np.searchsorted(p, cuts + self.spill) - np.searchsorted(p, cuts - self.spill)) / len(p)
                k = int(near.argmin())
                if near[k] < best:
                    best, chosen = near[k], (near[k], plane, float(cuts[k]))
            return chosen

        def random_planes():
            for _ in range(PLANES):
                plane = rng.standard_normal(width)
                yield plane / np.linalg.norm(plane)

        def finish(part: np.ndarray) -> int:
            """A leaf of the tree, split further as long as its rows are expected to be too many."""
            number, size, cuts = self.leaves, len(part) * share, []
            self.leaves += 1
            while len(part) >= 2 and size > leaf and len(cuts) < FURTHER:
                found = fewest(part, [self.plane(number, len(cuts))], np.array([0.5]))
                cuts.append(found[2] if found else float("nan"))
                size *= (1 + found[0]) / 2 if found else 1
                if len(cuts) >= PLANES and np.isnan(cuts[-PLANES:]).all():
                    break  # too dense: one cluster
            if cuts:
                self.further[number] = cuts
            return -1 - number

        def grow(part: np.ndarray) -> int:
            """Node number, or -1 - leaf."""
            if len(part) * share <= leaf or len(part) < LEAST_SAMPLE:
                return finish(part)
            found = fewest(part, random_planes(), np.linspace(0.3, 0.7, 9))
            if found is None:  # too dense here: splitting would send most rows both ways
                self.leaves += 1
                return -self.leaves
            _, plane, at = found
            p, node = part @ plane, len(self.planes)
            self.planes.append(plane)
            self.cuts.append(at)
            self.sides.append([0, 0])
            low, high = part[p < at + self.spill], part[p >= at - self.spill]
            self.sides[node] = [grow(low), grow(high)]
            return node

        for _ in range(trees or trees_for(rows, leaf)):
            self.roots.append(grow(sample))

    def plane(self, leaf: int, level: int) -> np.ndarray:
        """Unit vector drawn from a leaf's number and the level of the further split."""
        drawn = np.random.default_rng((self.seed, leaf, level)).standard_normal(self.width)
        return drawn / np.linalg.norm(drawn)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that a row reaches."""
        rows, leaves = [], []
        todo = [(root, np.arange(len(x))) for root in self.roots]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node < 0:
                number = np.full(len(at), (-node - 1) << FURTHER, np.int64)
                for level, edge in enumerate(self.further.get(-node - 1, ())):
                    if np.isnan(edge):
                        continue
                    p = x[at] @ self.plane(-node - 1, level)
                    low, high = p < edge + self.spill, p >= edge - self.spill
                    at, number = np.r_[at[low], at[high]], np.r_[number[low], number[high] | (1 << level)]
                rows.append(at)
                leaves.append(number)
                continue
            p = x[at] @ self.planes[node]
            todo.append((self.sides[node][0], at[p < self.cuts[node] + self.spill]))
            todo.append((self.sides[node][1], at[p >= self.cuts[node] - self.spill]))
        return np.concatenate(rows), np.concatenate(leaves)


def _unit(column: pa.Array, width: int) -> np.ndarray:
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _placed(sent, width: int):
    def run(batches):
        forest: Forest = pickle.loads(sent.value)
        for batch in batches:
            row, leaf = forest.place(_unit(batch.column("v"), width))
            order = np.lexsort((leaf, row))
            row, leaf = row[order], leaf[order]
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(leaf))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "copies", "v")), lists], ["rep", "copies", "v", "leaves"])

    return run


def compare(ids, copies, x, leaves, blocks, here: int, least: float):
    """Links of one leaf or pair of blocks: (ids, links of each, root of each).

    A pair counts only in the first leaf that both members reach, and in one pair of blocks.
    """
    n = len(ids)
    links = np.zeros(n, np.int64)
    found_a, found_b = [], []
    for lo in range(0, n, 512):
        dots = x[lo : lo + 512] @ x.T
        a, b = np.nonzero(dots >= least - 1e-9)
        a += lo
        keep = a < b
        if blocks is not None:
            keep &= blocks[a] != blocks[b]
        a, b = a[keep], b[keep]
        fine = np.concatenate([np.einsum("ij,ij->i", x[a[i : i + 65536]], x[b[i : i + 65536]]) for i in range(0, len(a), 65536)]) if len(a) else np.zeros(0)
        a, b = a[fine >= least], b[fine >= least]
        found_a.append(a)
        found_b.append(b)
        for i in range(0, len(a), 16384):
            p, q = leaves[a[i : i + 16384]], leaves[b[i : i + 16384]]
            earlier = ((p[:, :, None] == q[:, None, :]) & (p < here)[:, :, None] & (p >= 0)[:, :, None]).any(axis=(1, 2))
            u, w = a[i : i + 16384][~earlier], b[i : i + 16384][~earlier]
            np.add.at(links, u, copies[w])
            np.add.at(links, w, copies[u])
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    return links, small_components(n, a, b)


def _leaf(width: int, least: float):
    def run(key, table):
        ids = table.column("rep").to_numpy()
        order = np.argsort(ids, kind="stable")
        table = table.take(pa.array(order))
        ids, copies = ids[order], table.column("copies").to_numpy()
        x = _unit(table.column("v").combine_chunks(), width)
        lists = table.column("leaves").combine_chunks()
        ends, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy()
        size = np.diff(ends)
        pad = np.full((len(ids), int(size.max(initial=1))), -1)
        pad[np.arange(pad.shape[1]) < size[:, None]] = flat
        one, two = key[1].as_py(), key[2].as_py()
        blocks = None if one == two else table.column("block").to_numpy()
        links, root = compare(ids, copies, x, pad, blocks, key[0].as_py(), least)
        keep = (links > 0) | (root != np.arange(len(ids)))
        return pa.table({"rep": ids[keep], "links": links[keep], "root": ids[root][keep]})

    return run


def near_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", least: float = 0.95) -> DataFrame:
    """key, n_links, component_id (smallest key reachable) and kept, a row for each row of ``vectors``.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do rows
    with a null key.  Vectors of different widths never link.  Repeated rows are linked as copies.  An empty table
    gives an empty result; columns besides key and vector are ignored.
    """
    spark = vectors.sparkSession
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(column, lambda x: x != 0)
    whole = F.col(key).isNotNull() & F.col(column).isNotNull() & (F.size(column) > 0) & fine
    rows = vectors.select(F.col(key).cast("long").alias("node"), F.when(whole, F.col(column)).alias("v"))
    # Adding zero makes -0.0 and 0.0 the same vector; components keep their type until they are compared.
    item = vectors.schema[column].dataType.elementType.simpleString()
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0).cast(item)))
    classes = cut(rows.where("v is not null").groupBy("v").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("copies")))
    counted, edges = None, None
    for r in classes.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy("d").collect():
        width, n = r["d"], r["n"]
        own = classes.where(F.size("v") == width)
        sample = np.array([x["v"] for x in sample_by_hash(own.select("rep", "v"), ("rep", "v"), SAMPLE).orderBy("rep").toLocalIterator()], np.float64)
        sample = sample.reshape(-1, width)
        sample /= np.linalg.norm(sample, axis=1, keepdims=True)
        sent = spark.sparkContext.broadcast(pickle.dumps(Forest(sample, n)))
        placed = own.select("rep", "copies", "v").mapInArrow(_placed(sent, width), f"rep long, copies long, v array<{item}>, leaves array<long>")
        spread = placed.withColumn("leaf", F.explode("leaves"))
        sizes = placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("size"))
        parts = F.ceil(F.col("size") / BLOCK).cast("int")
        spread = spread.join(sizes.where(F.col("size") > BLOCK).withColumn("parts", parts).drop("size"), "leaf", "left")
        spread = spread.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
        # A block meets itself and, in a pair, every other block of its leaf.
        spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        spread = spread.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))
        found = spread.groupBy("leaf", "one", "two").applyInArrow(_leaf(width, least), "rep long, links long, root long")
        found = cut(found)
        part = found.groupBy("rep").agg(F.sum("links").alias("links"))
        link = found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))
        counted = part if counted is None else counted.union(part)
        edges = link if edges is None else edges.union(link)
    if counted is None:
        return rows.select(F.col("node").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("node").alias("component_id"), F.lit(True).alias("kept"))
    group = components(edges).withColumnRenamed("node", "rep")
    told = cut(classes.join(counted, "rep", "left").join(group, "rep", "left").select(
        "v", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")
    ))
    # Rows without a whole vector are kept out of the join, where they would meet in one task.
    with_vector = split_join(rows.where("v is not null"), told, "v", "copies", rows.count()).select("node", "n_links", "component_id")
    every = with_vector.union(rows.where("v is null").select("node", F.lit(0).cast("long"), F.lit(None).cast("long")))
    return every.select(
        F.col("node").alias(key), F.col("n_links").cast("long").alias("n_links"), F.coalesce("component_id", "node").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("component_id") == F.col(key), F.lit(True)))


#: The query with least = 0.95 on finite, non-zero vectors: all pairs, and reachability by recursion.
ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1),
k AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT v.vec_id, coalesce(k.n, 0) AS n_links, m.component_id, v.vec_id = m.component_id AS kept
FROM v JOIN m ON m.a = v.vec_id LEFT JOIN k ON k.a = v.vec_id
"""
