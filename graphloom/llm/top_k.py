"""Exact top-k inner products: vectors in order of length, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Components become integers, so scores are exact.  A rotation that is fitted on a bounded sample (the
right singular vectors) moves most of the length into the first coordinates.  The vectors are dealt to tasks by
ranges of descending length, and each task works through its own in that order, in blocks; a task of short
vectors stops at its first block.  A query is done when length times its
own length cannot reach its k-th score so far; for the others the product of the first coordinates
plus the product of the residual lengths bounds the score, and only pairs whose bound reaches the k-th
score are multiplied out.
"""

from __future__ import annotations

import itertools
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, sample_by_hash

#: Queries of one search, and bytes of queries that one pass over the vectors answers; so much is broadcast or on the driver.
QUERY_BLOCK, QUERY_BYTES = 8192, 64 << 20
#: Bound of the rotation's training sample, and of the longest vectors that give first thresholds.
SAMPLE, LONGEST = 4096, 2048
#: Candidates and queries of one matrix product.
ROWS, COLUMNS = 4096, 512
#: Stands for no score yet.
NONE = -(1 << 62)
#: Leading coordinates of the partial sum, as a share of all.
LEAD = 0.5


def quantised(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", scale: int = 256) -> DataFrame:
    """key, v: floor(scale * component) as integers.  Leaves out null keys, null, empty or non-finite vectors."""
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(column, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.where(F.col(key).isNotNull() & F.col(column).isNotNull() & (F.size(column) > 0) & fine).select(
        F.col(key).cast("long").alias("vec_id"), whole.alias("v")
    )


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, width)


def rotation(sample: np.ndarray) -> np.ndarray:
    """Right singular vectors, leading ones first (an orthonormal basis also for few rows)."""
    return np.linalg.svd(sample.T @ sample)[0] if len(sample) else np.eye(sample.shape[1])


class Search:
    """A block of queries with its rotation, its k best so far and the thresholds they give.

    What one call of ``run`` has reached holds for the next, so vectors may come in any number of parts and
    ``found`` is read once.
    """

    def __init__(self, ids: np.ndarray, q: np.ndarray, basis: np.ndarray, k: int):
        self.ids, self.q, self.basis, self.k = ids, q, basis, k
        self.lead = max(1, int(q.shape[1] * LEAD))
        turned = q @ basis
        self.head, self.tail = turned[:, : self.lead], np.linalg.norm(turned[:, self.lead :], axis=1)
        self.length = np.linalg.norm(q.astype(np.float64), axis=1)
        self.floor = np.full(len(ids), -np.inf)  # a k-th score that is known to be reached
        self.clear()

    def clear(self) -> None:
        """Forget the vectors; the thresholds stay."""
        self.best = np.full((len(self.ids), self.k), NONE)
        self.who = np.full((len(self.ids), self.k), np.iinfo(np.int64).max)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query position, candidate id, score) of the k best so far."""
        row, rank = np.nonzero(self.who != np.iinfo(np.int64).max)
        return row, self.who[row, rank], self.best[row, rank]

    def run(self, ids: np.ndarray, v: np.ndarray) -> None:
        """Take these candidates into the k best."""
        n, k, best, who, floor = len(self.ids), self.k, self.best, self.who, self.floor
        length = np.linalg.norm(v.astype(np.float64), axis=1)
        order = np.lexsort((ids, -length))
        ids, v, length = ids[order], v[order], length[order]
        exact = float(np.abs(v).max(initial=0)) * float(np.abs(self.q).max(initial=0)) * v.shape[1] < 2**52
        for lo in range(0, len(ids), ROWS):
            part, own, size = v[lo : lo + ROWS], ids[lo : lo + ROWS], length[lo : lo + ROWS]
            if not (self.length * size[0] + 1e-6 * (1 + self.length * size[0]) >= floor).any():
                break  # No query is left for this block's longest vector, nor for any later one.
            turned = part @ self.basis
            head, tail = turned[:, : self.lead], np.linalg.norm(turned[:, self.lead :], axis=1)
            for a in range(0, n, COLUMNS):
                b = min(n, a + COLUMNS)
                slack = 1e-6 * (1 + self.length[a:b] * (size[0] if len(size) else 0))
                live = np.flatnonzero(self.length[a:b] * size[0] + slack >= floor[a:b]) + a
                if not len(live):
                    continue
                bound = self.head[live] @ head.T
                bound += self.tail[live][:, None] * tail
                at, col = np.nonzero(bound >= (floor[live] - slack[live - a])[:, None])
                row = live[at]
                if not len(row):
                    continue
                if exact and len(row) > 0.05 * bound.size:
                    full = (self.q[live].astype(np.float64) @ part.T.astype(np.float64))[at, col]
                    score = np.rint(full).astype(np.int64)
                else:
                    score = np.concatenate([
                        np.einsum("ij,ij->i", self.q[row[i : i + 65536]], part[col[i : i + 65536]]) for i in range(0, len(row), 65536)
                    ])
                other = own[col] != self.ids[row]
                reach = other & (score >= floor[row])
                row, cand, score = row[reach], own[col[reach]], score[reach]
                # The k best of old and new for each query: score descending, id ascending.
                touched = np.unique(row)
                row = np.concatenate([np.repeat(touched, k), row])
                cand = np.concatenate([who[touched].reshape(-1), cand])
                score = np.concatenate([best[touched].reshape(-1), score])
                s = np.lexsort((cand, -score, row))
                row, cand, score = row[s], cand[s], score[s]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                keep = rank < k
                where = np.searchsorted(touched, row[keep])
                best[touched[where], rank[keep]], who[touched[where], rank[keep]] = score[keep], cand[keep]
                last = best[touched, k - 1]
                known = last > NONE
                floor[touched[known]] = np.maximum(floor[touched[known]], last[known])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, most: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products over all vectors.

    Both sides are ``(vec_id, v array<long>)`` as made by ``quantised``.  A query never meets rows with
    its own id; ties go to the smaller vec_id; with fewer than k candidates all are returned.  Rows count,
    as in the SQL: a vector that stands n times is n candidates and takes n places, and the rows of one
    query_id share its k places.  Vectors of another width than the query's take no part.  An empty side
    gives an empty result; null keys and vectors are left out by ``quantised``.  One pass over the vectors
    answers ``most`` bytes of queries; more queries take more passes, one after another, each of which writes its
    candidates and drops its broadcast.  ValueError where a score might not fit a long.
    """
    spark = vectors.sparkSession
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    asked = cut(queries.select("vec_id", "v", F.size("v").alias("d")))
    counts = {r["d"]: r["n"] for r in asked.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = None
    for width, number in sorted(counts.items()):
        own = cut(vectors.where(F.size("v") == width).select("vec_id", "v", length.alias("l")).repartitionByRange(F.col("l").desc()))
        sample = np.array([r["v"] for r in sample_by_hash(own.select("vec_id", "v"), ("vec_id", "v"), SAMPLE).toLocalIterator()], np.float64)
        basis = rotation(sample.reshape(-1, width))
        longest = own.orderBy(F.col("l").desc(), "vec_id").limit(LONGEST).collect()
        if longest and longest[0]["l"] >= 2.0**62:  # no score passes the largest squared length
            raise ValueError("vectors are too long for scores in 64 bits")
        top_ids = np.array([r["vec_id"] for r in longest], np.int64)
        top = np.array([r["v"] for r in longest], np.int64).reshape(-1, width)
        passes = -(-number * width * 8 // most)
        at = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(max(1, passes)))
        for one in range(passes):
            rows = asked.where((F.col("d") == width) & (at == one)).orderBy("vec_id").toLocalIterator()
            searches = []
            while block := list(itertools.islice(rows, QUERY_BLOCK)):
                search = Search(np.array([r["vec_id"] for r in block], np.int64), np.array([r["v"] for r in block], np.int64), basis, k)
                search.run(top_ids, top)
                search.clear()  # The tasks meet these vectors again.
                searches.append(search)
            if searches:
                sent = spark.sparkContext.broadcast(pickle.dumps(searches))
                part = cut(own.select("vec_id", "v").mapInArrow(_task(sent, width), "query_id long, vec_id long, score long"))
                sent.destroy()
                out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _task(sent, width: int, held: int = 131_072):
    def run(batches):
        searches: list[Search] = pickle.loads(sent.value)
        ids, parts, n = [], [], 0

        def flush():
            every, v = np.concatenate(ids), np.concatenate(parts)
            for search in searches:
                search.run(every, v)

        for batch in batches:
            ids.append(batch.column("vec_id").to_numpy(zero_copy_only=False))
            parts.append(matrix(batch.column("v"), width))
            n += batch.num_rows
            if n >= held:
                flush()
                ids, parts, n = [], [], 0
        if n:
            flush()
        for search in searches:
            row, cand, score = search.found()
            yield pa.RecordBatch.from_arrays([pa.array(search.ids[row]), pa.array(cand), pa.array(score)], ["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The query: rows whose vec_id is divisible by ``every`` against all rows."""
    whole = quantised(vectors)
    return top_k(whole, whole.where(F.col("vec_id") % every == 0), k)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
