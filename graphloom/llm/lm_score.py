"""Stupid-backoff scores of documents under the corpus' own n-gram counts.

The relational plan is: explode n-grams, count them in tables partitioned by hash, join the counts back
to the exploded n-grams and sum per document.  Documents are dealt into chunks of about ``CHUNK_BYTES``;
each chunk sends every distinct n-gram once to the n-gram's hash bucket, with its count in the chunk, so
the most frequent n-gram costs a bucket one entry for each chunk.  Buckets add the counts up and send
the totals back to the chunks, which join them to their n-grams.  Entries travel as sorted, packed
64-bit hashes (a wrong join needs a hash collision).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, combine, slices, word_hashes

ORDER, BACKOFF, LEAST_COUNT = 3, 0.4, 2
#: Bytes of text in a chunk, and chunks (or buckets) that a task works on, one after another.
CHUNK_BYTES, CHUNKS = 8 << 20, 2
#: Entry that carries the number of words.
WORDS = np.uint64(0)


def _packed(a: np.ndarray) -> bytes:
    """Byte planes of the numbers, compressed: sorted ones share their high bytes."""
    wide = np.ascontiguousarray(a.astype(f">u{a.itemsize}")).view(np.uint8).reshape(-1, a.itemsize)
    return zs.ZstdCompressor(level=1).compress(np.ascontiguousarray(wide.T).tobytes())


def _unpacked(data: bytes, n: int | None = None) -> np.ndarray:
    """The numbers as 64-bit ones; with their number known, their width follows from it."""
    raw = np.frombuffer(zs.ZstdDecompressor().decompress(data), np.uint8)
    size = 8 if n is None else len(raw) // max(1, n)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(f">u{size}").reshape(-1).astype(np.uint64)


def _narrow(n: np.ndarray, wide: int = 1 << 32) -> np.ndarray:
    """Counts in 32 bits, or in 64 where one of them needs it."""
    return n.astype(np.uint32 if not len(n) or n.max() < wide else np.uint64)


def _parcels(batches):
    """One compressed parcel of rows for each chunk that a batch has rows for.

    Equal rows of a batch travel once, with their number: a table that is a third one row stays spread.
    """
    for batch in batches:
        _, index, copies = np.unique(batch.column("row").to_numpy(), return_index=True, return_counts=True)
        batch = pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(pa.array(index)) for c in ("doc_id", "text", "chunk")), pa.array(copies, pa.int64())], ["doc_id", "text", "chunk", "copies"]
        )
        chunk = batch.column("chunk").to_numpy()
        order = np.argsort(chunk, kind="stable")
        rows = pa.Table.from_batches([batch]).select(["doc_id", "text", "copies"]).take(pa.array(order))
        starts = np.flatnonzero(np.r_[True, chunk[order][1:] != chunk[order][:-1]]) if len(chunk) else np.zeros(0, int)
        blobs = []
        for a, b in zip(starts, np.r_[starts[1:], len(chunk)]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(rows.slice(a, b - a).combine_chunks())
            blobs.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(chunk[order][starts], pa.int64()), pa.array(blobs, pa.binary())], ["chunk", "rows"])


def _opened(table: pa.Table) -> pa.Table:
    """The rows of all parcels of a chunk, in an order that does not depend on their arrival."""
    parcels = sorted(x.as_py() for x in table.column("rows"))
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in parcels])


def grams(table: pa.Table, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the n-grams that end at each word, for n = 1..order (0 where the text is too short), and first words."""
    parts, firsts, n = [], [np.zeros(1, np.int64)], 0
    for batch in table.to_batches():
        for lo, hi in slices(batch, "text"):
            h, first = word_hashes(*bytes_of(batch.column("text").slice(lo, hi - lo)))
            parts.append(h)
            firsts.append(first[1:] + n)
            n += len(h)
    words, first = np.concatenate([np.zeros(0, np.uint64), *parts]), np.concatenate(firsts)
    place = np.arange(n) - np.repeat(first[:-1], np.diff(first))
    out = []
    for k in range(order):
        h = np.zeros(n, np.uint64)
        if n > k:
            h[k:] = combine([words[i : n - k + i] for i in range(k + 1)]) | np.uint64(1)
            h[place < k] = 0
        out.append(h)
    return out, first


def _entries(hashes: list[np.ndarray], first: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and their counts, led by the number of words; a row counts as often as it stands."""
    every = np.concatenate(hashes)
    if (copies == 1).all():
        u, n = np.unique(every[every != 0], return_counts=True)
        return np.r_[WORDS, u], np.r_[len(hashes[0]), n].astype(np.uint64)
    weight = np.tile(np.repeat(copies, np.diff(first)), len(hashes))
    u, at = np.unique(every[every != 0], return_inverse=True)
    n = np.bincount(at, weights=weight[every != 0], minlength=len(u))
    return np.r_[WORDS, u], np.r_[weight[: len(hashes[0])].sum(), n].astype(np.uint64)


def _places(u: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Positions of h in the sorted u, looked up in the order of their high bits, which keeps the lookups near each other."""
    order = np.argsort((h >> np.uint64(48)).astype(np.uint16), kind="stable")
    out = np.empty(len(h), np.int64)
    out[order] = np.searchsorted(u, h[order])
    return out


def _cuts(u: np.ndarray, buckets: int) -> np.ndarray:
    """Entry positions at which each bucket begins; a bucket is a range of hashes."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    return np.r_[0, np.searchsorted(u, edges), len(u)]


def score(
    docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, least: int = LEAST_COUNT, chunk_bytes: int = CHUNK_BYTES, wide: int = 1 << 32
) -> DataFrame:
    """doc_id, n_words, n_backed_off and log_score of every row of ``docs(doc_id, text)``.

    An n-gram counts if the corpus holds it ``least`` times; else the score is ``backoff`` times that of
    the shorter n-gram, down to the word's share of all words.  log_score is the natural logarithm of
    the product over the words; null and blank texts have no words and 0.  Words are blank-separated
    with A-Z lowered.  Repeated rows count, and are scored, as often as they stand, also with a null or
    repeated doc_id, and counts from ``wide`` on travel in 64 bits.  A text is never cut: a very long one makes its chunk longer.  An empty table gives an
    empty result; other columns are ignored.

    A chunk sends at most one message to each bucket and never more than it has n-grams, so messages grow
    with the number of chunks times buckets only until a message is a single n-gram; from there on they are
    plain rows, in proportion to the input.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-total // chunk_bytes))
    kind = docs.schema["doc_id"].dataType.simpleString()
    # So many partitions that a task's share does not grow with the input.
    parts = max(1, chunks // CHUNKS)
    row = F.xxhash64("doc_id", "text", F.isnull("doc_id"), F.isnull("text"))
    dealt = docs.select("doc_id", "text", row.alias("row"), F.pmod(F.xxhash64(row, F.lit(7)), F.lit(chunks)).cast("long").alias("chunk"))
    dealt = dealt.mapInArrow(_parcels, "chunk long, rows binary").repartition(parts, "chunk")

    def send(key, table):
        table = _opened(table)
        u, n = _entries(*grams(table, order), table.column("copies").to_numpy())
        at = _cuts(u, chunks)
        rows = [(b, _packed(u[at[b] : at[b + 1]]), _packed(_narrow(n[at[b] : at[b + 1]], wide))) for b in range(chunks) if at[b] < at[b + 1]]
        return pa.table({
            "bucket": pa.array([r[0] for r in rows], pa.int64()), "chunk": pa.array([key[0].as_py()] * len(rows), pa.int64()),
            "grams": pa.array([r[1] for r in rows], pa.binary()), "n": pa.array([r[2] for r in rows], pa.binary()),
        })

    def add(key, table):
        parts = [_unpacked(x.as_py()) for x in table.column("grams")]
        every = np.concatenate(parts)
        n = np.concatenate([_unpacked(x.as_py(), len(p)) for x, p in zip(table.column("n"), parts)])
        order_ = np.argsort(every, kind="stable")
        ranked = every[order_]
        new = np.r_[True, ranked[1:] != ranked[:-1]]
        sums = np.add.reduceat(n[order_], np.flatnonzero(new))
        back = np.empty(len(every), np.uint64)
        back[order_] = sums[np.cumsum(new) - 1]
        ends = np.cumsum([len(p) for p in parts])[:-1]
        return pa.table({
            "chunk": table.column("chunk"), "bucket": table.column("bucket"),
            "totals": pa.array([_packed(x) for x in np.split(back, ends)], pa.binary()),
        })

    def join(key, table, totals):
        table = _opened(table)
        hashes, first = grams(table, order)
        u = np.sort(np.concatenate([h[h != 0] for h in hashes]))
        u = np.r_[WORDS, u[np.r_[True, u[1:] != u[:-1]][: len(u)]]]
        at = np.argsort(totals.column("bucket").to_numpy())
        blobs = totals.column("totals").to_pylist()
        count = np.concatenate([_unpacked(blobs[i]) for i in at]).astype(np.float64)
        words = count[0]
        seen = [np.where(h != 0, count[_places(u, h)], 0.0) for h in hashes]
        n = len(hashes[0])
        logs, open_, steps = np.zeros(n), np.ones(n, bool), np.zeros(n, np.int64)
        for k in range(order - 1, 0, -1):
            there = hashes[k] != 0
            hit = open_ & there & (seen[k] >= least)
            before = np.r_[1.0, seen[k - 1][:-1]]
            logs[hit] += np.log(seen[k][hit] / before[hit])
            miss = open_ & there & ~hit
            steps[miss] += 1
            open_ &= ~hit
        logs[open_] += np.log(seen[0][open_] / words)
        logs += steps * np.log(backoff)
        out, backed = np.zeros(table.num_rows), np.zeros(table.num_rows, np.int64)
        full = np.flatnonzero(np.diff(first))
        if len(full):
            out[full] = np.add.reduceat(logs, first[:-1][full])
            backed[full] = np.add.reduceat((steps > 0).astype(np.int64), first[:-1][full])
        return pa.table({
            "doc_id": table.column("doc_id"), "n_words": pa.array(np.diff(first), pa.int64()),
            "n_backed_off": pa.array(backed), "log_score": pa.array(out), "copies": table.column("copies"),
        })

    sent = dealt.groupBy("chunk").applyInArrow(send, "bucket long, chunk long, grams binary, n binary").repartition(parts, "bucket")
    totals = sent.groupBy("bucket").applyInArrow(add, "chunk long, bucket long, totals binary").repartition(parts, "chunk")
    out = dealt.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(
        join, f"doc_id {kind}, n_words long, n_backed_off long, log_score double, copies long"
    )
    # Copies are written out by the JVM row by row, a thousand at a time.
    out = out.withColumn("_part", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / 1000))))
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(1000), F.col("copies") - 1000 * F.col("_part")))))
    return out.select("doc_id", "n_words", "n_backed_off", F.round("log_score", 6).alias("log_score"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
t AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
x AS (
  SELECT doc_id, w, lag(w, 1) OVER o AS w1, lag(w, 2) OVER o AS w2
  FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM x),
c1 AS (SELECT w, count(*) AS c FROM x GROUP BY w),
c2 AS (SELECT w1, w, count(*) AS c FROM x WHERE w1 IS NOT NULL GROUP BY w1, w),
c3 AS (SELECT w2, w1, w, count(*) AS c FROM x WHERE w2 IS NOT NULL GROUP BY w2, w1, w),
s AS (
  SELECT x.doc_id,
         CASE WHEN x.w2 IS NOT NULL AND t3.c >= 2 THEN 0
              WHEN x.w1 IS NOT NULL AND b.c >= 2 THEN CASE WHEN x.w2 IS NULL THEN 0 ELSE 1 END
              ELSE (CASE WHEN x.w2 IS NULL THEN 0 ELSE 1 END) + (CASE WHEN x.w1 IS NULL THEN 0 ELSE 1 END) END AS steps,
         CASE WHEN x.w2 IS NOT NULL AND t3.c >= 2 THEN ln(CAST(t3.c AS DOUBLE) / h.c)
              WHEN x.w1 IS NOT NULL AND b.c >= 2 THEN ln(CAST(b.c AS DOUBLE) / p.c)
              ELSE ln(u.c / n.n) END AS l
  FROM x CROSS JOIN n JOIN c1 u ON u.w = x.w
  LEFT JOIN c2 b ON b.w1 = x.w1 AND b.w = x.w
  LEFT JOIN c1 p ON p.w = x.w1
  LEFT JOIN c3 t3 ON t3.w2 = x.w2 AND t3.w1 = x.w1 AND t3.w = x.w
  LEFT JOIN c2 h ON h.w1 = x.w2 AND h.w = x.w1),
g AS (
  SELECT doc_id, CAST(count(*) FILTER (steps > 0) AS BIGINT) AS n_backed_off, sum(l + steps * ln(0.4::DOUBLE)) AS log_score
  FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(g.n_backed_off, 0) AS n_backed_off,
       round(coalesce(g.log_score, 0.0::DOUBLE), 6) AS log_score
FROM d LEFT JOIN g USING (doc_id)
"""
