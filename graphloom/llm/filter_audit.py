"""Audit of how five quality filters interact, over all 120 orders of applying them.

A document's failures are five bits, so what an order of the filters does to it depends on one of 32
masks: a table of 32 by 120 first failing steps is made once, and the tasks look masks up in it and count
with ``np.bincount``.  Documents are reduced to counts by part, mask and label before that, so neither a large
part nor the number of tasks makes the looked-up rows many.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, split_join

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Least words, least share of distinct words and most share of capitals in percent.
WORDS, DISTINCT, CAPITALS = 200, 50, 2
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
#: Parts whose counts are turned into removals at once; bounds a task's memory.
PARTS = 64


def first_failures() -> np.ndarray:
    """(32, 120): step, from 0, at which an order removes a document with these failures; 5 if it stays."""
    table = np.full((1 << len(FILTERS), len(ORDERS)), len(FILTERS), np.int64)
    masks = np.arange(len(table))
    for o, order in enumerate(ORDERS):
        for step in reversed(range(len(order))):
            table[masks >> FILTERS.index(order[step]) & 1 == 1, o] = step
    return table


FIRST = first_failures()
#: (120, 5): filter at each step of an order.
AT = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask of every row of ``docs(doc_id, text, source)``; bit k stands for filter k.

    Null texts count as empty, a null source is the part "".  A row without a doc_id has no smaller one, nor
    is it smaller than others; of rows that share text and doc_id none fails E for the other's sake.
    Texts are compared by their SHA-256, and rows of a hot text are not gathered.
    """
    text, blanks = F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", blanks, F.lit(0)))
    n = F.size("words")
    bits = [
        n < WORDS, 100 * F.size(F.array_distinct("words")) < DISTINCT * n,
        100 * F.regexp_count("text", F.lit("[A-Z]")) > CAPITALS * F.length("text"), F.col("text").rlike("[#$%&*|]"),
    ]
    mask = sum((F.when(bit, 1 << k).otherwise(0) for k, bit in enumerate(bits)), F.lit(0))
    rows = cut(rows.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = split_join(rows, first, "digest", "n", rows.count(), "left")
    again = F.when(F.col("doc_id") > F.col("first"), 1 << 4).otherwise(0)
    return met.select("doc_id", "part", (F.col("mask") + again).alias("mask"))


def _removals(batches):
    """Rows (part, filter_order, step, measures) of counted rows (part, mask, good, toxic, n)."""
    held: dict[str, np.ndarray] = {}

    def flush():
        names = list(held)
        for lo in range(0, len(names), PARTS):
            yield _measured(names[lo : lo + PARTS], np.stack([held[p] for p in names[lo : lo + PARTS]]))
        held.clear()

    for batch in batches:
        part = batch.column("part").dictionary_encode()
        mask, good, toxic, n = (batch.column(c).to_numpy().astype(np.int64) for c in ("mask", "good", "toxic", "n"))
        cell = (part.indices.to_numpy().astype(np.int64) * 4 + good + 2 * toxic) * len(FIRST) + mask
        sums = np.zeros(len(part.dictionary) * 4 * len(FIRST), np.int64)
        np.add.at(sums, cell, n)
        for name, own in zip(part.dictionary.to_pylist(), sums.reshape(-1, 4, len(FIRST))):
            held[name] = held[name] + own if name in held else own
        if len(held) > 16 * PARTS:
            yield from flush()
    yield from flush()


def _measured(names: list[str], counts: np.ndarray) -> pa.RecordBatch:
    """The measures of some parts from their counts by label (2 * toxic + good) and mask."""
    p, label, mask = np.nonzero(counts)
    orders, steps = AT.shape
    n = np.repeat(counts[p, label, mask], orders)
    cell = ((p[:, None] * orders + np.arange(orders)) * (steps + 1) + FIRST[mask]) * 4 + label[:, None]
    # Weights of bincount are doubles: sums of up to 2**53 rows are exact.
    lost = np.bincount(cell.ravel(), n, len(names) * orders * (steps + 1) * 4).astype(np.int64)
    lost = lost.reshape(len(names), orders, steps + 1, 4)[:, :, :steps]
    removed, by_mask = lost.sum(axis=3), counts.sum(axis=1)
    failed = np.stack([by_mask[:, np.arange(len(FIRST)) >> f & 1 == 1].sum(axis=1) for f in range(steps)], 1)
    alone = by_mask[:, 1 << np.arange(steps)]
    shapley = np.zeros((len(names), steps), np.int64)
    np.add.at(shapley, (slice(None), AT), removed)
    columns = {
        "kept": by_mask.sum(axis=1)[:, None, None] - removed.cumsum(axis=2), "removed": removed, "redundant": failed[:, AT] - removed,
        "unique_fails": alone[:, AT], "good_lost": lost[..., 1] + lost[..., 3], "toxic_lost": lost[..., 2] + lost[..., 3], "shapley": shapley[:, AT],
    }
    keys = [
        pa.array(np.repeat(np.array(names, object), orders * steps), pa.string()),
        pa.array(np.tile(np.repeat(np.array(ORDERS, object), steps), len(names)), pa.string()),
        pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), orders * len(names))),
    ]
    return pa.RecordBatch.from_arrays([*keys, *[pa.array(columns[c].ravel()) for c in MEASURES]], ["part", "filter_order", "step", *MEASURES])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the measures: one row for each part, order of the filters and step.

    ``docs(doc_id, text, source)`` may have other columns; ``labels(doc_id, quality, toxic)`` may lack documents,
    repeat them (a label of 1 wins) or hold nulls (no label).  Repeated rows count as often as they stand.
    An empty table gives no rows.  Equal (doc_id, part, mask) are counted before labels are joined, so an id
    that very many rows share is a few rows there.
    """
    counted = failures(docs).groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    one = [F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))]
    known = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id").agg(*one)
    rows = counted.join(known, "doc_id", "left").na.fill(0, ["good", "toxic"])
    rows = rows.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).repartition("part")
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in MEASURES)
    partial = rows.mapInArrow(_removals, schema)
    return partial.groupBy("part", "filter_order", "step").agg(*[F.sum(c).alias(c) for c in MEASURES])


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(CAST(source AS VARCHAR), '') AS part, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
m AS (
  SELECT part,
         CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails,
         coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w LEFT JOIN l USING (doc_id)),
h AS (SELECT part, fails, good, toxic, count(*) AS n FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM f a, f b, f c, f d, f e
  WHERE b.f <> a.f AND c.f NOT IN (a.f, b.f) AND d.f NOT IN (a.f, b.f, c.f) AND e.f NOT IN (a.f, b.f, c.f, d.f)),
s AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM o),
x AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS filter, n, good, toxic, fails,
         contains(fails, substr(filter_order, step, 1)) AS here,
         list_has_any(string_split(fails, ''), string_split(substr(filter_order, 1, step - 1), '')) AND fails <> '' AND step > 1 AS earlier
  FROM h, s),
r AS (
  SELECT part, filter_order, step, filter,
         CAST(sum(CASE WHEN NOT here AND NOT earlier THEN n ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN here AND NOT earlier THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN here AND earlier THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN fails = filter THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN here AND NOT earlier THEN n * good ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN here AND NOT earlier THEN n * toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM x GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM r
"""
