"""Mixing sources to target weights by Efraimidis-Spirakis sampling.  DataFrame functions only.

Every source gets a token budget.  Complete epochs of the source come first; the rest is a weighted
sample without replacement: each document draws the exponential key -ln(u) / weight, u from a hash of
its id, documents stand in key order, and a running sum of their sizes is cut at the budget.

The running sum never gathers a source.  The unit interval is cut into cells so that a cell of the
largest source holds about ``CELL_ROWS`` documents; cell totals are summed first, then documents only
within their cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Weights of the sources in code point order, repeated.
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
#: Quality weights of documents labelled 1 and 0; others weigh 1.
GOOD, POOR = 2.0, 0.5
CELL_ROWS = 400
_BITS = 52


def size_of(text: Column) -> Column:
    """Number of blank-separated words; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """Number in (0, 1) from the id's MD5; the same on every run and engine."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(seed))
    whole = F.conv(F.substring(F.md5(text.cast("binary")), 1, _BITS // 4), 16, 10).cast("long")
    return (whole.cast("double") + 0.5) / float(1 << _BITS)


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from ``sizes(source, size)``: water-filling under the cap.

    The level is the one at which min(cap, level * weight) adds up to the total: sources are ordered by
    cap / weight, and the level solves the sum with the first ones at their caps.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("at") % len(WEIGHTS) + 1).cast("int"))
    per = per.withColumn("at", at).withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size"))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), "at")
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("total", SHARE * F.sum("source_size").over(every))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / F.sum("weight").over(later)
    per = per.withColumn("level", level)
    # The first source (in that order) whose cap is not reached fixes the level.
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "at", "level"))
    per = per.withColumn("level", F.min(fits).over(every)["level"])
    return per.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def mix(
    docs: DataFrame, labels: DataFrame | None = None, seed: str = "mix", boundary: str = "cut", keep: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, size, source_size, target, taken and ``keep`` of every row of ``docs(doc_id, text, source)``.

    taken counts words with repeats.  boundary says what the document on the budget's edge gives:
    "cut" the words that still fit, "nearest" all or none of them, whichever is nearer.  Null texts have
    size 0 and give nothing; a null source is a source of its own, the last one; repeated rows are
    separate documents with the same key, in the order of size and of hashes of ``keep``, so that a rerun on other
    partitions gives every row the same; labels may be missing, null or repeated (the best one counts).  An
    empty table gives an empty result; a text of any length is counted whole; columns of ``docs`` beside these may
    have any name, those in ``keep`` none of size, source_size, target, taken, _key, _cell, _in and _quality.
    """
    rows = docs.select(*dict.fromkeys(["doc_id", "source", *keep]), size_of(F.col("text")).alias("size"))
    if labels is not None:
        rated = labels.groupBy("doc_id").agg(F.max("quality").alias("_quality"))
        rows = rows.join(rated, "doc_id", "left")
    else:
        rows = rows.withColumn("_quality", F.lit(None).cast("int"))
    quality = F.when(F.col("_quality") == 1, GOOD).when(F.col("_quality") == 0, POOR).otherwise(1.0)
    # u ** (1 / weight) descending is the exponential key ascending, and lies in the unit interval.
    rows = rows.withColumn("_key", F.log(uniform(F.col("doc_id"), seed)) / -quality).drop("_quality")
    rows = cut(rows)
    goal = targets(rows.select("source", "size"))
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    goal = cut(goal.withColumnRenamed("source", "_source"))
    most = rows.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    cells = max(1, most // CELL_ROWS)
    rows = rows.withColumn("_cell", F.least(F.floor((1 - F.exp(-F.col("_key"))) * cells), F.lit(cells - 1)).cast("long"))
    totals = rows.groupBy(F.col("source").alias("_s"), F.col("_cell").alias("_c")).agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("_s").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_s", "_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # Rows that the hashes do not tell apart are equal in all that is kept.
    ties = [F.xxhash64(F.lit(seed_), *keep, *[F.isnull(c) for c in keep]) for seed_ in (3, 7)] if keep else []
    inner = Window.partitionBy("source", "_cell").orderBy("_key", "doc_id", "size", *ties).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    rows = rows.join(totals, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_cell") == F.col("_c")))
    rows = rows.join(goal, F.col("source").eqNullSafe(F.col("_source")))
    fits = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("_before") - F.col("_in")))
    if boundary == "nearest":
        fits = F.when(2 * fits >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    taken = (F.col("epochs") * F.col("size") + fits).cast("long")
    return rows.select(*dict.fromkeys(["doc_id", *keep]), "size", "source_size", "target", taken.alias("taken"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         (CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || 'mix'), 1, 13)) AS BIGINT) + 0.5::DOUBLE)
           / 4503599627370496.0::DOUBLE AS u
  FROM documents),
q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
k AS (
  SELECT d.*, ln(u) / -(CASE quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) AS key
  FROM d LEFT JOIN q USING (doc_id)),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos
  FROM k GROUP BY source),
w AS (
  SELECT *, CASE pos % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total
  FROM s),
l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
       / sum(weight) OVER (ORDER BY cap / weight, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
g AS (
  SELECT source, source_size,
         least(cap, coalesce((SELECT level FROM l WHERE level * weight <= cap ORDER BY cap / weight, pos LIMIT 1) * weight, cap)) AS target
  FROM l),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM g),
r AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs,
         CAST(floor(e.target - e.epochs * e.source_size) AS BIGINT) AS rest,
         CAST(coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM r
"""
