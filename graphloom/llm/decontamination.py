"""Benchmark passages in documents by a prefix-filtered set join.  DataFrame functions only.

A benchmark item is the set of its windows of ten words, a window the set of its shingles.  Shingles are ordered by
how often they stand in the documents; since a window must be contained whole, its prefix is its rarest
shingle alone, and windows whose rarest shingle stands nowhere are out.  Every position of a document
looks its shingle up among the prefixes (a broadcast of checked size, no shuffle of the text), the place of the
shingle in the window bounds where the window can begin and end, and what is left is compared word by word.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Words of a window and of a shingle; shorter items make shorter ones.
WINDOW, SHINGLE = 10, 4
#: Windows that are broadcast at once; a larger benchmark takes several passes over the documents.
WINDOWS = 100_000
#: Window and item pairs that are broadcast; more are joined by shuffle.
PAIRS = 1_000_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words with A-Z lowered; null has none."""
    text = F.coalesce(text, F.lit(""))
    # lower() changes letters beyond A-Z too, hence only where there are none.
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def shingle_at(words: str, at: Column, size: int) -> Column:
    """64-bit hash of ``size`` words from position ``at`` on."""
    return F.xxhash64(F.lit(size), *[F.get(words, at + i) for i in range(size)])


def windows_of(benchmark: DataFrame, window: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(window, words, k): the different windows with the size of their shingles; (window, item_id): who has them."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("_all")).where(F.size("_all") > 0)
    begin = F.explode(F.sequence(F.lit(0), F.greatest(F.size("_all") - window, F.lit(0))))
    held = cut(items.select("item_id", "_all", begin.alias("_at")).select("item_id", F.slice("_all", F.col("_at") + 1, F.lit(window)).alias("words")).distinct())
    windows = held.select("words").distinct().withColumn("window", F.monotonically_increasing_id())
    windows = cut(windows.withColumn("k", F.least(F.size("words"), F.lit(shingle))))
    pairs = held.where("item_id is not null").join(windows, "words").select("window", "item_id").distinct()
    return windows, cut(pairs)


def _positions(docs: DataFrame, sizes: list[int], *keep: str) -> DataFrame:
    """``keep``, words, pos and the shingle's hash of every position; a document without words has one row."""
    at = docs.select(*keep, "words", F.posexplode_outer("words").alias("pos", "_word"))
    if len(sizes) == 1:
        return at.select(*keep, "words", "pos", shingle_at("words", F.col("pos"), sizes[0]).alias("shingle"), F.lit(0).alias("turn"))
    every = F.array(*[shingle_at("words", F.col("pos"), k) for k in sizes])
    return at.select(*keep, "words", "pos", F.posexplode(every).alias("turn", "shingle"))


def prefixes(docs: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """shingle, entries(at, words, window): every window under its rarest shingle in ``docs(words)``.

    Ties go to the smaller hash, then the earlier place.  A window with a shingle that stands nowhere is left out.
    """
    place = F.explode(F.sequence(F.lit(0), F.size("words") - F.col("k")))
    own = windows.select("window", "words", "k", place.alias("at"))
    hashed = F.coalesce(*[F.when(F.col("k") == k, shingle_at("words", F.col("at"), k)) for k in sizes])
    own = cut(own.select("window", "words", "at", hashed.alias("shingle")))
    seen = _positions(docs, sizes).select("shingle").join(F.broadcast(own.select("shingle").distinct()), "shingle")
    seen = seen.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    ranked = own.join(seen, "shingle", "left").groupBy("window").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "at", "words")).alias("m")
    )
    found = ranked.where("m.n > 0").select("m.shingle", F.struct("m.at", "m.words", "window").alias("entry"))
    return cut(found.groupBy("shingle").agg(F.collect_list("entry").alias("entries")))


def _occurrences(docs: DataFrame, prefix: DataFrame, sizes: list[int]) -> DataFrame:
    """One row for each document (``is_doc``), and one for each occurrence of a window (start, size, window)."""
    at = _positions(docs, sizes, "doc_id", "h1", "h2", "n_words").join(F.broadcast(prefix), "shingle", "left")
    at = at.where("entries is not null or (coalesce(pos, 0) = 0 and turn = 0)")
    at = at.select("doc_id", "h1", "h2", "n_words", "words", "pos", "turn", F.posexplode_outer("entries").alias("e", "entry"))
    begin, size = F.col("pos") - F.col("entry.at"), F.size("entry.words")
    fits = (begin >= 0) & (begin + size <= F.col("n_words"))
    same = F.when(fits, F.slice("words", F.greatest(begin + 1, F.lit(1)), size) == F.col("entry.words")).otherwise(False)
    first = (F.coalesce("pos", F.lit(0)) == 0) & (F.coalesce("e", F.lit(0)) == 0) & (F.col("turn") == 0)
    hit = F.coalesce(same, F.lit(False))
    rows = at.select("doc_id", "h1", "h2", "n_words", first.alias("is_doc"), hit.alias("hit"), begin.alias("start"), size.alias("size"), "entry.window")
    return rows.where("is_doc or hit")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, most: int = WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids of every row of ``docs(doc_id, text)``.

    Null texts and texts without words have no hits, as all documents have with an empty benchmark.  Items
    without words have no windows; an item without an item_id hits words but is not listed; rows of one
    item_id are one item.  Repeated and null doc_ids are documents of their own, and further columns are ignored.
    Windows are compared in passes of ``most``, all of them on all documents.  Very long texts are
    split into words once, in one row.
    """
    windows, pairs = windows_of(benchmark, window, shingle)
    sizes = sorted(r["k"] for r in windows.select("k").distinct().collect()) or [shingle]
    passes = max(1, -(-windows.count() // most))
    text = F.coalesce("text", F.lit(""))
    # Rows of equal id and text have equal results: two 64-bit hashes stand for both.
    rows = docs.select("doc_id", F.xxhash64("doc_id", text).alias("h1"), F.xxhash64(F.lit(7), text, "doc_id").alias("h2"), words_of(F.col("text")).alias("words"))
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    parts = []
    for k in range(passes):
        own = windows.where(F.pmod(F.xxhash64("window"), F.lit(passes)) == k) if passes > 1 else windows
        found = _occurrences(rows, prefixes(rows, own, sizes), sizes)
        parts.append(cut(found if k == 0 else found.where("hit")))
    each = parts[0].where("is_doc").select("doc_id", "h1", "h2", "n_words")
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.union(part)
    hits = hits.where("hit").select("h1", "h2", "start", "size", "window").distinct()
    # Words covered: what each window adds to the ones before it, by where they begin.
    order = Window.partitionBy("h1", "h2").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("size")
    new = F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(F.max(end).over(order), F.lit(0))))
    cover = hits.withColumn("new", new).groupBy("h1", "h2").agg(F.sum("new").cast("long").alias("n_hit"))
    whose = F.broadcast(pairs) if pairs.count() <= PAIRS else pairs
    listed = hits.select("h1", "h2", "window").distinct().join(whose, "window")
    listed = listed.groupBy("h1", "h2").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    result = cut(cover.join(listed, ["h1", "h2"], "left"))
    none = F.array().cast("array<string>")
    out = each.join(result, ["h1", "h2"], "left").withColumn("item_ids", F.coalesce("item_ids", none)).withColumn("n_hit", F.coalesce("n_hit", F.lit(0)))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "item_ids",
    )


ORACLE_SQL = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
a AS (SELECT item_id, words, least(10, len(words)) AS k, unnest(range(0, greatest(len(words) - 10, 0) + 1)) AS s FROM b WHERE len(words) > 0),
w AS (SELECT DISTINCT item_id, k, words[s + 1 : s + k] AS win FROM a),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
p AS (
  SELECT r, k, words, unnest(range(0, len(words) - k + 1)) AS s FROM d, (SELECT DISTINCT k FROM w) WHERE len(words) >= k),
h AS (
  SELECT DISTINCT p.r, p.s, p.k, w.item_id FROM (SELECT r, k, s, words[s + 1 : s + k] AS win FROM p) p JOIN w ON p.k = w.k AND p.win = w.win),
c AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS pos FROM h) GROUP BY r),
i AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN i USING (r)
"""
