"""Near duplicates by SuperMinHash, banding, verification and union-find grouping.

SuperMinHash gives every set element one random permutation of the signature's places and one value
below 1 for each rank; a place holds the least rank + value that any element brought to it.  Ranks are
worked off one after another for all elements at once: as soon as every place of a text is filled, no
later rank can lower one, and the text stops early.

Equal sets become one class before anything is compared.  Classes that share a band meet in that
band's bucket.  First every member meets its bucket's pivot, the class with most copies; pairs whose
signatures come near the similarity are confirmed on the full sets and joined into groups.  Buckets whose
members are then still in different groups are compared in blocks, only across groups and each pair in
the first band that it shares.  A block returns a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, bytes_of, combine, cut, lean, mix64, multiple, salted_join, slices, split_join, tidy, word_hashes
from .components import components, find, union

#: Bands and rows: a pair at similarity 0.8 shares no band once in 13,000 times.
BANDS, ROWS = 24, 5
#: Elements whose permutations are held at a time.
BLOCK = 32_768
#: Agreeing signature bytes (of BANDS * ROWS) from which a pair is confirmed: 4.5 deviations below similarity 0.8.
AGREE = 4.5
#: Members of a bucket that are compared at once.
MEMBERS = 1024


def least_agreeing(m: int, percent: int) -> int:
    """Signature bytes that a pair at the similarity shares almost surely."""
    j = percent / 100
    return max(0, int(m * j - AGREE * (m * j * (1 - j)) ** 0.5))


def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each row; one of all words if there are fewer than k."""
    words, first = word_hashes(raw, off)
    n = len(words)
    every = combine([words[i : n - k + 1 + i] for i in range(k)]) if n >= k else np.zeros(0, np.uint64)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo >= k:
            out.append(np.unique(every[lo : hi - k + 1]))
        elif hi > lo:
            out.append(combine([words[i : i + 1] for i in range(lo, hi)]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """(len(sets), m) signatures; a place is rank * 2**32 + value.  Empty sets keep the largest value."""
    out = np.full((len(sets), m), np.uint64(0xFFFFFFFFFFFFFFFF))
    parts: list[tuple[int, np.ndarray]] = []
    held = 0

    def flush():
        nonlocal held
        if not parts:
            return
        sig = _signatures(np.concatenate([p for _, p in parts]), np.array([len(p) for _, p in parts]), m)
        for (i, _), s in zip(parts, sig):
            np.minimum(out[i], s, out=out[i])
        parts.clear()
        held = 0

    for i, s in enumerate(sets):
        for at in range(0, len(s), BLOCK):
            piece = s[at : at + BLOCK]
            if held + len(piece) > BLOCK:
                flush()
            parts.append((i, piece))
            held += len(piece)
    flush()
    return out


def _signatures(elements: np.ndarray, sizes: np.ndarray, m: int) -> np.ndarray:
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    sets = len(sizes)
    flat = np.full(sets * m, none)
    base = np.repeat(np.arange(sets) * m, sizes)
    seed = mix64(elements + GOLDEN)
    perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(elements), 1))
    rows = np.arange(len(elements))
    for j in range(m):
        draw = mix64(seed + multiple(j + 1))
        k = j + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        place = perm[rows, k].astype(np.int64)
        perm[rows, k] = perm[rows, j]
        value = (np.uint64(j) << np.uint64(32)) | (draw >> np.uint64(32))
        key = base + place
        open_ = flat[key] >= np.uint64(j) << np.uint64(32)  # places of lower ranks stay
        np.minimum.at(flat, key[open_], value[open_])
        full = (flat.reshape(sets, m) != none).all(axis=1)
        if full.all():
            break
        keep = ~full[base // m]
        if not keep.all():
            rows, base, seed = rows[keep], base[keep], seed[keep]
    return flat.reshape(sets, m)


def sketch(docs: DataFrame, key: str = "doc_id", k: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """key, n_shingles, digest of the whole set (null if empty), one hash for each band, one byte for each place."""

    def run(batches):
        salt = np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN
        for batch in batches:
            for lo, hi in slices(batch, "text"):
                sets = shingle_sets(*bytes_of(batch.column("text").slice(lo, hi - lo)), k)
                sig = super_minhash(sets, bands * rows)
                low = mix64(sig).astype(np.uint8)
                sig = sig.reshape(len(sets), bands, rows)
                band = mix64(combine([sig[:, :, r].reshape(-1) for r in range(rows)]).reshape(-1, bands) ^ salt)
                digest = [_digest(s) for s in sets]
                flat = pa.array(band.view(np.int64).reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), flat)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), lists, pa.array([x.tobytes() for x in low], pa.binary())],
                    [key, "n_shingles", "digest", "bands", "sig"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(lean(run), f"`{key}` {kind}, n_shingles long, digest binary, bands array<long>, sig binary")


def _digest(elements: np.ndarray) -> bytes | None:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest() if len(elements) else None


def class_of_digest():
    """A class of equal sets is known by 64 bits of its digest (a column)."""
    return F.xxhash64("digest")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """cls (the class of the set) and the whole sorted set as bytes, for each text that has one."""

    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch, "text"):
                sets = [s for s in shingle_sets(*bytes_of(batch.column("text").slice(lo, hi - lo)), k) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["digest", "elements"]
                )

    return docs.select("text").mapInArrow(lean(run), "digest binary, elements binary").select(class_of_digest().alias("cls"), "elements")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _linked(percent: int):
    def run(batches):
        for batch in batches:
            pairs = zip(batch.column("xs"), batch.column("ys"))
            keep = pa.array([_similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in pairs], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    return run


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity; a set that many pairs need is copied to several tasks."""
    both = salted_join(pairs, sets.select(F.col("cls").alias("a"), F.col("elements").alias("xs")), "a", pairs)
    both = salted_join(both, sets.select(F.col("cls").alias("b"), F.col("elements").alias("ys")), "b", pairs)
    return both.select("a", "b", "xs", "ys").mapInArrow(lean(_linked(percent)), "a long, b long")


def _near(least: int):
    """Pairs (a, b) whose signature bytes agree often enough."""

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            keep = pa.array((x == y).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    return run


def _cross_pairs(key, table, percent: int, least: int):
    """Index pairs of one block pair of a bucket: of different groups, alike enough, in their first common band."""
    band, one, two = (k.as_py() for k in key)
    part, n, block = (table.column(c).to_numpy() for c in ("part", "n", "block"))
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(part), -1)
    bands = np.asarray(table.column("bands").combine_chunks().flatten()).reshape(len(part), -1)
    out = []
    for i in range(len(part) - 1):
        ok = (part[i + 1 :] != part[i]) & (np.minimum(n[i + 1 :], n[i]) * 100 >= np.maximum(n[i + 1 :], n[i]) * percent)
        if one != two:
            ok &= block[i + 1 :] != block[i]
        j = np.flatnonzero(ok) + i + 1
        j = j[(sig[j] == sig[i]).sum(axis=1) >= least]
        if len(j):
            same = bands[j] == bands[i]
            j = j[bands[i][same.argmax(axis=1)] == band]
            out += [(i, int(x)) for x in j]
    return out


def _hopeful(percent: int, least: int):
    def run(key, table):
        tidy()
        seen = sorted({x for pair in _cross_pairs(key, table, percent, least) for x in pair})
        return table.select(["band", "cls", "n", "part", "block", "one", "two"]).take(pa.array(seen, pa.int64()))

    return run


def _forest_of(percent: int, least: int):
    def run(key, table):
        tidy()
        reps = table.column("cls").to_pylist()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("elements")]
        parent: dict = {}
        for i, j in _cross_pairs(key, table, percent, least):
            a, b = reps[i], reps[j]
            if find(parent, a) != find(parent, b) and _similar(sets[i], sets[j], percent):
                union(parent, a, b)
        rows = [(x, find(parent, x)) for x in parent if find(parent, x) != x]
        return pa.table({c: pa.array([r[k] for r in rows], pa.int64()) for k, c in enumerate("ab")})

    return run


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """key, n_shingles, component_id (smallest key reachable by links) and kept, a row for each row of docs.

    Shingles are k words; a link needs 100 * intersection >= percent * union.  Null and blank texts have
    an empty set and stand alone.  Every row is linked by its own text: rows that repeat a key with another
    text may be in other components, and component_id is the smallest key among the component's rows.  A
    row with a null key stands alone with a null component.  Columns besides key and text are ignored.  A text of
    any length is one set, made in one pass; an empty table gives an empty result.
    """
    least = least_agreeing(bands * rows, percent)
    drawn = cut(sketch(docs, key, k, bands, rows).withColumnRenamed(key, "node"))
    whole = drawn.where("digest is not null and node is not null")
    # One class for equal sets; its smallest key stands for it.
    classes = cut(whole.groupBy("digest").agg(
        F.min("node").alias("rep"), F.min_by(F.struct("bands", "sig"), "node").alias("s"), F.first("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies")
    ).select("digest", class_of_digest().alias("cls"), "rep", "s.bands", "s.sig", "n", "copies"))
    n_rows = classes.count() * bands
    held = classes.select("cls", "n", "copies", F.explode("bands").alias("band"))
    # Buckets with more than one class, each with its pivot: the class of most copies.
    pivots = cut(held.groupBy("band").agg(
        F.count(F.lit(1)).alias("size"), F.max(F.struct("copies", "cls", "n")).alias("p")
    ).where("size > 1").select("band", "size", F.col("p.cls").alias("pivot"), F.col("p.n").alias("pn")))
    members = cut(split_join(held, pivots, "band", "size", n_rows).select("band", "cls", "n", "size", "pivot", "pn"))
    near = (F.least("n", "pn") * 100 >= F.greatest("n", "pn") * percent) & (F.col("cls") != F.col("pivot"))
    pairs = members.where(near).select(F.least("cls", "pivot").alias("a"), F.greatest("cls", "pivot").alias("b")).distinct()
    pairs = cut(pairs)
    marks = classes.select("cls", "sig")
    signed = salted_join(pairs, marks.select(F.col("cls").alias("a"), F.col("sig").alias("sa")), "a", pairs)
    signed = salted_join(signed, marks.select(F.col("cls").alias("b"), F.col("sig").alias("sb")), "b", pairs)
    tried = cut(signed.select("a", "b", "sa", "sb").mapInArrow(lean(_near(least)), "a long, b long"))
    # The full sets of all that share a band with another class, made in one pass over the texts.
    wanted = classes.join(members.select("cls").distinct(), "cls", "left_semi").select(F.col("rep").alias("node")).distinct()
    text = docs.select(F.col(key).cast("long").alias("node"), "text").join(wanted, "node", "left_semi")
    sets = cut(full_sets(text.dropDuplicates(["node", "text"]), k))
    links = cut(confirm(tried, sets, percent))
    group = components(links)
    placed = cut(members.join(group.withColumnRenamed("node", "cls"), "cls", "left").select(
        "band", "cls", "n", "size", F.coalesce("component_id", "cls").alias("part")
    ))
    apart = placed.groupBy("band").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.first("size").alias("members")).where("lo < hi").select("band", "members")
    parts = F.ceil(F.col("size") / MEMBERS).cast("int")
    rest = split_join(placed, apart, "band", "members", n_rows).withColumn("block", F.pmod(F.xxhash64("cls"), parts).cast("int"))
    # A block meets itself and, in a pair, every other block of its bucket.
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    rest = rest.select("band", "cls", "n", "part", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    marks = classes.select("cls", "bands", "sig")
    by = ("band", "one", "two")
    hopeful = cut(rest.join(marks, "cls").groupBy(*by).applyInArrow(
        _hopeful(percent, least), "band long, cls long, n long, part long, block int, one int, two int"
    ))
    found = cut(hopeful.join(marks, "cls").join(sets, "cls").groupBy(*by).applyInArrow(_forest_of(percent, least), "a long, b long"))
    if not found.isEmpty():
        group = components(links.union(found))
    known = cut(classes.join(group.withColumnRenamed("node", "cls"), "cls", "left").select("digest", "rep", "copies", F.coalesce("component_id", "cls").alias("group")))
    first = known.groupBy("group").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("size"))
    of_class = cut(split_join(known, first, "group", "size", n_rows // bands).select("digest", "component_id", "copies"))
    told = split_join(drawn.select("node", "n_shingles", "digest"), of_class, "digest", "copies", drawn.count(), "left")
    # Rows without a key may hold a known text; they stay alone.
    mine = F.when(F.col("node").isNotNull(), F.coalesce("component_id", "node"))
    return told.select(F.col("node").alias(key), "n_shingles", mine.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("component_id") == F.col(key), F.lit(True))
    )


#: The query with k = 4 and percent = 80: every pair that shares a shingle, and reachability by recursion.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE [array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)] END) AS g
  FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d JOIN m ON m.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
