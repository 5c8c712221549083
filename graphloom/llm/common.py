"""Kernels and job helpers that the training-data operators share.

Texts travel as Arrow strings; the kernels work on the UTF-8 bytes of a slice of rows, so the
memory of a task is bounded by ``SLICE_BYTES`` plus its longest single text.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x5851F42D4C957F2D)
_MASK = (1 << 64) - 1
#: ASCII blanks: space and \t \n \v \f \r.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where none is set and all runs on one machine (tests)."""
    set_dir = spark.conf.get("spark.checkpoint.dir", "") or ""
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_dir:
        if not current.isDefined():
            spark.sparkContext.setCheckpointDir(set_dir)
        return set_dir
    if not current.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and forget how they were made."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy() -> None:
    """Give memory that batches have left behind back to the system; Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """The kernel of a mapInArrow, tidied up after its last batch."""

    def wrapped(batches):
        yield from run(batches)
        tidy()

    return wrapped


#: Keys that may count as hot at once; this bounds what the joins below broadcast.
HOT_KEYS = 2000


def hot_from(rows: int, floor: int = 256) -> int:
    """Rows from which a key is hot: fewer than ``HOT_KEYS`` keys of a table of so many rows can reach it."""
    return max(floor, rows // HOT_KEYS + 1)


def split_join(left: DataFrame, right: DataFrame, key: str, size: str, rows: int, how: str = "inner") -> DataFrame:
    """left join right on ``key``; right has one small row for each key, with the key's number of left rows in ``size``.

    ``rows`` is the number of rows of left.  The few right rows of hot keys are broadcast (their number is
    bounded by ``hot_from``), so that no task gathers a hot key's rows; the others meet in a shuffle.
    """
    least = hot_from(rows)
    hot = right.where(F.col(size) >= least).withColumn("_hot", F.lit(True))
    met = left.join(F.broadcast(hot.select(F.col(key).alias("_key"), F.struct(*[c for c in hot.columns if c != key]).alias("_row"))), F.col(key) == F.col("_key"), "left")
    rest = met.where("_key is null").select(*left.columns).join(right.where(F.col(size) < least), key, how)
    names = [c for c in right.columns if c != key]
    return met.where("_key is not null").select(*left.columns, *[F.col(f"_row.{c}").alias(c) for c in names]).select(*rest.columns).union(rest)


def salted_join(left: DataFrame, right: DataFrame, key: str, keys: DataFrame, floor: int = 1024) -> DataFrame:
    """left join right on ``key``, where right has a wide row for each key and left may hold hot keys.

    ``keys`` is a written table with the columns that tell left's rows apart, ``key`` among them; it is read
    to count the keys.  A hot key's right row is copied once for each ``floor`` or more of its left rows,
    which are dealt over the copies by their hash.
    """
    least = hot_from(keys.count(), floor)
    hot = keys.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    hot = F.broadcast(cut(hot.select(F.col(key).alias("_key"), F.ceil(F.col("_n") / least).cast("int").alias("_parts"))))
    on = F.col(key) == F.col("_key")
    salt = F.coalesce(F.pmod(F.xxhash64(*keys.columns), F.col("_parts")).cast("int"), F.lit(0))
    dealt = left.join(hot, on, "left").withColumn("_salt", salt).drop("_key", "_parts")
    copies = right.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_key", "_parts")
    return dealt.join(copies, [key, "_salt"]).drop("_salt")


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def multiple(n: int) -> np.uint64:
    """n times the golden constant modulo 2**64."""
    return np.uint64(n * int(GOLDEN) & _MASK)


class _Powers:
    """Powers of an odd base modulo 2**64 and their inverses, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, SLICE_BYTES)
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            up, down = np.full(size, _BASE, np.uint64), np.full(size, inverse, np.uint64)
            up[0] = down[0] = 1
            up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
            if n > SLICE_BYTES:
                return up, down
            self.up, self.down = up, down
        return self.up, self.down


_powers = _Powers()


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with about ``most`` bytes of text each; a longer text stands alone."""
    sizes = text_sizes(batch.column(column))
    at, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > at and held + n > most:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield at, len(sizes)


def text_sizes(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the rows one after another and their n + 1 offsets; null counts as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every blank-separated word with A-Z lowered, and each row's first word (n + 1)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    solid = ~BLANK[raw]
    begin = np.zeros(n + 1, bool)
    begin[off] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | begin[1:n]
    at = np.flatnonzero(start)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    up, down = _powers.get(n)
    value = LOWER[raw].astype(np.uint64)
    value += np.uint64(1)
    value *= up[:n]
    value *= solid
    h = np.add.reduceat(value, at)
    h *= down[at]
    return mix64(h ^ GOLDEN), np.searchsorted(at, off).astype(np.int64)


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of several aligned ones; order matters."""
    h = np.full(len(parts[0]), multiple(len(parts)), np.uint64)
    for p in parts:
        h = mix64(h ^ p) * _BASE + GOLDEN
    return mix64(h)


def crc_of_id(column) -> object:
    """crc32 of an id written as decimal text (a column; runs in the JVM)."""
    return F.crc32(column.cast("string").cast("binary"))


def sample_by_hash(df: DataFrame, keys: str | tuple[str, ...], most: int, seed: int = 11) -> DataFrame:
    """About ``most`` different rows, the same on every run, chosen by a hash of ``keys``.

    The share is worked out from one count, so nothing is sorted: rows whose hash falls under most / count
    stay, equal ones once.  Smaller tables stay whole.
    """
    keys = (keys,) if isinstance(keys, str) else keys
    unit = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    n = df.count()
    return (df.where(unit < F.lit(most / n)) if n > most else df).distinct()
