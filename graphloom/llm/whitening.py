"""Whitening of embeddings by a tiled covariance.

Vectors become whole numbers and every different one is fitted once.  For the covariance, rows are dealt
to row-blocks and cut into column blocks; the column blocks of a row-block meet in a shuffle, every pair
of them is one tile key whose product is added up in the task, tiles are summed by key, and only
the assembled matrix (width x width) reaches the driver, where it is decomposed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Least width of a tile, and column blocks of a vector at most.
TILE, COLUMN_BLOCKS = 16, 16
#: Bytes of a row-block as doubles; bounds what a task holds besides its tiles.
BLOCK_BYTES = 16 << 20
#: Widest vector: its covariance is assembled on the driver.
LARGEST = 4096
#: Whole numbers from here on do not fit the type; such an entry counts as not finite.
RANGE = float(1 << 62)


def width_of(vectors: DataFrame, column: str) -> int:
    """The width that most vectors have, the larger one of two; 0 without vectors."""
    sizes = vectors.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("w")).count()
    top = sizes.orderBy(F.desc("count"), F.desc("w")).first()
    return top["w"] if top else 0


def whole_numbers(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices of the rows that take part, their floor(SCALE * c)); others are null, of another width or not finite."""
    fits = pc.equal(pc.fill_null(pc.list_value_length(column), -1), width)
    at = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    values = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), width)
    scaled = np.floor(SCALE * values)
    good = (np.abs(scaled) < RANGE).all(axis=1)  # false for NaN and infinities
    return at[good], scaled[good].astype(np.int64)


def packed(x: np.ndarray) -> pa.Array:
    """One binary for each row, in the narrowest integers that hold it: equal rows are equal binaries."""
    if not len(x):
        return pa.array([], pa.binary())
    low, high = x.min(axis=1), x.max(axis=1)
    size = np.full(len(x), 8)
    for bits in (32, 16, 8):
        size[(low >= -(1 << bits - 1)) & (high < 1 << bits - 1)] = bits // 8
    if (size == size[0]).all():
        data = x.astype(f"<i{size[0]}")
        offsets = np.arange(len(x) + 1, dtype=np.int32) * np.int32(size[0] * x.shape[1])
        return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])
    return pa.array([r.astype(f"<i{s}").tobytes() for r, s in zip(x, size)], pa.binary())


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False) // width
    out = np.zeros((len(column), width), np.int64)
    for s in np.unique(sizes):
        at = np.flatnonzero(sizes == s)
        out[at] = np.frombuffer(b"".join(column.take(pa.array(at)).to_pylist()), f"<i{s}").reshape(len(at), width)
    return out


def _sums(make: Callable):
    """(dim, n, s): a task's column sums, as text so that any size fits."""

    def run(batches):
        n, s = 0, None
        for batch in batches:
            x = make(batch)
            if len(x):
                exact = x.dtype.kind == "i" and np.abs(x).max() >= 1 << 40
                own = (x.astype(object) if exact else x).sum(axis=0).astype(object)
                n, s = n + len(x), own if s is None else s + own
        if n:
            text = [str(int(v)) if isinstance(v, int) else repr(float(v)) for v in s]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(s)), pa.int32()), pa.array([n] * len(s), pa.int64()), pa.array(text)], ["dim", "n", "s"])

    return run


def moments(rows: DataFrame, make: Callable, kind: str) -> tuple[int, list]:
    """Rows and column sums of the matrices that ``make`` gives for the batches."""
    sums = rows.mapInArrow(lean(_sums(make)), "dim int, n long, s string").groupBy("dim")
    found = sums.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast(kind)).alias("s")).orderBy("dim").collect()
    return (found[0]["n"], [r["s"] for r in found]) if found else (0, [])


def _blocks(make: Callable, width: int, tile: int):
    """(row_block, col_block, kind, data): the column blocks of row-blocks of a bounded size."""
    most = max(16, BLOCK_BYTES // (8 * width))

    def run(batches):
        count, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            for lo in range(0, batch.num_rows, most):
                x = make(batch.slice(lo, most))
                if not len(x):
                    continue
                if x.dtype.kind == "i":
                    x = x.astype(np.min_scalar_type(-max(1, int(np.abs(x).max()) + 1)))
                cols = [x[:, c : c + tile] for c in range(0, width, tile)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{task}-{count}"] * len(cols)), pa.array(range(len(cols)), pa.int32()), pa.array([x.dtype.str] * len(cols)), pa.array([np.ascontiguousarray(c).tobytes() for c in cols])],
                    ["row_block", "col_block", "kind", "data"],
                )
                count += 1

    return run


def _products(width: int, tile: int, mean: np.ndarray):
    """(a, b, data): sums over the task's row-blocks of the products of centred column blocks a <= b."""

    def run(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        here, block = None, {}

        def multiply():
            for a, left in block.items():
                for b, right in block.items():
                    if a <= b:
                        got = left.T @ right
                        sums[a, b] = sums[a, b] + got if (a, b) in sums else got

        for batch in batches:
            for name, c, kind, data in zip(*(batch.column(k).to_pylist() for k in ("row_block", "col_block", "kind", "data"))):
                if name != here:
                    multiply()
                    here, block = name, {}
                centre = mean[c * tile : (c + 1) * tile]
                block[c] = np.frombuffer(data, kind).reshape(-1, len(centre)).astype(float) - centre
        multiply()
        yield from _tiles(sums)

    return run


def _tiles(sums: dict[tuple[int, int], np.ndarray]):
    for (a, b), s in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([b], pa.int32()), pa.array([s.tobytes()])], ["a", "b", "data"])


def _summed(batches):
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for a, b, data in zip(*(batch.column(k).to_pylist() for k in ("a", "b", "data"))):
            got = np.frombuffer(data)
            sums[a, b] = sums[a, b] + got if (a, b) in sums else got
    yield from _tiles(sums)


def covariance(rows: DataFrame, make: Callable, width: int, mean: np.ndarray, n: int) -> np.ndarray:
    """Covariance with divisor n of the matrices that ``make`` gives for the batches, centred before multiplying."""
    tile = max(TILE, -(-width // COLUMN_BLOCKS))
    blocks = rows.mapInArrow(lean(_blocks(make, width, tile)), "row_block string, col_block int, kind string, data binary")
    met = blocks.repartition("row_block").sortWithinPartitions("row_block", "col_block")
    products = met.mapInArrow(lean(_products(width, tile, mean)), "a int, b int, data binary")
    out = np.zeros((width, width))
    for a, b, data in products.repartition("a", "b").mapInArrow(_summed, "a int, b int, data binary").toLocalIterator():
        part = out[a * tile : (a + 1) * tile, b * tile : (b + 1) * tile]
        part[:] = np.frombuffer(data).reshape(part.shape)
        out[b * tile : (b + 1) * tile, a * tile : (a + 1) * tile] = part.T
    return out / n


@dataclass
class Whitener:
    """n, sums and mean of the whole numbers, and the directions (width x components) already divided by sqrt(e)."""

    width: int
    n: int
    sums: list[int]
    mean: np.ndarray
    directions: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.directions

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """sum of (n x - S)^2, exact; null beyond the range of a long."""
        top = self.n * float(np.abs(x).max(initial=0)) + max((abs(s) for s in self.sums), default=0)
        if top * top * self.width < 1 << 62:
            d = self.n * x - np.array(self.sums, np.int64)
            return (d * d).sum(axis=1).tolist()
        d = self.n * x.astype(object) - np.array(self.sums, object)
        return [v if v < 1 << 63 else None for v in (d * d).sum(axis=1)]


def fit(rows: DataFrame, width: int, components: int = COMPONENTS) -> Whitener | None:
    """Fitted on the different rows of ``rows(vector)``; None without rows.

    Components whose eigenvalue is not above the rounding of the largest have no direction and are left out.
    """
    from functools import partial

    if width > LARGEST:
        raise ValueError(f"vectors of width {width} are wider than {LARGEST}")
    make = partial(_matrix, width=width)
    different = cut(rows.select("vector").distinct())
    n, sums = moments(different, make, "decimal(38,0)")
    if not n:
        return None
    sums = [int(s) for s in sums]
    mean = np.array([s // n + (s % n) / n for s in sums])
    v = covariance(different, make, width, mean, n)
    e, vectors = np.linalg.eigh(v)
    e, vectors = e[::-1][:components], vectors[:, ::-1][:, :components]
    solid = e > max(e[0], 0.0) * width * np.finfo(float).eps
    model = Whitener(width, n, sums, mean, vectors[:, solid] / np.sqrt(e[solid]), e[solid] / max(np.trace(v), np.finfo(float).tiny))
    if solid.any():
        white = partial(_white, model=model)
        _, total = moments(different, white, "double")
        got = covariance(different, white, int(solid.sum()), np.array(total) / n, n)
        model.identity_error = float(np.abs(got - np.eye(len(got))).max())
    return model


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return unpacked(batch.column("vector"), width)


def _white(batch: pa.RecordBatch, model: Whitener) -> np.ndarray:
    return model.whitened(unpacked(batch.column("vector"), model.width))


def quantised(vectors: DataFrame, width: int, column: str = "embedding") -> DataFrame:
    """vector: the packed whole numbers of every row that takes part."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([packed(whole_numbers(batch.column(0), width)[1])], ["vector"])

    return vectors.select(column).mapInArrow(lean(run), "vector binary")


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``key``, component, n, deviation, whitened, explained and identity_error of every row that takes part.

    Rows take no part whose vector is null, holds null or non-finite entries (or such as do not fit a long when
    scaled), or has another width than most vectors.  Repeated vectors are fitted once and returned for
    every row; null and repeated keys are only carried along, other columns ignored.  Without rows, and where all
    vectors are equal, nothing has a direction and the result is empty; of rank r there are r components.
    """
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    width = width_of(vectors, column)
    model = fit(quantised(vectors, width, column), width, components) if width else None
    if model is None or not model.directions.shape[1]:
        return vectors.sparkSession.createDataFrame([], schema)
    sent = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m: Whitener = sent.value
        k = m.directions.shape[1]
        for batch in batches:
            at, x = whole_numbers(batch.column(column), m.width)
            each = np.repeat(np.arange(len(at)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key).take(pa.array(at[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(each), m.n)),
                    pa.array(m.deviations(x), pa.int64()).take(pa.array(each)), pa.array(m.whitened(x).ravel()), pa.array(np.tile(m.explained, len(at))), pa.array(np.full(len(each), m.identity_error)),
                ],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.select(key, column).mapInArrow(lean(run), schema)
