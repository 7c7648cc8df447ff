"""Whitening of embeddings from exact integer cross-products.

Entries become integers, less the least of their dimension, and each dimension's bits become planes: one bit for each
row, packed into 64-bit words. The popcount of the AND of two planes counts the rows that have both bits; weighted by the
planes' powers of two, these counts are the exact sum of products of two dimensions. Tasks add up products of tiles of
dimensions, Spark adds the tasks' integers, and the covariance is centred while it is still an integer; only then does
it become a matrix of doubles for the eigenvectors. That matrix, as large as the square of the dimensions and
independent of the number of rows, is all that the driver holds.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm._store import shared_folder, stored, tidy

SCALE, SHIFT = 1024, 100_000
LARGEST = 1e15  # entries of larger size are held there, so that integers and their differences fit 64 bits
HALF = 1 << 60  # sums travel as a part above and a part below
ROWS = 4096  # rows to a block of planes, in whole words
TILE = 64  # dimensions to a tile

Batches = Iterator[pa.RecordBatch]


def usable(vector: str) -> Column:
    """Whether a vector is neither null nor holds null, infinite or not-a-number entries."""
    finite = F.forall(F.col(vector), lambda c: F.coalesce((F.abs(c.cast("double")) < F.lit(float("inf"))) & ~F.isnan(c.cast("double")), F.lit(False)))
    return F.col(vector).isNotNull() & finite


def vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x: array of long) of the usable rows whose vectors have the most frequent length (of several, the longest)."""
    held = lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), c.cast("double")))
    x = F.transform("v", lambda c: F.floor(held(c) * SCALE) + F.lit(SHIFT).cast("long"))
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(usable("v"))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size("v") == F.lit(length.d if length else 0))
    return rows.select("id", x.alias("x"))


def planes(values: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes of an array (rows, dimensions) of integers below 2**bits: (dimensions, bits, words)."""
    rows, dims = values.shape
    padded = np.zeros((-(-rows // 64) * 64, dims), np.uint64)
    padded[:rows] = values
    out = np.empty((dims, bits, len(padded) // 64), np.uint64)
    for bit in range(bits):
        plane = ((padded >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8)
        out[:, bit] = np.packbits(np.ascontiguousarray(plane.T), axis=1).view(np.uint64)
    return out


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sums of products of all dimensions of ``left`` with all of ``right`` (object integers), by AND and popcount."""
    (m, bits, words), (n, other, _) = left.shape, right.shape
    flat = right.reshape(n * other, words)
    out = np.zeros((m, n), object)
    for i in range(m):
        for p in range(bits):
            plane = left[i, p]
            if plane.any():
                counts = np.bitwise_count(flat & plane).sum(axis=1, dtype=np.int64).reshape(n, other)
                out[i] += _weighted(counts, p)
    return out


def _weighted(counts: np.ndarray, shift: int) -> np.ndarray:
    bits = counts.shape[1]
    if shift + bits + 32 < 63:  # a block has fewer than 2**32 rows
        return (counts @ (np.int64(1) << np.arange(shift, shift + bits, dtype=np.int64))).astype(object)
    return counts.astype(object) @ np.array([1 << (shift + q) for q in range(bits)], object)


def _matrix(batch: pa.RecordBatch, name: str, dims: int) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), dims) if len(batch) else np.zeros((0, dims), np.int64)


def _blocks(batches: Batches, dims: int) -> Iterator[np.ndarray]:
    """Rows of all batches in blocks of ``ROWS``, the last one shorter."""
    waiting: list[np.ndarray] = []
    held = 0
    for batch in batches:
        waiting.append(_matrix(batch, "x", dims))
        held += len(batch)
        if held >= ROWS:
            rows = np.concatenate(waiting)
            for at in range(0, held - held % ROWS, ROWS):
                yield rows[at : at + ROWS]
            waiting, held = [rows[held - held % ROWS :]], held % ROWS
    if held:
        yield np.concatenate(waiting)


def _scatter(base: list[int], widths: list[int]):
    """mapInArrow from x to sums: (i, j, above, below) of products of shifted entries, j = -1 for a dimension's own sum, i = j = -1 for the rows."""
    dims = len(base)
    tiles = [slice(a, min(a + TILE, dims)) for a in range(0, dims, TILE)]

    def run(batches: Batches) -> Batches:
        cross, sums, n = np.zeros((dims, dims), object), np.zeros(dims, object), 0
        for block in _blocks(batches, dims):
            shifted = block - np.array(base, np.int64)
            n += len(block)
            for a, left in enumerate(tiles):
                first = planes(shifted[:, left].astype(np.uint64), max(widths[left]))
                ones = np.bitwise_count(first).sum(axis=2, dtype=np.int64)
                sums[left] += _weighted(ones, 0)
                for right in tiles[a:]:
                    second = first if right == left else planes(shifted[:, right].astype(np.uint64), max(widths[right]))
                    cross[left, right] += products(first, second)
        if n:
            entries = [(-1, -1, n), *((i, -1, sums[i]) for i in range(dims)), *((i, j, cross[i, j]) for i in range(dims) for j in range(i, dims))]
            i, j, value = zip(*entries, strict=True)
            yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([v // HALF for v in value], pa.int64()), pa.array([v % HALF for v in value], pa.int64())], names=["i", "j", "above", "below"])

    return tidy(run)


@dataclass
class Moments:
    """Exact sums over n rows of entries less ``base``: ``sums`` of each dimension, ``cross`` of each pair."""

    n: int
    base: list[int]
    sums: list[int]
    cross: np.ndarray

    @property
    def dims(self) -> int:
        return len(self.base)

    def covariance(self) -> np.ndarray:
        """Centred as integers (a shift does not matter to it), divided once."""
        scaled = self.cross * self.n - np.multiply.outer(np.array(self.sums, object), np.array(self.sums, object))
        return (scaled / (self.n * self.n)).astype(np.float64) if self.dims else np.zeros((0, 0))


def moments(x: DataFrame) -> Moments:
    """Of a table with vectors of integers ``x``, all of one length."""
    bounds = x.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.min("c").alias("low"), F.max("c").alias("high")).orderBy("i").collect()
    base = [r.low for r in bounds]
    widths = [max(1, int(r.high - r.low).bit_length()) for r in bounds]
    dims = len(base)
    found = x.select("x").mapInArrow(_scatter(base, widths), "i int, j int, above long, below long")
    halves = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("above", "below")]
    total = found.groupBy("i", "j").agg(*halves).collect() if dims else []
    cross, sums, n = np.zeros((dims, dims), object), [0] * dims, 0
    for r in total:
        value = int(r.above) * HALF + int(r.below)
        if r.i < 0:
            n = value
        elif r.j < 0:
            sums[r.i] = value
        else:
            cross[r.i, r.j] = cross[r.j, r.i] = value
    return Moments(n, base, sums, cross)


@dataclass
class Whitening:
    """Unit eigenvectors (columns) and eigenvalues of the covariance, falling; shares of its trace."""

    moments: Moments
    values: np.ndarray
    vectors: np.ndarray
    shares: np.ndarray


def fit(x: DataFrame, components: int = 8) -> Whitening:
    """Components without variance (an eigenvalue within rounding of 0) keep their place and have a value of 0."""
    m = moments(x)
    v = m.covariance()
    values, axes = np.linalg.eigh(v) if m.dims else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(-values, kind="stable")[:components]
    trace = float(np.trace(v)) if m.dims else 0.0
    values = np.where(values > max(m.dims, 1) * np.finfo(float).eps * max(trace, 0.0), values, 0.0)[order]
    return Whitening(m, values, axes[:, order], values / trace if trace > 0 else np.zeros(len(values)))


def _projected(model: Whitening, id_type: pa.DataType):
    m = model.moments
    base, sums = np.array(m.base, np.int64), np.array(m.sums, object)
    mean = np.array([s / m.n for s in m.sums]) if m.n else np.zeros(m.dims)
    scale = np.array([1 / np.sqrt(e) if e > 0 else np.nan for e in model.values])
    square = sum(s * s for s in m.sums)
    wide = any(s.bit_length() > 62 for s in m.sums)

    def exact(y: np.ndarray) -> list[int]:
        """n*n*|y|^2 - 2*n*y.S + |S|^2 of each row, in whole numbers."""
        largest = int(y.max(initial=0)).bit_length()
        if wide or 2 * largest + m.dims.bit_length() > 62 or largest + max((s.bit_length() for s in m.sums), default=0) + m.dims.bit_length() > 62:
            y = y.astype(object)
            own, both = (y * y).sum(axis=1), y @ sums
        else:
            own, both = (y * y).sum(axis=1), y @ sums.astype(np.int64)
        return [m.n * m.n * int(a) - 2 * m.n * int(b) + square for a, b in zip(own.tolist(), both.tolist(), strict=True)]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            y = _matrix(batch, "x", m.dims) - base
            white = ((y - mean) @ model.vectors) * scale
            flat = pa.array(white.reshape(-1), pa.float64(), from_pandas=True)  # without variance: null
            offsets = pa.array(np.arange(len(batch) + 1) * len(model.values), pa.int32())
            yield pa.record_batch([batch.column("id").cast(id_type), pa.array([str(v) for v in exact(y)], pa.string()), pa.ListArray.from_arrays(offsets, flat)], names=["id", "deviation", "white"])

    return tidy(run)


def whiten(table: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n, deviation, white: array, explained: array, identity_error) of each usable row; other columns are not read.

    Rows with a null vector or with null or non-finite entries are left out; so are vectors of another length than the most
    frequent one. Entries beyond 10**15 are held there. Repeated rows count as often as they stand; ids are only
    passed on, null ones too. There are as many components as the vectors have dimensions where that is fewer. A
    component without variance is null in ``white`` and 0 in ``explained``, and has no part in identity_error, which is
    null where no component has variance. ``deviation`` is a decimal, null beyond 38 digits. No usable rows give an empty result.
    """
    spark, folder = table.sparkSession, shared_folder(table.sparkSession, "whitening")
    kind = table.schema[id_col].dataType
    x = stored(vectors(table, id_col, vector_col), f"{folder}/x")
    model = fit(x, components)
    from pyspark.sql.pandas.types import to_arrow_type

    schema = f"id {kind.simpleString()}, deviation string, white array<double>"
    rows = stored(x.mapInArrow(_projected(model, to_arrow_type(kind)), schema), f"{folder}/white")
    live = [k for k, e in enumerate(model.values) if e > 0]
    pairs = list(itertools.combinations_with_replacement(live, 2))
    gaps = [F.abs(F.covar_pop(F.col("white")[a], F.col("white")[b]) - F.lit(float(a == b))) for a, b in pairs]
    error = rows.agg(F.greatest(*gaps) if len(gaps) > 1 else gaps[0]).first()[0] if gaps else None
    explained = F.array(*[F.lit(float(s)) for s in model.shares]).cast("array<double>")
    return rows.select(F.col("id").alias("vec_id"), F.lit(model.moments.n).cast("long").alias("n"), F.expr("try_cast(deviation AS decimal(38,0))").alias("deviation"), "white", explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each usable vector and component; a deviation beyond a long is null, and whole in deviation_exact."""
    rows = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    each = rows.select("vec_id", F.posexplode("white").alias("k", "whitened"), "n", "deviation", "explained", "identity_error")
    deviation = F.expr("try_cast(deviation AS bigint)").alias("deviation")
    return each.select("vec_id", (F.col("k") + 1).alias("component"), "n", deviation, "whitened", F.col("explained")[F.col("k")].alias("explained"), "identity_error", F.col("deviation").alias("deviation_exact"))
