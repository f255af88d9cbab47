"""PCA whitening of embeddings with exact statistics.

Entries become whole numbers, so the scatter matrix is summed exactly whatever the order; its eigenvalues come from its exact
characteristic polynomial (``spectrum``). The projection is a matrix product in doubles, and the covariance of what it
gives is measured over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written
from .spectrum import principal_components

SCALE, SHIFT = 64, 1_000_000
#: Bits of a limb and rows of a product: sums of 2**12 products of two limbs stay below 2**53.
LIMB, ROWS = 20, 1 << 12
RESULT = ("vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, "
          "identity_error double")


def _whole(c: Column) -> Column:
    y = c.cast("double") * SCALE
    return F.when(F.abs(y) < 2.0 ** 60, F.floor(y)).otherwise(
        F.raise_error(F.lit("an entry is too large for whole numbers of 64 bits")).cast("long"))


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, y) of the usable rows, written once: y = floor(64 c); the constant that makes it x is the same everywhere.

    Usable are vectors without null and non-finite entries, of the length that most such vectors have (of lengths equally
    frequent, the greatest): to the fit, shorter and longer ones have entries missing."""
    e = F.col("embedding")
    sound = e.isNotNull() & F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = written(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(sound)
                   .select("vec_id", F.transform("embedding", _whole).alias("y")), "whole-vectors")
    usual = rows.groupBy(F.size("y").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("y") == usual[0].d) if usual else rows


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("y").flatten().to_numpy().reshape(-1, d)


def products(y: np.ndarray) -> np.ndarray:
    """y.T @ y of whole numbers below 2**60, as Python integers; the products themselves are made by BLAS, exactly."""
    d = y.shape[1]
    total = np.zeros((d, d), object)
    for a in range(0, len(y), ROWS):
        part = y[a: a + ROWS]
        # The highest limb has the sign.
        many = max(int(abs(x)) for x in (part.max(), part.min())).bit_length() // LIMB + 1
        limbs = [((part >> LIMB * i) & ((1 << LIMB) - 1) if i + 1 < many else part >> LIMB * i).astype(np.float64)
                 for i in range(many)]
        for i, p in enumerate(limbs):
            for j, q in enumerate(limbs):
                total += (p.T @ q).astype(np.int64).astype(object) << (LIMB * (i + j))
    return total


def scatter(rows: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums of y, n * sum of products - products of sums): n**2 times the covariance, all exact."""
    up, over = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, total = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            y = _matrix(batch, d)
            n += len(y)
            # Halves of 32 bits, so that sums of longs can't overflow.
            sums += ((y >> 32).sum(0).astype(object) << 32) + (y & 0xFFFFFFFF).sum(0).astype(object)
            total += products(y)
        if n:
            cells = [n, *sums, *total[up, over]]
            yield pa.RecordBatch.from_pydict({"cell": pa.array(range(len(cells)), pa.int32()),
                                              "v": pa.array([Decimal(int(c)) for c in cells], pa.decimal128(38, 0))})

    found = {r.cell: int(r.v) for r in rows.select("y").mapInArrow(run, "cell int, v decimal(38,0)").groupBy("cell")
             .agg(F.sum("v").alias("v")).collect()}
    n, sums = found[0], [found[1 + i] for i in range(d)]
    matrix = [[0] * d for _ in range(d)]
    for cell, (i, j) in enumerate(zip(up.tolist(), over.tolist())):
        matrix[i][j] = matrix[j][i] = n * found[1 + d + cell] - sums[i] * sums[j]
    return n, sums, matrix


class Projection:
    """What tasks need to whiten rows."""

    def __init__(self, n: int, sums: list[int], values: list, vectors: np.ndarray):
        self.n, self.sums = n, sums
        # An eigenvalue of the matrix is n**2 times that of the covariance.
        self.columns = vectors.T / np.array([float(v) ** 0.5 / n for v in values])[None, :]

    def offsets(self, y: np.ndarray) -> np.ndarray:
        """n * x - S, as longs if they fit."""
        most = max(self.n * max(abs(int(y.max())), abs(int(y.min()))), *map(abs, self.sums)) * 2 if len(y) else 0
        kind = np.int64 if most < 1 << 62 else object
        return y.astype(kind) * self.n - np.array(self.sums, kind)

    def whitened(self, offsets: np.ndarray) -> np.ndarray:
        return (offsets / self.n).astype(np.float64) @ self.columns


def squared_sums(rows: np.ndarray) -> np.ndarray:
    """The sum of squares of each row of whole numbers: longs if all fit, else Python integers, put together from limbs of 21 bits."""
    if rows.dtype == object:
        return (rows * rows).sum(1)
    most = max(abs(int(rows.max())), abs(int(rows.min()))) if rows.size else 0
    if rows.shape[1] * most * most < 1 << 63:
        return (rows * rows).sum(1)
    a, b, c = rows >> 42, (rows >> 21) & 0x1FFFFF, rows & 0x1FFFFF
    terms = [(a * a, 84), (2 * a * b, 63), (2 * a * c + b * b, 42), (2 * b * c, 21), (c * c, 0)]
    return sum(t.sum(1).astype(object) << shift for t, shift in terms)


def _identity_error(rows: DataFrame, held, d: int, n: int) -> float:
    """The largest absolute entry of the whitened rows' covariance, divisor n, minus the identity."""
    k = held.value.columns.shape[1]
    up, over = np.triu_indices(k)

    def summed(cells):
        def run(batches):
            total = 0.0
            for batch in batches:
                p = held.value
                total = total + cells(p.whitened(p.offsets(_matrix(batch, d))))
            if not isinstance(total, float):
                yield pa.RecordBatch.from_pydict({"cell": pa.array(range(len(total)), pa.int32()), "v": pa.array(total)})
        found = rows.select("y").mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
        return np.array([r.v for r in sorted(found, key=lambda r: r.cell)])

    mean = summed(lambda z: z.sum(0)) / n
    covariance = summed(lambda z: ((z - mean).T @ (z - mean))[up, over]) / n
    return float(np.abs(covariance - (up == over)).max())


def whitened_components(vectors: DataFrame, most: int = 32) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each usable row and component up to ``most``.

    ``vectors`` has vec_id and embedding, an array of floats or doubles. Rows whose vector is null or has null or non-finite
    entries are dropped, and so are vectors of another length than most; rows with null or repeated ids all stay and count in the
    fit. Every remaining entry c becomes x = floor(64 c) + 1000000; ``deviation`` is the row's exact sum of (n x - S)**2.
    Components belong to the largest eigenvalues, counted as often as they repeat; an eigenvalue that is exactly 0 (fewer
    rows than dimensions, constant or dependent entries) can't be scaled to 1 and has no component. An empty table, vectors
    without entries and vectors that are all equal therefore give no rows. Other columns are not read.

    The driver holds matrices of the number of dimensions squared, never rows.
    """
    spark = vectors.sparkSession
    nothing = spark.createDataFrame([], RESULT)
    rows = integer_vectors(vectors)
    first = rows.select(F.size("y").alias("d")).limit(1).collect()
    if not first or not first[0].d:
        return nothing
    d = first[0].d
    n, sums, matrix = scatter(rows, d)
    values, components = principal_components(spark, matrix, most)
    if not values:
        return nothing
    held = spark.sparkContext.broadcast(Projection(n, sums, values, components))
    error = _identity_error(rows, held, d, n)
    trace = sum(matrix[i][i] for i in range(d))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = held.value
            offsets = p.offsets(_matrix(batch, d))
            squares = squared_sums(offsets)
            deviation = (pa.array(squares).cast(pa.decimal128(38, 0)) if squares.dtype == np.int64
                         else pa.array([Decimal(int(s)) for s in squares], pa.decimal128(38, 0)))
            z = p.whitened(offsets)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), deviation, lists], names=["vec_id", "deviation", "z"])

    shares = F.array(*[F.lit(float(v / trace)) for v in values])
    wide = rows.mapInArrow(run, "vec_id long, deviation decimal(38,0), z array<double>")
    return wide.select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
