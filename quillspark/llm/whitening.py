"""Whitening of embeddings: principal components with accurate standard deviations, by a QR decomposition in blocks and a one-sided Jacobi SVD.

Vectors become whole numbers, and each different one counts once, so copies don't weigh. Blocks of centred rows are compressed to a triangle each (TSQR), and triangles of triangles
to one of as many rows as there are dimensions: no covariance is formed on the way, which would square what rounding costs. Plane rotations make the columns of the last triangle orthogonal to one another; their
norms are the standard deviations, and the rotations together the components. Rows are then projected one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_arrow, ship, table

SCALE, MOST = 256, 4
_LONG = (1 << 63) - 1
_ROWS, _SPREAD = 1024, 64


def usable(vector: Column | str) -> Column:
    """Whether a vector is there and has entries, all of them there and finite."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))


def whole(vector: Column | str) -> Column:
    """floor(256 * c) of each entry c; beyond a long, the nearest long."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.transform(v, lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(9.2e18)), F.lit(-9.2e18))))


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of a QR decomposition, filled up with zeros to as many rows as columns."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))]) if len(r) < rows.shape[1] else r


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors as columns, by rotations of pairs of columns until all are orthogonal to double precision."""
    u = np.asfortranarray(r, dtype=np.float64)
    d = u.shape[1]
    v = np.asfortranarray(np.eye(d))
    floor = (np.finfo(float).eps * np.linalg.norm(u)) ** 2  # columns that are rounding errors only needn't turn
    for _ in range(sweeps):
        turned = False
        for i in range(d - 1):
            for j in range(i + 1, d):
                a, b, c = u[:, i] @ u[:, i], u[:, j] @ u[:, j], u[:, i] @ u[:, j]
                if min(a, b) <= floor or abs(c) <= 1e-15 * math.sqrt(a * b):
                    continue
                turned = True
                z = (b - a) / (2 * c)
                t = math.copysign(1.0, z) / (abs(z) + math.hypot(1.0, z))
                cos = 1 / math.hypot(1.0, t)
                sin = cos * t
                for m in (u, v):
                    x, y = m[:, i].copy(), m[:, j].copy()
                    m[:, i], m[:, j] = cos * x - sin * y, sin * x + cos * y
        if not turned:
            break
    values = np.linalg.norm(u, axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order], v[:, order]


@dataclass(frozen=True)
class Whitening:
    """n different vectors with sums by dimension; components as columns, with their variances, of which all make `trace`."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def rank(self, most: int) -> int:
        """How many of the first components vary at all."""
        return int(np.count_nonzero(self.variances[:most] > (16 * len(self.sums) * np.finfo(float).eps) ** 2 * max(self.variances[0], 1e-300))) if len(self.variances) else 0

    def whiten(self, x: np.ndarray, most: int) -> np.ndarray:
        """Rows in the first components, each of variance 1."""
        k = self.rank(most)
        return (x - self.mean) @ self.components[:, :k] / np.sqrt(self.variances[:k])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """sum((n * x - sums)^2) by row, exactly; None where it's more than a long holds."""
        sums = np.array(self.sums, dtype=object)
        rough = (((x * float(self.n)) - sums.astype(float)) ** 2).sum(axis=1)
        small = (rough < 9.2e18) & (np.abs(x).max(axis=1, initial=0) * float(self.n) < 9.2e18)
        out: list[int | None] = [None] * len(x)
        if small.any():
            away = x[small] * np.int64(self.n) - np.array([int(s) for s in self.sums], dtype=np.int64)
            for i, total in zip(np.flatnonzero(small).tolist(), (away * away).sum(axis=1).tolist(), strict=True):
                out[i] = total
        for i in np.flatnonzero(~small & (rough < 9.3e18)).tolist():
            exact = sum((self.n * int(a) - s) ** 2 for a, s in zip(x[i].tolist(), self.sums, strict=True))
            out[i] = exact if exact <= _LONG else None
        return out


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, d)


def _reduced(parts: DataFrame, d: int) -> np.ndarray:
    """One triangle of all (part, r): those of one part, of at most _SPREAD, are stacked and decomposed again, until a bounded number is left for the driver."""

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            for r in batch.column("r"):
                total = triangle(np.vstack([total, np.frombuffer(r.as_py()).reshape(d, d)]))
        yield pa.RecordBatch.from_pydict({"part": pa.array([key[0].as_py()], pa.int64()), "r": pa.array([total.tobytes()], pa.binary())})

    left = parts.groupBy("part").applyInArrow(merge, "part long, r binary").collect()  # at most _SPREAD rows
    total = np.zeros((d, d))
    for row in sorted(left, key=lambda r: r["part"]):
        total = triangle(np.vstack([total, np.frombuffer(row["r"]).reshape(d, d)]))
    return total


def fit(distinct: DataFrame, d: int) -> Whitening | None:
    """The whitening of the vectors x of d longs, each taken once as given; None of none."""
    ship(distinct.sparkSession)
    row = distinct.agg(F.count("*").alias("n"), *(F.sum(F.col("x")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(d))).first()
    if not row["n"]:
        return None
    n, sums = row["n"], tuple(int(row[f"s{i}"]) for i in range(d))
    mean = np.array([s / n for s in sums])

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, seen = np.zeros((d, d)), False
        for batch in batches:
            seen = seen or batch.num_rows > 0
            for i in range(0, batch.num_rows, _ROWS):
                total = triangle(np.vstack([total, _matrix(batch.column("x").slice(i, _ROWS), d) - mean]))
        if seen:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId() % _SPREAD], pa.int64()), "r": pa.array([total.tobytes()], pa.binary())})

    r = _reduced(distinct.select("x").mapInArrow(compress, "part long, r binary"), d)
    values, components = jacobi(r)
    variances = values**2 / n
    return Whitening(n, sums, components, variances, float(variances.sum()))


def identity_error(distinct: DataFrame, d: int, model: Whitening, most: int = MOST) -> float | None:
    """How far the whitened vectors' covariance, measured on all of them, is from the identity at most; None if nothing varies."""
    k = model.rank(most)
    if not k:
        return None

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Numbers, sums and products about the part's first mean: sums shift by numbers of rows, so that parts add up."""
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            for i in range(0, batch.num_rows, _ROWS):
                z = model.whiten(_matrix(batch.column("x").slice(i, _ROWS), d), most)
                z1 = np.column_stack([np.ones(len(z)), z])
                total += z1.T @ z1
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.repeat(np.arange(k + 1), k + 1), pa.int32()), "j": pa.array(np.tile(np.arange(k + 1), k + 1), pa.int32()), "v": pa.array(total.ravel())})

    sums = {(r["i"], r["j"]): r["v"] for r in distinct.select("x").mapInArrow(measure, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}  # at most 25
    full = np.array([[sums[i, j] for j in range(k + 1)] for i in range(k + 1)])
    mean = full[0, 1:] / full[0, 0]
    return float(np.abs(full[1:, 1:] / full[0, 0] - np.outer(mean, mean) - np.eye(k)).max())


def whitened(vectors: DataFrame, most: int = MOST) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each usable row and component up to `most`.

    vectors needs vec_id and embedding; other columns aren't read, whatever their names. Vectors that are null, empty, or hold null, NaN or infinite entries take no part, nor do those whose number of dimensions isn't
    the most frequent one (ties: the greater). Each different vector of whole numbers counts once in n, sums and components; each row, repeated ones and those with a null vec_id included, has its own results. Fewer dimensions than `most`: as many components.
    A component along which nothing varies (all of them, if the vectors are all the same) has a null whitened value and no part in identity_error; without any variance explained and identity_error are null too.
    Components whose variances are equal may be any of their plane, the same for all rows. Entries whose 256-fold exceeds a long are taken as the nearest long; a deviation beyond a long is null. Empty table: no rows.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).where(usable("v")).select("vec_id", whole("v").alias("x"))
    size = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if size is None:
        return spark.createDataFrame([], schema)
    d = size["d"]
    rows = rows.where(F.size("x") == d)
    distinct = cut(rows.select("x").distinct(), "distinct-vectors")
    model = fit(distinct, d)
    error = identity_error(distinct, d, model, most)
    parts, rank = min(most, d), model.rank(most)
    explained = [float(v) / model.trace for v in model.variances[:parts]] if model.trace > 0 else [None] * parts

    def project(batch: pa.RecordBatch) -> dict:
        x = _matrix(batch.column("x"), d)
        m = len(x)
        z = np.full((m, parts), np.nan)
        z[:, :rank] = model.whiten(x, most)
        each = np.repeat(np.arange(m), parts)
        return {
            "vec_id": batch.column("vec_id").take(pa.array(each)),
            "component": pa.array(np.tile(np.arange(1, parts + 1), m), pa.int32()),
            "n": pa.array(np.full(m * parts, model.n), pa.int64()),
            "deviation": pa.array(model.deviations(x), pa.int64()).take(pa.array(each)),
            "whitened": pa.array(z.ravel(), pa.float64(), from_pandas=True),
            "explained": explained * m,
            "identity_error": [error] * (m * parts),
        }

    return map_arrow(rows, project, schema)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four components of each row of embeddings."""
    return whitened(table(spark, sf_dir, "embeddings"))
