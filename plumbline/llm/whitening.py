"""Embedding whitening by FEAST: contour integrals of shifted covariance solves.

1. Vectors become whole numbers; each distinct one is kept once (the fit list). Two passes over it
   give its size and sums, exactly, and the covariance, centred before multiplying.
2. The spectrum is cut into intervals that hold few eigenvalues each. The inertia of V - s I (signs of
   the pivots of its tridiagonal form) tells how many lie above s, without solving for any.
3. Each interval is a task. A Gauss quadrature along a circle through its ends, each node a complex
   shifted solve with V, projects a random block onto the interval's eigenspace; Rayleigh-Ritz in the
   projected space gives eigenpairs, and both are repeated until the residuals are at rounding level.
   The number of pairs found must equal the inertia count; with fewer the block is widened.
4. One pass projects all rows. One over the fit list measures how far the covariance of the result is
   from the identity.

What the driver sees is of the size of the covariance, dimensions squared; it does not grow with rows.

Nulls: rows whose vector is null or holds a null, NaN or infinite entry are dropped; a null vec_id is
kept. The space is that of the most frequent length (the longer one on a tie); rows of another length,
and empty vectors, have no place in it and are left out. Components are those with a positive
eigenvalue, `MOST` at most: constant dimensions and copies of dimensions have none, a single distinct
vector gives no rows. Repeated rows are rows of their own and count once in the fit. A deviation that
does not fit a long is null; an entry whose whole number does not is an error. Extra columns are not
read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Scratch

SCALE = 64
OFFSET = 1_000_000
MOST = 16  # components
QUADRATURE = 8  # nodes on the upper half of a contour
PER_INTERVAL = 4  # eigenvalues that an interval should hold
ROUNDS = 60
FLOOR = 1e-11  # of the greatest eigenvalue; below is zero up to rounding
COLUMNS = [
    ("vec_id", pa.int64(), "bigint"),
    ("component", pa.int32(), "int"),
    ("n", pa.int64(), "bigint"),
    ("deviation", pa.int64(), "bigint"),
    ("whitened", pa.float64(), "double"),
    ("explained", pa.float64(), "double"),
    ("identity_error", pa.float64(), "double"),
]
SCHEMA = ", ".join(f"{n} {k}" for n, _, k in COLUMNS)


def whole_rows(column: pa.Array) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The places of usable vectors, and per length (places of them, their whole numbers)."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries become NaN
    ends = np.cumsum(lengths)
    bad = np.append(0, np.cumsum(~np.isfinite(flat)))
    usable = (bad[ends] == bad[ends - lengths]) & (lengths > 0)
    out = []
    for length in np.unique(lengths[usable]).tolist():
        places = np.flatnonzero(usable & (lengths == length))
        found = np.floor(flat[(ends - lengths)[places][:, None] + np.arange(length)] * SCALE)
        if len(found) and np.abs(found).max() > 2**62:
            raise OverflowError("an entry of a vector does not fit a long")
        out.append((places, found.astype(np.int64) + OFFSET))
    return usable, out


def encoded(x: np.ndarray) -> bytes:
    """A vector as bytes, four an entry where that is enough; the first byte tells."""
    wide = bool((x != x.astype(np.int32)).any())
    return b"\x08" + x.astype("<i8").tobytes() if wide else b"\x04" + x.astype("<i4").tobytes()


def decoded(column: pa.Array) -> np.ndarray:
    rows = [np.frombuffer(b, "<i8" if b[0] == 8 else "<i4", offset=1) for b in column.to_pylist()]
    return np.array(rows, np.int64)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(embedding) -> (dims, x, copies), each vector of a batch once."""
    for batch in batches:
        dims, keys, copies = [], [], []
        for _, x in whole_rows(batch.column(0))[1]:
            own, counts = np.unique(x, axis=0, return_counts=True)
            dims += [x.shape[1]] * len(own)
            keys += map(encoded, own)
            copies += counts.tolist()
        yield pa.RecordBatch.from_arrays(
            [pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(copies, pa.int64())], ["dims", "x", "copies"]
        )


def fit_list(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """The table (x) of distinct vectors of the most frequent length, and that length (0: no vector)."""
    table = scratch.save(
        rows.select(F.col("embedding").cast("array<double>"))
        .mapInArrow(_distinct, "dims int, x binary, copies bigint")
        .groupBy("dims", "x")
        .agg(F.sum("copies").alias("copies"))
    )
    best = table.groupBy("dims").agg(F.sum("copies").alias("rows")).agg(F.max(F.struct("rows", "dims")).alias("b")).first().b
    dims = best.dims if best else 0
    return table.where(F.col("dims") == dims).select("x"), dims


def sums(table: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """The number of vectors and their sum in each dimension, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, np.int64)
        for batch in batches:
            if batch.num_rows:
                n += batch.num_rows
                total += decoded(batch.column(0)).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(-1, dims), pa.int32()), pa.array(np.append(n, total))], ["i", "v"]
            )

    found = table.mapInArrow(run, "i int, v bigint").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    return int(found[0].v), np.array([r.v for r in found[1:]], np.int64)


def centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """x - S / n from the whole numbers n x - S."""
    return (n * x - total) / n


def second_moments(table: DataFrame, width: int, rows_of) -> np.ndarray:
    """Sums of products of the columns of `rows_of(x)` over the fit list."""
    i, j = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                y = rows_of(decoded(batch.column(0)))
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "v"])

    out = np.zeros((width, width))
    for r in table.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out


class Inertia:
    """How many eigenvalues of a symmetric matrix lie above a number."""

    def __init__(self, matrix: np.ndarray):
        a, n = matrix.astype(float).copy(), len(matrix)
        # Householder reflections to a tridiagonal matrix of the same inertia under shifts.
        for k in range(n - 2):
            x = a[k + 1 :, k].copy()
            norm = np.linalg.norm(x)
            if norm == 0:
                continue
            x[0] += np.copysign(norm, x[0])
            x /= np.linalg.norm(x)
            a[k + 1 :, :] -= 2 * np.outer(x, x @ a[k + 1 :, :])
            a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ x, x)
        self.diagonal, self.square = np.diag(a).copy(), np.append(0.0, np.diag(a, 1) ** 2)
        self.tiny = np.finfo(float).tiny ** 0.5

    def above(self, shift: float) -> int:
        count, pivot = 0, 1.0
        for d, s in zip((self.diagonal - shift).tolist(), self.square.tolist()):
            pivot = d - s / pivot
            if abs(pivot) < self.tiny:
                pivot = -self.tiny
            count += pivot > 0
        return count

    def clear(self, shift: float, room: float) -> bool:
        """Whether no eigenvalue lies within `room` of `shift`."""
        return self.above(shift - room) == self.above(shift + room)


def intervals(inertia: Inertia, top: float, most: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues) that together hold the `most` greatest eigenvalues above the floor."""
    floor = top * FLOOR
    most = min(most, inertia.above(floor))
    if not most:
        return []
    low, high = floor, top * (1 + 1e-9)
    for _ in range(80):
        if inertia.above(low) <= most + PER_INTERVAL and inertia.clear(low, 1e-3 * low):
            break
        mid = (low + high) / 2
        if inertia.above(mid) >= most:
            low = mid
        else:
            high = mid
    low = max(floor, low * (1 - 1e-9))
    out, todo = [], [(low, top * (1 + 1e-9))]
    while todo:
        a, b = todo.pop()
        count = inertia.above(a) - inertia.above(b)
        if count > PER_INTERVAL and b - a > 1e-9 * top:
            for share in (0.5, 0.38, 0.62, 0.27, 0.73):
                cut = a + share * (b - a)
                if inertia.clear(cut, 1e-3 * (b - a)):
                    todo += [(a, cut), (cut, b)]
                    break
            else:
                out.append((a, b, count))
        elif count:
            out.append((a, b, count))
    return out


def feast(matrix: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The eigenpairs with low < value <= high, `count` of them by inertia."""
    n, centre, radius = len(matrix), (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(QUADRATURE)
    angles = -np.pi / 2 * (nodes - 1)
    shifts = centre + radius * np.exp(1j * angles)
    eye, scale = np.eye(n), np.abs(matrix).sum(axis=1).max()
    width = min(n, count + 6)
    while True:
        block = np.random.default_rng(width).standard_normal((n, width))
        best = np.inf
        for _ in range(ROUNDS):
            projected = np.zeros_like(block)
            for shift, angle, weight in zip(shifts, angles, weights):
                solved = np.linalg.solve(shift * eye - matrix, block.astype(complex))
                projected += weight / 2 * np.real(radius * np.exp(1j * angle) * solved)
            basis = np.linalg.qr(projected)[0]
            values, small = np.linalg.eigh(basis.T @ matrix @ basis)
            block = basis @ small
            inside = (values > low) & (values <= high)
            residual = np.linalg.norm(matrix @ block[:, inside] - block[:, inside] * values[inside], axis=0).max(initial=0.0)
            if inside.sum() == count and (residual <= 8e-16 * scale or residual >= best / 2 and residual <= 1e-12 * scale):
                return values[inside], block[:, inside]
            if inside.sum() == count:
                best = min(best, residual)
        if width == n:
            raise ArithmeticError(f"{int(inside.sum())} eigenvalues found in ({low}, {high}], not {count}")
        width = min(n, 2 * width)


def components(spark: SparkSession, matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` greatest positive eigenvalues, falling, and their unit eigenvectors as columns. Each
    interval is solved in a task of its own."""
    top = float(np.abs(matrix).sum(axis=1).max())
    found = intervals(Inertia(matrix), top, most) if top > 0 else []
    if not found:
        return np.zeros(0), np.zeros((len(matrix), 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, count in zip(*[c.to_pylist() for c in batch.columns]):
                values, vectors = feast(matrix, low, high, count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values), pa.array(vectors.T.tolist(), pa.list_(pa.float64()))], ["value", "vector"]
                )

    table = spark.createDataFrame(found, "low double, high double, count int").repartition(len(found))
    pairs = sorted(table.mapInArrow(run, "value double, vector array<double>").collect(), key=lambda r: -r.value)[:most]
    return np.array([r.value for r in pairs]), np.array([r.vector for r in pairs]).T


def deviations(x: np.ndarray, n: int, total: np.ndarray) -> list[int | None] | np.ndarray:
    """Sums over dimensions of (n x - S)^2, exactly; None beyond a long."""
    far = n * x - total
    if len(far) and float(np.abs(far).max()) ** 2 * far.shape[1] < 2**62:
        return (far * far).sum(axis=1)
    exact = (sum(v * v for v in row) for row in far.tolist())
    return [v if v < 1 << 63 else None for v in exact]


def whiten(rows: DataFrame, scratch: Scratch, most: int = MOST) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of rows (vec_id, embedding)."""
    table, dims = fit_list(rows, scratch)
    n, total = sums(table, dims) if dims else (0, None)
    values = np.zeros(0)
    if n > 1:
        covariance = second_moments(table, dims, lambda x: centred(x, n, total)) / n
        values, vectors = components(rows.sparkSession, covariance, most)
    if not len(values):
        return rows.sparkSession.createDataFrame([], SCHEMA)
    projection = vectors / np.sqrt(values)
    own = second_moments(table, len(values), lambda x: centred(x, n, total) @ projection) / n
    error = float(np.abs(own - np.eye(len(values))).max())
    explained = values / np.trace(covariance)
    k = len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, x in whole_rows(batch.column(1))[1]:
                if x.shape[1] != dims:
                    continue
                size = len(places)
                out = [
                    batch.column(0).take(pa.array(np.repeat(places, k))),
                    pa.array(np.tile(np.arange(1, k + 1), size), pa.int32()),
                    pa.array(np.full(size * k, n)),
                    pa.array(deviations(x, n, total), pa.int64()).take(pa.array(np.repeat(np.arange(size), k))),
                    pa.array((centred(x, n, total) @ projection).reshape(-1)),
                    pa.array(np.tile(explained, size)),
                    pa.array(np.full(size * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(out, [c for c, _, _ in COLUMNS])

    return rows.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>")).mapInArrow(run, SCHEMA)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark))
