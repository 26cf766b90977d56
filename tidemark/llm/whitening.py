"""Embedding whitening by a polarised covariance.

Entries become integers x = floor(256 * c), so that every sum is exact. The covariance is not summed product by product: for each
dimension i and each pair i < j, the squares of the centred values n*x_i - S_i and of the centred sums of two dimensions are added up, and
by polarisation cov(i, j) = (var(i + j) - var(i) - var(j)) / 2. The matrix goes to ``eigh``; rows are projected on its leading
eigenvectors and divided by the root of the eigenvalues.

1. The distinct x vectors, the *fit list*, are written once to the shared folder, packed in 1, 2, 4 or 8 bytes an entry. Equal vectors are
   combined in the map tasks, so a vector that many rows share costs one row a task.
2. Two passes over that table add up, per task, the entries and then the squares. With m the rounded mean, u = x - m and r = n*m - S, the sum of
   (n*u + r)^2 is n^2 * sum(u^2) - n*r^2, so the tasks add squares of the small numbers u, in 64 bits; a sum about to leave them is sent
   off, and entries too large for them go by Python's integers, in limbs of 60 bits. What the driver gets are sums, d*(d+1)/2 of them for d dimensions, however many rows there are.
3. A third pass measures the covariance of the whitened fit list; then every row is projected.

Rows whose vector is null or holds a null or non-finite entry are left out. Vectors shorter than the longest count as ending in zeros. Entries beyond
the range of a long become its nearest end. Rows are whitened each on their own: repeated rows and null ids stay as they are; further columns are not
read. ``deviation`` is null where it does not fit a long. Components whose eigenvalue is below ``LEAST_SHARE`` of the trace (too few distinct
vectors, or constant dimensions) have null ``whitened``, and without any spread ``explained`` is null too. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.frames import written
from tidemark.llm.text import binary_parts

SCALE = 256
LEAST_SHARE = 1e-11
LOW, HIGH = -(1 << 63), (1 << 63) - 1
#: Sums stay below this, so that one more step cannot overflow 64 bits.
ROOM = 1 << 62
LIMB = 60
STEP_ENTRIES = 1 << 18
KINDS = ("<i1", "<i2", "<i4", "<i8")
SUMS = "i int, j int, limb int, q long"


def scaled(values: np.ndarray) -> np.ndarray:
    """floor(256 * c) as a long, for finite c; beyond the range of a long its nearest end."""
    with np.errstate(over="ignore"):
        x = np.floor(values * SCALE)
    inside = (x >= -(2.0**63)) & (x < 2.0**63)
    out = np.where(inside, x, 0.0).astype(np.int64)
    out[~inside] = np.where(x[~inside] > 0, HIGH, LOW)
    return out


def usable(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows whose vector has only finite entries, and these vectors as longs."""
    offsets = np.asarray(column.offsets, np.int64)
    flat = column.values
    bad = np.asarray(flat.is_null()) if flat.null_count else np.zeros(len(flat), bool)
    values = flat.fill_null(0.0).to_numpy(zero_copy_only=False) if flat.null_count else flat.to_numpy()
    bad = np.concatenate([[0], np.cumsum(bad | ~np.isfinite(values))])
    good = bad[offsets[1:]] == bad[offsets[:-1]]
    if column.null_count:
        good &= np.asarray(column.is_valid())
    x = scaled(np.where(np.isfinite(values), values, 0.0))
    rows = np.flatnonzero(good)
    return rows, [x[a:b] for a, b in zip(offsets[rows].tolist(), offsets[rows + 1].tolist(), strict=True)]


def encoded(x: np.ndarray) -> bytes:
    """A vector without the zeros at its end, in the narrowest integers that hold it."""
    used = np.flatnonzero(x)
    x = x[: used[-1] + 1 if len(used) else 0]
    low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    kind = next(k for k in range(4) if -(1 << (8 << k) - 1) <= low and high < 1 << (8 << k) - 1)
    return bytes([kind]) + x.astype(KINDS[kind]).tobytes()


def decoded(column: pa.Array, dims: int) -> np.ndarray:
    """The packed vectors as rows of a matrix."""
    data, offsets = binary_parts(column)
    out = np.zeros((len(column), dims), np.int64)
    sizes, kinds = np.diff(offsets), data[offsets[:-1]] if len(column) else np.zeros(0, np.uint8)
    for size, kind in {*zip(sizes.tolist(), kinds.tolist(), strict=True)}:
        rows = np.flatnonzero((sizes == size) & (kinds == kind))
        cells = data[offsets[rows][:, None] + 1 + np.arange(size - 1)]
        found = np.ascontiguousarray(cells).view(KINDS[kind]) if size > 1 else np.zeros((len(rows), 0), np.int64)
        out[rows, : found.shape[1]] = found
    return out


def _pieces(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    rows = max(1, STEP_ENTRIES // max(1, dims))
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield decoded(batch.column("x")[a : a + rows], dims)


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


def _sum_rows(i: np.ndarray, j: np.ndarray, sums: list[int] | np.ndarray) -> pa.RecordBatch:
    """Sums as (i, j, limb, q); integers beyond 64 bits in several limbs."""
    names = ["i", "j", "limb", "q"]
    if isinstance(sums, np.ndarray) and sums.dtype == np.int64:
        return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.zeros(len(i), np.int32)), pa.array(sums)], names)
    out = []
    for a, b, value in zip(i.tolist(), j.tolist(), sums, strict=True):
        sign, rest, limb = (-1 if value < 0 else 1), abs(int(value)), 0
        while rest or not limb:
            out.append((a, b, limb, sign * (rest & (1 << LIMB) - 1)))
            rest, limb = rest >> LIMB, limb + 1
    columns = zip(*out, strict=True)
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _summed(pieces: Iterator[np.ndarray], i: np.ndarray, j: np.ndarray, cost, add) -> Iterator[pa.RecordBatch]:
    """Exact sums of ``add`` over the pieces; ``cost`` bounds what a piece can add to one of them."""
    total, bound = np.zeros(len(i), np.int64), 0
    for x in pieces:
        more = cost(x)
        if more >= ROOM or x.dtype == object:
            yield _sum_rows(i, j, list(add(x.astype(object))))
            continue
        if bound + more >= ROOM:
            yield _sum_rows(i, j, total)
            total, bound = np.zeros(len(i), np.int64), 0
        total += add(x)
        bound += more
    if bound:
        yield _sum_rows(i, j, total)


def _collected_sums(rows: DataFrame, step) -> dict[tuple[int, int], int]:
    """(i, j) -> sum; as many as there are dimensions and pairs of them."""
    sums = rows.mapInArrow(step, SUMS).groupBy("i", "j", "limb").agg(F.sum(F.col("q").cast("decimal(20,0)")).alias("q"))
    out: dict[tuple[int, int], int] = {}
    for r in sums.toLocalIterator():
        out[r["i"], r["j"]] = out.get((r["i"], r["j"]), 0) + (int(r["q"]) << LIMB * r["limb"])
    return out


def fit_list(df: DataFrame, vector: str) -> DataFrame:
    """(x, size): each distinct x vector once, and the longest vector with these entries; written to the shared folder."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, vectors = usable(batch.column("v"))
            yield pa.RecordBatch.from_arrays([pa.array(map(encoded, vectors), pa.binary()), pa.array(map(len, vectors), pa.int32())], ["x", "size"])

    packed = df.select(F.col(f"`{vector}`").cast("array<double>").alias("v")).mapInArrow(step, "x binary, size int")
    return written(packed.groupBy("x").agg(F.max("size").alias("size")), "vectors")


def entry_sums(fit: DataFrame, dims: int) -> list[int]:
    """S: the sum of every dimension over the fit list."""
    i, j = np.arange(dims), np.full(dims, -1)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _summed(_pieces(batches, dims), i, j, lambda x: _largest(x) * len(x), lambda x: x.sum(axis=0))

    found = _collected_sums(fit.select("x"), step)
    return [found.get((k, -1), 0) for k in range(dims)]


def squared_sums(fit: DataFrame, n: int, sums: list[int]) -> dict[tuple[int, int], int]:
    """(i, i) -> sum of (n*x_i - S_i)^2 and (i, j) -> sum of (n*(x_i + x_j) - (S_i + S_j))^2 over the fit list."""
    dims = len(sums)
    means = rounded_means(n, sums)
    i, j = np.triu_indices(dims)

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for x in _pieces(batches, dims):
            wide = _largest(x) >= ROOM or any(abs(m) >= ROOM for m in means)
            yield (x.astype(object) - np.array(means, object)) if wide else x - np.array(means, np.int64)

    def add(u: np.ndarray) -> np.ndarray:
        columns, out = np.ascontiguousarray(u.T), []
        for k in range(dims):
            pair = columns[k:] + columns[k]
            pair[0] = columns[k]
            out.append((pair * pair).sum(axis=1))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _summed(centred(batches), i, j, lambda u: 4 * _largest(u) ** 2 * len(u), add)

    small = _collected_sums(fit.select("x"), step)
    out = {}
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        rest = n * means[a] - sums[a] + (n * means[b] - sums[b] if b != a else 0)
        out[a, b] = n * n * small.get((a, b), 0) - n * rest * rest
    return out


def rounded_means(n: int, sums: list[int]) -> list[int]:
    return [(2 * s + n) // (2 * n) for s in sums]


def covariance(n: int, dims: int, squares: dict[tuple[int, int], int]) -> np.ndarray:
    """The covariance matrix by polarisation: exact integers, rounded once at the end."""
    out = np.zeros((dims, dims))
    for (i, j), q in squares.items():
        doubled = 2 * q if i == j else q - squares[i, i] - squares[j, j]
        out[i, j] = out[j, i] = doubled / (2 * n**3)
    return out


@dataclass(frozen=True)
class Whitening:
    """The fitted model; ``scale`` is null for components without spread."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def used(self) -> np.ndarray:
        return self.values > LEAST_SHARE * self.trace if self.trace > 0 else np.zeros(len(self.values), bool)

    def project(self, x: np.ndarray) -> np.ndarray:
        """x - S/n on every component, over the root of its eigenvalue; NaN without spread."""
        means = rounded_means(self.n, self.sums)
        rest = np.array([(self.n * m - s) / self.n for m, s in zip(means, self.sums, strict=True)])
        if _largest(x) >= ROOM or any(abs(m) >= ROOM for m in means):
            centred = (x.astype(object) - np.array(means, object)).astype(float) + rest
        else:
            centred = (x - np.array(means, np.int64)) + rest
        scale = np.where(self.used, 1 / np.sqrt(np.where(self.used, self.values, 1.0)), np.nan)
        return centred @ self.vectors * scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n*x - S)^2, exact; None beyond a long."""
        top = self.n * _largest(x) + max(map(abs, self.sums), default=0)
        if top < ROOM and top * top * max(1, len(self.sums)) < ROOM:
            moved = x * self.n - np.array(self.sums, np.int64)
            return (moved * moved).sum(axis=1).tolist()
        moved = x.astype(object) * self.n - np.array(self.sums, object)
        return [d if d <= HIGH else None for d in map(int, (moved * moved).sum(axis=1))]


def fit(rows: DataFrame, components: int) -> Whitening | None:
    """Model of a written fit list; None without any vector."""
    n, dims = rows.agg(F.count("*"), F.max("size")).first()
    if not n:
        return None
    sums = entry_sums(rows, dims)
    matrix = covariance(n, dims, squared_sums(rows, n, sums))
    values, vectors = np.linalg.eigh(matrix)
    first = np.argsort(values)[::-1][:components]
    return Whitening(n, sums, vectors[:, first], values[first], math.fsum(np.diag(matrix)))


def identity_error(rows: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    used, dims = np.flatnonzero(model.used), len(model.sums)
    if not len(used):
        return None

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(used)
        total = np.zeros((size + 1, size))
        for x in _pieces(batches, dims):
            z = model.project(x)[:, used]
            total += np.concatenate([z.T @ z, z.sum(axis=0)[None]])
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "q"])

    found = rows.select("x").mapInArrow(step, "i int, j int, q double").groupBy("i", "j").agg(F.sum("q").alias("q")).collect()
    total = np.zeros((len(used) + 1, len(used)))
    for r in found:
        total[r["i"], r["j"]] = r["q"]
    mean = total[-1] / model.n
    return float(np.abs(total[:-1] / model.n - np.outer(mean, mean) - np.eye(len(used))).max())


def whitened(df: DataFrame, row_id: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """(row_id, component, n, deviation, whitened, explained, identity_error) of every usable row and component."""
    rows = fit_list(df, vector)
    model = fit(rows, components)
    error = identity_error(rows, model) if model else None
    source = df.select(F.col(f"`{row_id}`").alias("row_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    kinds = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())]
    schema = T.StructType([source.schema["row_id"], *[T.StructField(n, k) for n, k in kinds]])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model is None:
            return
        dims, count = len(model.sums), len(model.values)
        shares = [float(v) / model.trace if model.trace > 0 else None for v in model.values]
        for batch in batches:
            place, vectors = usable(batch.column("v"))
            for a in range(0, len(place), max(1, STEP_ENTRIES // max(1, dims))):
                some = vectors[a : a + max(1, STEP_ENTRIES // max(1, dims))]
                x = np.zeros((len(some), dims), np.int64)
                for k, v in enumerate(some):
                    x[k, : len(v)] = v
                z = model.project(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row_id").take(pa.array(np.repeat(place[a : a + len(some)], count))),
                        pa.array(np.tile(np.arange(1, count + 1), len(some)), pa.int32()),
                        pa.array(np.full(len(some) * count, model.n), pa.int64()),
                        pa.array([d for d in model.deviations(x) for _ in range(count)], pa.int64()),
                        pa.array(z.ravel(), pa.float64(), mask=np.isnan(z.ravel())),
                        pa.array(shares * len(some), pa.float64()),
                        pa.array([error] * (len(some) * count), pa.float64()),
                    ],
                    schema.names,
                )

    return source.mapInArrow(step, schema).withColumnRenamed("row_id", row_id)


def op13_polarised_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op13_polarised_whitening": op13_polarised_whitening}
SQL: dict[str, str] = {}
