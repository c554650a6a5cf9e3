"""Whitening of vectors by the leading eigenvectors of their covariance, found by Chebyshev-filtered subspace iteration.

Entries become integers on a fixed grid, ``floor(scale * entry) + shift``, so counts and sums are exact and the same in any order.
The covariance is never formed. One pass over the rows multiplies it with a block of columns: every task centres its rows, takes
Xᵀ(XQ) of them and gives one matrix; matrices are summed in two steps when there are many tasks.

1. A few Lanczos steps with one column bound the spectrum.
2. The block holds more columns than are wanted. A Chebyshev polynomial in the covariance, by its three-term recurrence, is small on
   the unwanted part of the spectrum (from the lower bound to the smallest Ritz value of the block) and grows fast above it.
   Its degree is kept where the first column cannot drown the last wanted one in rounding.
3. QR makes the block orthonormal, Rayleigh-Ritz turns it to Ritz vectors. Steps 2 and 3 repeat until the residuals of all wanted
   pairs are down at rounding level.
4. A last pass takes the covariance of the whitened rows; its distance from the identity must be small.

Rows whose vector is null, empty, or holds null or non-finite entries take no part, nor do vectors of another length than most rows
have (of two lengths as frequent the longer counts), nor entries that the grid would send beyond 2^52. Repeated rows are rows of their
own. Eigenvalues below ``NOTHING`` of the largest are directions without variance and give no component; so one row, equal
rows or an empty table give none. Equal eigenvalues may have any orthonormal vectors of their space. A component's entry of
largest size is positive.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cellsift.llm.common import ship
from cellsift.session import written

ship(__name__)

#: Eigenvalues below this share of the largest one count as zero.
NOTHING = 1e-10
#: Lanczos steps that bound the spectrum, the highest degree of a filter, and how far the columns of a block may grow apart in one.
LANCZOS = 8
DEGREE = 10
GROWTH = 1e7
#: Residuals, as shares of their eigenvalue, at rounding level, those still good enough when they no longer fall, and the most rounds to get there.
ROUNDING = 2e-14
RESIDUAL = 1e-9
ROUNDS = 200
#: The most that the covariance of the whitened rows may differ from the identity.
IDENTITY = 1e-4
#: With more tasks than this, their matrices are summed in two steps.
FAN = 64


@dataclass(frozen=True)
class Centre:
    """Exact mean of integer rows: whole part and the rest over ``n``."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    spread: int

    @staticmethod
    def of(n: int, sums: list[int], lows: list[int], highs: list[int]) -> Centre:
        whole = [s // n for s in sums]
        spread = max(max(h - w, w - low) for w, low, h in zip(whole, lows, highs, strict=True)) + 1
        rest = [s - n * w for s, w in zip(sums, whole, strict=True)]
        return Centre(n, np.array(whole, np.int64), np.array(rest, np.int64), spread)

    def times_n(self, x: np.ndarray) -> np.ndarray:
        """``n x - sums``, exactly: 64-bit integers where they hold it, else Python's."""
        kind = np.int64 if self.n * self.spread < 1 << 62 else object
        return (x - self.whole).astype(kind) * self.n - self.rest

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.times_n(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of squares of ``times_n``; none where a 64-bit integer cannot hold one."""
        d = self.times_n(x)
        if (self.n * self.spread) ** 2 * x.shape[1] < 1 << 63:
            return (d * d).sum(axis=1).tolist()
        sums = [sum(v * v for v in row) for row in d.tolist()]
        return [s if s < 1 << 63 else None for s in sums]


@dataclass(frozen=True)
class Whitening:
    """Unit eigenvectors (columns), eigenvalues, and what certifies them."""

    centre: Centre
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residual: float
    identity_error: float
    passes: int


def on_grid(rows: DataFrame, id_column: str, vector_column: str, scale: int, shift: int) -> DataFrame:
    """``id, x``: the rows that take part, entries as integers; written, since every pass reads them."""
    entries = F.col(f"`{vector_column}`").cast("array<double>")
    valid = F.forall(entries, lambda c: F.coalesce(F.abs(c * scale) < float(1 << 52), F.lit(False)))
    taken = rows.select(F.col(f"`{id_column}`").alias("id"), entries.alias("v")).where(
        entries.isNotNull() & (F.size(entries) > 0) & valid
    )
    placed = taken.select("id", F.transform("v", lambda c: F.floor(c * scale).cast("long") + shift).alias("x"))
    return written(placed, "whitening")


def common_length(x: DataFrame) -> int:
    found = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found.d if found else 0


def _rows(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        x = batch.column(1)
        yield batch.column(0), x.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


class Passes:
    """Passes over the rows: each task folds its centred rows into one array, and the arrays are summed."""

    def __init__(self, x: DataFrame, centre: Centre):
        self.x, self.centre, self.made = x, centre, 0
        self.tasks = x.rdd.getNumPartitions()

    def total(self, shape: tuple[int, ...], fold: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        centre, d, size = self.centre, len(self.centre.whole), math.prod(shape)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(shape)
            for _, x in _rows(batches, d):
                sums += fold(centre.centred(x))
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()])], ["sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(size)
            for batch in batches:
                for part in batch.column(0):
                    sums += np.frombuffer(part.as_buffer(), np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()])], ["sums"])

        parts = self.x.mapInArrow(run, "sums binary")
        if self.tasks > FAN:
            parts = parts.repartition(math.isqrt(self.tasks)).mapInArrow(add, "sums binary")
        self.made += 1
        return sum((np.frombuffer(r.sums, np.float64) for r in parts.collect()), np.zeros(size)).reshape(shape)

    def covariance_times(self, q: np.ndarray) -> np.ndarray:
        return self.total(q.shape, lambda c: c.T @ (c @ q)) / self.centre.n

    def trace(self) -> float:
        return float(self.total((1,), lambda c: np.array([(c * c).sum()]))[0]) / self.centre.n

    def covariance_of(self, projection: np.ndarray) -> np.ndarray:
        """Covariance of the projected rows, about their mean."""
        k = projection.shape[1]

        def fold(c: np.ndarray) -> np.ndarray:
            w = c @ projection
            return np.vstack([w.T @ w, w.sum(axis=0)])

        sums = self.total((k + 1, k), fold) / self.centre.n
        return sums[:k] - np.outer(sums[k], sums[k])


def spectrum_bounds(times: Callable[[np.ndarray], np.ndarray], d: int, steps: int, rng: np.random.Generator) -> tuple[float, float]:
    """Bounds of all eigenvalues from a few Lanczos steps: outer Ritz values, moved out by what the last step left over."""
    basis = [_unit(rng.standard_normal(d))]
    diagonal, beside, left = [], [], 0.0
    for _ in range(min(steps, d)):
        w = times(basis[-1][:, None])[:, 0]
        diagonal.append(float(w @ basis[-1]))
        for v in [*basis, *basis]:  # twice is enough
            w = w - (w @ v) * v
        left = float(np.linalg.norm(w))
        if left <= 1e-12 * max(map(abs, diagonal)):
            left = 0.0
            break
        beside.append(left)
        basis.append(w / left)
    ritz = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(beside[: len(diagonal) - 1], 1) + np.diag(beside[: len(diagonal) - 1], -1))
    return max(0.0, float(ritz[0]) - left), float(ritz[-1]) + left


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v)


def chebyshev(m: int, x: float) -> float:
    """Size of the Chebyshev polynomial of degree m at x >= 1."""
    return math.cosh(min(700.0, m * math.acosh(max(1.0, x))))


def filtered(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, z: np.ndarray, low: float, cut: float, top: float,
             degree: int) -> np.ndarray:
    """The filter of ``degree`` applied to the block ``q``, whose product ``z`` with the covariance is known already.

    The recurrence is scaled by the polynomial's value at ``top``, so nothing overflows.
    """
    half, middle = (cut - low) / 2, (cut + low) / 2
    first = half / (top - middle)
    sigma, before, now = first, q, (z - middle * q) * (first / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        before, now = now, (times(now) - middle * now) * (2 * following / half) - before * (sigma * following)
        sigma = following
    return now


def leading_pairs(times: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``wanted`` largest eigenvalues, their vectors (columns) and the largest residual of a pair over its eigenvalue."""
    rng = np.random.default_rng(seed)
    block = min(d, wanted + max(8, wanted // 2))
    low, top = spectrum_bounds(times, d, LANCZOS, rng) if block < d else (0.0, 0.0)
    q = np.linalg.qr(rng.standard_normal((d, block)))[0]
    before = math.inf
    for _ in range(ROUNDS):
        z = times(q)
        ritz, turn = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        q, z = q @ turn, z @ turn
        largest = max(float(ritz[0]), 0.0)
        if largest == 0.0:
            return ritz[:wanted], q[:, :wanted], 0.0
        real = ritz[:wanted] > NOTHING * largest
        residual = float((np.linalg.norm(z - q * ritz, axis=0)[:wanted][real] / ritz[:wanted][real]).max())
        if block == d or residual <= ROUNDING or (residual <= RESIDUAL and residual > before / 4):
            return ritz[:wanted], q[:, :wanted], residual
        before = residual
        top = max(top, largest)
        cut = max(float(ritz[-1]), low + 1e-9 * top)
        half, middle = (cut - low) / 2, (cut + low) / 2
        ends = (top - middle) / half, (max(float(ritz[wanted - 1]), cut) - middle) / half
        degree = max([1, *(m for m in range(2, DEGREE + 1) if chebyshev(m, ends[0]) <= GROWTH * chebyshev(m, ends[1]))])
        q = np.linalg.qr(filtered(times, q, z, low, cut, top, degree))[0]
    raise RuntimeError(f"the eigenvectors are not certified: a residual of {before:.1e} after {ROUNDS} rounds")


def fit(x: DataFrame, components: int) -> Whitening | None:
    """From the rows of ``on_grid``; none if no row takes part."""
    d = common_length(x)
    if not d:
        return None
    sums = (
        x.where(F.size("x") == d)
        .select(F.posexplode("x").alias("place", "value"))
        .groupBy("place")
        .agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(20,0)")).alias("s"), F.min("value"), F.max("value"))
        .orderBy("place")
        .collect()  # one row a dimension
    )
    centre = Centre.of(sums[0].n, [int(r.s) for r in sums], [r[3] for r in sums], [r[4] for r in sums])
    passes = Passes(x.where(F.size("x") == d), centre)
    trace = passes.trace()
    none = Whitening(centre, np.zeros((d, 0)), np.zeros(0), trace, 0.0, 0.0, passes.made)
    if trace == 0.0:
        return none
    values, vectors, residual = leading_pairs(passes.covariance_times, d, min(components, d))
    real = values > NOTHING * values[0]
    values, vectors = values[real], vectors[:, real]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    away = passes.covariance_of(vectors / np.sqrt(values)) - np.eye(len(values))
    error = float(np.abs(away).max())
    if error > IDENTITY:
        raise RuntimeError(f"the whitened rows are not certified: their covariance is {error:.1e} off the identity")
    return Whitening(centre, vectors, values, trace, residual, error, passes.made)


def transform(x: DataFrame, model: Whitening) -> DataFrame:
    """``id, deviation, whitened`` for every row that takes part; ``whitened`` has one entry a component."""
    centre, projection, d = model.centre, model.vectors / np.sqrt(model.values), len(model.centre.whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in _rows(batches, d):
            w = centre.centred(rows) @ projection
            ends = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
            arrays = [ids, pa.array(centre.deviations(rows), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(w.ravel()))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "deviation", "whitened"])

    kind = x.schema["id"].dataType.simpleString()
    return x.where(F.size("x") == d).mapInArrow(run, f"id {kind}, deviation long, whitened array<double>")


def whiten(vectors: DataFrame, components: int = 32, id_column: str = "vec_id", vector_column: str = "embedding",
           scale: int = 64, shift: int = 1_000_000) -> tuple[DataFrame, Whitening | None]:
    """The rows of ``transform``, their id by its own name, and the model; no rows if nothing varies."""
    x = on_grid(vectors, id_column, vector_column, scale, shift)
    model = fit(x, components)
    if model is None or not len(model.values):
        kind = x.schema["id"].dataType.simpleString()
        empty = x.sparkSession.createDataFrame([], f"id {kind}, deviation long, whitened array<double>")
        return empty.withColumnRenamed("id", id_column), model
    return transform(x, model).withColumnRenamed("id", id_column), model
