"""Embedding whitening: leading principal components by Chebyshev-filtered subspace iteration.

The covariance V is never formed. A pass multiplies it with a block of b directions: tasks add up Xc^T (Xc Q) for
their centred rows, states of d * b numbers are merged in a tree. V has no negative eigenvalues, so the interval
from 0 to the smallest Ritz value of the block holds the unwanted spectrum; the Chebyshev polynomial of that interval,
by its three-term recurrence one pass a degree, damps it and lifts what lies above. QR and a Rayleigh-Ritz step
follow, until the residual |V q - e q| of every asked component is at the level of rounding. Where the
spectrum is so flat that this would take long, the block is doubled; a block of all d directions is exact.

Defined cases: vectors that are null or hold null or non-finite entries take no part; shorter vectors count
as padded with zeros; equal vectors are fitted once and all get their coordinates; a row without an id has a
null id; components without variance are not returned, so that equal vectors, one vector or an empty table give no
rows. Signs: the largest loading of a component (the first, on ties) is positive. Squared deviations
above 2^63 - 1 are reported as that number. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import Batch, State, VectorBlocks, add_states
from .common import stored

SCALE = 64
COMPONENTS = 16
GUARD = 16  # directions beyond the asked ones
SEED = 13
_GROWTH = 1e8  # how far one filter may pull the block apart before QR
_MOST_DEGREE = 24
_SLOW = 240  # passes still needed at which the block is doubled
_MOST_PASSES = 4000
_MOST = 2**63 - 1


@dataclass
class Whitening:
    n: int  # different vectors
    sums: list[int]  # of each dimension over them
    axes: np.ndarray  # d x p
    values: np.ndarray  # p eigenvalues, falling
    trace: float
    identity_error: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def whole_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): components floor(scale * x) of vectors without null or non-finite entries, padded to one length."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.filter(v.isNotNull() & fine).select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"),
    )
    short, dim = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if short == dim:
        return rows
    pad = F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v"))
    return rows.withColumn("v", F.concat("v", pad))


# ---- passes over the fitted vectors ----------------------------------------------------------------


def _sum_pass(blocks: VectorBlocks) -> list[int]:
    low = (1 << 26) - 1

    def step(batches: Iterable[Batch]) -> State:
        total = {"high": np.zeros(blocks_dim, np.int64), "low": np.zeros(blocks_dim, np.int64)}
        for _, x in batches:
            x = x.astype(np.int64)
            total["high"] += (x >> 26).sum(0)
            total["low"] += (x & low).sum(0)
        return total

    blocks_dim = blocks.dim
    state = blocks.fold(step, add_states, 16 * blocks.dim)
    return [int(h) * (1 << 26) + int(lo) for h, lo in zip(state["high"], state["low"])]


def _times(blocks: VectorBlocks, mean: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, float]:
    """(V q, trace of V) in one pass."""

    def step(batches: Iterable[Batch]) -> State:
        out, size = np.zeros(q.shape), 0.0
        for _, x in batches:
            x = x - mean
            out += x.T @ (x @ q)
            size += float((x * x).sum())
        return {"out": out, "size": size}

    state = blocks.fold(step, add_states, 8 * q.size)
    return state["out"] / blocks.n, state["size"] / blocks.n


def _identity_error(blocks: VectorBlocks, mean: np.ndarray, axes: np.ndarray, values: np.ndarray) -> float:
    def step(batches: Iterable[Batch]) -> State:
        out = np.zeros((len(values), len(values)))
        for _, x in batches:
            w = (x - mean) @ axes / np.sqrt(values)
            out += w.T @ w
        return {"out": out}

    state = blocks.fold(step, add_states, 8 * len(values) ** 2)
    return float(np.abs(state["out"] / blocks.n - np.eye(len(values))).max())


# ---- subspace iteration ----------------------------------------------------------------------------


def _degree(values: np.ndarray) -> int:
    """The degree at which the filter pulls the block's ends apart by _GROWTH."""
    top = 2 * values[0] / values[-1] - 1
    return int(np.clip(math.log(_GROWTH) / max(math.acosh(max(top, 1.0)), 1e-3), 2, _MOST_DEGREE))


def leading_axes(multiply, dim: int, count: int, guard: int = GUARD, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, int]:
    """(eigenvectors, eigenvalues, passes) of the ``count`` largest eigenvalues above rounding.

    ``multiply(q)`` is one pass: the symmetric, non-negative d x d matrix times d x b.
    """
    rng = np.random.default_rng(seed)
    block = min(dim, count + guard)
    q = np.linalg.qr(rng.standard_normal((dim, block)))[0]
    eps = np.finfo(float).eps
    passes, filters, stuck, best = 0, 0, 0, math.inf
    while True:
        y = multiply(q)
        passes += 1
        h = q.T @ y
        values, u = np.linalg.eigh((h + h.T) / 2)
        values, u = values[::-1], u[:, ::-1]
        q, y = q @ u, y @ u
        top = max(float(values[0]), 0.0)
        kept = int((values[:count] > top * dim * 8 * eps).sum())
        if not kept:
            return q[:, :0], values[:0], passes
        residual = float(np.sqrt(((y - q * values) ** 2).sum(0))[:kept].max()) / top
        stuck = stuck + 1 if residual > best / 2 else 0
        best = min(best, residual)
        level = 32 * eps * math.sqrt(dim)
        if residual <= level or (stuck > 2 and residual <= 64 * level):
            return q[:, :kept], values[:kept], passes
        if passes > _MOST_PASSES:
            raise RuntimeError(f"no certified components after {passes} passes, residual {residual:.1e}")
        edge = float(values[-1])
        if edge <= top * dim * eps:  # nothing is left outside the block
            q = np.linalg.qr(y)[0]
            continue
        gain = math.acosh(max(2 * float(values[kept - 1]) / edge - 1, 1.0))
        if filters >= 2 and block < dim and (stuck > 2 or math.log(residual / level) > gain * _SLOW):
            more = min(dim, 2 * block) - block
            block += more
            q = np.linalg.qr(np.hstack([q, rng.standard_normal((dim, more))]))[0]
            filters, stuck = 0, 0
            continue
        degree, half = _degree(values), edge / 2  # the interval is [0, edge]
        before, now = q, (y - half * q) / half
        for _ in range(degree - 1):
            before, now = now, 2 * (multiply(now) - half * now) / half - before
            passes += 1
        q = np.linalg.qr(now)[0]
        filters += 1


def fit_whitening(rows: DataFrame, components: int = COMPONENTS, guard: int = GUARD) -> Whitening | None:
    """The whitening of the different vectors of (vec_id, v); None without vectors or dimensions."""
    different = stored(rows.select("v").distinct())
    if different.filter(F.size("v") > 0).isEmpty():
        return None
    blocks = VectorBlocks.of(different.select(F.xxhash64("v").alias("id"), F.col("v").cast("array<double>").alias("features")))
    try:
        fit = Whitening(blocks.n, _sum_pass(blocks), np.zeros((blocks.dim, 0)), np.zeros(0), 0.0, 0.0, 0)
        mean = fit.mean
        traces: list[float] = []

        def multiply(q: np.ndarray) -> np.ndarray:
            found, trace = _times(blocks, mean, q)
            traces.append(trace)
            return found

        fit.axes, fit.values, fit.passes = leading_axes(multiply, blocks.dim, components, guard)
        fit.trace = traces[0]
        if len(fit.values):
            largest = fit.axes[np.abs(fit.axes).argmax(0), np.arange(len(fit.values))]
            fit.axes = fit.axes * np.where(largest < 0, -1.0, 1.0)
            fit.identity_error = _identity_error(blocks, mean, fit.axes, fit.values)
    finally:
        blocks.close()
    return fit


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Sum over dimensions of (n x - S)^2, exact."""
    most = (n * float(np.abs(x.astype(float)).max(initial=0)) + max(map(abs, sums), default=0)) ** 2 * x.shape[1]
    if most < 2.0**62:
        off = n * x - np.array(sums, np.int64)
        return (off * off).sum(1)
    off = n * x.astype(object) - np.array(sums, object)
    return np.minimum((off * off).sum(1), _MOST).astype(np.int64)


def whiten(rows: DataFrame, fit: Whitening) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row and component."""
    dim, p = fit.axes.shape
    mean, scaled = fit.mean, fit.axes / np.sqrt(fit.values)
    explained = fit.values / fit.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.num_rows
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(m, dim)
            each = pa.array(np.repeat(np.arange(m), p))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("vec_id").take(each), pa.array(np.tile(np.arange(1, p + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * p, fit.n)), pa.array(np.repeat(_deviations(x, fit.n, fit.sums), p)),
                    pa.array(((x - mean) @ scaled).ravel()), pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * p, fit.identity_error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, RESULT)


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened_rows(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Every row of (vec_id, v) in the coordinates of its whitening."""
    fit = fit_whitening(rows, components)
    if fit is None or not len(fit.values):
        return rows.sparkSession.createDataFrame([], RESULT)
    return whiten(rows, fit)
