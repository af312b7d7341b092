"""Numeric passes over a table of vectors.

A pass is one Spark job: every task folds its Arrow batches into one small state, the states are
merged in a tree of further tasks, and only the last few reach the driver. Vectors sit in the
cache as (id, raw float64 bytes) so that a batch becomes a matrix without copying.

States hold exact sums. Vectors are rounded to multiples of 2**(exponent - 52), |x| <= 2**exponent
(an error of at most half an ulp of the largest value), so that sums can be taken over integers:
the result then has the same bits for every partitioning, order of tasks and retry.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRID_BITS = 52
_LOW32 = (1 << 32) - 1
_MERGE_WIDTH = 64
_TASK_BYTES = 256 << 20  # of states in one merging task
_DRIVER_BYTES = 64 << 20
_SPREAD_BYTES = 4 << 20

Batch = tuple[np.ndarray, np.ndarray]
State = dict[str, object]


# ---- exact integer sums ------------------------------------------------------------------------


def split_int(totals: np.ndarray) -> np.ndarray:
    """int64 totals as (high, low 32 bits), which can be added 2**31 times without overflow."""
    totals = totals.astype(np.int64)
    return np.stack([totals >> 32, totals & _LOW32])


def join_int(pair: np.ndarray) -> np.ndarray:
    """Python integers of a split total."""
    return pair[0].astype(object) * (1 << 32) + pair[1].astype(object)


def to_float(numerator, denominator: int, exponent: int) -> float:
    """numerator / denominator * 2**exponent, rounded once."""
    return math.ldexp(int(numerator) / denominator, exponent)


def limbs(values: np.ndarray, exponent: int, width: int, count: int) -> list[np.ndarray]:
    """Integer-valued parts with value = sum(part[i] * 2**(exponent - width * (i + 1)))."""
    parts = []
    rest = values
    for i in range(1, count + 1):
        unit = 2.0 ** (exponent - width * i)
        part = np.floor(rest / unit) if i < count else np.rint(rest / unit)
        rest = rest - part * unit
        parts.append(part)
    return parts


# ---- matrices and Arrow ------------------------------------------------------------------------


def list_matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """n x d matrix of a list<double> column; missing lists and lists of another length are an error."""
    n = len(column)
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    dim = dim if dim is not None else int(sizes[0]) if n else 0
    if n and (sizes != dim).any():
        wrong = sorted({int(x) for x in sizes[sizes != dim]})[:3]
        raise ValueError(f"vectors must have {dim} values, found {wrong} (-1: no vector)")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def on_grid(matrix: np.ndarray, exponent: int) -> np.ndarray:
    unit = 2.0 ** (exponent - GRID_BITS)
    rounded = np.rint(matrix * (1.0 / unit))
    rounded *= unit
    return rounded


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, list<double>) to (id, raw bytes); a missing list becomes no bytes."""
    for batch in batches:
        ids, lists = batch.column(0), batch.column(1)
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes.astype(np.int64) * 8)]).astype(np.int32)
        data = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False))
        vec = pa.Array.from_buffers(
            pa.binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(data)]
        )
        yield pa.RecordBatch.from_arrays([ids, vec], names=["id", "vec"])


def _profile(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per task: rows, smallest and largest number of values, largest magnitude."""
    n, low, high, size = 0, None, None, 0.0
    for batch in batches:
        if len(batch):
            vec = batch.column(1)
            ends = np.frombuffer(vec.buffers()[1], np.int32)[vec.offset :][: len(vec) + 1]
            dims = np.diff(ends) // 8
            low = int(dims.min()) if low is None else min(low, int(dims.min()))
            high = int(dims.max()) if high is None else max(high, int(dims.max()))
            if ends[-1] > ends[0]:
                count = (int(ends[-1]) - int(ends[0])) // 8
                values = np.frombuffer(vec.buffers()[2], np.float64, count, int(ends[0]))
                # A NaN makes the maximum NaN, which then fails the check as well.
                size = float(np.maximum(size, np.abs(values).max()))
            n += len(vec)
    if n:
        row = [pa.array([n]), pa.array([low]), pa.array([high]), pa.array([size])]
        yield pa.RecordBatch.from_arrays(row, names=["n", "low", "high", "size"])


def _bytes_matrix(column: pa.Array, dim: int) -> np.ndarray:
    start = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset]
    return np.frombuffer(
        column.buffers()[2], dtype=np.float64, count=len(column) * dim, offset=int(start)
    ).reshape(len(column), dim)


@dataclass
class VectorBlocks:
    """Cached vectors with what every pass needs to know about them."""

    df: DataFrame | None
    n: int
    dim: int
    exponent: int
    width: int
    seeds: dict = field(default_factory=dict)

    @staticmethod
    def of(vectors: DataFrame) -> VectorBlocks:
        """Cache (id, features) and check them.

        Ids only tell rows apart in draws and ties; rows with one id are rows of their own, and a row without
        an id counts under a hash of its vector. The rows are read from their source once: the check runs
        over the cached bytes.
        """
        features = F.col("features").cast("array<double>")
        df = vectors.select(
            F.coalesce(F.col("id").cast("long"), F.xxhash64(features)).alias("id"), features.alias("features")
        ).mapInArrow(_pack, "id long, vec binary").persist()
        n, low, high, size, width = (
            df.mapInArrow(_profile, "n long, low long, high long, size double")
            .agg(
                F.coalesce(F.sum("n"), F.lit(0)), F.min("low"), F.max("high"), F.max("size"), F.count("*")
            )
            .first()
        )
        blocks = VectorBlocks(df, n, low or 0, 0, width)
        if n == 0:
            blocks.close()
            return blocks
        if low != high or low == 0 or not math.isfinite(size):
            blocks.close()
            raise ValueError(
                f"vectors must be finite and of one size, not {low} to {high} values up to {size}"
            )
        blocks.exponent = math.frexp(size)[1] if size > 0 else 0
        # Every pass reads all vectors again, so a few large partitions are dealt out once.
        cores = vectors.sparkSession.sparkContext.defaultParallelism
        wanted = min(cores, n * low * 8 // _SPREAD_BYTES)
        if width < wanted:
            blocks.df, blocks.width = df.repartition(wanted).persist(), wanted
            blocks.df.count()
            df.unpersist()
        return blocks

    def fold(
        self,
        step: Callable[[Iterable[Batch]], State | None],
        merge: Callable[[State, State], State],
        state_bytes: int = 1 << 16,
    ) -> State:
        """One state for the whole table: step per task, then merge in a tree."""
        dim, exponent = self.dim, self.exponent

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pairs = (
                (b.column(0).to_numpy(), on_grid(_bytes_matrix(b.column(1), dim), exponent))
                for b in batches
                if len(b)
            )
            state = step(pairs)
            if state is not None:
                yield _state_batch(state)

        def combine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for raw in b.column(0).to_pylist():
                    state = pickle.loads(raw)
                    total = state if total is None else merge(total, state)
            if total is not None:
                yield _state_batch(total)

        states = self.df.mapInArrow(run, "state binary")
        width = self.width
        fan = max(2, min(_MERGE_WIDTH, _TASK_BYTES // state_bytes))  # states one task merges
        while width > _MERGE_WIDTH or (width > 1 and width * state_bytes > _DRIVER_BYTES):
            width = -(-width // fan)
            states = states.repartition(width).mapInArrow(combine, "state binary")
        total = None
        for row in states.collect():
            state = pickle.loads(row.state)
            total = state if total is None else merge(total, state)
        return total

    def close(self) -> None:
        if self.df is not None:
            self.df.unpersist()


def _state_batch(state: State) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([pickle.dumps(state)], pa.binary())], names=["state"]
    )


def add_states(a: State, b: State) -> State:
    return {key: a[key] + b[key] for key in a}


# ---- first and second moments ------------------------------------------------------------------

_LIMB = 18


def moments(blocks: VectorBlocks) -> tuple[np.ndarray, np.ndarray]:
    """(mean, covariance) of all vectors from one pass, both correctly rounded.

    The d x d sum of products is exact (three 18-bit limbs per value), so subtracting the mean
    loses nothing and no second pass over centred rows is needed.
    """
    exponent, dim = blocks.exponent, blocks.dim

    def step(batches: Iterable[Batch]) -> State | None:
        gram, sums = np.zeros((2, 5, dim, dim), np.int64), np.zeros((2, 3, dim), np.int64)
        for _, x in batches:
            for start in range(0, len(x), 1 << 14):  # products of 36 bits stay exact
                h, m, l = limbs(x[start : start + (1 << 14)], exponent, _LIMB, 3)
                hm, hl, ml = h.T @ m, h.T @ l, m.T @ l
                terms = (h.T @ h, hm + hm.T, hl + hl.T + m.T @ m, ml + ml.T, l.T @ l)
                gram += split_int(np.stack(terms))
                sums += split_int(np.stack([h.sum(0), m.sum(0), l.sum(0)]))
        return {"gram": gram, "sums": sums}

    state = blocks.fold(step, add_states, state_bytes=80 * dim * dim)
    gram, sums = join_int(state["gram"]), join_int(state["sums"])
    n, bits = blocks.n, _LIMB
    total = sum(sums[i] << (bits * (2 - i)) for i in range(3))
    product = sum(gram[i] << (bits * (4 - i)) for i in range(5))
    mean = np.array([to_float(t, n, exponent - 3 * bits) for t in total])
    centred = n * product - np.outer(total, total)
    scale = 2 * (exponent - 3 * bits)
    cov = np.array([[to_float(c, n * n, scale) for c in row] for row in centred])
    return mean, cov
