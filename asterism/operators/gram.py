"""The covariance of wide vectors, made and returned in blocks of columns.

Every task adds up products for one strip of columns at a time, so that its state is bounded for any
width. States are keyed by (block row, block column) and merged in groups of bounded size; the last step
divides in the tasks that hold the blocks. Neither a task nor the driver sees the whole matrix.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .blocks import Batch, State, VectorBlocks, _bytes_matrix, add_states, limbs, on_grid, split_int

BLOCK = 128
_LIMB = 18
_FAN = 32  # states that one merging task reads; each has 80 * BLOCK**2 bytes
_CHUNK = 1 << 14  # products of 36 bits stay exact
_LEVELS = 5
_KEYED = "a int, b int, part int, state binary"


def exact_sums(blocks: VectorBlocks) -> list[int]:
    """The sum of every column, in units of 2**(exponent - 3 * _LIMB)."""
    exponent, dim = blocks.exponent, blocks.dim

    def step(batches: Iterable[Batch]) -> State:
        total = np.zeros((2, 3, dim), np.int64)
        for _, x in batches:
            total += split_int(np.stack([part.sum(0) for part in limbs(x, exponent, _LIMB, 3)]))
        return {"sums": total}

    high, low = blocks.fold(step, add_states, 48 * dim)["sums"]
    return [
        sum((int(high[i, j]) * (1 << 32) + int(low[i, j])) << (_LIMB * (2 - i)) for i in range(3)) for j in range(dim)
    ]


def _strip(blocks: VectorBlocks, a: int) -> DataFrame:
    """States of the blocks (a, b) for b >= a, one per task."""
    dim, exponent = blocks.dim, blocks.exponent
    left = slice(a * BLOCK, min(dim, (a + 1) * BLOCK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        gram = np.zeros((2, _LEVELS, left.stop - left.start, dim - left.start), np.int64)
        for batch in batches:
            x = on_grid(_bytes_matrix(batch.column("vec"), dim)[:, left.start :], exponent)
            for start in range(0, len(x), _CHUNK):
                parts = limbs(x[start : start + _CHUNK], exponent, _LIMB, 3)
                own = [p[:, : left.stop - left.start].T for p in parts]
                for level in range(_LEVELS):
                    both = [(i, level - i) for i in range(3) if 0 <= level - i < 3]
                    gram[:, level] += split_int(sum(own[i] @ parts[j] for i, j in both))
        part = TaskContext.get().partitionId()
        for b in range(a, -(-dim // BLOCK)):
            state = gram[:, :, :, (b - a) * BLOCK : (b - a + 1) * BLOCK]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a], pa.int32()), pa.array([b], pa.int32()), pa.array([part], pa.int32()),
                    pa.array([np.ascontiguousarray(state).tobytes()], pa.binary()),
                ],
                names=["a", "b", "part", "state"],
            )

    return blocks.df.mapInArrow(run, _KEYED)


def _merged(table: pa.Table, shape: tuple[int, ...]) -> np.ndarray:
    total = np.zeros(shape, np.int64)
    for raw in table.column("state"):
        total += np.frombuffer(raw.as_buffer(), np.int64).reshape(shape)
    return total


def covariance_blocks(blocks: VectorBlocks) -> DataFrame:
    """(i, j, cov) of all pairs of columns, divided by n; exact up to the last places."""
    dim, n, exponent = blocks.dim, blocks.n, blocks.exponent
    count = -(-dim // BLOCK)
    sums = exact_sums(blocks)
    states = reduce(DataFrame.union, [_strip(blocks, a) for a in range(count)])

    def width(b: int) -> int:
        return min(dim, (b + 1) * BLOCK) - b * BLOCK

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        a, b, turn = (k.as_py() for k in key)
        total = _merged(table, (2, _LEVELS, width(a), width(b)))
        return pa.table({
            "a": pa.array([a], pa.int32()), "b": pa.array([b], pa.int32()), "part": pa.array([turn], pa.int32()),
            "state": pa.array([total.tobytes()], pa.binary()),
        })

    def finish(key: tuple, table: pa.Table) -> pa.Table:
        a, b = (k.as_py() for k in key)
        high, low = _merged(table, (2, _LEVELS, width(a), width(b)))
        product = words.empty(8, high.shape[1:])
        for level in range(_LEVELS):
            shift = _LIMB * (_LEVELS - 1 - level)
            words.add(product, low[level], shift)
            words.add(product, high[level], shift + 32)
        words.settle(product)
        centred = words.times(product, n)
        own, other = (words.halves(sums[c * BLOCK : c * BLOCK + width(c)]) for c in (a, b))
        words.subtract_products(centred, own, other)
        cov = np.ldexp(words.to_float(centred) / n / n, 2 * (exponent - 3 * _LIMB))
        i, j = np.indices(cov.shape)
        i, j, cov = i.ravel() + a * BLOCK, j.ravel() + b * BLOCK, cov.ravel()
        if a != b:
            i, j, cov = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([cov, cov])
        return pa.table({"i": i.astype(np.int32), "j": j.astype(np.int32), "cov": cov})

    tasks = blocks.width
    while tasks > _FAN:  # equal keys of one level are at most _FAN states
        tasks = -(-tasks // _FAN)
        turn = F.pmod("part", F.lit(tasks)).cast("int")
        states = states.withColumn("part", turn).groupBy("a", "b", "part").applyInArrow(merge, _KEYED)
    return states.groupBy("a", "b").applyInArrow(finish, "i int, j int, cov double")
