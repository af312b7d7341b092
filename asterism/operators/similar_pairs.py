"""Most similar vectors of one table among themselves: exact top k, every two rows compared once.

Rows that are equal are one class, named by its lowest id. Unit vectors of the classes lie in blocks, files that Spark hands to the
executors, cell by cell. A task takes two blocks, and one product in single precision serves the rows of both: the largest
score of a row and of a column says which of them can gain at all, and only these pairs are looked at in double
precision. Blocks meet in rounds, each of about as many pairs as all before: what rows have found so far is one packed
row per block, and the similarities it gives bound what the tasks of the next round send, to some k pairs per row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .blocks import list_matrix
from .many_centroids import SINGLE, _files, _grouped

DIGITS = 6
SLACK = 2e-6  # similarities are rounded to 6 decimals
ANGLE = 1e-7  # rounding of an arc cosine near 1

_TILE = 512, 1024  # rows of the two sides in one product
_EXACT = 1 << 14  # pairs compared at once in double precision
_PENDING = 1 << 20  # found pairs of a side, or four times the best, before all but the best are dropped
_FOUND_VALUES = 1 << 19  # best pairs of a block
_TURNS = 32  # twice the pairs of blocks per core, while blocks need not be larger
_BLOCK_ROWS = 4096  # at least, if they may be that many
_OFFSETS = 16  # of blocks that meet in one round
_WORTH = 0.7  # of the cells of a product; above that rows are not picked for it

_PACKED = "block int, at binary, other binary, sims binary, floor binary"
_ARROW = pa.schema([
    ("block", pa.int32()), ("at", pa.binary()), ("other", pa.binary()), ("sims", pa.binary()), ("floor", pa.binary()),
])


def unit_rows(x: np.ndarray) -> np.ndarray:
    size = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(size == 0.0, 1.0, size)[:, None]


def first_k(who: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int):
    """The k best entries per probe, by (similarity down, id up)."""
    order = np.lexsort((ids, -sims, who))
    who, ids, sims = who[order], ids[order], sims[order]
    keep = np.arange(len(who)) - np.searchsorted(who, who) < k
    return who[keep], ids[keep], sims[keep]


def reached(who: np.ndarray, sims: np.ndarray, k: int, n: int) -> np.ndarray:
    """The k-th similarity of each of n probes in what ``first_k`` gives; -inf where there are fewer."""
    floor = np.full(n, -np.inf)
    full = np.flatnonzero(np.bincount(who, minlength=n) == k)
    floor[full] = sims[np.searchsorted(who, full, side="right") - 1]
    return floor


def possible(unit: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """How similar a row of each group can be: (1 + 1 - d^2) / 2 with its least distance d."""
    c2 = np.einsum("ij,ij->i", centres, centres)
    away = np.sqrt(np.maximum(1.0 + c2[None, :] - 2.0 * (unit @ centres.T), 0.0))
    least = np.maximum(away - radius[None, :] - ANGLE, 0.0)
    return 1.0 - 0.5 * least * least + SLACK


def _cells(true: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.divmod(np.flatnonzero(true), true.shape[1])


class _Side:
    """The rows of a block, what they have found, and the similarities that others must reach."""

    def __init__(self, name: str, dim: int, k: int, floor: bytes | None):
        table = pq.read_table(SparkFiles.get(name)).sort_by("first")
        self.ids = np.concatenate([np.frombuffer(b.as_buffer(), np.int64) for b in table.column("ids")])
        self.unit = np.concatenate([np.frombuffer(b.as_buffer()) for b in table.column("matrix")]).reshape(-1, dim)
        self.centres = np.array([np.frombuffer(b.as_buffer()) for b in table.column("centre")])
        self.radius = table.column("radius").to_numpy()
        self.sizes = np.array([len(b.as_buffer()) // 8 for b in table.column("ids")])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.small, self.k, self.slack = self.unit.astype(np.float32), k, (dim + 16) * SINGLE + 0.5 * 10.0**-DIGITS
        self.floor = np.full(len(self.ids), -np.inf)
        if floor is not None:
            self.floor = np.frombuffer(floor).copy()
        self.floor[~self.unit.any(1)] = np.inf  # zero vectors are asked for elsewhere
        self.best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.pending, self.waiting, self.most = [], 0, min(_PENDING, 4 * k * len(self.ids))

    def least(self, at: np.ndarray) -> np.ndarray:
        return (self.floor[at] - self.slack).astype(np.float32)

    def exact(self, at: np.ndarray, other: _Side, to: np.ndarray):
        sims = np.empty(len(at))
        for i in range(0, len(at), _EXACT):
            cut = slice(i, i + _EXACT)
            sims[cut] = np.einsum("ij,ij->i", self.unit[at[cut]], other.unit[to[cut]])
        sims = np.round(sims, DIGITS) + 0.0
        good = sims >= self.floor[at]
        return at[good], other.ids[to[good]], sims[good]

    def found(self, at: np.ndarray, other: _Side, to: np.ndarray) -> None:
        self._keep(self.exact(at, other, to))

    def _keep(self, some) -> None:
        if len(some[0]):
            self.pending.append(some)
            self.waiting += len(some[0])
        if self.waiting > self.most:
            self.settle()

    def settle(self) -> None:
        if self.pending:
            self.best = first_k(*map(np.concatenate, zip(self.best, *self.pending)), self.k)
            self.pending, self.waiting = [], 0
            self.floor = np.maximum(self.floor, reached(self.best[0], self.best[2], self.k, len(self.floor)))

    def among_group(self, g: int) -> None:
        """The rows of a group among themselves, which gives first bounds."""
        rows = np.arange(self.starts[g], self.starts[g + 1])
        for part in np.array_split(rows, -(-len(rows) // _TILE[0])):
            scores = self.small[part] @ self.small[rows].T
            scores[part[:, None] == rows[None, :]] = -np.inf
            least = np.full(len(part), -np.inf, np.float32)
            if len(rows) > self.k:
                least = np.partition(scores, len(rows) - self.k, axis=1)[:, len(rows) - self.k] - np.float32(2 * self.slack)
            least[np.isposinf(self.floor[part])] = np.inf
            p, r = _cells(scores >= least[:, None])
            other = part[p] != rows[r]
            top = first_k(*self.exact(part[p[other]], self, rows[r[other]]), self.k)
            self._keep(top)
            low = reached(top[0] - part[0], top[2], self.k, len(part))
            self.floor[part] = np.maximum(self.floor[part], low)

    def wants(self, other: _Side) -> np.ndarray:
        """(rows, groups of the other side): where a row can find something."""
        return possible(self.unit, other.centres, other.radius) >= self.floor[:, None]


def _cut(rows: np.ndarray, most: int) -> list[np.ndarray]:
    return np.array_split(rows, -(-len(rows) // most)) if len(rows) else []


def _meet(x: _Side, xs: np.ndarray, y: _Side, ys: np.ndarray, for_x: bool = True, for_y: bool = True) -> int:
    room = np.empty(_TILE[0] * _TILE[1], np.float32)
    for b in _cut(ys, _TILE[1]):
        turned = y.small[b].T
        for a in _cut(xs, _TILE[0]):
            scores = np.matmul(x.small[a], turned, out=room[: len(a) * len(b)].reshape(len(a), len(b)))
            if for_x:
                least = x.least(a)
                near = np.flatnonzero(scores.max(1) >= least)
                if len(near):
                    p, r = _cells(scores[near] >= least[near, None])
                    x.found(a[near[p]], y, b[r])
            if for_y:
                least = y.least(b)
                near = np.flatnonzero(scores.max(0) >= least)
                if len(near):
                    p, r = _cells(scores[:, near] >= least[near])
                    y.found(b[near[r]], x, a[p])
    return len(xs) * len(ys)


def meet_blocks(x: _Side, y: _Side) -> int:
    """Lets the rows of two blocks, or of one, find each other; the number of pairs compared."""
    compared, same = 0, x is y
    if same:
        for g in range(len(x.sizes)):
            x.among_group(g)
    from_x, from_y = x.wants(y), y.wants(x)
    for g, size in enumerate(x.sizes):
        xs = np.arange(x.starts[g], x.starts[g + 1])
        n_x = from_x[xs].sum(0)
        n_y = np.add.reduceat(from_y[:, g], y.starts[:-1], dtype=np.int64)
        left = np.arange(len(y.sizes)) > (g if same else -1)
        both = left & (n_x * y.sizes + size * n_y > _WORTH * size * y.sizes)
        compared += _meet(x, xs, y, np.flatnonzero(np.repeat(both, y.sizes)))
        picked = np.repeat(left & ~both, y.sizes) & from_y[:, g]
        compared += _meet(x, xs, y, np.flatnonzero(picked), for_x=False)
        for h in np.flatnonzero(left & ~both & (n_x > 0)):
            compared += _meet(x, xs[from_x[xs, h]], y, np.arange(y.starts[h], y.starts[h + 1]), for_y=False)
    x.settle()
    y.settle()
    return compared


def rounds(blocks: int) -> Iterator[list[tuple[int, int]]]:
    """All pairs of blocks, also of a block with itself: each round meets about as many blocks as those before."""
    yield [(i, i) for i in range(blocks)]
    offset = 1
    while offset <= blocks // 2:
        stop = min(offset + min(offset, _OFFSETS), blocks // 2 + 1)
        yield [
            (i, (i + o) % blocks) for o in range(offset, stop) for i in range(blocks if 2 * o < blocks else blocks // 2)
        ]
        offset = stop


def _packed(block: int, best: tuple, floor: np.ndarray) -> list[dict]:
    who, other, sims = best
    at = who.astype(np.int32)
    return [{"block": block, "at": at.tobytes(), "other": other.tobytes(), "sims": sims.tobytes(), "floor": floor.tobytes()}]


def _unpacked(rows: pa.Table | pa.RecordBatch):
    kinds = (("at", np.int32), ("other", np.int64), ("sims", np.float64))
    found = [np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in rows.column(name)]) for name, kind in kinds]
    return found[0].astype(np.int64), *found[1:]


def _best_classes(vectors: DataFrame, n: int, dim: int, k: int, most_values: int) -> DataFrame:
    """(class, other, similarity): the k best other classes of each, and each class itself; (cluster, centroid) are unit vectors."""
    spark = vectors.sparkSession
    blocks = math.isqrt(_TURNS * spark.sparkContext.defaultParallelism)
    rows = max(1, min(most_values // dim, _FOUND_VALUES // k, max(_BLOCK_ROWS, -(-n // blocks))))
    names, _ = _files(durable(_grouped(vectors, n, dim, rows * dim)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tasks: dict[int, dict[int, bytes | None]] = {}
        for b in batches:
            for r in b.to_pylist():
                tasks.setdefault(r["task"], {})[r["block"]] = r["floor"]
        for floors in tasks.values():
            sides = {block: _Side(names[block], dim, k, floor) for block, floor in sorted(floors.items())}
            meet_blocks(*(list(sides.values()) * 2)[:2])
            for block, side in sides.items():
                yield pa.RecordBatch.from_pylist(_packed(block, side.best, side.floor), _ARROW)

    def merge(found: pa.Table) -> pa.Table:
        top = first_k(*_unpacked(found), k)
        n_rows = max(len(v.as_buffer()) for v in found.column("floor")) // 8
        low = reached(top[0], top[2], k, n_rows)
        return pa.Table.from_pylist(_packed(found.column("block")[0].as_py(), top, low), _ARROW)

    best = None
    for pairs in rounds(len(names)):
        table = spark.createDataFrame([(t, b) for t, pair in enumerate(pairs) for b in {*pair}], "task int, block int")
        if best is None:
            asked = table.withColumn("floor", F.lit(None).cast("binary"))
        else:
            asked = best.select("block", "floor").join(F.broadcast(table), "block")
        found = asked.select("task", "block", "floor").repartitionById(len(pairs), "task").mapInArrow(meet, _PACKED)
        found = found if best is None else found.union(best)
        best = durable(found.groupBy("block").applyInArrow(merge, _PACKED))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                side = _Side(names[b.column("block")[i].as_py()], dim, k, None)
                who, other, sims = _unpacked(b.slice(i, 1))
                own = np.flatnonzero(np.isneginf(side.floor))
                alike = np.round(np.einsum("ij,ij->i", side.unit[own], side.unit[own]), DIGITS) + 0.0
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([side.ids[who], side.ids[own]])),
                        pa.array(np.concatenate([other, side.ids[own]])), pa.array(np.concatenate([sims, alike])),
                    ],
                    names=["class", "other", "similarity"],
                )

    return best.repartitionById(len(names), "block").mapInArrow(unpack, "class long, other long, similarity double")


def among_themselves(rows: DataFrame, dim: int, k: int, skip_self: bool, most_values: int) -> DataFrame | None:
    """(probe_id, id, similarity) with the k best rows of each that is not zero; None where an id has several vectors."""
    by_id = Window.partitionBy("features").orderBy("id")
    again = Window.partitionBy("features", "id").orderBy("id")
    placed = (
        rows.withColumn("class", F.first("id").over(by_id)).withColumn("place", F.dense_rank().over(by_id))
        .withColumn("copy", F.row_number().over(again))
    )
    placed = placed.withColumn("first", (F.col("place") == 1) & (F.col("copy") == 1))
    placed = durable(placed.withColumn("features", F.when(F.col("first"), F.col("features"))))
    several = placed.groupBy("id").agg((F.min("class") != F.max("class")).alias("several"))
    if several.filter(F.col("several") | F.col("id").isNull()).limit(1).count():
        return None

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = unit_rows(list_matrix(b.column("features"), dim))
                real = np.isfinite(x).all(1)
                x = x[real]
                ends = pa.array(np.arange(0, (len(x) + 1) * dim, dim, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column("class").filter(pa.array(real)), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))],
                    names=["cluster", "centroid"],
                )

    classes = placed.filter("first").select("class", "features")
    vectors = durable(classes.mapInArrow(units, "cluster long, centroid array<double>"))
    n = vectors.count()
    if not n:
        return rows.limit(0).select(F.col("id").alias("probe_id"), "id", F.lit(0.0).alias("similarity"))
    lowest = placed.filter((F.col("place") <= k + int(skip_self)) & (F.col("copy") <= k)).select(F.col("class").alias("other"), "id")
    asking = placed.select("class", F.col("id").alias("probe_id"))
    found = _best_classes(vectors, n, dim, k, most_values).join(lowest, "other").join(asking, "class")
    if skip_self:
        found = found.filter("probe_id <> id")
    return found.select("probe_id", "id", "similarity")
