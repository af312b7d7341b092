"""Most similar vectors by cosine: exact top k for a table of probes.

A side of at most _HELD_VALUES numbers is held by every task of the other one. Beyond that, unit vectors
are divided into Voronoi cells around some of the rows. The rows lie in files that Spark hands to the executors, cell by
cell, and probes in order of their cells go through the files: the radius of a cell says how similar any of its rows can be
to a probe, whose own cell comes first. No vector is shuffled more than a fixed number of times, however many cells
a probe meets. A large table that meets itself goes through blocks of cells in pairs (``similar_pairs``), each for both its sides.

Rows of more than _HANDED_VALUES numbers are not copied to every executor: a probe first meets rows of its own cell, which
gives a similarity that k rows reach, and is then copied only to cells whose spread of angles can still reach it.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .blocks import list_matrix
from .many_centroids import FILE_VALUES, SINGLE, _files, _grouped, group_rows
from .similar_pairs import ANGLE, DIGITS, SLACK, among_themselves, first_k, possible, unit_rows

_HELD_VALUES = 1 << 22  # of the smaller side, held by every task
_HANDED_VALUES = 1 << 31  # of all rows, in files on every executor
_FEW_ROWS = 1 << 16  # of a table met with itself; fewer go through the files probe by probe, as rounds have a fixed cost
_SCREEN = 1 << 20  # cells of one product in single precision
_GROUP_VALUES = 1 << 22  # of either side in one group of the join
_MOST_CELLS = 4096
_PROBES = 4096  # that go through the files together
_CELLS = 1 << 21  # similarities computed at once

_FOUND = "probe_id long, id long, similarity double"


def _search(
    probes: np.ndarray,
    batches: Iterable[tuple[np.ndarray, np.ndarray]],
    k: int,
    own: np.ndarray | None = None,
    floor: np.ndarray | None = None,
):
    """(place of the probe, id, similarity) of the k best rows per probe over all batches of (ids, rows).

    Rows with the id ``own`` of a probe are left out; ``floor`` gives similarities that rows must reach. Only
    rows that reach a probe's current k-th best are looked at again, and a product never has more than
    _CELLS cells, so memory stays bounded by the probes.
    """
    who, found, sims = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    floor = np.full(len(probes), -np.inf) if floor is None else floor.copy()
    step = max(1, _CELLS // max(1, len(probes)))
    for ids, rows in batches:
        for start in range(0, len(ids), step):
            part = ids[start : start + step]
            sim = np.round(probes @ unit_rows(rows[start : start + step]).T, DIGITS) + 0.0
            good = sim >= floor[:, None]
            if own is not None:
                good &= own[:, None] != part[None, :]
            p, r = np.nonzero(good)
            who, found, sims = first_k(
                np.concatenate([who, p]), np.concatenate([found, part[r]]), np.concatenate([sims, sim[p, r]]), k
            )
            full = np.flatnonzero(np.bincount(who, minlength=len(floor)) == k)
            floor[full] = sims[np.searchsorted(who, full, side="right") - 1]
    return who, found, sims


def _batch(probe_ids, ids, value) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(probe_ids), pa.array(ids), pa.array(value)],
        names=["probe_id", "id", "similarity"],
    )


def _typed(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("features"))


def topk_similar(
    vectors: DataFrame, probes: DataFrame, k: int = 5, skip_self: bool = True, held_values: int | None = None
) -> DataFrame:
    """(probe_id, rank, id, similarity): for each of ``probes`` the k most similar ``vectors``.

    Both frames are (id, features). Similarity is the cosine rounded to 6 decimals (0 for a zero
    vector); ties go to the lower id. Ids of ``vectors`` tell vectors apart: one id has one vector. Every
    task keeps only its own k best per probe before anything is shuffled. A side is held by all tasks
    only after a check of its size.
    """
    held_values = _HELD_VALUES if held_values is None else held_values
    left = durable(_typed(probes))  # both sides are read several times
    right = left if vectors is probes else durable(_typed(vectors))
    size = F.count("*"), F.coalesce(F.max(F.size("features")), F.lit(0))
    n_probes, dim = left.agg(*size).first()
    if n_probes * dim <= held_values:
        found = _by_held_probes(left, right, k, skip_self)
    else:
        n_rows, _ = right.agg(*size).first()
        if n_rows * dim <= held_values:
            found = _by_held_rows(left, right, k, skip_self)
        elif n_rows * dim <= _HANDED_VALUES:
            found = _by_blocks(left, dim, k, skip_self) if left is right and n_rows > _FEW_ROWS else None
            if found is None:
                found = _by_files(left, right, dim, n_probes, k, skip_self)
        else:
            asks, rows, alone = cell_plan(left, right, dim, n_rows, k, skip_self)
            found = _join_cells(asks, rows, k, skip_self).union(alone)
    best = Window.partitionBy("probe_id").orderBy(F.col("similarity").desc(), F.col("id"))
    return (
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("probe_id", "rank", "id", "similarity")
    )


def _held(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = df.toArrow()
    x = list_matrix(table.column("features").combine_chunks()) if len(table) else np.zeros((0, 0))
    return table.column("id").to_numpy(), x


def _by_held_probes(left: DataFrame, right: DataFrame, k: int, skip_self: bool) -> DataFrame:
    probe_ids, matrix = _held(left)
    matrix = unit_rows(matrix)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if len(probe_ids):
            rows = ((b.column(0).to_numpy(), list_matrix(b.column(1))) for b in batches if len(b))
            who, found, sims = _search(matrix, rows, k, probe_ids if skip_self else None)
            yield _batch(probe_ids[who], found, sims)

    return right.mapInArrow(search, _FOUND)


def _by_held_rows(left: DataFrame, right: DataFrame, k: int, skip_self: bool) -> DataFrame:
    ids, matrix = _held(right)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b) and len(ids):
                own = b.column(0).to_numpy()
                probes = unit_rows(list_matrix(b.column(1)))
                who, found, sims = _search(probes, [(ids, matrix)], k, own if skip_self else None)
                yield _batch(own[who], found, sims)

    return left.mapInArrow(search, _FOUND)


# ---- two large sides -------------------------------------------------------------------------------


def _lowest_of_equal(rows: DataFrame, k: int, skip_self: bool) -> DataFrame:
    """Of equal vectors the rows with the lowest ids: no others can be among the k best."""
    by_id = Window.partitionBy("features").orderBy("id")
    again = Window.partitionBy("features", "id").orderBy("id")
    return (
        rows.withColumn("_place", F.dense_rank().over(by_id)).filter(F.col("_place") <= k + int(skip_self))
        .withColumn("_copy", F.row_number().over(again)).filter(F.col("_copy") <= k)
        .select("id", "features")
    )


def _for_zero_probes(rows: DataFrame, k: int, skip_self: bool):
    """What zero vectors find: one is as similar to any row as to the others."""
    need = 2 * k if skip_self else k  # a row is there k times at most, also the probe's own
    lowest = [r.id for r in rows.select("id").orderBy("id").limit(k * need).collect()]

    def alone(probes: Iterable[int]) -> Iterator[pa.RecordBatch]:
        for probe in probes:
            ids = [i for i in lowest if not (skip_self and i == probe)][:k]
            yield _batch(np.full(len(ids), probe), np.array(ids, np.int64), np.zeros(len(ids)))

    return alone


class _FileSearch:
    """The k best rows of a block of probes, file by file."""

    def __init__(self, names: list[str], groups: list[list[tuple]], k: int, skip_self: bool):
        self.names, self.k, self.skip_self = names, k, skip_self
        self.starts = np.cumsum([0, *map(len, groups)])
        flat = [g for part in groups for g in part]
        self.centres, self.radius = np.array([g[1] for g in flat]), np.array([g[2] for g in flat])
        self.compared = 0

    def __call__(self, unit: np.ndarray, own: np.ndarray):
        """(place of the probe, id, similarity) of the k best rows of unit vectors."""
        k, n = self.k, len(unit)
        most = possible(unit, self.centres, self.radius)
        floor = np.full(n, -np.inf)
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        small = unit.astype(np.float32)
        slack = (unit.shape[1] + 16) * SINGLE + 0.5 * 10.0**-DIGITS
        likely = [most[:, a:b].max(1).mean() for a, b in zip(self.starts, self.starts[1:])]
        for f in np.argsort(-np.array(likely), kind="stable"):
            first, stop = self.starts[f], self.starts[f + 1]
            if not (most[:, first:stop] >= floor[:, None]).any():
                continue
            table = pq.read_table(SparkFiles.get(self.names[f]), columns=["first", "ids", "matrix"]).sort_by("first")
            for g in first + np.argsort(-most[:, first:stop].sum(0), kind="stable"):
                who = np.flatnonzero(most[:, g] >= floor)
                if not len(who):
                    continue
                ids, matrix = group_rows(table, int(g - first))
                self.compared += len(who) * len(ids)
                turned = matrix.astype(np.float32).T
                step = max(1, _SCREEN // len(ids))
                for start in range(0, len(who), step):
                    part = who[start : start + step]
                    scores = small[part] @ turned
                    least = floor[part] - slack
                    new = np.flatnonzero(np.isneginf(least))
                    if len(new):  # k rows of this group are a first bound
                        if self.skip_self:
                            scores[new] = np.where(own[part[new]][:, None] == ids[None, :], -np.inf, scores[new])
                        if len(ids) > k:
                            least[new] = np.partition(scores[new], len(ids) - k, axis=1)[:, len(ids) - k] - 2 * slack
                    p, r = np.divmod(np.flatnonzero(scores >= least.astype(np.float32)[:, None]), len(ids))
                    p = part[p]
                    if self.skip_self:
                        other = own[p] != ids[r]
                        p, r = p[other], r[other]
                    if not len(p):
                        continue
                    sims = np.empty(len(p))
                    for i in range(0, len(p), 1 << 14):
                        at = slice(i, i + (1 << 14))
                        sims[at] = np.einsum("ij,ij->i", unit[p[at]], matrix[r[at]])
                    sims = np.round(sims, DIGITS) + 0.0
                    good = sims >= floor[p]
                    p, r, sims = p[good], r[good], sims[good]
                    if not len(p):
                        continue
                    met = np.zeros(n, bool)
                    met[p] = True
                    old = met[best[0]]
                    top = first_k(
                        np.concatenate([best[0][old], p]), np.concatenate([best[1][old], ids[r]]),
                        np.concatenate([best[2][old], sims]), k,
                    )
                    full = np.flatnonzero(np.bincount(top[0], minlength=n) == k)
                    floor[full] = top[2][np.searchsorted(top[0], full, side="right") - 1]
                    best = tuple(np.concatenate([b[~old], t]) for b, t in zip(best, top))
        return best


def _by_blocks(rows: DataFrame, dim: int, k: int, skip_self: bool) -> DataFrame | None:
    """A table with itself; None where an id has several vectors."""
    found = among_themselves(rows, dim, k, skip_self, min(FILE_VALUES, _GROUP_VALUES))
    if found is None:
        return None
    alone = _for_zero_probes(rows, k, skip_self)

    def zero(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from alone(b.column("id").to_pylist())

    without = rows.filter(~F.exists("features", lambda x: x != 0))
    return found.union(without.select("id").mapInArrow(zero, _FOUND))


def _by_files(left: DataFrame, right: DataFrame, dim: int, n_probes: int, k: int, skip_self: bool) -> DataFrame:
    """Probes in order of their cells against rows in files, both sides in cells around some of the rows."""

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = unit_rows(list_matrix(b.column("features"), dim))
                ends = pa.array(np.arange(0, (len(x) + 1) * dim, dim, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=["cluster", "centroid"]
                )

    rows = durable(_lowest_of_equal(right, k, skip_self).mapInArrow(units, "cluster long, centroid array<double>"))
    alone = _for_zero_probes(right, k, skip_self)
    n_rows = rows.count()
    if not n_rows:
        return left.limit(0).select(F.col("id").alias("probe_id"), "id", F.lit(0.0).alias("similarity"))
    names, groups = _files(_grouped(rows, n_rows, dim, min(FILE_VALUES, _GROUP_VALUES)))
    pivots = np.array([g[1] for part in groups for g in part])
    cores = left.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(8 * cores, -(-n_probes // _PROBES)))
    ordered = _in_cells(left, pivots).repartitionByRange(parts, "cell", "id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _FileSearch(names, groups, k, skip_self)
        for b in batches:
            own, zero = b.column("id").to_numpy(), b.column("cell").to_numpy() < 0
            yield from alone(own[zero].tolist())
            own = own[~zero]
            unit = unit_rows(list_matrix(b.column("features"), dim))[~zero] if len(b) else np.zeros((0, dim))
            for i in range(0, len(unit), _PROBES):
                who, found, sims = find(unit[i : i + _PROBES], own[i : i + _PROBES])
                yield _batch(own[i : i + _PROBES][who], found, sims)

    return ordered.mapInArrow(search, _FOUND)

def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))


def _in_cells(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, features, cell, angle): the nearest pivot and the angle to it; zero vectors have cell -1."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = list_matrix(b.column("features"), pivots.shape[1])
            cell, angle = np.zeros(len(x), np.int32), np.zeros(len(x))
            step = max(1, _CELLS // len(pivots))
            for i in range(0, len(x), step):
                at = slice(i, i + step)
                angles = _angles(unit_rows(x[at]), pivots)
                cell[at] = angles.argmin(1)
                angle[at] = angles.min(1)
            zero = ~x.any(1)
            cell[zero], angle[zero] = -1, 0.0
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("features"), pa.array(cell), pa.array(angle)],
                names=["id", "features", "cell", "angle"],
            )

    return df.mapInArrow(place, "id long, features array<double>, cell int, angle double")


def _every(count: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), count - 1))


def _dealt(column: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(column), parts)


def _wanted_cells(unit: np.ndarray, reach: np.ndarray, pivots: np.ndarray, cells: list[tuple], need: int):
    """(probe, cell) pairs of the cells that can hold one of the k best of a probe.

    ``cells`` are (cell, rows, least angle, largest angle); ``reach`` is a similarity that k rows of a
    probe are known to have, and the cells' largest angles give another one.
    """
    number, n, least, most = (np.array(c) for c in zip(*cells))
    known = number >= 0
    angle = np.where(known[None, :], _angles(unit, pivots)[:, number], np.pi / 2)
    sure = np.where(known, np.cos(np.minimum(angle + most + ANGLE, np.pi)), 0.0)
    order = np.argsort(-sure, axis=1)
    enough = (np.cumsum(n[order], axis=1) >= need).argmax(1)
    at = np.arange(len(unit))
    by_cells = np.where(n.sum() >= need, sure[at, order[at, enough]], -np.inf)
    possible = np.cos(np.maximum(np.maximum(angle - most, least - angle) - ANGLE, 0))
    possible = np.where(known[None, :], possible, 0.0)
    who, where = np.nonzero(possible >= np.maximum(reach, by_cells)[:, None] - SLACK)
    return who, number[where]


def cell_plan(
    left: DataFrame, right: DataFrame, dim: int, n_rows: int, k: int, skip_self: bool
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(probes copied to groups, rows copied to groups, what zero probes find).

    A group is (cell, part of its rows, block of the probes that want the cell); both sides of a group are
    bounded, however many rows or probes a cell has. Of equal vectors only the lowest ids take part.
    """
    spark, need = right.sparkSession, 2 * k if skip_self else k  # a row is there k times at most, also the probe's own
    most_rows = max(1, _GROUP_VALUES // max(1, dim))
    few = _lowest_of_equal(right, k, skip_self)
    wanted = max(1, min(_MOST_CELLS, most_rows, math.isqrt(n_rows)))
    taken = few.filter(F.exists("features", lambda x: x != 0)).orderBy(F.xxhash64("id", F.lit(7)), "id").limit(wanted)
    pivots = unit_rows(np.array([r.features for r in taken.collect()] or [[1.0] + [0.0] * (dim - 1)]))
    pivots = np.unique(pivots, axis=0)
    rows, asks = durable(_in_cells(few, pivots)), durable(_in_cells(left, pivots))

    cells = [
        (r.cell, r.n, r.least, r.most)
        for r in rows.groupBy("cell").agg(
            F.count("*").alias("n"), F.min("angle").alias("least"), F.max("angle").alias("most")
        ).orderBy("cell").collect()  # one row per pivot
    ]
    askers = {r.cell: r.n for r in asks.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    parts = {cell: -(-n // most_rows) for cell, n, *_ in cells}
    turns = {cell: max(p, -(-askers.get(cell, 0) // most_rows)) for cell, p in parts.items()}
    table = spark.createDataFrame([(c, p, turns[c]) for c, p in parts.items()], "cell int, parts long, turns long")

    # Every probe meets one part of its own cell; a part is met in several turns where probes are many.
    own = asks.filter("cell >= 0").join(F.broadcast(table), "cell").select(
        "cell", _dealt("id", F.col("turns")).alias("turn"), F.col("id").alias("probe_id"), "features"
    )
    part = _dealt("id", F.col("parts"))
    met = rows.filter("cell >= 0").join(F.broadcast(table), "cell").select(
        "cell", "id", "features", F.explode(F.sequence(part, F.col("turns") - 1, F.col("parts"))).alias("turn")
    )

    def first(ask: pa.Table, have: pa.Table) -> pa.Table:
        out = []
        ids = ask.column("probe_id").to_numpy()
        q = unit_rows(list_matrix(ask.column("features").combine_chunks(), dim)) if len(ids) else np.zeros((0, dim))
        reach = np.full(len(q), -np.inf)
        if len(ids) and len(have):
            x = list_matrix(have.column("features").combine_chunks(), dim)
            who, _, sims = _search(q, [(have.column("id").to_numpy(), x)], k, ids if skip_self else None)
            full = np.flatnonzero(np.bincount(who, minlength=len(q)) == k)
            reach[full] = sims[np.searchsorted(who, full, side="right") - 1]
        step = max(1, _CELLS // len(pivots))
        for i in range(0, len(q), step):
            who, cell = _wanted_cells(q[i : i + step], reach[i : i + step], pivots, cells, need)
            counts = np.bincount(who, minlength=len(q[i : i + step]))
            ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            out.append(pa.ListArray.from_arrays(ends, pa.array(cell.astype(np.int32))))
        wants = pa.chunked_array(out, pa.list_(pa.int32()))
        return ask.select(["probe_id", "features"]).append_column("reach", pa.array(reach)).append_column("wants", wants)

    asked = durable(
        own.groupBy("cell", "turn").cogroup(met.groupBy("cell", "turn"))
        .applyInArrow(first, "probe_id long, features array<double>, reach double, wants array<int>")
    )
    visits = asked.select("probe_id", "features", "reach", F.explode("wants").alias("cell"))
    crowd = {r.cell: r.n for r in visits.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    blocks = {c: max(1, -(-crowd.get(c, 0) // most_rows)) for c in parts}
    table = spark.createDataFrame([(c, p, blocks[c]) for c, p in parts.items()], "cell int, parts long, blocks long")
    probe_copies = visits.join(F.broadcast(table), "cell").select(
        "cell", _every(F.col("parts")).alias("part"), _dealt("probe_id", F.col("blocks")).alias("block"),
        "probe_id", "features", "reach",
    )
    row_copies = rows.join(F.broadcast(table), "cell").select(
        "cell", part.alias("part"), _every(F.col("blocks")).alias("block"), "id", "features"
    )

    zero = _for_zero_probes(right, k, skip_self)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from zero(b.column("id").to_pylist())

    return probe_copies, row_copies, asks.filter("cell < 0").mapInArrow(alone, _FOUND)


def _join_cells(asks: DataFrame, rows: DataFrame, k: int, skip_self: bool) -> DataFrame:
    def search(ask: pa.Table, have: pa.Table) -> pa.Table:
        if not len(ask) or not len(have):
            none = np.zeros(0, np.int64)
            return pa.Table.from_batches([_batch(none, none, np.zeros(0))])
        q, x = (list_matrix(t.column("features").combine_chunks()) for t in (ask, have))
        ids, floor = ask.column("probe_id").to_numpy(), ask.column("reach").to_numpy() - SLACK
        who, found, sims = _search(
            unit_rows(q), [(have.column("id").to_numpy(), x)], k, ids if skip_self else None, floor
        )
        return pa.Table.from_batches([_batch(ids[who], found, sims)])

    key = ["cell", "part", "block"]
    return asks.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(search, _FOUND)
