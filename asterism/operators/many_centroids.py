"""Nearest of very many centroids in one pass over the vectors.

Centroids are divided into groups around some of them, each with a centre and a radius, and the groups are
stored in files that Spark hands to the executors. A task reads vectors once and goes through the files one
by one: the triangle inequality says which groups can hold the nearest centroid of a vector, and only
those are compared. It holds one file's centroids at a time, however many there are. Products in single precision
with a bound on their error rule out most centroids of a group; what is left is decided in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import as_vector
from ..session import durable
from .blocks import list_matrix
from .kmeans import TIE, nearest, squared_distance

GROUP_VALUES = 1 << 16
FILES = 64  # the centroids are cut into at most this many files while one holds up to FILE_VALUES numbers
FILE_VALUES = 1 << 22
_ROWS = 4096  # vectors looked at together
_SCREEN = 1 << 20  # cells of one product
_SAFE = 1e-9
SINGLE = 2.0**-23  # twice the rounding error of a product in single precision
_GROUP = "file int, first long, centre binary, radius double, ids binary, matrix binary"


def _grouped(centroids: DataFrame, k: int, dim: int, tile_values: int) -> DataFrame:
    """One row per group: its file, lowest cluster, centre, radius, cluster ids (64 bits) and their centroids."""
    group_rows = max(1, min(GROUP_VALUES, tile_values) // dim)
    wanted = max(1, min(-(-k // group_rows), tile_values // dim))
    typed = centroids.select(F.col("cluster").cast("long").alias("cluster"), as_vector(F.col("centroid")).alias("centroid"))
    taken = typed.orderBy(F.xxhash64("cluster"), "cluster").limit(wanted).collect()
    centres = np.array([r.centroid for r in taken])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = list_matrix(b.column("centroid"), dim)
            cell, step = np.zeros(len(x), np.int32), max(1, _SCREEN // len(centres))
            for i in range(0, len(x), step):  # few distances at once, however many centres there are
                d2 = (centres * centres).sum(1)[None, :] - 2.0 * (x[i : i + step] @ centres.T)
                cell[i : i + step] = d2.argmin(1)
            yield b.append_column("cell", pa.array(cell))

    placed = durable(typed.mapInArrow(place, "cluster long, centroid array<double>, cell int"))
    sizes = {r.cell: r.n for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row per centre
    parts, files, load = [], 0, 0
    for cell, n in sorted(sizes.items()):  # crowded cells become several groups, and groups fill files
        count = -(-n // group_rows)
        for part in range(count):
            if load and load + n // count > tile_values // dim:
                files, load = files + 1, 0
            parts.append((cell, part, count, files))
            load += n // count
    table = placed.sparkSession.createDataFrame(parts, "cell int, part int, parts int, file int")
    counts = table.select("cell", "parts").distinct()
    dealt = placed.join(F.broadcast(counts), "cell").withColumn("part", F.pmod(F.xxhash64("cluster"), "parts").cast("int"))

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("cluster")
        x = list_matrix(rows.column("centroid").combine_chunks(), dim)
        ids = rows.column("cluster").to_numpy()
        centre = x.mean(0)
        return pa.table({
            "file": rows.column("file")[:1], "first": rows.column("cluster")[:1],
            "centre": pa.array([centre.tobytes()], pa.binary()),
            "radius": pa.array([float(np.sqrt(squared_distance(x, centre).max()))]),
            "ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()), "matrix": pa.array([x.tobytes()], pa.binary()),
        })

    return (
        dealt.drop("parts").join(F.broadcast(table.select("cell", "part", "file")), ["cell", "part"])
        .groupBy("cell", "part").applyInArrow(pack, _GROUP)
    )


def _files(groups: DataFrame) -> tuple[list[str], list[list[tuple]]]:
    """Names of the files handed to executors, and (first cluster, centre, radius) of the groups in each."""
    spark = groups.sparkSession
    count = groups.agg(F.max("file")).first()[0] + 1
    stored = durable(groups.repartitionByRange(count, "file").sortWithinPartitions("file", "first"))
    rows = stored.select(F.col("_metadata.file_path").alias("path"), "first", "centre", "radius").collect()
    by_path: dict[str, list[tuple]] = {}
    for r in rows:
        by_path.setdefault(r.path, []).append((r.first, np.frombuffer(r.centre), r.radius))
    for path in by_path:
        spark.sparkContext.addFile(path)
    return [p.rsplit("/", 1)[1] for p in by_path], [sorted(g, key=lambda t: t[0]) for g in by_path.values()]


def group_rows(table: pa.Table, g: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of a group of a file."""
    ids = np.frombuffer(table.column("ids")[g].as_buffer(), np.int64)
    return ids, np.frombuffer(table.column("matrix")[g].as_buffer()).reshape(len(ids), -1)


def _nearest_screened(x: np.ndarray, centres: np.ndarray, most: np.ndarray, size: float):
    """(row, centre, distance) for the rows that have a centre within ``most``: the nearest one, the first on ties.

    Ties are those of ``nearest``. No length exceeds ``size``, by which numbers are scaled for single precision.
    """
    unit, step = 1.0 / size, max(1, _SCREEN // len(centres))
    small = np.concatenate([centres * -unit, np.einsum("ij,ij->i", centres, centres)[:, None] * (0.5 * unit * unit)], axis=1)
    small = small.astype(np.float32).T
    margin = (x.shape[1] + 16) * SINGLE + 4.0 * TIE
    own_reach = np.sqrt(np.einsum("ij,ij->i", x, x)) + np.sqrt(np.einsum("ij,ij->i", centres, centres).max())
    found = []
    for start in range(0, len(x), step):
        part = x[start : start + step] * unit
        scores = np.concatenate([part, np.ones((len(part), 1))], axis=1).astype(np.float32) @ small
        least = scores.min(axis=1)
        limit = (most[start : start + step] * unit) ** 2 * 0.5 - 0.5 * np.einsum("ij,ij->i", part, part)
        rows = np.flatnonzero(least <= limit + margin)
        if not len(rows):
            continue
        close = np.flatnonzero(scores[rows] <= (least[rows] + np.float32(2 * margin))[:, None])
        near, at = np.divmod(close, len(centres))
        rows = start + rows
        exact = np.empty(len(near))
        for i in range(0, len(near), 1 << 14):
            cut = slice(i, i + (1 << 14))
            exact[cut] = np.sqrt(squared_distance(x[rows[near[cut]]], centres[at[cut]]))
        begins = np.searchsorted(near, np.arange(len(rows)))
        shortest = np.minimum.reduceat(exact, begins)
        tied = np.flatnonzero(exact <= (shortest + TIE * own_reach[rows])[near])
        first = tied[np.searchsorted(near[tied], np.arange(len(rows)))]
        found.append((rows, at[first], exact[first]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*found))


class _Search:
    """Nearest centroids of a block of vectors, file by file."""

    def __init__(self, names: list[str], groups: list[list[tuple]]):
        self.names = names
        self.starts = np.cumsum([0, *map(len, groups)])
        flat = [g for part in groups for g in part]
        self.centres = np.array([g[1] for g in flat])
        self.radius = np.array([g[2] for g in flat])
        self.longest = float(np.sqrt((self.centres**2).sum(1)).max(initial=0) + self.radius.max(initial=0))
        self.compared = 0

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cluster, best = np.full(len(x), -1, np.int64), np.full(len(x), np.inf)
        reach = np.sqrt((x * x).sum(1)) + self.longest
        slack = _SAFE * 16 * reach + TIE * reach
        c2 = (self.centres**2).sum(1)
        away = np.sqrt(np.maximum((x * x).sum(1)[:, None] + c2[None, :] - 2.0 * (x @ self.centres.T), 0))
        away_error = 1e-7 * reach  # of a distance from the product
        size = float(reach.max(initial=0))
        plain = not 1e-150 < size < 1e150  # also without a number
        low = away - self.radius[None, :] - away_error[:, None]
        high = (away + self.radius[None, :]).min(1) + away_error
        for f, name in enumerate(self.names):
            own = slice(self.starts[f], self.starts[f + 1])
            wanted = low[:, own] <= (np.minimum(high, best) + slack)[:, None]
            if not wanted.any():
                continue
            table = pq.read_table(SparkFiles.get(name), columns=["first", "ids", "matrix"]).sort_by("first")
            for g in np.flatnonzero(wanted.any(0)):
                rows = np.flatnonzero(wanted[:, g] & (low[:, self.starts[f] + g] <= best + slack))
                if not len(rows):
                    continue
                ids, matrix = group_rows(table, int(g))
                self.compared += len(rows) * len(ids)
                if plain:
                    at = nearest(x[rows], matrix)
                    diff = x[rows] - matrix[at]
                    d = np.sqrt(np.einsum("ij,ij->i", diff, diff))
                else:
                    close, at, d = _nearest_screened(x[rows], matrix, best[rows] + slack[rows], size)
                    rows = rows[close]
                tied = np.abs(d - best[rows]) <= TIE * reach[rows]
                nearer = (d < best[rows]) & ~tied
                cluster[rows] = np.where(
                    nearer, ids[at], np.where(tied, np.minimum(cluster[rows], ids[at]), cluster[rows])
                )
                best[rows] = np.minimum(best[rows], d)
        return cluster, best * best


def nearest_of_many(vectors: DataFrame, centroids: DataFrame, k: int, dim: int, tile_values: int) -> DataFrame:
    """``vectors`` plus (cluster, d2): the closest of (cluster, centroid); low ids win ties."""
    tile_values = max(tile_values, min(FILE_VALUES, -(-k * dim // FILES)))  # very many small files cost more than they spare
    typed = centroids.select(F.col("cluster").cast("int").alias("cluster"), "centroid")
    names, groups = _files(_grouped(typed, k, dim, tile_values))

    @F.arrow_udf("struct<cluster: int, d2: double>")
    def assign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        search = _Search(names, groups)
        for features in batches:
            x = list_matrix(features, dim) if len(features) else np.zeros((0, dim))
            found = [search(x[i : i + _ROWS]) for i in range(0, len(x), _ROWS)] or [(np.zeros(0), np.zeros(0))]
            cluster, d2 = (np.concatenate(part) for part in zip(*found))
            yield pa.StructArray.from_arrays([pa.array(np.maximum(cluster, -(2**31)).astype(np.int32)), pa.array(d2)], names=["cluster", "d2"])

    near = F.col("_near")
    return (
        vectors.withColumn("_near", assign.asNondeterministic()(as_vector(F.col("features"))))
        .withColumns({"cluster": near["cluster"], "d2": near["d2"]}).drop("_near")
    )
