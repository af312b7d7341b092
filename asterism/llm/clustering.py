"""Centroid clustering of whole-number vectors by exact rounds, with lower bounds loosened by geometry.

A row keeps its cluster, an upper bound of the distance to its own centroid and a lower bound of the distance
to every other one. After a round all rows of cluster i lie in a sphere around its centroid. When centroid j
moves by s from c to c', with middle m, a row x comes nearer to it by

    |x - c| - |x - c'| = 2 s (x - m).e / (|x - c| + |x - c'|) <= s cos(angle of x - m and e),

e the direction of the move, since the two distances add up to 2 |x - m| or more. In the plane of e and the centre of
the sphere, the least angle of any point of the sphere is that of its centre less asin(radius / |centre - m|), so
the lower bounds of cluster i are loosened by s times its cosine (by 0 behind the middle), in place of s. Only
rows whose bounds overlap get the exact distance to their own centroid, and only those still
ambiguous are compared with all centroids, in whole numbers, so that ties go to the smaller cluster.

Rows and their bounds are stored after every round; sums of rows are added up per task and then by (cluster,
component), and only k * d of them reach the driver.

Defined cases: vectors that are null, hold null or non-finite entries or do not have ``dim`` of them take no
part; an empty table gives no rows; fewer vectors than k give as many centroids; a row without an id is
clustered but starts a centroid only when too few others are there; repeated rows are rows of their own, and of rows
with one id the smaller vector comes first among the starting centroids. Arithmetic is exact for any long;
squared distances and inertias above 2^63 - 1 are reported as that number. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE = 64
CLUSTERS = 16
ROUNDS = 3
DIM = 64
_SAFE = 1e-9  # relative allowance for rounding in bounds; distances themselves are exact
_MOST = 2**63 - 1
_COARSE = 2.0**40  # above this, doubles are too coarse for bounds and every row is compared
_STATE = "vec_id long, v array<bigint>, cluster int, upper double, lower double"


@dataclass
class Clustering:
    rows: DataFrame  # vec_id, v, cluster, distance (squared)
    centroids: list[list[int]]
    inertias: list[int]  # of each cluster
    compared: list[int]  # rows compared with all centroids in each assignment


def whole_rows(df: DataFrame, dim: int, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): components floor(scale * x) of vectors with ``dim`` finite components."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(v.isNotNull() & (F.size(v) == dim) & fine).select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"),
    )


def _largest(*arrays: np.ndarray) -> float:
    return max(float(np.abs(a.astype(float)).max(initial=0.0)) for a in arrays)


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """n x k exact squared distances of whole numbers: int64, or Python integers where those do not do."""
    most = x.shape[1] * 4.0 * _largest(x, centres) ** 2
    if most < 2.0**52:
        a, b = x.astype(float), centres.astype(float)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)).astype(np.int64)
    if most >= 2.0**62:
        x, centres = x.astype(object), centres.astype(object)
    return np.stack([((x - c) ** 2).sum(1) for c in centres], axis=1)


def loosened(centres: np.ndarray, moved: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """k x k: by how much a row of cluster i, inside its sphere, can come nearer to centroid j at most."""
    move = moved - centres
    drift = np.sqrt((move * move).sum(1))
    e = move / np.where(drift == 0, 1, drift)[:, None]
    w = centres[:, None, :] - ((centres + moved) / 2)[None, :, :]
    along = (w * e[None, :, :]).sum(2)
    off = np.sqrt((w * w).sum(2))
    centre_angle = np.arctan2(np.sqrt(np.maximum(off * off - along * along, 0)), along)
    spread = np.arcsin(np.minimum(radius[:, None] * (1 + _SAFE) / np.where(off == 0, 1, off), 1))
    angle = np.where(radius[:, None] >= off, 0.0, np.maximum(centre_angle - spread, 0))
    tight = drift[None, :] * np.minimum(np.maximum(np.cos(angle), 0) + _SAFE, 1)
    return np.where(drift[None, :] == 0, 0.0, tight)


def _long_matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _compare(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, distance to it, distance to the next one)."""
    d2 = squared(x, centres)
    own = d2.argmin(1).astype(np.int32) if len(x) else np.zeros(0, np.int32)
    d = np.sqrt(d2.astype(float))
    at = np.arange(len(x))
    upper = d[at, own].copy()
    d[at, own] = np.inf
    return own, upper, d.min(1, initial=np.inf)


def _state(ids: pa.Array, v: pa.Array, own, upper, lower) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [ids, v, pa.array(own.astype(np.int32)), pa.array(upper), pa.array(lower)],
        names=["vec_id", "v", "cluster", "upper", "lower"],
    )


def _first(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    dim = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, upper, lower = _compare(_long_matrix(b.column("v"), dim), centres)
            yield _state(b.column("vec_id"), b.column("v"), own, upper, lower)

    return stored(rows.mapInArrow(run, _STATE))


def _next(state: DataFrame, centres: np.ndarray, moved: np.ndarray, radius: np.ndarray) -> tuple[DataFrame, int]:
    """The state after the centroids have moved, and how many rows were compared with all of them."""
    dim = centres.shape[1]
    if _largest(centres, moved) + radius.max(initial=0) < _COARSE:
        by = loosened(centres.astype(float), moved.astype(float), radius)
        np.fill_diagonal(by, 0.0)
        loose = by.max(1)
        drift = np.sqrt(((moved - centres).astype(float) ** 2).sum(1))
    else:
        loose, drift = np.full(len(centres), np.inf), np.zeros(len(centres))

    def ambiguous(upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        return ~(upper * (1 + _SAFE) + _SAFE < lower)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _long_matrix(b.column("v"), dim)
            own = b.column("cluster").to_numpy().copy()
            upper = b.column("upper").to_numpy() + drift[own]
            lower = b.column("lower").to_numpy() - loose[own]
            open_ = np.flatnonzero(ambiguous(upper, lower))
            for j in np.unique(own[open_]):
                mine = open_[own[open_] == j]
                upper[mine] = np.sqrt(squared(x[mine], moved[j : j + 1])[:, 0].astype(float))
            open_ = open_[ambiguous(upper[open_], lower[open_])]
            own[open_], upper[open_], lower[open_] = _compare(x[open_], moved)
            hit = np.zeros(len(x), bool)
            hit[open_] = True
            yield _state(b.column("vec_id"), b.column("v"), own, upper, lower).append_column("compared", pa.array(hit))

    found = stored(state.mapInArrow(run, _STATE + ", compared boolean"))
    return found.drop("compared"), found.filter("compared").count()


def _sums(state: DataFrame, k: int, dim: int) -> tuple[list[list[int]], list[int], np.ndarray]:
    """(sums, counts, radius) of the clusters; added up per task, then by (cluster, component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, far = np.zeros((k, dim), object), [0] * k, np.zeros(k)
        for b in batches:
            x, own = _long_matrix(b.column("v"), dim), b.column("cluster").to_numpy()
            np.maximum.at(far, own, b.column("upper").to_numpy())
            for j in np.unique(own):
                mine = x[own == j]  # halves, so that no sum leaves int64
                sums[j] += (mine >> 32).sum(0).astype(object) * 2**32 + (mine & (2**32 - 1)).sum(0).astype(object)
                counts[j] += len(mine)
        for j in range(k):
            if counts[j]:
                total = [Decimal(int(s)) for s in (*sums[j], counts[j])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([j] * (dim + 1), pa.int32()), pa.array(range(dim + 1), pa.int32()),
                        pa.array(total, pa.decimal128(38, 0)), pa.array([far[j]] * (dim + 1)),
                    ],
                    names=["cluster", "at", "total", "far"],
                )

    parts = state.select("v", "cluster", "upper").mapInArrow(run, "cluster int, at int, total decimal(38,0), far double")
    sums, counts, radius = [[0] * dim for _ in range(k)], [0] * k, np.zeros(k)
    for r in parts.groupBy("cluster", "at").agg(F.sum("total").alias("total"), F.max("far").alias("far")).collect():
        radius[r.cluster] = r.far
        if r["at"] == dim:
            counts[r.cluster] = int(r.total)
        else:
            sums[r.cluster][r["at"]] = int(r.total)
    return sums, counts, radius


def _distances(state: DataFrame, centres: np.ndarray) -> DataFrame:
    """(vec_id, v, cluster, distance): exact squared distances to the own centroid."""
    dim = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, own = _long_matrix(b.column("v"), dim), b.column("cluster").to_numpy()
            d2 = np.zeros(len(x), np.int64)
            for j in np.unique(own):
                found = squared(x[own == j], centres[j : j + 1])[:, 0]
                d2[own == j] = np.minimum(found, _MOST).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("v"), b.column("cluster"), pa.array(d2)],
                names=["vec_id", "v", "cluster", "distance"],
            )

    return state.mapInArrow(run, "vec_id long, v array<bigint>, cluster int, distance long")


def cluster_rows(rows: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 1) -> Clustering:
    """``rounds`` rounds of k-means over (vec_id, v), all of one length, and a last assignment.

    The first centroids are the rows with the smallest SHA-256 of "<seed>:<vec_id>".
    """
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = rows.select(draw.alias("draw"), "v").orderBy(F.col("draw").asc_nulls_last(), "v").limit(k).collect()
    if not starts:
        empty = rows.sparkSession.createDataFrame([], "vec_id long, v array<bigint>, cluster int, distance long")
        return Clustering(empty, [], [], [])
    centres = np.array([r.v for r in starts], np.int64)
    state, compared = _first(rows, centres), []
    for _ in range(rounds):
        sums, counts, radius = _sums(state, *centres.shape)
        moved = np.array(
            [[s // n for s in total] if n else old.tolist() for total, n, old in zip(sums, counts, centres)], np.int64
        )
        state, n = _next(state, centres, moved, radius)
        compared.append(n)
        centres = moved
    result = _distances(state, centres)
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertias = [0] * len(centres)
    for r in result.groupBy("cluster").agg(total.alias("total")).collect():
        inertias[r.cluster] = int(r.total)
    return Clustering(result, centres.tolist(), inertias, compared)
