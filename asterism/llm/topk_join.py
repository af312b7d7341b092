"""Exact search for the k rows with the largest inner product, as a Voronoi join.

Some rows are taken as pivots; every row belongs to the cell of its nearest pivot. A query's score
with each pivot gives a score that k rows are known to reach, and the distance bound of a cell,
``q.x <= q.p + |q| d(x, p)``, then says how far from its pivot a row must be to matter to any query of a
group. Neighbouring cells share a block; a crowded cell has several, dealt by hashed id, so that neither it nor
many copies of a vector fall to one task. Only such rows are sent to a group, and a query only to the blocks of
cells that matter to it. Blocks are solved locally and keep only scores that can still win.

Defined cases: vectors that are null or hold null or non-finite components take no part; shorter
vectors count as padded with zeros; a row repeated in full counts once; rows with the query's own
id are not its candidates; other columns are not read. Scores are exact and ranked as such for any
components of 64 bits; one that does not fit in a long is returned as the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SCALE = 64
PIVOTS = 256
QUERIES_PER_GROUP = 4096
ROWS_PER_BLOCK = 16384
_CHUNK = 64
_SAFE = 1e-9  # relative allowance for rounding in bounds; scores themselves are exact


def whole_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, v): components floor(scale * x), only of vectors without null or non-finite components."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        df.filter(v.isNotNull() & fine & F.col(vec_id).isNotNull())
        .select(F.col(vec_id).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"))
        .dropDuplicates(["id", "v"])
    )


def whole_matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as rows of int64, padded with zeros to ``dim``."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dim).all():
        return values.reshape(-1, dim)
    out = np.zeros((len(lengths), dim), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers: int64, or Python integers where those do not do."""
    most = (max(float(np.abs(x.astype(float)).max(initial=0)), 1.0) for x in (a, b))
    bound = next(most) * next(most) * max(a.shape[1], 1)
    if bound < 2.0**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if bound < 2.0**62:
        return a @ b.T
    return a.astype(object) @ b.T.astype(object)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d2 = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(d2, 0))


def _celled(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, v, cell, far): the nearest pivot and the distance to it."""
    dim = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole_matrix(batch.column("v"), dim).astype(float)
            d = _distances(x, pivots.astype(float))
            cell = d.argmin(1)
            yield batch.append_column("cell", pa.array(cell.astype(np.int32))).append_column(
                "far", pa.array(np.linalg.norm(x - pivots[cell], axis=1))
            )

    return rows.mapInArrow(run, "id long, v array<bigint>, cell int, far double")


def _bounded(
    queries: DataFrame, pivots: np.ndarray, pivot_ids: np.ndarray, radius: np.ndarray, k: int, blocks: dict[int, tuple[int, int]]
) -> DataFrame:
    """Queries with ``reach``, a score that k rows have, the distance from which rows of each cell matter, and the
    blocks of these cells."""
    dim = pivots.shape[1]
    first, parts = np.zeros((2, len(pivots)), np.int64)
    for cell, (at, n) in blocks.items():
        first[cell], parts[cell] = at, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = whole_matrix(batch.column("v"), dim)
            at_pivot = products(q, pivots).astype(np.float64)
            others = np.where(batch.column("id").to_numpy()[:, None] == pivot_ids[None, :], -np.inf, at_pivot)
            reach = np.full(len(q), -np.inf)
            if len(pivots) >= k:
                reach = np.partition(others, len(pivots) - k, axis=1)[:, len(pivots) - k]
            reach = reach - _SAFE * np.where(np.isfinite(reach), np.abs(reach), 0)  # rounded scores of pivots
            norm = np.linalg.norm(q.astype(float), axis=1)
            allowance = _SAFE * (1 + np.abs(at_pivot) + norm[:, None] * radius[None, :])
            with np.errstate(divide="ignore", invalid="ignore"):
                least = (reach[:, None] - at_pivot - allowance) / norm[:, None]
            # a zero query has the score 0 with every row: all rows matter to it
            least = np.where(norm[:, None] == 0, -np.inf, least)
            rows, cells = np.nonzero(least <= radius[None, :] * (1 + _SAFE) + _SAFE)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(q)))]).astype(np.int32)),
                pa.StructArray.from_arrays(
                    [pa.array(cells.astype(np.int32)), pa.array(least[rows, cells])], ["cell", "least"]
                ),
            )
            n = parts[cells]
            block = np.repeat(first[cells] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            pairs = np.unique(np.stack([np.repeat(rows, n), block]), axis=1)  # a block may hold several cells
            met = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(np.bincount(pairs[0], minlength=len(q)))]).astype(np.int32)),
                pa.array(pairs[1].astype(np.int32)),
            )
            yield batch.select(["id", "v", "team"]).append_column("reach", pa.array(reach)).append_column(
                "wants", lists
            ).append_column("blocks", met)

    kinds = "id long, v array<bigint>, team int, reach double, wants array<struct<cell: int, least: double>>, blocks array<int>"
    return queries.mapInArrow(run, kinds)


def _teams(counts: dict[int, int], pivots: np.ndarray, most: int) -> dict[int, tuple[int, int]]:
    """cell -> (first team, teams): neighbouring cells share a team until it has ``most``, crowded cells get several."""
    teams, team, load = {}, 0, 0
    left = sorted(counts)
    at = left[0] if left else None
    while left:
        left.remove(at)
        n = counts[at]
        if load and load + n > most:
            team, load = team + 1, 0
        parts = -(-n // most)
        teams[at] = (team, parts)
        team, load = (team, load + n) if parts == 1 else (team + parts, 0)
        if left:
            at = left[int(np.argmin(np.linalg.norm(pivots[left] - pivots[at], axis=1)))]
    return teams


def _best(scores: np.ndarray, allowed: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best allowed scores in each row that reach ``least``; ties to the smaller column."""
    if scores.dtype == object:
        found = [
            sorted(np.flatnonzero(ok & (row >= low)).tolist(), key=lambda c: (-row[c], c))[:k]
            for row, ok, low in zip(scores, allowed, least)
        ]
        return np.repeat(np.arange(len(found)), [len(f) for f in found]), np.array([c for f in found for c in f], np.int64)
    scores = np.where(allowed, scores, np.iinfo(np.int64).min)
    kth = np.full(len(scores), np.iinfo(np.int64).min)
    if scores.shape[1] > k:
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    rows, columns = np.nonzero(allowed & (scores >= kth[:, None]) & (scores >= least[:, None]))
    order = np.lexsort((columns, -scores[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], columns[keep]


def _fitting(scores: np.ndarray) -> np.ndarray:
    """Scores as longs, the nearest one for those that do not fit."""
    return np.clip(scores, -(2**63), 2**63 - 1).astype(np.int64)


def topk_inner(
    rows: DataFrame, queries: DataFrame, k: int, pivots: int = PIVOTS, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``queries``, which are rows too; both are (id, v)."""
    picked = rows.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(pivots).collect()
    size = F.greatest(F.array_max("v"), F.bitwise_not(F.array_min("v")))  # ~x is -x - 1, never outside a long
    dim, most = rows.agg(F.max(F.size("v")), F.max(size)).first()
    result = "query_id long, rank int, vec_id long, score long"
    if not picked or not dim:
        return rows.sparkSession.createDataFrame([], result)
    centres = np.zeros((len(picked), dim), np.int64)
    for i, r in enumerate(picked):
        centres[i, : len(r.v)] = r.v
    pivot_ids = np.array([r.id for r in picked], np.int64)
    data = stored(_celled(rows, centres))
    radius = np.zeros(len(picked))
    held = {}
    for r in data.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():
        radius[r.cell], held[r.cell] = r.far, r.n
    spark, places = rows.sparkSession, centres.astype(float)
    blocks = _teams(held, places, rows_per_block)

    def listed(cells: dict[int, tuple[int, int]]) -> DataFrame:
        return F.broadcast(spark.createDataFrame([(c, t, n) for c, (t, n) in cells.items()], "cell int, first int, parts int"))

    asked = _celled(queries, centres)
    counts = {r.cell: r.n for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    place = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int")
    teamed = asked.join(listed(_teams(counts, places, QUERIES_PER_GROUP)), "cell").withColumn("team", place)
    bounded = stored(_bounded(teamed.select("id", "v", "team"), centres, pivot_ids, radius, k, blocks))
    wants = (  # at most pivots x teams rows: what each team needs of each cell
        bounded.select("team", F.explode("wants").alias("w"))
        .groupBy("team", F.col("w.cell").alias("cell")).agg(F.min("w.least").alias("least"))
    )
    sent = data.join(listed(blocks), "cell").withColumn("block", place).join(wants, "cell").filter("far >= least").select(
        F.col("team").alias("to_team"), F.col("block").alias("in_block"), "id", "v"
    )
    seekers = bounded.select("team", F.explode("blocks").alias("block"), "id", "v", "reach")
    # Scores that may leave a long are carried in two parts, so that they can be ranked.
    wide = dim * (float(most) + 1) ** 2 >= 2.0**62

    def solve(asks: pa.Table, have: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object))]
        if asks.num_rows and have.num_rows:
            have = have.combine_chunks().sort_by("id")
            x, ids = whole_matrix(have.column("v").combine_chunks(), dim), have.column("id").to_numpy()
            q, q_ids = whole_matrix(asks.column("v").combine_chunks(), dim), asks.column("id").to_numpy()
            reach = asks.column("reach").to_numpy()
            lowest = -(2.0**62)
            least = np.where(np.isfinite(reach), np.floor(reach), -np.inf if wide else lowest)
            for i in range(0, len(q), _CHUNK):
                part = slice(i, i + _CHUNK)
                scores = products(q[part], x)
                low = least[part] if scores.dtype == object else np.maximum(least[part], lowest).astype(np.int64)
                r, c = _best(scores, q_ids[part][:, None] != ids[None, :], low, k)
                out.append((q_ids[part][r], ids[c], scores[r, c]))
        a, b, s = (np.concatenate(v) for v in zip(*out))
        columns = {"query_id": a, "vec_id": b, "score": _fitting(s)}
        if wide:
            columns["high"] = pa.array([Decimal(int(v) >> 62) for v in s], pa.decimal128(38, 0))
            columns["low"] = np.array([int(v) & ((1 << 62) - 1) for v in s], np.int64)
        return pa.table(columns)

    found = seekers.groupBy("team", "block").cogroup(sent.groupBy("to_team", "in_block")).applyInArrow(
        solve, "query_id long, vec_id long, score long" + (", high decimal(38,0), low long" if wide else "")
    )
    by_score = [F.col(c).desc() for c in (("high", "low") if wide else ("score",))]
    best = Window.partitionBy("query_id").orderBy(*by_score, "vec_id")
    return found.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
