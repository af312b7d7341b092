"""Nearest point within a radius, for a whole table of probes.

Points are ordered along a Z-curve and cut into parts of equal numbers, whatever their density. A probe is
copied to the parts with boxes that can hold its nearest point: the far corner of any box that is not empty
bounds the distance, so crowded places have small bounds and a probe meets few parts there. Inside a part,
boxes of consecutive points on the curve lead to the nearest one. Only one row per box of a part (BOXES for
PART_POINTS points) ever reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import PICK_RADIUS
from ..session import durable

PART_POINTS = 1 << 20
BOXES = 16  # of a part, known to all tasks
BLOCK_PROBES = 1 << 16  # probes of one part that one group takes at least
_LEAST_PART = 1 << 14  # smaller parts are not worth a task
_LEAST_BOX = 1 << 13
_LEAF = 32  # consecutive points of a box, and boxes of a larger box
_PAIRS = 1 << 22  # pairs looked at together
_BITS = 31  # of a cell number on each axis
_MARGIN = 1e-9

_ASKED = "probe_id long, px double, py double, part int, bound double"
_FOUND = "probe_id long, px double, py double, near double, id long"


def _spread(v: np.ndarray) -> np.ndarray:
    """The bits of a number below 2**31 moved to the even places."""
    v = v.astype(np.uint64)
    for shift, mask in (
        (16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
        (2, 0x3333333333333333), (1, 0x5555555555555555),
    ):
        v = (v | (v << np.uint64(shift))) & np.uint64(mask)
    return v


@dataclass(frozen=True)
class Curve:
    """Cells of side ``unit``, numbered from ``x0``, ``y0``; what lies outside counts to the outermost cells."""

    x0: float
    y0: float
    unit: float

    @staticmethod
    def over(low: tuple[float, float], middle: tuple[float, float], high: tuple[float, float], size: float) -> Curve:
        """Fine enough to cut a radius into 2**16 cells, wide enough for most of the points."""
        unit = max(size / 2**16, max(h - lo for lo, h in zip(low, high)) / 2 ** (_BITS - 1), 1e-300)
        half = 2 ** (_BITS - 1) * unit
        return Curve(middle[0] - half, middle[1] - half, unit)

    def cells(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top = 2.0**_BITS - 1
        return tuple(
            np.clip(np.floor((v - start) / self.unit), 0, top).astype(np.int64) for v, start in ((x, self.x0), (y, self.y0))
        )

    def key(self, cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
        return (_spread(cx) | (_spread(cy) << np.uint64(1))).astype(np.int64)


@dataclass(frozen=True)
class Boxes:
    """Rectangles (4 x n: least x, largest x, least y, largest y) that each hold a point."""

    sides: np.ndarray

    @staticmethod
    def of_runs(x: np.ndarray, y: np.ndarray, starts: np.ndarray) -> Boxes:
        return Boxes(np.stack([f.reduceat(v, starts) for v in (x, y) for f in (np.minimum, np.maximum)]))

    @staticmethod
    def around(boxes: Boxes, starts: np.ndarray) -> Boxes:
        low, high = np.minimum, np.maximum
        return Boxes(np.stack([f.reduceat(s, starts) for f, s in zip((low, high, low, high), boxes.sides)]))

    def distances(self, px: np.ndarray, py: np.ndarray, at=slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """To the nearest and to the farthest place of every box."""
        x0, x1, y0, y1 = self.sides[:, at]
        a, b, c, d = x0 - px, px - x1, y0 - py, py - y1
        near = np.hypot(np.maximum(0, np.maximum(a, b)), np.maximum(0, np.maximum(c, d)))
        far = np.hypot(np.maximum(np.abs(a), np.abs(b)), np.maximum(np.abs(c), np.abs(d)))
        return near, far


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] numbers), first[1], ..."""
    start = np.cumsum(count) - count
    return np.arange(int(count.sum())) - np.repeat(start - first, count)


def _margin(px: np.ndarray, py: np.ndarray, size: float) -> np.ndarray:
    return _MARGIN * (np.abs(px) + np.abs(py) + size)


def _slices(weight: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive slices of at most ``most`` total weight; an item above that is alone."""
    total, start = np.cumsum(weight), 0
    while start < len(weight):
        done = total[start - 1] if start else 0
        stop = max(int(np.searchsorted(total, done + most, side="right")), start + 1)
        yield slice(start, stop)
        start = stop


@dataclass(frozen=True)
class Parts:
    """Ranges of the curve in order, ``each`` of them a part of ``points`` points: their first keys and boxes."""

    curve: Curve
    size: float
    radius: float
    first: np.ndarray
    boxes: Boxes
    each: int
    points: int

    def _near_ranges(self, px, py, bound) -> tuple[np.ndarray, np.ndarray]:
        """Up to four runs of ranges per probe, which hold all cells within ``bound``: (first, how many)."""
        reach = bound + _margin(px, py, self.size)
        level = np.ceil(np.log2(np.maximum(2 * reach / self.curve.unit, 1))).astype(np.int64)
        level = np.minimum(level, _BITS)
        x0, y0 = (c >> level for c in self.curve.cells(px - reach, py - reach))
        x1, y1 = (c >> level for c in self.curve.cells(px + reach, py + reach))
        found = []
        for cx, cy, new in ((x0, y0, True), (x1, y0, x1 > x0), (x0, y1, y1 > y0), (x1, y1, (x1 > x0) & (y1 > y0))):
            low = self.curve.key(cx << level, cy << level)
            high = low + (np.int64(1) << (2 * level)) - 1
            start = np.maximum(np.searchsorted(self.first, low, side="left") - 1, 0)
            stop = np.searchsorted(self.first, high, side="right")
            found.append((start, np.where(new, stop - start, 0)))
        return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)

    def wanted(self, px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probe, part, bound): the parts that can hold the nearest point of each probe within the radius,
        and a distance that it does not exceed."""
        home = np.maximum(np.searchsorted(self.first, self.curve.key(*self.curve.cells(px, py)), side="right") - 1, 0)
        bound = np.minimum(self.radius, self.boxes.distances(px, py, home)[1])
        starts, counts = self._near_ranges(px, py, bound)
        out = [np.zeros((2, 0), np.int64)]
        for run in _slices(counts.sum(1), _PAIRS):
            n = counts[run].ravel()
            part = _ranges(starts[run].ravel(), n)
            who = np.repeat(np.arange(run.start, run.stop), counts[run].sum(1))
            near, far = self.boxes.distances(px[who], py[who], part)
            np.minimum.at(bound, who, far)
            keep = near <= (bound + _margin(px, py, self.size))[who]
            pairs = np.unique(who[keep] * len(self.first) + part[keep] // self.each)
            out.append(np.stack(np.divmod(pairs, len(self.first))))
        who, part = np.concatenate(out, axis=1)
        return who, part, bound[who]


def _levels(x: np.ndarray, y: np.ndarray) -> list[Boxes]:
    """Boxes of _LEAF consecutive points, boxes of _LEAF of those, and so on to a few; the largest first."""
    levels = [Boxes.of_runs(x, y, np.arange(0, len(x), _LEAF))]
    while (n := levels[0].sides.shape[1]) > 2 * _LEAF:
        levels.insert(0, Boxes.around(levels[0], np.arange(0, n, _LEAF)))
    return levels


def _nearest_to(levels: list[Boxes], x, y, ids, px, py, bound, slack):
    """(probe, squared distance, id) of the nearest point of the probes that have one within their bound."""
    n = levels[0].sides.shape[1]
    who, box = np.repeat(np.arange(len(px)), n), np.tile(np.arange(n), len(px))
    for boxes, below in zip(levels, [*(b.sides.shape[1] for b in levels[1:]), len(x)]):
        near, far = boxes.distances(px[who], py[who], box)
        np.minimum.at(bound, who, far)
        keep = near <= (bound + slack)[who]
        who, box = who[keep], box[keep]
        count = np.minimum(_LEAF, below - box * _LEAF)
        if len(px) > 1 and count.sum() > 4 * _PAIRS:  # very many points may be the nearest: fewer probes at once
            cut = len(px) // 2
            first, rest = (
                _nearest_to(levels, x, y, ids, px[h], py[h], bound[h].copy(), slack[h]) for h in (slice(0, cut), slice(cut, None))
            )
            return np.concatenate([first[0], rest[0] + cut]), *(np.concatenate(p) for p in zip(first[1:], rest[1:]))
        who, box = np.repeat(who, count), _ranges(box * _LEAF, count)
    if not len(who):
        return who, np.zeros(0), who
    dx, dy = x[box] - px[who], y[box] - py[who]
    d2 = dx * dx + dy * dy
    begins = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
    least = np.minimum.reduceat(d2, begins)
    tied = d2 == np.repeat(least, np.diff(np.r_[begins, len(d2)]))
    highest = np.maximum.reduceat(np.where(tied, ids[box], np.iinfo(np.int64).min), begins)
    return who[begins], least, highest


def nearest_inside(x, y, ids, px, py, bound, radius: float, size: float) -> tuple[np.ndarray, np.ndarray]:
    """(squared distance, id) of the nearest point of each probe, the highest id on ties; inf without one.

    Points are in order of the curve, so that boxes of consecutive ones are small.
    """
    best, best_id = np.full(len(px), np.inf), np.full(len(px), -1, np.int64)
    levels, slack = _levels(x, y), _margin(px, py, size)
    step = max(1, _PAIRS // (8 * levels[0].sides.shape[1] + 16 * _LEAF))
    for start in range(0, len(px), step):
        run = slice(start, start + step)
        who, d2, found = _nearest_to(
            levels, x, y, ids, px[run], py[run], np.minimum(bound[run], radius), slack[run]
        )
        hit = d2 <= radius * radius
        best[start + who[hit]], best_id[start + who[hit]] = d2[hit], found[hit]
    return best, best_id


def _finite(value: Column) -> Column:
    return F.abs(value) < F.lit(float("inf"))


def _block(points: int) -> int:
    """Probes that one group takes of a part of so many points.

    A part is copied for each of its groups. They take as many probes as a full part has points, so that points
    travel about once, or else eight times the points of a small part.
    """
    return max(BLOCK_PROBES, min(PART_POINTS, 8 * points))


def _in_parts(spots: DataFrame, size: float, radius: float) -> tuple[DataFrame, Parts] | None:
    """(id, x, y, part) in ranges of the curve, and what the driver knows of the ranges."""
    shares = F.lit([0.001, 0.5, 0.999])
    n, xs, ys = spots.agg(F.count("*"), F.percentile_approx("x", shares), F.percentile_approx("y", shares)).first()
    if not n:
        return None
    curve = Curve.over(*zip(xs, ys), size)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = curve.key(*curve.cells(b.column("x").to_numpy(), b.column("y").to_numpy()))
            yield b.append_column("key", pa.array(key))

    cores = spots.sparkSession.sparkContext.defaultParallelism
    count = max(-(-n // PART_POINTS), min(cores, -(-n // _LEAST_PART)))
    each = max(1, min(BOXES, -(-n // (count * _LEAST_BOX))))
    ranged = durable(
        spots.select("id", "x", "y").mapInArrow(keyed, "id long, x double, y double, key long")
        .repartitionByRange(count * each, "key", "x", "y").withColumn("range", F.spark_partition_id())
    )
    rows = ranged.groupBy("range").agg(
        F.min("key"), F.min("x"), F.max("x"), F.min("y"), F.max("y")
    ).orderBy("range").collect()
    found = np.array([r[1] for r in rows], np.int64)
    parts = Parts(curve, size, radius, found, Boxes(np.array([tuple(r)[2:] for r in rows]).T), each, -(-n // count))
    # Ranges without rows are not among them, so ranges are numbered by their place.
    known = spots.sparkSession.createDataFrame([(r["range"], i // each) for i, r in enumerate(rows)], "range int, part int")
    return ranged.join(F.broadcast(known), "range").select("id", "x", "y", "part"), parts


def pick_nearest(
    probes: DataFrame, points: DataFrame, radius: float = PICK_RADIUS
) -> DataFrame:
    """(probe_id, id): for every (probe_id, px, py) the nearest of (id, x, y) within ``radius``.

    The radius is inclusive, the highest id wins ties, and -1 says that no point is in reach. A
    probe id at several places has an answer for each; equal probes are answered once. Points and probes are
    each read once.
    """
    size = float(radius) * (1.0 + 1e-9) if radius > 0 else 1.0
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    # Points on the same spot: only the highest id can win.
    spots = durable(
        points.filter(_finite(x) & _finite(y))
        .groupBy(x.alias("x"), y.alias("y")).agg(F.max("id").cast("long").alias("id"))
    )
    px, py = F.col("px").cast("double"), F.col("py").cast("double")
    inside = _finite(px) & _finite(py)
    sought = probes.select(
        F.col("probe_id").cast("long"),
        *(F.when(inside, c).otherwise(float("nan")).alias(n) for n, c in (("px", px), ("py", py))),
    )
    placed = _in_parts(spots, size, float(radius))
    if placed is None:
        return sought.distinct().select("probe_id", F.lit(-1).cast("long").alias("id"))
    ranged, parts = placed

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            qx, qy = b.column("px").to_numpy(), b.column("py").to_numpy()
            fine = np.flatnonzero(np.isfinite(qx) & np.isfinite(qy))
            who, part, bound = parts.wanted(qx[fine], qy[fine])
            who = fine[who]
            alone = np.setdiff1d(np.arange(len(qx)), who)  # nothing in reach: one row without a part
            who = pa.array(np.append(who, alone))
            part = np.append(part, np.full(len(alone), -1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(i).take(who) for i in range(3)]
                + [pa.array(part), pa.array(np.append(bound, np.zeros(len(alone))))],
                names=["probe_id", "px", "py", "part", "bound"],
            )

    asked = durable(sought.mapInArrow(route, _ASKED))
    crowd = asked.groupBy("part").agg(F.count("*").alias("n")).collect()  # one row per part
    most = _block(parts.points)
    table = asked.sparkSession.createDataFrame([(r.part, -(-r.n // most)) for r in crowd], "part int, blocks int")
    blocks = F.broadcast(table)
    dealt = asked.join(blocks, "part").withColumn("block", F.pmod(F.xxhash64("probe_id", "px", "py"), "blocks").cast("int"))
    copies = ranged.join(blocks, "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    curve = parts.curve

    def solve(ask: pa.Table, have: pa.Table) -> pa.Table:
        qx, qy = ask.column("px").to_numpy(), ask.column("py").to_numpy()
        near, ids = np.full(len(qx), np.inf), np.full(len(qx), -1, np.int64)
        if len(qx) and len(have):
            x, y, known = (have.column(c).to_numpy() for c in ("x", "y", "id"))
            order = np.argsort(curve.key(*curve.cells(x, y)))
            near, ids = nearest_inside(
                x[order], y[order], known[order], qx, qy, ask.column("bound").to_numpy(), radius, size
            )
        return ask.select(["probe_id", "px", "py"]).append_column("near", pa.array(near)).append_column("id", pa.array(ids))

    found = (
        dealt.select("probe_id", "px", "py", "bound", "part", "block").groupBy("part", "block")
        .cogroup(copies.select("id", "x", "y", "part", "block").groupBy("part", "block"))
        .applyInArrow(solve, _FOUND)
    )
    hit = F.struct((-F.col("near")).alias("near"), F.col("id").alias("id"))
    return found.groupBy("probe_id", "px", "py").agg(F.max(hit).alias("hit")).select("probe_id", F.col("hit.id").alias("id"))
