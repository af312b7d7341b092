"""Operators on 2D layouts: normalise, rotate, scale, centroids, edges, highlights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import BOX_PAD, TURN_ANGLE
from ..functions.geometry import rotate, to_box


# Frames of one row per cluster are broadcast up to this many clusters.
_BROADCAST_CLUSTERS = 100_000


def per_cluster(df: DataFrame, k: int) -> DataFrame:
    """``df`` has at most k rows: broadcast it while k is small, else leave it to the optimizer."""
    return F.broadcast(df) if k <= _BROADCAST_CLUSTERS else df


def normalize_coords(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Coordinates scaled into [-1, 1] by the larger side of the bounding box, centred on it.

    The box is one aggregate, used as a scalar subquery. A side of length 0 counts as 1.
    """
    cx, cy = F.col(x), F.col(y)
    box = points.agg(
        F.struct(
            F.min(cx).alias("x0"), F.max(cx).alias("x1"), F.min(cy).alias("y0"), F.max(cy).alias("y1")
        ).alias("box")
    ).select(
        F.struct(
            ((F.col("box.x0") + F.col("box.x1")) / 2.0).alias("x"),
            ((F.col("box.y0") + F.col("box.y1")) / 2.0).alias("y"),
            F.greatest(
                *[
                    F.when(side == 0.0, F.lit(1.0)).otherwise(side)
                    for side in (
                        F.col("box.x1") - F.col("box.x0"),
                        F.col("box.y1") - F.col("box.y0"),
                    )
                ]
            ).alias("span"),
        ).alias("centre")
    ).scalar()
    return points.withColumns({
        x: (cx - box["x"]) * 2.0 / box["span"],
        y: (cy - box["y"]) * 2.0 / box["span"],
    })


def rotate_coords(points: DataFrame, angle: float, x: str = "x", y: str = "y") -> DataFrame:
    """Coordinates turned about the origin."""
    turned = rotate(F.col(x), F.col(y), angle)
    return points.withColumns({x: turned[0], y: turned[1]})


def scale_to_box(
    points: DataFrame, width: float, height: float, pad: float = BOX_PAD, x: str = "x", y: str = "y"
) -> DataFrame:
    """Coordinates in [-1, 1] mapped into a width x height box."""
    placed = to_box(F.col(x), F.col(y), width, height, pad)
    return points.withColumns({x: placed[0], y: placed[1]})


def reproject(points: DataFrame, angle: float = TURN_ANGLE, times: int = 1) -> DataFrame:
    """The layout turned ``times`` times by ``angle`` and normalised again; nothing else changes.

    Turning and normalising commute up to a uniform scale, so one turn by the whole angle is
    enough.
    """
    return normalize_coords(rotate_coords(points, angle * times))


def cluster_centroids_2d(points: DataFrame, k: int) -> DataFrame:
    """(cluster, x, y) for clusters 0..k-1: the mean position, the origin for an empty one."""
    means = (
        points.filter(F.col("cluster").between(0, k - 1))
        .groupBy("cluster").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    )
    ids = points.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster"))
    return ids.join(means, "cluster", "left").select(
        "cluster", F.coalesce("mx", F.lit(0.0)).alias("x"), F.coalesce("my", F.lit(0.0)).alias("y")
    )


def constellation_edges(points: DataFrame, k: int) -> DataFrame:
    """(id, x, y, cx, cy, cluster): one edge from every point to the centre of its cluster.

    Points outside 0..k-1 have no edge. 
    """
    centres = cluster_centroids_2d(points, k).select(
        "cluster", F.col("x").alias("cx"), F.col("y").alias("cy")
    )
    return points.join(per_cluster(centres, k), "cluster").select("id", "x", "y", "cx", "cy", "cluster")


def isolate(points: DataFrame, cluster: int) -> DataFrame:
    """Only the points of one cluster."""
    return points.filter(F.col("cluster") == cluster)


def highlight(points: DataFrame, cluster: int | None) -> DataFrame:
    """Every point with ``dimmed``: true outside the highlighted cluster; None highlights nothing."""
    if cluster is None or cluster < 0:
        return points.withColumn("dimmed", F.lit(False))
    return points.withColumn("dimmed", ~F.col("cluster").eqNullSafe(F.lit(cluster)))


def siblings(points: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """Points that share a cluster with a probed point: (id, cluster, n_probes, is_probe, is_sibling).

    ``probes`` holds one column ``id``. One row per point, however many probes its cluster has:
    probes are counted per cluster (at most k rows), no point-to-point pairs are made. A probed
    point is a sibling only of the other probes in its cluster.
    """
    inside = points.select("id", "cluster").filter(F.col("cluster").between(0, k - 1))
    marks = probes.select("id").distinct().withColumn("hit", F.lit(True))
    flagged = inside.join(marks, "id", "left").select(
        "id", "cluster", F.coalesce("hit", F.lit(False)).alias("is_probe")
    )
    counts = (
        inside.join(marks, "id", "left_semi").groupBy("cluster").agg(F.count("*").alias("n_probes"))
    )
    return flagged.join(per_cluster(counts, k), "cluster").select(
        "id", "cluster", "n_probes", "is_probe",
        (F.col("n_probes") > F.col("is_probe").cast("int")).alias("is_sibling"),
    )
