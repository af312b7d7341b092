"""Operators on whole vectors: means, covariance, nearest centroid, inertia, components."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from ..session import durable
from .blocks import VectorBlocks, list_matrix, on_grid
from .gram import covariance_blocks
from .kmeans import nearest
from .many_centroids import nearest_of_many


def normalize_vectors(vectors: DataFrame, features: str = "features") -> DataFrame:
    return vectors.withColumn(features, V.normalize(F.col(features)))


def mean_vector(vectors: DataFrame, features: str = "features") -> DataFrame:
    """One row ``mean``; an empty array when there are no vectors."""
    mean = (
        vectors.groupBy(F.lit(0).alias("all"))
        .agg(Summarizer.mean(array_to_vector(F.col(features))).alias("m"))
        .select(vector_to_array("m").alias("mean"))
    )
    empty = F.array().cast("array<double>")
    one = vectors.sparkSession.range(1)
    return one.select(F.coalesce(mean.scalar(), empty).alias("mean"))


def group_centroids(
    vectors: DataFrame, group: str = "cluster", features: str = "features"
) -> DataFrame:
    """(group, centroid, size): the mean vector of every group, combined before the shuffle."""
    return vectors.groupBy(group).agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col(features)))).alias("centroid"),
        F.count("*").alias("size"),
    )


def covariance(vectors: DataFrame) -> DataFrame:
    """(i, j, cov): the d x d covariance (divided by n) of (id, features), stored and read back.

    Blocks of the matrix are made and divided in tasks; neither a task nor the driver holds all of it.
    """
    blocks = VectorBlocks.of(vectors)
    try:
        if not blocks.n:
            return vectors.sparkSession.createDataFrame([], "i int, j int, cov double")
        return durable(covariance_blocks(blocks))
    finally:
        blocks.close()


def remove_component(
    vectors: DataFrame, direction: Sequence[float], features: str = "features"
) -> DataFrame:
    """Every vector without its part along one unit direction."""
    axis = F.array(*[F.lit(float(w)) for w in direction])
    return vectors.withColumn(features, V.remove_component(F.col(features), axis))


_TILE_VALUES = 1 << 22  # of centroids held by a task at a time


def assign_to(
    vectors: DataFrame, centres: np.ndarray, exponent: int | None = None, labels: list | None = None
) -> DataFrame:
    """``vectors`` plus (cluster, d2): the closest of the given centres; the first one wins ties.

    ``exponent`` puts the vectors on the grid of the blocks the centres were fitted on, ``labels``
    renames the clusters. Stateless and shuffle-free, so it works on a stream as well.
    """
    names = np.arange(len(centres)) if labels is None else np.array(labels)

    @F.arrow_udf("struct<cluster: int, d2: double>")
    def assign(features: pa.Array) -> pa.Array:
        if not len(features):
            own, d2 = np.zeros(0, dtype=np.int64), np.zeros(0)
        else:
            x = list_matrix(features, centres.shape[1])
            x = x if exponent is None else on_grid(x, exponent)
            own = nearest(x, centres)
            diff = x - centres[own]
            d2 = np.einsum("ij,ij->i", diff, diff)
        return pa.StructArray.from_arrays(
            [pa.array(names[own], pa.int32()), pa.array(d2)], names=["cluster", "d2"]
        )

    near = F.col("_near")
    return (
        vectors.withColumn("_near", assign.asNondeterministic()(V.as_vector(F.col("features"))))
        .withColumns({"cluster": near["cluster"], "d2": near["d2"]})
        .drop("_near")
    )


def nearest_centroid(
    vectors: DataFrame, centroids: DataFrame, tile_values: int = _TILE_VALUES
) -> DataFrame:
    """``vectors`` plus (cluster, d2): the closest of (cluster, centroid); low ids win ties.

    Vectors are read once and nothing of them is stored. Beyond ``tile_values`` numbers a task goes through
    the centroids in parts.
    """
    centroids = durable(centroids.select("cluster", "centroid"))  # read several times, made once
    k, dim = centroids.agg(F.count("*"), F.max(F.size("centroid"))).first()
    if k == 0:
        raise ValueError("there are no centroids")
    if k * dim > tile_values:
        return nearest_of_many(vectors, centroids, k, dim, tile_values)
    rows = centroids.select("cluster", "centroid").orderBy("cluster").collect()
    return assign_to(vectors, np.array([r.centroid for r in rows], dtype=float), labels=[r.cluster for r in rows])


def inertia(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """One row: sum of squared distances to the nearest centroid."""
    return nearest_centroid(vectors.select("features"), centroids).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("d2"), F.lit(0.0)).alias("inertia")
    )
