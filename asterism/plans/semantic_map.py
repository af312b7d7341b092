"""The labelled semantic map: cluster, project and name any collection of texts with vectors."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import (
    EMPTY_LABEL,
    KMEANS_MAX_ITER,
    KMEANS_SEED,
    LABEL_TERMS,
    MIN_LINES,
    TURN_ANGLE,
)
from ..functions.vector import as_vector
from ..operators import layout
from ..operators.blocks import VectorBlocks, list_matrix, on_grid
from ..operators.kmeans import KMeansModel, fit_kmeans, nearest, scan_k
from ..operators.labels import join_terms, top_terms
from ..operators.layout import per_cluster
from ..operators.pca import Basis, fit_pca
from ..schemas import CLUSTERS, POINTS
from ..session import durable
from ..sources.lines import cap_lines, file_lines, with_line_ids
from ..sources.vectors import embed_hash


def clamp_k(k: float, n: int) -> int:
    """k rounded (halves up) and bounded to 1..n."""
    return max(1, min(math.floor(k + 0.5), n))


@dataclass
class FittedMap:
    """Centroids and projection of a map: all that is needed to place rows, old or new."""

    kmeans: KMeansModel
    basis: Basis
    exponent: int

    def place(self, items: DataFrame) -> DataFrame:
        """``items`` with (x, y, cluster) from their ``features``, row by row, without a shuffle."""
        centres, basis, exponent = self.kmeans.assign_by, self.basis, self.exponent

        @F.arrow_udf("struct<x: double, y: double, cluster: int>")
        def locate(features: pa.Array) -> pa.Array:
            if not len(features):
                xy, own = np.zeros((0, 2)), np.zeros(0)
            else:
                rows = on_grid(list_matrix(features, centres.shape[1]), exponent)
                xy, own = basis.place(rows), nearest(rows, centres)
            return pa.StructArray.from_arrays(
                [pa.array(xy[:, 0]), pa.array(xy[:, 1]), pa.array(own, pa.int32())],
                names=["x", "y", "cluster"],
            )

        spot = F.col("_spot")
        return (
            items.withColumn("_spot", locate.asNondeterministic()(as_vector(F.col("features"))))
            .withColumns({"x": spot["x"], "y": spot["y"], "cluster": spot["cluster"]})
            .drop("_spot")
        )


    def save(self, spark: SparkSession, path: str) -> None:
        """Store the model (k x d numbers) as a small parquet table."""
        b = self.basis
        parts = {
            "centroids": self.kmeans.centroids, "assign_by": self.kmeans.assign_by, "axes": b.axes,
            "mean": b.mean[None, :], "variances": b.variances[None, :],
            "sizes": np.asarray(self.kmeans.sizes, dtype=float)[None, :],
            "box": np.array([[*b.centre, b.span, float(self.exponent)]]),
        }
        rows = [(p, i, [float(x) for x in v]) for p, m in parts.items() for i, v in enumerate(m)]
        spark.createDataFrame(rows, "part string, pos int, row array<double>").coalesce(
            1
        ).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> FittedMap:
        rows = spark.read.parquet(path).orderBy("part", "pos").collect()
        m = {p: np.array([r.row for r in rows if r.part == p]) for p in {r.part for r in rows}}
        x, y, span, exponent = m["box"][0]
        basis = Basis(m["mean"][0], m["axes"], m["variances"][0], (x, y), span)
        sizes = m["sizes"][0].astype(np.int64)
        kmeans = KMeansModel(len(m["centroids"]), m["centroids"], m["assign_by"], sizes, 0)
        return FittedMap(kmeans, basis, int(exponent))


def name_clusters(points: DataFrame, sizes: Sequence[int], top_n: int = LABEL_TERMS) -> DataFrame:
    """(id, label, size) of every cluster that has members; sizes are known per cluster id."""
    k = len(sizes)
    filled = points.sparkSession.createDataFrame(
        [(c, int(n)) for c, n in enumerate(sizes) if n], "cluster int, size long"
    )
    terms = top_terms(points, "cluster", "text", k, top_n, n_texts=int(sum(sizes)))
    labels = join_terms(terms, "cluster")
    return filled.join(per_cluster(labels, k), "cluster", "left").select(
        F.col("cluster").alias("id"),
        F.coalesce("label", F.lit(EMPTY_LABEL)).alias("label"),
        "size",
    )


def cluster_sizes(points: DataFrame) -> DataFrame:
    """(cluster, size) of the clusters that have members."""
    return points.groupBy("cluster").agg(F.count("*").alias("size"))


class SemanticMap:
    """points(id, text, x, y, cluster), clusters(id, label, size) and k.

    The frames are lazy: points are placed from the input by the fitted model whenever they are
    read. The cached vectors serve ``recluster`` until ``close``.
    """

    def __init__(
        self, items: DataFrame, blocks: VectorBlocks, model: FittedMap | None, seed: int,
        max_iter: int, top_n: int, points: DataFrame | None = None,
    ):
        self._items, self._blocks, self.model = items, blocks, model
        self._seed, self._max_iter, self._top_n = seed, max_iter, top_n
        self.k = model.kmeans.k if model else 0
        spark = items.sparkSession
        if model is None:
            self.points = spark.createDataFrame([], POINTS)
            self.clusters = spark.createDataFrame([], CLUSTERS)
            return
        placed = model.place(items.select(F.col("id").cast("long"), "text", "features"))
        self.points = points if points is not None else placed.select("id", "text", "x", "y", "cluster")
        named = name_clusters(placed.select("text", "cluster"), model.kmeans.sizes, top_n)
        self.clusters = per_cluster(named, self.k)

    @property
    def summary(self) -> DataFrame:
        """One row: k, number of points, number of clusters with members; all known from the fit."""
        sizes = self.model.kmeans.sizes if self.model else np.zeros(0, np.int64)
        row = (self.k, int(sizes.sum()), int((sizes > 0).sum()))
        return self.points.sparkSession.createDataFrame([row], "k int, n_points long, n_clusters long")

    def legend(self) -> DataFrame:
        """The clusters in order of their id (at most k rows)."""
        return self.clusters.orderBy("id")

    def recluster(self, k: float) -> SemanticMap:
        """The same rows and coordinates with another k. Nothing is embedded or projected again."""
        if self.model is None:
            return self
        k = clamp_k(k, self._blocks.n)
        kmeans = fit_kmeans(self._blocks, [k], self._seed, self._max_iter)[k]
        model = FittedMap(kmeans, self.model.basis, self.model.exponent)
        return SemanticMap(self._items, self._blocks, model, self._seed, self._max_iter, self._top_n)

    def reproject(self, angle: float = TURN_ANGLE, times: int = 1) -> SemanticMap:
        """The layout turned and normalised again; clusters and labels stay."""
        if self.model is None:
            return self
        turned = layout.reproject(self.points, angle, times)
        return SemanticMap(
            self._items, self._blocks, self.model, self._seed, self._max_iter, self._top_n, turned
        )

    def close(self) -> SemanticMap:
        """Release the cached vectors; the frames stay usable."""
        self._blocks.close()
        return self


def build_map(
    items: DataFrame,
    k: float | None = None,
    seed: int = KMEANS_SEED,
    max_iter: int = KMEANS_MAX_ITER,
    top_n: int = LABEL_TERMS,
    min_rows: int = 0,
) -> SemanticMap:
    """Map (id, text, features). Without k, the elbow of the inertia curve chooses it.

    Texts never enter the iterations: the vectors are cached alone, and rows are placed and named
    from the input afterwards, one pass without a shuffle.
    """
    blocks = VectorBlocks.of(items.select("id", "features"))
    if blocks.n < min_rows:
        blocks.close()
        raise ValueError(f"a map needs at least {min_rows} lines, got {blocks.n}")
    if blocks.n == 0:
        return SemanticMap(items, blocks, None, seed, max_iter, top_n)
    models: dict[int, KMeansModel] = {}
    if k is None:
        k, models = scan_k(blocks, seed=seed, max_iter=max_iter)
    k = clamp_k(k, blocks.n)
    if k not in models:
        models = fit_kmeans(blocks, [k], seed, max_iter)
    model = FittedMap(models[k], fit_pca(blocks), blocks.exponent)
    return SemanticMap(items, blocks, model, seed, max_iter, top_n)


def line_items(
    docs: DataFrame, embed: Callable[[DataFrame], DataFrame] = embed_hash, max_lines: int | None = None
) -> DataFrame:
    """(id, text, features) of every line of (doc_id, text); the id orders the lines."""
    lines = with_line_ids(cap_lines(docs, max_lines), docs)
    return embed(lines.select("id", F.col("line").alias("text")))


def map_documents(
    docs: DataFrame,
    k: float | None = None,
    embed: Callable[[DataFrame], DataFrame] = embed_hash,
    max_lines: int | None = None,
    min_lines: int = MIN_LINES,
    seed: int = KMEANS_SEED,
    max_iter: int = KMEANS_MAX_ITER,
    top_n: int = LABEL_TERMS,
) -> SemanticMap:
    """The map of all lines of (doc_id, text); refuses fewer than ``min_lines`` lines.

    ``embed`` turns (id, text) into (id, text, features). Its result is stored once; points, names
    and exports read it from there.
    """
    items = durable(line_items(docs, embed, max_lines))
    return build_map(items, k, seed, max_iter, top_n, min_lines)


def map_files(
    spark: SparkSession,
    path: str,
    k: float | None = None,
    embed: Callable[[DataFrame], DataFrame] = embed_hash,
    min_lines: int = MIN_LINES,
    seed: int = KMEANS_SEED,
    max_iter: int = KMEANS_MAX_ITER,
    top_n: int = LABEL_TERMS,
) -> SemanticMap:
    """The map of all lines of text files; ids number the lines in order of (path, place)."""
    items = durable(embed(file_lines(spark, path).select("id", F.col("line").alias("text"))))
    return build_map(items, k, seed, max_iter, top_n, min_lines)
