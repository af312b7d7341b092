"""One named query per operator over the test tables; ``oracle`` states the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import KMEANS_SEED, TURN_ANGLE
from ..functions import vector as V
from ..functions.csv import csv_cell
from ..functions.text import tokenize
from ..operators import export, labels, layout
from ..operators import vectors as vec
from ..operators.blocks import VectorBlocks
from ..operators.kmeans import KMeansModel, fit_kmeans, scan_k, seed_centres
from ..operators.nearest_point import pick_nearest
from ..operators.pca import fit_pca
from ..operators.similar import topk_similar
from ..session import durable, shared_folder
from ..sources import lines
from ..sources.tables import read_texts
from ..sources.vectors import embed_distinct, embed_hash, load_vectors
from .semantic_map import FittedMap, SemanticMap, build_map, map_documents
from .semantic_map import cluster_sizes as sizes_of

CAP = 5000
FIXED_K = 5
RECLUSTER_K = 7
SEEDS = 8
TOP_K = 5
TURN = 0.8
TURNS = 3
BOX = (1280.0, 720.0)
LINE_K = 9  # line numbers fill clusters 0..6, two more stay empty
RADIUS = 14.0

Query = Callable[[SparkSession, str], DataFrame]


def rnd(value: Column, digits: int = 6) -> Column:
    return F.round(value, digits) + F.lit(0.0)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _documents(spark, folder):
    return read_texts(spark, f"{folder}/documents.parquet")


def _vectors(spark, folder):
    """(id, features) of all embeddings."""
    return load_vectors(_table(spark, folder, "embeddings"), "vec_id", "embedding")


def _labelled(spark, folder):
    """(id, features, label) of all embeddings."""
    return _table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), V.as_vector(F.col("embedding")).alias("features"), "label"
    )


def _items(spark, folder):
    """(id, text, features) of every document: its stored vector, or else the hashed one of its text."""
    texts = _documents(spark, folder).select(F.col("doc_id").alias("id"), "text")
    stored = _vectors(spark, folder)
    others = embed_hash(texts.join(stored, "id", "left_anti"))
    return durable(texts.join(stored, "id").unionByName(others))


def _graded(spark, folder):
    """(doc_id, text, cluster): the quality of a document as its cluster, NULL without one."""
    grades = _table(spark, folder, "labels").select("doc_id", F.col("quality").alias("cluster"))
    return _documents(spark, folder).select("doc_id", "text").join(grades, "doc_id", "left")


def _points(spark, folder):
    """(id, x, y, cluster) of all order lines."""
    return _table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        F.col("l_quantity").alias("x"),
        F.col("l_extendedprice").alias("y"),
        (F.col("l_linenumber") - 1).cast("int").alias("cluster"),
    )


def _rounded_xy(df: DataFrame, *keep: str, digits: int = 6) -> DataFrame:
    return df.select(*keep, rnd(F.col("x"), digits).alias("x"), rnd(F.col("y"), digits).alias("y"))


def _long(df: DataFrame, keep: list[str], array: str, pos: str, value: str) -> DataFrame:
    """One row per array element, values rounded."""
    return df.select(*keep, F.posexplode(array).alias(pos, "_v")).select(
        *keep, pos, rnd(F.col("_v")).alias(value)
    )


def _label_centres(spark, folder):
    return vec.group_centroids(_labelled(spark, folder), "label").select(
        F.col("label").alias("cluster"), "centroid"
    )


def _map(spark, folder, k=None) -> SemanticMap:
    return build_map(_items(spark, folder), k=k).close()


def _kmeans(spark, folder) -> tuple[DataFrame, KMeansModel, VectorBlocks]:
    rows = _vectors(spark, folder)
    blocks = VectorBlocks.of(rows)
    model = fit_kmeans(blocks, [FIXED_K], KMEANS_SEED)[FIXED_K]
    return rows, model, blocks


# ---- lines and terms -----------------------------------------------------------------------------


def parse_lines(spark, folder):
    return lines.parse_lines(_documents(spark, folder))


def cap_lines(spark, folder):
    return lines.cap_lines(_documents(spark, folder), CAP)


def line_stats(spark, folder):
    return lines.line_stats(_documents(spark, folder), CAP)


def tokens(spark, folder):
    return _documents(spark, folder).select("doc_id", tokenize(F.col("text")).alias("t")).select(
        "doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens")
    )


def hashed(spark, folder):
    return _long(
        embed_hash(_documents(spark, folder), "doc_id"), ["id"], "features", "bucket", "value"
    )


def file_lines(spark, folder):
    """All lines of text files that hold the documents in order, numbered through."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    ordered = _documents(spark, folder).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.select("text").write.text(path, lineSep="\n")
    return lines.file_lines(spark, path).select("id", "line")


def _shape_model():
    """Stands for a sentence model: letters, vowels and spaces of a text."""

    def model(texts):
        return np.array([[len(t), sum(map(t.count, "aeiou")), t.count(" "), 1] for t in texts], float)

    return model


def embed_model(spark, folder):
    """Every line through a model that sees each different line once."""
    rows = lines.parse_lines(_documents(spark, folder)).withColumn("id", F.col("doc_id"))
    found = embed_distinct(rows, _shape_model, text_col="line", keep=("doc_id", "pos"))
    return _long(found, ["doc_id", "pos"], "features", "at", "value")


def csv_guard(spark, folder):
    return parse_lines(spark, folder).select("doc_id", "pos", csv_cell(F.col("line")).alias("cell"))


def valid_assignments(spark, folder):
    return labels.valid_assignments(_graded(spark, folder), 2).select("doc_id", "cluster")


def term_df(spark, folder):
    return labels.term_df(_documents(spark, folder), "lang")


def top_terms(spark, folder):
    return labels.top_terms(_documents(spark, folder), "source", top_n=5).withColumn(
        "score", rnd(F.col("score"))
    )


def label_groups(spark, folder):
    return labels.label_groups(_documents(spark, folder), "lang")


def label_clusters(spark, folder):
    return labels.label_groups(_graded(spark, folder), "cluster", k=3)


# ---- vectors -------------------------------------------------------------------------------------


def vectors_loaded(spark, folder):
    f = F.col("features")
    total = F.aggregate(f, F.lit(0.0), lambda s, x: s + x)
    return _vectors(spark, folder).select(
        "id", F.size(f).alias("dim"), rnd(V.norm(f)).alias("norm"), rnd(total).alias("total")
    )


def vector_ops(spark, folder):
    pairs = _labelled(spark, folder).join(
        _label_centres(spark, folder).withColumnRenamed("cluster", "label"), "label"
    )
    a, b = F.col("features"), F.col("centroid")
    return pairs.select(
        "id", rnd(V.dot(a, b)).alias("dot"), rnd(V.norm(a)).alias("norm"),
        rnd(V.cosine(a, b)).alias("cosine"), rnd(V.euclidean(a, b)).alias("euclidean"),
    )


def normalize_vectors(spark, folder):
    scaled = _labelled(spark, folder).withColumn(
        "features", F.transform("features", lambda x: x * F.col("label"))
    )
    return _long(vec.normalize_vectors(scaled), ["id"], "features", "pos", "value")


def mean_vector(spark, folder):
    return _long(vec.mean_vector(_vectors(spark, folder)), [], "mean", "pos", "mean")


def group_centroids(spark, folder):
    return _long(
        vec.group_centroids(_labelled(spark, folder), "label"), ["label", "size"], "centroid", "pos", "value"
    )


def nearest_centroid(spark, folder):
    return vec.nearest_centroid(_vectors(spark, folder), _label_centres(spark, folder)).select(
        "id", "cluster", rnd(F.col("d2")).alias("d2")
    )


def nearest_document(spark, folder):
    """The stored vectors against the hashed vectors of all documents, met in parts."""
    every = embed_hash(_documents(spark, folder), "doc_id")
    centroids = every.select(F.col("id").cast("int").alias("cluster"), F.col("features").alias("centroid"))
    return vec.nearest_centroid(_vectors(spark, folder), centroids, tile_values=1 << 13).select(
        "id", "cluster", rnd(F.col("d2")).alias("d2")
    )


def inertia(spark, folder):
    return vec.inertia(_vectors(spark, folder), _label_centres(spark, folder)).withColumn(
        "inertia", rnd(F.col("inertia"), 5)
    )


def similar(spark, folder):
    rows = _vectors(spark, folder)
    return topk_similar(rows, rows, TOP_K)


def similarity_join(spark, folder):
    """Every document with the documents most like it in hashed terms, both sides divided into cells."""
    rows = embed_hash(_documents(spark, folder), "doc_id")
    return topk_similar(rows, rows, TOP_K, held_values=0)


def covariance(spark, folder):
    return vec.covariance(_vectors(spark, folder)).withColumn("cov", rnd(F.col("cov"), 9))


def remove_component(spark, folder):
    rows = _vectors(spark, folder)
    direction = vec.mean_vector(rows).select(V.normalize(F.col("mean")).alias("w")).first().w
    return _long(vec.remove_component(rows, direction), ["id"], "features", "pos", "value")


def _projected(spark, folder, **options):
    rows = _vectors(spark, folder)
    blocks = VectorBlocks.of(rows)
    basis = fit_pca(blocks, **options)
    centre = KMeansModel(1, basis.mean[None, :], basis.mean[None, :], None, 0)
    blocks.close()
    return _rounded_xy(FittedMap(centre, basis, blocks.exponent).place(rows), "id")


def pca_2d(spark, folder):
    return _projected(spark, folder)


def pca_by_passes(spark, folder):
    """The same layout without the matrix of covariances."""
    return _projected(spark, folder, exact_dim=0)


# ---- k-means -------------------------------------------------------------------------------------


def kmeans_seed(spark, folder):
    blocks = VectorBlocks.of(_vectors(spark, folder))
    ids, _ = seed_centres(blocks, SEEDS, KMEANS_SEED)
    blocks.close()
    return spark.createDataFrame(list(enumerate(ids)), "step int, id long")


def kmeans(spark, folder):
    rows, model, blocks = _kmeans(spark, folder)
    blocks.close()
    return vec.assign_to(rows, model.assign_by, blocks.exponent).select("id", "cluster")


def kmeans_centroids(spark, folder):
    _, model, blocks = _kmeans(spark, folder)
    blocks.close()
    rows = [(c, [float(x) for x in v]) for c, v in enumerate(model.centroids)]
    df = spark.createDataFrame(rows, "cluster int, centroid array<double>")
    return _long(df, ["cluster"], "centroid", "pos", "value")


def elbow_k(spark, folder):
    blocks = VectorBlocks.of(_vectors(spark, folder))
    best, models = scan_k(blocks)
    blocks.close()
    rows = [(k, m.inertia, k == best) for k, m in sorted(models.items())]
    return spark.createDataFrame(rows, "k int, inertia double, is_elbow boolean").withColumn(
        "inertia", rnd(F.col("inertia"))
    )


# ---- maps and exports ----------------------------------------------------------------------------


def whole_map(spark, folder):
    points = _map(spark, folder).points
    return _rounded_xy(
        points.withColumn("text_md5", F.md5(F.col("text").cast("binary"))), "id", "cluster", "text_md5", digits=5
    )


def cluster_sizes(spark, folder):
    return sizes_of(_map(spark, folder, FIXED_K).points)


def legend(spark, folder):
    return _map(spark, folder).legend()


def map_summary(spark, folder):
    return _map(spark, folder).summary


def recluster(spark, folder):
    first = build_map(_items(spark, folder), k=FIXED_K)
    second = first.recluster(RECLUSTER_K).close()
    named = second.clusters.withColumnRenamed("id", "cluster")
    return _rounded_xy(
        second.points.join(named, "cluster"), "id", "cluster", "label", "size", digits=5
    )


def _exported(spark, folder, keep=("id",)):
    m = _map(spark, folder, FIXED_K)
    return export.export_rows(m.points, m.clusters, keep)


def export_rows(spark, folder):
    return _exported(spark, folder, ())


def export_csv(spark, folder):
    return export.export_csv(_exported(spark, folder), ("id",))


def export_json(spark, folder):
    return export.export_json(_exported(spark, folder), ("id",))


def export_document(spark, folder):
    """The pieces of the JSON document of the whole map: k, clusters and points."""
    m = _map(spark, folder, FIXED_K)
    return export.json_document(m.points, m.clusters, m.k)


def export_csv_file(spark, folder):
    """The lines of the CSV text of a map, read from its parts in order."""
    m = _map(spark, folder, FIXED_K)
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    export.write_csv_file(m.points, m.clusters, path)
    return lines.file_lines(spark, f"{path}/parts").select("id", "line")


def reproject_export(spark, folder):
    """A map turned and normalised again, then exported."""
    turned = _map(spark, folder, FIXED_K).reproject(TURN_ANGLE, TURNS)
    return export.export_rows(turned.points, turned.clusters, ("id",)).select("id", "cluster", "label", "x", "y")


def place_on_saved_map(spark, folder):
    """All documents placed by a map of the stored vectors that was saved and read again."""
    texts = _documents(spark, folder).select(F.col("doc_id").alias("id"), "text")
    m = build_map(_vectors(spark, folder).join(texts, "id"), k=FIXED_K).close()
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    m.model.save(spark, path)
    return _rounded_xy(FittedMap.load(spark, path).place(_items(spark, folder)), "id", "cluster", digits=5)


def lines_map(spark, folder):
    """Every line of every document: hashed, clustered with automatic k, placed and named."""
    m = map_documents(_documents(spark, folder)).close()
    labels_by_id = m.clusters.select(F.col("id").alias("cluster"), "label")
    return _rounded_xy(m.points.join(F.broadcast(labels_by_id), "cluster"), "id", "cluster", "label", digits=5)


# ---- layouts -------------------------------------------------------------------------------------


def _normal(spark, folder):
    return layout.normalize_coords(_points(spark, folder))


def normalize_coords(spark, folder):
    return _rounded_xy(_normal(spark, folder), "id")


def rotate_coords(spark, folder):
    return _rounded_xy(layout.rotate_coords(_normal(spark, folder), TURN), "id")


def reproject(spark, folder):
    return _rounded_xy(layout.reproject(_normal(spark, folder), TURN_ANGLE, TURNS), "id", "cluster")


def scale_to_box(spark, folder):
    return _rounded_xy(layout.scale_to_box(_normal(spark, folder), *BOX), "id")


def isolate(spark, folder):
    return layout.isolate(_points(spark, folder), 2).select("id", "x", "y")


def highlight(spark, folder):
    return layout.highlight(_points(spark, folder), 2).select("id", "cluster", "dimmed")


def cluster_centroids_2d(spark, folder):
    return _rounded_xy(layout.cluster_centroids_2d(_points(spark, folder), LINE_K), "cluster", digits=5)


def constellation_edges(spark, folder):
    edges = layout.constellation_edges(_points(spark, folder), LINE_K)
    return edges.withColumns({c: rnd(F.col(c), 5) for c in ("cx", "cy")})


def siblings(spark, folder):
    points = _table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").alias("cluster")
    )
    probes = _table(spark, folder, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    return layout.siblings(points, probes, 10)


def nearest_points(spark, folder):
    half = lambda c: ((F.min(c) + F.max(c)) / 2.0)
    probes = _table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("probe_id")).agg(
        half("l_quantity").alias("px"), half("l_extendedprice").alias("py")
    )
    return pick_nearest(probes, _points(spark, folder), RADIUS)


QUERIES: dict[str, Query] = {
    "parse_lines": parse_lines,
    "cap_lines": cap_lines,
    "line_stats": line_stats,
    "tokenize": tokens,
    "embed_hash": hashed,
    "embed_model": embed_model,
    "file_lines": file_lines,
    "csv_guard": csv_guard,
    "valid_assignments": valid_assignments,
    "term_df": term_df,
    "top_terms": top_terms,
    "label_groups": label_groups,
    "label_clusters": label_clusters,
    "load_vectors": vectors_loaded,
    "vector_ops": vector_ops,
    "normalize_vectors": normalize_vectors,
    "mean_vector": mean_vector,
    "group_centroids": group_centroids,
    "nearest_centroid": nearest_centroid,
    "nearest_document": nearest_document,
    "inertia": inertia,
    "topk_similar": similar,
    "similarity_join": similarity_join,
    "covariance": covariance,
    "remove_component": remove_component,
    "pca_2d": pca_2d,
    "pca_by_passes": pca_by_passes,
    "kmeans_seed": kmeans_seed,
    "kmeans": kmeans,
    "kmeans_centroids": kmeans_centroids,
    "elbow_k": elbow_k,
    "build_map": whole_map,
    "cluster_sizes": cluster_sizes,
    "legend": legend,
    "map_summary": map_summary,
    "recluster": recluster,
    "export_rows": export_rows,
    "export_csv": export_csv,
    "export_json": export_json,
    "export_document": export_document,
    "export_csv_file": export_csv_file,
    "reproject_export": reproject_export,
    "place_on_saved_map": place_on_saved_map,
    "lines_map": lines_map,
    "normalize_coords": normalize_coords,
    "rotate_coords": rotate_coords,
    "reproject": reproject,
    "scale_to_box": scale_to_box,
    "isolate": isolate,
    "highlight": highlight,
    "cluster_centroids_2d": cluster_centroids_2d,
    "constellation_edges": constellation_edges,
    "siblings": siblings,
    "pick_nearest": nearest_points,
}
