"""One query per operator over the test tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .clustering import CLUSTERS, DIM, ROUNDS, cluster_rows, whole_rows
from .common import table
from .fingerprints import fingerprint_edits, spelled
from .line_dedup import dedup_lines
from .mixing import mix_sources
from .ngram_join import near_links
from .packing import pack_documents, special_tokens
from .personal import BASE as PERSONAL_BASE
from .personal import find_personal
from .piece_tokens import encode_pieces
from .quality import score_quality
from .secrets import find_secrets
from .suffix_dedup import drop_repeats
from .topk_join import topk_inner, whole_vectors
from .whitening import whitened_rows
from .whitening import whole_vectors as padded_vectors

BYTE_TOKENIZER = "byte_bpe_50k.json"
BYTE_VOCABULARY = "byte_bpe_50k.tiktoken"  # its ids, but for special tokens
PIECE_VOCABULARY = "piece_bpe_32k.model"

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def fingerprints(spark, folder):
    found = fingerprint_edits(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256",
        spelled(F.col("picks")).alias("fingerprint"),
        spelled(F.col("edited_picks")).alias("edited_fingerprint"),
        "near_edited", "near_next",
    )


def line_dedup(spark, folder):
    return dedup_lines(table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def ngram_join(spark, folder):
    return near_links(table(spark, folder, "documents")).drop("class_id")


def quality_classifier(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return score_quality(docs, table(spark, folder, "labels")).select("doc_id", "held_out", "score", "predicted")


def best_fit_packing(spark, folder):
    return pack_documents(
        table(spark, folder, "documents"), vocabulary(BYTE_VOCABULARY), special=special_tokens(vocabulary(BYTE_TOKENIZER))
    )


def suffix_dedup(spark, folder):
    return drop_repeats(table(spark, folder, "documents"), with_kept=False)


def piece_tokens(spark, folder):
    return encode_pieces(table(spark, folder, "documents"), vocabulary(PIECE_VOCABULARY), with_ids=False)


def _digests(spans: DataFrame, base: tuple[str, ...], by_kind: bool) -> DataFrame:
    """Counts and digests of spans (kind, start, end); base kinds are ordered as listed."""
    key = ["cast({} as bigint) as a", "s.start as b"] if by_kind else ["s.start as a", "cast({} as bigint) as b"]
    listed = "array({})".format(", ".join(f"'{k}'" for k in base))
    order = ", ".join(k.format(f"if(array_contains({listed}, s.kind), array_position({listed}, s.kind), 99)") for k in key)
    text = "concat_ws(':', s.kind, s.start, s.end)"
    ordered = f"transform(array_sort(transform({{0}}, s -> struct({order}, s.end as c, {text} as t))), x -> x.t)"
    inside = f"filter(spans, s -> array_contains({listed}, s.kind))"
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in base]
    return spans.select(
        "doc_id", *counts,
        F.sha2(F.expr(f"array_join({ordered.format(inside)}, ',')"), 256).alias("base_sha256"),
        F.expr(f"array_join({ordered.format('spans')}, ',')").alias("spans"),
    )


def personal_data(spark, folder):
    return _digests(find_personal(table(spark, folder, "documents")), PERSONAL_BASE, by_kind=True)


def secret_scans(spark, folder):
    return _digests(find_secrets(table(spark, folder, "documents")), ("assign", "access", "hex"), by_kind=False)


def topk_search(spark, folder):
    rows = whole_vectors(table(spark, folder, "embeddings"))
    return topk_inner(rows, rows.filter("id % 20 = 0"), 20)


def source_mixing(spark, folder):
    return mix_sources(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def centroid_clustering(spark, folder):
    found = cluster_rows(whole_rows(table(spark, folder, "embeddings"), DIM))
    most = 2**63 - 1
    of_clusters = [
        (j, min(total, most), ",".join(map(str, centre)))
        for j, (centre, total) in enumerate(zip(found.centroids, found.inertias))
    ]
    spelled_out = spark.createDataFrame(of_clusters, "cluster int, cluster_inertia long, centroid string")  # k rows
    return found.rows.join(F.broadcast(spelled_out), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia",
        F.lit(min(sum(found.inertias), most)).cast("long").alias("inertia"),
        F.sha2("centroid", 256).alias("centroid_sha256"),
    )


def embedding_whitening(spark, folder):
    return whitened_rows(padded_vectors(table(spark, folder, "embeddings")))


LINE_DEDUP_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT k.*, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

QUERIES: dict[str, Query] = {
    "op1_fingerprints": fingerprints,
    "op2_ngram_join": ngram_join,
    "op3_quality_classifier": quality_classifier,
    "op4_best_fit_packing": best_fit_packing,
    "op5_line_dedup": line_dedup,
    "op6_suffix_dedup": suffix_dedup,
    "op7_piece_tokens": piece_tokens,
    "op8_personal_data": personal_data,
    "op9_secret_scans": secret_scans,
    "op10_topk_search": topk_search,
    "op11_source_mixing": source_mixing,
    "op12_centroid_clustering": centroid_clustering,
    "op13_embedding_whitening": embedding_whitening,
}

TOPK_SQL = """
WITH whole AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, x.vec_id AS vec_id, list_inner_product(q.v, x.v)::BIGINT AS score
  FROM (SELECT * FROM whole WHERE vec_id % 20 = 0) q JOIN whole x ON q.vec_id <> x.vec_id),
ranked AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
         vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 20
"""



def _clustering_sql() -> str:
    """All rounds written out: every vector against every centroid, sums by (cluster, component)."""
    parts = [f"""
WITH kept AS (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY h NULLS LAST, v) - 1)::INTEGER AS cluster, v AS c
  FROM (SELECT sha256('1:' || vec_id) AS h, v FROM kept) ORDER BY h NULLS LAST, v LIMIT {CLUSTERS})"""]
    for r in range(ROUNDS + 1):
        parts.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, row, v, cluster, d FROM (
    SELECT *, row_number() OVER (PARTITION BY row ORDER BY d, cluster) AS place FROM (
      SELECT k.*, c{r}.cluster,
             list_sum(list_transform(list_zip(k.v, c{r}.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
      FROM kept k, c{r}))
  WHERE place = 1)""")
        if r < ROUNDS:
            parts.append(f"""
c{r + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(m.c, old.c) AS c FROM c{r} old LEFT JOIN (
    SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY pos) AS c FROM (
      SELECT cluster, pos, sum(x)::BIGINT AS s, count(*) AS n
      FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{r}) GROUP BY ALL)
    GROUP BY cluster) m USING (cluster))""")
    last = ROUNDS
    return ",".join(parts) + f"""
SELECT vec_id, cluster, d AS distance, sum(d) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
       sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{last} JOIN c{last} USING (cluster)
"""


ORACLE: dict[str, str] = {
    "op10_topk_search": TOPK_SQL,
    "op12_centroid_clustering": _clustering_sql(),
    "op5_line_dedup": LINE_DEDUP_SQL,
}
