"""Placing new lines on a fitted map. Every step is stateless, so a stream runs as it is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.semantic_map import FittedMap
from ..sources.lines import parse_lines
from ..sources.vectors import embed_hash


def score_lines(docs: DataFrame, model: FittedMap, embed: Callable[..., DataFrame] = embed_hash) -> DataFrame:
    """(doc_id, pos, text, x, y, cluster) of every line of a stored or streaming (doc_id, text).

    ``embed(df, keep=...)`` turns (id, text) into (id, text, features) and carries the kept columns.
    """
    lines = parse_lines(docs).select(
        "doc_id", "pos", F.xxhash64("doc_id", "pos").alias("id"), F.col("line").alias("text")
    )
    return model.place(embed(lines, keep=("doc_id", "pos"))).select("doc_id", "pos", "text", "x", "y", "cluster")
