"""Naming groups of texts by their most distinctive terms (class-based TF-IDF)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import EMPTY_LABEL, LABEL_SEPARATOR, LABEL_TERMS
from ..functions.text import distinct_terms
from ..session import durable


def valid_assignments(df: DataFrame, k: int, cluster: str = "cluster") -> DataFrame:
    """Rows whose cluster is one of 0..k-1; NULL and out-of-range ones go."""
    return df.filter(F.col(cluster).between(0, k - 1))


def _assigned(df: DataFrame, group: str, k: int | None) -> DataFrame:
    return df.filter(F.col(group).isNotNull()) if k is None else valid_assignments(df, k, group)


def term_df(
    df: DataFrame, group: str = "cluster", text: str = "text", k: int | None = None
) -> DataFrame:
    """(group, term, tf, df): texts of the group with the term, and assigned texts with it.

    Texts become terms row by row; counts are combined on the map side before the shuffle, so a
    group or a term that fills much of the data costs no more than any other. ``df`` is summed
    from the per-group counts, combined by term, and joined back, so that a term of very many
    groups is a key that Spark can split.
    """
    per_group = (
        _assigned(df, group, k)
        .select(group, F.explode(distinct_terms(F.col(text))).alias("term"))
        .groupBy(group, "term").agg(F.count("*").alias("tf"))
    )
    totals = per_group.groupBy("term").agg(F.sum("tf").alias("df"))
    return per_group.join(totals, "term").select(group, "term", "tf", "df")


def top_terms(
    df: DataFrame,
    group: str = "cluster",
    text: str = "text",
    k: int | None = None,
    top_n: int = LABEL_TERMS,
    n_texts: int | None = None,
) -> DataFrame:
    """(group, rank, term, tf, df, score): the best terms of each group.

    score = tf * ln(1 + N / df), N counting every text, assigned or not (counted unless given). Equal scores are ordered
    by the term under Unicode collation, which is compared only where scores are equal. Every task keeps its own
    ``top_n`` terms of a group before the shuffle, however many of them tie.
    """
    if n_texts is None:
        total = df.agg(F.greatest(F.count("*"), F.lit(1)).cast("double").alias("n")).scalar()
    else:
        total = F.lit(float(max(n_texts, 1)))
    scored = term_df(df, group, text, k).withColumn(
        "score", F.col("tf") * F.log(F.lit(1.0) + total / F.col("df"))
    )
    best = Window.partitionBy(group).orderBy(
        F.col("score").desc(), F.collate(F.col("term"), "UNICODE"), F.col("term")
    )
    return (
        scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_n)
        .select(group, "rank", "term", "tf", "df", "score")
    )


def join_terms(ranked: DataFrame, group: str) -> DataFrame:
    """(group, label): at most top_n ranked terms per group, joined in rank order."""
    return ranked.groupBy(group).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]
            ),
            LABEL_SEPARATOR,
        ).alias("label")
    )


def label_groups(
    df: DataFrame,
    group: str = "cluster",
    text: str = "text",
    k: int | None = None,
    top_n: int = LABEL_TERMS,
) -> DataFrame:
    """(group, label) for every group: clusters 0..k-1, or all values of ``group`` without k.

    Groups without any term are called "misc".
    """
    counts = durable(df.groupBy(group).agg(F.count("*").alias("n")))  # both N and the groups
    n_texts = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    named = join_terms(top_terms(df, group, text, k, top_n, n_texts), group)
    if k is None:
        groups = counts.filter(F.col(group).isNotNull()).select(group)
    else:
        ids = df.sparkSession.range(k)
        groups = ids.select(F.col("id").cast(df.schema[group].dataType).alias(group))
    return groups.join(named, group, "left").select(
        group, F.coalesce("label", F.lit(EMPTY_LABEL)).alias("label")
    )
