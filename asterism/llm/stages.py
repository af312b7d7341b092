"""Stages that clean a corpus; each takes and returns the columns of ``documents``, the last returns packed pieces.

Defined cases, for all stages: an empty table gives an empty table; a text that is null counts as empty; rows with
a null or repeated doc_id are documents of their own (in ``lines`` they count as one document when a line's
documents are counted); texts of any length are taken whole; further columns come along as they are, whatever their
names; ``n_chars`` is counted anew where a stage may change the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stored, table
from .line_dedup import dedup_lines
from .ngram_join import keep_one_of_each
from .packing import pack_documents, special_tokens
from .quality import score_quality
from .queries import BYTE_TOKENIZER, BYTE_VOCABULARY, vocabulary
from .secrets import redact_secrets


def _carried(docs: DataFrame) -> DataFrame:
    """(document, doc_id, text): all columns in one struct, so that no name can clash with what an operator adds."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document"), "doc_id", "text")


def _with_text(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The columns of documents, with ``text`` taken from another column and counted anew."""
    new = {"text": F.col(text).alias("text"), "n_chars": F.char_length(F.col(text)).cast("long").alias("n_chars")}
    return df.select(*(new.get(c, F.col(f"document.`{c}`").alias(c)) for c in columns))


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels of the folder, accepts."""
    scored = score_quality(_carried(docs), table(spark, folder, "labels"))
    return scored.filter("predicted = 1").select("document.*")


def lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without the lines that ten or more of them share; one may be left empty."""
    return _with_text(dedup_lines(_carried(docs)), docs.columns, "kept_text")


def near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document, that of the smallest id, of every group of like documents."""
    return keep_one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every document, with a mask in the place of each secret."""
    return _with_text(redact_secrets(_carried(docs)), docs.columns, "text")


def packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token pieces of the documents, with their ids, packed into sequences."""
    special = special_tokens(vocabulary(BYTE_TOKENIZER))
    return pack_documents(docs, vocabulary(BYTE_VOCABULARY), with_ids=True, special=special)


STAGES = [
    ("quality", quality), ("lines", lines), ("near_copies", near_copies), ("secrets", secrets), ("packing", packing),
]


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``, each result stored as Parquet before the next stage reads it.

    Once a stage's result is stored, the tables that it was made from are emptied; the last result stays.
    """
    docs, before = table(spark, folder, "documents"), None
    for _, stage in STAGES:
        with scratch(spark) as made:
            docs = stored(stage(spark, docs, folder))
            after = made.pop()
            if before:
                made.append(before)
        before = after
    return docs
