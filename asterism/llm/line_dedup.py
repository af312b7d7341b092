"""Drops lines that many documents share. DataFrame functions only.

A line's key is the line without ASCII white space at both ends, A-Z in lower case. Keys are hashed
to 128 bits, counted once per document, and every line whose key is in at least ``min_docs``
documents goes, wherever it is. The other lines keep their order.

Defined cases: a null or empty text is one empty line; keys shorter than ``min_chars`` code points
are never dropped; a document with no line left has an empty text; rows that repeat a doc_id count as
one document; a null doc_id counts as one document too. Other columns are passed through, but for those
named like a result (kept_text, n_lines, n_dropped), whose place the results take.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, ascii_lower, stored, text_or_empty

MIN_DOCS = 10
MIN_CHARS = 1
RESULTS = ("kept_text", "n_lines", "n_dropped")


def lines_of(text: Column) -> Column:
    return F.split(text_or_empty(text), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def _hashed(line: Column, min_chars: int) -> Column:
    """128 bits of a key as two numbers; null for keys that are too short to drop."""
    key = line_key(line)
    both = F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))
    return F.when(F.char_length(key) >= min_chars, both)


def dedup_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """All columns of ``docs`` and (kept_text, n_lines, n_dropped).

    Text is shuffled once, with the numbers of its dropped lines; counting moves hashes only.
    """
    row = F.struct(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("t"))
    hashed = F.transform(lines_of(F.col(text)), lambda x: _hashed(x, min_chars))
    seen = docs.select(
        F.col(doc_id).alias("id"), F.explode(F.array_compact(F.array_distinct(hashed))).alias("h")
    ).select("h.h1", "h.h2", F.struct("id").alias("id"))
    counted = seen.groupBy("h1", "h2").agg(F.count_distinct("id").alias("n")).filter(F.col("n") >= min_docs)
    frequent = stored(counted.select("h1", "h2"))  # a table of its own lets Spark split a hot key in the join
    at = docs.select(row.alias("r"), F.posexplode(hashed).alias("pos", "h")).filter("h IS NOT NULL")
    dropped = (
        at.select("r.id", "r.t", "pos", "h.h1", "h.h2").join(frequent, ["h1", "h2"])
        .groupBy("id", "t").agg(F.collect_set("pos").alias("gone"))
    )
    names = [c for c in docs.columns if c not in RESULTS]
    left = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("doc"), row.alias("r"))
    joined = left.join(
        dropped, F.col("r.id").eqNullSafe(F.col("id")) & (F.col("r.t") == F.col("t")), "left"
    )
    lines = lines_of(F.col(f"doc.`{text}`"))
    gone = F.coalesce(F.col("gone"), F.array().cast("array<int>"))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), gone)
    return (
        joined.select("doc", lines.alias("lines"), gone.alias("gone"))
        .select(
            *(F.col(f"doc.`{c}`").alias(c) for c in names),
            F.array_join(F.transform(places, lambda i: F.get("lines", i)), "\n").alias("kept_text"),
            F.size("lines").cast("long").alias("n_lines"),
            F.size("gone").cast("long").alias("n_dropped"),
        )
    )
