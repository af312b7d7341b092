"""Line sources: documents or text files → one row per clean line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import MIN_LINES
from ..functions.text import split_lines, trim_ws
from ..session import durable


def parse_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, pos, line): trimmed non-blank lines; pos counts the kept lines from 0."""
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.posexplode(split_lines(F.col(text))).alias("pos", "line")
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, block_start, seq, line) of text files, split at line feeds only.

    The first three columns order the lines; ``seq`` grows inside one input split.
    """
    raw = spark.read.text(path, lineSep="\n")
    return raw.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("seq"),
        trim_ws(F.col("value")).alias("line"),
    ).filter(F.col("line") != "")


def _before(rows: DataFrame, order: list[str], weight: str, name: str) -> DataFrame:
    """``rows`` and ``name``, the sum of ``weight`` over all rows before, in sorted ranges of rows."""
    ranged = durable(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(F.sum(weight).alias("_total"))  # one row per range
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(starts), "_range").withColumn(
        name, F.col("_start") + F.coalesce(F.sum(weight).over(inside), F.lit(0))
    ).drop("_range", "_start")


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, path, pos, line): the clean lines of text files, however large a file is.

    A file is read in splits. One pass counts the kept lines of every split; prefix sums over
    (path, block_start) then number the lines: ``pos`` inside their file and ``id`` over all files in order of
    their paths, both from 0. Only counts of splits are sorted or joined to the lines.
    """
    kept = read_lines(spark, path).select("path", "block_start", "line").withColumn("seq", F.monotonically_increasing_id())
    splits = kept.groupBy("path", "block_start").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    numbered = _before(splits, ["path", "block_start"], "n", "start")
    in_file = Window.partitionBy("path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    starts = durable(numbered.withColumn("before", F.coalesce(F.sum("n").over(in_file), F.lit(0))).drop("n"))
    place = F.col("seq") - F.col("first")
    return kept.join(starts, ["path", "block_start"]).select(
        (F.col("start") + place).alias("id"), "path", (F.col("before") + place).alias("pos"), "line"
    )


def line_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_lines), computed row by row without a shuffle."""
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.size(split_lines(F.col(text))).cast("long").alias("n_lines")
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc_id, text) of text files for the map: one document per file, ids in the order of paths."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )
    names = durable(files.select("path").repartitionByRange("path").withColumn("part", F.spark_partition_id()))
    ranked = _numbered(names, ["path"], "doc_id")
    return files.join(ranked.select("path", "doc_id"), "path")


def _cut_point(counts: DataFrame, max_lines: int, buckets: int = 4096) -> tuple[int | None, int] | None:
    """(doc_id, lines kept of it): the document in which the cap is reached, or None.

    Narrows a range of doc ids, one small aggregation per round, so nothing is sorted. Documents
    without an id come first.
    """
    lines = F.coalesce(F.sum("n_lines"), F.lit(0))
    low, high, total, before = counts.agg(
        F.min("doc_id"), F.max("doc_id"), lines,
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n_lines"))), F.lit(0)),
    ).first()
    if total <= max_lines:
        return None
    if before >= max_lines:
        return None, max_lines
    while low < high:
        width = -(-(high - low + 1) // buckets)
        bucket = F.expr(f"(doc_id - {low}L) div {width}L")
        rows = (
            counts.filter(F.col("doc_id").between(low, high))
            .groupBy(bucket.alias("b")).agg(F.sum("n_lines").alias("n")).collect()
        )
        for b, n in sorted((r.b, r.n) for r in rows):
            if before + n > max_lines:
                low, high = low + b * width, min(high, low + (b + 1) * width - 1)
                break
            before += n
    return low, max_lines - before


def cap_lines(
    docs: DataFrame, max_lines: int | None, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """The first ``max_lines`` lines in (doc_id, pos) order; every line when it is None.

    The cap becomes a filter on doc_id, and a rank inside the one id at which it is reached: no
    global sort, no single-task limit, any size. Lines without an id come first; lines that share
    (doc_id, pos) are ordered by their text.
    """
    lines = parse_lines(docs, text, doc_id)
    if max_lines is None:
        return lines
    counts = line_counts(docs, text, doc_id).persist()
    try:
        cut = _cut_point(counts, max_lines)
    finally:
        counts.unpersist()
    if cut is None:
        return lines
    doc, kept = cut
    d = F.col("doc_id")
    last = Window.partitionBy("doc_id").orderBy("pos", "line")
    partly = (
        lines.filter(d.eqNullSafe(F.lit(doc).cast("long"))).withColumn("_rank", F.row_number().over(last))
        .filter(F.col("_rank") <= kept).drop("_rank")
    )
    return partly if doc is None else lines.filter(d.isNull() | (d < doc)).unionByName(partly)


def _numbered(parts: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows numbered from 0 in the order of ``order``; ``part`` numbers ranges of rows in that order."""
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))  # one row per range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return parts.withColumn("_rank", rank).join(F.broadcast(starts), "part").withColumn(
        name, F.col("_start") + F.col("_rank") - 1
    ).drop("part", "_rank", "_start")


def with_line_ids(lines: DataFrame, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``lines`` of ``docs`` and ``id``, one BIGINT per line without collisions, ordered as (doc_id, pos).

    Distinct ids close together give (doc_id - lowest) * (most lines of a document) + pos, row by
    row. Missing, repeated or widely spread ids are numbered through in sorted ranges.
    """
    d = F.col("doc_id")
    n, known, different, low, high, most = line_counts(docs, text, doc_id).agg(
        F.count("*"), F.count(d), F.count_distinct(d), F.min(d), F.max(d), F.max("n_lines")
    ).first()
    if n == 0 or (n == known == different and (high - low + 1) * max(most, 1) < 2**63):
        return lines.withColumn("id", (d - F.lit(low or 0)) * F.lit(max(most or 0, 1)) + F.col("pos"))
    order = ["doc_id", "pos", "line"]
    parts = lines.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    return _numbered(durable(parts), order, "id")


def line_stats(
    docs: DataFrame,
    max_lines: int | None = None,
    min_lines: int = MIN_LINES,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """One row: lines kept, lines dropped by the cap, and whether enough are left to map."""
    total = F.coalesce(F.sum("n_lines"), F.lit(0)).cast("long")
    kept = total if max_lines is None else F.least(total, F.lit(max_lines).cast("long"))
    return (
        line_counts(docs, text, doc_id)
        .agg(total.alias("total"), kept.alias("kept"))
        .select(
            "kept",
            (F.col("total") - F.col("kept")).alias("truncated"),
            (F.col("kept") >= min_lines).alias("enough"),
        )
    )


def require_lines(
    docs: DataFrame, min_lines: int = MIN_LINES, text: str = "text", doc_id: str = "doc_id"
) -> int:
    """The number of lines; raises when there are too few to map."""
    kept = line_stats(docs, None, min_lines, text, doc_id).first()["kept"]
    if kept < min_lines:
        raise ValueError(f"a map needs at least {min_lines} lines, got {kept}")
    return kept
