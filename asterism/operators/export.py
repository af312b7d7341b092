"""Writing a map: rows, JSON records, CSV records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import EXPORT_COLUMNS
from ..functions.csv import csv_cell
from ..functions.text import number_text, round4
from ..session import durable


def export_rows(points: DataFrame, clusters: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(line, cluster, label, x, y) of every point; a point without a cluster has an empty label.

    Coordinates are rounded to 4 decimals. ``keep`` names further point columns to carry along.
    """
    labels = clusters.select(F.col("id").alias("cluster"), "label")
    return points.join(labels, "cluster", "left").select(
        *keep,
        F.col("text").alias("line"),
        "cluster",
        F.coalesce("label", F.lit("")).alias("label"),
        round4(F.col("x")).alias("x"),
        round4(F.col("y")).alias("y"),
    )


def csv_record(*cells: Column) -> Column:
    return F.concat_ws(",", *[csv_cell(c) for c in cells])


def csv_header() -> str:
    return ",".join(EXPORT_COLUMNS)


def export_csv(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One CSV record (without line end) per export row."""
    return rows.select(
        *keep,
        csv_record(
            F.col("line"), F.col("cluster").cast("string"), F.col("label"),
            number_text(F.col("x")), number_text(F.col("y")),
        ).alias("record"),
    )


def json_string(text: Column) -> Column:
    """A JSON string literal; NULL becomes null."""
    quoted = F.to_json(F.array(text))
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def _member(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'"{name}":'), F.coalesce(value, F.lit("null")))


def _object(*members: Column) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


def export_json(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One JSON object per export row, numbers in their shortest form (1, not 1.0)."""
    return rows.select(
        *keep,
        _object(
            _member("line", json_string(F.col("line"))),
            _member("cluster", F.col("cluster").cast("string")),
            _member("label", json_string(F.col("label"))),
            _member("x", number_text(F.col("x"))),
            _member("y", number_text(F.col("y"))),
        ).alias("record"),
    )


def write_csv(points: DataFrame, clusters: DataFrame, path: str) -> None:
    """A folder of CSV parts without header, and the header beside them in ``<path>/header``.

    Records end in CRLF; line feeds inside quoted cells stay as they are.
    """
    spark = points.sparkSession
    export_csv(export_rows(points, clusters)).write.text(f"{path}/records", lineSep="\r\n")
    spark.createDataFrame([(csv_header(),)], "value string").coalesce(1).write.text(
        f"{path}/header", lineSep="\r\n"
    )


def write_json(points: DataFrame, clusters: DataFrame, k: int, path: str) -> None:
    """Folders ``points``, ``clusters`` and ``summary`` with one JSON object per line."""
    spark = points.sparkSession
    export_json(export_rows(points, clusters)).write.text(f"{path}/points")
    clusters.write.json(f"{path}/clusters")
    spark.createDataFrame([(k,)], "k int").coalesce(1).write.json(f"{path}/summary")


def json_clusters(clusters: DataFrame) -> DataFrame:
    """(id, record): one JSON object per cluster."""
    return clusters.select(
        F.col("id").cast("long").alias("id"),
        _object(
            _member("id", F.col("id").cast("string")),
            _member("label", json_string(F.col("label"))),
            _member("size", F.col("size").cast("string")),
        ).alias("record"),
    )


def json_document(points: DataFrame, clusters: DataFrame, k: int) -> DataFrame:
    """(part, id, record): the pieces of one JSON document {k, clusters, points}.

    The records in order of (part, id), joined, are the document. They are made row by row, so the
    number of points does not matter; a comma precedes every cluster and point but the first.
    """
    spark = points.sparkSession
    body = export_json(export_rows(points, clusters, keep=("id",)), keep=("id",))
    first_cluster = clusters.agg(F.min("id")).first()[0]
    first_point, without = points.agg(F.min("id"), F.count_if(F.col("id").isNull())).first()
    if without:
        raise ValueError(f"a document needs ids to put points in order; {without} points have none")

    def listed(rows: DataFrame, part: int, first) -> DataFrame:
        comma = F.when(F.col("id") == F.lit(first), "").otherwise(",")
        return rows.select(F.lit(part).alias("part"), "id", F.concat(comma, "record").alias("record"))

    frame = spark.createDataFrame(
        [(0, 0, f'{{"k":{k},"clusters":['), (2, 0, '],"points":['), (4, 0, "]}")], "part int, id long, record string"
    )
    return frame.union(listed(json_clusters(clusters), 1, first_cluster)).union(listed(body, 3, first_point))


def write_ordered(records: DataFrame, order: list[str], path: str, line_sep: str = "\n") -> DataFrame:
    """The column ``record`` as one text in parts: ``<path>/parts``, in order of ``order``.

    Parts are ranges of the order, sorted inside, so that the files joined in order of their names are the text;
    every record ends in ``line_sep``. Returns the manifest, also stored in ``<path>/manifest``: (file, bytes,
    offset) of every part, with which parts can be copied into one file side by side. The records are made once and
    stored: finding the ranges reads them a second time.
    """
    spark = records.sparkSession
    ranged = durable(records).repartitionByRange(*order).sortWithinPartitions(*order).select("record")
    ranged.write.text(f"{path}/parts", lineSep=line_sep)
    files = spark.read.format("binaryFile").load(f"{path}/parts").select(  # lengths only; no content is read
        F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes")
    ).filter("bytes > 0")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    manifest = files.withColumn("offset", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    manifest.write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def write_csv_file(points: DataFrame, clusters: DataFrame, path: str) -> DataFrame:
    """The map as one CSV text in ordered parts: the header, then the records in order of their ids."""
    spark = points.sparkSession
    header = spark.createDataFrame([(0, None, csv_header())], "part int, id long, record string")
    body = export_csv(export_rows(points, clusters, keep=("id",)), keep=("id",)).select(F.lit(1).alias("part"), "id", "record")
    return write_ordered(header.union(body), ["part", "id", "record"], path, "\r\n")


def write_json_file(points: DataFrame, clusters: DataFrame, k: int, path: str) -> DataFrame:
    """The map as one JSON document in ordered parts, one cluster or point per line."""
    return write_ordered(json_document(points, clusters, k), ["part", "id"], path)
