"""What the operators of this folder share: tables, stored results, Arrow batches, column helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local session without one gets its own."""
    known = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="asterism-shared-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir()


_made: ContextVar[list[str] | None] = ContextVar("paths of stored tables", default=None)


def stored(df: DataFrame) -> DataFrame:
    """The frame written once as a table in the shared folder and read from there.

    Lost executors cost only their running tasks; nothing is computed a second time.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if (made := _made.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables stored inside the block are emptied at its end, so that they take no more room.

    What reads them has to be written by then. The paths of the tables are handed out in a list, and one that is
    taken off it stays. A block that fails leaves its tables as they are; a block inside another has its own.
    """
    made: list[str] = []
    outer = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(outer)
    for path in made:
        empty_table(spark, path)


def empty_table(spark: SparkSession, path: str) -> None:
    """Overwrites a stored table with one of no rows, which removes its files on any file system."""
    spark.createDataFrame([], "nothing int").write.mode("overwrite").parquet(path)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose text column holds about ``most`` bytes; bounds memory."""
    texts = batch.column(column)
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(size):
        done = size[start - 1] if start else 0
        stop = max(int(np.searchsorted(size, done + most, side="right")), start + 1)
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after the other, n + 1 offsets); a null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]
