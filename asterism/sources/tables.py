"""Reading stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SPLIT_BYTES = 128 << 20


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table whose rows cost much work each, such as long texts.

    One row group is read by one task. A table too small to give every core a full split is dealt
    out evenly, which moves at most one split per core; larger tables are read as they lie.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * _SPLIT_BYTES else df
