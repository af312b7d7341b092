"""Settings the operators read from the Spark session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Make sure checkpoints go to the shared folder named in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="asterism-checkpoints-")
    sc.setCheckpointDir(shared)


def shared_folder(spark: SparkSession) -> str:
    use_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """The frame, computed once, stored as a table in the shared checkpoint folder and read from there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
