"""Cuts lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``. In local mode, where one machine does all, one of our own if unset."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(frame: DataFrame) -> DataFrame:
    """The same rows, read back from a checkpoint in the shared folder."""
    folder(frame.sparkSession)
    return frame.checkpoint()


def written(frame: DataFrame, compression: str | None = None) -> DataFrame:
    """The same rows, read back from a Parquet table in the shared folder, which is removed when the application ends."""
    spark = frame.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4()}"
    frame.write.parquet(path, compression=compression)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.parquet(path)
