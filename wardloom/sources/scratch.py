"""A folder for what one query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """A new path in ``spark.checkpoint.dir``, which all machines share; in local mode, if it is unset, on this machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{named or tempfile.mkdtemp(prefix='scratch-')}/{uuid.uuid4()}"
