"""Tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The name of a new folder that driver and executors share and that goes when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="memloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/memloom-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def counted(df: DataFrame, done: Callable[[int], None]) -> DataFrame:
    """durable(df); done gets the number of rows, counted while they were written."""
    seen = Observation()
    out = durable(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    done(seen.get["rows"])
    return out


def durable(df: DataFrame) -> DataFrame:
    """df written to the folder that driver and executors share, and read back:
    lineage ends there, and losing an executor costs a reread only."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
