"""Row numbers that stay the same when a plan is read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a session in one process may go without it and gets a folder of its own."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="axisweave-"))
        base = sc.getCheckpointDir()
    return base.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet into the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str = "_rid") -> DataFrame:
    """df with a unique row number. The numbers are written down, since a recomputed plan may deal rows out anew."""
    return stored(df.withColumn(name, F.monotonically_increasing_id()), "rows")
