"""Words of a text as Spark columns, and folders that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space and the control characters tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text in order; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def lower_ascii(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else changed."""
    return F.translate(text, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a session in one process may go without it and gets a folder of its own."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="axisweave-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


#: While set, Spark removes a query's shuffle files when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, tag: str, sort: list[str] | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here, and a lost executor costs nothing.

    The shuffle files of the query that makes df go when it is written, as nothing reads them any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/axisweave-{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.sortWithinPartitions(*sort) if sort else df).write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Remove the files of stored tables that no later step reads."""
    for df in tables:
        if df is not None and (path := getattr(df, "_stored_at", None)):
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def bounded_broadcast(df: DataFrame, rows: int, most: int) -> DataFrame:
    """A broadcast hint only if the counted rows stay within the bound; else a shuffled join follows."""
    return F.broadcast(df) if rows <= most else df
