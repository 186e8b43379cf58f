"""Interval tables derived from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lineitems(spark: SparkSession, d: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/lineitem.parquet")
    start = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long")
    return df.select(F.concat(F.lit("chr"), (F.col("l_suppkey") % 25 + 1).cast("string")).alias("chrom"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"), F.col("l_linestatus").alias("strand"))


def orders(spark: SparkSession, d: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/orders.parquet")
    start = (F.col("o_orderkey") * 10).cast("long")
    return df.select(F.concat(F.lit("chr"), (F.col("o_custkey") % 25 + 1).cast("string")).alias("chrom"), start.alias("start"), (start + F.col("o_totalprice").cast("long") % 100).alias("end"), F.col("o_orderkey").alias("okey"), F.col("o_orderstatus").alias("strand"))


def events(spark: SparkSession, d: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/events.parquet")
    start = F.unix_timestamp("ts").cast("long")
    return df.select(F.col("event_type").alias("chrom"), start.alias("start"), (start + F.col("value").cast("long")).alias("end"), "event_id", (F.col("user_id") % 3).alias("grp"))


def parts(spark: SparkSession, d: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/part.parquet")
    start = (F.col("p_partkey") * 75).cast("long")
    return df.select(F.concat(F.lit("chr"), (F.col("p_partkey") % 25 + 1).cast("string")).alias("chrom"), start.alias("start"), (start + F.col("p_size").cast("long")).alias("end"), F.col("p_partkey").alias("pkey"), F.col("p_brand").alias("brand"))


def view(spark: SparkSession, d: str) -> DataFrame:
    """Two arms for each of chr1 to chr25, up to the largest end of the lineitem and order intervals."""
    last = F.max("end").alias("n")
    half = lineitems(spark, d).agg(last).unionByName(orders(spark, d).agg(last)).agg(F.ceil(F.max("n") / 2).cast("long").alias("half"))
    arms = spark.range(1, 26).select(F.concat(F.lit("chr"), F.col("id").cast("string")).alias("chrom"), F.explode(F.array(F.lit(0), F.lit(1))).alias("arm"))
    half = int(half.first()["half"] or 0)
    return arms.select("chrom", (F.col("arm") * half).cast("long").alias("start"), ((F.col("arm") + 1) * half).cast("long").alias("end"), F.concat("chrom", F.when(F.col("arm") == 0, "p").otherwise("q")).alias("name"))


CTE = """
A AS (SELECT 'chr' || CAST(l_suppkey % 25 + 1 AS VARCHAR) AS chrom, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS s, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) + CAST(trunc(l_quantity) AS BIGINT) AS e, l_linestatus AS strand FROM lineitem),
B AS (SELECT 'chr' || CAST(o_custkey % 25 + 1 AS VARCHAR) AS chrom, CAST(o_orderkey * 10 AS BIGINT) AS s, CAST(o_orderkey * 10 AS BIGINT) + CAST(trunc(o_totalprice) AS BIGINT) % 100 AS e, o_orderkey AS okey, o_orderstatus AS strand FROM orders),
P0 AS (SELECT 'chr' || CAST(p_partkey % 25 + 1 AS VARCHAR) AS chrom, CAST(p_partkey * 75 AS BIGINT) AS s, CAST(p_partkey * 75 + p_size AS BIGINT) AS e, p_partkey AS pkey, p_brand AS brand FROM part),
E AS (SELECT event_type AS chrom, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + CAST(trunc(value) AS BIGINT) AS e, event_id, user_id % 3 AS grp FROM events),
H AS (SELECT CAST(ceil(greatest((SELECT max(e) FROM A), (SELECT max(e) FROM B)) / 2.0) AS BIGINT) AS h),
V AS (SELECT 'chr' || CAST(i AS VARCHAR) AS chrom, CAST(a * h AS BIGINT) AS s, CAST((a + 1) * h AS BIGINT) AS e, 'chr' || CAST(i AS VARCHAR) || CASE WHEN a = 0 THEN 'p' ELSE 'q' END AS name FROM H, range(1, 26) t(i), range(0, 2) u(a))
"""
