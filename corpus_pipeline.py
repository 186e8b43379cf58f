"""From raw documents to shards: language ID, near-duplicates, decontamination, source mix, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisweave.llm import decontaminate, langid, mixing, neardup, sharding
from axisweave.llm.text import stored


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id and the whole row, out of reach of other columns' names."""
    return docs.select(F.col("doc_id").alias("_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is among ids; null ids are kept if ids has one. Rows that share an id stay or go together."""
    ids = ids.select(F.col("doc_id").alias("_kept")).distinct()
    return _rows(docs).join(ids, F.col("_id").eqNullSafe(F.col("_kept")), "left_semi").select("_row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. Texts that are null or under three bytes have none and go; rows of one id stay or go together; an empty table gives no rows."""
    found = langid.documents_language(docs, spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return _only(docs, found.where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of each group of near copies (five-word shingles, similarity 0.8). Null ids and texts without words are in no group and stay; an empty table gives no rows."""
    return _only(docs, neardup.near_duplicates(docs).where("kept"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window. Texts without words stay; of rows that share an id all stay if any is clean; an empty benchmark takes none away."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _only(docs, found.where("n_hit = 0"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: whole takes, and the rest by a seeded draw of the same mean. Texts without words have no size and are taken in no mix; a null source is a source of its own; rows of one id share their takes."""
    take = mixing.mix(docs).groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("draw"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("double") / (1 << 32)
    times = F.least(F.lit(mixing.MAX_REPEATS), F.floor(F.col("taken") / F.greatest(F.lit(1), F.col("size")) + draw)).cast("int")
    take = take.select(F.col("doc_id").alias("_taken"), times.alias("_times")).where("_times > 0")
    df = _rows(docs).join(take, F.col("_id").eqNullSafe(F.col("_taken")))
    return df.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row. Null texts count as empty, null ids and repeated rows are dealt like others; an empty table gives no rows."""
    return sharding.shard(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontaminated), ("source_mix", mixed), ("sharding", sharded)]

#: Hashing, n-gram models and propagation can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again; nulls, repeated rows and empty tables as the stages say. Columns beyond those of documents are carried along."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
