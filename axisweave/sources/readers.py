"""Readers of genomic text formats as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axisweave.functions.genome import natural_key
from axisweave.operators.ranges import region_predicate
from axisweave.sources.binary import read_bam_files, read_indexed_lines
from axisweave.sources.formats import DEFAULT_PATTERNS, SCHEMAS


def read_table(spark: SparkSession, path, schema: str | list[str] | T.StructType | None = None, schema_is_strict: bool = False, **options) -> DataFrame:
    """A tab-separated file without a header, plain or gzipped, with a named schema, column names or a struct. Strict: a column without any value is an error."""
    if isinstance(schema, str):
        if schema not in SCHEMAS:
            raise ValueError(f"unknown schema {schema}")
        schema = SCHEMAS[schema]
    elif isinstance(schema, (list, tuple)):
        schema = T.StructType([T.StructField(n, T.StringType()) for n in schema])
    reader = spark.read.options(**{"sep": "\t", "comment": "#", "mode": "PERMISSIVE", "nullValue": "", **options})
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    if schema_is_strict:
        n = df.agg(*[F.count(f"`{c}`").alias(str(i)) for i, c in enumerate(df.columns)]).first()
        empty = [c for i, c in enumerate(df.columns) if n[i] == 0]
        if empty:
            raise ValueError(f"columns without values: {empty}")
    return df


def read_chromsizes(spark: SparkSession, path, filter_chroms: bool = True, chrom_patterns=DEFAULT_PATTERNS, natsort: bool = True, as_bed: bool = False, **options) -> DataFrame:
    """name and length (or an interval triple) in the order of the patterns, within each naturally sorted."""
    df = read_table(spark, path, T.StructType([T.StructField("name", T.StringType()), T.StructField("length", T.LongType())]), **options)
    rank: Column = F.lit(0)
    if filter_chroms:
        rank = F.coalesce(*[F.when(F.col("name").rlike(p), i) for i, p in enumerate(chrom_patterns)], F.lit(None).cast("int"))
        df = df.where(rank.isNotNull())
    df = df.orderBy(rank, *([natural_key(F.col("name"))] if natsort else []), "name" if natsort else F.lit(0)).select("name", "length")
    return df.select(F.col("name").alias("chrom"), F.lit(0).cast("long").alias("start"), F.col("length").alias("end")) if as_bed else df


def load_fasta(spark: SparkSession, paths) -> DataFrame:
    """chrom and seq of every record of one or more FASTA files."""
    raw = spark.read.option("lineSep", ">").text(paths).where(F.trim("value") != "")
    lines = F.split("value", "\r?\n", -1)
    name = F.regexp_extract(F.get(lines, F.lit(0)), r"^(\S*)", 1)
    return raw.select(name.alias("chrom"), F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "").alias("seq"))


def read_alignments(spark: SparkSession, path: str, chrom: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Alignments of a SAM or BAM file: twelve fields, POS from 0, CIGAR null where MAPQ is 0, TAGs as a JSON object. Other formats raise ValueError."""
    if path.endswith(".bam"):
        return _of_region(read_bam_files(spark, path), chrom, start, end)
    if not re.search(r"\.sam(\.gz)?$", path):
        raise ValueError("only .sam and .bam files can be read")
    rows = spark.read.text(path).where(~F.col("value").startswith("@"))
    f = F.split("value", "\t", -1)
    tag = F.transform(F.slice(f, 12, F.greatest(F.size(f) - 11, F.lit(0))), lambda x: F.struct(F.substring_index(x, ":", 1).alias("key"), F.regexp_extract(x, r"^[^:]*:[^:]*:(.*)$", 1).alias("value")))
    get = lambda i: F.get(f, F.lit(i))
    pos = get(3).cast("long") - 1
    mapq = get(4).cast("int")
    df = rows.select(
        get(0).alias("QNAME"), get(1).cast("int").alias("FLAG"), get(2).alias("RNAME"), pos.alias("POS"), mapq.alias("MAPQ"), F.when(mapq != 0, get(5)).alias("CIGAR"), get(6).alias("RNEXT"),
        (get(7).cast("long") - 1).alias("PNEXT"), get(8).cast("long").alias("TLEN"), get(9).alias("SEQ"), get(10).alias("QUAL"), F.to_json(F.map_from_entries(tag)).alias("TAGs"),
    )
    return _of_region(df, chrom, start, end)


def _of_region(df: DataFrame, chrom: str | None, start: int | None, end: int | None) -> DataFrame:
    if chrom is not None:
        df = df.where(F.col("RNAME") == chrom)
        df = df.where(F.col("POS") < end) if end is not None else df
        df = df.where(F.col("POS") + F.length("SEQ") > start) if start is not None else df
    return df


read_bam = read_alignments


def read_tabix(spark: SparkSession, path, chrom: str, start: int | None = None, end: int | None = None, schema: str = "bed3") -> DataFrame:
    """Rows of a region of a block-gzipped interval file. With an index beside it (.tbi) only the blocks that may hold some are read, else the whole file is."""
    try:
        lines = read_indexed_lines(spark, path, f"{path}.tbi", chrom, start or 0, end if end is not None else 1 << 29)
    except FileNotFoundError:
        return read_table(spark, path, schema).where(region_predicate((chrom, start, end)))
    fields = SCHEMAS[schema] if isinstance(schema, str) else schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    rows = lines.where(~F.col("value").startswith("#")).select(F.from_csv("value", ddl, {"sep": "\t", "nullValue": ""}).alias("r")).select("r.*")
    return rows.where(region_predicate((chrom, start, end)))


def read_pairix(spark: SparkSession, path, region1, region2=None, columns: list[str] | None = None) -> DataFrame:
    """Contacts whose first and second ends lie in two regions. Columns come from the file's #columns line unless given."""
    if columns is None:
        head = spark.read.text(path).where(F.col("value").startswith("#columns")).first()
        columns = re.split(r"[:\s]+", head[0].strip())[1:] if head else ["readID", "chrom1", "pos1", "chrom2", "pos2", "strand1", "strand2"]
    df = read_table(spark, path, columns)
    for n, region in (("1", region1), ("2", region2 if region2 is not None else region1)):
        df = df.withColumn(f"pos{n}", F.col(f"pos{n}").cast("long")).withColumn("_e", F.col(f"pos{n}") + 1)
        df = df.where(region_predicate(region, (f"chrom{n}", f"pos{n}", "_e"))).drop("_e")
    return df


def parse_gtf_attributes(attrs: Column, kv_sep: str = "=", item_sep: str = ";", quotechar: str = '"') -> Column:
    """Attributes of a GFF or GTF line as a map; of repeated keys the last counts."""
    items = F.filter(F.transform(F.split(attrs, re.escape(item_sep), -1), lambda x: F.trim(x)), lambda x: x != "")
    cut = F.transform(items, lambda x: F.split(x, re.escape(kv_sep), 2))
    value = lambda x: F.regexp_replace(F.trim(F.coalesce(F.get(x, F.lit(1)), F.lit(""))), re.escape(quotechar), "")
    pairs = F.transform(cut, lambda x: F.struct(F.trim(F.get(x, F.lit(0))).alias("key"), value(x).alias("value")))
    last = F.filter(pairs, lambda p, i: F.size(F.filter(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"])) == 0)
    return F.map_from_entries(last)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df
