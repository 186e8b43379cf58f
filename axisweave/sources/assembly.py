"""Assembly metadata from a folder of seqinfo and cytoband tables."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisweave.functions.construct import from_dict
from axisweave.sources.formats import CHROMSIZES


@dataclass
class GenomeAssembly:
    """seqinfo: name, length, role, molecule, unit, aliases; cytobands: chrom, start, end, band, stain, or None."""

    organism: str
    provider: str
    provider_build: str
    release_year: str
    seqinfo: DataFrame
    cytobands: DataFrame | None = None

    @property
    def chromsizes(self) -> DataFrame:
        return self.seqinfo.select("name", F.col("length").cast("long").alias("length"))

    @property
    def chromnames(self) -> list[str]:
        return [r[0] for r in self.seqinfo.select("name").collect()]

    @property
    def viewframe(self) -> DataFrame:
        return self.seqinfo.select(F.col("name").alias("chrom"), F.lit(0).cast("long").alias("start"), F.col("length").cast("long").alias("end"), "name")

    @property
    def alias_dict(self) -> dict[str, str]:
        rows = self.seqinfo.select("name", F.explode(F.split(F.coalesce("aliases", F.lit("")), ",")).alias("a")).where("a <> ''").collect()
        return {r["a"]: r["name"] for r in rows} | {n: n for n in self.chromnames}


def _manifest(folder: str | Path) -> list[dict]:
    import yaml

    return yaml.safe_load(next(Path(folder).glob("*assemblies.y*ml")).read_text())


def assemblies_available(spark: SparkSession, folder: str | Path) -> DataFrame:
    """The folder's manifest as a table."""
    rows = [(str(x.get("organism")), str(x.get("provider")), str(x.get("provider_build")), str(x.get("release_year")), str(x.get("seqinfo"))) for x in _manifest(folder)]
    return spark.createDataFrame(rows, "organism string, provider string, provider_build string, release_year string, seqinfo string")


def assembly_info(spark: SparkSession, name: str, folder: str | Path, roles=None, units=None) -> GenomeAssembly:
    """The assembly called [provider.]build, with the given or default roles and units, or "all"."""
    provider, dot, build = name.partition(".")
    provider, build = (provider.lower(), build) if dot else ("", name)
    found = [x for x in _manifest(folder) if str(x["provider_build"]) == build and provider in ("", x["provider"])]
    if len(found) != 1:
        raise ValueError(f"{'no' if not found else 'more than one'} assembly {name}")
    x = found[0]
    read = lambda f: spark.read.csv(str(Path(folder, f)), sep="\t", header=True)
    seq = read(x["seqinfo"])
    for column, wanted in (("role", roles or x.get("default_roles")), ("unit", units or x.get("default_units"))):
        if wanted and wanted != "all":
            seq = seq.where(F.col(column).isin(list(wanted)))
    bands = read(x["cytobands"]).withColumns({c: F.col(c).cast("long") for c in ("start", "end")}) if x.get("cytobands") else None
    return GenomeAssembly(x["organism"], x["provider"], build, str(x.get("release_year")), seq, bands)


def fetch_chromsizes(spark: SparkSession, db: str, *, folder: str | Path | None = None, as_bed: bool = False) -> DataFrame:
    """Lengths of an assembly's assembled sequences, from a folder of tables or those that are built in."""
    if folder is not None:
        a = assembly_info(spark, db, folder)
        return a.viewframe.select("chrom", "start", "end") if as_bed else a.chromsizes
    if db not in CHROMSIZES:
        raise ValueError(f"no lengths of {db}")
    df = from_dict(spark, CHROMSIZES[db], ("chrom", "start", "end"))
    return df if as_bed else df.select(F.col("chrom").alias("name"), F.col("end").alias("length"))


def centromeres(cytobands: DataFrame) -> DataFrame:
    """chrom, start, end and mid of the pair of acen bands of each chromosome; ValueError where there are not two. Of a table of centromere models, which has no bands, the stretch that they cover and its middle."""
    if not {"stain", "gieStain"} & set(cytobands.columns):
        by = cytobands.groupBy("chrom").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        return by.select("chrom", "start", "end", F.floor((F.col("start") + F.col("end")) / 2).cast("long").alias("mid"))
    stain = "stain" if "stain" in cytobands.columns else "gieStain"
    by = cytobands.where(F.col(stain) == "acen").groupBy("chrom").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("end", "start").alias("mid"), F.count("*").alias("n"))
    if not by.where("n <> 2").isEmpty():
        raise ValueError("a chromosome has other than two centromere bands")
    return by.select("chrom", "start", "end", "mid")


fetch_centromeres = centromeres
