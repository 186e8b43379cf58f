"""Tables of a genome browser's download area, copied to the shared folder and read from there."""

from __future__ import annotations

import base64
import uuid
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession

from axisweave.sources.assembly import centromeres
from axisweave.sources.formats import DEFAULT_PATTERNS
from axisweave.sources.readers import read_chromsizes, read_table
from axisweave.storage import shared_folder

#: Bytes that are copied at once.
PIECE = 1 << 20


def copied(spark: SparkSession, url: str) -> str:
    """Path of a copy of the file at url in the folder of spark.checkpoint.dir; it passes through the driver in pieces."""
    path = f"{shared_folder(spark)}/download-{uuid.uuid4().hex}-{url.rpartition('/')[2]}"
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    decoder = jvm.java.util.Base64.getDecoder()
    with urlopen(url) as f:
        out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
        while piece := f.read(PIECE):
            out.write(decoder.decode(base64.b64encode(piece).decode()))
        out.close()
    return path


class BrowserTables:
    """Chromosome sizes, centromeres, gaps, bands and transcripts of one assembly, as the public download area lays them out."""

    def __init__(self, spark: SparkSession, db: str, base: str = "https://hgdownload.soe.ucsc.edu/"):
        self.spark, self.db, self.base = spark, db, f"{base.rstrip('/')}/goldenPath/{db}"

    def _table(self, name: str, schema: str, **options) -> DataFrame:
        return read_table(self.spark, copied(self.spark, f"{self.base}/database/{name}.txt.gz"), schema, **options)

    def fetch_chromsizes(self, filter_chroms: bool = True, chrom_patterns=DEFAULT_PATTERNS, natsort: bool = True, as_bed: bool = False, **options) -> DataFrame:
        path = copied(self.spark, f"{self.base}/bigZips/{self.db}.chrom.sizes")
        return read_chromsizes(self.spark, path, filter_chroms, chrom_patterns, natsort, as_bed, **options)

    def fetch_centromeres(self, **options) -> DataFrame:
        return self._table("centromeres", "centromeres", **options)

    def fetch_gaps(self, **options) -> DataFrame:
        return self._table("gap", "gap", **options).select("chrom", "start", "end", "length", "type", "bridge")

    def fetch_cytoband(self, ideo: bool = False, **options) -> DataFrame:
        return self._table("cytoBandIdeo" if ideo else "cytoBand", "cytoband", **options)

    def fetch_mrna(self, **options) -> DataFrame:
        return self._table("all_mrna", "all_mrna", **options)

    def origins(self) -> DataFrame:
        """chrom, start, end and mid of the centromeres: by the models where there is such a table, else by the bands."""
        try:
            return centromeres(self.fetch_centromeres())
        except OSError:
            return centromeres(self.fetch_cytoband())
