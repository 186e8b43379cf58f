"""Bins, arms, restriction fragments and composition of sequences."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axisweave.config import interval_cols
from axisweave.functions.construct import from_any
from axisweave.operators.algebra import subtract

# fixed values: recognition site and cut offset of common restriction enzymes
ENZYMES = {
    "AluI": ("AGCT", 2), "BamHI": ("GGATCC", 1), "BglII": ("AGATCT", 1), "DpnII": ("GATC", 0), "EcoRI": ("GAATTC", 1), "EcoRV": ("GATATC", 3),
    "HaeIII": ("GGCC", 2), "HindIII": ("AAGCTT", 1), "KpnI": ("GGTACC", 5), "MboI": ("GATC", 0), "MseI": ("TTAA", 1), "MspI": ("CCGG", 1),
    "NcoI": ("CCATGG", 1), "NdeI": ("CATATG", 2), "NlaIII": ("CATG", 4), "NotI": ("GCGGCCGC", 2), "PstI": ("CTGCAG", 5), "SacI": ("GAGCTC", 5),
    "SalI": ("GTCGAC", 1), "SmaI": ("CCCGGG", 3), "SphI": ("GCATGC", 5), "XbaI": ("TCTAGA", 1), "XhoI": ("CTCGAG", 1),
}


def binnify(chromsizes: DataFrame, binsize: int, rel_ids: bool = False, cols=None) -> DataFrame:
    """Tiles of binsize units over each axis (columns name, length or an interval triple); the last ends with the axis."""
    if not isinstance(binsize, int) or binsize < 1:
        raise ValueError("binsize must be a positive integer")
    c = interval_cols(cols)
    name, length = ("name", "length") if "length" in chromsizes.columns else (c.chrom, c.end)
    df = chromsizes.where(F.col(length) > 0).select(F.col(name).alias(c.chrom), F.col(length).cast("long").alias("_n"))
    df = df.withColumn(c.start, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(binsize).cast("long"))))
    cols_ = [c.chrom, c.start, F.least(F.col(c.start) + binsize, F.col("_n")).alias(c.end)]
    return df.select(*cols_, *([F.call_function("div", F.col(c.start), F.lit(binsize)).alias("rel_id")] if rel_ids else []))


def make_chromarms(spark: SparkSession, chromsizes, midpoints, cols_chroms=("chrom", "length"), cols_mids=("chrom", "mid"), suffixes=("_p", "_q")) -> DataFrame:
    """chrom, start, end, name of the arms on either side of each midpoint; an axis without a midpoint is one arm with the first suffix, one with more than two arms an error."""

    def pairs(x, names):
        return x.select(*[F.col(n) for n in names]) if isinstance(x, DataFrame) else spark.createDataFrame([(str(k), int(v)) for k, v in dict(x).items()], f"`{names[0]}` string, `{names[1]}` long")

    size = pairs(chromsizes, cols_chroms).select(F.col(cols_chroms[0]).alias("chrom"), F.lit(0).cast("long").alias("start"), F.col(cols_chroms[1]).cast("long").alias("end"))
    mid = pairs(midpoints, cols_mids).select(F.col(cols_mids[0]).alias("chrom"), F.col(cols_mids[1]).cast("long").alias("start"), F.col(cols_mids[1]).cast("long").alias("end"))
    arms = subtract(size, mid, return_index=True, cols1=("chrom", "start", "end"), cols2=("chrom", "start", "end"))
    if not arms.where("sub_index_ > 1").isEmpty():
        raise ValueError("more than two arms")
    name = F.concat("chrom", F.when(F.col("sub_index_") == 0, suffixes[0]).otherwise(suffixes[1]))
    return arms.select("chrom", "start", "end", name.alias("name"))


def digest(sequences: DataFrame, enzyme: str, *, name: str = "chrom", seq: str = "seq") -> DataFrame:
    """chrom, start, end of the fragments that an enzyme cuts each sequence into; the cut lies one unit after the enzyme's 1-based site position."""
    if enzyme not in ENZYMES:
        raise ValueError(f"unknown enzyme {enzyme}")
    site, offset = ENZYMES[enzyme]
    pattern = f"(?={re.escape(site)})"
    # lengths of what lies between site starts give their positions
    part = F.split(F.upper(seq), pattern, -1)
    starts = F.aggregate(F.slice(F.transform(part, F.length), 1, F.greatest(F.size(part) - 1, F.lit(0))), F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    at_start = F.upper(seq).startswith(site)
    cuts = F.transform(F.filter(starts, lambda x, i: (i > 0) | at_start), lambda x: (x + offset + 2).cast("long"))
    edges = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), F.filter(cuts, lambda x: x < F.length(seq)), F.array(F.length(seq).cast("long")))))
    df = sequences.select(F.col(name).alias("chrom"), F.posexplode(edges).alias("_i", "end"), edges.alias("_e"))
    return df.where("_i > 0").select("chrom", F.get("_e", F.col("_i") - 1).alias("start"), "end")


def _count(seq: Column, chars: str) -> Column:
    return F.length(seq) - F.length(F.translate(seq, chars, ""))


def seq_gc(seq: Column, mapped_only: bool = True) -> Column:
    """Share of G and C among all letters, or among those that are not N; null where there are none."""
    total = F.length(seq) - (_count(seq, "Nn") if mapped_only else F.lit(0))
    return F.when(total > 0, _count(seq, "GgCc") / total)


def _slices(df: DataFrame, sequences: DataFrame, c) -> DataFrame:
    s = sequences.select(F.col("chrom").alias("_sc"), F.col("seq").alias("_seq"))
    out = df.join(s, F.col(c.chrom) == F.col("_sc"), "left")
    return out.withColumn("_part", F.substring(F.col("_seq"), (F.col(c.start) + 1).cast("int"), (F.col(c.end) - F.col(c.start)).cast("int"))).drop("_seq")


def _known(df: DataFrame, c) -> None:
    if not df.where(F.col("_sc").isNull() & F.col(c.chrom).isNotNull()).isEmpty():
        raise ValueError("a chromosome has no sequence")


def frac_mapped(df: DataFrame, sequences: DataFrame, return_input: bool = True, cols=None) -> DataFrame:
    """df with frac_mapped: the share of letters other than N; 0 for an empty stretch."""
    c = interval_cols(cols)
    out = _slices(df, sequences, c)
    _known(out, c)
    n = F.length("_part")
    value = F.when(n > 0, 1 - _count(F.col("_part"), "Nn") / n).otherwise(F.lit(0.0)).alias("frac_mapped")
    return out.select(*(df.columns if return_input else []), value)


def frac_gc(df: DataFrame, sequences: DataFrame, mapped_only: bool = True, return_input: bool = True, cols=None) -> DataFrame:
    """df with GC, the share of G and C of each row's own stretch."""
    c = interval_cols(cols)
    out = _slices(df, sequences, c)
    _known(out, c)
    return out.select(*(df.columns if return_input else []), seq_gc(F.col("_part"), mapped_only).alias("GC"))


def frac_gene_coverage(df: DataFrame, mrna: DataFrame, cols=None) -> DataFrame:
    """df with coverage and count by transcripts (columns tName, tStart, tEnd)."""
    from axisweave.operators.joins import count_overlaps, coverage

    c = interval_cols(cols)
    genes = mrna.select(F.col("tName").alias("chrom"), F.col("tStart").cast("long").alias("start"), F.col("tEnd").cast("long").alias("end"))
    return count_overlaps(coverage(df, genes, cols1=c, cols2=("chrom", "start", "end")), genes, cols1=c, cols2=("chrom", "start", "end"))


# fixed values: the CSS colour names
COLORS = {
    "aliceblue": "f0f8ff", "antiquewhite": "faebd7", "aqua": "00ffff", "aquamarine": "7fffd4", "azure": "f0ffff", "beige": "f5f5dc", "bisque": "ffe4c4",
    "black": "000000", "blanchedalmond": "ffebcd", "blue": "0000ff", "blueviolet": "8a2be2", "brown": "a52a2a", "burlywood": "deb887", "cadetblue": "5f9ea0",
    "chartreuse": "7fff00", "chocolate": "d2691e", "coral": "ff7f50", "cornflowerblue": "6495ed", "cornsilk": "fff8dc", "crimson": "dc143c", "cyan": "00ffff",
    "darkblue": "00008b", "darkcyan": "008b8b", "darkgoldenrod": "b8860b", "darkgray": "a9a9a9", "darkgreen": "006400", "darkgrey": "a9a9a9",
    "darkkhaki": "bdb76b", "darkmagenta": "8b008b", "darkolivegreen": "556b2f", "darkorange": "ff8c00", "darkorchid": "9932cc", "darkred": "8b0000",
    "darksalmon": "e9967a", "darkseagreen": "8fbc8f", "darkslateblue": "483d8b", "darkslategray": "2f4f4f", "darkslategrey": "2f4f4f",
    "darkturquoise": "00ced1", "darkviolet": "9400d3", "deeppink": "ff1493", "deepskyblue": "00bfff", "dimgray": "696969", "dimgrey": "696969",
    "dodgerblue": "1e90ff", "firebrick": "b22222", "floralwhite": "fffaf0", "forestgreen": "228b22", "fuchsia": "ff00ff", "gainsboro": "dcdcdc",
    "ghostwhite": "f8f8ff", "gold": "ffd700", "goldenrod": "daa520", "gray": "808080", "green": "008000", "greenyellow": "adff2f", "grey": "808080",
    "honeydew": "f0fff0", "hotpink": "ff69b4", "indianred": "cd5c5c", "indigo": "4b0082", "ivory": "fffff0", "khaki": "f0e68c", "lavender": "e6e6fa",
    "lavenderblush": "fff0f5", "lawngreen": "7cfc00", "lemonchiffon": "fffacd", "lightblue": "add8e6", "lightcoral": "f08080", "lightcyan": "e0ffff",
    "lightgoldenrodyellow": "fafad2", "lightgray": "d3d3d3", "lightgreen": "90ee90", "lightgrey": "d3d3d3", "lightpink": "ffb6c1", "lightsalmon": "ffa07a",
    "lightseagreen": "20b2aa", "lightskyblue": "87cefa", "lightslategray": "778899", "lightslategrey": "778899", "lightsteelblue": "b0c4de",
    "lightyellow": "ffffe0", "lime": "00ff00", "limegreen": "32cd32", "linen": "faf0e6", "magenta": "ff00ff", "maroon": "800000",
    "mediumaquamarine": "66cdaa", "mediumblue": "0000cd", "mediumorchid": "ba55d3", "mediumpurple": "9370db", "mediumseagreen": "3cb371",
    "mediumslateblue": "7b68ee", "mediumspringgreen": "00fa9a", "mediumturquoise": "48d1cc", "mediumvioletred": "c71585", "midnightblue": "191970",
    "mintcream": "f5fffa", "mistyrose": "ffe4e1", "moccasin": "ffe4b5", "navajowhite": "ffdead", "navy": "000080", "oldlace": "fdf5e6", "olive": "808000",
    "olivedrab": "6b8e23", "orange": "ffa500", "orangered": "ff4500", "orchid": "da70d6", "palegoldenrod": "eee8aa", "palegreen": "98fb98",
    "paleturquoise": "afeeee", "palevioletred": "db7093", "papayawhip": "ffefd5", "peachpuff": "ffdab9", "peru": "cd853f", "pink": "ffc0cb", "plum": "dda0dd",
    "powderblue": "b0e0e6", "purple": "800080", "rebeccapurple": "663399", "red": "ff0000", "rosybrown": "bc8f8f", "royalblue": "4169e1",
    "saddlebrown": "8b4513", "salmon": "fa8072", "sandybrown": "f4a460", "seagreen": "2e8b57", "seashell": "fff5ee", "sienna": "a0522d", "silver": "c0c0c0",
    "skyblue": "87ceeb", "slateblue": "6a5acd", "slategray": "708090", "slategrey": "708090", "snow": "fffafa", "springgreen": "00ff7f",
    "steelblue": "4682b4", "tan": "d2b48c", "teal": "008080", "thistle": "d8bfd8", "tomato": "ff6347", "turquoise": "40e0d0", "violet": "ee82ee",
    "wheat": "f5deb3", "white": "ffffff", "whitesmoke": "f5f5f5", "yellow": "ffff00", "yellowgreen": "9acd32",
}


def to_ucsc_colorstring(color) -> str:
    """A name, #rgb, #rrggbb or tuple of shares as "r,g,b"; none and null are "0"."""
    if color is None or (isinstance(color, float) and color != color) or (isinstance(color, str) and color.lower() in ("none", "")):
        return "0"
    if isinstance(color, str):
        h = COLORS.get(color.lower(), color.removeprefix("#"))
        h = "".join(x * 2 for x in h) if len(h) == 3 else h
        if not re.fullmatch(r"[0-9a-fA-F]{6}", h):
            raise ValueError(f"unknown colour {color}")
        return ",".join(str(int(h[i : i + 2], 16)) for i in (0, 2, 4))
    return ",".join(str(int(x * 255)) for x in tuple(color)[:3])


def natural_key(name: Column) -> Column:
    """A sort key in which numbers inside names count by value."""
    return F.regexp_replace(F.regexp_replace(name, r"(\d+)", "00000000000000000000$1"), r"0+(\d{20})(?!\d)", "$1")


def chromsizes_frame(spark: SparkSession, sizes) -> DataFrame:
    c = interval_cols()
    df = from_any(spark, sizes)
    return df.select(F.col(c.chrom).alias("name"), F.col(c.end).cast(T.LongType()).alias("length"))


def natsorted(df: DataFrame, name: str) -> DataFrame:
    return df.orderBy(natural_key(F.col(name)), name)
