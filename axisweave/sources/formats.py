"""Fixed field names of tabular formats and chromosome name patterns."""

from __future__ import annotations

from pyspark.sql import types as T

# fixed values: patterns of kinds of sequence names
UCSC_AUTOSOMES = r"^chr[0-9]+[A-Za-z]*$"
UCSC_SEXCHROMS = r"^chr[XYZW][A-Za-z]*$"
UCSC_NONNUCLEAR = r"^chrM$"
UCSC_OTHER = r"^chrLGE.*$"
UCSC_UNLOCALIZED = r"^chr(?!Un).+.*_random$"
UCSC_UNPLACED = r"^chrUn_.*$|^chrU[A-Za-z]*$"
UCSC_ALTCHROMS = r"^chr(?!Un).+_.*_hap\d+$|^chr(?!Un).+_.*_alt$"
NCBI_AUTOSOMES = r"^[0-9]+$"
NCBI_SEXCHROMS = r"^[XYZW]$"
NCBI_NONNUCLEAR = r"^MT$|^Pltd$"

_LONG, _INT, _DOUBLE, _STRING = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()

# fixed values: field names in file order
FIELDS: dict[str, list[str]] = {
    "bed3": ["chrom", "start", "end"],
    "bed4": ["chrom", "start", "end", "name"],
    "bed5": ["chrom", "start", "end", "name", "score"],
    "bed6": ["chrom", "start", "end", "name", "score", "strand"],
    "bed": ["chrom", "start", "end", "name", "score", "strand"],
    "bed9": ["chrom", "start", "end", "name", "score", "strand", "thickStart", "thickEnd", "itemRgb"],
    "bed12": ["chrom", "start", "end", "name", "score", "strand", "thickStart", "thickEnd", "itemRgb", "blockCount", "blockSizes", "blockStarts"],
    "bedGraph": ["chrom", "start", "end", "value"],
    "bedpe": ["chrom1", "start1", "end1", "chrom2", "start2", "end2", "name", "score", "strand1", "strand2"],
    "gff": ["chrom", "source", "feature", "start", "end", "score", "strand", "frame", "attributes"],
    "gtf": ["chrom", "source", "feature", "start", "end", "score", "strand", "frame", "attributes"],
    "pgsnp": ["chrom", "start", "end", "name", "alleleCount", "alleleFreq", "alleleScores"],
    "bedRnaElements": ["chrom", "start", "end", "name", "score", "strand", "level", "signif", "score2"],
    "narrowPeak": ["chrom", "start", "end", "name", "score", "strand", "fc", "-log10p", "-log10q", "relSummit"],
    "broadPeak": ["chrom", "start", "end", "name", "score", "strand", "fc", "-log10p", "-log10q"],
    "gappedPeak": ["chrom", "start", "end", "name", "score", "strand", "thickStart", "thickEnd", "itemRgb", "blockCount", "blockSizes", "blockStarts", "fc", "-log10p", "-log10q"],
    "jaspar": ["chrom", "start", "end", "name", "score", "pval", "strand"],
    "gap": ["bin", "chrom", "start", "end", "ix", "n", "length", "type", "bridge"],
    "centromeres": ["bin", "chrom", "start", "end", "name"],
    "cytoband": ["chrom", "start", "end", "name", "gieStain"],
    "all_mrna": [
        "bin", "matches", "misMatches", "repMatches", "nCount", "qNumInsert", "qBaseInsert", "tNumInsert", "tBaseInsert", "strand", "qName", "qSize",
        "qStart", "qEnd", "tName", "tSize", "tStart", "tEnd", "blockCount", "blockSizes", "qStarts", "tStarts",
    ],
    "sam": ["QNAME", "FLAG", "RNAME", "POS", "MAPQ", "CIGAR", "RNEXT", "PNEXT", "TLEN", "SEQ", "QUAL", "TAGs"],
    "vcf": ["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"],
}

_WHOLE = {"start", "end", "start1", "end1", "start2", "end2", "POS", "PNEXT", "TLEN", "relSummit", "length", "tStart", "tEnd", "qStart", "qEnd", "tSize", "qSize"}
_SMALL = {"score", "blockCount", "bin", "ix", "n", "FLAG", "MAPQ", "pval", "level", "alleleCount"}
_REAL = {"value", "fc", "-log10p", "-log10q", "signif", "score2"}
#: In these formats the score may be a dot or a fraction.
_TEXT_SCORE = {"gff", "gtf", "bedpe"}


def _type(schema: str, name: str) -> T.DataType:
    if name == "score" and schema in _TEXT_SCORE:
        return _STRING
    return _LONG if name in _WHOLE else _INT if name in _SMALL else _DOUBLE if name in _REAL else _STRING


SCHEMAS: dict[str, T.StructType] = {s: T.StructType([T.StructField(n, _type(s, n)) for n in names]) for s, names in FIELDS.items()}

# fixed values: name patterns of an assembly's sequences, in the order wanted
CHROM_NAME_PATTERNS: dict[str, tuple[str, ...]] = {
    "hg19": (r"^chr[0-9]+$", r"^chr[XY]$", r"^chrM$", r"^chr(?!Un).+_.*_random$", r"^chrUn_.*$", r"^chr(?!Un).+_.*_hap\d+$"),
    "hg38": (r"^chr[0-9]+$", r"^chr[XY]$", r"^chrM$", r"^chrEBV$", r"^chr(?!Un).+_.*_random$", r"^chrUn_.*$", r"^chr(?!Un).+_.*_alt$"),
    "mm9": (r"^chr[0-9]+$", r"^chr[XY]$", r"^chrM$", r"^chr(?!Un).+_random$", r"^chrUn_random$"),
    "mm10": (r"^chr[0-9]+$", r"^chr[XY]$", r"^chrM$", r"^chr(?!Un).+_random$", r"^chrUn_.*$"),
    "galGal4": (r"^chr[0-9]+$", r"^chr[ZW]$", r"^chrM$", r"^chrLGE64|chrLGE22C19W28_E50C23$", r"^chr(?!Un).+_random$", r"^chrUn_.*$"),
    "galGal5": (r"^chr[0-9]+$", r"^chr[ZW]$", r"^chrM$", r"^chrLGE64$", r"^chr(?!Un).+_random$", r"^chrUn_.*$"),
    "dm3": (r"^chr[234][LR[Het]*]*$", r"^chr[XY][Het]*$", r"^chrM$", r"^chr[U][extra]*$"),
    "dm6": (r"^chr[234][LR]*", r"^chr[XY]$", r"^chrM$", r"^chr(?!Un).+_random$", r"^chrUn_.*$"),
    "ce10": (r"chr[IV]+$", r"^chrX$", r"^chrM$"),
    "ce11": (r"chr[IV]+$", r"^chrX$", r"^chrM$"),
    "sacCer3": (r"chr[IXV]+$", r"^chrM$"),
    "TAIR10": (r"^\d+", r"^MT|Pltd$"),
}
DEFAULT_PATTERNS = (r"^chr[0-9]+$", r"^chr[XY]$", r"^chrM$")

# fixed values: lengths of the assembled sequences
CHROMSIZES: dict[str, dict[str, int]] = {
    "hg38": {
        "chr1": 248956422, "chr2": 242193529, "chr3": 198295559, "chr4": 190214555, "chr5": 181538259, "chr6": 170805979, "chr7": 159345973, "chr8": 145138636,
        "chr9": 138394717, "chr10": 133797422, "chr11": 135086622, "chr12": 133275309, "chr13": 114364328, "chr14": 107043718, "chr15": 101991189, "chr16": 90338345,
        "chr17": 83257441, "chr18": 80373285, "chr19": 58617616, "chr20": 64444167, "chr21": 46709983, "chr22": 50818468, "chrX": 156040895, "chrY": 57227415,
        "chrM": 16569, "chrEBV": 171823,
    },
}
