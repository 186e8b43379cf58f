"""BED writer with field checks, and bedGraph files for external converters."""

from __future__ import annotations

import re
import shutil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axisweave.operators.running import in_order
from axisweave.sources.formats import FIELDS

BED12 = FIELDS["bed12"]
_WHOLE = {"start", "end", "thickStart", "thickEnd", "blockCount"}


def parse_bed_schema(schema: str) -> tuple[int, bool]:
    """"bed6+" is (6, True); without a number 6."""
    m = re.fullmatch(r"bed(\d*)(\+\d*)?", schema)
    if not m:
        raise ValueError(f"not a BED schema: {schema}")
    n = int(m[1] or 6)
    if not 3 <= n <= 12 or n in (10, 11):
        raise ValueError(f"there is no BED{n}")
    return n, m[2] is not None


def infer_bed_schema(df: DataFrame) -> tuple[int, bool]:
    """The largest BED size whose last field is there, and whether there are other columns."""
    n = next(n for n in (12, 9, 8, 7, 6, 5, 4, 3) if BED12[n - 1] in df.columns)
    return n, bool(set(df.columns) - set(BED12[:n]))


def _numbers(c: str) -> Column:
    return F.transform(F.filter(F.split(c, ",", -1), lambda x: F.trim(x) != ""), lambda x: x.try_cast("long"))


def field_checks(fields: list[str], chromsizes: dict[str, int] | None = None, strict_score: bool = False) -> dict[str, Column]:
    """Named conditions that every row must meet."""
    c, s, e = F.col("chrom"), F.col("start"), F.col("end")
    out: dict[str, Column] = {"chrom_length": (F.length(c) >= 1) & (F.length(c) <= 255), "chrom_word": c.rlike(r"^\w+$"), "start_not_negative": s >= 0, "end_not_negative": e >= 0, "start_before_end": s <= e}
    if chromsizes:
        size = F.coalesce(*[F.when(c == k, F.lit(int(v))) for k, v in chromsizes.items()], F.lit(None).cast("long"))
        out |= {"chrom_known": size.isNotNull(), "start_in_chrom": s < size, "end_in_chrom": e <= size}
    if "name" in fields:
        out |= {"name_length": F.length("name").between(1, 255), "name_printable": F.col("name").rlike(r"^[\x20-\x7e]+$")}
    if "score" in fields and strict_score:
        out |= {"score_whole": F.col("score") == F.floor("score"), "score_range": F.col("score").between(0, 1000)}
    if "strand" in fields:
        out["strand_known"] = F.col("strand").isin("+", "-", ".", "?")
    if "thickStart" in fields:
        out |= {"thick_start_not_before": F.col("thickStart") >= s, "thick_start_not_after": F.col("thickStart") <= e}
    if "thickEnd" in fields:
        out |= {"thick_end_not_before": F.col("thickEnd") >= F.col("thickStart"), "thick_end_not_after": F.col("thickEnd") <= e}
    if "itemRgb" in fields:
        rgb = F.split(F.col("itemRgb").cast("string"), ",", -1)
        out["item_rgb"] = (F.col("itemRgb").cast("string") == "0") | ((F.size(rgb) == 3) & F.forall(rgb, lambda x: F.coalesce(x.try_cast("int").between(0, 255), F.lit(False))))
    if "blockCount" in fields:
        out["block_count"] = F.col("blockCount") > 0
        sizes, starts = _numbers("blockSizes"), _numbers("blockStarts")
        n, last = F.col("blockCount"), F.col("blockCount") - 1
        ends = F.zip_with(starts, sizes, lambda a, b: a + b)
        out |= {
            "block_sizes_count": F.size(sizes) == n, "block_sizes_numbers": F.forall(sizes, lambda x: x.isNotNull()), "block_sizes_positive": F.forall(sizes, lambda x: x > 0),
            "block_starts_count": F.size(starts) == n, "block_starts_numbers": F.forall(starts, lambda x: x.isNotNull()), "block_starts_sorted": starts == F.array_sort(starts),
            "block_first_at_start": F.get(starts, F.lit(0)) == 0, "block_last_at_end": F.get(ends, last.cast("int")) == e - s,
            "blocks_apart": F.forall(F.zip_with(F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))), F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), lambda a, b: a <= b), lambda x: F.coalesce(x, F.lit(False))),
        }
    return out


def validate_bed_fields(df: DataFrame, n: int, chromsizes: dict[str, int] | None = None, strict_score: bool = False) -> dict[str, bool]:
    """Each condition's verdict, in one aggregate; wrong column types raise TypeError."""
    fields = BED12[:n]
    for f in fields:
        if f in df.columns and f in _WHOLE and not isinstance(df.schema[f].dataType, T.IntegralType):
            raise TypeError(f"{f} must be a whole number")
        if f in ("chrom", "name", "strand") and f in df.columns and not isinstance(df.schema[f].dataType, T.StringType):
            raise TypeError(f"{f} must be a string")
    checks = field_checks([f for f in fields if f in df.columns], chromsizes, strict_score)
    row = df.agg(*[F.coalesce(F.min(v), F.lit(True)).alias(k) for k, v in checks.items()]).first()
    return row.asDict()


def check_is_sorted(df: DataFrame, order_col: str) -> bool:
    """Chromosomes in one block each and starts and ends in order, by the order of order_col."""
    v, p = (lambda c: F.col("v")[c]), (lambda c: F.col("p")[c])
    new = F.coalesce(p("chrom") != v("chrom"), F.lit(True))
    bad = F.coalesce(~new & ((v("start") < p("start")) | ((v("start") == p("start")) & (v("end") < p("end")))), F.lit(False))
    # a range's first row is compared with the range before, so that it counts there alone
    within = F.when(F.col("p").isNotNull(), new.cast("long"))
    per = in_order(df, order_col, F.struct("chrom", "start", "end"), [F.sum(within).alias("blocks"), F.max(bad).alias("bad")])
    r = per.agg(F.sum(F.coalesce("blocks", F.lit(0)) + new.cast("long")).alias("blocks"), F.coalesce(F.max(F.col("bad") | bad), F.lit(False)).alias("bad")).first()
    return not r["bad"] and (r["blocks"] or 0) == df.agg(F.count_distinct("chrom")).first()[0]


def to_bed_dataframe(df: DataFrame, schema: str = "infer", validate_fields: bool = True, chromsizes: dict[str, int] | None = None, strict_score: bool = False) -> DataFrame:
    """Fields of the schema in order, missing ones filled (name and strand ".", score and itemRgb 0, thick ends the interval's); other columns follow if the schema is extended."""
    n, extended = infer_bed_schema(df) if schema == "infer" else parse_bed_schema(schema)
    fields = BED12[:n]
    need = [f for f in fields if f in ("chrom", "start", "end") or f.startswith("block")]
    if missing := [f for f in need if f not in df.columns]:
        raise ValueError(f"columns are missing: {missing}")
    if validate_fields:
        bad = [k for k, v in validate_bed_fields(df, n, chromsizes, strict_score).items() if not v]
        if bad:
            raise ValueError(f"fields are not valid: {bad}")
    fill = {"name": F.lit("."), "score": F.lit(0), "strand": F.lit("."), "itemRgb": F.lit("0"), "thickStart": F.col("start"), "thickEnd": F.col("end")}
    col = lambda f: (F.coalesce(F.col(f), fill[f].cast(df.schema[f].dataType)) if f in fill else F.col(f)) if f in df.columns else fill[f]
    rest = [F.col(f"`{c}`") for c in df.columns if c not in fields] if extended else []
    return df.select(*[col(f).alias(f) for f in fields], *rest)


def to_bed(df: DataFrame, path: str | None = None, *, schema: str = "infer", validate_fields: bool = True, require_sorted: bool = False, order_col: str | None = None, chromsizes=None, strict_score: bool = False, na_rep: str = "nan") -> str | None:
    """Write tab-separated files to the folder path, or without one give the text (of a table small enough for the driver)."""
    if require_sorted and not check_is_sorted(df, order_col):
        raise ValueError("rows are not sorted")
    out = to_bed_dataframe(df, schema, validate_fields, chromsizes, strict_score)
    if path is not None:
        out.write.csv(path, sep="\t", header=False, nullValue=na_rep, quote="\u0000")
        return None
    rows = out.toLocalIterator()
    return "".join("\t".join(na_rep if v is None else str(v) for v in r) + "\n" for r in rows)


def to_bedgraph(df: DataFrame, path: str, value_field: str | None = None) -> None:
    """Sorted chrom, start, end and value as one text folder, what the bigWig converters read."""
    value = value_field or next(c for c in df.columns if c not in ("chrom", "start", "end"))
    df.select("chrom", "start", "end", value).orderBy("chrom", "start").write.csv(path, sep="\t", header=False)


def find_converter(tool: str, path: str | None = None) -> str:
    """Full path of an external converter; ValueError where it is not installed."""
    found = shutil.which(tool, path=path)
    if not found:
        raise ValueError(f"{tool} is not installed")
    return found


def _convert(tool: str, df: DataFrame, chromsizes: dict[str, int], outpath: str, binary: str | None, *args: str) -> None:
    import subprocess
    import tempfile
    from pathlib import Path

    program = find_converter(tool, binary)
    with tempfile.TemporaryDirectory() as d:
        rows, sizes = Path(d, "rows"), Path(d, "sizes")
        with rows.open("w") as f:  # these formats are one file, written by one process
            for r in df.orderBy("chrom", "start").toLocalIterator():
                f.write("\t".join(map(str, r)) + "\n")
        sizes.write_text("".join(f"{k}\t{v}\n" for k, v in chromsizes.items()))
        subprocess.run([program, *args, str(rows), str(sizes), outpath], check=True)


def to_bigwig(df: DataFrame, chromsizes: dict[str, int], outpath: str, value_field: str | None = None, path_to_binary: str | None = None) -> None:
    value = value_field or next(c for c in df.columns if c not in ("chrom", "start", "end"))
    _convert("bedGraphToBigWig", df.select("chrom", "start", "end", value), chromsizes, outpath, path_to_binary)


def to_bigbed(df: DataFrame, chromsizes: dict[str, int], outpath: str, schema: str = "infer", path_to_binary: str | None = None) -> None:
    n, _ = infer_bed_schema(df) if schema == "infer" else parse_bed_schema(schema)
    _convert("bedToBigBed", to_bed_dataframe(df, schema), chromsizes, outpath, path_to_binary, f"-type=bed{n}")
