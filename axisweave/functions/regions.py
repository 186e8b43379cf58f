"""Region strings and tuples."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"": 1, "k": 1_000, "m": 1_000_000, "g": 1_000_000_000}
_NUMBER = re.compile(r"^\s*(\d[\d,]*(?:\.\d+)?|\.\d+)\s*([kmg]?)b?\s*$", re.IGNORECASE)


class Region(NamedTuple):
    chrom: str
    start: int | None
    end: int | None


def humanized_int(text: str) -> int:
    """"1.5kb" is 1500; thousands separators are ignored and fractions cut off."""
    m = _NUMBER.match(text)
    if not m:
        raise ValueError(f"not a coordinate: {text!r}")
    return int(float(m[1].replace(",", "")) * _UNITS[m[2].lower()])


def parse_region_string(text: str) -> Region:
    """chrom, chrom:start- or chrom:start-end."""
    parts = text.split(":")
    if not parts[0].strip():
        raise ValueError(f"no chromosome in {text!r}")
    if len(parts) < 2:
        return Region(parts[0].strip(), None, None)
    start, dash, end = parts[1].partition("-")
    if not dash:
        raise ValueError(f"no range in {text!r}")
    a = humanized_int(start)
    b = humanized_int(end) if end.strip() else None
    if b is not None and b < a:
        raise ValueError(f"end before start in {text!r}")
    return Region(parts[0].strip(), a, b)


def parse_region(region, chromsizes: dict | None = None, *, check_bounds: bool = True) -> Region:
    """A string or tuple as a region: a missing start is 0, a missing end the chromosome's length if that is known; with check_bounds a start below 0 and an end beyond a known length raise ValueError."""
    if isinstance(region, str):
        chrom, start, end = parse_region_string(region)
    else:
        if len(region) < 3:
            raise ValueError("a region has a chromosome, a start and an end")
        chrom, start, end = tuple(region)[:3]
        chrom, start, end = str(chrom), None if start is None else int(start), None if end is None else int(end)
    start = 0 if start is None else start
    if chromsizes is not None:
        if chrom not in chromsizes:
            raise ValueError(f"unknown chromosome {chrom}")
        length = int(chromsizes[chrom])
        end = length if end is None else end
    else:
        length = None
    if end is not None and end < start:
        raise ValueError("end before start")
    if check_bounds and (start < 0 or (length is not None and end > length)):
        raise ValueError(f"{chrom}:{start}-{end} is out of bounds")
    return Region(chrom, start, end)


def to_ucsc_string(region) -> str:
    return "{}:{}-{}".format(*region)


def is_complete_ucsc_string(text) -> bool:
    if not isinstance(text, str):
        return False
    try:
        r = parse_region_string(text)
    except ValueError:
        return False
    return r.end is not None


def ucsc_string(chrom: Column, start: Column, end: Column) -> Column:
    return F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def region_columns(text: Column) -> tuple[Column, Column, Column]:
    """chrom, start and end of a column of region strings; missing coordinates are null."""

    def number(group: int) -> Column:
        raw = F.regexp_extract(text, r"^[^:]+:\s*([\d,.]+)\s*([kKmMgG]?)[bB]?\s*-\s*(?:([\d,.]+)\s*([kKmMgG]?)[bB]?)?\s*$", group)
        unit = F.lower(F.regexp_extract(text, r"^[^:]+:\s*([\d,.]+)\s*([kKmMgG]?)[bB]?\s*-\s*(?:([\d,.]+)\s*([kKmMgG]?)[bB]?)?\s*$", group + 1))
        times = F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "g", 1e9).otherwise(1.0)
        return F.when(raw != "", F.floor(F.replace(raw, F.lit(","), F.lit("")).try_cast("double") * times).cast("long"))

    return F.trim(F.substring_index(text, ":", 1)), number(1), number(3)
