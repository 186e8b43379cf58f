"""Interval tables from dicts, lists and strings, and their repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisweave.config import interval_cols
from axisweave.functions.regions import parse_region_string, ucsc_string


def _frame(spark: SparkSession, rows: list, c, name_col: str | None = None) -> DataFrame:
    schema = f"`{c.chrom}` string, `{c.start}` long, `{c.end}` long" + (f", `{name_col}` string" if name_col else "")
    return spark.createDataFrame(rows, schema)


def from_dict(spark: SparkSession, regions: dict, cols=None) -> DataFrame:
    """{chrom: length} as intervals from 0."""
    c = interval_cols(cols)
    if any(isinstance(v, (list, tuple, dict, set)) for v in regions.values()):
        raise ValueError("values must be lengths")
    return _frame(spark, [(str(k), 0, int(v)) for k, v in regions.items()], c)


def from_series(spark: SparkSession, regions, cols=None) -> DataFrame:
    """A pandas Series of lengths by chromosome."""
    return from_dict(spark, dict(regions.items()), cols)


def from_list(spark: SparkSession, regions: list, name_col: str = "name", cols=None) -> DataFrame:
    """Tuples (chrom, start, end) or (chrom, start, end, name)."""
    sizes = {len(r) for r in regions}
    if not sizes <= {3} and not sizes <= {4}:
        raise ValueError("tuples must have three or four parts")
    return _frame(spark, [tuple(r) for r in regions], interval_cols(cols), name_col if sizes == {4} else None)


def from_ucsc_string_list(spark: SparkSession, regions: list[str], cols=None) -> DataFrame:
    return _frame(spark, [tuple(parse_region_string(r)) for r in regions], interval_cols(cols))


def from_any(spark: SparkSession, regions, fill_null: bool | dict = False, name_col: str = "name", cols=None) -> DataFrame:
    """Intervals from a Spark or pandas frame, dict, Series, region string, tuple or list of these; fill_null puts 0 and the chromosome's length (a dict) for missing coordinates."""
    import pandas as pd

    c = interval_cols(cols)
    if isinstance(regions, DataFrame):
        df = regions
    elif isinstance(regions, pd.DataFrame):
        df = spark.createDataFrame(regions)
    elif isinstance(regions, pd.Series):
        df = from_series(spark, regions, c)
    elif isinstance(regions, dict):
        df = from_dict(spark, regions, c)
    elif isinstance(regions, str):
        df = from_ucsc_string_list(spark, [regions], c)
    elif isinstance(regions, tuple):
        df = from_list(spark, [regions], name_col, c)
    elif isinstance(regions, list):
        df = from_ucsc_string_list(spark, regions, c) if regions and all(isinstance(r, str) for r in regions) else from_list(spark, regions, name_col, c)
    else:
        raise ValueError(f"unknown kind of regions: {type(regions)}")
    if fill_null is not False and fill_null is not None:
        sizes = fill_null if isinstance(fill_null, dict) else {}
        length = F.coalesce(*[F.when(F.col(c.chrom) == k, F.lit(int(v))) for k, v in sizes.items()], F.lit(None).cast("long"))
        df = df.withColumn(c.start, F.coalesce(c.start, F.lit(0).cast("long"))).withColumn(c.end, F.coalesce(F.col(c.end), length))
        if df.where(F.col(c.end).isNull() & F.col(c.chrom).isNotNull()).take(1):
            raise ValueError("no length known for a chromosome without an end")
    return df


def add_ucsc_name_column(df: DataFrame, name_col: str = "name", cols=None) -> DataFrame:
    c = interval_cols(cols)
    return df.withColumn(name_col, ucsc_string(F.col(c.chrom), F.col(c.start), F.col(c.end)))


def make_viewframe(spark: SparkSession, regions, check_bounds=None, name_style: str | None = None, view_name_col: str = "name", cols=None) -> DataFrame:
    """A valid view: names from the input, the chromosome, or (name_style "ucsc") the region."""
    from axisweave.operators.checks import is_contained, is_viewframe

    c = interval_cols(cols)
    df = from_any(spark, regions, name_col=view_name_col, cols=c)
    if view_name_col not in df.columns:
        if name_style is None:
            df = df.withColumn(view_name_col, F.col(c.chrom))
        elif name_style.lower() == "ucsc":
            df = add_ucsc_name_column(df, view_name_col, c)
        else:
            raise ValueError("name_style must be None or 'ucsc'")
    is_viewframe(df, raise_errors=True, view_name_col=view_name_col, cols=c)
    if check_bounds is not None and not is_contained(df, make_viewframe(spark, check_bounds, cols=c), cols=c, cols_view=c):
        raise ValueError("regions out of bounds")
    return df


def sanitize_bedframe(df: DataFrame, recast_dtypes: bool = True, drop_null: bool = False, start_exceed_end_action: str | None = None, cols=None) -> DataFrame:
    """Cast the triple, make it all null where one is null, and flip or drop intervals whose start exceeds their end."""
    c = interval_cols(cols)
    if recast_dtypes:
        df = df.withColumn(c.chrom, F.col(c.chrom).cast("string")).withColumn(c.start, F.col(c.start).try_cast("long")).withColumn(c.end, F.col(c.end).try_cast("long"))
    whole = F.col(c.chrom).isNotNull() & F.col(c.start).isNotNull() & F.col(c.end).isNotNull()
    df = df.withColumns({x: F.when(whole, F.col(x)) for x in c})
    if drop_null:
        df = df.dropna()
    action = (start_exceed_end_action or "").lower()
    if action == "flip":
        df = df.withColumns({c.start: F.least(c.start, c.end), c.end: F.greatest(c.start, c.end)})
    elif action == "drop":
        df = df.where(F.col(c.start).isNull() | (F.col(c.start) <= F.col(c.end)))
    elif action:
        raise ValueError("start_exceed_end_action must be flip, drop or None")
    return df
