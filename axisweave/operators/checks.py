"""Validators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axisweave.config import interval_cols
from axisweave.operators.joins import met, setdiff
from axisweave.operators.running import in_order


def _fail(raise_errors: bool, kind: type[Exception], text: str) -> bool:
    if raise_errors:
        raise kind(text)
    return False


def is_chrom_dtype(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.VarcharType, T.CharType))


def is_bedframe(df: DataFrame, raise_errors: bool = False, cols=None) -> bool:
    """Columns and types are right (seen in the schema alone), the triple is null only as a whole, and no start exceeds its end (one aggregate)."""
    c = interval_cols(cols)
    if not set(c) <= set(df.columns):
        return _fail(raise_errors, TypeError, "interval columns are missing")
    ok = is_chrom_dtype(df.schema[c.chrom].dataType) and all(isinstance(df.schema[x].dataType, T.IntegralType) for x in c[1:])
    if not ok:
        return _fail(raise_errors, TypeError, "interval columns have wrong types")
    nulls = sum(F.col(x).isNull().cast("int") for x in c)
    bad = df.agg(F.max((nulls > 0) & (nulls < 3)).alias("part"), F.max(F.col(c.start) > F.col(c.end)).alias("order")).first()
    if bad["part"]:
        return _fail(raise_errors, ValueError, "some intervals are partly null")
    if bad["order"]:
        return _fail(raise_errors, ValueError, "some starts exceed their ends")
    return True


def is_cataloged(df: DataFrame, view_df: DataFrame, raise_errors: bool = False, df_view_col: str = "view_region", view_name_col: str = "name") -> bool:
    """Every region name of df is in the view; nulls are passed over."""
    for frame, name in ((df, df_view_col), (view_df, view_name_col)):
        if name not in frame.columns:
            return _fail(raise_errors, ValueError, f"no column {name}")
    names = df.select(F.col(df_view_col).alias("n")).where("n is not null").distinct()
    if names.join(view_df.select(F.col(view_name_col).alias("n")), "n", "left_anti").isEmpty():
        return True
    return _fail(raise_errors, ValueError, "some region names are not in the view")


def is_overlapping(df: DataFrame, cols=None) -> bool:
    """The lengths sum to more than those of the merged intervals; equal points don't count."""
    from axisweave.operators.islands import merge

    c = interval_cols(cols)
    size = F.coalesce(F.sum(F.col(c.end) - F.col(c.start)), F.lit(0)).alias("n")
    return df.select(*c).dropna().agg(size).first()[0] > merge(df.select(*c).dropna(), cols=c).agg(size).first()[0]


def is_viewframe(df: DataFrame, raise_errors: bool = False, view_name_col: str = "name", cols=None) -> bool:
    """Intervals without nulls, with unique names, not overlapping."""
    c = interval_cols(cols)
    if view_name_col not in df.columns:
        return _fail(raise_errors, TypeError, f"no column {view_name_col}")
    if not is_bedframe(df, raise_errors, c):
        return False
    part = df.select(*c, view_name_col)
    n = part.agg(F.count("*").alias("n"), F.count_distinct(view_name_col).alias("names"), F.sum(sum(F.col(x).isNull().cast("int") for x in part.columns)).alias("nulls")).first()
    if n["nulls"]:
        return _fail(raise_errors, ValueError, "a view has no nulls")
    if n["names"] != n["n"]:
        return _fail(raise_errors, ValueError, "names are not unique")
    if is_overlapping(part, c):
        return _fail(raise_errors, ValueError, "regions overlap")
    return True


def is_contained(df: DataFrame, view_df: DataFrame, raise_errors: bool = False, df_view_col: str | None = None, view_name_col: str = "name", cols=None, cols_view=None) -> bool:
    """Every row lies within the regions that it overlaps (and overlaps one), or with df_view_col within its region."""
    c, v = interval_cols(cols), interval_cols(cols_view)
    s, e = F.col(c.start), F.col(c.end)
    rows = df.where(F.col(c.chrom).isNotNull())
    if df_view_col is None:
        out = met(rows, view_df, c, v, [], [], []).where((F.col("_s1") < F.col("_s2")) | (F.col("_e1") > F.col("_e2")))
        ok = setdiff(rows, view_df, cols1=c, cols2=v).isEmpty() and out.isEmpty()
        return True if ok else _fail(raise_errors, AssertionError, "not contained in the view")
    view = view_df.select(F.col(v.start).alias("_vs"), F.col(v.end).alias("_ve"), F.col(view_name_col).alias("_vn"))
    inside = (s >= F.col("_vs")) & (e <= F.col("_ve"))
    if not is_cataloged(df, view_df, raise_errors, df_view_col, view_name_col):
        return False
    bad = rows.join(view, F.col(df_view_col) == F.col("_vn")).where(~inside)
    return True if bad.isEmpty() else _fail(raise_errors, ValueError, "not contained in the view")


def is_covering(df: DataFrame, view_df: DataFrame, view_name_col: str = "name", cols=None, cols_view=None) -> bool:
    """Nothing of the view is left open."""
    from axisweave.operators.algebra import complement

    return complement(df, view_df, view_name_col, cols, cols_view).isEmpty()


def is_tiling(df: DataFrame, view_df: DataFrame, raise_errors: bool = False, df_view_col: str = "view_region", view_name_col: str = "name", cols=None, cols_view=None) -> bool:
    """Covering, contained and without overlaps."""
    if is_overlapping(df, cols):
        return _fail(raise_errors, ValueError, "intervals overlap")
    if not is_covering(df, view_df, view_name_col, cols, cols_view):
        return _fail(raise_errors, ValueError, "the view is not covered")
    return is_contained(df, view_df, raise_errors, df_view_col, view_name_col, cols, cols_view)


def is_sorted(df: DataFrame, view_df: DataFrame | None = None, *, order_col: str, df_view_col: str | None = None, view_name_col: str = "name", cols=None, cols_view=None) -> bool:
    """Rows in the order of order_col are in the order of sort_bedframe; where order_col is equal, any order will do.

    Each row is compared with the one before, in two levels (in_order).
    """
    from axisweave.operators.ranges import sort_key

    c, v = interval_cols(cols), interval_cols(cols_view)
    df, order = sort_key(view_df, df, df_view_col, view_name_col, c, v)
    key = F.struct(*[x for n in (([] if view_df is None else ["_view_ord"]) + list(c[view_df is not None :])) for x in (F.col(n).isNull().alias(f"{n}_null"), F.col(n))])
    per = in_order(df, order_col, key, [F.coalesce(F.max(F.col("p") > F.col("v")), F.lit(False)).alias("bad")])
    return per.where("bad or p > v").isEmpty()
