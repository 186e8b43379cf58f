"""Range selection, expansion, views and trimming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisweave.config import IntervalCols, interval_cols
from axisweave.functions.regions import parse_region
from axisweave.operators.joins import _content, _on_content, met
from axisweave.storage import numbered

LAST = 9_223_372_036_854_775_807


def region_predicate(region, cols=None) -> Column:
    """True for intervals that the region meets; the region's missing end is open, its missing start 0. Unlike joins, the region is not widened if it is a point."""
    c = interval_cols(cols)
    chrom, start, end = parse_region(region)
    s, e = F.col(c.start), F.col(c.end)
    hit = ((e > start) if end is None else (s < end) & (e > start)) | ((s == e) & (s == start))
    return (F.col(c.chrom) == chrom) & hit


def select(df: DataFrame, region, cols=None) -> DataFrame:
    """Rows of the region; the condition reaches the scan."""
    return df.where(region_predicate(region, cols))


def select_mask(df: DataFrame, region, cols=None, mask_col: str = "mask") -> DataFrame:
    return df.withColumn(mask_col, F.coalesce(region_predicate(region, cols), F.lit(False)))


def select_indices(df: DataFrame, region, cols=None, index_col: str = "index") -> DataFrame:
    """Row numbers of the rows of the region, in the order of the table's partitions."""
    return select(numbered(df, index_col), region, cols).select(index_col)


def select_labels(df: DataFrame, region, key: str, cols=None) -> DataFrame:
    """Values of the key column of the rows of the region."""
    return select(df, region, cols).select(key)


def expand(df: DataFrame, pad: int | None = None, scale: float | None = None, side: str = "both", cols=None) -> DataFrame:
    """Intervals widened by pad units on a side, or scaled about their centre. A negative pad shrinks to the middle at most."""
    c = interval_cols(cols)
    if (pad is None) == (scale is None):
        raise ValueError("give either pad or scale")
    if pad is not None and not isinstance(pad, int):
        raise ValueError("pad must be an integer")
    if scale is not None and scale < 0:
        raise ValueError("scale must not be negative")
    if side not in ("both", "left", "right"):
        raise ValueError("side must be both, left or right")
    s, e = F.col(c.start), F.col(c.end)
    if scale is not None:
        by = 0.5 * (scale - 1) * (e - s)
        lo, hi = F.bround(s - by).cast("long"), F.bround(e + by).cast("long")
    else:
        lo, hi = s - pad, e + pad
        if pad < 0:
            mid = s + ((e - s) * 0.5).cast("long")
            lo, hi = F.least(lo, mid), F.greatest(hi, mid)
    new = {}
    if side in ("both", "left"):
        new[c.start] = lo
    if side in ("both", "right"):
        new[c.end] = hi
    return df.withColumns(new)


def assign_view(df: DataFrame, view_df: DataFrame, drop_unassigned: bool = False, df_view_col: str = "view_region", view_name_col: str = "name", cols=None, cols_view=None) -> DataFrame:
    """df with the name of the region that each row overlaps most (ties: the region of smaller start, then name). Rows without one get null or, with drop_unassigned, go with all rows that have any null."""
    c, v = interval_cols(cols), interval_cols(cols_view)
    view = view_df.select(F.col(v.chrom).alias("_vc"), F.col(v.start).cast("long").alias("_vs"), F.col(v.end).cast("long").alias("_ve"), F.col(view_name_col).alias("_vn"))
    mine, names = df.select(*_content(df, c, [])).distinct(), IntervalCols("_c", "_s", "_e")
    m = met(mine, view, names, IntervalCols("_vc", "_vs", "_ve"), [], [], [F.col("_vn")])
    size = F.least("_e1", "_e2") - F.greatest("_s1", "_s2")
    m = m.groupBy(F.col("_c1").alias("_c"), F.col("_s1").alias("_s"), F.col("_e1").alias("_e")).agg(F.min(F.struct((-size).alias("l"), F.col("_s2").alias("s"), F.col("_vn").alias("n")))["n"].alias(df_view_col))
    out = df.join(m, _on_content(df, m, c, []), "left").drop("_c", "_s", "_e")
    return out.dropna() if drop_unassigned else out


def trim(df: DataFrame, view_df: DataFrame | None = None, df_view_col: str | None = None, view_name_col: str = "name", return_view_columns: bool = False, cols=None, cols_view=None) -> DataFrame:
    """Intervals cut to their region; without a view to [0, largest long). Rows without a region lose axis and coordinates, rows outside theirs become points at its border."""
    c, v = interval_cols(cols), interval_cols(cols_view)
    s, e = F.col(c.start), F.col(c.end)
    if view_df is None:
        lo, hi = F.lit(0).cast("long"), F.lit(LAST)
        return df.withColumns({c.start: F.least(F.greatest(s, lo), hi), c.end: F.least(F.greatest(e, lo), hi)}) if df_view_col is None else trim(df, None, None, cols=c)
    name = df_view_col
    if name is None:
        name = "view_region"
        if name in df.columns:
            raise ValueError("the column view_region exists")
        df = assign_view(df, view_df, df_view_col=name, view_name_col=view_name_col, cols=c, cols_view=v)
    view = view_df.select(F.col(view_name_col).alias("_vn"), F.col(v.start).alias("_vs"), F.col(v.end).alias("_ve"))
    out = df.join(view, F.col(name) == F.col("_vn"), "left")
    known = F.col("_vn").isNotNull()
    cut = lambda x: F.when(known, F.least(F.greatest(x, F.col("_vs")), F.col("_ve")))
    out = out.withColumns({c.chrom: F.when(known, F.col(c.chrom)), c.start: cut(s), c.end: cut(e)})
    keep = [x for x in out.columns if x not in ("_vn", "_vs", "_ve") and (return_view_columns or df_view_col is not None or x != name)]
    more = [F.col("_vs").alias(f"{v.start}_view"), F.col("_ve").alias(f"{v.end}_view")] if return_view_columns else []
    return out.select(*keep, *more)


def sort_key(view_df: DataFrame | None, df: DataFrame, df_view_col: str | None, view_name_col: str, c, v) -> tuple[DataFrame, list[Column]]:
    """df with a view ordinal if there is a view, and its sort columns."""
    order = [F.col(x).asc_nulls_last() for x in c]
    if view_df is None:
        return df, order
    if df_view_col is None:
        df_view_col = "_view_name"
        df = assign_view(df, view_df, df_view_col=df_view_col, view_name_col=view_name_col, cols=c, cols_view=v)
    names = [r[0] for r in view_df.select(view_name_col).collect()]  # a view is a short, ordered list of regions
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(df_view_col))
    df = df.withColumn("_view_ord", F.when(rank > 0, rank))
    return df, [F.col("_view_ord").asc_nulls_last(), *order[1:]]


def sort_bedframe(df: DataFrame, view_df: DataFrame | None = None, reset_index: bool = True, df_view_col: str | None = None, view_name_col: str = "name", cols=None, cols_view=None) -> DataFrame:
    """Rows by axis, start and end, or by the view's order of regions; what has no region comes last. Names that the view lacks raise ValueError."""
    from axisweave.operators.checks import is_cataloged

    c, v = interval_cols(cols), interval_cols(cols_view)
    if view_df is not None and df_view_col is not None and not is_cataloged(df, view_df, df_view_col=df_view_col, view_name_col=view_name_col):
        raise ValueError("a region name is not in the view")
    names = df.columns
    df, order = sort_key(view_df, df, df_view_col, view_name_col, c, v)
    return df.orderBy(*order).select(*names)
