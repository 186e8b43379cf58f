"""Complement and subtraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axisweave.config import IntervalCols, interval_cols
from axisweave.operators.joins import met
from axisweave.operators.ranges import LAST
from axisweave.operators.running import running, stretch_of
from axisweave.storage import numbered, stored


def complement(df: DataFrame, view_df: DataFrame | None = None, view_name_col: str = "name", cols=None, cols_view=None) -> DataFrame:
    """chrom, start, end, view_region of what df leaves open of each region; without a view of [0, largest long) of each axis in df. Points cut a gap in two; a region that nothing meets is given whole."""
    c, v = interval_cols(cols), interval_cols(cols_view)
    if view_df is None:
        view = df.where(F.col(c.chrom).isNotNull()).select(F.col(c.chrom).alias("_vc")).distinct()
        view = view.select("_vc", F.lit(0).cast("long").alias("_lo"), F.lit(LAST).alias("_hi"), F.col("_vc").alias("view_region"))
    else:
        view = view_df.select(F.col(v.chrom).alias("_vc"), F.col(v.start).alias("_lo"), F.col(v.end).alias("_hi"), F.col(view_name_col).alias("view_region"))
    keys = ["view_region", "_vc", "_lo", "_hi"]
    if view_df is None:
        rows = df.select(F.col(c.chrom).alias("_vc"), F.col(c.start).alias("start"), F.col(c.end).alias("end")).where(F.col("_vc").isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("end") >= 0))
        rows = rows.select(F.col("_vc").alias("view_region"), "_vc", F.lit(0).cast("long").alias("_lo"), F.lit(LAST).alias("_hi"), F.greatest("start", F.lit(0)).alias("start"), "end")
    else:
        names = IntervalCols("_vc", "_lo", "_hi")
        rows = met(df.select(*c), view, c, names, [], [], [F.struct(*keys).alias("_v")]).select("_v.*", F.greatest("_s1", "_s2").alias("start"), F.least("_e1", "_e2").alias("end"))
    # a gap lies before each row that starts beyond all earlier ends; points cut a gap in two
    rows = running(rows, keys, "start", [F.col("start"), F.col("end")], {"_far": (F.col("end"), "max")}, upto=-1, stretch=stretch_of(rows, keys, "start"))
    gaps = rows.where((F.col("_far").isNull() & (F.col("start") > F.col("_lo"))) | (F.col("start") > F.col("_far"))).select(*keys, F.coalesce("_far", "_lo").alias("start"), F.col("start").alias("end"))
    ends = rows.groupBy(*keys).agg(F.max("end").alias("z"))
    tail = ends.where("z < _hi").select(*keys, F.col("z").alias("start"), F.col("_hi").alias("end"))
    free = view.join(ends.select("view_region"), "view_region", "left_anti").select(*keys, F.col("_lo").alias("start"), F.col("_hi").alias("end"))
    out = gaps.unionByName(tail).unionByName(free)
    return out.select(F.col("_vc").alias(c.chrom), F.col("start").alias(c.start), F.col("end").alias(c.end), "view_region")


def subtract(df1: DataFrame, df2: DataFrame, return_index: bool = False, suffixes=("", "_"), cols1=None, cols2=None) -> DataFrame:
    """df1 without what df2 covers: one row for each piece left, with the other columns of df1; points of df2 cut. Null rows and what lies below 0 go. return_index adds index and sub_index_."""
    c1, c2 = interval_cols(cols1), interval_cols(cols2)
    sx, sy = suffixes
    a = numbered(df1) if return_index else df1
    chroms = a.select(F.col(c1.chrom).alias("chrom")).unionByName(df2.select(F.col(c2.chrom).alias("chrom"))).where("chrom is not null").distinct()
    view = chroms.select("chrom", F.lit(0).cast("long").alias("start"), F.lit(LAST).alias("end"), F.col("chrom").alias("name"))
    holes = df2.select(F.col(c2.chrom).alias("chrom"), F.col(c2.start).alias("start"), F.col(c2.end).alias("end"))
    plain = IntervalCols("chrom", "start", "end")
    free = stored(_gaps(holes, view), "gaps")  # read for the bins and for the join
    out = met(a, free, c1, plain, [], [F.struct(*[F.col(f"`{c}`") for c in a.columns]).alias("_x")], []).select("_x.*", F.greatest("_s1", "_s2").alias("_gs"), F.least("_e1", "_e2").alias("_ge"))
    out = out.withColumns({c1.start: F.col("_gs"), c1.end: F.col("_ge")})
    keep = [F.col(f"`{c}`").alias(f"{c}{sx}") for c in df1.columns]
    if return_index:
        nth = F.row_number().over(Window.partitionBy("_rid").orderBy(c1.start, c1.end)) - 1
        keep = [F.col("_rid").alias(f"index{sx}"), *keep, nth.cast("long").alias("sub_index_")]
    return out.select(*keep)


def _gaps(holes: DataFrame, view: DataFrame) -> DataFrame:
    """chrom, start, end of what holes leave open of whole axes; axes that only the view names are open throughout."""
    found = complement(holes).select("chrom", "start", "end")
    whole = view.join(holes.where("chrom is not null and start is not null and end is not null and end >= 0").select("chrom").distinct(), "chrom", "left_anti")
    return found.join(whole.select("chrom"), "chrom", "left_anti").unionByName(whole.select("chrom", "start", "end"))
