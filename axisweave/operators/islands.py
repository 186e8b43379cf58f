"""Clusters, merged intervals, runs and depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axisweave.config import interval_cols
from axisweave.operators.running import beside, running, stretch_of
from axisweave.storage import numbered


def _whole(c, on: list[str]) -> Column:
    """True for rows that no axis, coordinate or key is missing from; the others stand alone."""
    ok = F.lit(True)
    for name in (*c, *on):
        ok = ok & F.col(name).isNotNull()
    return ok


def _islands(df: DataFrame, c, on: list[str], min_dist: int | None, tie: list[str]) -> DataFrame:
    """Add _island, the number of the cluster within its axis and keys, from 1 in order of start."""
    keys = [c.chrom, *on]
    order = [F.col(c.start), F.col(c.end), *[F.col(t) for t in tie]]
    wide = stretch_of(df, keys, c.start)
    df = running(df, keys, c.start, order, {"_far": (F.col(c.end), "max")}, upto=-1, stretch=wide)
    s, far = F.col(c.start), F.col("_far")
    # as differences, so that an end at the largest long does not overflow
    apart = (s >= far) if min_dist is None else (s > far) & (s - far > min_dist)
    df = df.withColumn("_border", F.when(far.isNull() | apart, 1).otherwise(0).cast("long"))
    # of equal rows the one that opens the cluster comes first, however the rows were dealt between the passes
    order = [*order[:2], F.col("_border").desc(), *order[2:]]
    return running(df, keys, c.start, order, {"_island": (F.col("_border"), "sum")}, stretch=wide).drop("_far", "_border")


def _min_dist(min_dist):
    if min_dist is not None and min_dist < 0:
        raise ValueError("min_dist must not be negative")
    return min_dist


def cluster(df: DataFrame, min_dist: int | None = 0, *, cols=None, on: list[str] | None = None, return_input: bool = True, return_cluster_ids: bool = True, return_cluster_intervals: bool = True) -> DataFrame:
    """df with cluster, cluster_start and cluster_end; min_dist=None splits abutting intervals.

    Numbers start from 0 and run on over axes and keys in sorted order, then over rows that lack an axis, coordinate
    or key, each a cluster of its own.
    """
    _min_dist(min_dist)
    c, on = interval_cols(cols), on or []
    keys = [c.chrom, *on]
    a = numbered(df)
    good = _islands(a.where(_whole(c, on)), c, on, min_dist, ["_rid"])
    per = good.groupBy(*keys, "_island").agg(F.min(c.start).alias("cluster_start"), F.max(c.end).alias("cluster_end"))
    groups = per.groupBy(*keys).agg(F.count("*").alias("_n"))
    past = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("_base", F.coalesce(F.sum("_n").over(past), F.lit(0))).drop("_n")
    good = good.join(per, [*keys, "_island"]).join(groups, keys).withColumn("cluster", F.col("_base") + F.col("_island") - 1)
    good = good.select(*df.columns, "cluster", "cluster_start", "cluster_end", "_rid")
    bad = a.where(~_whole(c, on))
    count = per.agg(F.count("*").alias("_all"))
    nth = F.row_number().over(Window.orderBy("_rid"))
    bad = bad.withColumn("_k", nth - 1).join(F.broadcast(count)).withColumn("cluster", F.col("_all") + F.col("_k"))
    bad = bad.select(*df.columns, "cluster", F.col(c.start).cast("long").alias("cluster_start"), F.col(c.end).cast("long").alias("cluster_end"), "_rid")
    out = good.unionByName(bad)
    keep = [*(df.columns if return_input else []), *(["cluster"] if return_cluster_ids else []), *(["cluster_start", "cluster_end"] if return_cluster_intervals else [])]
    return out.select(*keep)


def merge(df: DataFrame, min_dist: int | None = 0, *, cols=None, on: list[str] | None = None) -> DataFrame:
    """chrom, start, end, keys and n_intervals of each cluster. Rows that lack something follow with their values and a null n_intervals; the schema is the same with or without them."""
    _min_dist(min_dist)
    c, on = interval_cols(cols), on or []
    keys = [c.chrom, *on]
    part = df.select(*dict.fromkeys([*c, *on]))
    good = _islands(part.where(_whole(c, on)), c, on, min_dist, [])
    out = good.groupBy(*keys, "_island").agg(F.min(c.start).alias(c.start), F.max(c.end).alias(c.end), F.count("*").alias("n_intervals"))
    names = [c.chrom, c.start, c.end, *on]
    bad = part.where(~_whole(c, on)).select(*names, F.lit(None).cast("long").alias("n_intervals"))
    return out.select(*names, "n_intervals").unionByName(bad)


def _changed(value: Column, before: Column, floating: bool) -> Column:
    """True where the value differs from the one before; floats may differ by rounding."""
    if not floating:
        return ~value.eqNullSafe(before)
    nan = lambda x: x.isNull() | F.isnan(x)
    close = (value == before) | (F.abs(value - before) <= 1e-8 + 1e-5 * F.abs(before))
    return ~((nan(value) & nan(before)) | (~nan(value) & ~nan(before) & F.coalesce(close, F.lit(False))))


def mark_runs(df: DataFrame, col: str, *, allow_overlaps: bool = False, reset_counter: bool = True, run_col: str = "run", tie: list[str] | None = None, cols=None) -> DataFrame:
    """df with a run number: a run is a stretch of touching intervals of one value of col. Rows without an axis are dropped.

    Numbers start from 0 on each axis, or run on over axes in sorted order with reset_counter=False. Overlapping intervals
    raise ValueError unless allowed. Rows of equal coordinates are in the order of the columns `tie`, which should tell them apart;
    without them rows are numbered as the table gives them, and the numbers written down.
    """
    from axisweave.operators.checks import is_overlapping

    c = interval_cols(cols)
    if not allow_overlaps and is_overlapping(df, cols=c):
        raise ValueError("intervals overlap")
    a = df.where(F.col(c.chrom).isNotNull())
    a = numbered(a) if tie is None else a
    names = [c.start, c.end, *(["_rid"] if tie is None else tie)]
    order = [F.col(n) for n in names]
    floating = dict(df.dtypes)[col] in ("float", "double")
    wide = stretch_of(a, [c.chrom], c.start)
    a = running(a, [c.chrom], c.start, order, {"_far": (F.col(c.end), "max")}, upto=-1, stretch=wide)
    a = beside(a, [c.chrom], c.start, names, F.col(col), "_before", stretch=wide)
    border = F.col("_far").isNull() | (F.col(c.start) > F.col("_far")) | _changed(F.col(col), F.col("_before"), floating)
    a = a.withColumn("_b", border.cast("long"))
    a = running(a, [c.chrom], c.start, order, {"_run": (F.col("_b"), "sum")}, stretch=wide)
    number = F.col("_run") - 1
    if not reset_counter:
        n = a.groupBy(c.chrom).agg(F.max("_run").alias("_n"))
        past = Window.orderBy(c.chrom).rowsBetween(Window.unboundedPreceding, -1)
        n = n.select(c.chrom, F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_base"))
        a = a.join(n, c.chrom)
        number = number + F.col("_base")
    return a.select(*df.columns, number.alias(run_col))


def merge_runs(df: DataFrame, col: str, *, allow_overlaps: bool = False, agg: dict | None = None, tie: list[str] | None = None, cols=None) -> DataFrame:
    """One row a run: axis, start, end, value and the named aggregates {"out": (column, function name)} or {"out": Column}."""
    c = interval_cols(cols)
    runs = mark_runs(df, col, allow_overlaps=allow_overlaps, run_col="_run_no", tie=tie, cols=c)
    names = {"mean": F.avg, "count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp, "median": F.median, "first": F.first, "last": F.last, "nunique": F.count_distinct}
    more = [(v if isinstance(v, Column) else names[v[1]](v[0])).alias(k) for k, v in (agg or {}).items()]
    head = F.min_by(col, F.struct(c.start, c.end)).alias(col)
    return runs.groupBy(c.chrom, "_run_no").agg(F.min(c.start).alias(c.start), F.max(c.end).alias(c.end), head, *more).drop("_run_no")


def depth_profile(df: DataFrame, weight: Column | None = None, *, cols=None) -> DataFrame:
    """chrom, start, end, depth of every stretch between neighbouring borders where depth is not zero."""
    c = interval_cols(cols)
    w = F.lit(1) if weight is None else weight
    ends = df.where(_whole(c, [])).select(F.col(c.chrom).alias("chrom"), F.explode(F.array(F.struct(F.col(c.start).alias("p"), w.alias("d")), F.struct(F.col(c.end).alias("p"), (-w).alias("d")))).alias("x"))
    ends = ends.groupBy("chrom", F.col("x.p").alias("start")).agg(F.sum("x.d").alias("d"))
    wide = stretch_of(ends, ["chrom"], "start")
    deep = running(ends, ["chrom"], "start", [F.col("start")], {"depth": (F.col("d"), "sum")}, stretch=wide)
    deep = beside(deep, ["chrom"], "start", ["start"], F.col("start"), "end", ahead=True, stretch=wide)
    return deep.where("end is not null and depth <> 0").select("chrom", "start", "end", "depth")


def stack_levels(df: DataFrame, *, cols=None, level_col: str = "level") -> DataFrame:
    """df with the lowest row on which each interval of an axis can be drawn without touching an earlier one. The assignment depends on all earlier intervals of the axis, so an axis is one pandas group."""
    import pandas as pd

    c = interval_cols(cols)

    def levels(pdf: pd.DataFrame) -> pd.DataFrame:
        import heapq

        pdf = pdf.sort_values([c.start, c.end]).reset_index(drop=True)
        free, busy, top, out = [], [], 0, []
        for s, e in zip(pdf[c.start], pdf[c.end]):
            while busy and busy[0][0] <= s:
                heapq.heappush(free, heapq.heappop(busy)[1])
            if free:
                k = heapq.heappop(free)
            else:
                k, top = top, top + 1
            heapq.heappush(busy, (max(e, s + 1), k))
            out.append(k)
        return pdf.assign(**{level_col: out})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{level_col}` long"
    return df.where(_whole(c, [])).groupBy(c.chrom).applyInPandas(levels, schema)
