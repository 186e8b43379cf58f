"""Nearest intervals and pairs at a distance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axisweave.config import interval_cols
from axisweave.operators.joins import pairs, wide_end
from axisweave.operators.running import floor_div, running, stretch_of
from axisweave.storage import numbered, stored


def _ranked(t: DataFrame, order: list[Column], pos: str, stretch: int) -> DataFrame:
    """Targets with rank, from 1 along each axis."""
    return running(t, ["c"], pos, order, {"rank": (F.lit(1).cast("long"), "sum")}, stretch=stretch)


def _reach(q: DataFrame, at: Column, t: DataFrame, pos: Column, targets_first: bool, stretch: int) -> DataFrame:
    """q, c and n: how many targets lie up to each query's place; targets at the same place count if they come first."""
    events = q.select("c", F.col("q"), at.alias("p"), F.lit(1 if targets_first else 0).alias("o"), F.lit(0).cast("long").alias("is"))
    events = events.unionByName(t.select("c", F.lit(None).cast("long").alias("q"), pos.alias("p"), F.lit(0 if targets_first else 1).alias("o"), F.lit(1).cast("long").alias("is")))
    return running(events, ["c"], "p", [F.col("p"), F.col("o"), F.col("q")], {"n": (F.col("is"), "sum")}, stretch=stretch).where("q is not null").select("q", "c", "n")


def closest(
    df1: DataFrame, df2: DataFrame | None = None, k: int = 1, *, ignore_overlaps: bool = False, ignore_upstream: bool = False, ignore_downstream: bool = False,
    direction_col: str | None = None, tie_breaking_col: str | Callable | None = None, return_input: bool = True, return_index: bool | str = False,
    return_distance: bool = True, return_overlap: bool = False, suffixes=("", "_"), cols1=None, cols2=None,
) -> DataFrame:
    """For each row of df1 its k nearest of df2 (of itself without df2, the row excluded), overlaps first, then by gap, tie column and row number.

    Upstream is to the left, or to the right where direction_col is "-". Rows without an axis or coordinate are dropped, rows
    without a partner keep nulls. Candidates are the overlaps and, by rank along the axis, the k nearest on either side,
    found by running counts and an equi-join on rank: no step is quadratic but true overlaps.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if df2 is df1:
        raise ValueError("leave df2 out to search df1 itself")
    c1 = interval_cols(cols1)
    own = df2 is None
    c2 = c1 if own else interval_cols(cols2)
    a = numbered(df1.where(F.col(c1.chrom).isNotNull() & F.col(c1.start).isNotNull() & F.col(c1.end).isNotNull()), "_q")
    b = a.withColumnRenamed("_q", "_t") if own else numbered(df2, "_t")
    names2 = df1.columns if own else df2.columns
    tie = F.lit(0) if tie_breaking_col is None else tie_breaking_col(b) if callable(tie_breaking_col) else F.col(tie_breaking_col)
    minus = F.coalesce(F.col(direction_col) == "-", F.lit(False)) if direction_col else F.lit(False)
    q = a.select(F.col(c1.chrom).alias("c"), F.col(c1.start).cast("long").alias("s1"), F.col(c1.end).cast("long").alias("e1"), F.col("_q").alias("q"), minus.alias("minus"))
    t = b.select(F.col(c2.chrom).alias("c"), F.col(c2.start).cast("long").alias("s2"), F.col(c2.end).cast("long").alias("e2"), F.col("_t").alias("t"), tie.alias("tie"))
    t = t.where(F.col("c").isNotNull() & F.col("s2").isNotNull() & F.col("e2").isNotNull())
    n = k + own  # the row itself may be among the ranks
    found = []
    if not ignore_overlaps:
        p = pairs(a, b, c1, c2, [], "_q", "_t")
        found.append(p.select(F.col("r1").alias("q"), F.col("r2").alias("t")))
    wide = min(stretch_of(t, ["c"], "s2"), stretch_of(q, ["c"], "s1"))
    by_end = _ranked(t, [F.col("e2"), F.col("tie").desc(), F.col("t").desc()], "e2", wide).select(F.col("c").alias("rc"), F.col("t"), "rank")
    by_start = _ranked(t, [F.col("s2"), F.col("tie"), F.col("t")], "s2", wide).select(F.col("c").alias("rc"), F.col("t"), "rank")
    for ranks, reach, lo, hi, up in (
        (by_end, _reach(q, F.col("s1"), t, F.col("e2"), True, wide), F.col("n") - n + 1, F.col("n"), ~F.col("minus")),
        (by_start, _reach(q, F.col("e1"), t, F.col("s2"), False, wide), F.col("n") + 1, F.col("n") + n, F.col("minus")),
    ):
        wanted = F.lit(True)
        if ignore_upstream:
            wanted = wanted & ~up
        if ignore_downstream:
            wanted = wanted & up
        side = reach.join(q.select("q", "minus"), "q").where(wanted)
        side = side.withColumn("rank", F.explode(F.sequence(lo, hi)))
        found.append(side.join(ranks, (side["c"] == ranks["rc"]) & (side["rank"] == ranks["rank"])).select("q", "t"))
    both = found[0]
    for x in found[1:]:
        both = both.unionByName(x)
    both = both.where("q <> t") if own else both
    both = both.join(q.drop("c", "minus"), "q").join(t.drop("c"), "t")
    hit = (F.col("s1") < wide_end(F.col("s2"), F.col("e2"))) & (F.col("s2") < wide_end(F.col("s1"), F.col("e1")))
    gap = F.greatest(F.lit(0).cast("long"), F.col("s1") - F.col("e2"), F.col("s2") - F.col("e1"))
    both = both.withColumn("hit", hit).withColumn("gap", gap)
    if ignore_overlaps:
        both = both.where(~F.col("hit"))
    near = Window.partitionBy("q").orderBy(F.when(F.col("hit"), 0).otherwise(F.col("gap") + 1), F.col("tie"), F.col("t"))
    # a target found in two ways has one rank and is next to itself: no distinct over the candidates, whose hash tables are large
    best = both.withColumn("_nth", F.dense_rank().over(near)).where(F.col("_nth") <= k).withColumn("_same", F.lag("t").over(near))
    best = best.where(F.col("_same").isNull() | (F.col("_same") != F.col("t"))).select("q", "t", "gap", "hit", "s1", "e1", "s2", "e2")
    left = a.select("_q", F.struct(*df1.columns).alias("_x"))
    right = b.select("_t", F.struct(*names2).alias("_y"))
    out = left.join(best, left["_q"] == best["q"], "left").join(right, F.col("t") == right["_t"], "left")
    (sx, sy), index = suffixes, return_index if isinstance(return_index, str) else "index"
    cols = [F.col("_q").alias(f"{index}{sx}")] if return_index else []
    cols += [F.col("_x")[c].alias(f"{c}{sx}") for c in df1.columns] if return_input else []
    cols += [F.col("t").alias(f"{index}{sy}")] if return_index else []
    cols += [F.col("_y")[c].alias(f"{c}{sy}") for c in names2] if return_input else []
    if return_overlap:
        cols += [F.col("hit").alias("have_overlap"), F.when(F.col("hit"), F.greatest("s1", "s2")).alias("overlap_start"), F.when(F.col("hit"), F.least("e1", "e2")).alias("overlap_end")]
    cols += [F.col("gap").alias("distance")] if return_distance else []
    return out.select(*cols)


def pair_by_distance(
    df: DataFrame, min_sep: int, max_sep: int, min_intervening: int | None = None, max_intervening: int | None = None, relative_to: str = "midpoints", *,
    cols=None, return_index: bool = False, keep_order: bool = False, suffixes=("_1", "_2"), tie: list[str] | None = None,
) -> DataFrame:
    """Pairs of one axis, the first before the second in order of start, whose separation lies within the bounds.

    Separation is that of midpoints (rounded down) or of endpoints (the first's end to the second's start). Half-open probes
    make both bounds exclusive, but where a probe is a point the lower one is inclusive. *_intervening bounds the number of
    intervals between the two in the order of axis, start and end, then of the columns `tie`, which must tell rows apart;
    without them rows are numbered as the table gives them. The two rows travel with their pair, so nothing is joined back.
    """
    if min_sep >= max_sep:
        raise ValueError("min_sep must be below max_sep")
    lo, hi = 0 if min_intervening is None else min_intervening, max_intervening
    if lo < 0 or (hi is not None and hi < lo):
        raise ValueError("bad bounds of intervening intervals")
    if relative_to not in ("midpoints", "endpoints"):
        raise ValueError("relative_to must be midpoints or endpoints")
    c = interval_cols(cols)
    index = return_index or keep_order or tie is None
    a = numbered(df) if index else df
    part = a.where(F.col(c.chrom).isNotNull() & F.col(c.start).isNotNull() & F.col(c.end).isNotNull())
    last = ["r"] if tie is None else [f"_t{i}" for i in range(len(tie))]
    names = [F.col(x).alias(f"_t{i}") for i, x in enumerate(tie or [])]
    part = part.select(F.col(c.chrom).alias("c"), F.col(c.start).alias("s"), F.col(c.end).alias("e"), (F.col("_rid") if index else F.lit(0)).alias("r"), *names, F.struct(*[F.col(f"`{n}`") for n in df.columns]).alias("_x"))
    part = stored(running(part, ["c"], "s", [F.col("s"), F.col("e"), *map(F.col, last)], {"i": (F.lit(1).cast("long"), "sum")}, stretch=stretch_of(part, ["c"], "s")).drop(*[f"_t{i}" for i in range(len(tie or []))]), "order")
    mid = floor_div(F.col("s") + F.col("e"), 2)
    x = part.select("c", "_x", F.col("r").alias("r1"), F.col("i").alias("i1"), (mid if relative_to == "midpoints" else F.col("e")).alias("p1"))
    y = part.select(F.col("c").alias("c2"), F.col("_x").alias("_y"), F.col("r").alias("r2"), F.col("i").alias("i2"), (mid if relative_to == "midpoints" else F.col("s")).alias("p2"))
    width = max(1, max_sep - min(0, min_sep))
    bins = F.explode(F.sequence(floor_div(F.col("p1") + min(0, min_sep), width), floor_div(F.col("p1") + max_sep, width)))
    d = F.col("p2") - F.col("p1")
    point = max_sep // 2 == (min_sep + 1) // 2
    within = (d < max_sep) & ((d >= min_sep) if point else (d > min_sep))
    between = F.col("i2") - F.col("i1") - 1
    ok = (F.col("i2") > F.col("i1")) & (between >= lo) & (F.lit(True) if hi is None else between <= hi)
    x, y = x.withColumn("b", bins), y.withColumn("b2", floor_div(F.col("p2"), width))
    out = x.join(y, (F.col("c") == F.col("c2")) & (F.col("b") == F.col("b2")) & within & ok)
    if keep_order:
        out = out.orderBy("r1", "r2")
    sx, sy = suffixes
    head = [F.col("r1").alias(f"index{sx}"), F.col("r2").alias(f"index{sy}")] if return_index else []
    return out.select(*head, *[F.col("_x")[n].alias(f"{n}{sx}") for n in df.columns], *[F.col("_y")[n].alias(f"{n}{sy}") for n in df.columns])
