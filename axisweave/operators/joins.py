"""Overlap joins and what is counted from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisweave.config import IntervalCols, interval_cols
from axisweave.operators.running import floor_div
from axisweave.storage import numbered

HOWS = ("inner", "left", "right", "outer")


def wide_end(start: Column, end: Column, closed: bool = False) -> Column:
    """Points count as one unit long when intervals are matched; closed intervals hold their ends, so each is a unit longer."""
    return end + 1 if closed else F.when(start == end, end + 1).otherwise(end)


def overlap_size(start1: Column, end1: Column, start2: Column, end2: Column) -> Column:
    """Length that two intervals share: 0 if they only touch, -1 if they are apart."""
    size = F.least(end1, end2) - F.greatest(start1, start2)
    return F.when(size < 0, F.lit(-1)).otherwise(size).cast("long")


def _suffixed(df: DataFrame, suffix: str, index: str | None = None) -> list[Column]:
    return [F.col(f"`{c}`").alias(f"{c}{suffix}") for c in df.columns if c != index]


def _check_on(on, *cols: IntervalCols) -> list[str]:
    if on is None:
        return []
    if not isinstance(on, list):
        raise TypeError("on must be a list of column names")
    if any(c.chrom in on for c in cols):
        raise ValueError("on must not contain the chromosome column")
    return on


def _sides(df: DataFrame, cols: IntervalCols, on: list[str], tag: str, rid: str, closed: bool = False) -> DataFrame:
    """Only what matching needs: keys, raw coordinates, widened end and row id."""
    s, e = F.col(cols.start).cast("long"), F.col(cols.end).cast("long")
    keep = [F.col(cols.chrom).alias(f"c{tag}"), s.alias(f"s{tag}"), wide_end(s, e, closed).alias(f"w{tag}"), F.col(rid).alias(f"r{tag}")]
    keys = [F.col(k).alias(f"k{i}_{tag}") for i, k in enumerate(on)]
    return df.select(*keep, *keys).where(F.col(f"c{tag}").isNotNull() & F.col(f"s{tag}").isNotNull() & F.col(f"w{tag}").isNotNull())


def _lengths(*sides: tuple[DataFrame, str, str]) -> list:
    """A histogram of the sides' lengths by powers of two, with rows, sum of lengths and largest start: one job, a few rows whatever the tables' sizes."""
    parts = [df.select(F.lit(k).alias("side"), F.col(s).alias("s"), (F.col(e) - F.col(s)).cast("double").alias("n")) for k, (df, s, e) in enumerate(sides)]
    rows = reduce(lambda x, y: x.unionByName(y), parts).groupBy("side", F.floor(F.log2(F.greatest(F.col("n"), F.lit(1.0)))).alias("power"))
    return rows.agg(F.count("*").alias("c"), F.sum("n").alias("n"), F.max("s").alias("s")).collect()


def _width(rows: list) -> tuple[int, int]:
    last = max((r["s"] for r in rows), default=0) + 1
    width = 64
    for k in {r["side"] for r in rows}:
        own = [r for r in rows if r["side"] == k]
        mean = sum(min(r["n"], r["c"] * max(last, 1)) for r in own) / max(1, sum(r["c"] for r in own))
        while width < mean:
            width *= 2
    return width, last


def bin_width(*sides: tuple[DataFrame, str, str]) -> tuple[int, int]:
    """Power of two that is at least the larger mean length, so that binned copies at most double the rows; and the largest end in use.

    Ends beyond what the other side reaches are clipped first, so a sentinel end does no harm.
    """
    return _width(_lengths(*sides))


def _bins(start: Column, end: Column, width: int, last: int) -> Column:
    """Numbers of the bins that an interval meets, its end clipped."""
    lo = floor_div(start, width)
    return F.explode(F.sequence(lo, F.greatest(lo, floor_div(F.least(end, F.lit(last)) - 1, width))))


def _side(df: DataFrame, c: IntervalCols, on: list[str], t: str, keep: list[Column], closed: bool) -> DataFrame:
    """Keys, coordinates, widened end and the kept columns of the rows that can match."""
    s, e = F.col(c.start).cast("long"), F.col(c.end).cast("long")
    keys = [F.col(k).alias(f"_k{i}_{t}") for i, k in enumerate(on)]
    out = df.select(F.col(c.chrom).alias(f"_c{t}"), s.alias(f"_s{t}"), e.alias(f"_e{t}"), wide_end(s, e, closed).alias(f"_w{t}"), *keys, *keep)
    return out.where(F.col(f"_c{t}").isNotNull() & F.col(f"_s{t}").isNotNull() & F.col(f"_e{t}").isNotNull())


def met(df1: DataFrame, df2: DataFrame, cols1: IntervalCols, cols2: IntervalCols, on: list[str], keep1: list[Column], keep2: list[Column], width: int | None = None, kind: str = "inner", closed: bool = False, bins: tuple[int, int] | None = None) -> DataFrame:
    """Overlapping rows with _s1, _e1, _s2, _e2 and the kept columns of both (of the first with kind left_semi): one equi-join on axis, keys and bin, each pair taken in the first bin that both share. No row numbers are needed. bins: width and last end, if bin_width() is known."""

    a, b = _side(df1, cols1, on, "1", keep1, closed), _side(df2, cols2, on, "2", keep2, closed)
    found, last = bins or bin_width((a, "_s1", "_w1"), (b, "_s2", "_w2"))
    w = width or found
    a, b = (df.withColumn(f"_b{t}", _bins(F.col(f"_s{t}"), F.col(f"_w{t}"), w, last)) for df, t in ((a, "1"), (b, "2")))
    keys = [a["_c1"] == b["_c2"], a["_b1"] == b["_b2"], *[a[f"_k{i}_1"].eqNullSafe(b[f"_k{i}_2"]) for i in range(len(on))]]
    hit = (F.col("_s1") < F.col("_w2")) & (F.col("_s2") < F.col("_w1"))
    first = F.col("_b1") == F.greatest(floor_div(F.col("_s1"), w), floor_div(F.col("_s2"), w))
    return a.join(b, reduce(lambda x, y: x & y, keys) & hit & first, kind)


def _row(df: DataFrame, name: str) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def _content(df: DataFrame, c: IntervalCols, on: list[str]) -> list[Column]:
    """Axis, coordinates and keys: all that decides what a row overlaps, so rows that agree in them need no number to be told apart."""
    return [F.col(c.chrom).alias("_c"), F.col(c.start).cast("long").alias("_s"), F.col(c.end).cast("long").alias("_e"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(on)]]


def _on_content(df: DataFrame, other: DataFrame, c: IntervalCols, on: list[str]) -> Column:
    keys = [F.col(k).eqNullSafe(other[f"_k{i}"]) for i, k in enumerate(on)]
    return reduce(lambda x, y: x & y, [F.col(c.chrom) == other["_c"], F.col(c.start) == other["_s"], F.col(c.end) == other["_e"], *keys])


def _hit_contents(df1: DataFrame, df2: DataFrame, c1: IntervalCols, c2: IntervalCols, on: list[str], width: int | None, closed: bool = False) -> DataFrame:
    """Distinct contents of df1 that overlap something in df2."""
    keys = [f"_k{i}" for i in range(len(on))]
    mine = df1.select(*_content(df1, c1, on)).distinct()
    names = IntervalCols("_c", "_s", "_e")
    other = df2.select(*_content(df2, c2, on)).distinct()
    return met(mine, other, names, names, keys, [F.struct("_c", "_s", "_e", *keys).alias("_x")], [], width, "left_semi", closed).select("_x.*").distinct()


def _kept(df1: DataFrame, df2: DataFrame, c1: IntervalCols, c2: IntervalCols, on: list[str], kind: str, width: int | None, closed: bool = False) -> DataFrame:
    """_x and _y (rows of df1 and df2) of a join that keeps, or asks for, whole rows of df1: left, left_semi or left_anti (_x alone).

    A row of df1 is in the one bin of its start and a row of df2 in all bins in which a row that it overlaps can start, so one
    equi-join tells what a row meets, and that it meets nothing. The reach is the power of two above df1's lengths, or, where a few
    are much longer than the mean, twice the width of bins; those that are longer go through met(), rows that can't match pass by.
    """
    x, y = [_row(df1, "_x")], [] if kind != "left" else [_row(df2, "_y")]
    a, b = _side(df1, c1, on, "1", x, closed), _side(df2, c2, on, "2", y, closed)
    rows = _lengths((a, "_s1", "_w1"), (b, "_s2", "_w2"))
    found, last = _width(rows)
    longest = max((2 << r["power"] for r in rows if r["side"] == 0), default=1)
    reach = min(longest, 2 * found)
    w = width or max(found, 4 * reach)
    short = (F.col("_w1") <= F.col("_s1")) | (F.col("_w1") - F.col("_s1") <= reach)
    near = (a if longest <= reach else a.where(short)).withColumn("_b1", floor_div(F.col("_s1"), w))
    least = F.greatest(F.col("_s2"), F.lit(reach - 1 - (1 << 63))) - (reach - 1)
    lo = floor_div(least, w)
    far = b.withColumn("_b2", F.explode(F.sequence(lo, F.greatest(lo, floor_div(F.least("_w2", F.lit(last)) - 1, w)))))
    keys = [near["_c1"] == far["_c2"], near["_b1"] == far["_b2"], *[near[f"_k{i}_1"].eqNullSafe(far[f"_k{i}_2"]) for i in range(len(on))]]
    hit = (F.col("_s1") < F.col("_w2")) & (F.col("_s2") < F.col("_w1"))
    keep = ["_x", "_y"] if kind == "left" else ["_x"]
    out = near.join(far, reduce(lambda p, q: p & q, keys) & hit, kind).select(*keep)
    none = [] if kind != "left" else [F.lit(None).cast(b.schema["_y"].dataType).alias("_y")]
    if longest > reach:
        long = df1.where(wide_end(F.col(c1.start).cast("long"), F.col(c1.end).cast("long"), closed) - F.col(c1.start).cast("long") > reach)
        hits = _hit_contents(long, df2, c1, c2, on, width, closed)
        if kind == "left":
            out = out.unionByName(met(long, df2, c1, c2, on, x, y, width, closed=closed).select(*keep))
        side = "left_semi" if kind == "left_semi" else "left_anti"
        long = long.where(F.col(c1.chrom).isNotNull())
        out = out.unionByName(long.join(hits, _on_content(long, hits, c1, on), side).select(*x, *none))
    if kind == "left_semi":
        return out
    return out.unionByName(df1.where(F.col(c1.chrom).isNull() | F.col(c1.start).isNull() | F.col(c1.end).isNull()).select(*x, *none))


def pairs(df1: DataFrame, df2: DataFrame, cols1: IntervalCols, cols2: IntervalCols, on: list[str], rid1: str = "_rid", rid2: str = "_rid", width: int | None = None, closed: bool = False) -> DataFrame:
    """r1, r2 of all overlapping pairs: an equi-join on axis, keys and bin, each pair taken in the first bin that both share."""
    a, b = _sides(df1, cols1, on, "1", rid1, closed), _sides(df2, cols2, on, "2", rid2, closed)
    found, last = bin_width((a, "s1", "w1"), (b, "s2", "w2"))
    w = width or found
    cut = lambda df, t: df.withColumn(f"b{t}", F.explode(F.sequence(floor_div(F.col(f"s{t}"), w), F.greatest(floor_div(F.col(f"s{t}"), w), floor_div(F.least(F.col(f"w{t}"), F.lit(last)) - 1, w)))))
    a, b = cut(a, "1"), cut(b, "2")
    keys = [a["c1"] == b["c2"], a["b1"] == b["b2"], *[a[f"k{i}_1"].eqNullSafe(b[f"k{i}_2"]) for i in range(len(on))]]
    first = F.col("b1") == F.greatest(floor_div(F.col("s1"), w), floor_div(F.col("s2"), w))
    hit = (F.col("s1") < F.col("w2")) & (F.col("s2") < F.col("w1"))
    return a.join(b, reduce(lambda x, y: x & y, keys) & hit & first).select("r1", "r2")


def overlap(
    df1: DataFrame, df2: DataFrame, how: str = "left", *, return_input: bool = True, return_index: bool | str = False, return_overlap: bool | str = False,
    suffixes: tuple[str, str] = ("", "_"), keep_order: bool | None = None, cols1=None, cols2=None, on: list[str] | None = None, width: int | None = None, ensure_int: bool = True, closed: bool = False,
) -> DataFrame:
    """Join of the rows whose intervals overlap: same axis and keys, s1 < e2 and s2 < e1, points widened to length 1.
    With closed the ends belong to the intervals, so that those that touch overlap.

    how is inner, left, right or outer; rows with a null axis or coordinate never match and stay on the kept side. With
    return_index come index columns (row numbers), with return_overlap the shared segment in raw coordinates; a string is the
    prefix of their names. The result is unordered unless keep_order, which only how="left" allows. Coordinates are
    BIGINT and nullable throughout, so ensure_int has no effect.
    """
    if how not in HOWS:
        raise ValueError(f"how must be one of {HOWS}")
    if keep_order and how != "left":
        raise ValueError("keep_order needs how='left'")
    c1, c2 = interval_cols(cols1), interval_cols(cols2)
    on = _check_on(on, c1, c2)
    if not return_index and not keep_order:
        return _overlap_plain(df1, df2, how, return_input, return_overlap, suffixes, c1, c2, on, width, closed)
    a, b = numbered(df1, "_rid1"), numbered(df2, "_rid2")
    p = pairs(a, b, c1, c2, on, "_rid1", "_rid2", width, closed)
    left = a.select("_rid1", *[F.struct(*df1.columns).alias("_x")])
    right = b.select("_rid2", *[F.struct(*df2.columns).alias("_y")])
    kind = {"inner": "inner", "left": "left", "right": "inner", "outer": "left"}[how]
    out = left.join(p, left["_rid1"] == p["r1"], kind).drop("r1")
    out = out.join(right, out["r2"] == right["_rid2"], {"inner": "inner", "left": "left", "right": "right", "outer": "full_outer"}[how]).drop("r2")
    x, y, (sx, sy) = (lambda c: F.col("_x")[c]), (lambda c: F.col("_y")[c]), suffixes
    index = return_index if isinstance(return_index, str) else "index"
    cols: list[Column] = []
    if return_index:
        cols.append(F.col("_rid1").alias(f"{index}{sx}"))
    if return_input:
        cols += [x(c).alias(f"{c}{sx}") for c in df1.columns]
    if return_index:
        cols.append(F.col("_rid2").alias(f"{index}{sy}"))
    if return_input:
        cols += [y(c).alias(f"{c}{sy}") for c in df2.columns]
    if return_overlap:
        name = return_overlap if isinstance(return_overlap, str) else "overlap"
        both = F.col("_rid1").isNotNull() & F.col("_rid2").isNotNull()
        cols.append(F.when(both, F.greatest(x(c1.start), y(c2.start))).cast("long").alias(f"{name}_{c1.start}"))
        cols.append(F.when(both, F.least(x(c1.end), y(c2.end))).cast("long").alias(f"{name}_{c1.end}"))
    if keep_order:
        out = out.orderBy("_rid1", F.col("_rid2").asc_nulls_last())
    return out.select(*cols)


def _overlap_plain(df1: DataFrame, df2: DataFrame, how: str, return_input: bool, return_overlap: bool | str, suffixes, c1: IntervalCols, c2: IntervalCols, on: list[str], width: int | None, closed: bool = False) -> DataFrame:
    """Without row numbers: one binned join that carries both rows, and with outer the rows of df2 that meet nothing."""
    if how == "inner":
        rows = met(df1, df2, c1, c2, on, [_row(df1, "_x")], [_row(df2, "_y")], width, closed=closed).select("_x", "_y")
    elif how == "right":
        rows = _kept(df2, df1, c2, c1, on, "left", width, closed).select(F.col("_y").alias("_x"), F.col("_x").alias("_y"))
    else:
        rows = _kept(df1, df2, c1, c2, on, "left", width, closed)
    if how == "outer":
        none = F.lit(None).cast(rows.schema["_x"].dataType).alias("_x")
        rows = rows.unionByName(_kept(df2, df1, c2, c1, on, "left_anti", width, closed).select(none, F.col("_x").alias("_y")))
    x, y, (sx, sy) = (lambda c: F.col("_x")[c]), (lambda c: F.col("_y")[c]), suffixes
    cols = [x(c).alias(f"{c}{sx}") for c in df1.columns] + [y(c).alias(f"{c}{sy}") for c in df2.columns] if return_input else []
    if return_overlap:
        name = return_overlap if isinstance(return_overlap, str) else "overlap"
        both = F.col("_x").isNotNull() & F.col("_y").isNotNull()
        cols.append(F.when(both, F.greatest(x(c1.start), y(c2.start))).cast("long").alias(f"{name}_{c1.start}"))
        cols.append(F.when(both, F.least(x(c1.end), y(c2.end))).cast("long").alias(f"{name}_{c1.end}"))
    return rows.select(*cols)


def setdiff(df1: DataFrame, df2: DataFrame, *, cols1=None, cols2=None, on: list[str] | None = None, width: int | None = None) -> DataFrame:
    """Rows of df1 that overlap nothing in df2 (anti join); null rows stay."""
    c1, c2 = interval_cols(cols1), interval_cols(cols2)
    on = _check_on(on, c1, c2)
    return _kept(df1, df2, c1, c2, on, "left_anti", width).select("_x.*")


def semi(df1: DataFrame, df2: DataFrame, *, cols1=None, cols2=None, on: list[str] | None = None, width: int | None = None) -> DataFrame:
    """Rows of df1 that overlap something in df2, once each."""
    c1, c2 = interval_cols(cols1), interval_cols(cols2)
    on = _check_on(on, c1, c2)
    return _kept(df1, df2, c1, c2, on, "left_semi", width).select("_x.*")


def _summed(df1: DataFrame, df2: DataFrame, c1: IntervalCols, c2: IntervalCols, on: list[str], value: Column, name: str, suffix: str, return_input: bool, width: int | None, bins: tuple[int, int] | None = None) -> DataFrame:
    """df1 with the sum of `value` over the rows of df2 that overlap each row, 0 for none and for null rows."""
    keys = [f"_k{i}" for i in range(len(on))]
    mine = df1.select(*_content(df1, c1, on)).distinct()
    two = df2.select(*_content(df2, c2, on))
    names = IntervalCols("_c", "_s", "_e")
    n = met(mine, two, names, names, keys, [F.struct("_c", "_s", "_e", *keys).alias("_x")], [], width, bins=bins).groupBy("_x").agg(F.sum(value).alias("_n")).select("_x.*", "_n")
    out = df1.join(n, _on_content(df1, n, c1, on), "left")
    keep = [df1[f"`{c}`"].alias(f"{c}{suffix}") for c in df1.columns] if return_input else []
    return out.select(*keep, F.coalesce("_n", F.lit(0)).cast("long").alias(name))


def count_overlaps(df1: DataFrame, df2: DataFrame, *, suffixes=("", "_"), return_input: bool = True, cols1=None, cols2=None, on: list[str] | None = None, width: int | None = None) -> DataFrame:
    """df1 with count: how many rows of df2 overlap each row, 0 for none and for null rows."""
    c1, c2 = interval_cols(cols1), interval_cols(cols2)
    return _summed(df1, df2, c1, c2, _check_on(on, c1, c2), F.lit(1).cast("long"), "count", suffixes[0], return_input, width)


def coverage(df1: DataFrame, df2: DataFrame, *, suffixes=("", "_"), return_input: bool = True, cols1=None, cols2=None, width: int | None = None) -> DataFrame:
    """df1 with coverage: how many of a row's units df2 covers, overlaps within df2 counted once; 0 for points and null rows."""
    from axisweave.operators.islands import merge

    c1, c2 = interval_cols(cols1), interval_cols(cols2)
    b = merge(df2.select(*c2), cols=c2).where(F.col(c2.chrom).isNotNull()).select(*c2)
    both = F.greatest(F.lit(0).cast("long"), F.least("_e1", "_e2") - F.greatest("_s1", "_s2"))
    # merged rows are together no longer than the rows that they come from, so those can tell the bins and the merge runs once
    sides = [(df.select(F.col(c.start).cast("long").alias("s"), F.col(c.end).cast("long").alias("e")).dropna(), "s", "e") for df, c in ((df1, c1), (df2, c2))]
    return _summed(df1, b, c1, c2, [], both, "coverage", suffixes[0], return_input, width, bin_width(*sides))
