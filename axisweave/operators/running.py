"""Running sums and maxima along an axis without gathering an axis in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Usual width of the stretches that an axis is cut into, and rows that one should hold at most.
STRETCH, STRETCH_ROWS = 1 << 16, 1 << 18


def floor_div(x: Column, w: int) -> Column:
    """Floor of x / w in whole numbers."""
    return ((x - F.pmod(x, F.lit(w))) / w).cast("long")


def stretch_of(df: DataFrame, keys: list[str], pos: str) -> int:
    """Width of stretches that suits the rows' density: narrower where one would hold too many rows, wider where most would be nearly empty. One job that gives three numbers."""
    by = df.groupBy(*keys, floor_div(F.col(pos), STRETCH).alias("_s")).count().agg(F.max("count").alias("most"), F.count("*").alias("n"), F.sum("count").alias("rows")).first()
    width, most, n = STRETCH, by["most"] or 0, by["n"]
    while most > STRETCH_ROWS and width > 1:
        width, most = width // 2, most / 2
    while width >= STRETCH and most * 2 <= STRETCH_ROWS and n > max(64, (by["rows"] or 0) / 32) and width < 1 << 40:
        width, most, n = width * 2, most * 2, n / 2
    return width


def same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[n].eqNullSafe(b[n]) for n in names))


def running(df: DataFrame, keys: list[str], pos: str, order: list[Column], values: dict[str, tuple[Column, str]], upto: int = 0, stretch: int = STRETCH) -> DataFrame:
    """Add columns: the sum or max ("sum", "max") of each value over the rows of `keys` up to this one in `order` (led by `pos`).

    Two levels: within a stretch of the axis by a window, and over whole stretches by a window on a table of one row a
    stretch. upto: 0 includes the row itself, -1 does not.
    """
    df = df.withColumn("_s", floor_div(F.col(pos), stretch))
    names = [*keys, "_s"]
    kind = {"sum": F.sum, "max": F.max}
    total = df.groupBy(*names).agg(*[kind[how](v).alias(f"_t_{n}") for n, (v, how) in values.items()])
    past = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select(*[F.col(n).alias(f"_k{i}") for i, n in enumerate(names)], *[kind[how](f"_t_{n}").over(past).alias(f"_p_{n}") for n, (_, how) in values.items()])
    here = Window.partitionBy(*names).orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
    for n, (v, how) in values.items():
        df = df.withColumn(f"_h_{n}", kind[how](v).over(here))
    df = df.join(total, reduce(lambda a, b: a & b, (df[n].eqNullSafe(total[f"_k{i}"]) for i, n in enumerate(names))), "left")
    for n, (_, how) in values.items():
        h, p = F.col(f"_h_{n}"), F.col(f"_p_{n}")
        df = df.withColumn(n, F.greatest(h, p) if how == "max" else F.coalesce(h, F.lit(0)) + F.coalesce(p, F.lit(0)))
    return df.drop("_s", *[f"_k{i}" for i in range(len(names))], *[f"_{x}_{n}" for n in values for x in "hp"])


def beside(df: DataFrame, keys: list[str], pos: str, order: list[str], value: Column, name: str, *, ahead: bool = False, stretch: int = STRETCH) -> DataFrame:
    """Add column `name`: the value of the row before this one of `keys` in `order` (columns, led by pos), or of the one after it with ahead; null where there is none.

    Two levels as in running(): the neighbour within the stretch, and at a stretch's border the outermost row of the next stretch that has any.
    """
    df = df.withColumn("_s", floor_div(F.col(pos), stretch)).withColumn("_v", F.struct(value.alias("v")))
    names = [*keys, "_s"]
    edge = (F.min if ahead else F.max)(F.struct(*order, "_v"))["_v"]
    total = df.groupBy(*names).agg(edge.alias("_e"))
    move = F.lead if ahead else F.lag
    total = total.select(*[F.col(n).alias(f"_k{i}") for i, n in enumerate(names)], move("_e").over(Window.partitionBy(*keys).orderBy("_s")).alias("_p"))
    df = df.withColumn("_h", move("_v").over(Window.partitionBy(*names).orderBy(*order)))
    df = df.join(total, reduce(lambda a, b: a & b, (df[n].eqNullSafe(total[f"_k{i}"]) for i, n in enumerate(names))), "left")
    return df.withColumn(name, F.coalesce("_h", "_p")["v"]).drop("_s", "_v", "_h", "_p", *[f"_k{i}" for i in range(len(names))])


def in_order(df: DataFrame, order_col: str, value: Column, aggs: list[Column]) -> DataFrame:
    """One row for each range of order_col (about STRETCH_ROWS rows, any type of column): aggs over the range's v (value) and p (the value of the row before within the range, null in its first row), then v, the range's first value, and p, the last value of the range before.

    Where order_col is equal, rows are in the order of their values. All comes from one plan, as ranges drawn twice can differ.
    """
    n = 1 + df.count() // STRETCH_ROWS
    rows = df.select(F.col(order_col).alias("o"), value.alias("v")).repartitionByRange(n, "o").withColumn("_p", F.spark_partition_id())
    rows = rows.withColumn("p", F.lag("v").over(Window.partitionBy("_p").orderBy("o", "v")))
    row = F.struct("o", "v")
    per = rows.groupBy("_p").agg(*aggs, F.min(row)["v"].alias("v"), F.max(row)["v"].alias("_last"))
    return per.withColumn("p", F.lag("_last").over(Window.orderBy("_p"))).drop("_last")
