"""Interval operators on streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisweave.config import interval_cols
from axisweave.operators.joins import wide_end
from axisweave.operators.running import floor_div


def stream_overlap(stream: DataFrame, static: DataFrame, *, width: int, suffixes=("", "_"), cols1=None, cols2=None, on: list[str] | None = None) -> DataFrame:
    """Inner overlap of a stream with a static table, by bins of a fixed width; no state is kept."""
    c1, c2, on = interval_cols(cols1), interval_cols(cols2), on or []

    def side(df, c, sfx, tag):
        s, e = F.col(c.start), F.col(c.end)
        out = df.where(F.col(c.chrom).isNotNull() & s.isNotNull() & e.isNotNull())
        out = out.withColumn("_b", F.explode(F.sequence(floor_div(s, width), F.greatest(floor_div(s, width), floor_div(wide_end(s, e) - 1, width)))))
        return out.select(*[F.col(x).alias(f"{x}{sfx}") for x in df.columns], F.col("_b").alias(f"_b{tag}"))

    a, b = side(stream, c1, suffixes[0], 1), side(static, c2, suffixes[1], 2)
    col = lambda c, i: F.col(f"{c}{suffixes[i]}")
    s1, e1, s2, e2 = col(c1.start, 0), col(c1.end, 0), col(c2.start, 1), col(c2.end, 1)
    keys = [col(c1.chrom, 0) == col(c2.chrom, 1), F.col("_b1") == F.col("_b2"), *[col(k, 0).eqNullSafe(col(k, 1)) for k in on]]
    first = F.col("_b1") == F.greatest(floor_div(s1, width), floor_div(s2, width))
    return a.join(b, reduce(lambda x, y: x & y, keys) & first & (s1 < wide_end(s2, e2)) & (s2 < wide_end(s1, e1))).drop("_b1", "_b2")


def session_merge(stream: DataFrame, time_col: str, gap: str, *, keys: list[str], watermark: str) -> DataFrame:
    """Sessions of events of equal keys no further apart than `gap`: start, end and count, final once the watermark has passed."""
    w = F.session_window(time_col, gap)
    out = stream.withWatermark(time_col, watermark).groupBy(*keys, w.alias("_w")).agg(F.count("*").alias("n_intervals"))
    return out.select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n_intervals")
