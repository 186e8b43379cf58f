"""Mixing sources to target weights: Sainte-Laguë quotas over the whole mix, spread over shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axisweave.llm.text import WORD, stored

#: Repeats of a source at most, shards of every source's stream at least, words of a run at most, runs of all sources in a shard at most, buckets of the seeded order at least, and words of all sources for each bucket.
MAX_REPEATS, SHARDS, BLOCK, SHARD_BLOCKS, BUCKETS, BUCKET_WORDS = 3, 16, 64, 1 << 20, 256, 1 << 20
SEED = "mix"


def _div(a: Column, b: Column | int) -> Column:
    """Whole-number quotient of numbers that are not negative."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size (words) and target (words, double) of every source.

    Sources in code point order, null last, weigh 1, 2, 3, repeating. A target stops at max_repeats times
    its source's size and the excess is shared by weight among the rest until none is above: with
    sources in order of cap / weight, a source is capped if its cap stays below its share of what the
    earlier caps leave. The table has a row a source, and only it is ordered in one task.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("w", (F.row_number().over(order) - 1) % 3 + 1).withColumn("cap", F.lit(max_repeats) * F.col("source_size"))
    every = Window.partitionBy()
    rank = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    before, after = rank.rowsBetween(Window.unboundedPreceding, -1), rank.rowsBetween(0, Window.unboundedFollowing)
    by = by.withColumn("total", F.sum("source_size").over(every))
    by = by.withColumn("rest", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("wr", F.sum("w").over(after))
    by = by.withColumn("level", F.col("rest") / F.col("wr"))
    by = by.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("level").alias("x")))).over(every)["x"])
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("w"))
    return by.select("source", "source_size", F.coalesce(target, F.col("cap").cast("double")).alias("target"))


def quotas(targets: DataFrame, shards: int = SHARDS, block: int = BLOCK, max_repeats: int | None = None) -> DataFrame:
    """source, shard, begin, length (its words of the source's stream) and seats (blocks it takes), by Sainte-Laguë.

    The whole mix's seats, one for each `block` words of the targets, go to the highest quotients target / (2k - 1).
    Only quotients near each source's share can be the last to win: the divisor method's total at the standard
    divisor is off by half the number of sources at most, so a source's seats lie within its share of that many, and the rest
    is certain. A source never takes more than max_repeats times its words. A shard holds the same part of every source's
    stream and the same part of its seats, what one shard's rounding leaves being carried to the next.
    """
    every = Window.partitionBy()
    s = targets.withColumn("_n", F.count("*").over(every)).withColumn("part", F.when(F.col("source_size") > 0, F.col("target")).otherwise(F.lit(0.0))).withColumn("all", F.sum("part").over(every))
    s = s.withColumn("n", F.round(F.col("all") / block).cast("long")).withColumn("share", F.when(F.col("all") > 0, F.col("part") / F.col("all")).otherwise(F.lit(0.0)))
    slack = F.col("share") * F.col("_n") / 2 + 1
    s = s.withColumn("sure", F.greatest(F.lit(0).cast("long"), F.floor(F.col("share") * F.col("n") - slack).cast("long")))
    s = s.withColumn("most", F.ceil(F.col("share") * F.col("n") + slack).cast("long")).withColumn("given", F.sum("sure").over(every))
    open_ = s.where("part > 0").withColumn("k", F.explode(F.expr("sequence(sure + 1, most)"))).withColumn("quotient", F.col("part") / (2 * F.col("k") - 1))
    best = Window.partitionBy().orderBy(F.col("quotient").desc(), F.col("source").asc_nulls_last(), "k")
    won = open_.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= F.col("n") - F.col("given"))
    won = won.groupBy(F.col("source").alias("_source")).agg(F.count("*").alias("more"))
    got = s.join(won, s.source.eqNullSafe(won._source), "left").withColumn("all_seats", F.col("sure") + F.coalesce("more", F.lit(0)))
    if max_repeats is not None:
        got = got.withColumn("all_seats", F.least("all_seats", _div(max_repeats * F.col("source_size"), block)))
    got = got.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    edge = lambda k: _div(F.col("source_size") * k, shards)
    wide = lambda c: c.cast("decimal(19,0)")
    upto = lambda x: F.when(F.col("source_size") > 0, _div(wide(F.col("all_seats")) * wide(x), wide(F.col("source_size")))).otherwise(F.lit(0)).cast("long")
    got = got.withColumn("begin", edge(F.col("shard"))).withColumn("end", edge(F.col("shard") + 1))
    return got.select("source", "shard", "begin", (F.col("end") - F.col("begin")).alias("length"), (upto(F.col("end")) - upto(F.col("begin"))).alias("seats"))


def _phase(source: Column, shard: Column) -> Column:
    """Seeded start of the even selection, below 2**16."""
    name = F.concat_ws("|", F.lit(SEED), F.coalesce(source, F.lit("\x00")), shard.cast("string"))
    return F.conv(F.substring(F.md5(name), 1, 4), 16, 10).cast("long")


def mix(docs: DataFrame, *, text: str = "text", key: str = "doc_id", source: str = "source", max_repeats: int = MAX_REPEATS, shards: int | None = None, block: int = BLOCK) -> DataFrame:
    """key, size, source_size, target and taken of every row.

    Each source's texts are laid end to end in seeded order and the stream is cut into shards. Words are apportioned
    once over the whole mix: a shard is taken as many whole times as its seats allow, and a seeded, even
    selection of runs of `block` words or fewer once more. taken is what falls on the row's words, so no row exceeds max_repeats
    times its size, and a source's total differs from its target by the rounding of whole words alone, however small it is.

    Null texts have size 0, null sources are one source, rows without words take nothing. Rows that are
    equal in key and size may be dealt either way between themselves. Reruns agree.
    """
    sized = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    hashed = F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(F.col("key").cast("string"), F.lit(""))))
    sized = stored(sized.withColumn("h", hashed), "sizes")
    targets = stored(source_targets(sized, max_repeats), "targets")
    total = targets.agg(F.sum("source_size")).first()[0] or 0
    shards = shards or max(SHARDS, total // (block * SHARD_BLOCKS) + 1)
    part = quotas(targets, shards, 1, max_repeats)
    # words taken from a stream before position x, within a shard: whole times first, then a run in each of equal cells
    part = part.withColumn("each", F.when(F.col("length") > 0, _div(F.col("seats"), F.col("length"))).otherwise(F.lit(0)).cast("long"))
    part = part.withColumn("extra", F.col("seats") - F.col("each") * F.col("length")).withColumn("phase", _phase(F.col("source"), F.col("shard")))
    part = part.withColumn("cells", F.ceil(F.col("extra") / block).cast("long"))

    def before(x: Column) -> Column:
        cells, length = (F.greatest(F.lit(1).cast("long"), F.col(c)) for c in ("cells", "length"))
        cell = F.least(cells - 1, _div((x + 1) * cells - 1, length))
        begin, end = (_div(length * k, cells) for k in (cell, cell + 1))
        past, upto = (_div(F.col("extra") * c, length) for c in (begin, end))
        skip = _div((end - begin - upto + past) * F.col("phase"), 1 << 16)
        run = past + F.least(upto - past, F.greatest(F.lit(0).cast("long"), x - begin - skip))
        return F.col("each") * x + F.when(F.col("cells") > 0, run).otherwise(F.lit(0).cast("long"))

    part = part.withColumn("sum", before(F.col("length")))
    past = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    part = stored(part.withColumn("past", F.coalesce(F.sum("sum").over(past), F.lit(0))), "parts")

    # each row's place in its source's stream: place of its bucket, then place in the bucket
    sized = sized.withColumn("bucket", F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % max(BUCKETS, total // BUCKET_WORDS))
    totals = sized.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(totals, placed.source.eqNullSafe(totals._source) & (placed.bucket == totals._bucket), "left")
    placed = placed.withColumn("at", F.col("at") + F.col("start")).drop("_source", "_bucket", "start")
    t = targets.select(F.col("source").alias("_source"), "source_size", "target")
    placed = placed.join(t, placed.source.eqNullSafe(t._source), "left").drop("_source")
    shard_of = lambda x: F.least(F.lit(shards - 1).cast("long"), _div((x + 1) * shards - 1, F.greatest(F.lit(1).cast("long"), F.col("source_size")))).cast("int")

    def upto(df: DataFrame, x: str, name: str) -> DataFrame:
        """Add the words taken before position x of the row's stream."""
        p = part.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "begin", "length", "cells", "each", "extra", "phase", "past")
        df = df.withColumn("s", shard_of(F.col(x)))
        df = df.join(p, df.source.eqNullSafe(p._source) & (df.s == p._shard), "left")
        return df.withColumn(name, F.col("past") + before(F.col(x) - F.col("begin"))).drop(*p.columns, "s")

    placed = upto(placed.withColumn("to", F.col("at") + F.col("size")), "at", "t0")
    placed = upto(placed, "to", "t1")
    taken = F.when(F.col("size") > 0, F.col("t1") - F.col("t0")).otherwise(F.lit(0)).cast("long")
    return placed.select(F.col("key").alias(key), "size", "source_size", "target", taken.alias("taken"))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: all documents, mixed by source."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The query by brute force: seats by ranking all quotients, and every word of every stream by itself.
SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
tot AS (SELECT sum(source_size)::BIGINT AS total FROM src),
cap AS (SELECT a.source, {MAX_REPEATS} * a.source_size / a.w AS ratio, (SELECT (total - coalesce(sum({MAX_REPEATS} * b.source_size) FILTER ({MAX_REPEATS} * b.source_size / b.w < {MAX_REPEATS} * a.source_size / a.w), 0)) / sum(b.w) FILTER ({MAX_REPEATS} * b.source_size / b.w >= {MAX_REPEATS} * a.source_size / a.w) FROM src b, tot GROUP BY total) AS level FROM src a),
lev AS (SELECT min_by(level, ratio) AS level FROM cap WHERE level <= ratio),
tar AS (SELECT source, source_size, CASE WHEN level IS NULL THEN ({MAX_REPEATS} * source_size)::DOUBLE ELSE least(({MAX_REPEATS} * source_size)::DOUBLE, level * w) END AS target FROM src, lev),
quo AS (SELECT source, target / (2 * k - 1) AS q, k FROM (SELECT source, target, unnest(range(1, ceil(target)::BIGINT + 10)) AS k FROM tar WHERE source_size > 0)),
won AS (SELECT source, count(*) AS seats FROM (SELECT source FROM quo ORDER BY q DESC, source NULLS LAST, k LIMIT (SELECT round(sum(target))::BIGINT FROM tar WHERE source_size > 0)) GROUP BY source),
shd AS (SELECT greatest({SHARDS}, total // ({BLOCK} * {SHARD_BLOCKS}) + 1) AS shards FROM tot),
par AS (SELECT t.source, t.source_size, k, t.source_size * k // shards AS b, t.source_size * (k + 1) // shards AS e, least(coalesce(won.seats, 0), {MAX_REPEATS} * t.source_size) AS seats FROM tar t LEFT JOIN won ON t.source IS NOT DISTINCT FROM won.source, shd, unnest(range(0, shards)) AS u(k)),
quota AS (SELECT source, k, b, e - b AS length, seats * e // source_size - seats * b // source_size AS n, ('0x' || substr(md5('{SEED}|' || coalesce(source, chr(0)) || '|' || k::VARCHAR), 1, 4))::BIGINT AS phase FROM par WHERE e > b),
cells AS (SELECT *, n // length AS each, n % length AS extra, (n % length + {BLOCK} - 1) // {BLOCK} AS cells FROM quota),
word AS (SELECT *, CASE WHEN cells > 0 THEN ((x + 1) * cells - 1) // length END AS c FROM (SELECT *, unnest(range(0, length)) AS x FROM cells)),
edge AS (SELECT *, length * c // cells AS cb, length * (c + 1) // cells AS ce FROM word),
run AS (SELECT *, extra * ce // length - extra * cb // length AS r FROM edge),
took AS (SELECT source, b + x AS pos, each + CASE WHEN cells > 0 AND x - cb >= (ce - cb - r) * phase // 65536 AND x - cb < (ce - cb - r) * phase // 65536 + r THEN 1 ELSE 0 END AS t FROM run),
place AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY ('0x' || substr(h, 1, 8))::BIGINT % greatest({BUCKETS}, total // {BUCKET_WORDS}), h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM d, tot),
docword AS (SELECT doc_id, source, unnest(range(pos, pos + size)) AS pos FROM place),
taken AS (SELECT w.doc_id, sum(t)::BIGINT AS taken FROM docword w JOIN took ON w.source IS NOT DISTINCT FROM took.source AND w.pos = took.pos GROUP BY w.doc_id)
SELECT d.doc_id, d.size, tar.source_size, tar.target, coalesce(taken.taken, 0)::BIGINT AS taken
FROM d LEFT JOIN tar ON d.source IS NOT DISTINCT FROM tar.source LEFT JOIN taken USING (doc_id)
"""
