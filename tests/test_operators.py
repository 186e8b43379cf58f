"""Small frames with points, nulls, abutting and negative intervals, against expected rows or brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from axisweave.operators import algebra, checks, islands, joins, nearest, ranges, running
from axisweave.sources.bed import check_is_sorted

SCHEMA = "chrom string, start long, end long"


def frame(spark, rows, more=""):
    return spark.createDataFrame(rows, SCHEMA + more)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def hit(a, b):
    if None in a[:3] or None in b[:3] or a[0] != b[0]:
        return False
    w = lambda x: x[2] + (x[1] == x[2])
    return a[1] < w(b) and b[1] < w(a)


def some(seed, n, nulls=True):
    r = random.Random(seed)
    out = []
    for i in range(n):
        s = r.randrange(-20, 200)
        out.append((r.choice(["chr1", "chr2"]), s, s + r.choice([0, 1, 5, 20, 60]), i))
    return out + ([(None, None, None, n)] if nulls else [])


@pytest.fixture(scope="module")
def two(spark):
    a, b = some(1, 40), some(2, 30)
    return a, b, frame(spark, a, ", id long"), frame(spark, b, ", id long")


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_overlap(two, how):
    a, b, x, y = two
    want = [(p[3], q[3]) for p, q in itertools.product(a, b) if hit(p, q)]
    if how in ("left", "outer"):
        want += [(p[3], None) for p in a if not any(hit(p, q) for q in b)]
    if how in ("right", "outer"):
        want += [(None, q[3]) for q in b if not any(hit(p, q) for p in a)]
    for width in (None, 1, 7):
        assert rows(joins.overlap(x, y, how, width=width), "id", "id_") == sorted(want, key=str)


@pytest.mark.parametrize("how", ["left", "right", "outer"])
def test_overlap_of_long_and_far_rows(spark, how):
    """Short rows, a few that reach over many bins, a sentinel end, points, equal rows and rows that lack something."""
    r = random.Random(5)
    some = lambda n, k: [("c", s, s + r.choice([0, 1, 9, 40]), i) for i in range(n) for s in [r.randrange(-900, 900)]] + [("c", -700, 800, n), ("c", 0, 2**63 - 2, n + 1), ("c", -5000 - k, -890, n + 2), (None, 1, 2, n + 3), ("c", None, None, n + 4), (None, None, None, n + 5), ("d", 1, 2, n + 6)]
    a, b = some(60, 1), some(25, 2)
    a += [(*p[:3], p[3] + 100) for p in a[:10]]
    meets = lambda p, q: p[1] is not None and q[1] is not None and hit(p, q)
    want = [(p[3], q[3]) for p, q in itertools.product(a, b) if meets(p, q)]
    if how != "right":
        want += [(p[3], None) for p in a if not any(meets(p, q) for q in b)]
    if how != "left":
        want += [(None, q[3]) for q in b if not any(meets(p, q) for p in a)]
    x, y = frame(spark, a, ", id long"), frame(spark, b, ", id long")
    assert rows(joins.overlap(x, y, how), "id", "id_") == sorted(want, key=str)


def test_kept_rows_take_one_join(spark):
    """Each side of a left join is shuffled once, where nothing is long."""
    a, b = frame(spark, some(3, 40)[:-1], ", id long"), frame(spark, some(4, 40)[:-1], ", id long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
        assert plan(joins.overlap(a, b, "left")).count("Join") == 1
        assert plan(joins.setdiff(a, b)).count("Join") == 1 and plan(joins.overlap(a, b, "outer")).count("Join") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_overlap_columns_and_errors(spark, two):
    _, _, x, y = two
    df = joins.overlap(x, y, "inner", return_index=True, return_overlap="o")
    assert df.columns == ["index", "chrom", "start", "end", "id", "index_", "chrom_", "start_", "end_", "id_", "o_start", "o_end"]
    for bad in ({"how": "innter"}, {"how": "inner", "keep_order": True}, {"on": ["chrom"]}):
        with pytest.raises(ValueError):
            joins.overlap(x, y, **bad)
    with pytest.raises(TypeError):
        joins.overlap(x, y, on="id")


def test_points_and_abutting(spark):
    a = frame(spark, [("c", 1, 1), ("c", 2, 2), ("c", 2, 5)])
    b = frame(spark, [("c", 1, 2), ("c", 5, 9)])
    assert rows(joins.overlap(a, b, "inner"), "start", "end", "start_", "end_") == [(1, 1, 1, 2)]


def test_on_keys(spark):
    a = frame(spark, [("c", 0, 5, "+"), ("c", 0, 5, None)], ", strand string")
    b = frame(spark, [("c", 1, 2, "+"), ("c", 1, 2, None), ("c", 1, 2, "-")], ", strand string")
    assert rows(joins.overlap(a, b, "inner", on=["strand"]), "strand", "strand_") == [("+", "+"), (None, None)]
    assert rows(joins.setdiff(b, a, on=["strand"]), "strand") == [("-",)]


def test_counts_and_sets(two):
    a, b, x, y = two
    assert rows(joins.count_overlaps(x, y), "id", "count") == sorted(((p[3], sum(hit(p, q) for q in b)) for p in a), key=str)
    assert rows(joins.setdiff(x, y), "id") == sorted(((p[3],) for p in a if not any(hit(p, q) for q in b)), key=str)
    assert rows(joins.semi(x, y), "id") == sorted(((p[3],) for p in a if any(hit(p, q) for q in b)), key=str)
    cover = {}
    for p in a:
        cover[p[3]] = 0 if p[0] is None else len({u for q in b if q[0] == p[0] for u in range(max(p[1], q[1]), min(p[2], q[2]))})
    assert rows(joins.coverage(x, y), "id", "coverage") == sorted(cover.items(), key=str)


def test_merge_and_cluster(spark):
    df = frame(spark, [("chr1", 1, 5), ("chr1", 3, 8), ("chr1", 8, 10), ("chr1", 12, 14), ("chrX", 2, 2), (None, None, None)])
    assert rows(islands.merge(df), "chrom", "start", "end", "n_intervals") == sorted([("chr1", 1, 10, 3), ("chr1", 12, 14, 1), ("chrX", 2, 2, 1), (None, None, None, None)], key=str)
    assert (("chr1", 1, 14, 4)) in rows(islands.merge(df, 2), "chrom", "start", "end", "n_intervals")
    assert (("chr1", 8, 10, 1)) in rows(islands.merge(df, None), "chrom", "start", "end", "n_intervals")
    assert rows(islands.cluster(df), "start", "cluster") == sorted([(1, 0), (3, 0), (8, 0), (12, 1), (2, 2), (None, 3)], key=str)
    with pytest.raises(ValueError):
        islands.merge(df, -1)


def test_merge_over_stretches(spark):
    far = [("c", 65_000, 140_000), ("c", 70_000, 70_010), ("c", 139_999, 139_999), ("c", 140_001, 140_002), ("c", -70_000, -65_000)]
    assert rows(islands.merge(frame(spark, far)), "start", "end", "n_intervals") == sorted([(65_000, 140_000, 3), (140_001, 140_002, 1), (-70_000, -65_000, 1)], key=str)


@pytest.mark.parametrize("dist, want", [(0, [(0, 9, 3), (20, 25, 2)]), (None, [(0, 5, 2), (5, 9, 1), (20, 25, 2)]), (11, [(0, 25, 5)])])
def test_merge_of_equal_rows_in_any_order(spark, monkeypatch, dist, want):
    passes = islands.running

    def dealt_anew(*args, **more):
        """Equal rows come from the first pass with the one that opens the cluster last."""
        out = passes(*args, **more)
        return out.repartition(1).sortWithinPartitions(F.col("_far").desc_nulls_last()) if "_far" in out.columns else out

    monkeypatch.setattr(islands, "running", dealt_anew)
    df = frame(spark, [("c", 20, 25), ("c", 0, 5), ("c", 5, 9), ("c", 0, 5), ("c", 20, 25)])
    assert rows(islands.merge(df, dist), "start", "end", "n_intervals") == sorted(want, key=str)
    assert islands.cluster(df, dist).select("cluster").distinct().count() == len(want)


def test_complement_and_subtract(spark):
    df = frame(spark, [("chr1", 1, 5), ("chr1", 3, 8), ("chr1", 10, 10), ("chr2", 0, 20)])
    view = spark.createDataFrame([("chr1", 0, 15, "a"), ("chr2", 0, 20, "b"), ("chr3", 4, 9, "d")], SCHEMA + ", name string")
    assert rows(algebra.complement(df, view), "chrom", "start", "end", "view_region") == [("chr1", 0, 1, "a"), ("chr1", 10, 15, "a"), ("chr1", 8, 10, "a"), ("chr3", 4, 9, "d")]
    free = rows(algebra.complement(df), "chrom", "start", "end")
    assert ("chr1", 10, ranges.LAST) in free and ("chr2", 20, ranges.LAST) in free
    a = frame(spark, [("chr1", 0, 12, 7), ("chr2", 3, 9, 8), ("chr9", 1, 2, 9), (None, None, None, 6)], ", id long")
    assert rows(algebra.subtract(a, df, return_index=True), "id", "start", "end", "sub_index_") == [(7, 0, 1, 0), (7, 10, 12, 2), (7, 8, 10, 1), (9, 1, 2, 0)]
    assert algebra.subtract(df.where("start < end"), df).isEmpty()


def test_select_rules(spark):
    df = frame(spark, [("c", 0, 10), ("c", 10, 20), ("c", 10, 10), ("c", -5, -1)])
    assert rows(ranges.select(df, ("c", 10, 10)), "start", "end") == [(10, 10)]
    assert rows(ranges.select(df, ("c", 4, 4)), "start", "end") == [(0, 10)]
    assert rows(ranges.select(df, "c"), "start", "end") == [(0, 10), (10, 10), (10, 20)]
    assert rows(ranges.select(df, "c:9-11"), "start", "end") == [(0, 10), (10, 10), (10, 20)]


def test_expand_and_trim(spark):
    df = frame(spark, [("c", 10, 21), ("c", 0, 4)])
    assert rows(ranges.expand(df, pad=-100), "start", "end") == [(15, 15), (2, 2)]
    assert rows(ranges.expand(df, scale=0), "start", "end") == [(16, 16), (2, 2)]
    for bad in ({}, {"pad": 1, "scale": 2}, {"pad": 1.5}, {"scale": -1}):
        with pytest.raises(ValueError):
            ranges.expand(df, **bad)
    view = spark.createDataFrame([("c", 2, 15, "v")], SCHEMA + ", name string")
    assert rows(ranges.trim(df, view), "start", "end") == [(10, 15), (2, 4)]
    far = frame(spark, [("c", 32, 36)]).withColumn("r", F.lit("v"))
    assert rows(ranges.trim(far, view, df_view_col="r"), "start", "end") == [(15, 15)]


def nearest_brute(a, b, k, own=False, skip=False):
    out = []
    for p in a:
        if p[0] is None:
            continue
        c = []
        for q in b:
            if q[0] == p[0] and not (own and q[3] == p[3]):
                h, g = hit(p, q), max(0, p[1] - q[2], q[1] - p[2])
                if not (h and skip):
                    c.append((0 if h else g + 1, q[3], g))
        out += [(p[3], x[1], x[2]) for x in sorted(c)[:k]] or [(p[3], None, None)]
    return sorted(out, key=str)


@pytest.mark.parametrize("k", [1, 3])
def test_closest(two, k):
    a, b, x, y = two
    assert rows(nearest.closest(x, y, k, tie_breaking_col="id"), "id", "id_", "distance") == nearest_brute(a, b, k)
    assert rows(nearest.closest(x, None, k, tie_breaking_col="id"), "id", "id_", "distance") == nearest_brute(a, a, k, own=True)


def test_closest_of_targets_found_twice(spark):
    """Points that are overlaps and neighbours by rank count once, without a hash table of all candidates."""
    a, b = [("c", 5, 5, 0), ("c", 5, 9, 1), ("c", 6, 6, 2)], [("c", 5, 5, 0), ("c", 5, 5, 1), ("c", 6, 6, 2), ("c", 9, 9, 3)]
    df = nearest.closest(frame(spark, a, ", id long"), frame(spark, b, ", id long"), 3, tie_breaking_col="id")
    assert rows(df, "id", "id_", "distance") == nearest_brute(a, b, 3)
    assert "keys=[q#" not in df._jdf.queryExecution().sparkPlan().toString()


def test_closest_direction(spark):
    a = frame(spark, [("c", 10, 12, "+"), ("c", 10, 12, "-")], ", strand string")
    b = frame(spark, [("c", 1, 5, "l"), ("c", 20, 25, "r")], ", strand string")
    assert rows(nearest.closest(a, b, ignore_upstream=True, direction_col="strand"), "strand", "strand_") == [("+", "r"), ("-", "l")]
    with pytest.raises(ValueError):
        nearest.closest(a, a)
    with pytest.raises(ValueError):
        nearest.closest(a, b, 0)


def test_runs(spark):
    df = spark.createDataFrame([("c", 0, 5, 1.0), ("c", 5, 9, 1.0), ("c", 9, 12, float("nan")), ("c", 12, 13, float("nan")), ("c", 20, 21, float("nan")), ("d", 0, 1, 2.0)], SCHEMA + ", v double")
    assert rows(islands.mark_runs(df, "v"), "chrom", "start", "run") == sorted([("c", 0, 0), ("c", 5, 0), ("c", 9, 1), ("c", 12, 1), ("c", 20, 2), ("d", 0, 0)], key=str)
    assert rows(islands.mark_runs(df, "v", reset_counter=False), "chrom", "run")[-1] == ("d", 3)
    assert rows(islands.merge_runs(df, "v", agg={"n": ("start", "count")}), "start", "end", "n") == sorted([(0, 9, 2), (9, 13, 2), (20, 21, 1), (0, 1, 1)], key=str)
    with pytest.raises(ValueError):
        islands.mark_runs(df.union(df), "v")


def test_checks(spark):
    good = spark.createDataFrame([("c", 0, 5, "a"), ("c", 5, 9, "b")], SCHEMA + ", name string")
    assert checks.is_bedframe(good) and checks.is_viewframe(good) and checks.is_contained(good, good) and checks.is_covering(good, good)
    assert checks.is_tiling(good.withColumn("view_region", F.col("name")), good)
    assert not checks.is_bedframe(good.drop("end")) and not checks.is_bedframe(frame(spark, [("c", 5, 1)]))
    assert not checks.is_bedframe(frame(spark, [("c", None, None)]))
    with pytest.raises(TypeError):
        checks.is_bedframe(good.drop("end"), raise_errors=True)
    with pytest.raises(ValueError):
        checks.is_bedframe(frame(spark, [("c", 5, 1)]), raise_errors=True)
    with pytest.raises(AssertionError):
        checks.is_contained(frame(spark, [("c", 3, 20)]), good, raise_errors=True)
    n = good.withColumn("i", F.col("start"))
    assert checks.is_sorted(n, order_col="i") and not checks.is_sorted(n.withColumn("i", -F.col("i")), order_col="i")


def test_sorted_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(running, "STRETCH_ROWS", 10)
    at = [("c", 3 * i, 3 * i + 1, i) for i in range(60)]
    flip = lambda k: [*at[:k], ("c", *at[k + 1][1:3], k), ("c", *at[k][1:3], k + 1), *at[k + 2 :]]
    look = lambda r: frame(spark, r, ", i long").repartition(3, "start")
    assert checks.is_sorted(look(at), order_col="i") and check_is_sorted(look(at), "i")
    for k in (0, 9, 10, 31, 58):  # within ranges and at their borders
        assert not checks.is_sorted(look(flip(k)), order_col="i") and not check_is_sorted(look(flip(k)), "i")
    torn = [("d" if i == 40 else c, s, e, i) for c, s, e, i in at]
    assert not check_is_sorted(look(torn), "i") and check_is_sorted(look([("d" if i > 40 else c, s, e, i) for c, s, e, i in at]), "i")
    equal = frame(spark, [("c", 5, 6, 0), ("c", 1, 2, 0), ("c", 7, 9, 1)], ", i long").coalesce(1)
    assert checks.is_sorted(equal, order_col="i") and check_is_sorted(equal, "i")
    assert checks.is_sorted(frame(spark, [], ", i long"), order_col="i") and check_is_sorted(frame(spark, [], ", i long"), "i")


def test_depth_and_levels(spark):
    df = frame(spark, [("c", 0, 5), ("c", 3, 8)])
    assert rows(islands.depth_profile(df), "start", "end", "depth") == [(0, 3, 1), (3, 5, 2), (5, 8, 1)]
    assert rows(islands.stack_levels(df), "start", "level") == [(0, 0), (3, 1)]


def test_empty(spark):
    none = frame(spark, [])
    some_ = frame(spark, [("c", 0, 5)])
    assert joins.overlap(none, some_, "outer").count() == 1
    assert islands.merge(none).isEmpty() and islands.cluster(none).isEmpty() and algebra.complement(none).isEmpty()
    assert rows(joins.count_overlaps(some_, none), "count") == [(0,)]
    assert rows(nearest.closest(some_, none), "start", "distance") == [(0, None)]


def test_closed_overlap(spark):
    a = spark.createDataFrame([("c", 0, 5), ("c", 7, 7)], "chrom string, start long, end long")
    b = spark.createDataFrame([("c", 5, 9), ("c", 10, 12)], "chrom string, start long, end long")
    for more in ({}, {"return_index": True}):
        got = lambda closed: sorted((r["start"], r["start_"]) for r in joins.overlap(a, b, "inner", closed=closed, **more).collect())  # noqa: E731, B023
        assert got(False) == [(7, 5)] and got(True) == [(0, 5), (7, 5)]
    size = joins.overlap_size(*(F.col(c) for c in ("start", "end", "s2", "e2")))
    pairs = spark.createDataFrame([(0, 5, 3, 9), (0, 5, 5, 9), (0, 5, 6, 9)], "start long, end long, s2 long, e2 long")
    assert [r[0] for r in pairs.select(size).collect()] == [2, 0, -1]
