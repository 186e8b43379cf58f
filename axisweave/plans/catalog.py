"""Registered queries of the interval operators and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from axisweave.functions import construct, genome
from axisweave.functions.construct import sanitize_bedframe
from axisweave.functions.regions import region_columns, ucsc_string
from axisweave.operators import algebra, checks, islands, joins, nearest, ranges
from axisweave.sources.bed import to_bed_dataframe
from axisweave.plans.tables import CTE, events, lineitems, orders, parts, view
from axisweave.storage import numbered

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: SQL of what overlaps: points are widened to length 1.
_HIT = "{a}.chrom = {b}.chrom AND {a}.s < CASE WHEN {b}.s = {b}.e THEN {b}.e + 1 ELSE {b}.e END AND {b}.s < CASE WHEN {a}.s = {a}.e THEN {a}.e + 1 ELSE {a}.e END"
AB, AV, BV = _HIT.format(a="A", b="B"), _HIT.format(a="A", b="V"), _HIT.format(a="B", b="V")


def _add(name: str, query, sql: str | None = None, more: str = "") -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = f"WITH {CTE.strip()}{', ' + more if more else ''} {sql}"


def _merged(source: str, keys: str, cond: str) -> str:
    """CTEs: W with the running maximum, I with island numbers, M with merged rows."""
    return f"""W AS (SELECT *, max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM {source}),
I AS (SELECT *, sum(CASE WHEN far IS NULL OR {cond} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM W),
M AS (SELECT {keys}, island, min(s) AS s, max(e) AS e, count(*) AS n FROM I GROUP BY {keys}, island)"""


_add("select_region", lambda s, d: ranges.select(orders(s, d), "chr7:1k-40k"), "SELECT chrom, s AS start, e AS \"end\", okey, strand FROM B WHERE chrom = 'chr7' AND ((s < 40000 AND e > 1000) OR (s = e AND s = 1000))")
_add("select_mask", lambda s, d: ranges.select_mask(orders(s, d), ("chr7", 1000, 40000)).select("okey", "mask"), "SELECT okey, chrom = 'chr7' AND ((s < 40000 AND e > 1000) OR (s = e AND s = 1000)) AS mask FROM B")
_add("select_labels", lambda s, d: ranges.select_labels(orders(s, d), "chr9", "okey"), "SELECT okey FROM B WHERE chrom = 'chr9' AND (e > 0 OR (s = e AND s = 0))")
_add("expand_pad", lambda s, d: ranges.expand(orders(s, d), pad=15), "SELECT chrom, s - 15 AS start, e + 15 AS \"end\", okey, strand FROM B")
_add("expand_neg_pad", lambda s, d: ranges.expand(orders(s, d), pad=-20), "SELECT chrom, least(s + 20, s + CAST(trunc((e - s) * 0.5) AS BIGINT)) AS start, greatest(e - 20, s + CAST(trunc((e - s) * 0.5) AS BIGINT)) AS \"end\", okey, strand FROM B")
_add("expand_scale", lambda s, d: ranges.expand(orders(s, d), scale=1.5), "SELECT chrom, CAST(round_even(s - 0.25 * (e - s), 0) AS BIGINT) AS start, CAST(round_even(e + 0.25 * (e - s), 0) AS BIGINT) AS \"end\", okey, strand FROM B")
_add("expand_left", lambda s, d: ranges.expand(orders(s, d), pad=7, side="left"), "SELECT chrom, s - 7 AS start, e AS \"end\", okey, strand FROM B")

_PAIR = 'A.chrom, A.s AS start, A.e AS "end", A.strand, B.chrom AS chrom_, B.s AS start_, B.e AS end_, B.okey AS okey_, B.strand AS strand_'
for _how, _sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("outer", "FULL JOIN")):
    _add(f"overlap_{_how}", lambda s, d, h=_how: joins.overlap(lineitems(s, d), orders(s, d), h), f"SELECT {_PAIR} FROM A {_sql} B ON {AB}")
_add("overlap_on_strand", lambda s, d: joins.overlap(orders(s, d), orders(s, d), "inner", on=["strand"]).select("okey", "okey_"), f"SELECT X.okey, Y.okey AS okey_ FROM B X JOIN B Y ON {_HIT.format(a='X', b='Y')} AND X.strand IS NOT DISTINCT FROM Y.strand")
_add("overlap_segment", lambda s, d: joins.overlap(lineitems(s, d), orders(s, d), "inner", return_overlap=True, return_input=False), f"SELECT greatest(A.s, B.s) AS overlap_start, least(A.e, B.e) AS overlap_end FROM A JOIN B ON {AB}")
_add("setdiff", lambda s, d: joins.setdiff(lineitems(s, d), orders(s, d)), f'SELECT chrom, s AS start, e AS "end", strand FROM A WHERE NOT EXISTS (SELECT 1 FROM B WHERE {AB})')
_add("semi_overlap", lambda s, d: joins.semi(lineitems(s, d), orders(s, d)), f'SELECT chrom, s AS start, e AS "end", strand FROM A WHERE EXISTS (SELECT 1 FROM B WHERE {AB})')
_add("count_overlaps", lambda s, d: joins.count_overlaps(orders(s, d), lineitems(s, d)).select("okey", "count"), f'SELECT B.okey, count(A.chrom) AS "count" FROM B LEFT JOIN A ON {AB} GROUP BY B.okey')
_add("coverage", lambda s, d: joins.coverage(orders(s, d), lineitems(s, d)).select("okey", "coverage"), f"SELECT B.okey, CAST(coalesce(sum(CASE WHEN M.s IS NULL THEN 0 ELSE greatest(0, least(M.e, B.e) - greatest(M.s, B.s)) END), 0) AS BIGINT) AS coverage FROM B LEFT JOIN M ON {_HIT.format(a='M', b='B')} GROUP BY B.okey", _merged("A", "chrom", "s > far"))
_add("union_intervals", lambda s, d: lineitems(s, d).select("chrom", "start", "end").unionByName(orders(s, d).select("chrom", "start", "end")), 'SELECT chrom, s AS start, e AS "end" FROM A UNION ALL SELECT chrom, s, e FROM B')

for _name, _dist, _cond in (("merge", 0, "s > far"), ("merge_min_dist", 25, "s > far + 25"), ("merge_none", None, "s >= far")):
    _add(_name, lambda s, d, x=_dist: islands.merge(lineitems(s, d), x), 'SELECT chrom, s AS start, e AS "end", n AS n_intervals FROM M', _merged("A", "chrom", _cond))
_add("merge_on", lambda s, d: islands.merge(lineitems(s, d), on=["strand"]), 'SELECT chrom, s AS start, e AS "end", strand, n AS n_intervals FROM M', _merged("A", "chrom, strand", "s > far"))
_CLUSTER = "SELECT okey, CAST(base + island - 1 AS BIGINT) AS cluster, M.s AS cluster_start, M.e AS cluster_end FROM I JOIN M USING (chrom, island) JOIN G USING (chrom)"
_add("cluster", lambda s, d: islands.cluster(orders(s, d)).select("okey", "cluster", "cluster_start", "cluster_end"), _CLUSTER, _merged("B", "chrom", "s > far") + ", G AS (SELECT chrom, coalesce(sum(count(*)) OVER (ORDER BY chrom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM M GROUP BY chrom)")
_add("depth_profile", lambda s, d: islands.depth_profile(lineitems(s, d)), 'SELECT chrom, p AS start, nxt AS "end", CAST(depth AS BIGINT) AS depth FROM (SELECT chrom, p, lead(p) OVER w AS nxt, sum(x) OVER (PARTITION BY chrom ORDER BY p ROWS UNBOUNDED PRECEDING) AS depth FROM (SELECT chrom, p, sum(x) AS x FROM (SELECT chrom, s AS p, 1 AS x FROM A UNION ALL SELECT chrom, e, -1 FROM A) GROUP BY chrom, p) WINDOW w AS (PARTITION BY chrom ORDER BY p)) WHERE nxt IS NOT NULL AND depth <> 0')
_RUNS = """W AS (SELECT *, max(e) OVER (PARTITION BY chrom ORDER BY s, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far, lag(grp) OVER (PARTITION BY chrom ORDER BY s, e, event_id) AS pg FROM E),
R AS (SELECT *, sum(CASE WHEN far IS NULL OR s > far OR grp IS DISTINCT FROM pg THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s, e, event_id ROWS UNBOUNDED PRECEDING) - 1 AS run FROM W)"""


_add("mark_runs", lambda s, d: islands.mark_runs(events(s, d), "grp", allow_overlaps=True, tie=["event_id"]).select("event_id", "run"), "SELECT event_id, CAST(run AS BIGINT) AS run FROM R", _RUNS)
_add("merge_runs", lambda s, d: islands.merge_runs(events(s, d), "grp", allow_overlaps=True, tie=["event_id"], agg={"n": ("event_id", "count")}), 'SELECT chrom, min(s) AS start, max(e) AS "end", min(grp) AS grp, count(*) AS n FROM R GROUP BY chrom, run', _RUNS)

_GAPS = """X AS (SELECT V.name AS chrom, V.chrom AS c, V.s AS lo, V.e AS hi, greatest(A.s, V.s) AS s, least(A.e, V.e) AS e FROM A JOIN V ON {av}),
{merged}, K AS (SELECT M.*, V.chrom AS c, V.s AS lo, V.e AS hi FROM M JOIN V ON M.chrom = V.name WHERE M.e > V.s AND M.s < V.e),
L AS (SELECT *, lag(e) OVER (PARTITION BY chrom ORDER BY s) AS pe, lead(s) OVER (PARTITION BY chrom ORDER BY s) AS ns FROM K)"""
_add(
    "complement", lambda s, d: algebra.complement(lineitems(s, d), view(s, d)),
    """SELECT c AS chrom, coalesce(pe, lo) AS start, s AS "end", chrom AS view_region FROM L WHERE pe IS NOT NULL OR s > lo
UNION ALL SELECT c, e, hi, chrom FROM L WHERE ns IS NULL AND e < hi UNION ALL SELECT chrom, s, e, name FROM V WHERE name NOT IN (SELECT chrom FROM K)""",
    _GAPS.format(av=AV, merged=_merged("X", "chrom", "s > far")),
)
_FREE = _merged("A", "chrom", "s > far") + """, L AS (SELECT *, lag(e) OVER (PARTITION BY chrom ORDER BY s) AS pe, lead(s) OVER (PARTITION BY chrom ORDER BY s) AS ns FROM M WHERE e > 0),
F AS (SELECT chrom, coalesce(pe, 0) AS s, s AS e FROM L WHERE pe IS NOT NULL OR s > 0 UNION ALL SELECT chrom, e, 9223372036854775807 FROM L WHERE ns IS NULL UNION ALL SELECT DISTINCT chrom, 0, 9223372036854775807 FROM B WHERE chrom NOT IN (SELECT chrom FROM L))"""
_add("subtract", lambda s, d: algebra.subtract(orders(s, d), lineitems(s, d)), f'SELECT B.chrom, greatest(B.s, F.s) AS start, least(B.e, F.e) AS "end", okey, strand FROM B JOIN F ON {_HIT.format(a="B", b="F")}', _FREE)

_BEST = f"""J AS (SELECT B.okey, V.name, row_number() OVER (PARTITION BY B.okey ORDER BY least(B.e, V.e) - greatest(B.s, V.s) DESC, V.s, V.name) AS k FROM B JOIN V ON {BV}), N AS (SELECT B.*, J.name FROM B LEFT JOIN J ON B.okey = J.okey AND k = 1)"""
_add("assign_view", lambda s, d: ranges.assign_view(orders(s, d), view(s, d)).select("okey", "view_region"), "SELECT okey, name AS view_region FROM N", _BEST)
_add("trim", lambda s, d: ranges.trim(orders(s, d), view(s, d)).select("okey", "chrom", "start", "end"), 'SELECT okey, V.chrom, CASE WHEN V.s IS NOT NULL THEN least(greatest(N.s, V.s), V.e) END AS start, CASE WHEN V.s IS NOT NULL THEN least(greatest(N.e, V.s), V.e) END AS "end" FROM N LEFT JOIN V ON N.name = V.name', _BEST)


def _sorted(s: SparkSession, d: str) -> DataFrame:
    """Rows with the place that the sort gives them; rows of equal coordinates share the first of their places.

    The numbers are written down: read twice, the sort may be cut into other partitions, and places would not match them.
    """
    df = numbered(ranges.sort_bedframe(orders(s, d), view(s, d)), "_m")
    offset = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND((1 << 33) - 1))
    base = df.groupBy("_p").count().select("_p", F.coalesce(F.sum("count").over(offset), F.lit(0)).alias("_base"))
    df = df.join(base, "_p").withColumn("place", F.col("_base") + F.col("_i"))
    return df.withColumn("place", F.min("place").over(Window.partitionBy("chrom", "start", "end"))).select("okey", "place")


_add("sort_bedframe", _sorted, "SELECT okey, CAST(rank() OVER (ORDER BY x.i, B.s, B.e) - 1 AS BIGINT) AS place FROM N B JOIN (SELECT name, row_number() OVER () AS i FROM (SELECT name FROM V ORDER BY CAST(substr(chrom, 4) AS INT), s)) x ON B.name = x.name", _BEST)

_NEAR = """P AS (SELECT X.okey, Y.okey AS okey_, CASE WHEN {hit} THEN 0 ELSE greatest(0, X.s - Y.e, Y.s - X.e) + 1 END AS k, greatest(0, X.s - Y.e, Y.s - X.e) AS distance FROM {x} X JOIN {y} Y ON X.chrom = Y.chrom AND {cond}),
Q AS (SELECT *, row_number() OVER (PARTITION BY okey ORDER BY k, okey_) AS nth FROM P)"""
_YX = _HIT.format(a="X", b="Y")


def _closest(k: int, **more):
    def query(s: SparkSession, d: str) -> DataFrame:
        o, p = orders(s, d).select("chrom", "start", "end", "okey"), parts(s, d).select("chrom", "start", "end", "pkey")
        return nearest.closest(o, p, k=k, tie_breaking_col="pkey", **more).select("okey", "pkey_", "distance")

    return query


_TARGETS = "(SELECT chrom, s, e, pkey AS okey FROM P0)"
for _name, _k, _more, _cond in (
    ("closest_k1", 1, {}, "true"), ("closest_k3", 3, {}, "true"), ("closest_no_overlap", 2, {"ignore_overlaps": True}, f"NOT ({_YX})"),
    ("closest_downstream", 1, {"ignore_upstream": True}, f"(({_YX}) OR Y.s >= X.e)"), ("closest_upstream", 1, {"ignore_downstream": True}, f"(({_YX}) OR Y.e <= X.s)"),
    ("closest_directed", 1, {"ignore_upstream": True, "direction_col": "strand"}, f"(({_YX}) OR (coalesce(X.strand = 'F', false) AND Y.e <= X.s) OR (coalesce(X.strand, '') <> 'F' AND Y.s >= X.e))"),
):
    _query = _closest(_k, **_more)
    if "direction_col" in _more:  # orders that are finished run backwards

        def _query(s: SparkSession, d: str) -> DataFrame:
            o = orders(s, d).withColumn("strand", F.when(F.col("strand") == "F", "-").otherwise("+"))
            return nearest.closest(o, parts(s, d), tie_breaking_col="pkey", ignore_upstream=True, direction_col="strand").select("okey", "pkey_", "distance")

    _add(_name, _query, f"SELECT B.okey, Q.okey_ AS pkey_, Q.distance FROM B LEFT JOIN Q ON B.okey = Q.okey AND nth <= {_k}", _NEAR.format(hit=_YX, x="B", y=_TARGETS, cond=_cond))
_add("closest_self", lambda s, d: nearest.closest(orders(s, d).select("chrom", "start", "end", "okey"), tie_breaking_col="okey").select("okey", "okey_", "distance"), "SELECT B.okey, Q.okey_, Q.distance FROM B LEFT JOIN Q ON B.okey = Q.okey AND nth = 1", _NEAR.format(hit=_YX, x="B", y="B", cond="X.okey <> Y.okey"))
_ORDER = "O AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY s, e, okey) AS i, CAST(floor((s + e) / 2) AS BIGINT) AS mid FROM B)"
_add("pair_by_distance", lambda s, d: nearest.pair_by_distance(orders(s, d), 100, 2000, 0, 3, tie=["okey"]).select("okey_1", "okey_2"), "SELECT X.okey AS okey_1, Y.okey AS okey_2 FROM O X JOIN O Y ON X.chrom = Y.chrom AND Y.i > X.i AND Y.i - X.i - 1 <= 3 AND Y.mid - X.mid > 100 AND Y.mid - X.mid < 2000", _ORDER)

_add("binnify", lambda s, d: genome.binnify(view(s, d).groupBy("chrom").agg(F.max("end").alias("end")), 700, rel_ids=True), 'SELECT chrom, b * 700 AS start, least((b + 1) * 700, 2 * h) AS "end", b AS rel_id FROM (SELECT DISTINCT chrom FROM V), H, unnest(range(0, (2 * h + 699) // 700)) t(b)')
_add("chromarms", lambda s, d: genome.make_chromarms(s, view(s, d).groupBy("chrom").agg(F.max("end").alias("length")), view(s, d).where("start > 0").select("chrom", F.col("start").alias("mid"))), 'SELECT chrom, k * h AS start, (k + 1) * h AS "end", chrom || CASE WHEN k = 0 THEN \'_p\' ELSE \'_q\' END AS name FROM (SELECT DISTINCT chrom FROM V), H, range(0, 2) t(k)')
_LETTERS = lambda chars: "(length(text) - length(translate(text, '" + chars + "', '')))"
_add("seq_gc", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", genome.seq_gc(F.col("text")).alias("gc")), f"SELECT doc_id, CASE WHEN length(text) - {_LETTERS('Nn')} > 0 THEN {_LETTERS('GgCc')} / (length(text) - {_LETTERS('Nn')}) END AS gc FROM documents")


def _sequences(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = s.read.parquet(f"{d}/documents.parquet")
    seqs = docs.select(F.col("doc_id").cast("string").alias("chrom"), F.col("text").alias("seq"))
    return seqs.select("chrom", F.lit(0).cast("long").alias("start"), F.length("seq").cast("long").alias("end")), seqs


_WHOLE = 'CAST(doc_id AS VARCHAR) AS chrom, CAST(0 AS BIGINT) AS start, CAST(length(text) AS BIGINT) AS "end"'
_add("frac_gc", lambda s, d: genome.frac_gc(*_sequences(s, d)), f"SELECT {_WHOLE}, CASE WHEN length(text) - {_LETTERS('Nn')} > 0 THEN {_LETTERS('GgCc')} / (length(text) - {_LETTERS('Nn')}) END AS \"GC\" FROM documents")
_add("frac_mapped", lambda s, d: genome.frac_mapped(*_sequences(s, d)), f"SELECT {_WHOLE}, CASE WHEN length(text) > 0 THEN 1 - {_LETTERS('Nn')} / length(text) ELSE 0 END AS frac_mapped FROM documents")
_add("ucsc_names", lambda s, d: orders(s, d).select("okey", ucsc_string(F.col("chrom"), F.col("start"), F.col("end")).alias("name")), "SELECT okey, chrom || ':' || s || '-' || e AS name FROM B")
_add("sanitize", lambda s, d: sanitize_bedframe(orders(s, d).withColumn("end", F.when(F.col("okey") % 5 == 0, F.lit(None)).otherwise(F.col("end") - 30)), start_exceed_end_action="flip"), "SELECT CASE WHEN okey % 5 = 0 THEN NULL ELSE chrom END AS chrom, CASE WHEN okey % 5 = 0 THEN NULL ELSE least(s, e - 30) END AS start, CASE WHEN okey % 5 = 0 THEN NULL ELSE greatest(s, e - 30) END AS \"end\", okey, strand FROM B")


def _flags(s: SparkSession, d: str) -> DataFrame:
    o, v = orders(s, d), view(s, d)
    tagged = ranges.assign_view(o, v)
    row = (checks.is_bedframe(o), checks.is_cataloged(tagged, v), checks.is_overlapping(o), checks.is_viewframe(v), checks.is_contained(v, v), checks.is_covering(v, v), checks.is_tiling(v.withColumn("view_region", F.col("name")), v), checks.is_covering(o, v))
    names = ("bedframe", "cataloged", "overlapping", "viewframe", "contained", "covering", "tiling", "orders_covering")
    return s.createDataFrame([row], ", ".join(f"{n} boolean" for n in names))


_FLAGS = """SELECT (SELECT bool_and(s <= e AND (chrom IS NULL) = (s IS NULL) AND (s IS NULL) = (e IS NULL)) FROM B) AS bedframe,
(SELECT count(*) FROM N WHERE name IS NOT NULL AND name NOT IN (SELECT name FROM V)) = 0 AS cataloged,
(SELECT sum(e - s) FROM B) > (SELECT sum(e - s) FROM M) AS overlapping,
(SELECT count(*) = count(DISTINCT name) AND count(*) = count(chrom) AND bool_and(s <= e) FROM V) AND NOT EXISTS (SELECT 1 FROM V a JOIN V b ON a.chrom = b.chrom AND a.name < b.name AND a.s < b.e AND b.s < a.e) AS viewframe,
NOT EXISTS (SELECT 1 FROM V a WHERE NOT EXISTS (SELECT 1 FROM V b WHERE a.chrom = b.chrom AND a.s < b.e AND b.s < a.e) OR EXISTS (SELECT 1 FROM V b WHERE a.chrom = b.chrom AND a.s < b.e AND b.s < a.e AND (a.s < b.s OR a.e > b.e))) AS contained,
(SELECT sum(least(a.e, b.e) - greatest(a.s, b.s)) FROM V a JOIN V b ON a.chrom = b.chrom AND a.s < b.e AND b.s < a.e) >= (SELECT sum(e - s) FROM V) AS covering,
(SELECT sum(least(a.e, b.e) - greatest(a.s, b.s)) FROM V a JOIN V b ON a.chrom = b.chrom AND a.s < b.e AND b.s < a.e) = (SELECT sum(e - s) FROM V) AS tiling,
(SELECT coalesce(sum(least(M.e, V.e) - greatest(M.s, V.s)), 0) FROM M JOIN V ON M.chrom = V.chrom AND M.s < V.e AND V.s < M.e) = (SELECT sum(e - s) FROM V) AS orders_covering"""
_add("checks", _flags, _FLAGS, _BEST + ", " + _merged("B", "chrom", "s > far"))


def _small(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.concat(F.lit("chr"), F.col("c_nationkey").cast("string")).alias("chrom"))


_add("add_ucsc_name", lambda s, d: construct.add_ucsc_name_column(parts(s, d)).select("pkey", "name"), "SELECT pkey, chrom || ':' || s || '-' || e AS name FROM P0")
_add("region_columns", lambda s, d: orders(s, d).select("okey", *(x.alias(n) for x, n in zip(region_columns(ucsc_string(F.col("chrom"), F.col("start"), F.col("end"))), ("chrom", "start", "end")))), 'SELECT okey, chrom, s AS start, e AS "end" FROM B')
_add("natsorted", lambda s, d: _small(s, d).select("c_custkey", "chrom", genome.natural_key(F.col("chrom")).alias("k")).withColumn("place", F.dense_rank().over(Window.orderBy("k"))).select("c_custkey", F.col("place").cast("long").alias("place")), "SELECT c_custkey, dense_rank() OVER (ORDER BY c_nationkey) AS place FROM customer")
_add("from_dict", lambda s, d: construct.from_dict(s, {r["n_name"]: r["n_nationkey"] for r in s.read.parquet(f"{d}/nation.parquet").select("n_name", "n_nationkey").collect()}), 'SELECT n_name AS chrom, CAST(0 AS BIGINT) AS start, CAST(n_nationkey AS BIGINT) AS "end" FROM nation')
_add("from_list", lambda s, d: construct.from_list(s, [(r["n_name"], r["n_nationkey"], 100 + r["n_nationkey"]) for r in s.read.parquet(f"{d}/nation.parquet").collect()]), 'SELECT n_name AS chrom, CAST(n_nationkey AS BIGINT) AS start, CAST(100 + n_nationkey AS BIGINT) AS "end" FROM nation')
_add("from_region_strings", lambda s, d: construct.from_any(s, [f"{r['n_name']}:{r['n_nationkey']}k-30,000" for r in s.read.parquet(f"{d}/nation.parquet").collect()]), 'SELECT n_name AS chrom, CAST(1000 * n_nationkey AS BIGINT) AS start, CAST(30000 AS BIGINT) AS "end" FROM nation')
_add("make_viewframe", lambda s, d: construct.make_viewframe(s, {r["n_name"]: 10 + r["n_nationkey"] for r in s.read.parquet(f"{d}/nation.parquet").collect()}, name_style="ucsc"), 'SELECT n_name AS chrom, CAST(0 AS BIGINT) AS start, CAST(10 + n_nationkey AS BIGINT) AS "end", n_name || \':0-\' || (10 + n_nationkey) AS name FROM nation')
_add("select_indices", lambda s, d: ranges.select_indices(orders(s, d), "chr7:1k-40k").agg(F.count_distinct("index").alias("n")), "SELECT count(*) AS n FROM B WHERE chrom = 'chr7' AND ((s < 40000 AND e > 1000) OR (s = e AND s = 1000))")
_add("frac_gene_coverage", lambda s, d: genome.frac_gene_coverage(orders(s, d).select("chrom", "start", "end", "okey"), parts(s, d).select(F.col("chrom").alias("tName"), F.col("start").alias("tStart"), F.col("end").alias("tEnd"))).select("okey", "coverage", "count"), f"SELECT B.okey, CAST(sum(CASE WHEN X.s IS NULL THEN 0 ELSE greatest(0, least(X.e, B.e) - greatest(X.s, B.s)) END) AS BIGINT) AS coverage, count(X.s) AS count FROM B LEFT JOIN P0 X ON {_HIT.format(a='X', b='B')} GROUP BY B.okey")
_add("to_bed_dataframe", lambda s, d: to_bed_dataframe(parts(s, d).withColumnRenamed("brand", "name").drop("pkey"), "bed6", validate_fields=True), "SELECT chrom, s AS start, e AS \"end\", brand AS name, 0 AS score, '.' AS strand FROM P0")
_add("stack_levels", lambda s, d: islands.stack_levels(parts(s, d)).groupBy("chrom").agg(F.max("level").alias("top")), "SELECT chrom, CAST(max(n) - 1 AS BIGINT) AS top FROM (SELECT X.chrom, X.pkey, count(*) AS n FROM P0 X JOIN P0 Y ON X.chrom = Y.chrom AND Y.s <= X.s AND greatest(Y.e, Y.s + 1) > X.s GROUP BY X.chrom, X.pkey) GROUP BY chrom")
_DIGEST = """D AS (SELECT CAST(doc_id AS VARCHAR) AS chrom, upper(text) AS t FROM documents WHERE text IS NOT NULL),
C AS (SELECT chrom, length(t) AS n, unnest(list_filter(range(1, length(t) - 2), lambda i: substr(t, i, 4) = 'TTAA')) AS i FROM D),
G AS (SELECT chrom, 0 AS x FROM D UNION SELECT chrom, length(t) FROM D UNION SELECT chrom, i + 2 FROM C WHERE i + 2 < n)"""
_add("digest", lambda s, d: genome.digest(_sequences(s, d)[1].where("seq is not null"), "MseI"), 'SELECT chrom, CAST(lag(x) OVER w AS BIGINT) AS start, CAST(x AS BIGINT) AS "end" FROM G WINDOW w AS (PARTITION BY chrom ORDER BY x) QUALIFY lag(x) OVER w IS NOT NULL', _DIGEST)
_add("is_sorted", lambda s, d: s.createDataFrame([(checks.is_sorted(parts(s, d), order_col="pkey"), checks.is_sorted(events(s, d).withColumn("_o", F.struct("chrom", "start", "end", "event_id")), order_col="_o"))], "parts boolean, events boolean"), "SELECT NOT EXISTS (SELECT 1 FROM (SELECT (chrom, s, e) < lag((chrom, s, e)) OVER (ORDER BY pkey) AS b FROM P0) WHERE b) AS parts, true AS events")
