"""Benchmark decontamination with a positional inverted index kept as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axisweave.llm.text import LOWER, UPPER, bounded_broadcast, dropped, lower_ascii, stored

#: What separates words: ASCII but digits and lower-case letters (A-Z are lower-cased before).
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 8
#: A term that no text holds; its posting in the query's index tells how many words a text has.
END = "\x00"
#: Rows of a benchmark-side table that may be broadcast; a larger one is shuffled.
BROADCAST_ROWS = 200_000


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BREAK, -1), "")


def test_terms(benchmark: DataFrame, text: str = "text", key: str = "item_id") -> DataFrame:
    """item, ipos, term and len (words of the item) of every benchmark word; items of no words have no rows."""
    w = benchmark.where(F.col(key).isNotNull()).select(F.col(key).alias("item"), tokens(F.col(text)).alias("w")).distinct()
    return w.select("item", F.size("w").alias("len"), F.posexplode("w").alias("ipos", "term"))


def postings(docs: DataFrame, terms: DataFrame | None = None, *, text: str = "text", key: str = "doc_id", ends: bool = False) -> DataFrame:
    """The index: term, doc, pos of every occurrence of a term in the training texts, `key` naming the text.

    Each task writes its part of the index sorted by term, so no posting is shuffled. With `terms`, words that no test
    item holds get no list, as they can't be part of a match; without, the index serves any later benchmark. The list of terms
    is broadcast within a counted bound, joined by shuffle beyond it. Null texts and keys and texts without words have no
    postings; rows of one key count as one text, so the key must name the text. With ends each text has a posting of END more, at
    the place after its last word.
    """
    words = F.concat(tokens(F.col(text)), F.array(F.lit(END))) if ends else tokens(F.col(text))
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.posexplode(words).alias("pos", "term"))
    if terms is not None:
        terms = terms.select("term").distinct()
        terms = terms.unionByName(docs.sparkSession.range(1).select(F.lit(END).alias("term"))) if ends else terms
        rows = rows.join(bounded_broadcast(terms, terms.count(), BROADCAST_ROWS), "term")
    return stored(rows.select(F.xxhash64("term").alias("term"), "doc", "pos"), "postings", ["term"])


def _windows(terms: DataFrame, index: DataFrame, size: int) -> DataFrame:
    """item, first, n (words) of every window with its terms from the rarest to the commonest: arrays of (df, ipos, term)."""
    t = terms.withColumn("term", F.xxhash64("term"))
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    t = t.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    n = F.least(F.lit(size), F.col("len"))
    t = t.withColumn("n", n).withColumn("first", F.explode(F.sequence(F.greatest(F.lit(0), F.col("ipos") - n + 1), F.least(F.col("ipos"), F.col("len") - n))))
    return t.groupBy("item", "first", "n").agg(F.sort_array(F.collect_list(F.struct("df", "ipos", "term"))).alias("terms"))


def phrase_matches(index: DataFrame, terms: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc, item, start (position in the text) and n (words) of each exact occurrence of a benchmark window.

    A window's lists are intersected from its rarest term: the rarest term's postings give alignments
    (position less offset), the second rarest's adjusted list keeps those it shares, and the remaining
    terms' lists are then looked up at the places that the surviving alignments name. Postings are keyed by
    (document, position), so no list is gathered in one task and a frequent term's list is only read.
    """
    rare = lambda k: F.get(F.col("terms"), F.lit(k))
    win = _windows(terms, index, size).where(F.col("terms")[0]["df"] > 0)
    win = stored(win.withColumn("i1", rare(0)["ipos"]).withColumn("i2", F.coalesce(rare(1)["ipos"], F.lit(-1))), "windows")
    probe = win.select(rare(0)["term"].alias("term"), "item", "i1", rare(1)["term"].alias("t2"), "i2").distinct()
    probe = stored(probe, "probes")
    of = ["item", "i1", "i2"]
    found = index.join(bounded_broadcast(probe, probe.count(), BROADCAST_ROWS), "term").select("doc", *of, (F.col("pos") - F.col("i1")).alias("at"), "t2")
    found = stored(found.withColumn("p2", F.col("at") + F.col("i2")), "alignments")
    second = index.select(F.col("term").alias("t2"), "doc", F.col("pos").alias("p2"))
    two = found.where("t2 is not null").join(second, ["t2", "doc", "p2"], "left_semi")
    lines = stored(two.unionByName(found.where("t2 is null")).select("doc", *of, "at").distinct(), "lines")
    # only the windows that an alignment's two terms are the rarest of
    w = win.select(*of, "first", "n", F.explode("terms").alias("t")).select(*of, "first", "n", "t.term", "t.ipos")
    w = bounded_broadcast(w, w.count(), BROADCAST_ROWS)
    need = lines.join(w, of).select("doc", "item", "at", "first", "n", "term", (F.col("at") + F.col("ipos")).alias("pos"))
    found_in = lines.select("doc").distinct()
    hold = index.join(bounded_broadcast(found_in, found_in.count(), BROADCAST_ROWS), "doc", "left_semi")
    met = need.join(hold, ["doc", "pos", "term"], "left_semi").groupBy("doc", "item", "at", "first", "n").count()
    met = stored(met.where("count = n").select("doc", "item", (F.col("at") + F.col("first")).alias("start"), "n"), "matches")
    dropped(win, probe, found, lines)
    return met


def proximity_matches(index: DataFrame, terms: DataFrame, slop: int) -> DataFrame:
    """doc, item and pos (of the rarest term) where all distinct terms of an item stand within `slop` words of its rarest term, in any order.

    Positions are joined by bins of slop + 1 words, so that only neighbouring postings meet. Items without words, null texts
    and empty tables give no rows; a text that repeats the rarest term may match at each place.
    """
    wide = slop + 1
    t = terms.select("item", F.xxhash64("term").alias("term")).distinct()
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    t = t.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    own = Window.partitionBy("item").orderBy("df", "term")
    t = t.withColumn("k", F.row_number().over(own)).withColumn("all", F.count("*").over(Window.partitionBy("item")))
    at = index.join(t.where("k = 1"), "term").select("doc", "item", "all", F.col("pos").alias("p"))
    others = t.where("k > 1").select("item", "term")
    near = at.join(others, "item").withColumn("bin", F.explode(F.array(*[F.floor(F.col("p") / wide) + d for d in (-1, 0, 1)])))
    other = index.select("term", "doc", "pos", F.floor(F.col("pos") / wide).alias("bin"))
    met = near.join(other, ["doc", "term", "bin"]).where(F.abs(F.col("pos") - F.col("p")) <= slop)
    met = met.groupBy("doc", "item", "all", "p").agg(F.count_distinct("term").alias("c")).where(F.col("c") == F.col("all") - 1)
    alone = at.where("all = 1").select("doc", "item", "p")
    return met.select("doc", "item", "p").unionByName(alone).withColumnRenamed("p", "pos")


def contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", key: str = "doc_id", item: str = "item_id", size: int = WINDOW) -> DataFrame:
    """Every document's n_words, n_hit, n_items, items_sha256 and contaminated.

    Windows are `size` consecutive words of an item, or a shorter item whole. Null and empty texts have no
    words. Rows are told apart by key and text, so rows that repeat a key each have their own matches and a null key has them too;
    items likewise, those of a null id being left out as they can't be named. An empty benchmark leaves every document clean, with
    the digest of the empty string; an empty table gives no rows.
    """
    named = benchmark.where(F.col(item).isNotNull()).select(F.xxhash64(F.col(item), F.col("text")).alias("_item"), F.col(item).cast("string").alias("name"), "text")
    terms = stored(test_terms(named, "text", "_item"), "terms")
    row = F.xxhash64(F.lit("row"), F.col(key), F.col(text))
    index = postings(docs.select(row.alias("_row"), F.col(text).alias("_text")), terms, text="_text", key="_row", ends=True)
    hits = phrase_matches(index, terms, size)
    words = hits.select("doc", F.explode(F.expr("sequence(start, start + n - 1)")).alias("pos")).distinct()
    words = words.groupBy("doc").agg(F.count("*").alias("n_hit"))
    items = hits.join(named.select(F.col("_item").alias("item"), "name").distinct(), "item").select("doc", F.col("name").alias("item")).distinct()
    items = items.groupBy("doc").agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list("item")).alias("names"))
    long = index.where(F.col("term") == F.xxhash64(F.lit(END))).select(F.col("doc").alias("_doc"), F.col("pos").cast("long").alias("n_words")).distinct()
    per = stored(long.join(words.join(items, "doc"), F.col("_doc") == F.col("doc"), "left").drop("doc"), "contamination")
    dropped(terms, index, hits)
    out = docs.select(F.col(key).alias(key), row.alias("_row")).join(per, F.col("_row") == F.col("_doc"), "left")
    zero = F.lit(0).cast("long")
    return out.select(
        key, "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.sha2(F.coalesce(F.array_join("names", ","), F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_items", zero) >= 2).alias("contaminated"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op4: all documents against all benchmark items."""
    return contamination(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))


#: The query by brute force: every window of every text against every window of every item.
SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BREAK}'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BREAK}'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
bn AS (SELECT item_id, w, least({WINDOW}, len(w)) AS n FROM b WHERE len(w) > 0),
bp AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS f FROM bn),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[f:f + n - 1], ' ') AS g FROM bp),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS f FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
hit AS (SELECT doc_id, f, n, item_id FROM (SELECT doc_id, n, f, array_to_string(w[f:f + n - 1], ' ') AS g FROM dp) JOIN win USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(f, f + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
