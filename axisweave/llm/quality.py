"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisweave.llm.text import SPACE, words

#: Hash buckets of the two multinomials.
BUCKETS = 8192
#: Documents whose mean log ratio lies below this are dropped.
THRESHOLD = -0.11
#: Labelled target rows that the target multinomial is fitted on, at most (those of least hash).
TARGET_ROWS = 50_000
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def _grams(w: Column, n_words: Column, buckets: int) -> Column:
    """Buckets of all words and of all word pairs."""
    single = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))
    at = F.when(n_words > 1, F.sequence(F.lit(0), n_words - 2)).otherwise(F.array().cast("array<int>"))
    pairs = F.transform(at, lambda i: F.pmod(F.xxhash64(F.get(w, i), F.get(w, i + 1)), F.lit(buckets)).cast("int"))
    return F.concat(single, pairs)


def _repeated_words(df: DataFrame) -> DataFrame:
    """Add n_repeat_words: words inside 5-word windows that occur twice or more in their text.

    Windows are compared by 64-bit hash. Everything happens inside the row: hashes are sorted with
    their positions, and only neighbours of equal hash are looked at.
    """
    n = F.col("_n")
    at = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_x", F.transform("_w", lambda x: F.xxhash64(x)))
    df = df.withColumn("_h", F.transform(at, lambda i: F.xxhash64(*[F.get("_x", i + k) for k in range(WINDOW)])))
    df = df.withColumn("_dup", F.size(F.array_distinct("_h")) < F.size("_h"))
    df = df.withColumn("_s", F.when(F.col("_dup"), F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda s, j: (s["h"] == F.get("_s", j - 1)["h"]) | (s["h"] == F.get("_s", j + 1)["h"])
    df = df.withColumn("_p", F.sort_array(F.transform(F.filter("_s", same), lambda s: s["i"])))
    each = F.transform("_p", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", j + 1) - p, F.lit(WINDOW))))
    total = F.aggregate(each, F.lit(0), lambda a, x: a + x).cast("long")
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("_x", "_h", "_dup", "_s", "_p")


def base_rules(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Counts of each text and the plain rules' verdict.

    Returns key, _w (words), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.
    Null and empty texts have no words and fail; other columns of docs are not looked at, repeated rows
    and null keys each keep a row of their own.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(F.col(key).alias(key), t.alias("_t")).withColumn("_w", words(F.col("_t"))).withColumn("_n", F.size("_w"))
    df = df.withColumn("_lines", F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = _repeated_words(df)
    bare = lambda chars: F.length(F.translate("_t", chars, ""))
    n, r = F.col("_n").cast("long"), F.col("n_repeat_words")
    return df.select(
        key, "_w", n.alias("n_words"), bare(" \t\n\x0b\x0c\r").cast("long").alias("word_chars"),
        (F.length("_t") - bare(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        r, ((n < 10) | (100 * r > 20 * n)).alias("base_failed"),
    )


def log_ratios(docs: DataFrame, target_ids: DataFrame, *, text: str = "text", key: str = "doc_id", buckets: int = BUCKETS, target_rows: int = TARGET_ROWS) -> DataFrame:
    """One row with the array `ratios`: log of target share over raw share, by hash bucket.

    Raw counts cover every document. The target multinomial is fitted on the documents of target_ids,
    at most target_rows of them (least hash first), so the broadcast list of ids is bounded. Counts are
    summed per task before the shuffle: at most `buckets` rows leave a task. Both shares get half a count
    for each bucket; without target or corpus every ratio is 0.
    """
    ids = target_ids.select(F.col(key).alias("_id")).where(F.col("_id").isNotNull()).distinct()
    ids = ids.orderBy(F.xxhash64("_id"), "_id").limit(target_rows)
    df = docs.select(F.col(key).alias("_id"), words(F.col(text)).alias("_w"))
    df = df.join(F.broadcast(ids.withColumn("_target", F.lit(1))), "_id", "left")
    grams = df.select(F.col("_target"), F.explode(_grams(F.col("_w"), F.size("_w"), buckets)).alias("b"))
    counts = grams.groupBy("b").agg(F.count("*").alias("raw"), F.count("_target").alias("target"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left")
    cell = F.struct("b", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    row = every.agg(F.sort_array(F.collect_list(cell)).alias("c"), F.sum("raw").alias("raws"), F.sum("target").alias("targets"))
    half = F.lit(buckets / 2.0)
    share = lambda x, total: (x + F.lit(0.5)) / (F.coalesce(F.col(total), F.lit(0)) + half)
    ratio = lambda s: F.log(share(s["target"], "targets") / share(s["raw"], "raws"))
    known = F.coalesce(F.col("targets"), F.lit(0)) > 0
    return row.select(F.transform("c", lambda s: F.when(known, ratio(s)).otherwise(F.lit(0.0))).alias("ratios"))


def ratio_scores(df: DataFrame, ratios: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Add llr: the mean log ratio of the n-grams of `_w`; 0 where there are none. The table of ratios is one row of bounded size, read as a scalar subquery."""
    grams = _grams(F.col("_w"), F.size("_w"), buckets)
    df = df.withColumn("_g", grams).withColumn("_r", ratios.select("ratios").scalar())
    total = F.aggregate("_g", F.lit(0.0), lambda a, b: a + F.get("_r", b))
    return df.withColumn("llr", F.when(F.size("_g") > 0, total / F.size("_g")).otherwise(F.lit(0.0))).drop("_g", "_r")


def quality_rules(docs: DataFrame, target_ids: DataFrame, *, text: str = "text", key: str = "doc_id", buckets: int = BUCKETS, threshold: float = THRESHOLD, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Every document's counts, base_failed, llr and kept (not base_failed and llr >= threshold).

    An empty table gives no rows; null texts count as empty and fail; ties at the threshold are kept.
    """
    ratios = log_ratios(docs, target_ids, text=text, key=key, buckets=buckets, target_rows=target_rows)
    df = ratio_scores(base_rules(docs, text, key), ratios, buckets)
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold)).drop("_w")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: all documents against the documents labelled as good."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    df = quality_rules(docs, labels.where("quality = 1"))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
