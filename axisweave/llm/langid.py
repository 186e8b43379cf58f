"""Language ID by Bayesian fusion of text, declared language, address suffix and host priors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisweave.llm.text import stored
from axisweave.llm.vector import _LOWER, slices, text_bytes

#: Buckets of hashed byte trigrams; weight of a trigram's evidence (neighbours overlap); pseudo-counts of a host's parent and of declared values.
BUCKETS, TEMPER, HOST_PRIOR, EVIDENCE_PRIOR = 8192, 0.3, 20.0, 1.0
#: A candidate language is declared by this many rows at least.
MIN_ROWS = 5
#: Part of any language's trigrams that may be anything (names, numbers, code), and prior of a text in none of the languages, whose trigrams are all alike.
ANY, OTHER_PRIOR = 0.2, 0.01
#: A document is rejected if no language reaches this posterior.
MIN_POSTERIOR = 0.5


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every byte trigram inside a text, and the n + 1 trigram offsets of the texts."""
    d = _LOWER[data].astype(np.uint32)
    if len(d) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    code = (d[:-2] << np.uint32(16)) | (d[1:-1] << np.uint32(8)) | d[2:]
    inside = np.ones(len(code), bool)
    for back in (1, 2):
        cut = offsets[1:-1] - back
        inside[cut[(cut >= 0) & (cut < len(code))]] = False
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(inside)])
    return bucket[inside], total[np.minimum(offsets, len(code))]


def trigram_counts(df: DataFrame) -> DataFrame:
    """lang, bucket, n over all rows (columns lang, text): summed in each task, then by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            data, offsets = text_bytes(batch.column(1))
            for a, b in slices(offsets):
                grams, at = _trigrams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                row_lang = langs[a:b]
                for lang in {x for x in row_lang if x is not None}:
                    mask = np.repeat(row_lang == lang, np.diff(at))
                    sums[lang] = sums.get(lang, 0) + np.bincount(grams[mask], minlength=BUCKETS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at].astype(np.int64))], ["lang", "bucket", "n"])

    return df.select("lang", "text").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def text_model(counts: DataFrame, langs: list[str]) -> np.ndarray:
    """log P(bucket | language), a row a language, never below that of a uniform bucket times ANY; what comes to the driver is at most languages times BUCKETS sums."""
    table = np.full((len(langs), BUCKETS), 0.5)
    at = {x: k for k, x in enumerate(langs)}
    pdf = counts.where(F.col("lang").isin(langs)).toPandas() if langs else None
    if pdf is not None and len(pdf):
        np.add.at(table, (pdf["lang"].map(at).to_numpy(), pdf["bucket"].to_numpy()), pdf["n"].to_numpy())
    return np.log((1 - ANY) * table / table.sum(axis=1, keepdims=True) + ANY / BUCKETS).astype(np.float32)


def text_scores(df: DataFrame, model: np.ndarray) -> DataFrame:
    """id and carried columns of df, with n (trigrams) and ll (log likelihood of the text by language). Null texts and those under three bytes have no trigrams and zeros; without languages ll is empty."""
    keep = [f for f in df.schema.fields if f.name != "text"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ll = np.zeros(len(batch), np.int64), np.zeros((len(batch), len(model)))
            data, offsets = text_bytes(batch.column(batch.schema.get_field_index("text")))
            for a, b in slices(offsets):
                grams, at = _trigrams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n[a:b] = np.diff(at)
                for k, row in enumerate(model):
                    total = np.concatenate([[0.0], np.cumsum(row[grams], dtype=np.float64)])
                    ll[a:b, k] = total[at[1:]] - total[at[:-1]]
            cols = [batch.column(batch.schema.get_field_index(f.name)) for f in keep]
            lists = pa.FixedSizeListArray.from_arrays(pa.array(ll.reshape(-1)), max(1, len(model))).cast(pa.list_(pa.float64())) if len(model) else pa.array([[]] * len(batch), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n), lists], [*[f.name for f in keep], "n", "ll"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return df.mapInArrow(score, f"{schema}, n long, ll array<double>")


def _arg_max(values: str) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def host_priors(df: DataFrame, size: int) -> DataFrame:
    """host and prior (P(language) by language number), from columns host and best.

    A host's counts are smoothed towards its parent domain's, those towards the next parent's, up to all rows. Counts
    are grouped sums; a host's chain has a level for each of its labels. A null host is the empty one; rows without a best language
    add nothing, and without any all languages are alike. An empty table gives no rows.
    """
    parts = F.split(F.coalesce("host", F.lit("")), r"\.", -1)
    depth = F.size(parts)
    chain = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), depth), lambda k: F.array_join(F.slice(parts, -k, k), ".")))
    hosts = df.groupBy("host", "best").agg(F.count("*").alias("c")).where("best is not null")
    node = hosts.select("best", "c", F.explode(F.array_distinct(chain)).alias("node")).groupBy("node", "best").agg(F.sum("c").alias("c"))
    node = node.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("best", "c"))).alias("by"), F.sum("c").alias("all"))
    step = df.select("host").distinct().select("host", F.posexplode(F.array_distinct(chain)).alias("level", "node"))
    step = step.join(node, "node", "left").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("level", F.coalesce("all", F.lit(0)).alias("all"), F.map_entries("by").alias("by")))).alias("steps"))
    start = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.lit(1.0 / size))
    got = lambda s, k: F.coalesce(F.element_at(F.map_from_entries(s["by"]), k), F.lit(0))
    fold = F.aggregate("steps", start, lambda acc, s: F.transform(acc, lambda p, k: (got(s, k) + HOST_PRIOR * p) / (s["all"] + HOST_PRIOR)))
    return step.select(F.col("host").alias("_host"), fold.alias("prior"))


def _evidence(df: DataFrame, name: str, size: int) -> DataFrame:
    """Value of column `name`, an array of log P(value | language), smoothed by the value's share of all rows, and log of that share."""
    c = df.where(F.col(name).isNotNull() & F.col("best").isNotNull()).groupBy(name, "best").agg(F.count("*").alias("c"))
    by = c.groupBy(name).agg(F.map_from_entries(F.collect_list(F.struct("best", "c"))).alias("by"), F.sum("c").alias("n"))
    langs = c.groupBy("best").agg(F.sum("c").alias("c"))
    totals = langs.agg(F.map_from_entries(F.collect_list(F.struct("best", "c"))).alias("totals"), F.sum("c").alias("all"))
    by = by.join(F.broadcast(totals))  # one row
    of = lambda m, k: F.coalesce(F.element_at(m, k), F.lit(0))
    p = lambda k: (of(F.col("by"), k) + EVIDENCE_PRIOR * F.col("n") / F.col("all")) / (of(F.col("totals"), k) + EVIDENCE_PRIOR)
    return by.select(F.col(name).alias(f"_{name}"), F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.log(p(k))).alias(f"{name}_ev"), F.log(F.col("n") / F.col("all")).alias(f"{name}_any"))


def identify(df: DataFrame, extra: DataFrame | None = None, *, min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """id, declared, text_language, language, posterior and kept for every row.

    df: id, text, declared (language code) and host; extra: id, declared, host and suffix known from elsewhere (a page of
    the document), one row an id, which take precedence. Languages are those that five rows declare; the text
    model is counted over all rows that declare one. A text whose trigrams are likelier to be drawn evenly than from any
    language has no text_language and counts in no prior. Posterior, over the languages and one that is none of them: host prior times text likelihood (tempered) times
    P(declared | language) times P(suffix | language), each left out where it is missing. A text of fewer than three bytes
    has no text evidence and is rejected, as is one whose best posterior is too small. Ties go to the first language in
    alphabetical order. Null keys keep their row; without any declared language all rows are rejected.
    """
    kind = df.schema["id"].dataType
    df = df.select("id", F.lower(F.substring_index(F.col("declared"), "-", 1)).alias("declared"), F.col("host").cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    found = df.groupBy("declared").count().where(F.col("declared").isNotNull() & (F.trim("declared") != ""))
    langs = sorted(r[0] for r in found.where(F.col("count") >= MIN_ROWS).collect())
    scored = text_scores(df, text_model(trigram_counts(df.withColumnRenamed("declared", "lang")), langs))
    if extra is not None:
        more = extra.select(F.col("id").cast(kind).alias("_id"), F.col("declared").alias("d2"), F.col("host").alias("h2"), "suffix")
        scored = scored.join(more, F.col("id") == F.col("_id"), "left").withColumn("declared", F.coalesce("d2", "declared")).withColumn("host", F.coalesce("h2", "host")).drop("_id", "d2", "h2")
    else:
        scored = scored.withColumn("suffix", F.lit(None).cast("string"))
    scored = stored(scored, "language-scores")
    if not langs:
        none = F.lit(None).cast("string")
        return scored.select("id", "declared", none.alias("text_language"), none.alias("language"), F.lit(None).cast("double").alias("posterior"), F.lit(False).alias("kept"))
    size = len(langs)
    even = F.col("n") * F.lit(-float(np.log(BUCKETS)))
    best = F.when((F.col("n") > 0) & (F.array_max("ll") >= even), _arg_max("ll"))
    scored = scored.withColumn("best", best)
    out = scored
    p = host_priors(scored, size)
    out = out.join(p, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")
    for name in ("declared", "suffix"):
        e = _evidence(scored, name, size)
        out = out.join(e, F.col(name) == F.col(f"_{name}"), "left").drop(f"_{name}")
    at = lambda c, k: F.coalesce(F.get(c, k), F.lit(0.0))
    log = F.transform("ll", lambda x, k: F.lit(TEMPER) * x + F.log((1 - OTHER_PRIOR) * F.get("prior", k)) + at("declared_ev", k) + at("suffix_ev", k))
    other = TEMPER * even + float(np.log(OTHER_PRIOR)) + F.coalesce("declared_any", F.lit(0.0)) + F.coalesce("suffix_any", F.lit(0.0))
    out = out.withColumn("log", log).withColumn("top", F.array_max("log"))
    out = out.withColumn("mass", F.aggregate("log", F.exp(other - F.col("top")), lambda a, x: a + F.exp(x - F.col("top"))))
    names = F.array(*[F.lit(x) for x in langs])
    posterior = 1 / F.col("mass")
    return out.select("id", "declared", F.get(names, F.col("best")).alias("text_language"), F.get(names, _arg_max("log")).alias("language"), posterior.alias("posterior"), ((F.col("n") > 0) & (posterior >= min_posterior)).alias("kept"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """id (of the document that the address names), declared, host and suffix; of several pages of a document the first address counts."""
    host = F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1)
    rows = pages.select(
        F.regexp_extract("url", r"/[a-z]{2}/(\d+)", 1).try_cast("long").alias("id"), "url", F.lower(F.regexp_extract("html", r"<html[^>]*\slang=[\"']?([A-Za-z]+)", 1)).alias("declared"), F.lower(host).alias("host"),
    )
    one = rows.where("id is not null").groupBy("id").agg(F.min(F.struct("url", "declared", "host")).alias("r")).select("id", "r.declared", "r.host")
    text = lambda c: F.when(F.col(c) != "", F.col(c))
    return one.select("id", text("declared").alias("declared"), text("host").alias("host"), F.when(F.col("host") != "", F.substring_index("host", ".", -1)).alias("suffix"))


def documents_language(docs: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """identify() for documents: declared language `lang`, host `source`, or those of the document's page."""
    df = docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"))
    return identify(df, None if pages is None else page_evidence(pages)).withColumnRenamed("id", "doc_id")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: all documents, with the evidence of their pages."""
    return documents_language(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "pages")))
