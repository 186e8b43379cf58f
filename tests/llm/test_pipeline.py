"""The pipeline's stages against the operators' brute-force counterparts."""

import random
from collections import Counter

import corpus_pipeline as cp

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = docs.columns
    for name, stage in cp.STAGES:
        out = stage(spark, docs, DATA).cache()
        if name != "sharding":
            assert out.columns == names
        if name == "language":
            assert out.count() >= 0.97 * docs.count()
        if name in ("near_duplicates", "decontamination"):
            assert 0.5 * docs.count() < out.count() <= docs.count() and out.select("doc_id").distinct().count() == out.count()
        if name == "sharding":
            n = Counter(r["shard"] for r in out.collect())
            assert out.count() == docs.count() and max(n.values()) - min(n.values()) <= 1
        docs = out


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "some words"), (5, "one two three"), (5, "one two three"), (6, "x")]
    docs = spark.createDataFrame([(i, t, "en", None, None, 1, 2) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _id int, _times int")
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns
        assert stage(spark, docs.limit(0), DATA).isEmpty()
    assert cp.sharded(spark, docs, DATA).count() == len(rows)


def test_sharded_texts_of_one_common_sentence(spark):
    """Pairs of long texts that have one of forty sentences in common go to one shard, wherever its hash ranks among theirs."""
    r = random.Random(12)
    sentence = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(6)) + ". "
    rows = [(k, [sentence() for _ in range(40)]) for k in range(400)]
    for k in range(0, 120, 2):
        rows[k + 1][1][r.randrange(40)] = rows[k][1][r.randrange(40)]
    docs = spark.createDataFrame([(k, "".join(t)) for k, t in rows], "doc_id long, text string")
    at = {x["doc_id"]: x["shard"] for x in cp.sharded(spark, docs, DATA).collect()}
    assert len(at) == 400 and set(Counter(at.values()).values()) == {10}
    assert sum(at[k] == at[k + 1] for k in range(0, 120, 2)) >= 55


def test_sharded_texts_of_short_sentences(spark):
    """Pairs of texts that have but a passage of sentences of 10 characters in common, on lines of other ends, go to one shard."""
    r = random.Random(14)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    rows = [(k, [word(60) for _ in range(5)]) for k in range(400)]
    for k in range(0, 120, 2):
        common = [word(10) for _ in range(4)]
        rows[k][1].extend(common)
        rows[k + 1][1].extend(f"  {x}\r" for x in common)
    docs = spark.createDataFrame([(k, "\n".join(t)) for k, t in rows], "doc_id long, text string")
    at = {x["doc_id"]: x["shard"] for x in cp.sharded(spark, docs, DATA).collect()}
    assert len(at) == 400 and set(Counter(at.values()).values()) == {10}
    assert sum(at[k] == at[k + 1] for k in range(0, 120, 2)) >= 55
