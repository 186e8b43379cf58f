"""MinHash near-duplicates with tensored banding: table keys are pairs of band hashes from two small collections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axisweave.llm.graph import components
from axisweave.llm.text import LOWER, UPPER, WORD, dropped, stored
from axisweave.llm.vector import mix, shingles, words_of

#: Bands of each of the two collections, and MinHashes of a band: 2 * 14 * 4 MinHashes serve 14 * 14
#: tables of eight MinHashes each. A pair of similarity 0.8 meets in a table with probability
#: (1 - (1 - 0.8**4)**14)**2 = 0.9988, one of 0.85 with 0.99996.
BANDS, ROWS = 14, 4
#: Rounds in which each document is compared with the first of each of its tables, before the exact search for what is left.
ROUNDS = 3
#: Rounds of the exact search, where some pairs are forbidden, in which sets with common differences are brought together before their pairs are formed.
FAMILIES = 2


def _signer(size: int, bands: int, rows: int):
    rng = np.random.default_rng(20_240_229)
    mul = rng.integers(1, 1 << 31, 2 * bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 1 << 32, 2 * bands * rows, dtype=np.uint32)

    def minima(s: np.ndarray, at: np.ndarray) -> np.ndarray:
        """MinHashes of the 32-bit shingles s, a row for each stretch that begins at `at`."""
        out = np.empty((len(at), len(mul)), np.uint32)
        for k, (m, a) in enumerate(zip(mul, add)):
            x = s * m + a
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            x ^= x >> np.uint32(13)
            out[:, k] = np.minimum.reduceat(x, at)
        return out

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b = (np.zeros(len(batch), np.int64) for _ in range(3))
            sides = np.zeros((len(batch), 2 * bands), np.int64)
            for at, _, w in words_of(batch.column(1), lower=True):
                sets = [shingles(w.hash[x:y], size) for x, y in zip(w.bounds[:-1], w.bounds[1:])]
                rowed = np.array([k for k, s in enumerate(sets) if len(s)], np.int64)
                if not len(rowed):
                    continue
                every = np.concatenate([sets[k] for k in rowed])
                lens = np.array([len(sets[k]) for k in rowed])
                begin = np.cumsum(lens) - lens
                n[at + rowed] = lens
                a[at + rowed] = np.add.reduceat(mix(every), begin).view(np.int64)
                b[at + rowed] = np.add.reduceat(mix(every ^ np.uint64(0xA5A5F00DC0FFEE11)), begin).view(np.int64)
                low = minima((every >> np.uint64(32)).astype(np.uint32), begin).reshape(len(rowed), 2 * bands, rows)
                h = np.zeros((len(rowed), 2 * bands), np.uint64)
                for r in range(rows):
                    h = mix(h * np.uint64(0x2545F4914F6CDD1D) + low[:, :, r])
                sides[at + rowed] = h.view(np.int64)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).reshape(-1)), bands).cast(pa.list_(pa.int64())) for x in (sides[:, :bands], sides[:, bands:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(a), pa.array(b), *lists], ["id", "n", "sa", "sb", "left", "right"])

    return sign


def signatures(docs: DataFrame, text: str, key: str, size: int, bands: int, rows: int) -> DataFrame:
    """id, n (distinct shingles), sa and sb (128 bits that name the set), left and right (band hashes of the two collections)."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"id {kind}, n long, sa long, sb long, left array<long>, right array<long>"
    return docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(_signer(size, bands, rows), schema)


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """id and s (hashes of the distinct shingles) of docs with columns id and text."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in words_of(batch.column(1), lower=True):
                made = [shingles(w.hash[x:y], size) for x, y in zip(w.bounds[:-1], w.bounds[1:])]
                at = np.cumsum([0, *map(len, made)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(made).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["id", "s"])

    return docs.select("id", "text").mapInArrow(sets, f"id {docs.schema['id'].dataType.simpleString()}, s array<long>")


def _tables(reps: DataFrame) -> DataFrame:
    """key, id of every table in which a set meets another.

    A table is a band of one collection paired with a band of the other. A set can share table (i, j)
    only if it shares band i of the left collection and band j of the right one with some set, so bands
    that no other set has are left out before the pairs are formed.
    """
    sides = []
    for side in ("left", "right"):
        s = reps.select("id", F.posexplode(side).alias(f"{side}_i", f"{side}_h"))
        by = [f"{side}_i", f"{side}_h"]
        sides.append(s.join(s.groupBy(*by).count().where("count > 1").drop("count"), by, "left_semi"))
    return sides[0].join(sides[1], "id").select(F.xxhash64("left_i", "left_h", "right_i", "right_h").alias("key"), "id")


def _with_sets(pairs: DataFrame, sets: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs with the full shingle sets sa and sb of both."""
    left, right = (sets.select(F.col("id").alias(name), F.col("s").alias(s)) for name, s in ((a, "sa"), (b, "sb")))
    return pairs.join(right, b).join(left, a)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full shingle sets are similar enough."""
    df = _with_sets(pairs, sets).withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return df.where(100 * F.col("both") >= percent * (F.size("sa") + F.size("sb") - F.col("both"))).select(*pairs.columns).distinct()


def _sizes(m: str, n: str, percent: int):
    """Sets of such sizes can be similar enough."""
    return F.lit(100) * F.least(m, n) >= F.lit(percent) * F.greatest(m, n)


def _merged(df: DataFrame, to: DataFrame) -> DataFrame:
    """df with its column c replaced by the component that c has become a part of."""
    to = to.select(F.col("id").alias("_c"), F.col("component").alias("_to"))
    return df.join(to, F.col("c") == F.col("_c"), "left").withColumn("c", F.coalesce("_to", "c")).drop("_c", "_to")


def _left_over(at: DataFrame, sets: DataFrame, percent: int, apart=None) -> DataFrame:
    """Pairs a, b of different components c, d that meet in a table of `at` and are similar enough: all of them, without forming all pairs.

    Each set is written as what it adds to the first member (pivot) of its table and what of it it lacks. If A is not similar
    enough to the pivot, then any B that A is similar enough to shares with A an added or a lacked shingle, for else the two
    differ by all that both differ from the pivot by, which is too much already; and without a shared added one their
    added shingles and the difference of their lacked ones must stay within what the similarity allows. So
    pairs are looked for by shared added shingles, and by lacked ones only among sets of which such a sum is possible.
    Pairs of sets that both are similar enough to the pivot are in one component through it. Where `apart` (of two columns x)
    forbids some pairs, sets that are similar to the pivot but must not be linked with it are compared with all of the table.
    """
    more = ["x"] if apart else []
    first = at.groupBy("key").agg(F.min(F.struct("o", "id", "c", *more)).alias("h"), F.max("c").alias("hi"), F.min("c").alias("lo")).where("lo < hi")
    first = first.select("key", F.col("h.id").alias("a"), F.col("h.c").alias("d"), *[F.col("h.x").alias("xa") for _ in more])
    near = at.join(first, "key").where("id <> a").select("a", "d", F.col("id").alias("b"), "c", *[F.col("xa") for _ in more], *more).distinct()
    df = _with_sets(near, sets).withColumn("p", F.array_except("sb", "sa")).withColumn("q", F.array_except("sa", "sb"))
    df = df.withColumn("np", F.size("p").cast("long")).withColumn("nq", F.size("q").cast("long")).withColumn("n", F.size("sb").cast("long")).withColumn("m", F.size("sa").cast("long"))
    far, near_ = F.lit(100 + percent), F.lit(100 - percent)
    df = df.withColumn("ok", far * (F.col("np") + F.col("nq")) <= near_ * (F.col("n") + F.col("m")))
    delta = stored(df.drop("sa", "sb"), "differences")
    links = stored(delta.where("ok and c <> d").where(apart(F.col("xa"), F.col("x")) if apart else F.lit(True)).select("a", "b", "c", "d"), "links")
    some = delta.where("not ok").select("a").distinct()
    each = delta.join(some, "a", "left_semi").select("a", "b", "c", "np", "nq", "n", "m", "ok", "p", "q", *more)
    if apart:  # sets similar to the pivot that must not be linked with it, and the members of their tables
        held = at.join(first.select("key", "a"), "key").select("key", "a", "id", "c", "n", "x")
        close = delta.where("ok").where(~apart(F.col("xa"), F.col("x"))).select("a", F.col("b").alias("id")).distinct()
        close = held.join(close, ["a", "id"], "left_semi")
        held = stored(held.join(close.select("key").distinct(), "key", "left_semi").join(close.select("key", "id", F.lit(True).alias("close")), ["key", "id"], "left"), "close")

    def against_close() -> DataFrame:
        other = held.select("key", F.col("id").alias("f"), F.col("c").alias("d"), F.col("n").alias("n2"), F.col("x").alias("xa"))
        both = held.where("close").join(other, "key").where((F.col("c") != F.col("d")) & apart(F.col("x"), F.col("xa")) & _sizes("n", "n2", percent))
        return both.select(F.col("id").alias("b"), "f", "c", "d")

    # where sets that are similar to the pivot may not be linked with it, families with common differences come together first: each set is compared with the one that leads most of its added and
    # lacked shingles, which is the one nearest to the pivot that has the shingle added or lacking, and in later rounds any
    for turn in range(FAMILIES if apart else 0):
        to = components(links, "c", "d")
        was, each = each, stored(_merged(each, to), "differences")
        dropped(was)
        if apart:
            was, held = held, stored(_merged(held, to), "close")
            dropped(was)
        dropped(to)
        added = each.select("a", "b", "c", "n", "ok", *more, (F.col("np") + F.col("nq")).alias("far"), F.explode(F.concat("p", "q")).alias("e"))
        order = F.lit(0).cast("long") if turn else F.col("far")
        lead = added.groupBy("a", "e").agg(F.min(F.struct(order.alias("far"), F.xxhash64("b", F.lit(turn)).alias("o"), F.col("b").alias("f"), F.col("c").alias("d"), F.col("n").alias("n2"), *[F.col("x").alias("xa") for _ in more])).alias("h"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi")
        led = added.where("not ok").drop("far").join(lead.select("a", "e", "h.f", "h.d", "h.n2", *[F.col("h.xa") for _ in more]), ["a", "e"]).where((F.col("c") != F.col("d")) & _sizes("n", "n2", percent))
        led = led.where(apart(F.col("x"), F.col("xa"))) if apart else led
        led = led.groupBy("b", "f", "c", "d").count().groupBy("b").agg(F.max(F.struct("count", "f", "c", "d")).alias("r"))
        led = led.select(F.col("r.f").alias("a"), "b", "r.c", "r.d")
        if apart:  # with one member of each component at first
            one = against_close().groupBy("b", "c", "d").agg(F.min(F.struct(F.xxhash64("f", F.lit(turn)), "f"))["f"].alias("a"))
            led = led.unionByName(one.select("a", "b", "c", "d"))
        pairs = stored(led, "pairs")
        new = stored(_confirmed(pairs, sets, percent), "links")
        dropped(pairs)
        if new.isEmpty():
            break
        was, links = links, stored(links.unionByName(new), "links")
        dropped(was, new)
    else:
        turn = FAMILIES
    if turn == FAMILIES:  # the last of them found links
        to = components(links, "c", "d")
        was, each = each, stored(_merged(each, to), "differences")
        dropped(was)
        if apart:
            was, held = held, stored(_merged(held, to), "close")
            dropped(was)
        dropped(to)
    base = ["a", "b", "c", "np", "nq", "n", "ok", *more]
    added = each.select(*base, F.lit(True).alias("more"), F.explode("p").alias("e"))
    lacked = each.where(far * F.col("np") <= near_ * (F.col("n") + F.col("m") - F.col("nq"))).select(*base, F.lit(False).alias("more"), F.explode("q").alias("e"))
    x = added.unionByName(lacked).where("not ok").drop("ok")
    y = added.unionByName(lacked.where("nq > np"))
    y = y.select("a", "e", F.col("b").alias("b2"), F.col("c").alias("c2"), F.col("np").alias("np2"), F.col("nq").alias("nq2"), F.col("n").alias("n2"), "ok", *[F.col("x").alias("x2") for _ in more])
    total = near_ * (F.col("n") + F.col("n2"))
    gap = F.abs(F.col("nq") - F.col("nq2"))
    fits = F.when(F.col("more"), far * (F.abs(F.col("np") - F.col("np2")) + gap) <= total).otherwise(far * (F.col("np") + F.col("np2") + gap) <= total)
    fits = fits & apart(F.col("x"), F.col("x2")) if apart else fits
    met = x.join(y, ["a", "e"]).where((F.col("c") != F.col("c2")) & (F.col("ok") | (F.col("b") < F.col("b2"))) & fits)
    met = met.groupBy("a", "b", "b2", "c", "c2").agg(F.sum(F.col("more").cast("int")).alias("shared"), *[F.first(k).alias(k) for k in ("np", "np2", "nq", "nq2", "n", "n2")])
    least = F.col("np") + F.col("np2") - 2 * F.col("shared") + gap
    met = met.where(far * least <= total).select(F.least("b", "b2").alias("a"), F.greatest("b", "b2").alias("b"), F.when(F.col("b") < F.col("b2"), F.col("c")).otherwise(F.col("c2")).alias("c"), F.when(F.col("b") < F.col("b2"), F.col("c2")).otherwise(F.col("c")).alias("d"))
    if apart:
        met = met.unionByName(against_close().select(F.col("f").alias("a"), "b", F.col("d").alias("c"), F.col("c").alias("d")))
    pairs = stored(met.distinct(), "pairs")
    found = stored(links.unionByName(_confirmed(pairs, sets, percent)), "links")
    dropped(delta, each, pairs, links, held if apart else None)
    return found


def link_sets(every: DataFrame, sets: DataFrame, percent: int, apart=None, rounds: int = ROUNDS) -> DataFrame:
    """id and c (component) of every id of the tables after linking all that meet in a table and whose sets are similar enough.

    every: stored rows key (table), id, n and n0 (largest and smallest size of the id's sets), o (order: the first of a table is compared
    with the others first), c (= id), with `apart` also x, on which it decides which pairs may be linked. For some rounds each id
    is compared with the first members of its tables; those of a first member's component then leave its table and the next round takes
    another first member. What is left is found by _left_over. The tables are removed.
    """
    more = ["x"] if apart else []
    label = stored(every.select("id", "c").distinct(), "labels")
    at = every
    for _ in range(rounds):
        head = at.groupBy("key").agg(F.min(F.struct("o", "id", "c", "n", "n0", *more)).alias("h"), F.max("c").alias("hi"), F.min("c").alias("lo")).where("lo < hi").select("key", "h")
        fits = (F.col("c") != F.col("h.c")) & (F.lit(100) * F.least("n", "h.n") >= F.lit(percent) * F.greatest("n0", "h.n0"))
        fits = fits & apart(F.col("x"), F.col("h.x")) if apart else fits
        pairs = stored(at.join(head, "key").where(fits).select(F.col("h.id").alias("a"), F.col("id").alias("b"), "c", F.col("h.c").alias("d")).distinct(), "pairs")
        links = stored(_confirmed(pairs, sets, percent), "links")
        dropped(pairs)
        if links.isEmpty():  # the exact search sees to the rest
            break
        to = components(links, "c", "d")
        was, label = label, stored(_merged(label, to), "labels")
        # the first member's component leaves its table
        gone = head.select("key", F.col("h.c").alias("c"))
        left = stored(_merged(at.join(head.select("key"), "key", "left_semi"), to).join(_merged(gone, to), ["key", "c"], "left_anti"), "tables")
        dropped(was, to, links, at if at is not every else None)
        at = left
    dropped(at if at is not every else None)
    now = stored(every.drop("c").join(label, "id"), "tables")
    dropped(every)
    links = _left_over(now, sets, percent, apart)
    if not links.isEmpty():
        to = components(links, "c", "d")
        was, label = label, stored(_merged(label, to), "labels")
        dropped(was, to)
    dropped(now, links)
    return label


def near_duplicates(docs: DataFrame, *, text: str = "text", key: str = "doc_id", size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Each row's key, n_shingles, component_id (smallest key reachable over links) and kept (it is its own component's key).

    Documents are linked if the Jaccard similarity of their sets of `size`-word shingles (A-Z lower-cased)
    is at least percent / 100; every link is confirmed on the full sets. Documents of equal sets share one
    representative. For three rounds each document is compared with the first members (those that meet the
    most others) of its tables; those of a first member's component then leave its table and the next round
    takes another first member. At last all colliding pairs between different components that can be similar enough are
    found exactly (_left_over), so no colliding pair goes unexamined unless it is joined already or ruled out.

    Null and empty texts have no shingles and stay alone. Rows that repeat a key count as one document, which is linked
    if any of its texts is. A null key has no component and is kept. Other columns are not looked at; an empty table gives no rows.
    """
    sig = stored(signatures(docs, text, key, size, bands, rows), "signatures")
    whole = sig.where("n > 0 and id is not null")
    classes = whole.groupBy("n", "sa", "sb").agg(F.min(F.struct("id", "left", "right")).alias("r"))
    classes = stored(classes.select("n", "sa", "sb", "r.*"), "classes")
    tables = stored(_tables(classes), "tables")
    # documents that meet the most others come first: the origin of a group of copies is nearer to all than they are to each other
    many = tables.groupBy("key").agg(F.count("*").alias("k")).where("k > 1")
    degree = tables.join(many, "key").groupBy("id").agg(F.sum("k").alias("k"))
    sized = classes.groupBy("id").agg(F.max("n").alias("n"), F.min("n").alias("n0"))
    at = tables.join(many.select("key"), "key", "left_semi").join(degree, "id").join(sized, "id")
    every = stored(at.select("key", "id", "n", "n0", (-F.col("k")).alias("o"), F.col("id").alias("c")), "tables")
    texts = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).join(every.select("id").distinct(), "id", "left_semi")
    sets = stored(shingle_sets(texts, size), "sets")
    dropped(tables)
    label = link_sets(every, sets, percent)
    named = classes.select("n", "sa", "sb", "id").join(label.withColumnRenamed("c", "component"), "id", "left").select("n", "sa", "sb", F.coalesce("component", "id").alias("component"))
    out = sig.select("id", "n", "sa", "sb").join(named, ["n", "sa", "sb"], "left")
    # the texts of a repeated key may lie in different components: they are one document
    again = out.groupBy("id").agg(F.count_distinct("component").alias("k"), F.min("component").alias("lo")).where("k > 1 and id is not null")
    if not again.isEmpty():
        both = out.join(again.select("id"), "id", "left_semi").join(again.select("id", "lo"), "id").select("component", "lo")
        out = _merged(out.withColumnRenamed("component", "c"), components(both, "component", "lo")).withColumnRenamed("c", "component")
    comp_id = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    out = stored(out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), comp_id.alias("component_id"), F.coalesce(F.col("id") == comp_id, F.lit(True)).alias("kept")), "near-duplicates")
    dropped(sig, classes, sets, label)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    """op7: two-word shingles over all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=2)


#: The query by brute force: all pairs of different sets that share a shingle, and the smallest id reachable from each.
SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s FROM d),
c AS (SELECT min(doc_id) AS id, s FROM s WHERE len(s) > 0 GROUP BY s),
e AS (SELECT id, len(s) AS n, unnest(s) AS g FROM c),
p AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.g = b.g AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT id, id AS root FROM c UNION SELECT l.b, r.root FROM r JOIN l ON r.id = l.a),
m AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(root, doc_id) AS component_id, doc_id = coalesce(root, doc_id) AS kept
FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN m ON c.id = m.id
"""
