"""Sharding by balanced label propagation over documents that share a text or passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axisweave.llm.text import dropped, lower_ascii, stored

SHARDS = 40
#: Rounds of propagation, rows of a block of equal texts at most, and how far a shard may be filled while labels move.
ROUNDS, BLOCK, SLACK = 4, 64, 1.02
#: What lies between stops or line ends is a sentence. A passage is a sentence of so many characters, or one that is shorter with as many of those
#: after it as make up so many; a document is linked by all of its passages.
CHARACTERS = 24
#: Steps by which a shard's free room is dealt out to those who want to move there.
STEPS = 1024


def propagate(nodes: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, load: DataFrame | None = None, capacity: float | None = None) -> DataFrame:
    """id, weight and label of every node, after moving linked nodes together under quotas.

    nodes: id, weight; links: id, hub, where nodes that name a hub are linked with each other through it (a link
    between two nodes is a hub of their own). load: label and weight of what else fills the shards and stays. capacity: weight that a
    shard may hold, or a little more than an equal share of nodes and load. In each round a
    hub's label is that of the most weight among its nodes, a node wants the label that most of its hubs have, and
    a shard admits movers, in seeded order by steps of equal probability, as far as its quota has room. Ties go to the
    label with the most room, as a full one would admit nobody, then to the smaller one. Votes and wishes are summed per task before they are shuffled; no hub is gathered.

    Nodes without links keep the label that their id's hash gives; links to unknown nodes and null ids or hubs are passed over, repeated
    links vote again, and empty tables give no rows.
    """
    label = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    now = stored(nodes.select("id", "weight", label.alias("label")), "labels")
    fixed = now.sparkSession.createDataFrame([], "label int, weight long") if load is None else load.select(F.col("label").cast("int"), F.col("weight").cast("long"))
    for turn in range(rounds):
        was = now
        filled = now.select("label", "weight").unionByName(fixed).groupBy("label").agg(F.sum("weight").alias("w"))
        free = F.broadcast(filled.select("label", (-F.col("w")).alias("free")))  # at most `shards` rows
        votes = links.join(now, "id").groupBy("hub", "label").agg(F.sum("weight").alias("w")).join(free, "label")
        best = votes.groupBy("hub").agg(F.max(F.struct("w", "free", (-F.col("label")).alias("l"))).alias("b")).select("hub", "b.free", (-F.col("b.l")).alias("to"))
        wish = links.join(best, "hub").groupBy("id", "to", "free").agg(F.count("*").alias("c"))
        wish = wish.groupBy("id").agg(F.max(F.struct("c", "free", (-F.col("to")).alias("t")))["t"].alias("t")).select("id", (-F.col("t")).alias("to"))
        step = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(STEPS)).cast("int")
        moves = stored(now.join(wish, "id").where("to <> label").select("id", "weight", "label", "to", step.alias("step")), "moves")
        every = now.sparkSession.range(shards).select(F.col("id").cast("int").alias("label")).join(F.broadcast(filled), "label", "left")
        leaving = moves.groupBy("label").agg(F.sum("weight").alias("out"))
        every = every.join(leaving, "label", "left").withColumn("cap", F.lit(SLACK) * F.sum("w").over(Window.partitionBy()) / shards if capacity is None else F.lit(float(capacity)))
        # half of what wants to leave is taken to make room
        room = every.select(F.col("label").alias("to"), (F.col("cap") - F.coalesce("w", F.lit(0)) + F.coalesce("out", F.lit(0)) / 2).alias("room"))
        steps = moves.groupBy("to", "step").agg(F.sum("weight").alias("w")).join(room, "to")
        upto = Window.partitionBy("to").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
        let = steps.withColumn("sum", F.sum("w").over(upto)).where("sum <= room").select("to", "step")
        admitted = moves.join(F.broadcast(let), ["to", "step"], "left_semi").select("id", "to")  # at most shards * STEPS rows
        now = stored(now.join(admitted, "id", "left").select("id", "weight", F.coalesce("to", "label").alias("label")), "labels")
        none = moves.isEmpty()
        dropped(was, moves)
        if none:
            break
    return now


def ranked(df: DataFrame, by: list[str], tag: str) -> DataFrame:
    """df with rank, the gapless place of each row in the order of `by`: a range-partitioned sort and one offset for each partition.

    Nulls come first; rows that agree in all of `by` are placed either way between themselves, once and for good as the order is written. An empty table gives no rows.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mark = F.monotonically_increasing_id()
    df = df.repartitionByRange(n, *by).sortWithinPartitions(*by)
    df = stored(df.withColumn("_m", mark).withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m"), tag)
    past = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy("_p").count().select("_p", F.coalesce(F.sum("count").over(past), F.lit(0)).alias("_start"))
    return df.join(F.broadcast(starts), "_p").withColumn("rank", F.col("_start") + F.col("_i")).drop("_p", "_i", "_start")


def cut_links(links: DataFrame, placed: DataFrame) -> DataFrame:
    """One row: all (links of nodes to their hubs, less one for each hub) and cut (those of them outside the label that most of the hub's nodes have).

    links: id, hub; placed: id, label. A hub of one node has no link. Without links both are 0.
    """
    by = links.join(placed.select("id", "label"), "id").groupBy("hub", "label").agg(F.count("*").alias("c")).groupBy("hub").agg(F.sum("c").alias("n"), F.max("c").alias("most"))
    zero = F.lit(0).cast("long")
    return by.agg(F.coalesce(F.sum(F.col("n") - 1), zero).alias("all"), F.coalesce(F.sum(F.col("n") - F.col("most")), zero).alias("cut"))


def sentence_hashes(text: Column, characters: int = CHARACTERS) -> Column:
    """Hashes of all of a text's different passages: from each sentence on (between stops and line ends, A-Z lower-cased, without the white space
    around it) the fewest whole sentences that have `characters` together.

    Whatever whole sentences in a row two texts have in common, of `characters` or more together, they have a passage in common. A text of
    fewer characters is one passage as a whole; a null text and one without words have none.
    """
    parts = F.transform(F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[.!?\n]+", -1), lambda x: F.trim(x, F.lit(" \t\r\x0b\x0c")))
    parts = F.filter(parts, lambda x: x != "")

    def passages(every: Column) -> Column:
        def passage(x: Column, i: Column) -> Column:
            # each sentence more is two characters more, with the space before it
            run = F.aggregate(F.slice(every, i + 2, characters // 2), x, lambda a, y: F.when(F.length(a) >= characters, a).otherwise(F.concat(a, F.lit(" "), y)))
            run = F.when(F.length(x) >= characters, x).otherwise(run)
            return F.when((F.length(run) >= characters) | (i == 0), F.xxhash64(run))

        return F.array_distinct(F.array_compact(F.transform(every, passage)))

    return F.transform(F.array(parts), passages)[0]  # as a lambda's variable the sentences are cut but once


def document_links(base: DataFrame, total: int, shards: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups (g1, g2, c: rows, per: blocks under one hub, linked), nodes (id, weight, g1, g2) and links (id, hub) of the rows base (g1, g2, sentences).

    A node is a block of at most BLOCK rows of equal text. Blocks of one text are linked by hubs of theirs; texts that have a
    passage in common are linked by it, whichever it is. What is named by more rows than a shard holds is split
    into several hubs, as it could not lie in one shard. Rows are counted per task before they are shuffled, nothing is gathered.
    """
    room = max(1, total // shards)
    groups = base.groupBy("g1", "g2").agg(F.count("*").alias("c"), F.first("sentences").alias("sentences"))
    groups = stored(groups, "groups")
    named = groups.select("g1", "g2", "c", F.explode("sentences").alias("s"))
    shared = named.groupBy("s").agg(F.count("*").alias("k"), F.sum("c").alias("w")).where("k > 1")
    by = named.join(shared, "s").select("g1", "g2", F.xxhash64("s", F.pmod(F.xxhash64("g1", "g2"), F.ceil(F.col("w") / room).cast("long"))).alias("hub"))
    by = stored(by, "named")
    linked = by.select("g1", "g2").distinct().withColumn("linked", F.lit(True))
    groups = groups.join(linked, ["g1", "g2"], "left").where("c > 1 or linked").select("g1", "g2", "c", F.greatest(F.lit(1), F.floor(F.lit(room) / BLOCK)).cast("long").alias("per"))
    groups = stored(groups, "linked-groups")
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("c") / BLOCK).cast("long") - 1))
    blocks = groups.withColumn("block", block).withColumn("id", F.xxhash64("g1", "g2", "block"))
    own = blocks.where(F.col("c") > BLOCK).select("id", F.xxhash64("g1", "g2", F.floor(F.col("block") / F.col("per"))).alias("hub"))
    links = stored(own.unionByName(blocks.join(by, ["g1", "g2"]).select("id", "hub")), "links")
    dropped(by)
    return groups, blocks.select("id", "g1", "g2", "block"), links


def shard(docs: DataFrame, *, text: str = "text", key: str = "doc_id", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Each row's size (UTF-8 bytes of the text and 16), text_crc32, shard and slot; shards' row counts differ by one at most.

    Rows of equal text and texts that share passages are linked (document_links), and labels are propagated along the links under
    quotas. A label's rows then make its shard; those beyond its exact count, unlinked ones first, go to
    the shards that have too few.

    Null texts count as empty, null keys come first, repeated rows are dealt like others; an empty table gives no rows.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(
        F.col(key).alias("key"), (F.octet_length(t) + 16).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"),
        F.xxhash64(t).alias("g1"), F.xxhash64(F.lit(1), t).alias("g2"), sentence_hashes(t).alias("sentences"),
    )
    first = stored(base, "sizes")
    total = first.count()
    groups, _, links = document_links(first, total, shards)
    base = first.drop("sentences").join(groups, ["g1", "g2"], "left")
    node = F.xxhash64("g1", "g2", F.pmod(F.xxhash64("key", "size"), F.ceil(F.col("c") / BLOCK).cast("long")))
    base = stored(base.withColumn("_node", F.when(F.col("c").isNotNull(), node)).drop("c", "per"), "rows")
    own = F.pmod(F.xxhash64("key", "g1"), F.lit(shards)).cast("int")
    nodes = stored(base.where("_node is not null").groupBy(F.col("_node").alias("id")).agg(F.count("*").alias("weight")), "nodes")
    # rows without links make room later, so linked ones may fill a shard
    labels = propagate(nodes, links, shards, rounds, capacity=total / shards)
    # rows of one passage stand together, so that one that goes to another shard takes those linked with it along
    family = links.groupBy("id").agg(F.min("hub").alias("family"))
    labels = labels.join(family, "id", "left").select(F.col("id").alias("_node"), "label", "family")
    placed = base.join(labels, "_node", "left").withColumn("label", F.coalesce("label", own)).withColumn("alone", F.col("_node").isNull())
    order = ranked(placed.drop("_node"), ["label", "alone", "family", "g1", "g2", "key", "text_crc32"], "ranked")
    have = {r["label"]: r["count"] for r in order.groupBy("label").count().collect()}  # at most `shards` rows
    begin, over, gaps, rows = 0, 0, 0, []
    for k in range(shards):
        n, quota = have.get(k, 0), total // shards + (k < total % shards)
        rows.append((k, begin, quota, n, over, gaps, gaps + max(0, quota - n)))
        begin, over, gaps = begin + n, over + max(0, n - quota), gaps + max(0, quota - n)
    table = docs.sparkSession.createDataFrame(rows, "label int, begin long, quota long, have long, over long, gap long, gap_end long")
    order = order.join(F.broadcast(table.select("label", "begin", "quota", "over")), "label").withColumn("at", F.col("rank") - F.col("begin"))
    moved = F.when(F.col("at") >= F.col("quota"), F.col("over") + F.col("at") - F.col("quota"))
    order = order.withColumn("moved", moved)
    free = table.where("gap < gap_end").select(F.col("label").alias("to"), "gap", "gap_end", F.col("have").alias("from"))
    order = order.join(F.broadcast(free), (F.col("moved") >= F.col("gap")) & (F.col("moved") < F.col("gap_end")), "left")  # at most `shards` rows
    slot = F.when(F.col("moved").isNull(), F.col("at")).otherwise(F.col("from") + F.col("moved") - F.col("gap"))
    out = order.select(F.col("key").alias(key), "size", "text_crc32", F.coalesce("to", "label").cast("int").alias("shard"), slot.cast("long").alias("slot"))
    dropped(first, groups, base, nodes)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    """op9: all documents into 40 shards of equal row counts."""
    df = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return df.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
