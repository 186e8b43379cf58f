"""Token ids in a content-addressed store: unique chunks once, a recipe for each document, Merkle roots to verify."""

from __future__ import annotations

import hashlib
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axisweave.llm.text import bounded_broadcast, dropped, stored

#: Mean ids of a chunk (a power of two), least and most ids, and ids that the rolling hash sees.
MEAN, LEAST, MOST, SEEN = 512, 128, 2048, 16
END = 2
#: Pieces of text in each of the two generations that a worker keeps the ids of, and rows of a broadcast table, at most.
CACHE, BROADCAST_ROWS = 600_000, 1_000_000
#: Documents under one node of the manifest's lowest level.
SEGMENT = 4096
_BASE = np.uint64(0x9E3779B97F4A7C55)


#: The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others one after another from U+0100.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
LETTERS = {b: b for b in _PRINTED} | {b: 0x100 + k for k, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Letters and numbers up to U+024F, and the kind of each character up to there: neither, space, other white space, letter, number.
L, N = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
#: How the library cuts texts of these characters: piece_starts restates it for many texts at once.
PIECE = rf" ?[{L}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{N}]+| ?[^\s{L}{N}]+|\s+(?!\S)|\s+"
_OTHER, _BLANK, _SPACE, _LETTER, _NUMBER = range(5)
_KIND = np.array([next((k for k, c in ((_BLANK, " "), (_SPACE, r"\s"), (_LETTER, L), (_NUMBER, N)) if re.match(f"[{c}]", chr(x))), _OTHER) for x in range(0x250)], np.uint8)


def piece_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the pieces of PIECE begin in the UTF-8 bytes of texts below U+0250 that lie between the bounds, one after another."""
    n = len(data)
    kind = _KIND[data]
    lead = np.flatnonzero(data >= 0xC0)
    kind[lead] = kind[lead + 1] = _KIND[(data[lead].astype(np.int64) & 0x1F) << 6 | data[lead + 1] & 0x3F]
    edge = np.zeros(n + 3, bool)
    edge[bounds], edge[n:] = True, True
    space = (kind == _BLANK) | (kind == _SPACE)
    start = edge[:n].copy()
    # a piece goes on over characters of a kind, and over all white space but the last before other characters, which joins them if it is a blank
    start[1:] |= (kind[1:] != kind[:-1]) & ~(space[1:] & space[:-1]) & (kind[:-1] != _BLANK)
    start[:-1] |= space[:-1] & ~space[1:] & ~edge[1:n]
    start[1:] |= space[1:] & ~space[:-1]
    mark = np.flatnonzero((data == 0x27) & start)
    near = np.append(data, np.zeros(2, np.uint8))
    one, two = near[mark + 1], near[mark + 1].astype(np.int64) << 8 | near[mark + 2]
    short = np.isin(one, list(b"stmd")) & ~edge[mark + 1]
    long = np.isin(two, [int.from_bytes(x, "big") for x in (b"re", b"ve", b"ll")]) & ~edge[mark + 1] & ~edge[mark + 2]
    use = short | long
    mark, after = mark[use], mark[use] + np.where(short[use], 2, 3)
    start[mark + 1] = False
    start[after[after < n]] = True
    return np.flatnonzero(start)


class Encoder:
    """Byte-level BPE by the tokenizers library, piece by piece: pieces are what its pre-tokenizer cuts, and equal pieces have equal ids."""

    #: Texts of these characters are cut by piece_starts exactly as by the library; others go to it whole.
    PLAIN = r"[\t\n\r\x20-\x7e¡-¬®-ɏ]*"

    def __init__(self, path: str, literal: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        #: Texts with an added token's content go to the library whole, unless it is encoded literally.
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values() if not (literal and t.special)]
        self.added = re.compile("|".join(added), re.IGNORECASE) if added else None
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids don't fit in 16 bits")
        self.plain = re.compile(self.PLAIN)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.merger = Tokenizer.from_file(path)
        self.merger.pre_tokenizer = Split(chr(LETTERS[10]), "isolated")
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("H", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, white space last. Those without white space inside go to the library as lines of one text, their bytes already written as the
        vocabulary's letters, so that it has but to merge them: a line's end is a piece of its own, whose id parts them again."""
        blank = next((k for k, p in enumerate(pieces) if p.isspace()), len(pieces))
        lines, rest = pieces[:blank], pieces[blank:]
        ids = np.array(self.merger.encode_batch_fast(["\n".join(lines).encode().decode("latin-1").translate(LETTERS)], add_special_tokens=False)[0].ids, "<u2") if lines else np.zeros(0, "<u2")
        edge = np.flatnonzero(ids == self.line)
        if len(edge) != max(0, len(lines) - 1):
            return self._ids(lines + rest)
        raw, at = ids.tobytes(), [-2, *(edge * 2).tolist(), len(ids) * 2]
        found = [raw[a + 2 : b] for a, b in zip(at[:-1], at[1:])] if lines else []
        return found + self._ids(rest)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 16-bit ids of each text."""
        cut = [bool(self.plain.fullmatch(t)) and not (self.added and self.added.search(t)) for t in texts]
        coded = [t.encode() for t, c in zip(texts, cut) if c]
        bounds = np.cumsum([0, *map(len, coded)])
        data = np.frombuffer(b"".join(coded), np.uint8)
        starts = piece_starts(data, bounds)
        ends = np.append(starts, len(data)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        used = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [p for p in used if p not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.known, self.older, new = {}, self.known, used
        if self.older:  # what is still in use moves to the newer generation
            self.known.update({p: self.older[p] for p in new if p in self.older})
            new = [p for p in new if p not in self.known]
        new = sorted(new, key=str.isspace)  # white space last, as _pieces gives it
        self.known.update(zip(new, self._pieces(new)))
        held = [self.known[p] for p in used]
        # the ids of each different piece, then of each piece in order
        flat, size = np.frombuffer(b"".join(held), "<u2"), np.fromiter(map(len, held), np.int64, len(held)) // 2
        at, which = np.cumsum(size) - size, pieces.indices.to_numpy()
        to = np.concatenate([[0], np.cumsum(size[which])])
        ids = flat[np.repeat(at[which] - to[:-1], size[which]) + np.arange(to[-1])].tobytes()
        of = iter((2 * to[np.searchsorted(starts, bounds)]).tolist())
        out, begin = [], next(of)
        for t, c in zip(texts, cut):
            if c:
                end = next(of)
                out.append(ids[begin:end])
                begin = end
            else:
                out.append(self._ids([t])[0])
        return out


def encoder(path: str, literal: bool = True) -> Encoder:
    """This process's encoder; a worker keeps it from task to task."""
    held, name = sys.__dict__.setdefault("_axisweave_encoders", {}), (path, literal)
    return held.setdefault(name, None) or held.__setitem__(name, Encoder(path, literal)) or held[name]


def all_cuts(ids: np.ndarray, bounds: list[int]) -> list[list[int]]:
    """Ends of the content-defined chunks of each text of ids between the bounds: where the rolling hash of the last ids has its low bits
    clear, within the least and most sizes. A text's first ids, whose hash sees those of the text before, are less than the least size."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    for k in (1 << x for x in range(SEEN.bit_length() - 1)):  # over twice as many ids each time
        h[k:] += h[:-k] * np.uint64(pow(int(_BASE), k, 1 << 64))
    marks = np.flatnonzero((h >> np.uint64(40)) & np.uint64(MEAN - 1) == 0) + 1
    first, marks = np.searchsorted(marks, bounds, "right").tolist(), marks.tolist()
    every = []
    for a, b, x, y in zip(bounds[:-1], bounds[1:], first[:-1], first[1:]):
        out, last, n = [], 0, b - a
        for m in [*(m - a for m in marks[x:y]), n]:
            while m - last > MOST:
                last += MOST
                out.append(last)
            if m - last >= LEAST or (m == n and m > last):
                last = m
                out.append(m)
        every.append(out)
    return every


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of one text's chunks."""
    return all_cuts(ids, [0, len(ids)])[0]


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root over chunk digests in order; an odd node moves up unchanged."""
    level = leaves or [digest(b"")]
    while len(level) > 1:
        level = [digest(level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


_CHUNKED = "n long, recipe array<binary>, root binary, payloads array<binary>"


def _writer(path: str, end: int, literal: bool):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, literal)
        for batch in batches:
            texts, at = batch.column(1), 0
            while at < len(batch):
                part, size = [], 0
                while at + len(part) < len(batch) and (not part or size < 1 << 22) and len(part) < 2048:
                    part.append(texts[at + len(part)].as_py() or "")
                    size += len(part[-1])
                n, recipes, roots, payloads = [], [], [], []
                mark = end.to_bytes(2, "little")
                coded = [raw + mark for raw in enc.encode(part)]
                bounds = np.cumsum([0, *map(len, coded)]) // 2
                for raw, ends in zip(coded, all_cuts(np.frombuffer(b"".join(coded), "<u2"), bounds.tolist())):
                    data = [raw[2 * a : 2 * b] for a, b in zip([0, *ends], ends)]
                    names = [digest(x) for x in data]
                    n.append(len(raw) // 2)
                    recipes.append(names)
                    roots.append(merkle(names))
                    payloads.append(data)
                lists = [pa.array(x, pa.list_(pa.binary())) for x in (recipes, payloads)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), batch.column(2).slice(at, len(part)), pa.array(n, pa.int64()), lists[0], pa.array(roots, pa.binary()), lists[1]], ["id", "tie", "n", "recipe", "root", "payloads"])
                at += len(part)

    return write


def _assembled(recipe: list[bytes], have: dict[bytes, bytes], root: bytes) -> tuple[int, int]:
    """Number of ids and crc32 of them as 32-bit values, after every digest and the root have been verified."""
    for d in recipe:
        if digest(have[d]) != d:
            raise ValueError("a chunk does not match its digest")
    if merkle(recipe) != root:
        raise ValueError("a recipe does not match its root")
    ids = np.frombuffer(b"".join(have[d] for d in recipe), "<u2").astype("<u4")
    return len(ids), zlib.crc32(ids.tobytes())


def _reader(keep: list[str]):
    """Rows with recipe, root and chunks (digest and payload) to n and crc, with the kept columns."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, crc = [], []
            for recipe, root, payloads, names in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("recipe", "root", "payloads", "names"))):
                have = {d: p for d, p in zip(names.as_py(), payloads.as_py()) if p is not None}
                a, b = _assembled(recipe.as_py(), have, root.as_py())
                n.append(a)
                crc.append(b)
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(crc, pa.int64())], [*keep, "n", "crc"])

    return read


def write_store(docs: DataFrame, *, text: str = "text", key: str = "doc_id", tokenizer: str | None = None, end: int = END, literal: bool = True) -> DataFrame:
    """Encode every text and write the store, a row a document in ascending order of key (then of the text's hash).

    Columns: part (number of the file) and at (place in it), id, n (ids, the end id included), recipe (digests of its chunks), root,
    payloads (its chunks as 16-bit ids, null where an earlier place owns the chunk), borrowed (true if a chunk is another document's).
    The owner of a chunk is its first place in the store's order, so each unique chunk is stored once. Encoded rows are written first,
    ownership is settled on the digests alone, and the final files follow in one sorted pass.
    With `literal` a special token's content in a text is encoded as any other text, without it as the library's default, the token's id.

    Null and empty texts are the end id alone; null keys come first; rows that repeat a key stand side by side, repeated rows share
    all their chunks. Other columns are not looked at; an empty table gives an empty store.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    made = rows.mapInArrow(_writer(tokenizer or default_tokenizer(), end, literal), f"id {kind}, tie long, {_CHUNKED}").withColumn("row", F.monotonically_increasing_id())
    first = stored(made, "encoded")
    chunk = first.select("id", "tie", "row", F.posexplode("recipe").alias("pos", "d"))
    owner = chunk.groupBy("d").agg(F.min(F.struct("id", "tie", "row", "pos")).alias("o"), F.count("*").alias("c")).where("c > 1").select("d", F.col("o.row").alias("o"), F.col("o.pos").alias("p"))
    repeat = chunk.join(owner, "d").where((F.col("row") != F.col("o")) | (F.col("pos") != F.col("p")))
    repeat = stored(repeat.groupBy("row").agg(F.collect_list("pos").alias("_gone"), F.max(F.col("row") != F.col("o")).alias("borrowed")), "repeats")
    gone = F.coalesce("_gone", F.array().cast("array<int>"))
    store = first.join(bounded_broadcast(repeat, repeat.count(), BROADCAST_ROWS), "row", "left").withColumn("payloads", F.transform("payloads", lambda p, i: F.when(~F.array_contains(gone, i), p)))
    store = store.select("id", "tie", "row", "n", "recipe", "root", "payloads", F.coalesce("borrowed", F.lit(False)).alias("borrowed"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    store = store.repartitionByRange(parts, "id", "tie", "row").sortWithinPartitions("id", "tie", "row").withColumn("_m", F.monotonically_increasing_id())
    store = store.select(F.shiftright("_m", 33).cast("int").alias("part"), F.col("_m").bitwiseAND((1 << 33) - 1).alias("at"), "id", "n", "recipe", "root", "payloads", "borrowed")
    store = stored(store, "store")
    dropped(first, repeat)
    return store


def manifest(store: DataFrame) -> DataFrame:
    """part, segment, docs, ids and root of every SEGMENT documents of a file in order: the Merkle root over their documents' roots."""

    @F.pandas_udf("binary")
    def over(roots: pd.Series) -> pd.Series:
        return roots.map(lambda x: merkle(list(x)))

    rows = store.select("part", F.floor(F.col("at") / SEGMENT).alias("segment"), "at", "root", "n")
    by = rows.groupBy("part", "segment").agg(F.count("*").alias("docs"), F.sum("n").alias("ids"), F.sort_array(F.collect_list(F.struct("at", "root"))).alias("r"))
    return by.select("part", "segment", "docs", "ids", over(F.transform("r", lambda x: x["root"])).alias("root"))


def manifest_root(tree: DataFrame) -> bytes:
    """The store's Merkle root: over its files, and in each file over its segments; one digest a SEGMENT of documents comes to the driver."""
    files: dict[int, list[bytes]] = {}
    for r in tree.select("part", "segment", "root").orderBy("part", "segment").toLocalIterator():
        files.setdefault(r["part"], []).append(bytes(r["root"]))
    return merkle([merkle(x) for _, x in sorted(files.items())])


def read_store(store: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """id, start, n_tokens and ids_crc32 of every document, rebuilt from its recipe and verified.

    Every chunk is held against its digest, every recipe against its root, and all roots against the manifest `tree` if it is given;
    what does not match raises an error. A document that owns all its chunks is rebuilt inside its row. Of the others each distinct
    recipe is rebuilt once, from the chunks that it names, and its figures joined to the rows that have it.
    start counts the ids of the documents before it in the files, which are in ascending order of id. An empty store gives no rows.
    """
    whole = store.where("not borrowed").withColumn("names", F.col("recipe")).select("part", "at", "id", "recipe", "root", "payloads", "names")
    kind = store.schema["id"].dataType.simpleString()
    own = whole.mapInArrow(_reader(["part", "at", "id", "root"]), f"part int, at long, id {kind}, root binary, n long, crc long")
    parts = store.where("borrowed")
    lists = stored(parts.groupBy("root").agg(F.min("recipe").alias("recipe")), "recipes")
    need = lists.select("root", F.explode(F.array_distinct("recipe")).alias("d"))
    wanted = need.select("d").distinct()
    have = store.select(F.explode(F.arrays_zip(F.col("recipe").alias("d"), F.col("payloads").alias("p"))).alias("x")).select("x.d", "x.p").where("p is not null").join(wanted, "d", "left_semi")
    got = need.join(have, "d").groupBy("root").agg(F.collect_list("d").alias("names"), F.collect_list("p").alias("payloads"))
    built = lists.join(got, "root").mapInArrow(_reader(["root"]), "root binary, n long, crc long")
    rest = parts.select("part", "at", "id", "root").join(built, "root").select("part", "at", "id", "root", "n", "crc")
    every = stored(own.unionByName(rest).withColumn("segment", F.floor(F.col("at") / SEGMENT)), "read")
    dropped(lists)
    if tree is not None:
        found = manifest(every).select("part", "segment", "docs", "ids", "root")
        if manifest_root(found) != manifest_root(tree) or not found.exceptAll(tree.select(*found.columns)).isEmpty():
            raise ValueError("the store does not match its manifest")
    past = Window.orderBy("part", "segment").rowsBetween(Window.unboundedPreceding, -1)
    sums = every.groupBy("part", "segment").agg(F.sum("n").alias("s")).select("part", "segment", F.coalesce(F.sum("s").over(past), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part", "segment").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.col("base")
    return every.join(sums, ["part", "segment"]).select("id", start.alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: all documents, with the library's own handling of special tokens, written with a manifest, read back and verified."""
    store = write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), literal=False)
    return read_store(store, stored(manifest(store), "manifest")).withColumnRenamed("id", "doc_id")
