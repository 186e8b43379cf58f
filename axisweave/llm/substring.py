"""Substring dedup: paragraphs that repeat, found by MinHash banding and confirmed by exact Jaccard similarity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axisweave.llm.graph import components
from axisweave.llm.neardup import link_sets
from axisweave.llm.text import dropped, stored
from axisweave.llm.vector import _power, mix, words_of

#: Words of a shingle, similarity in percent, words that a paragraph is extended to, words it has at least, and the wanted recall at that similarity.
SIZE, PERCENT, TARGET_WORDS, LEAST_WORDS, RECALL = 5, 80, 20, 10, 0.995
#: MinHashes of a band: two leave paragraphs apart that share but a phrase, and cost few bands more at the wanted recall.
ROWS = 2
#: A shared passage of this many words holds a common paragraph; where stops don't see to it, cuts do: the words whose hash is the least of this many.
PASSAGE_WORDS, NEAR_WORDS = 50, 10


def tuned_bands(similarity: float, recall: float, rows: int = ROWS) -> int:
    """Bands of `rows` MinHashes that find a pair of this similarity with this probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows) - 1e-9))


def _least(h: np.ndarray, at: np.ndarray, near: int) -> np.ndarray:
    """Place of the least of the `near` hashes from each place on, and of equal ones the last."""
    best = at.copy()
    for k in range(1, near):
        best = np.where(h[at + k] <= h[best], at + k, best)
    return best


def _unstopped(w, stop: np.ndarray, target: int, passage: int, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of paragraphs between content-defined cuts, one for each passage that no paragraph of sentences lies in.

    A cut is where the hash of a word and the next is the least of `near` in a row. The paragraph runs from the first such
    place of the passage to the next cut `target` words on, which is less than `near` further. All of this depends on
    the passage's words alone, so each copy of the passage has the paragraph.
    """
    n, none = len(w.hash), np.zeros(0, np.int64)
    x = np.arange(max(0, n - passage + 1))
    x = x[w.doc[x] == w.doc[x + passage - 1]]
    # the first paragraph of sentences whose edges, with the words on both sides, lie in the passage
    first = np.searchsorted(stop, x + 1)
    first = stop[np.minimum(first, len(stop) - 1)]
    end = stop[np.minimum(np.searchsorted(stop, first + target), len(stop) - 1)]
    x = x[(first <= x) | (end < first + target) | (end >= x + passage)]
    if not len(x):
        return none, none
    h = mix(w.hash[:-1] * np.uint64(0x2545F4914F6CDD1D) + w.hash[1:])
    rows = np.arange(max(0, n - near))
    cut = np.unique(_least(h, rows[w.doc[rows] == w.doc[rows + near]], near))
    start = np.unique(_least(h, x, near))
    return start, cut[np.searchsorted(cut, start + target)]


def _shingle_hashes(w, size: int) -> np.ndarray:
    """Hash of the `size` words from each word on; those that run beyond the words' end are not used."""
    n = len(w.hash)
    sh = np.full(n, size, np.uint64)
    for k in range(size):
        sh[: n - k] = mix(sh[: n - k] * np.uint64(0x2545F4914F6CDD1D) + w.hash[k:])
    return sh


def _sequence_hashes(w, start: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Hashes of sequences of words, by prefix sums as for words."""
    n = len(w.hash)
    power, inverse = _power(n + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(w.hash) * power[:n], dtype=np.uint64)])
    return mix((total[to] - total[start]) * inverse[start] + (to - start).astype(np.uint64))


def _pieces(col: pa.Array, bands: int, size: int, target: int, least: int, rows: int = ROWS):
    """Slice by slice of the texts: first row of the slice, its words, and of each paragraph the text in the slice, first word, end, band hashes (a row each) and the hash of its words; at last the hashes of shingles from each word on."""
    rng = np.random.default_rng(11)
    muls = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    ends_sentence = np.zeros(256, bool)
    ends_sentence[[ord("."), ord("!"), ord("?")]] = True
    for a, _, w in words_of(col, lower=True):
        n = len(w.hash)
        if not n:
            continue
        # a sentence ends at a stop, at a line's end and at the text's end
        line = np.searchsorted(np.flatnonzero(w.data == 10), w.starts)
        last = ends_sentence[w.data[w.ends - 1]]
        last[:-1] |= (line[1:] != line[:-1]) | (w.doc[1:] != w.doc[:-1])
        last[-1] = True
        stop = np.flatnonzero(last) + 1
        more = _unstopped(w, stop, target, PASSAGE_WORDS, NEAR_WORDS)
        start = np.concatenate([[0], stop[:-1]])
        doc = w.doc[start]
        limit = w.bounds[doc + 1]
        to = np.minimum(stop[np.minimum(np.searchsorted(stop, start + target), len(stop) - 1)], limit)
        # a text's end belongs to the shortest paragraph that is long enough, even if one ended before
        use = limit - start >= max(least, size)
        start, to, doc, limit = start[use], to[use], doc[use], limit[use]
        if not len(start):
            continue
        end = np.append(doc[1:] != doc[:-1], True) & (to < limit)
        start, to, doc = (np.concatenate([x, y[end]]) for x, y in ((start, start), (to, limit), (doc, doc)))
        use = to - start >= max(least, size)
        start, to = np.concatenate([start[use], more[0]]), np.concatenate([to[use], more[1]])
        sh = _shingle_hashes(w, size)
        pairs = np.stack([start, to - size + 1], 1).reshape(-1)
        cols = []
        for band in range(bands):
            key = np.full(len(start), band, np.uint64)
            for m in muls[band * rows : band * rows + rows]:
                h = np.append(mix(sh * m), np.iinfo(np.uint64).max)
                key = mix(key * np.uint64(0x2545F4914F6CDD1D) + np.minimum.reduceat(h, pairs)[::2])
            cols.append(key)
        yield a, w, w.doc[start], start, to, np.stack(cols, 1), _sequence_hashes(w, start, to), sh


def _cutter(bands: int, size: int, target: int, least: int, rows: int = ROWS):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, w, doc, start, to, keys, whole, _ in _pieces(batch.column(1), bands, size, target, least, rows):
                ids = batch.column(0).take(pa.array(a + doc))
                sig = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).reshape(-1)), bands).cast(pa.list_(pa.int64()))
                at, n = (start - w.bounds[doc]).astype(np.int32), (to - start).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids, pa.array(at), pa.array(n), pa.array(whole.view(np.int64)), sig], ["id", "at", "n", "e", "sig"])

    return cut


def paragraphs(docs: DataFrame, text: str = "text", key: str = "doc_id", *, size: int = SIZE, target: int = TARGET_WORDS, least: int = LEAST_WORDS, bands: int | None = None) -> DataFrame:
    """id, at (first word), n (words), e (64-bit hash of the words) and sig (band hashes) of every paragraph.

    A paragraph starts at a sentence or line and runs on over whole sentences until it has `target` words, so a
    passage that is pasted into other text shares paragraphs with its other copies whatever surrounds it. Every start
    that leaves enough words is used, and the last of them also runs to the text's end, so every word of a text of
    `least` words or more is in a paragraph. Where 50 words in a row have no paragraph of sentences inside, one between
    content-defined cuts is added, so that a passage of 50 words shares one with its copies whatever its stops.
    """
    bands = bands or tuned_bands(PERCENT / 100, RECALL)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).where(F.col("id").isNotNull())
    return rows.mapInArrow(_cutter(bands, size, target, least), f"id {kind}, at int, n int, e long, sig array<long>")


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def _blobs(buckets: int, most: int = 1 << 20):
    """put(d, key, mark, of) collects entries, rows() gives them as batches, a row a bucket: d and how often it comes in a row, keys and marks. Entries go to a bucket by `of`."""
    held = []

    def rows(least: int = 1) -> Iterator[pa.RecordBatch]:
        if sum(len(x[0]) for x in held) < least:
            return
        d, key, mark, of = (np.concatenate(x) for x in zip(*held))
        held.clear()
        b = (of % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
        order = np.argsort(b, kind="stable")
        b, d, key, mark = b[order], d[order], key[order], mark[order]
        at = _runs(b)
        cols = [[], [], [], []]
        for x, y in zip(at, np.append(at[1:], len(b))):
            run = _runs(d[x:y])
            for col, v in zip(cols, (d[x:y][run], np.diff(np.append(run, y - x)).astype(np.int32), key[x:y], mark[x:y])):
                col.append(v.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(b[at].astype(np.int32)), *[pa.array(x, pa.binary()) for x in cols]], ["b", "d", "c", "k", "m"])

    def put(d, key, mark, of) -> Iterator[pa.RecordBatch]:
        if len(d):
            held.append((d, key, mark, of))
        return rows(most)

    return put, rows


_BLOBS = "b int, d binary, c binary, k binary, m binary"


def _of_buckets(batches: Iterator[pa.RecordBatch], mark: type):
    """d, keys and marks of each bucket; the rows come by bucket."""
    now, held = None, []

    def whole():
        return [np.concatenate(x) for x in zip(*held)]

    for batch in batches:
        b, *cols = (c.to_pylist() for c in batch.columns)
        for at, d, c, k, m in zip(b, *cols):
            if at != now and held:
                yield whole()
                held = []
            now = at
            held.append((np.repeat(np.frombuffer(d, np.int64), np.frombuffer(c, np.int32)), np.frombuffer(k, np.uint64), np.frombuffer(m, mark)))
    if held:
        yield whole()


#: What an entry is: the key of a band, or the hash of a paragraph's words in its first text and in others. Marks of bands have the lowest bit set.
BAND, FIRST, AGAIN = 0, 1, 2


def _entries(buckets: int, bands: int, size: int):
    """Entries of texts (d, text): each band's key once a text, marked by the paragraphs that have it (twice, with different marks, if two of them lie apart), and each paragraph's hash, marked 0."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        put, rows = _blobs(buckets)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, _, doc, start, to, keys, whole, _ in _pieces(batch.column(1), bands, size, TARGET_WORDS, LEAST_WORDS):
                salt = mix(doc.astype(np.uint64) + np.uint64(1))
                own = np.unique(mix(whole + salt), return_index=True)[1]
                yield from put(ids[a + doc[own]], whole[own], np.zeros(len(own), np.uint32), mix(whole[own]))
                key, who = keys.reshape(-1), np.repeat(np.arange(len(doc)), keys.shape[1])
                code = mix(key + salt[who])
                order = np.argsort(code)
                at = _runs(code[order])
                who, key = who[order], key[order][at]
                mark = np.add.reduceat(mix(whole)[who], at).astype(np.uint32) | np.uint32(1)
                two = np.minimum.reduceat(to[who], at) <= np.maximum.reduceat(start[who], at)
                d = ids[a + doc[who[at]]]
                for use, add in ((slice(None), 0), (two, 2)):
                    yield from put(d[use], key[use], mark[use] + np.uint32(add), mix(key[use]))
        yield from rows()

    return entries


def _shared(buckets: int):
    """Entries by text (d, key and kind) whose key is worth a second look: a band's key of which two entries have different marks, a paragraph's hash in two texts."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        put, rows = _blobs(buckets)
        for d, key, mark in _of_buckets(batches, np.uint32):
            for band in (True, False):
                use = (mark != 0) == band
                order = np.argsort(key[use])
                k, m, t = key[use][order], mark[use][order], d[use][order]
                at = _runs(k)
                if not len(at):
                    continue
                x = m if band else t
                lo, hi = np.minimum.reduceat(x, at), np.maximum.reduceat(x, at)
                n = np.diff(np.append(at, len(k)))
                keep = np.repeat(lo != hi, n)
                kind = np.full(len(k), BAND, np.uint8) if band else np.where(t == np.repeat(lo, n), FIRST, AGAIN).astype(np.uint8)
                k, t, kind = k[keep], t[keep], kind[keep]
                order = np.argsort(t, kind="stable")
                yield from put(t[order], k[order], kind[order], mix(t[order].view(np.uint64)))
        yield from rows()

    return shared


def _by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """d, keys and kinds of each text's entries."""
    for d, key, kind in _of_buckets(batches, np.uint8):
        order = np.argsort(d, kind="stable")
        d, key, kind = d[order], key[order], kind[order]
        at = _runs(d)
        to = np.append(at[1:], len(d))
        yield pa.RecordBatch.from_arrays([pa.array(d[at]), *[pa.array([v[x:y].tobytes() for x, y in zip(at, to)], pa.binary()) for v in (key, kind)]], ["d", "k", "m"])


def _places(bands: int, size: int):
    """e, d, at, n of the paragraphs of texts (d, text, k, m) that have one of the text's entries; in the first text of a paragraph that has keys of bands among them also these and its set of shingles."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kept, kinds = batch.column(0).to_numpy(), batch.column(2), batch.column(3)
            for a, w, doc, start, to, keys, whole, sh in _pieces(batch.column(1), bands, size, TARGET_WORDS, LEAST_WORDS):
                salt = mix(doc.astype(np.uint64) + np.uint64(1))
                rows = np.unique(doc)
                k = [np.frombuffer(kept[a + int(r)].as_py(), np.uint64) for r in rows]
                kind = np.concatenate([np.frombuffer(kinds[a + int(r)].as_py(), np.uint8) for r in rows])
                code = mix(np.concatenate(k) + np.repeat(mix(rows.astype(np.uint64) + np.uint64(1)), [len(x) for x in k]))
                own = mix(whole + salt)
                again, other = np.isin(own, code[kind != BAND]), np.isin(own, code[kind == AGAIN])
                met = np.isin(mix(keys + salt[:, None]), code[kind == BAND])
                met[other] = False
                linked = met.any(1)
                use = np.flatnonzero(again | linked)
                if not len(use):
                    continue
                sets = [np.unique(sh[start[x] : to[x] - size + 1]).tobytes() if linked[x] else None for x in use]
                some = met[use]
                edge = np.cumsum(np.append(0, some.sum(1))).astype(np.int32)
                cols = [whole[use].view(np.int64), ids[a + doc[use]], (start - w.bounds[doc])[use].astype(np.int32), (to - start)[use].astype(np.int32)]
                found = pa.ListArray.from_arrays(pa.array(edge), pa.array(keys[use][some].view(np.int64)))
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), found, pa.array(sets, pa.binary())], ["e", "d", "at", "n", "h", "s"])

    return places


def _apart(x, y):
    """Places x and y (id, at, n) don't overlap in one text."""
    return (x["id"] != y["id"]) | (x["at"] + x["n"] <= y["at"]) | (y["at"] + y["n"] <= x["at"])


def _links(h, e, d, at, n, sets: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Paragraphs joined by pairs with a key h in common, apart, and with sets that are similar enough, and the smallest one that each is joined with.

    Each paragraph is compared with the one of its key that has the most frequent shingles. Of the others, similar ones share one
    of their rarest shingles (rarest under the key): all but `percent` of the larger size, and one more. All such pairs are compared unless both are
    linked with that first one.
    """
    size = np.array([len(x) >> 3 for x in sets])
    edge = np.append(0, np.cumsum(size))
    own = np.repeat(np.arange(len(h)), size)
    group = np.cumsum(np.append(True, h[1:] != h[:-1])) - 1
    token = mix(np.frombuffer(b"".join(sets), np.uint64) + mix(group.astype(np.uint64) + np.uint64(1))[own])
    _, code, many = np.unique(token, return_inverse=True, return_counts=True)
    often = many[code]

    def apart(x, y):
        return (e[x] != e[y]) & ((d[x] != d[y]) | (at[x] + n[x] <= at[y]) | (at[y] + n[y] <= at[x])) & (100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y]))

    def similar(x, y, both):
        return 100 * both >= percent * (size[x] + size[y] - both)

    first = _runs(group)
    weight = np.add.reduceat(often, edge[:-1]) / size
    head = np.lexsort((-weight, group))[first]
    mine = np.zeros(len(many), bool)
    mine[code[np.isin(own, head)]] = True
    x, y = np.arange(len(h)), head[group]
    star = apart(x, y) & similar(x, y, np.add.reduceat(mine[code], edge[:-1], dtype=np.int64))
    joined = star.copy()
    joined[head] = True
    a, b = [x[star]], [y[star]]
    # the rarest shingles of each paragraph, by shingle, those of paragraphs that are not joined first
    order = np.lexsort((code, often, own))
    prefix = np.arange(len(own)) - edge[own] < (size - (percent * size + 99) // 100 + 1)[own]
    rare = order[prefix & (often[order] > 1)]
    rare = rare[np.lexsort((joined[own[rare]], code[rare]))]
    who, c = own[rare], code[rare]
    run = _runs(c)
    stop = np.repeat(np.append(run[1:], len(c)), np.diff(np.append(run, len(c)))) if len(c) else run
    active = np.flatnonzero(~joined[who])
    # every pair of (paragraph, shingle) in order, for a search
    table = np.sort(own * np.int64(len(many)) + code)

    def confirm(pairs: list[np.ndarray]) -> None:
        pairs = np.unique(np.concatenate(pairs))
        for k in range(0, len(pairs), 1 << 16):
            x, y = np.divmod(pairs[k : k + (1 << 16)], len(h))
            to = np.cumsum(size[x])
            pos = np.arange(to[-1]) + np.repeat(edge[x] - to + size[x], size[x])
            want = np.repeat(y, size[x]) * np.int64(len(many)) + code[pos]
            hit = table[np.minimum(np.searchsorted(table, want), len(table) - 1)] == want
            ok = similar(x, y, np.add.reduceat(hit, to - size[x], dtype=np.int64))
            a.append(x[ok])
            b.append(y[ok])

    step, pairs, held = 1, [], 0
    while len(active := active[active + step < stop[active]]):
        x, y = who[active], who[active + step]
        x, y = np.minimum(x, y), np.maximum(x, y)
        ok = apart(x, y)
        pairs.append(x[ok] * np.int64(len(h)) + y[ok])
        held, step = held + len(pairs[-1]), step + 1
        if held > 1 << 22:
            confirm(pairs)
            pairs, held = [], 0
    if held:
        confirm(pairs)
    return _forest(e[np.concatenate(a)], e[np.concatenate(b)])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every id that a pair names, but the smallest of each component, and that smallest one."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    low = root != np.arange(len(ids))
    return ids[low], ids[root[low]]


#: Paragraphs that are worked on at once, and the most with one key that one task compares; neardup.link_sets sees to larger groups.
AT_ONCE, GROUP = 1 << 14, 1 << 16


def _linker(percent: int):
    """Links a, b of paragraphs (h, e, d, at, n, s) that come by h."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def made(t: pa.Table) -> Iterator[pa.RecordBatch]:
            h, e, d, at, n = (t.column(k).to_numpy() for k in range(5))
            # paragraphs of one key alone have no partner
            k = np.diff(np.append(_runs(h), len(h)))
            use = np.flatnonzero(np.repeat(k > 1, k))
            if len(use):
                x, y = _links(h[use], e[use], d[use], at[use].astype(np.int64), n[use].astype(np.int64), t.column(5).take(pa.array(use)).to_pylist(), percent)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

        for batch in batches:
            for k in range(0, batch.num_rows, AT_ONCE):
                t = pa.Table.from_batches([batch.slice(k, AT_ONCE)])
                t = pa.concat_tables([rest, t]) if rest is not None else t
                h = t.column(0).to_numpy()
                last = int(_runs(h)[-1])  # the last key may go on
                rest = t.slice(last).combine_chunks()
                if last:
                    yield from made(t.slice(0, last))
        if rest is not None:
            yield from made(rest)

    return links


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """e and its set as an array."""
    for batch in batches:
        sets = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
        edge = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate(sets or [np.zeros(0, np.int64)])))], ["id", "s"])


def _linked(places: DataFrame, percent: int, group: int) -> DataFrame:
    """id and component of the paragraphs (stored e, d, at, n, h, s) that are similar enough to another one with a key h in common."""
    first = places.where("s is not null")
    large = stored(first.select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("k")).where(F.col("k") > group), "paragraph-large")
    classes = first.groupBy("e").agg(F.min(F.struct("d", "at", "n", "h", "s")).alias("r")).select("e", "r.*")
    rows = classes.select(F.explode("h").alias("h"), "e", "d", "at", "n", "s")
    some = not large.isEmpty()
    light = rows.join(large.select("h"), "h", "left_anti") if some else rows
    light = light.repartition("h").sortWithinPartitions("h")
    links = stored(light.mapInArrow(_linker(percent), "a long, b long"), "paragraph-links")
    if some:
        member = rows.join(large, "h")
        sized = member.select(F.col("h").alias("key"), F.col("e").alias("id"), (F.length("s") / 8).cast("long").alias("n"), F.struct(F.col("d").alias("id"), "at", "n").alias("x"), "k")
        order = sized.groupBy("id").agg((-F.sum("k")).alias("o"))
        every = stored(sized.drop("k").join(order, "id").select("key", "id", "n", F.col("n").alias("n0"), "o", F.col("id").alias("c"), "x"), "paragraph-members")
        sets = stored(member.select("e", "s").dropDuplicates(["e"]).mapInArrow(_arrays, "id long, s array<long>"), "paragraph-sets")
        label = link_sets(every, sets, percent, _apart, rounds=2)
        was, links = links, stored(links.unionByName(label.select(F.col("id").alias("a"), F.col("c").alias("b")).where("a <> b")), "paragraph-links")
        dropped(was, sets, label)
    found = components(links)
    dropped(large, links)
    return found


def _numbered(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, DataFrame | None]:
    """d (a number in the order of the keys) and text of the rows with a key; id and d of each key where the number is not the key itself."""
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    if isinstance(docs.schema[key].dataType, T.IntegralType):
        return rows.select(F.col("id").cast("long").alias("d"), "text"), None
    # ids rise along the sorted partitions
    ids = stored(rows.select("id").distinct().orderBy("id").withColumn("d", F.monotonically_increasing_id()), "paragraph-ids")
    return stored(rows.join(ids, "id").select("d", "text"), "paragraph-texts"), ids


def repeated_paragraphs(docs: DataFrame, *, text: str = "text", key: str = "doc_id", size: int = SIZE, percent: int = PERCENT, group: int = GROUP) -> DataFrame:
    """key, start_word, n_words, cluster, removed: the stretches of each text that another document repeats.

    Equal paragraphs are one class. Classes that share a band are linked by the exact Jaccard similarity of
    their shingles, unless they are neighbours in one text that overlap: up to `group` of one band by their rarest shingles, larger
    bands by neardup.link_sets; no colliding pair goes unexamined unless it is joined or ruled out.
    Confirmed classes join by connected components, and clusters within a single document are left alone. The first
    occurrence (smallest key and position) of each cluster stays, with what overlaps it, all others are marked removed; overlapping
    paragraphs of a text with the same mark are given as one stretch, cluster being that of its first paragraph.

    Texts are cut twice: first only hashes are compared, a band's key once a text, then the paragraphs whose hash or
    band another text shares are written with their sets. A band that has the same paragraphs in all of its texts has no pair to compare,
    which is told by 31 bits of the sum of their hashes.

    Null keys, null and empty texts and texts of fewer than ten words have no paragraphs. Equal keys count as one
    text. An empty table gives no rows.
    """
    spark, bands = docs.sparkSession, tuned_bands(PERCENT / 100, RECALL)
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, ids = _numbered(docs, text, key)
    by_key = rows.mapInArrow(_entries(buckets, bands, size), _BLOBS).repartition("b").sortWithinPartitions("b")
    by_text = by_key.mapInArrow(_shared(buckets), _BLOBS).repartition("b").sortWithinPartitions("b")
    shared = stored(by_text.mapInArrow(_by_text, "d long, k binary, m binary"), "paragraph-shared")
    places = rows.join(shared, "d").select("d", "text", "k", "m")
    places = stored(places.mapInArrow(_places(bands, size), "e long, d long, at int, n int, h array<long>, s binary"), "paragraph-places")
    dropped(shared, rows)
    comp = _linked(places, percent, group).select(F.col("id").alias("e"), F.col("component").alias("cluster"))
    dup = places.select("e", "d", "at", "n").join(comp, "e", "left").withColumn("cluster", F.coalesce("cluster", "e"))
    keep = dup.groupBy("cluster").agg(F.min(F.struct("d", "at")).alias("keep"), F.max("d").alias("last")).where("last <> keep.d")
    keep = stored(keep.select("cluster", F.col("keep.d").alias("kid")), "paragraph-clusters")
    hits = dup.join(keep, "cluster").select(F.col("d").alias("id"), "at", "n", "cluster", "kid").repartition("id")
    # what overlaps the first occurrence in its own text is part of it
    same = Window.partitionBy("id", "cluster").orderBy("at", "n")
    hits = hits.withColumn("far", F.max(F.col("at") + F.col("n")).over(same.rowsBetween(Window.unboundedPreceding, -1)))
    hits = hits.withColumn("again", F.max(F.coalesce(F.col("far") <= F.col("at"), F.lit(False))).over(same.rowsBetween(Window.unboundedPreceding, 0)))
    hits = hits.select("id", "at", "n", "cluster", ((F.col("id") != F.col("kid")) | F.col("again")).alias("removed"))
    own = Window.partitionBy("id", "removed").orderBy("at", "n")
    hits = hits.withColumn("far", F.max(F.col("at") + F.col("n")).over(own.rowsBetween(Window.unboundedPreceding, -1)))
    hits = hits.withColumn("span", F.sum((F.coalesce("far", F.lit(-1)) < F.col("at")).cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    out = hits.groupBy("id", "removed", "span").agg(F.min("at").alias("start_word"), F.max(F.col("at") + F.col("n")).alias("end"), F.min(F.struct("at", "cluster"))["cluster"].alias("cluster"))
    out = out.withColumnRenamed("id", "d")
    out = out.withColumn("id", F.col("d").cast(docs.schema[key].dataType)) if ids is None else out.join(ids, "d")
    return out.select(F.col("id").alias(key), "start_word", (F.col("end") - F.col("start_word")).alias("n_words"), "cluster", "removed")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: all documents."""
    return repeated_paragraphs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
