"""Corpus operators against brute force, and on nulls, empty and repeated rows and clashing column names."""

import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisweave.llm import decontaminate, graph, langid, lm, mixing, neardup, quality, sharding, substring, tokenstore, toxicity, vector

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, n int, e int"


def low(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty texts, repeated rows, no words, and columns named as the operators' own."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "some words here"), (5, "one"), (5, "one"), (6, "a b c d e f g h i j k l"), (7, "a b c d e f g h i j k l"), (8, long), (9, "| # $ % é ß")]
    return spark.createDataFrame([(i, t, None if k % 2 else "en", None if k % 3 else "s", None, "x", k, k) for k, (i, t) in enumerate(rows)], SCHEMA)


def test_words_and_hashes():
    import pyarrow as pa

    texts = ["a b  a", None, "", "Éa\n\tB", "x" * 70_000 + " y"]
    got = [(a, w) for a, _, w in vector.words_of(pa.array(texts), lower=True)]
    assert len(got) == 1
    w = got[0][1]
    assert np.diff(w.bounds).tolist() == [3, 0, 0, 2, 2]
    assert w.hash[0] == w.hash[2] != w.hash[1] == w.hash[4]
    assert len(vector.shingles(w.hash[:3], 2)) == 2 and len(vector.shingles(w.hash[:1], 2)) == 1


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    named = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: top(x) for x in named}


def test_quality(spark, docs, texts, odd):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1")
    for r in quality.quality_rules(docs, labels).collect():
        t = texts[r["doc_id"]]
        w = WORD.findall(t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        many = Counter(grams)
        twice = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(5)}
        lines, seen, dup = t.split("\n"), set(), 0
        for x in lines:
            dup += bool(WORD.search(x)) and x in seen
            seen.add(x)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(twice))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(twice) > 20 * len(w)) and r["kept"] <= (not r["base_failed"])
    got = quality.quality_rules(odd, odd.limit(0)).collect()
    assert len(got) == odd.count() and all(r["llr"] == 0 for r in got) and not next(r for r in got if r["doc_id"] == 1)["kept"]
    assert quality.quality_rules(odd.limit(0), odd).isEmpty()


def test_quality_verdict(spark, docs, texts):
    """llr and kept by counting every hashed word and pair again, with a tie at the threshold."""
    import xxhash

    labels = spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1")
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    word = lambda w, seed=42: xxhash.xxh64(w.encode(), seed).intdigest()
    found = {k: WORD.findall(t or "") for k, t in texts.items()}
    grams = {k: [signed(word(x)) % 8192 for x in w] + [signed(word(b, word(a))) % 8192 for a, b in zip(w, w[1:])] for k, w in found.items()}
    target = {r["doc_id"] for r in labels.collect()}
    raw, good = Counter(x for g in grams.values() for x in g), Counter(x for k, g in grams.items() if k in target for x in g)
    ratio = lambda b: np.log((good[b] + 0.5) / (sum(good.values()) + 4096)) - np.log((raw[b] + 0.5) / (sum(raw.values()) + 4096))
    of = {b: ratio(b) for b in raw}
    want = {k: np.mean([of[b] for b in g]) if g else 0.0 for k, g in grams.items()}
    edge = sorted(want.values())[len(want) // 3]
    got = {r["doc_id"]: r for r in quality.quality_rules(docs, labels, threshold=float(edge) - 1e-9).collect()}
    assert all(abs(got[k]["llr"] - v) < 1e-7 for k, v in want.items())
    assert all(got[k]["kept"] == (not got[k]["base_failed"] and v >= edge - 1e-9) for k, v in want.items())


def test_ids_and_texts_that_repeat(spark):
    """Rows of one id and different texts are told apart, and null ids keep their matches."""
    d = spark.createDataFrame([(1, "a b c d x x x x"), (1, "y y y y e f g h"), (None, "a b c d e f g h"), (2, "q a b c d e f g h")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c d e f g h"), (8, "a b c d e f g h"), (7, "r s")], "item_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_hit"], r["n_items"], r["contaminated"]) for r in decontaminate.contamination(d, items).collect())
    assert got == [(0, 8, 2, True), (1, 0, 0, False), (1, 0, 0, False), (2, 8, 2, True)]
    twice = spark.createDataFrame([(5, "one two three four"), (5, "six seven eight nine"), (6, "one two three four"), (7, "six seven eight nine"), (8, "ten")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(twice, size=2).collect()) == [(5, 5), (5, 5), (6, 5), (7, 5), (8, 8)]


def test_left_over_loses_no_link(spark):
    """The exact search around a pivot against all pairs, on families of random edits."""
    r = random.Random(4)
    sets = {}
    for family in range(3):
        origin = r.sample(range(1000 * family, 1000 * family + 200), 60)
        for _ in range(40):
            s = set(origin) - set(r.sample(origin, r.randrange(14)))
            sets[len(sets)] = s | set(r.sample(range(5000 + 10 * family, 5000 + 10 * family + 40), r.randrange(12)))
    at = spark.createDataFrame([(i // 40, i, len(s), len(s), r.random(), i) for i, s in sets.items()], "key long, id long, n long, n0 long, o double, c long")
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, s array<long>")
    for rounds in (0, 2):
        got = {x["id"]: x["c"] for x in neardup.link_sets(neardup.stored(at, "t"), rows, 80, rounds=rounds).collect()}
        top = {i: i for i in sets}
        for i in sets:
            for j in sets:
                both = len(sets[i] & sets[j])
                if i // 40 == j // 40 and 100 * both >= 80 * len(sets[i] | sets[j]) and top[i] != top[j]:
                    lo, hi = sorted((top[i], top[j]))
                    top = {k: lo if v == hi else v for k, v in top.items()}
        assert got == top and 3 < len(set(top.values())) < len(sets)


def test_substring(spark, docs, odd):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    sentence = lambda n: " ".join([word().capitalize(), *[word() for _ in range(n - 1)]]) + "."
    passage = " ".join(sentence(13) for _ in range(5))
    rows = []
    for i in range(30):
        a, b = sentence(40)[:-1], sentence(30)
        rows.append((i, f"{a} {passage} {b}" if i % 3 == 0 else f"{a} {b} {sentence(50)}"))
    got = substring.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["doc_id"] for x in got} == {i for i in range(30) if i % 3 == 0}
    assert {x["doc_id"] for x in got if x["removed"]} == {i for i in range(3, 30, 3)}
    assert all(35 <= x["n_words"] and x["start_word"] >= 40 for x in got)
    assert {x["doc_id"] for x in substring.repeated_paragraphs(odd).collect()} == {6, 7}
    assert substring.repeated_paragraphs(odd.limit(0)).isEmpty()
    assert 1 - (1 - 0.8) ** substring.tuned_bands(0.8, 0.99) >= 0.99


def test_substring_reaches_the_ends(spark):
    """Copies that end in short sentences, and short texts of several sentences, are found whole."""
    r = random.Random(2)
    sentence = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n)) + "."
    shapes = [(25, 5), (25, 3, 4), (6, 7), (12, 12), (25, 5, 30), (9, 1), (30, 1, 1)]
    rows = [(2 * k + copy, text) for k, shape in enumerate(shapes) for text in [" ".join(map(sentence, shape))] for copy in (0, 1)]
    got = {(x["doc_id"], x["start_word"], x["n_words"], x["removed"]) for x in substring.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(2 * k + copy, 0, sum(shape), bool(copy)) for k, shape in enumerate(shapes) for copy in (0, 1)}


def test_substring_compares_all_of_a_band(spark):
    """Near copies are found although their bands' first class shares only a frequent phrase with them."""
    import pyarrow as pa

    r = random.Random(3)
    some = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    # a phrase of small hashes, so that the paragraphs with it share all bands
    phrases = [some(10) for _ in range(30_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(phrases))), pa.array(phrases)], ["id", "text"])
    found = next(substring._cutter(3, 5, 20, 10)(iter([batch])))
    sig = np.array(found.column("sig").to_pylist())
    phrase = phrases[found.column("id")[int(np.argmin((sig & 0xFFFFFFFF).max(axis=1)))].as_py()]
    rows = [(k, f"{phrase} {some(30)}.") for k in range(60)]
    for k in range(8):
        text = some(30)
        rows += [(100 + 2 * k, f"{phrase} {text} {some(1)}."), (101 + 2 * k, f"{phrase} {text} {some(1)}.")]
    got = {(x["doc_id"], x["removed"]) for x in substring.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(100 + k, bool(k % 2)) for k in range(16)}


def test_substring_without_stops(spark):
    """Every pasted passage of 50 words is found, whatever stops it and the texts around it have."""
    r = random.Random(4)
    some = lambda n, stop=0: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) + "." * (r.random() < stop) for _ in range(n))
    rows = []
    for k, inner in enumerate([0, 0, 0, 0.02, 0.02, 0.04, 0.04, 0.04, 0.08, 0.08] * 4):
        passage = some(50, inner)
        rows += [(2 * k + copy, f"{some(r.randrange(60), around)} {passage} {some(r.randrange(60), around)}") for copy, around in enumerate(r.choices([0, 0.05, 0.2], k=2))]
    got = substring.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(x["doc_id"], x["removed"]) for x in got} == {(k, bool(k % 2)) for k in range(len(rows))}


def test_substring_writes_what_is_shared(spark, monkeypatch):
    """Intermediate tables and shuffles are in proportion to what texts share, not to all of their paragraphs."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    text = lambda n: " ".join(word() + "." * (r.random() < 0.2) for _ in range(n))
    rows = [(k, text(600)) for k in range(300)]
    rows += [(300 + k, f"{text(300)} {rows[k][1]}") for k in range(3)]
    wrote = []

    def stored(df, tag, *a):
        out = keep(df, tag, *a)
        wrote.append(sum(p.stat().st_size for p in Path(out._stored_at.removeprefix("file:")).rglob("*.parquet")))
        return out

    keep = substring.stored
    monkeypatch.setattr(substring, "stored", stored)
    got = substring.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert {(x["doc_id"], x["removed"]) for x in got} == {(k, False) for k in range(3)} | {(300 + k, True) for k in range(3)}
    assert sum(wrote) < 0.1 * sum(len(x) for _, x in rows)


def test_substring_links():
    """What pairs that are similar and apart join, against all pairs: groups of near copies, with and without a phrase in common."""
    rng = np.random.default_rng(6)
    for phrase in (0, 14):
        common = rng.integers(0, 1 << 62, phrase)
        sets, h = [], []
        for g in range(6):
            for _ in range(5):
                origin = rng.integers(0, 1 << 62, 20)
                for _ in range(6):
                    sets.append(np.unique(np.concatenate([common, rng.choice(origin, 20 - rng.integers(0, 5), replace=False), rng.integers(0, 1 << 62, rng.integers(0, 4))])))
                    h.append(g)
        n, h = len(sets), np.array(h)
        e, d, at = rng.permutation(n).astype(np.int64), rng.integers(0, 8, n), rng.integers(0, 60, n)
        a, b = substring._links(h, e, d, at, np.full(n, 20), [x.tobytes() for x in sets], 80)
        joined = lambda pairs: {frozenset(int(y) for y in e if root(pairs, int(y)) == x) for x in {root(pairs, int(y)) for y in e}}

        def root(up, x):
            while x in up:
                x = up[x]
            return x

        want, near = {}, 0
        for i in range(n):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if h[i] == h[j] and (d[i] != d[j] or abs(at[i] - at[j]) >= 20) and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    near += 1
                    x, y = sorted((root(want, int(e[i])), root(want, int(e[j]))))
                    want |= {y: x} if x != y else {}
        assert near > 50 and joined(dict(zip(a.tolist(), b.tolist()))) == joined(want)


def test_substring_large_bands(spark, docs):
    """Bands that are too large for one task, and keys that are no numbers, give the same."""
    want = {tuple(x) for x in substring.repeated_paragraphs(docs).collect()}
    assert want and {tuple(x) for x in substring.repeated_paragraphs(docs, group=2).collect()} == want
    named = docs.select(F.format_string("k%012d", "doc_id").alias("doc_id"), "text")
    assert {(int(x[0][1:]), *x[1:]) for x in substring.repeated_paragraphs(named).collect()} == want


def test_lm(docs, texts, odd):
    got = {r["doc_id"]: r for r in lm.lm_scores(docs, known=2000).collect()}
    tokens = {k: [*WORD.findall(low(t)), None] for k, t in texts.items()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in texts}
    c = Counter(x for k, v in tokens.items() if not held[k] for x in v)
    n, v = sum(c.values()), len(c)
    for k, x in tokens.items():
        base = sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x)
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(x), sum(c[w] > 0 for w in x), n)
        assert abs(r["base_score"] - base) < 1e-6 * abs(base)
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    some = lm.lm_scores(odd).collect()
    assert len(some) == odd.count() and next(r for r in some if r["doc_id"] == 1)["n_tokens"] == 1
    assert lm.lm_scores(odd.limit(0)).isEmpty()


def test_lm_does_not_depend_on_the_split(docs):
    got = [{r["doc_id"]: r["score"] for r in lm.lm_scores(docs.repartition(n)).collect()} for n in (2, 7)]
    assert got[0].keys() == got[1].keys() and all(abs(got[1][k] - v) < 1e-5 * abs(v) for k, v in got[0].items())


def test_lm_scan():
    """States of stretches side by side are those of one step after another."""
    rng = np.random.default_rng(1)
    hold, add = rng.random((1000, lm.UNITS), np.float32), rng.random((1000, lm.UNITS), np.float32)
    h = want = rng.random(lm.UNITS, np.float32)
    got = lm._scan(hold, add, h)
    for t in range(1000):
        want = hold[t] * want + add[t]
        assert np.allclose(got[t], want, rtol=1e-4)


def test_lm_gradient():
    """The backward pass against differences of the forward pass, and probabilities that sum to one."""
    rng = np.random.default_rng(0)
    lex = lm.Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), 10, 5, np.ones(lm.TAILS), np.ones(lm.TAILS), rng.integers(0, 5, lm.HEAD_WORDS).astype(float))
    p = {k: v.astype(np.float64) for k, v in lm.initial(lex).items()}
    x, y = rng.integers(0, lm.INPUTS, (6, 3)), rng.integers(0, lm.INPUTS, (6, 3))
    fresh = np.zeros((6, 3), np.float32)
    fresh[[0, 3], [0, 1]] = 1
    h = np.zeros((3, lm.UNITS), np.float32)
    loss = lambda q: -lm.Network(q).window(x, y, fresh, h, False)[0].sum() / 18
    net = lm.Network({k: v.copy() for k, v in p.items()}, rate=1.0)
    net.seen = {k: np.full_like(v, 1e12) for k, v in p.items()}
    net.window(x, y, fresh, h, True)
    for name in lm.NAMES:
        step = (p[name] - net.p[name]) * 1e6  # the gradient, as the scale is fixed
        i = np.unravel_index(np.argmax(np.abs(step)), step.shape)
        up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        up[name][i] += 1e-3
        down[name][i] -= 1e-3
        assert abs((loss(up) - loss(down)) / 2e-3 - step[i]) < 0.02 * abs(step[i]) + 1e-4
    every = [lm.Network(p).window(np.full((1, 1), 3), np.full((1, 1), k), np.ones((1, 1), np.float32), h[:1], False)[0][0, 0] for k in range(lm.INPUTS)]
    assert abs(np.exp(every).sum() - 1) < 1e-4


def brute_contamination(texts, items, size=8):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    win = {}
    for k, t in items.items():
        w = cut(t)
        for i in range(max(1, len(w) - size + 1)) if w else ():
            win.setdefault(tuple(w[i : i + size]), set()).add(k)
    out = {}
    for d, t in texts.items():
        w, hit, seen = cut(t), set(), set()
        for n in {len(x) for x in win}:
            for i in range(len(w) - n + 1):
                if found := win.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    seen |= found
        names = ",".join(sorted(map(str, seen)))
        out[d] = (len(w), len(hit), len(seen), hashlib.sha256(names.encode()).hexdigest(), len(seen) >= 2)
    return out


def test_decontaminate(spark, docs, texts, odd):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    more = spark.createDataFrame([(900, "The of"), (901, "the"), (902, ""), (903, None), (904, "a b c d e f g h i"), (905, "c d e f g h i j k a a")], "item_id long, text string")
    bench = bench.unionByName(more)
    items = {r[0]: r[1] for r in bench.collect()}
    cols = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = {r["doc_id"]: tuple(r[c] for c in cols) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == brute_contamination(texts, items)
    some = decontaminate.contamination(odd, bench).collect()
    want = brute_contamination({r[0]: r[1] for r in odd.where("doc_id is not null").select("doc_id", "text").collect()}, items)
    assert len(some) == odd.count() and {r["doc_id"]: tuple(r[c] for c in cols) for r in some if r["doc_id"] is not None} == want
    assert decontaminate.contamination(odd, bench.limit(0)).where("n_items > 0").isEmpty()
    assert decontaminate.contamination(odd.limit(0), bench).isEmpty()


def test_proximity(spark):
    d = spark.createDataFrame([(1, "x a q b y c"), (2, "a z z z z z z z b c"), (3, "c b a")], "doc_id long, text string")
    terms = decontaminate.test_terms(spark.createDataFrame([(7, "a b c")], "item_id long, text string"))
    index = decontaminate.postings(d, terms)
    assert {r["doc"] for r in decontaminate.proximity_matches(index, terms, 4).collect()} == {1, 3}


def test_mixing(docs, odd):
    got = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    size = Counter()
    for r in got:
        size[r["source"]] += r["size"]
    names, total = sorted(size), sum(size.values())
    weight, target, free = {s: i % 3 + 1 for i, s in enumerate(names)}, {}, set(names)
    while free:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        target |= {s: 3 * size[s] for s in over} if over else share
        free = free - over if over else set()
    taken = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == size[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * total
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) < 0.02 * total for s in names)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(3)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(odd.limit(0)).isEmpty()
    assert mixing.mix(odd).where("doc_id = 1").first()["taken"] == 0


def test_small_sources_reach_their_targets(spark):
    """Every source takes its own target, a capped source of a few words among large ones too, in many shards."""
    size = {"a": 7, "b": 160, "c": 500, "d": 1, "e": 60_000, "f": 40_000, "g": 90_000}
    rows, k = [], 0
    for name, n in size.items():
        while n:
            part = min(n, 40 if n < 1000 else 700)
            rows.append((k, " ".join(["w"] * part), name))
            k, n = k + 1, n - part
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for shards in (None, 75):
        got = mixing.mix(docs, shards=shards).join(docs.select("doc_id", "source"), "doc_id").collect()
        taken, target = Counter(), {r["source"]: r["target"] for r in got}
        for r in got:
            assert 0 <= r["taken"] <= 3 * r["size"]
            taken[r["source"]] += r["taken"]
        assert target["b"] == 480 and target["d"] == 3
        assert all(abs(taken[s] - target[s]) <= 1 for s in size), (taken, target)


def test_sainte_lague(spark):
    t = spark.createDataFrame([("a", 5300, 5300.0), ("b", 2400, 2400.0), ("c", 2300, 2300.0), ("d", 9, 9.0)], "source string, source_size long, target double")
    got = {r["source"]: r["seats"] for r in mixing.quotas(t, 1, 100).collect()}
    votes, seats = {"a": 5300.0, "b": 2400.0, "c": 2300.0, "d": 9.0}, Counter()
    for _ in range(100):
        seats[max(votes, key=lambda s: votes[s] / (2 * seats[s] + 1))] += 1
    assert got == {s: seats[s] for s in votes}


def test_toxicity(spark, odd):
    big = "/root/testdata/sf0.01"
    d, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(d, labels).join(labels, "doc_id").where("held_out")
    n = {tuple(r)[:2]: r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[(0, 0)] > 0 and n.get((0, 1), 0) == 0 and n[(1, 1)] >= 0.45 * (n[(1, 1)] + n.get((1, 0), 0))
    some = toxicity.toxicity(odd, labels).collect()
    assert len(some) == odd.count() and all(0 <= r["score"] <= 1 for r in some)
    assert toxicity.toxicity(odd.limit(0), labels.limit(0)).isEmpty()


def test_interactions_beat_weights():
    """One of two terms, but not both: additive weights can't tell this."""
    r = np.random.default_rng(3)
    x = (r.random((1500, 2)) < 0.35).astype(int)
    rows = [np.array([30] + [10] * a + [20] * b) for a, b in x]
    rows = [np.sort(v) for v in rows]
    y = (x[:, 0] ^ x[:, 1]).astype(float)
    m = toxicity.fit(rows, y, epochs=40)
    at = np.concatenate([[0], np.cumsum([len(v) for v in rows])])
    p = 1 / (1 + np.exp(-m.raw(np.concatenate(rows), at)))
    assert p[y == 1].min() > 0.8 and p[y == 0].max() < 0.3


def test_interactions_without_marginal_signal():
    """Terms that alone tell nothing of the label are kept for what their pair tells."""
    r = np.random.default_rng(5)
    x, noise = (r.random((4000, 2)) < 0.5).astype(int), r.integers(100, 200, (4000, 5))
    rows = [np.unique([30, *n] + [10] * a + [20] * b) for (a, b), n in zip(x, noise)]
    y = (x[:, 0] ^ x[:, 1]).astype(float)
    m = toxicity.fit(rows, y)
    at = np.concatenate([[0], np.cumsum([len(v) for v in rows])])
    p = 1 / (1 + np.exp(-m.raw(np.concatenate(rows), at)))
    assert p[y == 1].mean() > 0.8 and p[y == 0].mean() < 0.2


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, texts, size):
    sets = {}
    for k, t in texts.items():
        w = WORD.findall(low(t))
        sets[k] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    ids, parent = sorted(sets), {k: k for k in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs, size=size).collect()}
    assert got == {k: (len(sets[k]), top(k), top(k) == k) for k in ids}


def test_near_duplicates_odd(odd):
    got = neardup.near_duplicates(odd, size=2).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[7]["component_id"] == 6 and not by[7]["kept"] and by[1]["component_id"] == 1 and by[None]["component_id"] is None and by[None]["kept"]
    assert neardup.near_duplicates(odd.limit(0)).isEmpty()


def test_token_store(spark, docs, texts, odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenstore.default_tokenizer())
    tok.encode_special_tokens = True
    tricky = spark.createDataFrame([(1_000, "it's  I'll\n\n  x y 日本語 12½ <|endoftext|>\t\t"), (1_001, None), (1_002, "é" * 3000)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(tricky)
    store = tokenstore.write_store(both)
    got = sorted(tuple(r) for r in tokenstore.read_store(store).collect())
    at = 0
    for (k, t), r in zip(sorted((texts | {x[0]: x[1] for x in tricky.collect()}).items()), got, strict=True):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert r == (k, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    names = store.select(F.explode(F.arrays_zip(F.col("recipe").alias("d"), F.col("payloads").alias("p"))).alias("x")).where("x.p is not null").select("x.d")
    assert names.count() == names.distinct().count()
    # written in ascending order, and any change shows
    mixed = tokenstore.write_store(both.repartition(3))
    order = [r["id"] for r in mixed.orderBy("part", "at").select("id").collect()]
    assert order == sorted(order) and sorted(tuple(r) for r in tokenstore.read_store(mixed, tokenstore.manifest(mixed)).collect()) == got
    tree = tokenstore.manifest(mixed)
    assert len(tokenstore.manifest_root(tree)) == 16
    with pytest.raises(ValueError):
        tokenstore.read_store(mixed.where("id <> 1002"), tree)
    some = tokenstore.read_store(tokenstore.write_store(odd)).collect()
    assert len(some) == odd.count() and {r["n_tokens"] for r in some if r["id"] in (1, 2)} == {1}
    assert tokenstore.read_store(tokenstore.write_store(odd.limit(0))).isEmpty()


def test_token_store_query_keeps_the_tokenizers_default(spark, tmp_path):
    """Ids of texts that contain special tokens are those of the library without any switch."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenstore.default_tokenizer())
    names = [t.content for t in tok.get_added_tokens_decoder().values()]
    rows = [(0, "x <|endoftext|> y"), (1, "plain text"), *((2 + k, f"it's{x}{x} {x}\n日本 {x}") for k, x in enumerate(names)), (900, "x <|ENDOFTEXT|> y"), (901, "<|endoftext")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got, at = sorted(tuple(r) for r in tokenstore.query(spark, str(tmp_path)).collect()), 0
    for (k, t), r in zip(rows, got, strict=True):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert r == (k, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_pieces_of_many_texts_at_once():
    """Texts cut together have the pieces of the library's regular expression, and the ids of the library text by text."""
    r = random.Random(15)
    some = [*"abstmdrevl'  \n\t\r09.,-é²×ɏªß¼", " '", "'re", "'ll", "'s", "\n've"]
    enc, piece = tokenstore.Encoder(tokenstore.default_tokenizer(), False), re.compile(tokenstore.PIECE)
    for _ in range(300):
        texts = ["".join(r.choice(some) for _ in range(r.randrange(14))) for _ in range(r.randrange(12))]
        data = "".join(texts).encode()
        at = tokenstore.piece_starts(np.frombuffer(data, np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])).tolist()
        assert [data[a:b].decode() for a, b in zip(at, [*at[1:], len(data)])] == [p for t in texts for p in piece.findall(t)]
        texts += [r.choice(["日本 語", "<|endoftext|> a", "\u00a0x", ""]) for _ in range(r.randrange(3))]
        r.shuffle(texts)
        assert [np.frombuffer(x, "<u2").tolist() for x in enc.encode(texts)] == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_chunks_follow_content():
    ids = np.random.default_rng(2).integers(0, 50_000, 20_000)
    a, b = tokenstore.cuts(ids), tokenstore.cuts(ids[777:])
    assert a[-1] == 20_000 and max(np.diff([0, *a])) <= tokenstore.MOST
    assert len({x - 777 for x in a} & set(b)) > 0.5 * len(b)


def test_chunks_of_many_texts_at_once():
    """Each text's chunks end where the hash of its own last ids, taken one by one, says."""
    r = np.random.default_rng(3)
    texts = [r.integers(0, v, n).astype("<u2") for v in (3, 50_000) for n in (1, 2, 15, 16, 17, 127, 128, 129, 2047, 2048, 2049, 9000)]
    want = []
    for ids in texts:
        out, last = [], 0
        for m in range(1, len(ids) + 1):
            h = 0
            for x in ids[max(0, m - tokenstore.SEEN) : m].tolist():
                h = (h * int(tokenstore._BASE) + (x + 1) * 0xBF58476D1CE4E5B9) % (1 << 64)
            marked = (h >> 40) % tokenstore.MEAN == 0 and m - last >= tokenstore.LEAST
            if marked or m - last == tokenstore.MOST or m == len(ids):
                out.append(last := m)
        want.append(out)
    assert tokenstore.all_cuts(np.concatenate(texts), np.cumsum([0, *map(len, texts)]).tolist()) == want
    assert [tokenstore.cuts(x) for x in texts] == want


def test_sharding(docs, odd):
    n, shards = docs.count(), 7
    rows = sharding.shard(docs, shards=shards).collect()
    count = Counter(r["shard"] for r in rows)
    assert len(rows) == n and set(count) <= set(range(shards)) and max(count.values()) - min(count.values()) <= 1
    for s, k in count.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(k))
    some = sharding.shard(odd, shards=3).collect()
    assert sorted(Counter(r["shard"] for r in some).values()) == [3, 3, 4]
    assert {r["size"] for r in some if r["doc_id"] in (1, 2)} == {16}
    assert sharding.shard(odd.limit(0)).isEmpty()


def test_sharding_cuts_fewer_links_than_a_hash_deal(spark):
    """Labels move on the real tables, and linked documents end together far more often than if they were dealt by hash."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    base = docs.select("doc_id", F.xxhash64("text").alias("g1"), F.xxhash64(F.lit(1), "text").alias("g2"), sharding.sentence_hashes(F.col("text")).alias("sentences"))
    _, blocks, links = sharding.document_links(base, docs.count(), 40)
    at = sharding.shard(docs).select("doc_id", F.col("shard").alias("label"))
    node = blocks.where("block = 0").join(base.select("doc_id", "g1", "g2"), ["g1", "g2"]).select("id", "doc_id")
    placed = node.join(at, "doc_id").groupBy("id").agg(F.min("label").alias("label"))
    dealt = placed.select("id", F.pmod(F.xxhash64("id"), F.lit(40)).alias("label"))
    kept, hashed = (sharding.cut_links(links, x).first() for x in (placed, dealt))
    assert kept["all"] == hashed["all"] > 50 and kept["cut"] < 0.25 * hashed["cut"]


def test_sharding_links_texts_by_any_common_sentence(spark):
    """Long texts that have but one sentence in common, wherever its hash ranks among theirs, share a hub, and no others do."""
    r = random.Random(11)
    sentence = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(6)) + ". "
    texts = []
    for k in range(20):
        common = sentence()
        for _ in range(2):
            own = [sentence() for _ in range(39)]
            own.insert(r.randrange(40), common)
            texts.append((len(texts), "".join(own)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    base = docs.select("doc_id", F.xxhash64("text").alias("g1"), F.xxhash64(F.lit(1), "text").alias("g2"), sharding.sentence_hashes(F.col("text")).alias("sentences"))
    _, blocks, links = sharding.document_links(base, 40 * len(texts), 40)
    named = blocks.join(base.select("doc_id", "g1", "g2"), ["g1", "g2"]).join(links, "id").groupBy("hub").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    assert sorted(r["ids"] for r in named.collect()) == [[k, k + 1] for k in range(0, 40, 2)]


def test_sharding_links_texts_by_passages_of_short_sentences(spark):
    """Passages against brute force: white space around sentences does not count, and short sentences in a row are linked as long ones are."""
    r = random.Random(13)
    words = ["ab", "cde", "f", "ghijk lmn", "opq rst uvw xyz abcdefgh ij"]
    texts = ["".join(r.choice(words) + r.choice([". ", "!", ".\r\n", "\n\t", "? "]) for _ in range(r.randrange(9))) for _ in range(300)] + [None, "", " .\n", "No.", "no!"]

    def runs(text):
        parts = [p for x in re.split(r"[.!?\n]+", low(text)) if (p := x.strip(" \t\r\x0b\x0c"))]
        every = [" ".join(parts[i:j]) for i in range(len(parts)) for j in range(i + 1, len(parts) + 1)]
        return {x for x in every if len(x) >= 24}, " ".join(parts)

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: set(x["s"]) for x in docs.select("doc_id", sharding.sentence_hashes(F.col("text")).alias("s")).collect()}
    want = {k: runs(t) for k, t in enumerate(texts)}
    for a in want:
        for b in range(a):
            (x, p), (y, q) = want[a], want[b]
            assert bool(got[a] & got[b]) == bool(x & y or p == q != ""), (texts[a], texts[b])


def test_sharding_links_pairs_of_small_tables(spark):
    """What a shard can hold is not split: pairs with a sentence in common share a hub where a shard holds two rows."""
    docs = spark.createDataFrame([(k, f"the sentence number {k // 2} that two texts have. {k}") for k in range(60)], "doc_id long, text string")
    base = docs.select("doc_id", F.xxhash64("text").alias("g1"), F.xxhash64(F.lit(1), "text").alias("g2"), sharding.sentence_hashes(F.col("text")).alias("sentences"))
    _, _, links = sharding.document_links(base, 60, 30)
    assert sorted(r["count"] for r in links.groupBy("hub").count().collect()) == [2] * 30


def test_propagation_by_hand(spark):
    """Two cliques of four meet under a quota that holds one each; a brute-force count of cut links agrees."""
    ids = list(range(8))
    nodes = spark.createDataFrame([(i, 1) for i in ids], "id long, weight long")
    links = spark.createDataFrame([(i, i // 4) for i in ids], "id long, hub long")
    load = spark.createDataFrame([(k, 40) for k in range(2)], "label int, weight long")
    got = {r["id"]: r["label"] for r in sharding.propagate(nodes, links, 2, 4, load).collect()}
    cut = sum(4 - max(Counter(got[i] for i in ids if i // 4 == h).values()) for h in (0, 1))
    placed = spark.createDataFrame(list(got.items()), "id long, label int")
    assert tuple(sharding.cut_links(links, placed).first()) == (6, cut) and cut == 0
    assert tuple(sharding.cut_links(links.limit(0), placed).first()) == (0, 0)


def test_sharding_keeps_copies(spark):
    rows = [(i, f"group {i % 40}") for i in range(800)] + [(1000 + i, "hot") for i in range(400)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=6).collect()
    where = {}
    for r in got:
        if r["doc_id"] < 1000:
            where.setdefault(r["doc_id"] % 40, set()).add(r["shard"])
    assert sum(len(v) > 1 for v in where.values()) <= 6 and max(Counter(r["shard"] for r in got).values()) == 200


def test_language(spark, docs, odd):
    got = langid.documents_language(docs, spark.read.parquet(f"{DATA}/pages.parquet")).collect()
    assert len(got) == docs.count()
    assert sum(r["language"] == r["declared"] for r in got) >= 0.97 * len(got) and sum(r["kept"] for r in got) >= 0.97 * len(got)
    some = {r["doc_id"]: r for r in langid.documents_language(odd).collect()}
    assert not some[1]["kept"] and not some[2]["kept"] and some[6]["language"] == "en"
    assert langid.documents_language(odd.limit(0)).isEmpty()
    assert not any(r["kept"] for r in langid.documents_language(odd.withColumn("lang", F.lit(None).cast("string"))).collect())


def test_language_of_rows_that_declare_nothing(spark):
    """Rows that nothing is learnt from, as they declare no language and have no page: the text and the host decide."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    hidden = docs.withColumn("lang", F.when(~out, F.col("lang")))
    got = langid.documents_language(hidden).join(docs.where(out).where("length(text) >= 40").select("doc_id", "lang"), "doc_id")
    right, n = got.where("language = lang and kept").count(), got.count()
    assert n > 100 and right >= 0.97 * n


def test_text_outweighs_wrong_declaration(spark, docs):
    wrong = docs.where("lang = 'fr'").limit(1).select((F.col("doc_id") + 10**6).alias("doc_id"), "text", F.lit("de").alias("lang"), F.lit(None).cast("string").alias("source"), "n_chars")
    got = langid.documents_language(docs.unionByName(wrong)).where("doc_id >= 1000000").first()
    assert got["language"] == "fr" and got["text_language"] == "fr"


def test_rare_and_unknown_languages(spark):
    """A language of 0.1% of the rows is identified; texts in none of the languages are rejected whatever they declare."""
    r = random.Random(5)
    lexicon = {x: ["".join(r.choice(letters) for _ in range(r.randrange(2, 8))) for _ in range(60)] for x, letters in (("en", "etaoinshrd"), ("de", "enirstadhul"), ("fi", "aitneslokuäy"))}
    text = lambda x, n: " ".join(r.choice(lexicon[x]) for _ in range(n))
    rows = [(k, text(x, 40), x) for k, x in enumerate(["fi"] * 6 + ["en"] * 4000 + ["de"] * 1994)]
    rows += [(10_000 + k, "".join(r.choice("bcdfghjklmpqvwxyz    ") for _ in range(100)), r.choice(["en", "de", None])) for k in range(40)]
    rows += [(20_000, "Съешь же ещё этих мягких французских булок, да выпей чаю", "de"), (20_001, text("fi", 40), None), (20_002, text("fi", 40), "en")]
    docs = spark.createDataFrame([(k, t, x, "s") for k, t, x in rows], "doc_id long, text string, lang string, source string")
    got = {x["doc_id"]: (x["language"], x["kept"]) for x in langid.documents_language(docs).collect()}
    assert all(got[k] == (x, True) for k, _, x in rows[:6000])
    assert got[20_001] == got[20_002] == ("fi", True)
    assert not any(kept for k, (_, kept) in got.items() if 10_000 <= k <= 20_000)
