"""LM scoring by a gated recurrent network with a class-factored softmax, trained by truncated backpropagation in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisweave.llm.text import stored
from axisweave.llm.vector import mix, words_of

#: Head classes of `MEMBERS` frequent words each; classes of all other words, by their ending; units; words of a window; streams side by side.
HEADS, MEMBERS, TAILS, UNITS, STEPS, STREAMS = 16, 64, 48, 16, 32, 256
#: Words whose counts are broadcast, at most; rarer words' counts are joined.
KNOWN_WORDS = 1 << 16
#: Tokens that the warm start and a training group have about, tokens of a pool that is laid into streams, and of a block that is scored at once.
WARM_TOKENS, GROUP_TOKENS, POOL_TOKENS, BLOCK = 1 << 19, 1 << 21, 1 << 18, 1 << 15
HEAD_WORDS = HEADS * MEMBERS
CLASSES, INPUTS = HEADS + TAILS, HEAD_WORDS + TAILS
#: The end of a text is a token of its own.
END_HASH = np.uint64(0x0E4D0F7E870DED01)


def _tokens(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Row range, token hashes with the end of each text, tail class of each token, and n + 1 token offsets of the rows."""
    for a, b, w in words_of(col, lower=True):
        last = w.data[w.ends - 1].astype(np.uint64)
        second = w.data[np.maximum(w.ends - 2, w.starts)].astype(np.uint64)
        shape = (mix(last * np.uint64(256) + second) % np.uint64(TAILS)).astype(np.int32)
        n = np.diff(w.bounds)
        at = w.bounds + np.arange(len(w.bounds))
        hashes, shapes = np.full(at[-1], END_HASH), np.zeros(at[-1], np.int32)
        to = np.arange(len(w.hash)) + np.repeat(np.arange(len(n)), n)
        hashes[to], shapes[to] = w.hash, shape
        yield a, b, hashes, shapes, at


def word_counts(df: DataFrame) -> DataFrame:
    """h, c, shape of every distinct token of all texts (column text): summed within tasks, then by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> pa.RecordBatch:
            h, c, s = (np.concatenate(x) for x in zip(*held))
            u, first, inv = np.unique(h, return_index=True, return_inverse=True)
            total = np.bincount(inv, c).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(total), pa.array(s[first])], ["h", "c", "shape"])

        for batch in batches:
            for _, _, h, s, _ in _tokens(batch.column(0)):
                u, first, c = np.unique(h, return_index=True, return_counts=True)
                held.append((u, c, s[first]))
                size += len(u)
                if size > 3_000_000:
                    yield merged()
                    held, size = [], 0
        if held:
            yield merged()

    return df.select("text").mapInArrow(count, "h long, c long, shape int").groupBy("h").agg(F.sum("c").alias("c"), F.min("shape").alias("shape"))


@dataclass
class Lexicon:
    """Known words sorted by hash with counts and head numbers (-1: none), counts of all tokens and words, and per tail class the tokens and words outside the head."""

    h: np.ndarray
    c: np.ndarray
    head: np.ndarray
    tokens: int
    words: int
    tail_n: np.ndarray
    tail_v: np.ndarray
    head_c: np.ndarray

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash among the known words, -1 for others."""
        if not len(self.h):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.h, hashes), len(self.h) - 1)
        return np.where(self.h[at] == hashes, at, -1)

    def heads(self) -> Lexicon:
        """The part that training needs: words with a head number."""
        own = self.head >= 0
        return Lexicon(self.h[own], self.c[own], self.head[own], self.tokens, self.words, self.tail_n, self.tail_v, self.head_c)


def lexicon(counts: DataFrame, known: int = KNOWN_WORDS) -> Lexicon:
    """Totals over all words and the most frequent ones; at most `known` rows come to the driver."""
    got = counts.orderBy(F.desc("c"), "h").limit(known).toArrow()
    top = {x: got.column(x).to_numpy() for x in ("h", "c", "shape")}
    head = {x: v[:HEAD_WORDS] for x, v in top.items()}
    by = counts.groupBy("shape").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    n, v = np.zeros(TAILS), np.zeros(TAILS)
    for r in by:
        n[r["shape"]], v[r["shape"]] = r["c"], r["v"]
    tokens, words = int(n.sum()), int(v.sum())
    np.subtract.at(n, head["shape"], head["c"])
    np.subtract.at(v, head["shape"], 1)
    number = np.full(len(top["h"]), -1, np.int32)
    number[:HEAD_WORDS] = np.arange(len(head["h"]))
    h = top["h"].astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    head_c = np.zeros(HEAD_WORDS)
    head_c[: len(head["c"])] = head["c"]
    return Lexicon(h[order], top["c"].astype(np.int64)[order], number[order], tokens, words, n, v, head_c)


NAMES = ("gate", "cell", "out", "bias", "word", "word_bias")


def initial(lex: Lexicon, seed: int = 5) -> dict[str, np.ndarray]:
    """Small random inputs and outputs, and biases that make the untrained model the class-wise unigram model."""
    rng = np.random.default_rng(seed)
    heads = lex.head_c.reshape(HEADS, MEMBERS) + 0.5
    sizes = np.concatenate([heads.sum(1), lex.tail_n + 0.5 * (lex.tail_v + 1)])
    p = {
        "gate": rng.normal(0, 0.1, (INPUTS, UNITS)), "cell": rng.normal(0, 0.3, (INPUTS, UNITS)), "out": rng.normal(0, 0.05, (UNITS, CLASSES)),
        "bias": np.log(sizes / sizes.sum()), "word": rng.normal(0, 0.05, (HEADS, UNITS, MEMBERS)), "word_bias": np.log(heads / heads.sum(1, keepdims=True)),
    }
    return {k: v.astype(np.float32) for k, v in p.items()}


def _softmax(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities and log normaliser by row."""
    top = z.max(1, keepdims=True)
    e = np.exp(z - top)
    total = e.sum(1, keepdims=True)
    return e / total, (top + np.log(total))[:, 0]


def _emitted(p: dict[str, np.ndarray], hr: np.ndarray, yr: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log probabilities of targets yr in states hr, and with grad (filled with sums) the derivative by the states."""
    cls = np.where(yr < HEAD_WORDS, yr // MEMBERS, yr - HEAD_WORDS + HEADS)
    z = hr @ p["out"] + p["bias"]
    prob, norm = _softmax(z)
    rows = np.arange(len(yr))
    logp = z[rows, cls] - norm
    order = np.argsort(cls, kind="stable")
    edge = np.searchsorted(cls[order], np.arange(HEADS + 1))
    dh = None
    if grad is not None:
        prob[rows, cls] -= 1
        grad |= {"out": hr.T @ prob, "bias": prob.sum(0), "word": np.zeros_like(p["word"]), "word_bias": np.zeros_like(p["word_bias"])}
        dh = prob @ p["out"].T
    for k in range(HEADS):
        at = order[edge[k] : edge[k + 1]]
        if len(at):
            zk = hr[at] @ p["word"][k] + p["word_bias"][k]
            pk, nk = _softmax(zk)
            member, own = yr[at] % MEMBERS, np.arange(len(at))
            logp[at] += zk[own, member] - nk
            if grad is not None:
                pk[own, member] -= 1
                grad["word"][k] = hr[at].T @ pk
                grad["word_bias"][k] = pk.sum(0)
                dh[at] += pk @ p["word"][k].T
    return logp, dh


class Network:
    """h_t = (1 - g_t) h_{t-1} + g_t c_t, where gate g and candidate c follow from the token read; then class and word-in-class softmaxes."""

    def __init__(self, p: dict[str, np.ndarray], rate: float = 0.05):
        self.p, self.rate = p, rate
        self.seen = {k: np.full_like(v, 1e-6) for k, v in p.items()}

    def gates(self) -> tuple[np.ndarray, np.ndarray]:
        """Gate and candidate of every token that can be read."""
        return 1 / (1 + np.exp(-self.p["gate"])), np.tanh(self.p["cell"])

    def window(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, h: np.ndarray, learn: bool) -> tuple[np.ndarray, np.ndarray]:
        """Natural log probabilities (steps, streams) of the targets y (head number, or HEAD_WORDS + tail class; -1: none) and the last state.

        x: tokens read; fresh: 1 where a text begins and the carried state is dropped.
        """
        p, (steps, m) = self.p, x.shape
        g, c = (t[x] for t in self.gates())
        hold = (1 - g) * (1 - fresh)[:, :, None]
        add = g * c
        hs = np.empty((steps + 1, m, UNITS), np.float32)
        hs[0] = h
        for t in range(steps):
            hs[t + 1] = hold[t] * hs[t] + add[t]
        real = np.flatnonzero(y.reshape(-1) >= 0)
        grad: dict | None = {} if learn else None
        logp, dh = _emitted(p, hs[1:].reshape(-1, UNITS)[real], y.reshape(-1)[real], grad)
        out = np.zeros(steps * m)
        out[real] = logp
        if learn and len(real):
            full = np.zeros((steps * m, UNITS), np.float32)
            full[real] = dh
            full = full.reshape(steps, m, UNITS)
            back = np.zeros((m, UNITS), np.float32)
            for t in range(steps - 1, -1, -1):
                full[t] += back
                back = full[t] * hold[t]
            dg = full * (c - hs[:-1] * (1 - fresh)[:, :, None]) * g * (1 - g)
            dc = full * g * (1 - c * c)
            flat = x.reshape(-1)
            for name, d in (("gate", dg), ("cell", dc)):
                d = d.reshape(-1, UNITS)
                grad[name] = np.stack([np.bincount(flat, d[:, u], INPUTS) for u in range(UNITS)], 1).astype(np.float32)
            for name, gr in grad.items():
                gr = gr / len(real)
                self.seen[name] += gr * gr
                p[name] -= self.rate * gr / np.sqrt(self.seen[name])
        return out.reshape(steps, m), hs[-1]


def _scan(hold: np.ndarray, add: np.ndarray, h: np.ndarray, steps: int = 64) -> np.ndarray:
    """All states of h_t = hold_t h_{t-1} + add_t: stretches of `steps` from a state of zero side by side, then what each stretch is handed on."""
    n = len(hold)
    wide = -(-n // steps)
    hs, pr = (np.zeros((wide * steps, UNITS), np.float32) for _ in range(2))
    hs[:n], pr[:n] = add, hold
    hs, pr = hs.reshape(wide, steps, UNITS), pr.reshape(wide, steps, UNITS)
    for t in range(1, steps):
        hs[:, t] += pr[:, t] * hs[:, t - 1]
        pr[:, t] *= pr[:, t - 1]
    carried = np.empty((wide, UNITS), np.float32)
    for k in range(wide):
        carried[k] = h
        h = hs[k, -1] + pr[k, -1] * h
    hs += pr * carried[:, None]
    return hs.reshape(-1, UNITS)[:n]


def _read(ids: np.ndarray, first: np.ndarray, end_id: int) -> np.ndarray:
    """The token read before each token: the one before it in its text, the end at a text's beginning."""
    x = np.empty_like(ids)
    x[1:] = ids[:-1]
    x[:1] = end_id
    x[first] = end_id
    return x


def log_probs(net: Network, ids: np.ndarray, first: np.ndarray, end_id: int) -> np.ndarray:
    """Log probability of every token of texts laid end to end (first: where a text begins). The state is carried from window to window to each text's end."""
    g, c = net.gates()
    keep, add = (1 - g).astype(np.float32), (g * c).astype(np.float32)
    out, x, h = np.zeros(len(ids)), _read(ids, first, end_id), np.zeros(UNITS, np.float32)
    for at in range(0, len(ids), BLOCK):
        w = slice(at, at + BLOCK)
        hold = keep[x[w]]
        hold[first[w]] = 0
        hs = _scan(hold, add[x[w]], h)
        h = hs[-1]
        out[w], _ = _emitted(net.p, hs, ids[w])
    return out


def learn_pool(net: Network, ids: np.ndarray, first: np.ndarray, end_id: int) -> None:
    """One pass of truncated backpropagation: the tokens are cut into equal streams side by side, which are read in windows with the state carried on."""
    if not len(ids):
        return
    m = int(np.clip(len(ids) // STEPS, 1, STREAMS))
    long = -(-len(ids) // (m * STEPS)) * STEPS
    x, y, fresh = np.full(m * long, end_id, np.int32), np.full(m * long, -1, np.int32), np.zeros(m * long, np.float32)
    x[: len(ids)], y[: len(ids)], fresh[: len(ids)] = _read(ids, first, end_id), ids, first
    x, y, fresh = (v.reshape(m, long).T for v in (x, y, fresh))
    h = np.zeros((m, UNITS), np.float32)
    for t in range(0, long, STEPS):
        w = slice(t, t + STEPS)
        _, h = net.window(np.ascontiguousarray(x[w]), np.ascontiguousarray(y[w]), fresh[w], h, True)


def _numbers(lex: Lexicon, hashes: np.ndarray, shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Input numbers of tokens, and their places among the known words (-1: none)."""
    at = lex.find(hashes)
    head = np.where(at >= 0, lex.head[at], -1) if len(lex.h) else np.full(len(hashes), -1)
    return np.where(head >= 0, head, HEAD_WORDS + shapes).astype(np.int32), at


def _end(lex: Lexicon) -> int:
    return int(_numbers(lex, np.array([END_HASH]), np.zeros(1, np.int32))[0][0])


def _pools(col: pa.Array, most: int = POOL_TOKENS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """_tokens() of several slices together, about `most` tokens."""
    held: list = []
    for x in _tokens(col):
        held.append(x)
        if sum(len(y[2]) for y in held) >= most:
            yield _joined(held)
            held = []
    if held:
        yield _joined(held)


def _joined(held: list) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    h, s = (np.concatenate([x[k] for x in held]) for k in (2, 3))
    sizes = np.concatenate([np.diff(x[4]) for x in held])
    return held[0][0], held[-1][1], h, s, np.concatenate([[0], np.cumsum(sizes)])


def _pass(texts: DataFrame, groups: int, parts: int, held, rate: float) -> np.ndarray | None:
    """Weights (flat) after each group of texts has been learnt from, averaged by tokens; None without texts.

    texts: text and r (a hash of the row). Which group a row is in and the order within it depend on the row alone, and a group's
    tokens are cut into pools of equal size, so the weights are the same however the input is split. held: broadcast start weights and lexicon.
    """
    rows = texts.select(F.pmod("r", F.lit(groups)).cast("int").alias("g"), "r", "text").repartition(parts, "g").sortWithinPartitions("g", "r", "text")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, d = held.value
        lex, now, net, total, ids, first = Lexicon(**d), None, None, 0, [], []
        end = _end(lex)

        def taught(least: int) -> None:
            nonlocal ids, first, total
            i, f = np.concatenate(ids), np.concatenate(first)
            upto = len(i) // least * least if least else len(i)
            for at in range(0, upto, POOL_TOKENS):
                learn_pool(net, i[at : min(at + POOL_TOKENS, upto)], f[at : min(at + POOL_TOKENS, upto)], end)
            total += upto
            ids, first = [i[upto:]], [f[upto:]]

        def ended() -> pa.RecordBatch:
            nonlocal ids, first
            taught(0)
            flat = np.concatenate([net.p[k].reshape(-1) for k in NAMES]).astype(np.float64) * total
            ids, first = [], []
            return pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat) + 1)), pa.array(np.append(flat, total))], ["i", "v"])

        for batch in batches:
            group = batch.column(0).to_numpy()
            for a, b, h, s, at in _tokens(batch.column(1)):
                every, _ = _numbers(lex, h, s)
                begins = np.zeros(len(every), bool)
                begins[at[:-1]] = True
                edge = [0, *(np.flatnonzero(np.diff(group[a:b])) + 1).tolist(), b - a]
                for lo, hi in zip(edge[:-1], edge[1:]):
                    if group[a + lo] != now:
                        if now is not None:
                            yield ended()
                        now, net, total = group[a + lo], Network({k: v.copy() for k, v in start.items()}, rate), 0
                    ids.append(every[at[lo] : at[hi]])
                    first.append(begins[at[lo] : at[hi]])
                    if sum(map(len, ids)) >= POOL_TOKENS:
                        taught(POOL_TOKENS)
        if now is not None:
            yield ended()

    sums = rows.select("g", "text").mapInArrow(learn, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")["v"].to_numpy()
    return sums[:-1] / sums[-1] if len(sums) and sums[-1] > 0 else None


def train(texts: DataFrame, lex: Lexicon) -> dict[str, np.ndarray]:
    """Weights after a warm start on one group of about WARM_TOKENS tokens and a pass over all texts in parallel groups of about GROUP_TOKENS.

    Columns text and r (a hash of the row). Both passes run on the executors, text by text; the driver gets one value a weight however much there is to learn from.
    """
    p, sc = initial(lex), texts.sparkSession.sparkContext
    groups = max(1, round(lex.tokens / GROUP_TOKENS))
    part = max(1, lex.tokens // WARM_TOKENS)
    warm = texts.where(F.pmod(F.xxhash64("r"), F.lit(part)) == 0)
    for rows, n, rate in ((warm, 1, 0.05), (texts, groups, 0.03)):
        flat = _pass(rows, n, n, sc.broadcast((p, lex.heads().__dict__)), rate)
        if flat is None:
            continue
        at, new = 0, {}
        for k in NAMES:
            new[k] = flat[at : at + p[k].size].reshape(p[k].shape).astype(np.float32)
            at += p[k].size
        p = new
    return p


def lm_scores(docs: DataFrame, *, text: str = "text", key: str = "doc_id", parts: int = 5, known: int = KNOWN_WORDS) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score of every text.

    Counts, network and scores all cover whole texts; nothing is learnt from rows whose crc32 of the key is 1 modulo `parts`.
    A frequent word is scored as class and member; any other as a tail class by the network and then by its smoothed share of the
    class, the unseen word being one of them. Counts of the most frequent words travel with the network; the counts of
    all others are joined to what each text has of them. A null text is the end alone, a null key is learnt from and not held out;
    equal keys are scored row by row. Without anything to learn from every token is unseen. An empty table gives no rows.
    Scores don't depend on how the input is split into files and tasks.
    """
    kind = docs.schema[key].dataType.simpleString()
    out = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts == 1, F.lit(False))
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    words = F.coalesce(F.col(text).cast("string"), F.lit(""))
    learnt = docs.where(~out).select(words.alias("text"), F.xxhash64(F.lit("learn"), F.col(key).cast("string"), words).alias("r"))
    counts = stored(word_counts(learnt), "word-counts")
    lex = lexicon(counts, known)
    weights = train(learnt, lex)
    held = docs.sparkSession.sparkContext.broadcast((weights, lex.__dict__))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, d = held.value
        net, words = Network({k: v.copy() for k, v in p.items()}), Lexicon(**d)
        end, ten = _end(words), np.log(10)
        share = np.log10(words.tokens + 0.5 * (words.words + 1))
        tail = np.log10(words.tail_n + 0.5 * (words.tail_v + 1))
        for batch in batches:
            for a, b, h, s, at in _pools(batch.column(1)):
                ids, place = _numbers(words, h, s)
                first = np.zeros(len(ids), bool)
                first[at[:-1]] = True
                logs = log_probs(net, ids, first, end) / ten
                found = place >= 0
                log_c = np.where(found, np.log10((words.c[place] if len(words.c) else np.zeros(len(place))) + 0.5), 0.0)
                in_tail = ids >= HEAD_WORDS
                logs += np.where(in_tail, log_c - tail[s], 0.0)
                row = np.repeat(np.arange(b - a), np.diff(at))
                add = lambda v: np.bincount(row, v, b - a)  # noqa: E731, B023
                rare = ~found
                both = row[rare].astype(np.uint64), h[rare]
                order = np.lexsort((both[1], both[0]))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(both[0][order], np.arange(b - a + 1)).astype(np.int32)), pa.array(both[1][order].view(np.int64)))
                n = np.diff(at).astype(np.int64)
                cols = [batch.column(0).slice(a, b - a), pa.array(n), pa.array(add(found).astype(np.int64)), pa.array(add(log_c) - n * share), pa.array(add(logs)), lists]
                yield pa.RecordBatch.from_arrays(cols, ["id", "n_tokens", "n_found", "base", "model", "rare"])

    scored = rows.mapInArrow(score, f"id {kind}, n_tokens long, n_found long, base double, model double, rare array<long>").withColumn("row", F.monotonically_increasing_id())
    scored = stored(scored, "scored")
    # log10(c + 0.5) of the words that did not travel: each text's distinct ones with the joined counts
    rare = scored.select("row", F.explode("rare").alias("h")).groupBy("row", "h").agg(F.count("*").alias("k"))
    rare = rare.join(counts.select("h", "c"), "h", "left").groupBy("row").agg(F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("known"))
    df = scored.join(rare, "row", "left")
    more, k = F.coalesce("more", F.lit(0.0)), F.coalesce("known", F.lit(0))
    held_out = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % parts == 1, F.lit(False))
    return df.select(F.col("id").alias(key), held_out.alias("held_out"), "n_tokens", (F.col("n_found") + k).alias("n_known"), F.lit(lex.tokens).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: all documents."""
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
