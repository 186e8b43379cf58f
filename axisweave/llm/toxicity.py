"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisweave.llm.vector import PUNCTUATION, words_of

#: Hash buckets of terms, factors of a term, labelled rows that are learnt from at most (those of least hash), least association of a term with the label (log-likelihood ratio G2), and passes.
BUCKETS, FACTORS, TRAIN_ROWS, MIN_G2, EPOCHS = 1 << 18, 8, 16_384, 25.0, 20
#: Frequent terms whose pairs are tested for an interaction, rows that have a term at least, and least G2 that a pair has beyond its better term.
PAIR_TERMS, PAIR_ROWS, PAIR_G2 = 2048, 20, 40.0
#: A word also counts by its first bytes, so that inflected forms share what is learnt.
PREFIX = 4
CUT = 0.7


def _terms(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, sorted distinct buckets of each row's terms one after another, and their n + 1 offsets."""
    for a, b, w in words_of(col, lower=True, breaks=PUNCTUATION):
        stem = w.spans(w.starts, np.minimum(w.starts + PREFIX, w.ends)) ^ np.uint64(0x5BD1E995)
        terms = np.concatenate([w.hash, stem]) % np.uint64(BUCKETS)
        both = np.unique(np.concatenate([w.doc, w.doc]).astype(np.int64) * BUCKETS + terms.astype(np.int64))
        rows, buckets = np.divmod(both, BUCKETS)
        yield a, b, buckets.astype(np.int32), np.searchsorted(rows, np.arange(b - a + 1))


@dataclass
class Machine:
    """score(x) = sigmoid(bias + sum w_i + sum over pairs <v_i, v_j>) over the terms present."""

    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def raw(self, buckets: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = len(at) - 1
        row = np.repeat(np.arange(n), np.diff(at))
        out = self.bias + np.bincount(row, self.weight[buckets], n)
        for f in range(self.factor.shape[1]):
            v = self.factor[buckets, f]
            out += 0.5 * (np.bincount(row, v, n) ** 2 - np.bincount(row, v * v, n))
        return out


def _g2(cells: list[tuple[np.ndarray, np.ndarray]], n: float, n1: float) -> np.ndarray:
    """Log-likelihood ratio of tables with a cell for each (rows, rows of label 1), against a label that is independent of the cell."""
    out = 0.0
    for k, k1 in cells:
        for seen, total in ((k1, n1), (k - k1, n - n1)):
            out = out + np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(k * total / n, 1e-9)), 0.0)
    return 2 * out


def associated(k: np.ndarray, k1: np.ndarray, n: float, n1: float) -> np.ndarray:
    """G2 of each term's presence and the label; k: rows that have the term, k1: those of label 1, n and n1: all such rows."""
    return _g2([(k, k1), (n - k, n1 - k1)], n, n1) if n else np.zeros(len(k))


def candidates(k: np.ndarray, k1: np.ndarray, n: float, n1: float) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the terms that are associated with the label by themselves, and of the frequent ones whose pairs are tested."""
    frequent = np.zeros(len(k), bool)
    both = np.minimum(k, n - k)
    top = np.argsort(-both, kind="stable")[:PAIR_TERMS]
    frequent[top[both[top] >= PAIR_ROWS]] = True
    return associated(k, k1, n, n1) >= MIN_G2, frequent


def interacting(rows: list[np.ndarray], labels: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Mask of the terms of pairs whose joint presence tells more of the label than either term alone does."""
    ids, n, n1 = np.flatnonzero(frequent), float(len(labels)), float(labels.sum())
    place = np.full(BUCKETS, -1)
    place[ids] = np.arange(len(ids))
    c, c1 = (np.zeros((len(ids), len(ids)), np.float32) for _ in range(2))
    for at in range(0, len(rows), 2048):
        part = rows[at : at + 2048]
        x = np.zeros((len(part), len(ids)), np.float32)
        for j, r in enumerate(part):
            p = place[r]
            x[j, p[p >= 0]] = 1
        c += x.T @ x
        c1 += x[labels[at : at + 2048] > 0.5].T @ x[labels[at : at + 2048] > 0.5]
    k, k1 = np.diag(c).astype(np.float64), np.diag(c1).astype(np.float64)
    one = associated(k, k1, n, n1)
    hit = np.zeros(len(ids), bool)
    for i in range(len(ids)):
        ab, ab1 = c[i].astype(np.float64), c1[i].astype(np.float64)
        cells = [(ab, ab1), (k[i] - ab, k1[i] - ab1), (k - ab, k1 - ab1), (n - k[i] - k + ab, n1 - k1[i] - k1 + ab1)]
        more = _g2(cells, n, n1) - np.maximum(one[i], one) >= PAIR_G2
        more[i] = False
        hit |= more
        hit[i] |= more.any()
    out = np.zeros(BUCKETS, bool)
    out[ids[hit]] = True
    return out


def fit(rows: list[np.ndarray], labels: np.ndarray, *, factors: int = FACTORS, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-4, batch: int = 128, seed: int = 7) -> Machine:
    """Adagrad on the logistic loss over the terms that are associated with the label, alone or in a pair; others keep no weight, so rare and unseen terms add nothing to a score."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    of = np.repeat(labels, [len(x) for x in rows]) if rows else np.zeros(0)
    seen, frequent = candidates(np.bincount(every, minlength=BUCKETS).astype(float), np.bincount(every, of, BUCKETS), float(len(labels)), float(labels.sum()))
    seen = seen | interacting(rows, labels, frequent)
    rows = [x[seen[x]] for x in rows]
    w, v = np.zeros(BUCKETS), rng.normal(0, 0.05, (BUCKETS, factors)) * seen[:, None]
    share = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))
    bias, gw, gv = float(np.log(share / (1 - share))), np.full(BUCKETS, 1e-2), np.full((BUCKETS, factors), 1e-2)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(rows), batch):
            part = order[k : k + batch]
            lens = np.array([len(rows[i]) for i in part])
            ids, inv = np.unique(np.concatenate([rows[i] for i in part]), return_inverse=True)
            row, m = np.repeat(np.arange(len(part)), lens), len(part)
            vb = v[ids]
            sums = np.stack([np.bincount(row, vb[inv, f], m) for f in range(factors)], 1)
            squares = np.stack([np.bincount(row, vb[inv, f] ** 2, m) for f in range(factors)], 1)
            z = bias + np.bincount(row, w[ids][inv], m) + 0.5 * (sums**2 - squares).sum(1)
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]
            bias -= 0.02 * g.mean()
            each = g[row]
            dw = np.bincount(inv, each, len(ids)) + decay * w[ids]
            dv = np.stack([np.bincount(inv, each * (sums[row, f] - vb[inv, f]), len(ids)) for f in range(factors)], 1) + decay * vb
            gw[ids] += dw**2
            gv[ids] += dv**2
            w[ids] -= rate * dw / np.sqrt(gw[ids])
            v[ids] -= 0.3 * rate * dv / np.sqrt(gv[ids])
    return Machine(bias, w.astype(np.float32), (v * seen[:, None]).astype(np.float32))


def held_out(key: str, parts: int = 3):
    """True for rows that nothing is learnt from; a null key is never learnt from nor held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "toxic", most: int = TRAIN_ROWS) -> tuple[list[np.ndarray], np.ndarray]:
    """Term buckets and labels of at most `most` labelled rows.

    Only ids of the sample are broadcast. Its terms are counted first, and of each whole text only the terms that can matter (candidates) come
    to the driver, which bounds what it gets however long the texts are.
    """
    chosen = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key)).groupBy(key).agg(F.max(label).cast("int").alias("_label"))
    chosen = chosen.orderBy(F.xxhash64(key), key).limit(most).select(F.col(key).alias("_id"), "_label")
    rows = docs.select(F.col(key).alias("_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "_id").select("_label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, k1, n = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), np.zeros(2, np.int64)
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            n += [len(y), (y > 0).sum()]
            for a, b, buckets, at in _terms(batch.column(1)):
                k += np.bincount(buckets, minlength=BUCKETS)
                k1 += np.bincount(buckets, np.repeat(y[a:b] > 0, np.diff(at)), BUCKETS).astype(np.int64)
        at = np.flatnonzero(k)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(k[at], n[0])), pa.array(np.append(k1[at], n[1]))], ["b", "k", "k1"])

    got = rows.mapInArrow(count, "b long, k long, k1 long").groupBy("b").agg(F.sum("k").alias("k"), F.sum("k1").alias("k1")).toPandas()
    total, got = got[got["b"] < 0], got[got["b"] >= 0]
    k, k1 = (np.bincount(got["b"].to_numpy(), got[c].to_numpy(), BUCKETS) for c in ("k", "k1"))
    use = np.logical_or(*candidates(k, k1, float(total["k"].sum()), float(total["k1"].sum())))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buckets, at in _terms(batch.column(1)):
                upto = np.concatenate([[0], np.cumsum(use[buckets])])[at]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(buckets[use[buckets]]))], ["label", "terms"])

    got = rows.mapInArrow(terms, "label int, terms array<int>").toArrow()
    got = got.combine_chunks()
    return [np.asarray(x, np.int64) for x in got.column("terms").to_pandas()], got.column("label").to_numpy().astype(np.float64)


def toxicity(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "toxic", cut: float = CUT, most: int = TRAIN_ROWS) -> DataFrame:
    """key, held_out, score and predicted of every row.

    The machine is fitted on the driver from a bounded sample of labelled rows that are not held out, and scores
    every whole text; only the text's terms enter a score. Null and empty texts get the bias alone, as do all rows
    where nothing is labelled; a score equal to the cut is predicted. Repeated rows score alike.
    """
    m = fit(*training_rows(docs, labels, text=text, key=key, label=label, most=most))
    machine = docs.sparkSession.sparkContext.broadcast((m.bias, m.weight, m.factor))
    kind = docs.schema[key].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine(*machine.value)
        for batch in batches:
            out = np.zeros(len(batch))
            for a, b, buckets, at in _terms(batch.column(1)):
                out[a:b] = 1 / (1 + np.exp(-np.clip(m.raw(buckets, at), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["id", "score"])

    scored = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(score, f"id {kind}, score double")
    return scored.select(F.col("id").alias(key), held_out("id").alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: all documents, learning from labels.toxic."""
    return toxicity(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")))
