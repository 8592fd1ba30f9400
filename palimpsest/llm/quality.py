"""Operator 7: a quality classifier by a factorisation machine.

A text's features are its hashed words (each occurrence weighs one over the number of
words), structure statistics (shares of kinds of characters and signs, repetition of
words and lines) and metadata of its form (sizes). The score is

    w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)**2 - sum_i (v_if x_i)**2 ]

through a logistic function: all pairwise interactions at low rank, in linear time by
the sum-of-squares identity. It is learned on the driver from at most ``rows`` labelled
rows (a bound, not a share); every document is scored whole.

Null and empty texts have no words and zero statistics, and get a score like any other.
Without labelled rows every score is 1/2. Repeated rows have equal scores. Columns of
``docs`` other than id and text are never read by a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import body_buffers, slices
from .learn import STATS, hashed_words, labelled_sample, learned, row_sums, sigmoid, structure

BITS, RANK = 16, 8
#: A word's weight is this over the number of words of its text.
WORD_SCALE = 4.0


def features(data, off):
    ids, cut = hashed_words(data, off, BITS)
    return ids, cut, structure(data, off)


class Machine:
    """Parameters: rows 0..2**BITS-1 for words, then one for each statistic."""

    def __init__(self, seed: int = 7):
        r = np.random.Generator(np.random.PCG64(seed))
        n = (1 << BITS) + STATS
        self.w0, self.w, self.v = 0.0, np.zeros(n), r.normal(0, 0.05, (n, RANK))
        self.mean, self.spread = np.zeros(STATS), np.ones(STATS)

    def rescaled(self, stats):
        return np.clip((stats - self.mean) / self.spread, -4, 4)

    def logits(self, ids, x, cut, stats):
        """Linear time: sums over a row's features, then squares of sums less sums of squares."""
        d = self.rescaled(stats)
        w, v = self.w, self.v
        base = 1 << BITS
        linear = row_sums(w[ids] * x, cut) + d @ w[base:]
        vx = v[ids] * x[:, None]
        s = row_sums(vx, cut) + d @ v[base:]
        q = row_sums(vx**2, cut) + d**2 @ v[base:] ** 2
        return self.w0 + linear + 0.5 * (s**2 - q).sum(1)

    def fit(self, ids, counts, cut, stats, y, epochs: int = 12, batch: int = 128, rate: float = 0.02, decay: float = 1e-4, seed: int = 11):
        """Logistic loss, Adam on mini-batches in a fixed random order; small samples get more rounds (400 steps at least)."""
        n = len(y)
        if not n:
            return self
        epochs = max(epochs, -(-400 // -(-n // batch)))
        self.mean, self.spread = stats.mean(0), np.maximum(stats.std(0), 1e-3)
        p = np.clip(y.mean(), 0.01, 0.99)
        self.w0 = float(np.log(p / (1 - p)))
        total = np.maximum(np.add.reduceat(np.append(counts, 0.0), cut[:-1]) * (np.diff(cut) > 0), 1)
        x_all = counts * np.repeat((WORD_SCALE / total).astype(np.float32), np.diff(cut))
        r, base = np.random.Generator(np.random.PCG64(seed)), 1 << BITS
        theta = np.concatenate((self.w[:, None], self.v), axis=1)
        m, s, t = np.zeros_like(theta), np.zeros_like(theta), 0
        m0 = s0 = 0.0
        d_all = self.rescaled(stats)
        for epoch in range(epochs):
            order = r.permutation(n)
            step = rate * (1 - epoch / epochs) ** 0.5
            for at in range(0, n, batch):
                rows = order[at : at + batch]
                t += 1
                size = np.diff(cut)[rows]
                pick = np.repeat(cut[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                i, x, d = ids[pick], x_all[pick], d_all[rows]
                c = np.concatenate(([0], np.cumsum(size)))
                own = np.repeat(np.arange(len(rows)), size)
                vx = theta[i, 1:] * x[:, None]
                dense = theta[base:]
                sums = row_sums(vx, c) + d @ dense[:, 1:]
                squares = row_sums(vx**2, c) + d**2 @ dense[:, 1:] ** 2
                z = self.w0 + row_sums(theta[i, 0] * x, c) + d @ dense[:, 0] + 0.5 * (sums**2 - squares).sum(1)
                g = (sigmoid(z) - y[rows]) / len(rows)
                # d score / d v_if = x_i (sum_f - v_if x_i)
                grad_i = np.concatenate(((g[own] * x)[:, None], (g[own] * x)[:, None] * (sums[own] - vx)), axis=1)
                touched, inverse = np.unique(i, return_inverse=True)
                grad = np.zeros((len(touched) + STATS, RANK + 1))
                for c in range(RANK + 1):
                    grad[: len(touched), c] = np.bincount(inverse, grad_i[:, c], len(touched))
                grad[len(touched) :, 0] = d.T @ g
                grad[len(touched) :, 1:] = (d * g[:, None]).T @ sums - (d**2 * g[:, None]).sum(0)[:, None] * dense[:, 1:]
                where = np.concatenate((touched, np.arange(base, base + STATS)))
                grad += decay * theta[where]
                m[where] = 0.9 * m[where] + 0.1 * grad
                s[where] = 0.99 * s[where] + 0.01 * grad**2
                theta[where] -= step * (m[where] / (1 - 0.9**t)) / (np.sqrt(s[where] / (1 - 0.99**t)) + 1e-8)
                m0, s0 = 0.9 * m0 + 0.1 * g.sum(), 0.99 * s0 + 0.01 * g.sum() ** 2
                self.w0 -= step * (m0 / (1 - 0.9**t)) / (np.sqrt(s0 / (1 - 0.99**t)) + 1e-8)
        self.w, self.v = np.ascontiguousarray(theta[:, 0]), np.ascontiguousarray(theta[:, 1:])
        return self

    def scores(self, data, off):
        ids, cut, stats = features(data, off)
        n = np.diff(cut)
        if not self.w.any():
            return np.full(len(n), float(sigmoid(self.w0)))
        return sigmoid(self.logits(ids, np.repeat(WORD_SCALE / np.maximum(n, 1), n), cut, stats))


def held_out(id_col: str):
    """Rows kept from learning: crc32 of the id as text leaves 0 by 5; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, rows: int = 6000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Machine:
    """Learns from at most ``rows`` labelled rows that are not held out."""
    sample = labelled_sample(docs, labels, [label_col], rows, id_col, text_col, ~held_out(id_col))
    return learned(sample, features, 1, lambda s: Machine().fit(s.ids, s.counts, s.cut, s.dense, s.y[:, 0])) or Machine()


def score(docs: DataFrame, machine: Machine, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", columns: bool = False) -> DataFrame:
    """Per row: id, held_out, score, predicted; ``columns``: a struct ``row`` of all columns in place of the id."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)  # of fixed size
    first = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if columns else F.col(id_col)
    taken = docs.select(first.alias("first"), *([] if columns else [F.col(text_col).cast("binary").alias("body")]))

    def run(batches):
        for batch in batches:
            if columns:  # the text travels once, in its row
                batch = pa.RecordBatch.from_arrays([batch.column(0), batch.column(0).field(text_col).cast(pa.binary())], ["first", "body"])
            for part in slices(batch, 4096, 2 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sent.value.scores(*body_buffers(part.column(1))))], ["first", "score"])

    out = taken.mapInArrow(run, f"first {taken.schema['first'].dataType.simpleString()}, score double")
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    if columns:
        return out.select(F.col("first").alias("row"), "score", predicted)
    return out.withColumnRenamed("first", id_col).select(id_col, held_out(id_col).alias("held_out"), "score", predicted)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = 6000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs``, all columns, with a score of ``threshold`` or more."""
    return score(docs, train(docs, labels, rows, id_col, text_col, label_col), threshold, id_col, text_col, columns=True).filter("predicted = 1").select("row.*")
