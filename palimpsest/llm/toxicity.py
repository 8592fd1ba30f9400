"""Operator 3: toxicity by a classifier chain of linear models.

Categories are predicted one after the other. Each model is linear (logistic) over the
words and word beginnings that occur in a text, hashed, and over the probabilities of all
earlier categories. While learning, these come from models that have not seen the row
(out-of-fold predictions); for scoring each category has one model of all rows. A model
first fits the links to earlier categories, then the words to what these leave open.

Where the table labels only ``toxic``, the earlier categories are learned from it: the toxic
rows are clustered by the words that tell them from others (spherical k-means from fixed,
farthest first seeds), each cluster is a kind of toxicity, and the chain predicts the kinds,
largest first, then ``toxic``. With several label columns the chain follows these.

The models are learned in one task from at most ``rows`` labelled rows with at most
``learn.FEATURE_BYTES`` of features, each over at most ``CHOSEN`` features that tell most
(bounds, not shares); every document is scored whole, with no shuffle.

Null and empty texts hold no words: their probabilities are those of the bias, and they
are never flagged. Without labelled rows nothing is flagged. Repeated rows have equal
scores; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import body_buffers, slices
from .learn import Sample, hashed_words, labelled_sample, learned, row_sums, sigmoid

BITS = 19
PREFIXES = (4, 6)
FOLDS = 3
#: Kinds of toxicity that are learned where the table names none.
KINDS = 2


def features(data, off):
    ids, cut = hashed_words(data, off, BITS, PREFIXES)
    return ids, cut, np.zeros((len(cut) - 1, 0))


class Linear:
    """Logistic model over present features and a few dense columns."""

    def __init__(self, dense: int):
        self.w, self.d, self.b = np.zeros(1 << BITS, np.float32), np.zeros(dense), -4.0

    def fit(self, ids, cut, dense, y, epochs: int = 30, batch: int = 64, rate: float = 0.15, decay: float = 2e-5, seed: int = 5):
        """First the links (dense columns) by Newton's method, then the words by Adagrad on mini-batches in a fixed random order.

        The words are those that say something about ``y``; they learn what the links leave open.
        """
        n = len(y)
        if not n or y.min() == y.max():
            self.b = -4.0 if not n or y[0] < 0.5 else 4.0
            return self
        keep = telling(ids, np.repeat(y.astype(np.int8), np.diff(cut)), y)[ids]
        cut = np.concatenate(([0], np.cumsum(keep)))[cut]
        ids = ids[keep]
        r = np.random.Generator(np.random.PCG64(seed))
        w, gw = np.zeros(1 << BITS), np.full(1 << BITS, 1e-3)
        p = np.clip(y.mean(), 0.01, 0.99)
        b, *d = newton(dense, y, float(np.log(p / (1 - p))))
        d, gb = np.array(d), 1e-2
        for _ in range(epochs):
            order = r.permutation(n)
            for at in range(0, n, batch):
                rows = order[at : at + batch]
                size = np.diff(cut)[rows]
                pick = np.repeat(cut[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                i, own = ids[pick], np.repeat(np.arange(len(rows)), size)
                z = b + np.bincount(own, w[i], len(rows)) + dense[rows] @ d
                g = (sigmoid(z) - y[rows]) / len(rows)
                touched, inverse = np.unique(i, return_inverse=True)
                grad = np.bincount(inverse, g[own], len(touched)) + decay * w[touched]
                gw[touched] += grad**2
                w[touched] -= rate * grad / np.sqrt(gw[touched])
                gb += g.sum() ** 2
                b -= rate * g.sum() / np.sqrt(gb)
        w[np.abs(w) < 0.02] = 0
        self.w, self.d, self.b = w.astype(np.float32), d, b
        return self

    def predict(self, ids, cut, dense):
        """``ids`` once each in a row."""
        return sigmoid(self.b + row_sums(self.w[ids].astype(np.float64), cut) + dense @ self.d)


def newton(dense: np.ndarray, y: np.ndarray, b: float, ridge: float = 0.1, rounds: int = 25) -> np.ndarray:
    """Bias and weights of a logistic model of a few columns, the weights with a small ridge."""
    x = np.concatenate((np.ones((len(y), 1)), dense), axis=1)
    t, keep = np.array([b, *np.zeros(dense.shape[1])]), ridge * np.diag([1e-3, *np.ones(dense.shape[1])])
    for _ in range(rounds if dense.shape[1] else 0):
        p = sigmoid(x @ t)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (p - y) + keep @ t)
        t = t - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return t


#: Features of one model at most, and the least chi-square of a feature against the label.
CHOSEN, CHI_SQUARE = 2000, 15.0


def telling(ids: np.ndarray, y_of: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Marks the features whose presence depends on ``y`` most (chi-square of the 2 x 2 table)."""
    n, pos = len(y), y.sum()
    here = np.bincount(ids, minlength=1 << BITS).astype(np.float64)
    both = np.bincount(ids[y_of > 0], minlength=1 << BITS)
    expected = here * pos / n
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.nan_to_num((both - expected) ** 2 / (expected * (1 - here / n) * (1 - pos / n)))
    chi[here < 3] = 0
    least = max(CHI_SQUARE, np.partition(chi, -CHOSEN)[-CHOSEN])
    return chi >= least


def distinct(ids: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's ids once."""
    parts = [np.unique(ids[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)


def rows_of(ids, cut, rows):
    size = np.diff(cut)[rows]
    pick = np.repeat(cut[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return ids[pick], np.concatenate(([0], np.cumsum(size)))


class Chain:
    """One linear model a category, in order."""

    def __init__(self, names: tuple[str, ...]):
        self.names, self.models = names, [Linear(k) for k in range(len(names))]

    def fit(self, ids, cut, y, folds: int = FOLDS):
        n = len(y)
        fold = np.arange(n) % folds
        past = np.zeros((n, 0))
        for k, model in enumerate(self.models):
            apart = np.zeros(n)
            for f in range(folds if k + 1 < len(self.models) and n >= folds else 0):
                rows, rest = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                one = Linear(k).fit(*rows_of(ids, cut, rows), past[rows], y[rows, k])
                apart[rest] = one.predict(*rows_of(ids, cut, rest), past[rest])
            model.fit(ids, cut, past, y[:, k])
            past = np.concatenate((past, apart[:, None]), axis=1)
        return self

    def predict(self, ids, cut):
        past = np.zeros((len(cut) - 1, 0))
        for model in self.models:
            past = np.concatenate((past, model.predict(ids, cut, past)[:, None]), axis=1)
        return past


def kinds(ids: np.ndarray, cut: np.ndarray, y: np.ndarray, n: int = KINDS, rounds: int = 10) -> np.ndarray:
    """Clusters of the rows marked in ``y``, one 0/1 column each, largest first; a row without telling words is in none."""
    out = np.zeros((len(y), n))
    if not len(y) or y.min() == y.max():
        return out
    columns = np.flatnonzero(telling(ids, np.repeat(y.astype(np.int8), np.diff(cut)), y))
    rows = np.flatnonzero(y)
    flat, c = rows_of(ids, cut, rows)
    of = np.repeat(np.arange(len(rows)), np.diff(c))
    at = np.minimum(np.searchsorted(columns, flat), max(len(columns) - 1, 0))
    hit = columns[at] == flat if len(columns) else np.zeros(len(flat), bool)
    x = np.zeros((len(rows), max(len(columns), 1)), np.float32)
    x[of[hit], at[hit]] = 1
    size = np.sqrt(x.sum(1))
    x, rows = x[size > 0] / size[size > 0, None], rows[size > 0]
    if len(rows) < n:
        return out
    centres = [x[0]]
    while len(centres) < n:
        centres.append(x[int(np.argmin(np.max(x @ np.array(centres).T, axis=1)))])
    centres = np.array(centres)
    for _ in range(rounds):
        part = np.argmax(x @ centres.T, axis=1)
        sums = np.array([x[part == k].sum(0) for k in range(n)])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    for place, k in enumerate(sorted(range(n), key=lambda k: (-int((part == k).sum()), k))):
        out[rows[part == k], place] = 1
    return out


def train(docs: DataFrame, labels: DataFrame, rows: int = 8000, id_col: str = "doc_id", text_col: str = "text", label_cols: tuple[str, ...] | None = None, where=None) -> Chain:
    """Learns a chain of the given label columns in their order; by default kinds of toxicity, then ``toxic``."""
    sample = labelled_sample(docs, labels, list(label_cols or ["toxic"]), rows, id_col, text_col, where)
    names = tuple(label_cols or (*(f"kind_{k + 1}" for k in range(KINDS)), "toxic"))

    def fit(s: Sample) -> Chain:
        y = s.y if label_cols else np.concatenate((kinds(s.ids, s.cut, s.y[:, 0]), s.y), axis=1)
        return Chain(names).fit(s.ids, s.cut, y)

    return learned(sample, features, len(label_cols or ["toxic"]), fit) or Chain(names)


def score(docs: DataFrame, chain: Chain, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, p_<category> for each category, toxic (the last one's is ``threshold`` or more)."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)  # of fixed size
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, 4096, 1 << 20):
                ids, cut, _ = features(*body_buffers(part.column(1)))
                p = sent.value.predict(*distinct(ids, cut))
                flagged = (p[:, -1] >= threshold) & (np.diff(cut) > 0)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(flagged)], ["id", *(f"p_{c}" for c in sent.value.names), "toxic"])

    taken = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("body"))
    return taken.mapInArrow(run, f"id {kind}, {', '.join(f'p_{c} double' for c in chain.names)}, toxic boolean").withColumnRenamed("id", id_col)
