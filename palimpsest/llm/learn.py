"""Hashed features of texts, and the bounded labelled samples that models learn from."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import tidy
from .columns import ALNUM_WORDS, ASCII_LOWER, SPACE_WORDS, body_buffers, slices, split_words
from .shared import kept
from .superkmer_dedup import word_hashes

#: Bytes whose shares are measured one by one.
SIGNS = b"!#$%&*|.,:;?@/=_-\"'()[]{}<>+~^\\`"
STATS = 12 + len(SIGNS)


def hashed_words(data: np.ndarray, off: np.ndarray, bits: int, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers below 2**bits of each row's words (and of their first bytes), row by row, and the rows' cuts."""
    data = ASCII_LOWER[data]
    start, end, rows = split_words(data, off, ALNUM_WORDS)
    kinds = [word_hashes(data, start, end)] + [word_hashes(data, start, np.minimum(end, start + p)) ^ np.uint64(p * 0x9E3779B97F4A7C15 % 2**64) for p in prefixes]
    ids = np.stack([(h >> np.uint64(20)) & np.uint64((1 << bits) - 1) for h in kinds], axis=1).astype(np.int64).ravel()
    return ids, rows * len(kinds)


def row_sums(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Sums of consecutive values between cuts; zero for an empty row."""
    total = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)))
    return total[cut[1:]] - total[cut[:-1]]


def structure(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Structure statistics of each row, as numbers of moderate size; an empty text has zeros."""
    n = np.diff(off)
    size = np.maximum(n, 1)
    out = np.zeros((len(n), STATS), np.float64)
    kind = np.zeros(256, np.uint8)
    kind[0x41:0x5B], kind[0x61:0x7B], kind[0x30:0x3A], kind[list(b" \t\r\n\f\v")], kind[0x80:] = 1, 2, 3, 4, 5
    k = kind[data]
    share = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[off]) / size
    for j in range(1, 6):
        out[:, j - 1] = share(k == j)
    out[:, 5] = share(k == 0)
    start, end, rows = split_words(data, off, SPACE_WORDS)
    words = np.diff(rows)
    per = np.maximum(words, 1)
    out[:, 6] = np.log1p(n) / 10
    out[:, 7] = np.minimum(row_sums((end - start).astype(float), rows) / per, 40) / 10
    h = word_hashes(data, start, end)
    row_of = np.repeat(np.arange(len(n)), words)
    for col, a, b in ((8, h, row_of),):
        order = np.lexsort((a, b))
        first = np.ones(len(a), bool)
        first[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        out[:, col] = np.bincount(b[order][first], minlength=len(n)) / per
    line_table = np.ones(256, bool)
    line_table[0x0A] = False
    ls, le, lrows = split_words(data, off, line_table)
    lines = np.diff(lrows)
    lh, lrow = word_hashes(data, ls, le), np.repeat(np.arange(len(n)), lines)
    order = np.lexsort((lh, lrow))
    first = np.ones(len(lh), bool)
    first[1:] = (lh[order][1:] != lh[order][:-1]) | (lrow[order][1:] != lrow[order][:-1])
    out[:, 9] = np.bincount(lrow[order][first], minlength=len(n)) / np.maximum(lines, 1)
    out[:, 10] = np.log1p(lines) / 5
    out[:, 11] = np.bincount(row_of, (kind[data[np.maximum(end - 1, 0)]] == 0) if len(end) else None, len(n)) / per
    for j, c in enumerate(SIGNS):
        out[:, 12 + j] = np.sqrt(share(data == c))
    return out


#: Bytes of packed features (a number and a count each) that a model learns from at most.
FEATURE_BYTES = 64 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label_cols: list[str], rows: int, id_col: str, text_col: str, where=None) -> DataFrame:
    """At most ``rows`` labelled documents as (id, body, one int column a label), chosen by a hash of the id.

    An id's labels are averaged and count as 1 from one half; rows without a label are not used.
    Of repeated rows of an id the smallest text counts, once. The sample is bounded, so it may
    be joined by broadcast.
    """
    known = labels.filter(F.col(id_col).isNotNull())
    if where is not None:
        known = known.filter(where)
    for c in label_cols:
        known = known.filter(F.col(c).isNotNull())
    known = known.groupBy(F.col(id_col).alias("_id")).agg(*[(F.avg(c) >= 0.5).cast("int").alias(f"y{k}") for k, c in enumerate(label_cols)])
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    names = [f"y{k}" for k in range(len(label_cols))]
    got = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body")).join(F.broadcast(known), "_id")
    return got.groupBy(F.col("_id").alias("id"), *names).agg(F.min("body").alias("body")).select("id", "body", *names)


class Sample(NamedTuple):
    """Features of labelled rows: flat numbers and counts, the rows' cuts, dense columns, labels."""

    ids: np.ndarray
    counts: np.ndarray
    cut: np.ndarray
    dense: np.ndarray
    y: np.ndarray


def packs(features, n_labels: int):
    """Rows (id, place, size, pack, labels..): each text's features, packed."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                ids, cut, dense = features(*body_buffers(part.column(1)))
                blobs = []
                for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
                    one, n = np.unique(ids[a:b], return_counts=True)
                    blobs.append(np.int64(len(one)).tobytes() + one.astype(np.int32).tobytes() + n.astype(np.int32).tobytes() + dense[k].astype(np.float64).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in blobs], pa.int64()), pa.array(blobs, pa.binary()), *part.columns[2:]], ["id", "size", "pack", *[f"y{k}" for k in range(n_labels)]])

    return run


def unpacked_sample(packs: pa.Array, order: np.ndarray, y: np.ndarray) -> Sample:
    """The features of rows in an order, in 32 bits each."""
    views = [memoryview(packs[int(k)].as_buffer()) for k in order]
    size = np.array([int(np.frombuffer(v, np.int64, 1)[0]) for v in views], np.int64)
    cut = np.concatenate(([0], np.cumsum(size)))
    ids, counts = np.empty(cut[-1], np.int32), np.empty(cut[-1], np.float32)
    for v, n, at in zip(views, size.tolist(), cut.tolist()):
        ids[at : at + n] = np.frombuffer(v, np.int32, n, 8)
        counts[at : at + n] = np.frombuffer(v, np.int32, n, 8 + 4 * n)
    dense = np.array([np.frombuffer(v, np.float64, -1, 8 + 8 * n) for v, n in zip(views, size.tolist())], np.float64)
    return Sample(ids, counts, cut, dense.reshape(len(views), -1), y[order])


def learned(sample: DataFrame, features, n_labels: int, fit: Callable[[Sample], object], limit: int = FEATURE_BYTES):
    """What ``fit`` makes of a bounded sample, learned in one task on an executor; None if there are no rows.

    ``features(data, offsets)`` gives ids, cuts and dense rows. Rows are taken in order of the hash of
    their id as long as their packed features make up ``limit`` bytes at most, so the task's input
    and memory are bounded in rows and in bytes. Only row sizes and the model go to the driver.
    """
    kind, names = sample.schema["id"].dataType.simpleString(), [f"y{k}" for k in range(n_labels)]
    rows = kept(sample.mapInArrow(packs(features, n_labels), f"id {kind}, size long, pack binary, {', '.join(f'{n} int' for n in names)}").withColumn("place", F.xxhash64("id")))
    total, last = 0, None
    for r in rows.select("place", "id", "size").orderBy("place", "id").collect():  # as many as the sample's rows
        total += r["size"]
        if total > limit and last is not None:
            break
        last = r
    if last is None:
        return None
    chosen = rows.filter((F.col("place") < last.place) | (F.col("place") == last.place) & (F.col("id") <= F.lit(last.id)))

    def run(table):
        order = pc.sort_indices(table.select(["place", "id"]), [("place", "ascending"), ("id", "ascending")]).to_numpy()
        y = np.array([table.column(n).to_pylist() for n in names], np.float64).T.reshape(table.num_rows, n_labels)
        sample = unpacked_sample(table.column("pack").combine_chunks(), order, y)
        del table
        return tidy(pa.table([pa.array([pickle.dumps(fit(sample))], pa.binary())], ["model"]))

    return pickle.loads(bytes(chosen.groupBy(F.lit("all").alias("group")).applyInArrow(run, "model binary").first()[0]))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
