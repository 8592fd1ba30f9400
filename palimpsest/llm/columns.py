"""Byte-level views of Arrow text columns shared by the operators.

Everything here works on whole Arrow buffers with numpy, so cost per byte is a
few vectorised passes and no Python object is made per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that separate words for the white-space word rule ``[^\x20\x09-\x0D]+``.
SPACE_BYTES = (0x20, *range(0x09, 0x0E))


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text as bytes, under fixed names; other columns never travel."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("body"))


def body_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and its row offsets; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"")
    wide = pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def word_table(separators) -> np.ndarray:
    """True for each byte value that belongs to a word."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


SPACE_WORDS = word_table(SPACE_BYTES)
#: Letters, digits and every byte above ASCII: the rule ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing.
ALNUM_WORDS = word_table([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[0x41:0x5B] += 32


def split_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word index of each row (one entry more than rows)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = table[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def words_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words as an Arrow large-binary array, without a Python object per word."""
    lens = ends - starts
    off = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=off[1:])
    if len(lens):
        keep = np.repeat(starts - off[:-1], lens) + np.arange(off[-1])
        packed = data[keep]
    else:
        packed = np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(packed))])


def slices(batch: pa.RecordBatch, rows: int = 512, size: int = 4 << 20):
    """Cuts a batch so that one piece holds about ``size`` bytes of text; a longer text stands alone."""
    _, off = body_buffers(batch.column(1))
    at, n = 0, batch.num_rows
    while at < n:
        to = min(at + rows, max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1))
        yield batch.slice(at, to - at)
        at = to
