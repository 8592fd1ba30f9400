"""Round trips between chunks of documents and ranges of content.

Documents are dealt by a hash of their id to chunks of bounded size, packed and
compressed, and shuffled once. An operator then

* ``emit``: makes records from each chunk for ranges chosen by content, with
  equal content met once per chunk (so a hot passage or group of copies costs a
  range at most one record per chunk, not one per copy),
* ``solve``: works on each range and answers the chunks that wrote to it,
* ``apply``: lets each chunk act on its answers, using the same shuffled chunks.

Records travel in crates: all that a chunk has for a range is one compressed row. A chunk
fills at most ``FAN`` crates whatever the number of ranges; beyond that, crates go to
groups of ranges first and are dealt anew there, one hop for each factor of ``FAN``. So the
rows of an exchange grow with the corpus, not with its square, and no crate gets tiny.

All steps are pure functions of their group's rows, whatever order they arrive in,
so a lost executor costs recomputation and nothing else. Nothing goes to the driver.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .columns import body_buffers, narrow
from .superkmers import gather

#: Text bytes aimed at in a chunk. A single longer text makes a longer chunk.
CHUNK_BYTES = 2 << 20
#: Ranges of content: so many, unless a range would get the records of more than SHARE chunks.
RANGES, SHARE = 64, 8
#: Crates that a group fills at most, where there are more sources and targets than that.
FAN = 256
MAIL = "at long, lane long, data binary"
#: Stands for a null id inside: later than every other id.
NULL_ID = np.iinfo(np.int64).max


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library: nothing to hand back
    _trim = None


def tidy(table: pa.Table | None = None) -> pa.Table | None:
    """Hands freed memory back to the system before the worker waits for its next group.

    A worker process lives on between stages; what its allocators keep would add up beside
    the executor's heap.
    """
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit hash of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def packed(*arrays) -> bytes:
    """Arrays as one compressed string."""
    head = np.array([len(arrays)] + [x for a in arrays for x in (len(a), _KINDS.index(a.dtype.str))], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([np.int64(len(head)).tobytes(), head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)]))


_KINDS = ["|u1", "<u2", "<u4", "<u8", "<i4", "<i8", "|b1"]


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, n, 8)
    at, out = 8 + 8 * n, []
    for k in range(int(head[0])):
        size, kind = int(head[1 + 2 * k]), np.dtype(_KINDS[int(head[2 + 2 * k])])
        out.append(np.frombuffer(raw, kind, size, at))
        at += size * kind.itemsize
    return out


def text_volume(docs: DataFrame, text_col: str) -> int:
    """The bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(F.col(text_col).cast("binary")))).first()[0] or 0


class Chunk:
    """Documents of one chunk in order of id (then size and content)."""

    def __init__(self, blobs: list[bytes]):
        ids, valid, lens, datas = [np.zeros(0, np.int64)], [np.zeros(0, bool)], [np.zeros(0, np.int64)], []
        for b in blobs:
            i, v, n, d = unpacked(b)
            ids.append(i), valid.append(v), lens.append(n), datas.append(d)
        ids, valid, lens = np.concatenate(ids), np.concatenate(valid), np.concatenate(lens)
        data = np.concatenate(datas) if datas else np.zeros(0, np.uint8)
        off = np.concatenate(([0], np.cumsum(lens)))
        texts = [data[a:b].tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
        order = sorted(range(len(ids)), key=lambda k: (ids[k], len(texts[k]), texts[k]))
        self.ids, self.valid = ids[order], valid[order]
        self.texts = [texts[k] for k in order]
        self.offsets = np.concatenate(([0], np.cumsum(lens[order]))).astype(np.int64)
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)

    def id_array(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=~self.valid)


def chunked(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """Rows (chunk, data) of compressed documents, and the number of chunks.

    Ids must be of an integer type, as documents are ordered by them; others raise a TypeError.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be of an integer type, not {docs.schema[id_col].dataType.simpleString()}")
    n = max(1, -(-text_volume(docs, text_col) // chunk_bytes))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            valid = np.asarray(batch.column(0).is_valid())
            ids = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            data, off = body_buffers(batch.column(1))
            lens = np.diff(off)
            chunk = (mix(ids.astype(np.uint64)) % np.uint64(n)).astype(np.int64)
            order = np.argsort(chunk, kind="stable")
            cut = np.flatnonzero(np.diff(chunk[order])) + 1
            rows, blobs = [], []
            for part in np.split(order, cut):
                body = np.concatenate([data[off[k] : off[k + 1]] for k in part.tolist()])
                rows.append(int(chunk[part[0]]))
                blobs.append(packed(ids[part], valid[part], lens[part], body))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(blobs, pa.binary())], ["chunk", "data"])

    source = narrow(docs, id_col, text_col).select(F.col("id").cast("long").alias("id"), "body")
    return source.mapInArrow(run, "chunk long, data binary"), n


class Mail(NamedTuple):
    """Records for numbered targets: equal columns and, if there is a ``body``, ``size`` bytes of it each."""

    to: np.ndarray
    columns: list[np.ndarray]
    size: np.ndarray | None = None
    body: np.ndarray | None = None


class Records(NamedTuple):
    """Records as they arrive, with the number of the group that each is ``of``."""

    to: np.ndarray
    of: np.ndarray
    columns: list[np.ndarray]
    size: np.ndarray | None
    body: np.ndarray | None

    def take(self, rows: np.ndarray) -> Records:
        body = None
        if self.body is not None:
            size = self.size.astype(np.int64)
            body = self.body[gather((np.cumsum(size) - size)[rows], size[rows])]
        return Records(self.to[rows], self.of[rows], [c[rows] for c in self.columns], None if self.size is None else self.size[rows], body)

    def parts(self, spread: np.ndarray, weight: int, limit: int) -> Iterator[Records]:
        """Parts of about ``limit`` of the weight; records with one ``spread`` (a byte) stay together."""
        n = min(256, -(-weight // limit))
        if n < 2:
            yield self
            return
        part = spread.astype(np.int64) * n >> 8
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(n + 1))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if a < b:
                yield self.take(order[a:b])


def ranges_for(n: int) -> int:
    """Ranges for ``n`` chunks."""
    return max(min(RANGES, 2 * n), -(-n // SHARE))


def widths(sources: int, targets: int) -> list[int]:
    """Targets that one crate covers, hop by hop; the last covers one."""
    if min(sources, targets) <= FAN:
        return [1]
    out, w = [], targets
    while w > 1:
        w = -(-w // FAN)
        out.append(w)
    return out


def crated(records: Records, width: int, lane: int) -> pa.Table:
    """Rows of ``MAIL``: one crate for each ``width`` neighbouring targets."""
    order = np.argsort(records.to, kind="stable")
    at = records.to[order].astype(np.int64) // width
    cut = np.append(np.flatnonzero(np.diff(at, prepend=-1)), len(at)).tolist()
    blobs, sealed = [], np.array([records.body is not None], np.uint8)
    for a, b in zip(cut[:-1], cut[1:]):
        r = records.take(order[a:b])
        blobs.append(packed(sealed, r.to.astype(np.uint32), r.of.astype(np.uint32), *r.columns, *(() if r.body is None else (r.size.astype(np.uint32), r.body))))
    return pa.table([pa.array(at[cut[:-1]], pa.int64()), pa.array([lane] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())], ["at", "lane", "data"])


def opened(blobs: list[bytes]) -> Records | None:
    """All records of some crates, in order of their sources; each source's in the order it sent them."""
    crates = sorted((c for c in map(unpacked, blobs) if len(c[1])), key=lambda c: int(c[2][0]))
    if not crates:
        return None
    sealed = bool(crates[0][0][0])
    columns = [np.concatenate([c[k] for c in crates]) for k in range(1, len(crates[0]))]
    size, body = columns[-2:] if sealed else (None, None)
    return Records(*columns[:2], columns[2 : len(columns) - 2 * sealed], size, body)


def dealer(width: int, fan: int):
    def run(key, table):
        return tidy(crated(opened(table.column("data").to_pylist()), width, key[1].as_py() // fan))

    return run


def hopped(mail: DataFrame, sources: int, targets: int) -> DataFrame:
    """Crates at their own targets, dealt anew as often as their number needs."""
    for width in widths(sources, targets)[1:]:
        mail = mail.groupBy("at", "lane").applyInArrow(dealer(width, FAN), MAIL)
    return mail


def sender(sources: int, targets: int) -> Callable[[pa.Scalar, Mail], pa.Table]:
    """Makes a group's crates for the first hop."""
    ways, fan = widths(sources, targets), FAN

    def send(number: pa.Scalar, mail: Mail) -> pa.Table:
        n = number.as_py()
        records = Records(mail.to, np.full(len(mail.to), n, np.int64), mail.columns, mail.size, mail.body)
        return tidy(crated(records, ways[0], n // fan if len(ways) > 1 else 0))

    return send


def emit(chunks: DataFrame, function: Callable[[Chunk], Mail], n: int, ranges: int) -> DataFrame:
    """Crates at ranges (``at``), made from each of the ``n`` chunks."""
    send = sender(n, ranges)

    def run(key, table):
        return send(key[0], function(Chunk(table.column("data").to_pylist())))

    return hopped(chunks.groupBy("chunk").applyInArrow(run, MAIL), n, ranges)


def emit_with(chunks: DataFrame, answers: DataFrame, function: Callable[[Chunk, list[bytes]], Mail], n: int, ranges: int) -> DataFrame:
    """As ``emit``, with answers to an earlier question."""
    send = sender(n, ranges)

    def run(key, docs, replies):
        return send(key[0], function(Chunk(docs.column("data").to_pylist()), replies.column("data").to_pylist()))

    return hopped(chunks.groupBy("chunk").cogroup(answers.groupBy("at")).applyInArrow(run, MAIL), n, ranges)


def solve(sent: DataFrame, function: Callable[[Records], Mail], ranges: int, n: int) -> DataFrame:
    """Crates at chunks (``at``): the ranges' answers."""
    send = sender(ranges, n)

    def run(key, table):
        return send(key[0], function(opened(table.column("data").to_pylist())))

    return hopped(sent.groupBy("at").applyInArrow(run, MAIL), ranges, n)


def apply(chunks: DataFrame, answers: DataFrame, function: Callable[[Chunk, list[bytes]], pa.Table], schema: str) -> DataFrame:
    """Each chunk with its answers; ``function`` returns rows of ``schema``."""

    def run(docs, replies):
        return tidy(function(Chunk(docs.column("data").to_pylist()), replies.column("data").to_pylist()))

    return chunks.groupBy("chunk").cogroup(answers.groupBy("at")).applyInArrow(run, schema)


#: Keys compared at a time.
KEYS = 1 << 19


def short(keys: np.ndarray) -> list[np.ndarray]:
    """The upper 48 bits of 64-bit keys, as two columns."""
    return [(keys >> np.uint64(32)).astype(np.uint32), ((keys >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.uint16)]


def joined_key(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return (hi.astype(np.uint64) << np.uint64(16)) | lo


def key_parts(low: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of records in parts of about ``KEYS``, by the lower column of their keys."""
    n = max(1, -(-len(low) // KEYS))
    for p in range(n):
        yield np.flatnonzero(low % np.uint16(n) == p) if n > 1 else np.arange(len(low))


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return (keys % np.uint64(ranges)).astype(np.int64)


def common_keys(chunks: DataFrame, keys_of: Callable[[Chunk], np.ndarray], n: int) -> DataFrame:
    """Answers that say which of its keys a chunk shares with another chunk.

    ``keys_of`` gives a chunk's distinct 64-bit keys in order. A key travels as 48 bits, the
    answer as one bit; two keys that agree in those bits and the range count as one, so a
    key may seem shared that isn't, never the other way round.
    """
    ranges = ranges_for(n)

    def ask(chunk):
        keys = keys_of(chunk)
        return Mail(range_of(keys, ranges), short(keys))

    def answer(r):
        more = np.zeros(len(r.to), bool)
        for rows in key_parts(r.columns[1]):
            key = joined_key(r.columns[0][rows], r.columns[1][rows])
            order = np.argsort(key)
            # Keys of one chunk are distinct but for the bits cut off, so equal neighbours are of two chunks.
            same = key[order][1:] == key[order][:-1]
            more[rows[order[1:][same]]] = True
            more[rows[order[:-1][same]]] = True
        by = np.argsort(r.of, kind="stable")
        first = np.flatnonzero(np.diff(r.of[by].astype(np.int64), prepend=-1))
        bits = [np.packbits(more[rows]) for rows in np.split(by, first[1:])]
        return Mail(r.of[by[first]], [r.to[by[first]].astype(np.uint32)], np.array([len(b) for b in bits], np.int64), np.concatenate(bits))

    return solve(emit(chunks, ask, n, ranges), answer, ranges, n)


def common_among(keys: np.ndarray, answers: list[bytes], n: int) -> np.ndarray:
    """Reads a chunk's answers: for each of its keys (as ``keys_of`` gave them) whether it is shared."""
    out, r = np.zeros(len(keys), bool), opened(answers)
    if r is None:
        return out
    bucket = range_of(keys, ranges_for(n))
    order = np.argsort(bucket, kind="stable")
    bucket, end = bucket[order], np.cumsum(r.size.astype(np.int64))
    for b, a, e in zip(r.columns[0].tolist(), (end - r.size).tolist(), end.tolist()):
        lo, hi = np.searchsorted(bucket, [b, b + 1])
        out[order[lo:hi]] = np.unpackbits(r.body[a:e], count=hi - lo).astype(bool)
    return out
