r"""Operator 4: benchmark decontamination as a prefix-filtered set join.

Item texts and documents are cut into words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``
after lower-casing A-Z. A window is ``window`` consecutive words of an item, or
the whole item if it has fewer. A window's set is its shingles (three words, or
all of a shorter window), ordered by how rare they are in the documents. To hold
a window whole, a document must hold its rarest shingle (for full containment the
necessary prefix has length 1), far enough from both ends of the document for the
rest of the window; what passes these positional and length bounds is compared
word by word.

Benchmark text comes in blocks of at most ``block_bytes`` bytes (one item may
exceed it alone), so what is sent to the executors has a bound whatever the
benchmark's size; every block meets every document. Counts are sums over all
documents, made per task before they are shuffled.

Null and empty texts have no words: such documents have no hits, such items no
windows. Repeated documents are judged one by one; repeated items and items with
the same id count once. An item with a null id hits like any other but has no entry in
the list of items. Empty tables give empty or clean results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import ALNUM_WORDS, ASCII_LOWER, body_buffers, narrow, slices, split_words, words_array
from .shared import kept

SHINGLE = 3
_BITS = 21


class Block:
    """Windows of one benchmark block over integer words; exact, since words are numbered by a dictionary."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        texts: dict[str | None, list[bytes]] = {}
        for item, body in items:
            texts.setdefault(item, []).append(body)
        self.items = sorted(texts, key=lambda i: (i is not None, i or ""))
        number: dict[bytes, int] = {}
        rows: dict[tuple[int, ...], set[int]] = {}
        for k, item in enumerate(self.items):
            for body in texts[item]:
                data = ASCII_LOWER[np.frombuffer(body, np.uint8)]
                s, e, _ = split_words(data, np.array([0, len(data)]), ALNUM_WORDS)
                raw = data.tobytes()
                ids = [number.setdefault(raw[a:b], len(number)) for a, b in zip(s.tolist(), e.tolist())]
                size = min(window, len(ids))
                for at in range(len(ids) - size + 1 if size else 0):
                    rows.setdefault(tuple(ids[at : at + size]), set()).add(k)
        if len(number) >= 1 << _BITS:
            raise ValueError("benchmark block has too many distinct words; lower block_bytes")
        self.words = pa.array(list(number), pa.large_binary())
        self.windows = list(rows)
        self.owners = [sorted(k for k in rows[w] if self.items[k] is not None) for w in self.windows]
        self.sizes = np.array([len(w) for w in self.windows], np.int64)
        self.flat = np.array([i for w in self.windows for i in w], np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))[:-1].astype(np.int64)
        self.keys = np.unique(np.array([key for w in self.windows for key in self.shingles(w)], np.int64))

    @staticmethod
    def shingles(w: tuple[int, ...]) -> list[int]:
        q = min(SHINGLE, len(w))
        return [sum((x + 1) << (_BITS * j) for j, x in enumerate(w[k : k + q])) for k in range(len(w) - q + 1)]

    def order(self, counts: dict[int, int]) -> None:
        """Chooses each window's rarest shingle (ties: the smaller key, then the first place)."""
        chosen: dict[int, list[tuple[int, int]]] = {}
        for n, w in enumerate(self.windows):
            keys = self.shingles(w)
            at = min(range(len(keys)), key=lambda k: (counts.get(keys[k], 0), keys[k], k))
            chosen.setdefault(keys[at], []).append((n, at))
        self.prefix = np.array(sorted(chosen), np.int64)
        lists = [chosen[k] for k in sorted(chosen)]
        self.at = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
        self.entry = np.array([p for x in lists for p in x], np.int64).reshape(-1, 2)


def numbered(part: pa.RecordBatch, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each document word's number in ``words`` (-1: not there) and the rows' first words."""
    data, off = body_buffers(part.column(1))
    data = ASCII_LOWER[data]
    s, e, rows = split_words(data, off, ALNUM_WORDS)
    ids = pc.fill_null(pc.index_in(words_array(data, s, e), value_set=words), -1)
    return ids.to_numpy(zero_copy_only=False).astype(np.int64), rows


def keys_at(ids: np.ndarray, row_of: np.ndarray, q: int) -> np.ndarray:
    """Key of the q-word shingle that starts at each word; -1 where it leaves its row or the dictionary."""
    n = len(ids) - q + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key, good = np.zeros(n, np.int64), row_of[:n] == row_of[q - 1 :]
    for j in range(q):
        key |= (ids[j : j + n] + 1) << (_BITS * j)
        good &= ids[j : j + n] >= 0
    return np.where(good, key, -1)


def found_in(keys: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``keys`` that are among the sorted values, and which of these they are."""
    some = np.flatnonzero(keys >= 0)
    if not len(among) or not len(some):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = np.minimum(np.searchsorted(among, keys[some]), len(among) - 1)
    hit = among[k] == keys[some]
    return some[hit], k[hit]


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    """The benchmark in parts by a hash of the item, each of about ``block_bytes`` at most."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("body")).filter("body is not null")
    total = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n = -(-total * 2 // block_bytes) if total > block_bytes else 1
    # Items without an id are dealt by their text; the others stay whole.
    return [items.filter(F.pmod(F.xxhash64("item", F.when(F.col("item").isNull(), F.col("body"))), F.lit(n)) == k) for k in range(n)]


def shingle_counts(bodies: DataFrame, shared, sizes: list[int]) -> dict[int, int]:
    """How often each of the block's shingles occurs in all documents."""

    def run(batches):
        words, keys = shared.value
        total = np.zeros(len(keys), np.int64)
        for batch in batches:
            for part in slices(batch, 4096):
                ids, rows = numbered(part, words)
                row_of = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
                for q in sizes:
                    total += np.bincount(found_in(keys_at(ids, row_of, q), keys)[1], minlength=len(keys))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(total[some])], ["key", "n"])

    return {r.key: r.n for r in bodies.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()}


#: Blocks judged in one Spark stage; between such groups the rows are written to the checkpoint folder.
BLOCKS_AT_ONCE = 3


def spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = 4 << 20, columns: bool = False) -> DataFrame:
    """Per document: its id, n_words, hit word runs ``spans`` (start, end by word) and ``items`` (ids as sorted strings).

    ``columns=True`` gives all columns of ``docs`` as a struct ``row`` in place of the id.
    """
    spark = docs.sparkSession
    bodies = narrow(docs, id_col, text_col)
    body = F.col(text_col).cast("binary").alias("body")
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), body) if columns else bodies
    parts = blocks(benchmark, item_id, item_text, block_bytes)
    for k, items in enumerate(parts):
        block = Block([(r.item, bytes(r.body)) for r in items.toLocalIterator()], window)
        sizes = sorted({min(SHINGLE, int(s)) for s in block.sizes})
        shared = spark.sparkContext.broadcast((block.words, block.keys))
        block.order(shingle_counts(bodies, shared, sizes) if len(block.keys) else {})
        sent = spark.sparkContext.broadcast((block.words, block.prefix, block.at, block.entry, block.sizes, block.first, block.flat, block.owners, block.items))
        found = matches(found, sent, sizes)
        if k % BLOCKS_AT_ONCE == BLOCKS_AT_ONCE - 1 and k + 1 < len(parts):
            found = kept(found)
    first = F.col("row") if columns else F.col("id").alias(id_col)
    return found.select(first, "n_words", "spans", "items")


def matches(found: DataFrame, sent, sizes: list[int]) -> DataFrame:
    """Adds one block's hits to what earlier blocks gave."""
    later = "spans" in found.columns
    head, kind = found.columns[0], found.schema[0].dataType.simpleString()

    def run(batches):
        words, prefix, at, entry, size, first, flat, owners, items = sent.value
        for batch in batches:
            for part in slices(batch, 4096):
                ids, rows = numbered(part, words)
                n_words = np.diff(rows)
                row_of = np.repeat(np.arange(len(n_words)), n_words)
                got = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
                for q in sizes:
                    pos, k = found_in(keys_at(ids, row_of, q), prefix)
                    many = at[k + 1] - at[k]
                    place = np.repeat(pos, many)
                    pick = np.repeat(at[k] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                    w, begin, row = entry[pick, 0], place - entry[pick, 1], row_of[place]
                    # The window must start and end inside the document that holds the shingle.
                    ok = (np.minimum(SHINGLE, size[w]) == q) & (begin >= rows[row]) & (begin + size[w] <= rows[row + 1])
                    w, begin = w[ok], begin[ok]
                    for j in range(int(size.max(initial=0)) if len(w) else 0):
                        same = j >= size[w]
                        same[~same] = ids[begin[~same] + j] == flat[first[w[~same]] + j]
                        w, begin = w[same], begin[same]
                    got.append((begin, w))
                begin, w = (np.concatenate(x) for x in zip(*got))
                held: list[set] = [set() for _ in n_words]
                for r, x in zip(row_of[begin].tolist(), w.tolist()):
                    held[r].update(items[i] for i in owners[x])
                change = np.zeros(len(ids) + 1, np.int64)
                np.add.at(change, begin, 1)
                np.add.at(change, begin + size[w], -1)
                if later:
                    past = part.column(2)
                    base = np.repeat(rows[:-1], pc.list_value_length(past).to_numpy(zero_copy_only=False))
                    runs = past.flatten()
                    np.add.at(change, base + runs.field(0).to_numpy(), 1)
                    np.add.at(change, base + runs.field(1).to_numpy(), -1)
                    for h, more in zip(held, part.column(3).to_pylist()):
                        h.update(more)
                hit = np.cumsum(change[:-1]) > 0
                starts, ends = hit.copy(), hit.copy()
                if len(hit):
                    new_row = row_of[1:] != row_of[:-1]
                    starts[1:] &= ~hit[:-1] | new_row
                    ends[:-1] &= ~hit[1:] | new_row
                a, b = np.flatnonzero(starts), np.flatnonzero(ends) + 1
                shift = rows[row_of[a]]
                runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(a, rows).astype(np.int32)), pa.StructArray.from_arrays([pa.array((a - shift).astype(np.int32)), pa.array((b - shift).astype(np.int32))], ["start", "end"]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), runs, pa.array([sorted(h) for h in held], pa.list_(pa.string())), pa.array(n_words)], [head, "body", "spans", "items", "n_words"])

    taken = found.select(head, "body", "spans", "items") if later else found
    return taken.mapInArrow(run, f"{head} {kind}, body binary, spans array<struct<start:int,end:int>>, items array<string>, n_words long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, min_share: float = 0.0, **names) -> DataFrame:
    """The rows of ``docs``, all columns, without those of which more than ``min_share`` of the words are hit."""
    found = spans(docs, benchmark, window, columns=True, **names)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda t, x: t + x["end"] - x["start"])
    return found.filter(~((n_hit > 0) & (n_hit > F.lit(min_share) * F.col("n_words")))).select("row.*")
