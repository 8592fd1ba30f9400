"""Operator 1: removal of repeated byte strings by an enhanced suffix array's interval tree.

A byte goes if a string of ``length`` bytes that covers it also starts in a document
with a smaller id; the smallest id keeps it. Strings never cross documents.

Each window of ``length`` bytes has a minimiser, equal windows the same one. Chunks of
documents first ask which of their minimisers also occur elsewhere, by hash; windows
whose minimiser occurs nowhere else repeat nowhere and go no further. The others are
sent, with their neighbours that share the minimiser, to its range. A range sorts the
suffixes of the distinct strings it got (told apart by their bytes, not by hashes), computes common prefixes of neighbours
(the enhanced suffix array), and scans them with a stack: each node of the interval
tree is a set of suffixes with a common prefix. A node whose suffixes differ in the
byte to their left cannot be extended to either side: a maximal repeat, reported
with *all* its occurrences (a string that came from several ids is a leaf with as many). Every occurrence in a document after the repeat's
smallest id is removed; since each repeated window lies in a maximal repeat of
the same occurrences, nothing is missed.

Null text is empty. A null id counts as later than all others and stays null in the
result; rows with one id do not remove each other. Empty tables give empty results;
further columns are not read.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as C
from .superkmers import RangeHash, U, byte_values, classes, gather, runs, shared, sliding_argmin, sort_rows

#: Bytes of the k-mers from which minimisers are chosen.
KMER = 20
#: Windows read at a time.
BLOCK = 1 << 20


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a big-endian number; zeros after the end."""
    n = len(data)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = data
    out = np.empty((n + 8) // 8 * 8, np.uint64)
    for k in range(8):
        view = padded[k : k + len(out)].view(">u8")
        out[k::8] = view
    return out[:n]


def segments(data: np.ndarray, offsets: np.ndarray, length: int):
    """Runs of windows with one minimiser: start byte, windows, minimiser's offset, its hash, content hash."""
    out = []
    last = len(data) - length + 1
    ends = offsets[1:]
    for at in range(0, max(0, last), BLOCK):
        part = data[at : at + BLOCK + length - 1]
        w = words_at(part)
        n = len(part) - KMER + 1
        h = C.mix(C.mix(w[:n] * U(0x9E3779B97F4A7C15) ^ C.mix(w[8 : 8 + n])) ^ w[KMER - 8 : KMER - 8 + n])
        place = sliding_argmin(h, length - KMER + 1)
        good = np.ones(len(place), bool)
        lo, hi = np.searchsorted(ends, at, "right"), np.searchsorted(ends, at + len(place) + length)
        for e in ends[lo : hi + 1].tolist():  # windows that would cross a document's end
            good[max(0, e - length + 1 - at) : max(0, e - at)] = False
        start, count = runs(place, good)
        hashes = RangeHash(byte_values(part))
        out.append((start + at, count, place[start] - start, h[place[start]] if len(start) else np.zeros(0, np.uint64), hashes.of(start, start + count + length - 1)))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


class Segments:
    """A chunk's segments, equal ones as one class with its smallest and largest id."""

    def __init__(self, chunk: C.Chunk, length: int):
        self.start, count, anchor, key, content = segments(chunk.data, chunk.offsets, length)
        self.ids = chunk.ids[np.searchsorted(chunk.offsets, self.start, "right") - 1] if len(self.start) else self.start
        # Classes in the order of first places, so that ids in messages run up and compress.
        first, of = classes(content, chunk.data, self.start, count + length - 1)
        order = np.argsort(first)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.of = rank[of]
        f = first[order]
        self.first, self.count, self.anchor, self.key = f, count[f], anchor[f], key[f]
        self.low = np.full(len(f), C.NULL_ID)
        self.high = np.full(len(f), np.iinfo(np.int64).min)
        np.minimum.at(self.low, self.of, self.ids)
        np.maximum.at(self.high, self.of, self.ids)
        self.several = self.low < self.high


def anchors(length: int):
    """A chunk's distinct minimisers."""

    def keys(chunk: C.Chunk) -> np.ndarray:
        return np.unique(segments(chunk.data, chunk.offsets, length)[3])

    return keys


def may_repeat(s, answers: list[bytes], n: int) -> np.ndarray:
    """Classes whose minimiser occurs in another chunk or with several ids (or places) in this one."""
    key, of = np.unique(s.key, return_inverse=True)
    near = C.common_among(key, answers, n)
    return near[of] | (np.bincount(of)[of] > 1) | s.several


def byte_of(key: np.ndarray) -> np.ndarray:
    """A byte of a hash, by which a range's records are parted."""
    return (key >> U(40)).astype(np.uint8)


def emitter(length: int, n: int):
    ranges = C.ranges_for(n)

    def emit(chunk: C.Chunk, answers: list[bytes]) -> C.Mail:
        s = Segments(chunk, length)
        k = np.flatnonzero(may_repeat(s, answers, n))
        size = s.count[k] + length - 1
        body = chunk.data[gather(s.start[s.first[k]], size)]
        columns = [k.astype(np.uint32), byte_of(s.key[k]), s.anchor[k].astype(np.uint16), s.low[k], (s.high[k] - s.low[k]).view(np.uint64)]
        return C.Mail(C.range_of(s.key[k], ranges), columns, size, body)

    return emit


def intervals(lcp: list[int], left: list[int], low: list[int], high: list[int], least: int):
    """Maximal repeats of sorted suffixes by a stack scan of the interval tree.

    ``lcp[i]`` is the common prefix of suffixes i-1 and i; ``left`` the byte before each
    suffix, -1 at a string's start. Yields (first suffix, last suffix, length, smallest id,
    largest id) of each node of at least ``least`` whose left bytes differ.
    """
    stack: list[list[int]] = []  # depth, first suffix, left byte or -1 for several, low, high
    n = len(left)
    for i in range(1, n + 1):
        depth = lcp[i] if i < n else 0
        if depth < least and not stack:
            continue
        first, side, lo, hi = i - 1, left[i - 1], low[i - 1], high[i - 1]
        while stack and stack[-1][0] > depth:
            top = stack.pop()
            first = top[1]
            side = side if side == top[2] else -1
            lo, hi = min(lo, top[3]), max(hi, top[4])
            if side == -1:
                yield first, i - 1, top[0], lo, hi
        if depth < least:
            continue
        if stack and stack[-1][0] == depth:
            top = stack[-1]
            top[2] = side if side == top[2] else -1
            top[3], top[4] = min(lo, top[3]), max(hi, top[4])
        else:
            stack.append([depth, first, side, lo, hi])


class SuffixArray:
    """Suffixes of at least ``least`` bytes of several strings, sorted, with neighbours' common prefixes."""

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, least: int):
        count = size - least + 1
        self.string = np.repeat(np.arange(len(start)), count)
        self.offset = gather(np.zeros(len(start), np.int64), count)
        place = np.repeat(start, count) + self.offset
        rest = np.repeat(size, count) - self.offset
        w = np.append(words_at(data), U(0))
        depth = -(-int(rest.max(initial=0)) // 8)

        def word(j, rows):
            left = rest[rows] - 8 * j
            x = w[np.minimum(place[rows] + 8 * j, len(w) - 1)]
            cut = np.clip(8 - left, 0, 8).astype(np.uint64) * U(8)
            return np.where(left <= 0, U(0), (x >> np.minimum(cut, U(63))) << np.minimum(cut, U(63)))

        # Zeros pad short suffixes; among rows equal when padded the shorter is smaller.
        order, _ = sort_rows(lambda j, rows: word(j, rows) if j < depth else rest[rows].astype(np.uint64), len(place), depth + 1)
        self.string, self.offset, self.rest = self.string[order], self.offset[order], rest[order]
        self.left = np.where(self.offset > 0, data[np.maximum(place[order] - 1, 0)].astype(np.int64), -1)
        self.lcp = np.zeros(len(order), np.int64)
        live = np.arange(1, len(order))
        for j in range(depth):
            if not len(live):
                break
            x = word(j, order[live - 1]) ^ word(j, order[live])
            same = x == 0
            # Bytes in common: found from the top byte down.
            common = np.full(len(x), 8, np.int64)
            for b in range(7, -1, -1):
                common[(x >> U(8 * (7 - b))) & U(255) != 0] = b
            self.lcp[live] = 8 * j + common
            live = live[same]
        self.lcp[1:] = np.minimum(self.lcp[1:], np.minimum(self.rest[1:], self.rest[:-1]))

    def repeats(self, low: np.ndarray, high: np.ndarray, least: int):
        """Arrays (first, last, length, low) of the maximal repeats that span several ids.

        A string that itself stands for several ids is a leaf of the tree with several occurrences;
        it begins where its occurrences do, so the leaf of its whole length is maximal.
        """
        if not len(self.lcp):
            return (np.zeros(0, np.int64),) * 4
        leaf = np.flatnonzero((self.offset == 0) & (low < high)[self.string])
        leaves = leaf, leaf, self.rest[leaf], low[self.string[leaf]]
        # Only suffixes with a long neighbour can be in a node.
        deep = self.lcp >= least
        near = deep.copy()
        near[:-1] |= deep[1:]
        keep = np.flatnonzero(near)
        lcp = np.where(deep[keep], self.lcp[keep], 0)
        s = self.string[keep]
        found = [(a, b, d, lo) for a, b, d, lo, hi in intervals(lcp.tolist(), self.left[keep].tolist(), low[s].tolist(), high[s].tolist(), least) if lo < hi]
        if not found:
            return leaves
        a, b, d, lo = np.array(found, np.int64).T
        return tuple(np.concatenate(x) for x in zip(leaves, (keep[a], keep[b], d, lo)))


#: Bytes of strings that are sorted at a time (more if they share one minimiser).
PART = 2 << 20


def solver(length: int):
    def solve(sent: C.Records) -> C.Mail:
        found = [repeats_among(r, length) for r in sent.parts(sent.columns[1], len(sent.body), PART)]
        to, *columns = (np.concatenate(x) for x in zip(*found))
        return C.Mail(to, columns)

    return solve


def repeats_among(sent: C.Records, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that occur in an earlier document, for each chunk that sent them: chunk, string, first window, windows, smallest id."""
    context = (length + KMER) // 2  # a window holds its k-mer and as much on one side at least
    chunk, data, size = sent.of, sent.body, sent.size.astype(np.int64)
    number, _, anchor, low, span = sent.columns
    anchor, high = anchor.astype(np.int64), low + span.view(np.int64)
    start = np.cumsum(size) - size
    h = RangeHash(byte_values(data))
    first, of = classes(h.of(start, start + size), data, start, size)
    c_low = np.full(len(first), C.NULL_ID)
    c_high = np.full(len(first), np.iinfo(np.int64).min)
    np.minimum.at(c_low, of, low)
    np.maximum.at(c_high, of, high)
    c_start, c_size, c_anchor = start[first], size[first], anchor[first]
    # A string that occurs once and shares no window with another one has none of the k-mer's contexts in common.
    half = context - KMER
    a = c_start + c_anchor
    has_left, has_right = c_anchor >= half, c_anchor + context <= c_size
    mate = np.zeros(len(first), bool)
    for has, lo, hi in ((has_left, a - half, a + KMER), (has_right, a, a + context)):
        k = np.flatnonzero(has)
        mate[k] |= shared(h.of(lo[k], hi[k]))
    del h
    base = np.cumsum(c_size - length + 1) - (c_size - length + 1)
    best = np.full(int((c_size - length + 1).sum()), C.NULL_ID)
    k = np.flatnonzero(mate | (c_low < c_high))
    if len(k):
        sa = SuffixArray(data, c_start[k], c_size[k], length)
        f, last, depth, lo = sa.repeats(c_low[k], c_high[k], length)
        many = last - f + 1
        member = gather(f, many)
        at = base[k[sa.string[member]]] + sa.offset[member]
        windows = np.repeat(depth - length + 1, many)
        np.minimum.at(best, gather(at, windows), np.repeat(np.repeat(lo, many), windows))
    # Runs of windows with one smallest id, then to every chunk that holds the string after it.
    string = np.repeat(np.arange(len(first)), c_size - length + 1)
    new = np.ones(len(best), bool)
    new[1:] = (best[1:] != best[:-1]) | (string[1:] != string[:-1])
    r = np.flatnonzero(new)
    r_size = np.diff(np.append(r, len(best)))
    real = best[r] < c_high[string[r]]
    r, r_size = r[real], r_size[real]
    per = np.bincount(string[r], minlength=len(first))
    r_first = np.cumsum(per) - per
    copies = np.flatnonzero(per[of] > 0)
    pick = gather(r_first[of[copies]], per[of[copies]])
    copy = np.repeat(copies, per[of[copies]])
    need = best[r[pick]] < high[copy]
    pick, copy = pick[need], copy[need]
    s0 = (r[pick] - base[string[r[pick]]]).astype(np.uint16)
    return chunk[copy], number[copy], s0, r_size[pick].astype(np.uint16), best[r[pick]]


def applier(length: int, with_text: bool):
    def act(chunk: C.Chunk, replies: list[bytes]) -> pa.Table:
        change, found = np.zeros(len(chunk.data) + 1, np.int32), C.opened(replies)
        if found:
            s = Segments(chunk, length)
            number, at, windows, low = found.columns
            number = number.astype(np.int64)
            by = np.argsort(s.of, kind="stable")
            per = np.bincount(s.of, minlength=len(s.first))
            first = np.cumsum(per) - per
            pick = by[gather(first[number], per[number])]
            row = np.repeat(np.arange(len(number)), per[number])
            hit = s.ids[pick] > low[row]
            begin = s.start[pick[hit]] + at[row[hit]]
            change += np.bincount(begin, minlength=len(change)).astype(np.int32)
            change -= np.bincount(begin + windows[row[hit]] + length - 1, minlength=len(change)).astype(np.int32)
        gone = np.cumsum(change[:-1], dtype=np.int32) > 0
        return removed(chunk, gone, with_text)

    return act


def removed(chunk: C.Chunk, gone: np.ndarray, with_text: bool) -> pa.Table:
    """Rows of ``chunk`` without the bytes marked in ``gone``."""
    kept, n_spans, n_removed, spans, digests, whole = [], [], [], [], [], []
    for k, text in enumerate(chunk.texts):
        g = gone[chunk.offsets[k] : chunk.offsets[k + 1]]
        digests.append(sha256(text).hexdigest() if with_text else None)
        if not g.any():
            kept.append(text), n_spans.append(0), n_removed.append(0), spans.append([]), whole.append(None)
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([False], g, [False])).astype(np.int8)))
        kept.append(np.frombuffer(text, np.uint8)[~g].tobytes())
        n_spans.append(len(edge) // 2), n_removed.append(int(g.sum()))
        ends = [0, *edge.tolist(), len(text)]
        spans.append([{"start": x, "end": y} for x, y in zip(ends[1:-1:2], ends[2:-1:2])] if with_text else [])
        # Each run between cuts, without the parts of characters at its ends.
        whole.append("".join(text[x:y].decode("utf-8", "ignore") for x, y in zip(ends[::2], ends[1::2])) if with_text else None)
    cols = [chunk.id_array(), pa.array(np.diff(chunk.offsets)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64())]
    if with_text:
        more = [pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()), pa.array(whole, pa.string()), pa.array(digests, pa.string())]
        return pa.table([*cols, *more], ["id", "n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_text", "text_sha256"])
    return pa.table([*cols, pa.array([sha256(x).hexdigest() for x in kept], pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, chunk_bytes: int = C.CHUNK_BYTES) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans and, ``with_text``, the removed ``spans`` (bytes), ``kept`` (binary), ``kept_text`` (whole characters only; null if nothing is removed) and the text's ``text_sha256``; else kept_sha256.

    ``length`` is at least 2 * 20 bytes (the minimisers' k-mers). Kept bytes may end inside a
    character, as strings are judged by bytes.
    """
    if length < 2 * KMER:
        raise ValueError(f"length must be at least {2 * KMER}")
    parts, n = C.chunked(docs, id_col, text_col, chunk_bytes)
    common, ranges = C.common_keys(parts, anchors(length), n), C.ranges_for(n)
    answers = C.solve(C.emit_with(parts, common, emitter(length, n), n, ranges), solver(length), ranges, n)
    tail = "spans array<struct<start:long,end:long>>, kept binary, kept_text string, text_sha256 string" if with_text else "kept_sha256 string"
    out = C.apply(parts, answers, applier(length, with_text), f"id long, n_bytes long, n_removed long, n_spans long, {tail}")
    return out.withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with repeats cut out of the text.

    Each row comes out once, repeated ones too: rows with one id do not cut each other, and rows
    with one id and text are cut alike. A cut inside a character leaves the whole character
    out; the text's own characters, U+FFFD among them, all stay. Null texts and rows with
    a null id stay as they are. Columns may have any names.
    """
    found = remove_repeats(docs.filter(F.col(id_col).isNotNull()), length, id_col, text_col).filter("n_removed > 0")
    found = found.select(F.col(id_col).alias("key"), F.col("text_sha256").alias("digest"), F.col("kept_text").alias("body")).dropDuplicates(["key", "digest"])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("row_id"), F.sha2(F.col(text_col).cast("binary"), 256).alias("row_digest"))
    both = rows.join(found, (F.col("row_id") == F.col("key")) & (F.col("row_digest") == F.col("digest")), "left")
    return both.select(*[(F.coalesce("body", F.col("row")[c]) if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
