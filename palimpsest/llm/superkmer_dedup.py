r"""Operator 5: removal of repeated word windows by super-k-mer partitioning.

Words are ``[^\x20\x09-\x0D]+``, unchanged. A window is ``length`` consecutive words
of one document. A word goes if a window that covers it also starts earlier: in a
document with a smaller id, or earlier in the same document.

Consecutive windows with one minimiser (the smallest hash among their short word
grams) travel as one packed string, a super-k-mer, to the minimiser's bucket, unless
an exchange of minimiser hashes has shown that it occurs nowhere else.
Equal strings of a chunk travel once. A bucket numbers its words by an exact
dictionary, sorts the windows of the distinct strings word by word, and so counts
each window and finds its first occurrence. Strings whose neighbourhood of the
minimiser occurs nowhere else are left out of the sort: no window of theirs can.

Null text has no words. A null id counts as later than all others. Rows that share
an id count as one document for order (smaller start first), so equal starts do not
remove each other. Empty tables give empty results; further columns are not read.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import chunks as C
from .columns import SPACE_WORDS, split_words, words_array
from .suffix_dedup import PART, byte_of, may_repeat
from .superkmers import RangeHash, U, byte_values, classes, gather, runs, shared, sliding_argmin, sort_rows

#: Words of the grams from which minimisers are chosen.
GRAM = 4
BLOCK = 1 << 20


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, size: int = 1 << 20) -> np.ndarray:
    """64-bit hash of each word's bytes, in pieces of about ``size`` bytes."""
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(start, start[at] + size)))
        a = start[at]
        h = RangeHash(byte_values(data[a : end[to - 1]]))
        out.append(h.of(start[at:to] - a, end[at:to] - a) ^ (end[at:to] - start[at:to]).astype(np.uint64))
        at = to
    return C.mix(np.concatenate(out))


def segments(words: np.ndarray, rows: np.ndarray, length: int):
    """Runs of windows with one minimiser: first word, windows, minimiser's offset, its hash, content hash."""
    out = []
    ends = rows[1:]
    for at in range(0, max(0, len(words) - length + 1), BLOCK):
        h = RangeHash(words[at : at + BLOCK + length - 1])
        n = len(h.sums) - GRAM
        k = np.arange(n)
        grams = C.mix(h.of(k, k + GRAM))
        place = sliding_argmin(grams, length - GRAM + 1)
        good = np.ones(len(place), bool)
        lo, hi = np.searchsorted(ends, at, "right"), np.searchsorted(ends, at + len(place) + length)
        for e in ends[lo : hi + 1].tolist():
            good[max(0, e - length + 1 - at) : max(0, e - at)] = False
        start, count = runs(place, good)
        out.append((start + at, count, place[start] - start, grams[place[start]], h.of(start, start + count + length - 1)))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


class Segments:
    """A chunk's words and super-k-mers; equal ones form a class with its first and last occurrence."""

    def __init__(self, chunk: C.Chunk, length: int):
        self.word_start, self.word_end, self.rows = split_words(chunk.data, chunk.offsets, SPACE_WORDS)
        self.start, count, anchor, key, content = segments(word_hashes(chunk.data, self.word_start, self.word_end), self.rows, length)
        row = np.searchsorted(self.rows, self.start, "right") - 1
        self.ids, self.pos = chunk.ids[row], self.start - self.rows[row]
        exact = pc.dictionary_encode(words_array(chunk.data, self.word_start, self.word_end)).indices.to_numpy()
        first, of = classes(content, exact, self.start, count + length - 1)
        order = np.argsort(first)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.of = rank[of]
        f = first[order]
        self.first, self.count, self.anchor, self.key = f, count[f], anchor[f], key[f]
        by = np.lexsort((self.pos, self.ids, self.of))
        n = np.bincount(self.of, minlength=len(f))
        least, most = by[np.cumsum(n) - n], by[np.cumsum(n) - 1]
        self.low, self.low_pos, self.high, self.high_pos = self.ids[least], self.pos[least], self.ids[most], self.pos[most]
        self.several = n > 1


def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words with one space after each."""
    size = end - start + 1
    out = data[np.minimum(gather(start, size), max(len(data) - 1, 0))] if len(start) else np.zeros(0, np.uint8)
    out[np.cumsum(size) - 1] = 0x20
    return out


def anchors(length: int):
    """A chunk's distinct minimisers."""

    def keys(chunk: C.Chunk) -> np.ndarray:
        start, end, rows = split_words(chunk.data, chunk.offsets, SPACE_WORDS)
        return np.unique(segments(word_hashes(chunk.data, start, end), rows, length)[3])

    return keys


def emitter(length: int, n: int):
    ranges = C.ranges_for(n)

    def emit(chunk: C.Chunk, answers: list[bytes]) -> C.Mail:
        s = Segments(chunk, length)
        k = np.flatnonzero(may_repeat(s, answers, n))
        count = s.count[k] + length - 1
        words = gather(s.start[s.first[k]], count)
        body = joined(chunk.data, s.word_start[words], s.word_end[words])
        size = np.add.reduceat(np.append(s.word_end[words] - s.word_start[words] + 1, 0), np.cumsum(count) - count) if len(k) else count
        columns = [k.astype(np.uint32), byte_of(s.key[k]), s.count[k].astype(np.uint16), s.anchor[k].astype(np.uint16), s.low[k], s.low_pos[k].astype(np.uint32), (s.high[k] - s.low[k]).view(np.uint64), s.high_pos[k].astype(np.uint32)]
        return C.Mail(C.range_of(s.key[k], ranges), columns, size, body)

    return emit


def before(a_id, a_pos, b_id, b_pos):
    return (a_id < b_id) | ((a_id == b_id) & (a_pos < b_pos))


def solver(length: int):
    def solve(sent: C.Records) -> C.Mail:
        found = [repeats_among(r, length) for r in sent.parts(sent.columns[1], len(sent.body), PART)]
        to, *columns = (np.concatenate(x) for x in zip(*found))
        return C.Mail(to, columns)

    return solve


def repeats_among(sent: C.Records, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that occur earlier, for each chunk that sent them: chunk, string, first window, windows, first id, lead of its position."""
    context = (length + GRAM) // 2
    chunk, data = sent.of, sent.body
    number, _, count, anchor, low, low_pos, span, high_pos = sent.columns
    count, anchor, low_pos, high_pos = (x.astype(np.int64) for x in (count, anchor, low_pos, high_pos))
    high = low + span.view(np.int64)
    stop = np.flatnonzero(data == 0x20)
    begin = np.concatenate(([0], stop[:-1] + 1))
    words = pc.dictionary_encode(words_array(data, begin, stop)).indices.to_numpy().astype(np.int64)
    del data, begin, stop
    size = count + length - 1
    start = np.cumsum(size) - size
    h = RangeHash(C.mix((words + 1).astype(np.uint64)))
    first, of = classes(h.of(start, start + size), words, start, size)
    n = np.bincount(of, minlength=len(first))
    by = np.lexsort((low_pos, low, of))
    least = by[np.cumsum(n) - n]
    by = np.lexsort((high_pos, high, of))
    most = by[np.cumsum(n) - 1]
    c_low, c_low_pos, c_high, c_high_pos = low[least], low_pos[least], high[most], high_pos[most]
    c_start, c_size, c_anchor, c_count = start[first], size[first], anchor[first], count[first]
    a = c_start + c_anchor
    mate = np.zeros(len(first), bool)
    half = context - GRAM
    for has, lo, hi in ((c_anchor >= half, a - half, a + GRAM), (c_anchor + context <= c_size, a, a + context)):
        k = np.flatnonzero(has)
        mate[k] |= shared(h.of(lo[k], hi[k]))
    # No window occurs twice inside one string: equal windows have their minimiser at the same offset.
    base = np.cumsum(c_count) - c_count
    string = np.repeat(np.arange(len(first)), c_count)
    offset = np.arange(len(string)) - base[string]
    m_id, m_pos = c_low[string], c_low_pos[string] + offset
    k = np.flatnonzero(mate[string])
    if len(k):
        place = c_start[string[k]] + offset[k]
        padded = np.append(words, -1)

        def word(j, rows):
            p = place[rows] + 2 * j
            second = np.where(2 * j + 1 < length, padded[np.minimum(p + 1, len(words))], -1)
            return ((words[p] + 1).astype(np.uint64) << U(32)) | (second + 1).astype(np.uint64)

        order, same = sort_rows(word, len(k), -(-length // 2))
        group = np.cumsum(~same) - 1
        w = k[order]
        by = np.lexsort((m_pos[w], m_id[w], group))
        head = by[np.flatnonzero(np.diff(np.concatenate(([-1], group[by]))))]
        f_id, f_pos = m_id[w[head]], m_pos[w[head]]
        m_id[w], m_pos[w] = f_id[group], f_pos[group]
    # Runs of windows whose first occurrences run along with them.
    lead = m_pos - offset
    new = np.ones(len(string), bool)
    new[1:] = (string[1:] != string[:-1]) | (m_id[1:] != m_id[:-1]) | (lead[1:] != lead[:-1])
    r = np.flatnonzero(new)
    r_size = np.diff(np.append(r, len(string)))
    real = before(m_id[r], lead[r], c_high[string[r]], c_high_pos[string[r]])
    r, r_size = r[real], r_size[real]
    per = np.bincount(string[r], minlength=len(first))
    r_first = np.cumsum(per) - per
    copies = np.flatnonzero(per[of] > 0)
    pick = gather(r_first[of[copies]], per[of[copies]])
    copy = np.repeat(copies, per[of[copies]])
    need = before(m_id[r[pick]], lead[r[pick]], high[copy], high_pos[copy])
    pick, copy = pick[need], copy[need]
    return chunk[copy], number[copy], offset[r[pick]].astype(np.uint16), r_size[pick].astype(np.uint16), m_id[r[pick]], lead[r[pick]]


def applier(length: int, with_text: bool):
    def act(chunk: C.Chunk, replies: list[bytes]) -> pa.Table:
        found = C.opened(replies)
        if found:
            s = Segments(chunk, length)
            start, end, rows = s.word_start, s.word_end, s.rows
        else:
            start, end, rows = split_words(chunk.data, chunk.offsets, SPACE_WORDS)
        change = np.zeros(len(start) + 1, np.int64)
        if found:
            number, at, windows, m_id, lead = found.columns
            number = number.astype(np.int64)
            by = np.argsort(s.of, kind="stable")
            per = np.bincount(s.of, minlength=len(s.first))
            first = np.cumsum(per) - per
            pick = by[gather(first[number], per[number])]
            row = np.repeat(np.arange(len(number)), per[number])
            hit = before(m_id[row], lead[row], s.ids[pick], s.pos[pick])
            begin = s.start[pick[hit]] + at[row[hit]]
            change += np.bincount(begin, minlength=len(change))
            change -= np.bincount(begin + windows[row[hit]] + length - 1, minlength=len(change))
        gone = np.cumsum(change[:-1]) > 0
        n_words = np.diff(rows)
        total = np.concatenate(([0], np.cumsum(gone)))
        n_removed = total[rows[1:]] - total[rows[:-1]]
        left = np.flatnonzero(~gone)
        body = joined(chunk.data, start[left], end[left]).tobytes()
        size = np.concatenate(([0], np.cumsum(end[left] - start[left] + 1)))
        cut = size[np.searchsorted(left, rows)].tolist()
        kept = [body[a : max(a, b - 1)] for a, b in zip(cut[:-1], cut[1:])]
        cols = [chunk.id_array(), pa.array(n_words), pa.array(n_removed)]
        if with_text:
            return pa.table([*cols, pa.array(kept, pa.binary())], ["id", "n_words", "n_removed", "kept"])
        return pa.table([*cols, pa.array([sha256(x).hexdigest() for x in kept], pa.string())], ["id", "n_words", "n_removed", "kept_sha256"])

    return act


def remove_windows(docs: DataFrame, length: int = 20, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, chunk_bytes: int = C.CHUNK_BYTES) -> DataFrame:
    """Per row: id, n_words, n_removed and the kept words joined by one space (``kept``, binary), or kept_sha256.

    ``length`` is at least 2 * 4 words (the minimisers' grams).
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    parts, n = C.chunked(docs, id_col, text_col, chunk_bytes)
    common, ranges = C.common_keys(parts, anchors(length), n), C.ranges_for(n)
    answers = C.solve(C.emit_with(parts, common, emitter(length, n), n, ranges), solver(length), ranges, n)
    out = C.apply(parts, answers, applier(length, with_text), f"id long, n_words long, n_removed long, {'kept binary' if with_text else 'kept_sha256 string'}")
    return out.withColumnRenamed("id", id_col)
