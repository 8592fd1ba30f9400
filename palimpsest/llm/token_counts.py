"""Operator 10: token counts by a compiled finite-state tokenizer.

Two deterministic transducers do the counting.

1. The splitter reads classes of code points. Its states say which kind of piece
   is open; a transition is marked if a new piece starts with its character. Text
   is cut into chunks that are read in lockstep from *every* state, which gives each
   chunk's state map; the maps compose by a parallel prefix scan (doubling), and
   with its true first state known each chunk then marks its piece starts.
2. The piece transducer reads bytes, the last one of a piece as a symbol of its own. Each
   transition is annotated with the number of tokens it adds (which may be negative: a byte
   can turn two tokens into one). A state is what later tokens can depend on: the ends of
   what was read that begin some token, with the token before each and the count there
   less the count now. There are finitely many, whatever the length of a piece: ends
   that begin no token are forgotten. Transitions are compiled when first met.

   The bytes of all pieces are cut into chunks too. A chunk's map with its count is constant
   but for its head, the bytes up to the end of the piece that is open where it begins: all
   rests are read in lockstep from the start state, then all heads from the state in which the
   chunk before ends. A chunk that is all head passes its state on, in further rounds.

Null text counts as empty: no tokens. Invalid UTF-8 is read with U+FFFD. Rows are
independent (repeats, null ids and further columns change nothing); no shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Vocabulary, vocabulary
from .columns import narrow, slices
from .superkmers import gather

# Classes: the letters that can follow an apostrophe in a contraction stand alone.
SPACE, LETTER, NUMBER, OTHER, QUOTE, S, T, M, D, R, V, L, E = range(13)
CLASSES = 13
# States: what the last character left open.
GAP, WORD, SIGN, APOS, APOS_R, APOS_V, APOS_L, DONE = range(8)
STATES = 8


def transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state and mark for each (state, class).

    Marks: 0 none, 1 a piece starts here, 2 a piece starts here and another one starts at
    the character before, where a contraction that needed two letters failed.
    A quote that opens a piece may begin 's 't 'm 'd (done after one letter) or 're 've 'll.
    If it begins none, it stays a piece of signs and the letters start their own.
    """
    nxt, mark = np.zeros((STATES, CLASSES), np.int8), np.zeros((STATES, CLASSES), np.int8)
    letters = (LETTER, S, T, M, D, R, V, L, E)
    for st in range(STATES):
        for c in range(CLASSES):
            if c == SPACE:
                to, m = GAP, 0
            elif c in letters:
                to, m = WORD, 0 if st == WORD else 1
            elif c == NUMBER:
                to, m = DONE, 1
            elif c == OTHER:
                to, m = SIGN, 0 if st in (SIGN, APOS) else 1
            else:
                to, m = (SIGN, 0) if st in (SIGN, APOS) else (APOS, 1)
            if st == APOS and c in (S, T, M, D):
                to, m = DONE, 0
            if st == APOS and c in (R, V, L):
                to, m = {R: APOS_R, V: APOS_V, L: APOS_L}[c], 0
            if st in (APOS_R, APOS_V, APOS_L):
                if c == (L if st == APOS_L else E):
                    to, m = DONE, 0
                elif c in letters:
                    to, m = WORD, 3
                else:
                    m += 3
            nxt[st, c], mark[st, c] = to, m
    return nxt, mark


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, c in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\p{White_Space}", SPACE)):
        for m in regex.finditer(pattern + "+", every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            for k in ([(a, b)] if b - a + 1 == len(m[0]) else [(a, 0xD7FF), (0xE000, b)]):
                table[k[0] : k[1] + 1] = c
    table[0x27] = QUOTE
    for ch, c in zip("stmdrvle", (S, T, M, D, R, V, L, E)):
        table[ord(ch)] = c
    return table


NEXT, MARK = transitions()
CHUNK = 256


def piece_starts(classes: np.ndarray) -> np.ndarray:
    """Marks of a whole text: chunk maps in lockstep, composed by a prefix scan, then the marks."""
    n = len(classes)
    width = min(CHUNK, max(1, n))
    rows = -(-n // width)
    grid = np.full(rows * width, SPACE, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    maps = np.broadcast_to(np.arange(STATES, dtype=np.int8), (rows, STATES)).copy()
    flat_next, flat_mark = NEXT.ravel(), MARK.ravel()
    for j in range(width):
        # Two maps that have met stay equal; most rows are constant after a space.
        maps = flat_next[maps.astype(np.int16) * CLASSES + grid[j][:, None]]
    step = 1
    while step < rows:  # inclusive scan: map k becomes the composition of maps 0..k
        maps[step:] = np.take_along_axis(maps[step:].copy(), maps[:-step].astype(np.int64), axis=1)
        step *= 2
    state = np.full(rows, GAP, np.int8)
    state[1:] = maps[:-1, GAP]
    marks = np.empty((width, rows), np.int8)
    for j in range(width):
        at = state.astype(np.int16) * CLASSES + grid[j]
        marks[j] = flat_mark[at]
        state = flat_next[at]
    return np.ascontiguousarray(marks.T).ravel()[:n]


BYTES = [bytes([b]) for b in range(256)]


class Transitions:
    """(state, symbol) -> (state, tokens added) as arrays: a hash table that is read for many keys at once."""

    def __init__(self, bits: int = 18):
        self.clear(bits)

    def clear(self, bits: int):
        self.bits, self.used = bits, 0
        self.key = np.full(1 << bits, -1, np.int64)
        self.to, self.add = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int16)

    def place(self, key: np.ndarray) -> np.ndarray:
        """Where each key is, or the free place it would take."""
        mask = (1 << self.bits) - 1
        at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.key[at]
        off = np.flatnonzero((there != key) & (there >= 0))
        while len(off):
            at[off] = (at[off] + 1) & mask
            there = self.key[at[off]]
            off = off[(there != key[off]) & (there >= 0)]
        return at

    def put(self, key: np.ndarray, to: np.ndarray, add: np.ndarray):
        """Adds distinct new keys."""
        if 2 * (self.used + len(key)) >= 1 << self.bits:
            old = np.flatnonzero(self.key >= 0)
            held = self.key[old], self.to[old], self.add[old]
            self.clear((2 * (self.used + len(key))).bit_length() + 1)
            self.put(*held)
        self.used += len(key)
        while len(key):
            at = self.place(key)
            first = np.unique(at, return_index=True)[1]  # of keys that would take one place, one does
            self.key[at[first]], self.to[at[first]], self.add[at[first]] = key[first], to[first], add[first]
            rest = np.ones(len(key), bool)
            rest[first] = False
            key, to, add = key[rest], to[rest], add[rest]


class PieceTransducer:
    """Counts of pieces by transitions that carry token counts."""

    #: Transitions kept between batches; beyond that all are compiled anew.
    KEPT = 1 << 20
    #: Bytes of a chunk.
    CHUNK = 256

    def __init__(self, vocab: Vocabulary):
        self.v = vocab
        self.split = {new: pair for pair, new in sorted(vocab.into.items(), key=lambda x: -vocab.rank[x[0]])}
        self.made = {new: vocab.rank[pair] for new, pair in sorted(self.split.items())}
        inner_ids, final_ids = set(vocab.inner), set(vocab.final)
        for new in sorted(self.made, key=self.made.get):
            a, b = self.split[new]
            if a in inner_ids and b in inner_ids:
                inner_ids.add(new)
            elif a in inner_ids and b in final_ids:
                final_ids.add(new)
        self.inner = {vocab.bytes_of[i]: i for i in inner_ids}
        self.final = {vocab.bytes_of[i]: i for i in final_ids}
        #: What begins a token and is not all of it.
        self.begins = {t[:n] for t in self.inner | self.final for n in range(len(t))}
        self.fits: dict[tuple[int, int], bool] = {}
        self.table = Transitions()
        self.clear()

    def clear(self):
        #: State 0 has read nothing: one end, empty, with no token before it.
        self.states: list[tuple[tuple[bytes, int, int], ...]] = [((b"", -1, 0),)]
        self.number = {self.states[0]: 0}
        self.table.clear(18)

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of both together leaves exactly these two tokens.

        Undoes the latest merge next to the border, step by step: a merge across the border
        that comes before the ones that closed either side would have happened first.
        """
        key = a, b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            into, made = self.v.rank, self.made
            limit, x, y, known = 1 << 60, a, b, True
            while True:
                r = into.get((x, y))
                if r is not None and r < limit:
                    known = False
                    break
                rx, ry = made.get(x, -1), made.get(y, -1)
                if rx < 0 and ry < 0:
                    break
                if rx > ry:
                    limit, x = rx, self.split[x][1]
                else:  # of equal ranks the left place merges first
                    limit, y = ry + 1, self.split[y][0]
            self.fits[key] = known
        return known

    def compile(self, key: int) -> tuple[int, int]:
        """The transition of a state by a byte; symbols from 256 on are last bytes, which lead to state 0."""
        ends, symbol = self.states[key >> 9], key & 511
        byte, tokens = BYTES[symbol & 255], self.final if symbol > 255 else self.inner
        longer = [(end + byte, before, count) for end, before, count in ends]
        # The longest token that goes with the one before it; a byte alone is a token, so there is one.
        for end, before, count in longer:
            last = tokens.get(end)
            if last is not None and (before < 0 or self.compatible(before, last)):
                break
        add = count + 1
        if symbol > 255:
            return 0, add
        begins = self.begins
        new = (*[(end, before, count - add) for end, before, count in longer if end in begins], (b"", last, 0))
        to = self.number.setdefault(new, len(self.states))
        if to == len(self.states):
            self.states.append(new)
        return to, add

    def step(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.table.place(key)
        new = np.flatnonzero(self.table.key[at] < 0)
        if len(new):
            keys = np.unique(key[new])
            to, add = zip(*map(self.compile, keys.tolist()))
            self.table.put(keys, np.array(to, np.int32), np.array(add, np.int16))
            at = self.table.place(key)
        return self.table.to[at], self.table.add[at]

    def read(self, symbols: np.ndarray, first: np.ndarray, size: np.ndarray, state: np.ndarray, added: np.ndarray) -> np.ndarray:
        """Reads ranges of symbols in lockstep, each from its state; notes what each symbol adds and returns the states at the ends."""
        order = np.argsort(-size, kind="stable")
        at, state, shrinking = first[order], state[order].astype(np.int64), -size[order]
        for j in range(int(size.max(initial=0))):
            n = int(np.searchsorted(shrinking, -j, "left"))
            place = at[:n] + j
            state[:n], added[place] = self.step(state[:n] << 9 | symbols[place])
        out = np.empty(len(order), np.int64)
        out[order] = state
        return out

    def counts(self, symbols: np.ndarray) -> np.ndarray:
        """Tokens that each symbol adds, over whole pieces one after the other."""
        if self.table.used > self.KEPT:
            self.clear()
        added = np.zeros(len(symbols), np.int16)
        first = np.arange(0, len(symbols), self.CHUNK)
        size = np.minimum(self.CHUNK, len(symbols) - first)
        last = np.flatnonzero(symbols > 255)
        # A chunk's head ends with the first last byte in it.
        end = np.append(last, len(symbols))[np.searchsorted(last, first)] + 1
        head = np.minimum(end - first, size)
        constant = end <= first + size
        after = np.zeros(len(first), np.int64)
        after[constant] = self.read(symbols, (first + head)[constant], (size - head)[constant], np.zeros(int(constant.sum()), np.int64), added)
        before = np.concatenate(([0], after[:-1]))
        # Heads whose chunk before is settled, round by round (one round unless a piece fills whole chunks).
        open_, settled = np.arange(len(first)), np.concatenate(([True], constant[:-1]))
        while len(open_):
            now = open_[settled[open_]]
            state = self.read(symbols, first[now], head[now], before[now], added)
            through = ~constant[now] & (now + 1 < len(first))
            before[now[through] + 1], settled[now[through] + 1] = state[through], True
            open_ = open_[~np.isin(open_, now)]
        return added

    def tokens(self, piece: bytes) -> int:
        """Tokens of one piece."""
        symbols = np.frombuffer(piece, np.uint8).astype(np.int64)
        symbols[-1:] += 256
        return int(self.counts(symbols).sum())


class Counter:
    def __init__(self, path: str):
        self.pieces = PieceTransducer(vocabulary(path))
        special = vocabulary(path).special
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def normal(self, text: str) -> str:
        """NFC, then lower case character by character (a final sigma has no form of its own)."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text. A special string counts one and parts the text around it."""
        total = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for k, t in enumerate(texts):
            for p in self.special.split(t) if self.special else [t]:
                parts.append(self.normal(p))
                owner.append(k)
                total[k] += 1
            total[k] -= 1
        joined = "\n".join([*parts, ""])  # a space after each text: no piece spans two, every piece is closed
        owner = np.array(owner)
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        if not len(code):
            return total
        classes = class_table()[code]
        marks = piece_starts(classes)
        starts = (marks & 1).astype(bool)  # 1 and 3: starts here
        late = np.flatnonzero(marks >= 3) - 1  # and where a contraction failed, one character back
        starts[np.flatnonzero(marks == 3)] = False
        starts[np.flatnonzero(marks == 4)] = True
        starts[late] = True
        data = np.frombuffer(joined.encode(), np.uint8)
        lead = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        solid = classes != SPACE
        at = np.flatnonzero(starts & solid)
        if not len(at):
            return total
        gaps = np.append(np.flatnonzero(~solid), len(code))
        end = np.minimum(np.append(at[1:], len(code)), gaps[np.searchsorted(gaps, at)])
        begin, stop = lead[at], lead[end]
        symbols = data[gather(begin, stop - begin)].astype(np.int64)
        close = np.cumsum(stop - begin)
        symbols[close - 1] += 256
        each = np.add.reduceat(self.pieces.counts(symbols).astype(np.int64), close - (stop - begin))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        total += np.bincount(owner[np.searchsorted(np.cumsum(sizes), at, "right")], each, len(texts)).astype(np.int64)
        return total


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters.clear()
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (more tokens than ``limit``)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        c = counter(vocab_path)
        for batch in batches:
            for part in slices(batch, 2048, 1 << 20):
                raw = [b or b"" for b in part.column(1).to_pylist()]
                n = c.counts([b.decode("utf-8", "replace") for b in raw])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(b) for b in raw], pa.int64()), pa.array(n)], ["id", "n_bytes", "n_tokens"])

    out = narrow(docs, id_col, text_col).mapInArrow(run, f"id {id_type}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
