"""Byte-pair merging: vocabulary files, exact merging, joining of encoded halves."""

from __future__ import annotations

import json
from functools import cached_property, lru_cache

import numpy as np

END = "</w>"


def byte_symbols() -> dict[int, str]:
    """Byte-level BPE writes each byte as a printable character: those that are printable as
    themselves, and the rest, in order, from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Vocabulary:
    """Merges over integer ids. ``ends`` says whether the last symbol of a word has its own ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, symbol = spec["model"], byte_symbols()
        vocab = model["vocab"]
        self.ends = model.get("end_of_word_suffix") == END
        self.inner = [vocab[symbol[b]] for b in range(256)]
        self.final = [vocab[symbol[b] + END] for b in range(256)] if self.ends else self.inner
        self.rank: dict[tuple[int, int], int] = {}
        self.into: dict[tuple[int, int], int] = {}
        #: What the merge of each rank makes.
        self.made: list[int] = []
        for k, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            key = vocab[a], vocab[b]
            self.rank.setdefault(key, k)
            self.into.setdefault(key, vocab[a + b])
            self.made.append(vocab[a + b])
        back = {s: b for b, s in symbol.items()}
        #: Strings that are one token wherever they stand; options by which they would match otherwise are not known here.
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t.get(x) for t in spec["added_tokens"] for x in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens with options are not supported")
        self.bytes_of = {i: bytes(back[c] for c in t.removesuffix(END if self.ends else "\0")) for t, i in vocab.items() if all(c in back for c in t.removesuffix(END if self.ends else "\0"))}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}

    def merge(self, ids: list[int]) -> list[int]:
        """Applies the best-ranked merge, leftmost first, until none applies."""
        get, none = self.rank.get, len(self.made)
        ranks = [get(p, none) for p in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < none:
            k = ranks.index(best)
            ids[k : k + 2] = [self.made[best]]
            del ranks[k]
            if k:
                ranks[k - 1] = get((ids[k - 1], ids[k]), none)
            if k < len(ranks):
                ranks[k] = get((ids[k], ids[k + 1]), none)
        return ids

    def encode(self, word: bytes) -> list[int]:
        """Exact ids of one unsplit piece, merged at once."""
        if not word:
            return []
        return self.merge([*(self.inner[b] for b in word[:-1]), self.final[word[-1]]])

    @cached_property
    def in_step(self) -> bool:
        """Whether all merges of a rank may be done at once: each token is made by one merge, after those that made its parts."""
        born: dict[int, int] = {}
        for (a, b), k in sorted(self.rank.items(), key=lambda x: x[1]):
            if self.made[k] in born or born.get(a, -1) >= k or born.get(b, -1) >= k:
                return False
            born[self.made[k]] = k
        return True

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that merge, as sorted numbers, with their ranks; a last rank stands for no merge."""
        keys = np.array([a << 32 | b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        return keys[order], np.append(np.fromiter(self.rank.values(), np.int64, len(keys))[order], len(self.made))

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys, rank = self.pairs
        key = a << 32 | b
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return rank[np.where(keys[at] == key, at, len(keys))]

    def merge_all(self, ids: np.ndarray, cut: np.ndarray) -> list[np.ndarray]:
        """``merge`` of many sequences in lockstep: in each round every sequence does all its merges of its best rank."""
        if not self.in_step:
            return [np.array(self.merge(ids[a:b].tolist()), np.int64) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        made, none = np.array(self.made, np.int64), len(self.made)
        of = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        rank = np.full(len(ids), none, np.int64)  # of each symbol with the next one of its sequence
        k = np.flatnonzero(of[1:] == of[:-1])
        rank[k] = self.ranks(ids[k], ids[k + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            first = np.flatnonzero(np.diff(of, prepend=-1))
            size = np.diff(np.append(first, len(of)))
            best = np.repeat(np.minimum.reduceat(rank, first), size)
            ready = best == none
            if ready.any():
                done.append((of[ready], ids[ready]))
                ids, of, rank, best = ids[~ready], of[~ready], rank[~ready], best[~ready]
            hit = np.flatnonzero(rank == best)
            if not len(hit):
                continue
            # Of overlapping pairs (in runs of one symbol) every second one merges, from the left.
            lead = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
            hit = hit[(np.arange(len(hit)) - np.repeat(lead, np.diff(np.append(lead, len(hit))))) % 2 == 0]
            ids[hit] = made[best[hit]]
            stay = np.ones(len(ids), bool)
            stay[hit + 1] = False
            ids, of, rank = ids[stay], of[stay], rank[stay]
            near = (np.cumsum(stay) - 1)[hit]
            near = np.unique(np.concatenate((near, near[near > 0] - 1)))
            rank[near] = none
            near = near[near + 1 < len(ids)]
            near = near[of[near] == of[near + 1]]
            rank[near] = self.ranks(ids[near], ids[near + 1])
        if not done:
            return [np.zeros(0, np.int64)] * (len(cut) - 1)
        of, ids = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(of, kind="stable")
        return np.split(ids[order], np.searchsorted(of[order], np.arange(1, len(cut) - 1)))

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Byte symbols of several pieces, and their cuts."""
        cut = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
        return np.array(self.inner, np.int64)[np.frombuffer(b"".join(words), np.uint8)], cut

    def encode_many(self, pieces: list[bytes], leaf: int = 48) -> list[np.ndarray]:
        """Ids of unsplit pieces by tree concatenation, all at once.

        Pieces longer than ``leaf`` bytes are cut; the parts of all pieces are merged in lockstep.
        Then neighbouring parts are joined, level by level. Around each join a window of
        tokens is encoded anew, the windows of all joins in lockstep, and grows until its first
        and last token are those it had before (or it has reached the parts' ends): from
        there on every neighbouring pair is one that its own part had settled, so the whole
        is what merging the piece at once gives. The tree's depth is logarithmic.
        """
        if self.ends:
            raise ValueError("end-of-word vocabularies have no long unsplit pieces to join")
        parts = [p[k : k + leaf] for p in pieces for k in range(0, max(1, len(p)), leaf)]
        coded = self.merge_all(*self.symbols(parts))
        if len(parts) == len(pieces):
            return coded
        at, level = 0, []
        for p in pieces:
            n = max(1, -(-len(p) // leaf))
            level.append(coded[at : at + n])
            at += n
        while any(len(x) > 1 for x in level):
            joins = [(k, j) for k, x in enumerate(level) for j in range(0, len(x) - 1, 2)]
            joined = iter(self.join_all([(level[k][j], level[k][j + 1]) for k, j in joins]))
            level = [[next(joined) if j + 1 < len(x) else x[j] for j in range(0, len(x), 2)] for x in level]
        return [x[0] for x in level]

    def join_all(self, sides: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """Encoded neighbours as one, by growing windows round each join."""
        out: list = [None] * len(sides)
        open_, width = list(range(len(sides))), 2
        while open_:
            old = [np.concatenate((sides[k][0][-width:], sides[k][1][:width])) for k in open_]
            new = self.merge_all(*self.symbols([b"".join(map(self.bytes_of.__getitem__, w.tolist())) for w in old]))
            rest = []
            for k, was, now in zip(open_, old, new):
                left, right = sides[k]
                if (len(left) <= width or now[0] == was[0]) and (len(right) <= width or now[-1] == was[-1]):
                    out[k] = np.concatenate((left[:-width], now, right[width:]))
                else:
                    rest.append(k)
            open_, width = rest, 2 * width
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)
