"""Operator 9: byte-level BPE encoding and decoding by tree concatenation.

A text is cut into leaves wherever that falls. All leaves of a batch are encoded apart: each
is cut into pieces by the pre-tokenizer's pattern, and the distinct pieces of all leaves are
merged in lockstep. Neighbouring leaves are then joined, level by level: a window of pieces
round the join is cut anew and grows until its first and its last piece are those that the
sides had. Both sides then agree: the pattern looks only forward, so what follows a piece's
start does not depend on what was before it. Long pieces, in themselves unsplit, are joined in
the same way from tokens (``Vocabulary.encode_many``).

Null text counts as empty: no ids. Invalid UTF-8 is read with U+FFFD in place of
each ill-formed part. Rows are independent, so repeated rows and ids, null ids,
empty tables and further columns change nothing; there is no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import vocabulary
from .chunks import tidy
from .columns import narrow, slices

#: The pre-tokenizer's pattern (fixed value), white space by its Unicode property.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Characters of a leaf.
LEAF = 1024
#: Pieces remembered by a worker between batches; the memory is emptied when full.
REMEMBERED = 200_000
#: Characters of the longest piece that is remembered.
SHORT = 64


class Codec:
    """Encodes batches of texts; ids as little-endian 32-bit bytes."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.vocab, self.remembered = vocabulary(path), remembered
        self.find = regex.compile(PIECES).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.vocab.special)) + ")") if self.vocab.special else None
        self.token = [self.vocab.bytes_of.get(i, b"") for i in range(max(self.vocab.bytes_of) + 1)]
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str, leaf: int = LEAF) -> list[str]:
        """The pieces of a text, from those of its leaves."""
        level = [self.find(text[k : k + leaf]) for k in range(0, len(text), leaf)]
        while len(level) > 1:
            level = [self.joined(level[k], level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        return level[0] if level else []

    def joined(self, left: list[str], right: list[str]) -> list[str]:
        width = 2
        while True:
            new = self.find("".join(left[-width:] + right[:width]))
            if (len(left) <= width or new[0] == left[-width]) and (len(right) <= width or new[-1] == right[width - 1]):
                left[-width:] = new
                left += right[width:]
                return left
            width *= 2

    def encode_all(self, texts: list[str], leaf: int = LEAF) -> list[bytes]:
        split = [self.special.split(t) if self.special and any(s in t for s in self.vocab.special) else [t] for t in texts]
        cut = [[[p] if k % 2 else self.pieces(p, leaf) for k, p in enumerate(parts)] for parts in split]
        met: set[str] = set()
        met.update(*(pieces for parts in cut for pieces in parts[::2]))
        new = list(met - self.known.keys())
        if len(self.known) + len(new) > self.remembered:
            self.known.clear()
            new = list(met)
        self.known.update((p, x.astype("<u4").tobytes()) for p, x in zip(new, self.vocab.encode_many([p.encode() for p in new])))
        special = {s: np.array([i], "<u4").tobytes() for s, i in self.vocab.special.items()}
        out = [b"".join(b"".join(map((special if k % 2 else self.known).__getitem__, pieces)) for k, pieces in enumerate(parts)) for parts in cut]
        for p in new:
            if len(p) > SHORT:
                del self.known[p]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs.clear()
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids (array of int) and their decoded text.

    ``with_text=False`` leaves the arrays and texts out and keeps digests only:
    ids_sha256 over the ids as little-endian 32-bit integers, decoded_sha256.
    """
    from hashlib import sha256

    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        c = codec(vocab_path)
        for batch in batches:
            for part in slices(batch, 512, 1 << 20):
                texts = [(b or b"").decode("utf-8", "replace") for b in part.column(1).to_pylist()]
                coded = c.encode_all(texts)
                back = [c.decode(x) for x in coded]
                n = pa.array([len(x) // 4 for x in coded], pa.int64())
                if with_text:
                    flat = np.frombuffer(b"".join(coded), "<u4").astype(np.int32)
                    off = np.concatenate(([0], np.cumsum([len(x) // 4 for x in coded]))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([part.column(0), n, pa.ListArray.from_arrays(pa.array(off), pa.array(flat)), pa.array(back, pa.string())], ["id", "n_tokens", "ids", "decoded"])
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), n, pa.array([sha256(x).hexdigest() for x in coded], pa.string()), pa.array([sha256(t.encode()).hexdigest() for t in back], pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
            tidy()

    tail = "ids array<int>, decoded string" if with_text else "ids_sha256 string, decoded_sha256 string"
    return narrow(docs, id_col, text_col).mapInArrow(run, f"id {id_type}, n_tokens long, {tail}").select(F.col("id").alias(id_col), "n_tokens", *(["ids", "decoded"] if with_text else ["ids_sha256", "decoded_sha256"]))


def decode_documents(coded: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of ``array<int>`` ids, special tokens written out; null ids give an empty text."""
    id_type = coded.schema[id_col].dataType.simpleString()

    def run(batches):
        c = codec(vocab_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [c.decode(np.array(x or [], "<u4").tobytes()) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["id", "decoded"])

    return coded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {id_type}, decoded string").select(F.col("id").alias(id_col), "decoded")
