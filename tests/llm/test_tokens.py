from hashlib import sha256

import numpy as np
import pytest

from palimpsest.llm.bpe import vocabulary
from palimpsest.llm.bpe_codec import Codec, decode_documents, encode_documents
from palimpsest.llm.token_counts import PieceTransducer, count_tokens, counter

from .helpers import AWKWARD, prose, table

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


def some_texts():
    import random

    r = random.Random(3)
    out = [t or "" for _, t in AWKWARD] + [prose(k, 300) for k in range(5)]
    alphabet = "ab'strevmlld  \n\t.!1٣é東😀ΣİǅŒ́  ﬀ "
    out += ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    out += ["ab" * 700, "the" * 300 + "x" * 333, "é" * 500, "=-" * 400, "".join(r.choice("abcdetion") for _ in range(4000))]
    return out


@pytest.mark.parametrize("leaf,remembered", [(1024, 400_000), (1024, 0), (7, 0), (2, 400_000)])
def test_encoding_equals_library(leaf, remembered):
    lib, own = tokenizers.Tokenizer.from_file(BYTE), Codec(BYTE, remembered)
    texts = some_texts()
    texts = texts if leaf > 10 else texts[:1200] + texts[-5:]
    for t, coded in zip(texts, own.encode_all(texts, leaf)):
        ids = np.frombuffer(coded, "<u4").tolist()
        assert ids == lib.encode(t, add_special_tokens=False).ids, t[:80]
        assert own.decode(coded) == t == lib.decode(ids, skip_special_tokens=False)
    assert own.encode_all([]) == [] and own.encode("") == b""


def test_tree_concatenation_equals_merging_at_once():
    v = vocabulary(BYTE)
    assert v.in_step
    pieces = [t.encode() for t in ["abcabc" * 40, "tion" * 77 + "s", "aaaa" * 99, "a" * 95, prose(9, 60).replace(" ", ""), "x", "", "é" * 70]]
    want = [v.encode(p) for p in pieces]
    for leaf in (1, 3, 8, 48, 1000):
        assert [x.tolist() for x in v.encode_many(pieces, leaf)] == want


def test_joins_change_the_halves():
    """Halves alone are not the whole: without the windows the pieces would differ."""
    c = Codec(BYTE)
    text = "it's   we'll\n\n  12345 end... " * 9
    halves = [c.find(text[k : k + 5]) for k in range(0, len(text), 5)]
    assert sum(halves, []) != c.find(text) == c.pieces(text, 5)


def test_counts_equal_library():
    lib, own = tokenizers.Tokenizer.from_file(WORD), counter(WORD)
    texts = some_texts()
    want = [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    got = own.counts(texts).tolist()
    bad = [(t[:60], a, b) for t, a, b in zip(texts, want, got) if a != b]
    assert not bad, bad[:5]
    assert own.counts([]).tolist() == [] and own.counts([""]).tolist() == [0]


def test_chunk_maps_and_states(monkeypatch):
    v = vocabulary(WORD)
    raw = [p.encode() for p in ["tion", "a" * 900, "international" * 40, "x", "é" * 60, *prose(4, 200).split()]]
    want = [len(v.encode(p)) for p in raw]
    symbols = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    close = np.cumsum([len(p) for p in raw])
    symbols[close - 1] += 256
    for chunk in (1, 5, 64, 1 << 20):
        t = PieceTransducer(v)
        monkeypatch.setattr(t, "CHUNK", chunk)
        assert np.add.reduceat(t.counts(symbols).astype(int), np.append(0, close[:-1])).tolist() == want
    known = len(t.states)
    assert t.tokens(b"a" * 5000) == len(v.encode(b"a" * 5000)) and len(t.states) <= known + 2  # the length of a piece makes no states
    monkeypatch.setattr(PieceTransducer, "KEPT", 0)
    assert [t.tokens(p) for p in raw] == want and t.tokens(b"") == 0


def test_queries_on_awkward_tables(spark):
    docs = table(spark, AWKWARD)
    lib, words = tokenizers.Tokenizer.from_file(BYTE), tokenizers.Tokenizer.from_file(WORD)
    want = sorted((i, len(x := lib.encode(t or "", add_special_tokens=False).ids), sha256(np.array(x, "<u4").tobytes()).hexdigest(), sha256((t or "").encode()).hexdigest()) for i, t in AWKWARD)
    assert sorted(map(tuple, encode_documents(docs, BYTE, with_text=False).collect())) == want
    full = encode_documents(docs, BYTE)
    assert sorted((r.doc_id, r.decoded) for r in full.collect()) == sorted((i, t or "") for i, t in AWKWARD)
    assert sorted((r.doc_id, r.decoded) for r in decode_documents(full.select("doc_id", "ids"), BYTE).collect()) == sorted((i, t or "") for i, t in AWKWARD)
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs, WORD, limit=100).collect())
    assert got == sorted((i, len((t or "").encode()), n := len(words.encode(t or "", add_special_tokens=False).ids), n > 100) for i, t in AWKWARD)
    empty = docs.limit(0)
    assert encode_documents(empty, BYTE).count() == 0 and count_tokens(empty, WORD).count() == 0
