import random
from hashlib import sha256

import numpy as np
import pytest

from palimpsest.llm import suffix_dedup as D

from .helpers import AWKWARD, prose, table


def brute(rows, length=50):
    first = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    late = float("inf")
    for i, b in raw:
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            first[w] = min(first.get(w, late), late if i is None else i)
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < (late if i is None else i):
                gone[k : k + length] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        out.append((i, len(b), int(gone.sum()), spans, sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def corpus():
    r = random.Random(5)
    passages = [prose(k, 40) for k in range(6)]
    rows = list(AWKWARD)
    for k in range(60):
        parts = [prose(100 + k, r.randint(0, 40))] + [r.choice(passages)[r.randint(0, 60) :][: r.randint(40, 200)] for _ in range(r.randint(0, 3))] + [prose(200 + k, r.randint(0, 20))]
        rows.append((r.randint(-50, 1000), "".join(parts)))
    rows += [(2000 + k, passages[0] + (str(k) if k % 3 else "")) for k in range(30)]
    rows += [(3000, "ab" * 400), (3001, "ab" * 300), (3002, "a" * 49), (3003, "a" * 50), (3004, "\0" * 120), (3005, "x" + "\0" * 70), (3006, "\0" * 51 + "y"), (None, passages[1]), (None, passages[1]), (3007, "é" * 200)]
    return rows


@pytest.mark.parametrize("chunk_bytes", [8 << 20, 3000])
def test_removal_equals_brute_force(spark, chunk_bytes, monkeypatch):
    rows = corpus()
    got = D.remove_repeats(table(spark, rows), with_text=False, chunk_bytes=chunk_bytes)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_blocks_do_not_matter(monkeypatch):
    rows = [(k, prose(7, 300)[k * 3 :] + prose(k, 10)) for k in range(5)]
    chunk = D.C.Chunk([D.C.packed(np.array([i for i, _ in rows]), np.ones(5, bool), np.array([len(t.encode()) for _, t in rows]), np.frombuffer("".join(t for _, t in rows).encode(), np.uint8))])
    whole = set()
    for block in (1 << 20, 100, 333):
        monkeypatch.setattr(D, "BLOCK", block)
        start, count, anchor, key, _ = D.segments(chunk.data, chunk.offsets, 50)
        windows = {(int(s) + w, int(s + a), int(k)) for s, c, a, k in zip(start, count, anchor, key) for w in range(c)}
        whole.add(frozenset(windows))
    assert len(whole) == 1
    assert {w for w, _, _ in next(iter(whole))} == {int(o) + k for o, (_, t) in zip(chunk.offsets, rows) for k in range(len(t.encode()) - 49)}


def test_interval_tree_gives_maximal_repeats_with_all_occurrences():
    r = random.Random(1)
    for _ in range(60):
        strings = [bytes(r.choice(b"ab\0") for _ in range(r.randint(3, 14))) for _ in range(r.randint(1, 5))]
        least, data = 3, np.frombuffer(b"".join(strings), np.uint8)
        size = np.array([len(s) for s in strings])
        sa = D.SuffixArray(data, np.cumsum(size) - size, size, least)
        suffixes = [strings[s][o:] for s, o in zip(sa.string, sa.offset)]
        assert suffixes == sorted(suffixes)
        ids = np.arange(len(strings))
        got = set()
        for a, b, depth, _, _ in D.intervals(sa.lcp.tolist(), sa.left.tolist(), ids[sa.string].tolist(), ids[sa.string].tolist(), least):
            got.add((suffixes[a][:depth], frozenset((int(sa.string[k]), int(sa.offset[k])) for k in range(a, b + 1))))
        want = {}
        for s, x in enumerate(strings):
            for i in range(len(x)):
                for j in range(i + least, len(x) + 1):
                    want.setdefault(x[i:j], set()).add((s, i))
        maximal = set()
        for x, occ in want.items():
            if len(occ) < 2:
                continue
            right = {strings[s][i + len(x) : i + len(x) + 1] or (s, i) for s, i in occ}
            left = {strings[s][i - 1] if i else -1 for s, i in occ}
            if len(right) > 1 and (len(left) > 1 or -1 in left):
                maximal.add((x, frozenset(occ)))
        assert got == maximal


def test_general_interface(spark):
    rows = [(1, prose(1, 30)), (2, "start " + prose(1, 30) + " end"), (3, None), (4, "")]
    docs = table(spark, rows)
    r = {x.doc_id: x for x in D.remove_repeats(docs).collect()}
    assert bytes(r[1].kept).decode() == rows[0][1] and r[2].n_spans == 1
    (a, b) = r[2].spans[0]
    assert rows[1][1].encode()[a:b] in rows[0][1].encode()
    out = D.without_repeats(docs)
    assert out.columns == docs.columns
    texts = {x.doc_id: x.text for x in out.collect()}
    assert texts[3] is None and texts[4] == "" and texts[1] == rows[0][1] and texts[2] == bytes(r[2].kept).decode()
    assert D.remove_repeats(docs.limit(0)).count() == 0
