import random
import re
from hashlib import sha256

import pytest

from palimpsest.llm import superkmer_dedup as D

from .helpers import AWKWARD, prose, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, length=20):
    late = float("inf")
    docs = [(late if i is None else i, i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for key, _, w in docs:
        for k in range(len(w) - length + 1):
            x = tuple(w[k : k + length])
            first[x] = min(first.get(x, (late, late)), (key, k))
    out = []
    for key, i, w in docs:
        gone = set()
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < (key, k):
                gone |= set(range(k, k + length))
        out.append((i, len(w), len(gone), sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus():
    r = random.Random(8)
    passages = [prose(k, 60) for k in range(6)]
    rows = list(AWKWARD)
    for k in range(60):
        parts = [prose(100 + k, r.randint(0, 40))] + [" ".join(r.choice(passages).split()[r.randint(0, 30) :][: r.randint(15, 50)]) for _ in range(r.randint(0, 4))] + [prose(200 + k, r.randint(0, 20))]
        rows.append((r.randint(-50, 1000), r.choice([" ", "\n", "  "]).join(parts)))
    rows += [(2000 + k, passages[0] + (f" {k}" if k % 3 else "")) for k in range(30)]
    rows += [(3000, "a b " * 60), (3001, "b a " * 30), (3002, "z " * 19), (3003, "z " * 20), (3004, "z " * 90), (3005, (passages[2] + " ") * 5), (None, passages[1]), (None, passages[1]), (3006, "q" * 3000 + " " + passages[3])]
    rows += [(3010, prose(77, 30) + " " + passages[4]), (3010, passages[4] + " x")]
    return rows


@pytest.mark.parametrize("chunk_bytes,block", [(8 << 20, 1 << 20), (3000, 1 << 20), (8 << 20, 50)])
def test_removal_equals_brute_force(spark, chunk_bytes, block, monkeypatch):
    rows = corpus()
    if block < 1 << 20:  # blocks are cut on one chunk, without Spark
        monkeypatch.setattr(D, "BLOCK", block)
    got = D.remove_windows(table(spark, rows), with_text=False, chunk_bytes=chunk_bytes)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_kept_texts_and_empty_table(spark):
    rows = [(1, prose(1, 30)), (2, "x " + prose(1, 30) + "\n y"), (3, None)]
    docs = table(spark, rows)
    kept = {r.doc_id: bytes(r.kept).decode() for r in D.remove_windows(docs).collect()}
    assert kept == {1: rows[0][1], 2: "x y", 3: ""}
    assert D.remove_windows(docs.limit(0)).count() == 0
