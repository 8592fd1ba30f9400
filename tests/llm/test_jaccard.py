import random
import re

import numpy as np
import pytest

from palimpsest.llm import jaccard as J
from palimpsest.llm.components import connected_components

from .helpers import AWKWARD, prose, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets(rows, size):
    out = []
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append((i, frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()))
    return out


def brute(rows, size, num, den):
    s = sets(rows, size)
    links = [[b for b in range(len(s)) if b != a and s[a][1] and s[b][1] and den * len(s[a][1] & s[b][1]) >= num * len(s[a][1] | s[b][1])] for a in range(len(s))]
    label = list(range(len(s)))
    for a in range(len(s)):
        stack, seen = [a], {a}
        while stack:
            for b in links[stack.pop()]:
                if b not in seen:
                    seen.add(b)
                    stack.append(b)
        ids = [s[k][0] for k in seen if s[k][0] is not None]
        label[a] = min(ids) if ids and s[a][1] else s[a][0]
    return sorted(((s[a][0], len(s[a][1]), label[a], len(links[a])) for a in range(len(s))), key=str)


def corpus():
    r = random.Random(2)
    rows = list(AWKWARD)
    for family in range(8):
        base = prose(family, r.randint(8, 160)).split()
        for k in range(r.randint(2, 14)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                w[r.randrange(len(w))] = r.choice(["ZZ", "new", "word", str(r.random())])
            rows.append((family * 100 + k + 20, " ".join(w[: len(w) - r.choice([0, 0, 0, 5])])))
    shared = prose(99, 30)
    rows += [(2000 + k, prose(300 + k, 60) + " " + shared) for k in range(15)]
    rows += [(2100 + k, shared.upper() + (" x" * (k % 3))) for k in range(6)]
    rows += [(None, shared), (None, ""), (2200, "two words"), (2201, "Two  Words"), (2202, "a a a a a a a a"), (2203, "a a a a a")]
    return rows


@pytest.mark.parametrize("size,num,den,tile", [(4, 85, 100, 500_000), (5, 80, 100, 150), (4, 50, 100, 60)])
def test_classes_equal_brute_force(spark, size, num, den, tile, monkeypatch):
    monkeypatch.setattr(J, "TILE", tile)
    rows = corpus()
    got = J.classes(table(spark, rows), size, num, den, chunk_bytes=4000)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, size, num, den)


def test_first_of_classes_and_empty_tables(spark):
    rows = corpus()
    docs = table(spark, rows)
    kept = J.first_of_classes(docs)
    assert kept.columns == docs.columns
    want = sorted((str(i) for i, _, c, _ in brute(rows, 5, 80, 100) if i is None or i == c))
    assert sorted(str(r.doc_id) for r in kept.collect()) == want
    assert J.classes(docs.limit(0)).count() == 0


def test_bitmap_bound_never_loses_a_pair():
    r = np.random.Generator(np.random.PCG64(4))
    base = r.integers(0, 1 << 62, 400, dtype=np.uint64)
    parts = [np.unique(np.concatenate((r.choice(base, r.integers(100, 399), replace=False), r.integers(0, 1 << 62, 10, dtype=np.uint64)))) for _ in range(40)]
    got = {frozenset((i, int(j))) for i, js in J.tile_links(parts, np.full(40, 2), 7, 10) for j in js}
    want = {frozenset((a, b)) for a in range(40) for b in range(a) if 10 * len(x := np.intersect1d(parts[a], parts[b])) >= 7 * (len(parts[a]) + len(parts[b]) - len(x))}
    assert got == want and want


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(60)] + [(k, k + 1) for k in range(200, 240)] + [(300, 300)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()))
    want = {x: find(x) for e in edges for x in e if e[0] != e[1]}
    assert got == want
