"""Which sentences of a new text are old, edited, rewritten or added, and which old ones are gone."""

from __future__ import annotations

from collections import Counter

from ..functions import rules as R
from ..functions.options import Options
from . import changes as C
from . import engine

#: Sentences a side aligned by similarity, and the least similarity of an aligned pair (fixed values).
MOST_SENTENCES, ALIGNED = 500, 0.5


class Sentence:
    """A sentence's key with what bounds its similarity to others from above."""

    def __init__(self, key: str):
        self.key = key
        text = R.prepare(key, html=False)
        self.size = R.solid_length(text)
        self.words = Counter(R.tokens("words", text)[1])

    def may_reach_half(self, other: "Sentence") -> bool:
        total = self.size + other.size
        if 4 * min(self.size, other.size) < total:
            return False
        return 4 * sum(min(n, other.words[w]) * R.solid_length(w) for w, n in self.words.items() if w in other.words) >= total


def align(old: list[str], new: list[str]) -> tuple[list[tuple[int, int, float]], bool]:
    """Matches (old, new, similarity) in order over two lists of keys, and whether only equal ones were sought."""
    if len(old) > MOST_SENTENCES or len(new) > MOST_SENTENCES:
        out, i, j = [], 0, 0
        for op, n in engine.script(*engine.intern(old, new)):
            if op == engine.EQUAL:
                out += [(i + k, j + k, 1.0) for k in range(n)]
            i, j = i + (n if op != engine.INSERT else 0), j + (n if op != engine.REMOVE else 0)
        return out, True
    a, b = [Sentence(s) for s in old], [Sentence(s) for s in new]
    weight: list[list[float | None]] = []
    for x in a:
        line: list[float | None] = []
        for y in b:
            s = C.similarity(x.key, y.key, html=False) if x.may_reach_half(y) else 0.0
            line.append(s if s >= ALIGNED else None)
        weight.append(line)
    # best[i][j]: the largest sum of weights over the first i and j sentences, added in this order.
    best = [[0.0] * (len(b) + 1)]
    for line in weight:
        above, row = best[-1], [0.0]
        for j, w in enumerate(line):
            top = row[j] if row[j] > above[j + 1] else above[j + 1]
            row.append(above[j] + w if w is not None and above[j] + w > top else top)
        best.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        w = weight[i - 1][j - 1]
        if w is not None and best[i][j] == best[i - 1][j - 1] + w:
            i, j = i - 1, j - 1
            out.append((i, j, w))
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return out[::-1], False


def heatmap(old: str, new: str, o: Options = Options()) -> dict:
    solid = lambda t: R.solid_length(t) > 0
    new_tokens = C.tokenize("sentences", new)
    a, b = [t for t in C.tokenize("sentences", old) if solid(t)], [t for t in new_tokens if solid(t)]
    ka, kb = ([R.lower(t) for t in x] if o.ignore_case else x for x in (a, b))
    head = next((k for k, (x, y) in enumerate(zip(ka, kb)) if x != y), min(len(ka), len(kb)))
    room = min(len(ka), len(kb)) - head
    tail = next((k for k in range(room) if ka[-1 - k] != kb[-1 - k]), room)
    middle, exact = align(ka[head : len(ka) - tail], kb[head : len(kb) - tail])
    matches = [(k, k, 1.0) for k in range(head)] + [(head + i, head + j, s) for i, j, s in middle] + [(len(ka) - tail + k, len(kb) - tail + k, 1.0) for k in range(tail)]
    partner = {j: (i, s) for i, j, s in matches}
    gone: dict[int, list[int]] = {}  # new sentence (or the end) before which old ones are gone
    pi = pj = 0
    for i, j, _ in [*matches, (len(a), len(b), 0.0)]:
        pairs = min(i - pi, j - pj)
        partner |= {pj + k: (pi + k, C.similarity(ka[pi + k], kb[pj + k], html=False)) for k in range(pairs)}
        if i > pi + pairs:
            gone.setdefault(j, []).extend(range(pi + pairs, i))
        pi, pj = i + 1, j + 1
    segments, at = [], 0
    lost = lambda j: [{"type": "removed", "text": a[i]} for i in gone.get(j, ())]
    for t in new_tokens:
        if not solid(t):
            segments.append({"type": "gap", "text": t})
            continue
        segments += lost(at)
        if at in partner:
            i, s = partner[at]
            heat = R.heat_level(s)
            segments.append({"type": "sentence", "text": t, "heat": heat, "status": "unchanged" if heat == 0 else "edited" if s >= 0.5 else "rewritten", "similarity": s, "changed": R.changed_percent(s), "old": a[i]})
        else:
            segments.append({"type": "sentence", "text": t, "heat": 4, "status": "added", "similarity": 0.0, "changed": 100})
        at += 1
    return {"segments": segments + lost(len(b)), "exact": exact}
