"""Minimap marks, timelines and navigation."""

from __future__ import annotations

from itertools import groupby

from ..functions import rules as R
from ..functions.options import Options
from . import changes as C
from . import lines as L


def mark(index: int, kind: str, start: int, end: int, total: int) -> dict:
    top = R.hundredths(start, total)
    return {"index": index, "kind": kind, "top": top, "height": R.hundredths(end, total) - top}


def text_marks(found: list[C.Change]) -> list[dict]:
    """A mark for each change, by its place in the new text."""
    total, at, out = sum(len(c.value) for c in found if c.kind != "-"), 0, []
    for c in found:
        n = 0 if c.kind == "-" else len(c.value)
        if c.value and c.kind != "=":
            out.append(mark(len(out), "removed" if c.kind == "-" else "added", at, at + n, total))
        at += n
    return out


def line_marks(blocks: list[dict]) -> list[dict]:
    """A mark for each run of changed rows, by its place among the new lines."""
    has_new = lambda r: "newNo" in r or "right" in r
    total = sum(b["count"] if b["type"] == "collapsed" else sum(map(has_new, b["rows"])) for b in blocks)
    at, out = 0, []
    for b in blocks:
        if b["type"] == "collapsed":
            at += b["count"]
            continue
        for same, run in groupby(b["rows"], lambda r: r["type"] == "equal"):
            run = list(run)
            n = sum(map(has_new, run))
            if not same:
                kinds = {r["type"] for r in run}
                kind = "added" if kinds == {"added"} else "removed" if kinds == {"removed"} else "moved" if kinds <= {"moved-from", "moved-to"} else "modified"
                out.append(mark(len(out), kind, at, at + n, total))
            at += n
    return out


def timeline(versions: list[str], mode: str = "words", labels=(), o: Options = Options()) -> dict:
    """A step for each pair of consecutive versions; an unknown mode means words."""
    mode = mode if mode in R.VIEWS else "words"
    names = [labels[k] if k < len(labels) and isinstance(labels[k], str) else f"v{k + 1}" for k in range(len(versions))]
    steps = []
    for k in range(1, len(versions)):
        model, stats = L.view(mode, versions[k - 1], versions[k], o)
        step = {"step": k, "fromLabel": names[k - 1], "toLabel": names[k], "stats": stats, "similarity": C.similarity(versions[k - 1], versions[k], html=False)}
        steps.append(step | {"hunks" if mode in ("unified", "split") else "changes": model})
    return {"mode": mode, "labels": names, "steps": steps}


def wrap_index(index: int, count: int) -> int:
    """The place that ``index`` comes to in a ring of ``count`` changes; -1 if there are none."""
    return index % count if count > 0 else -1
