"""What interactive views need besides markup: numbered items, legends, links, steps and navigation.

Everything is plain data, so it can also be a column (``frames``) or be kept as JSON.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from ..functions import rules as R
from ..functions.options import Options
from . import heatmap as H
from . import lines as L
from . import render as V
from .views import line_marks, wrap_index


def shown_row(row: dict) -> dict:
    """A row with its texts as they are displayed."""
    out = dict(row)
    for k in ("text", "value"):
        if k in out:
            out[k] = R.display(out[k])
    for k in ("left", "right"):
        if k in out:
            out[k] = shown_row(out[k])
    if "parts" in out:
        out["parts"] = [shown_row(p) for p in out["parts"]]
    return out


def move_of(row: dict) -> int | None:
    """The move that a unified or paired row belongs to."""
    side = {"moved-from": "left", "moved-to": "right"}.get(row["type"])
    return row.get("move", row.get(side, {}).get("move")) if side else None


def line_items(blocks: list[dict]) -> dict:
    """Items of unified or paired blocks: rows with the number of the change that they begin, and folded blocks."""
    items, n = [], 0
    for at, b in enumerate(blocks):
        if b["type"] == "collapsed":
            items.append({"kind": "collapsed", "key": f"c{at}", "block": at, "count": b["count"], "rows": [shown_row(r) for r in b["rows"]]})
            continue
        for k, row in enumerate(b["rows"]):
            before = b["rows"][k - 1] if k else None
            begins = row["type"] != "equal" and (before is None or before["type"] == "equal")
            move = move_of(row)
            first = move is not None and (before is None or (before["type"], move_of(before)) != (row["type"], move))
            items.append({"kind": "row", "key": f"h{at}-{k}", "row": shown_row(row), "changeIndex": n if begins else None, "firstOfMove": first})
            n += begins
    return {"items": items, "hasChanges": n > 0, "count": n, "marks": line_marks(blocks)}


def expanded(model: dict, open_blocks, split: bool = False) -> list[dict]:
    """The items with the rows of the opened folded blocks in their place; nothing is numbered anew."""
    out = []
    for item in model["items"]:
        if item["kind"] == "collapsed" and item["block"] in open_blocks:
            rows = L.paired(item["rows"]) if split else item["rows"]
            out += [{"kind": "row", "key": f"{item['key']}-{k}", "row": r, "changeIndex": None, "firstOfMove": False} for k, r in enumerate(rows)]
        else:
            out.append(item)
    return out


def minimap_links(marks: list[dict], id_prefix: str = "td") -> list[dict]:
    place = lambda m: f"top:{R.format_hundredths(m['top'])};height:{R.format_hundredths(m['height'])}"
    return [{"key": m["index"], "className": f"diff-minimap-mark diff-minimap-{m['kind']}", "href": f"#{id_prefix}-change-{m['index']}", "style": place(m), "label": f"Change {m['index'] + 1}: {m['kind']}"} for m in marks]


def heat_items(old: str, new: str, o: Options = Options()) -> dict:
    """Sentences as displayed, with labels and change numbers; the legend; the number of changes."""
    items, n, gone, per = [], 0, 0, [0] * 5
    for s in H.heatmap(old, new, o)["segments"]:
        if s["type"] == "removed" and not o.show_removed:
            continue
        heat = s.get("heat", 0)
        changed = s["type"] == "removed" or heat > 0
        label = "removed sentence" if s["type"] == "removed" else V.heat_label(s) if changed else ""
        items.append({"kind": s["type"], "text": R.display(s["text"]), "heat": heat, "changeIndex": n if changed else None, "label": label})
        n, gone = n + changed, gone + (s["type"] == "removed")
        per[heat] += s["type"] == "sentence"
    legend = [{"key": f"h{k}", "className": "diff-heat-key", "heat": k, "text": f"{V.HEAT_LABELS[k]} ({c})"} for k, c in enumerate(per)]
    if o.show_removed:
        legend.append({"key": "removed", "className": "diff-heat-key diff-heat-key-removed", "text": f"removed ({gone})"})
    return {"items": items, "legend": legend, "count": n}


def timeline_steps(versions: list[str], labels=(), mode: str = "words") -> dict:
    """The steps of a timeline by their texts and captions, before anything is compared."""
    names = [labels[k] if k < len(labels) and isinstance(labels[k], str) else f"v{k + 1}" for k in range(len(versions))]
    steps = [{"step": k, "oldText": versions[k - 1], "newText": versions[k], "caption": f"{names[k - 1]} → {names[k]}"} for k in range(1, len(versions))]
    return {"mode": mode if mode in R.VIEWS else "words", "steps": steps}


def line_view_options(**options) -> dict:
    """Options of a line view in their three groups: context, moves, the rest."""
    moves = ("detectMoves", "minMoveLines", "moveSimilarity")
    rest = {k: v for k, v in options.items() if k not in (*moves, "contextLines")}
    return {"contextLines": options.get("contextLines"), "moves": {k: options.get(k) for k in moves}, "options": rest}


def option_key(options: dict | Options | None) -> str:
    """One string for equal options, whatever the order of their names (for caches)."""
    plain = asdict(options) if isinstance(options, Options) else options
    return json.dumps(plain, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def from_key(key: str):
    return json.loads(key)


@dataclass(frozen=True)
class Place:
    """Where a reader is among ``count`` changes; -1 before the first step and where there are none."""

    count: int
    at: int = -1

    def go_to(self, index: int) -> Place:
        return Place(self.count, wrap_index(index, self.count))

    def next(self) -> Place:
        return self.go_to(self.at + 1)

    def previous(self) -> Place:
        return self.go_to(self.at - 1 if self.at >= 0 else self.count - 1)

    def reset(self) -> Place:
        return Place(self.count)
