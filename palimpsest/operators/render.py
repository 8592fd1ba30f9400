"""Canonical markup of every view, byte for byte."""

from __future__ import annotations

from ..functions import rules as R
from ..functions.options import Options, playback_step
from .changes import Change

CLASSES = {"chars": "chars", "words": "words", "wordsWithSpace": "words-with-space", "lines": "lines", "sentences": "sentences"}
KINDS = {"-": "removed", "+": "added"}
SIGNS = {"equal": " ", "removed": "−", "moved-from": "−", "added": "+", "moved-to": "+"}
HEAT_LABELS = ("unchanged", "lightly edited", "edited", "heavily edited", "rewritten or new")
NO_CHANGES = '<div class="diff-empty">No changes</div>'


def tag(name: str, inner: str = "", **attributes) -> str:
    """An element; attributes in the given order, None left out, underscores for hyphens."""
    return f"<{name}{''.join(attribute(k, v) for k, v in attributes.items())}>{inner}</{name}>"


def attribute(name: str, value) -> str:
    return "" if value is None else f' {name.strip("_").replace("_", "-")}="{value}"'


def anchor(o: Options, index: int | None) -> str | None:
    return f"{R.escape(o.id_prefix)}-change-{index}" if o.anchors and index is not None else None


def spans(found: list[Change], o: Options, animated: bool = False) -> str:
    out, n = [], 0
    for c in found:
        if not c.value:
            continue
        if c.kind == "=":
            out.append(tag("span", R.escape(c.value)))
        else:
            out.append(tag("span", R.escape(c.value), class_=f"diff-{KINDS[c.kind]}", id=anchor(o, n), data_change_index=n, style=f"--td-i:{n}" if animated else None))
            n += 1
    return "".join(out)


def text(mode: str, found: list[Change], o: Options = Options()) -> str:
    return tag("div", spans(found, o), class_=f"text-diff text-diff-{CLASSES[mode]}")


def playback(mode: str, found: list[Change], o: Options = Options()) -> str:
    ms, p = playback_step(o.speed), R.escape(o.id_prefix)
    inner = tag("div", spans(found, o, animated=True), class_=f"text-diff text-diff-{CLASSES[mode]} text-diff-playback", style=f"--text-diff-playback-step:{ms}ms" if ms else None)
    return f'<div class="text-diff-playback-wrap"><input class="diff-replay-input" type="checkbox" id="{p}-replay"><label class="diff-replay" for="{p}-replay">Replay</label>{inner}</div>'


def collapsed(n: int) -> str:
    return tag("div", "1 unchanged line" if n == 1 else f"{n} unchanged lines", class_="diff-row diff-row-collapsed")


def sign(kind: str) -> str:
    return tag("span", SIGNS[kind], class_="diff-sign", aria_hidden="true")


def label(kind: str, no: int, counterpart) -> str | None:
    if kind == "equal":
        return None
    if kind in ("removed", "added"):
        return f"{kind} line {no}"
    return f"line {no} moved {'to' if kind == 'moved-from' else 'from'} line {counterpart}"


def move_link(kind: str, move: int, counterpart: int, first: bool, o: Options) -> str:
    here, there = ("from", "to") if kind == "moved-from" else ("to", "from")
    p = f"{R.escape(o.id_prefix)}-move-{move}"
    return tag("a", f"moved {there} line {counterpart}", class_="diff-move-link", id=f"{p}-{here}" if first else None, href=f"#{p}-{there}")


def blocks(view: str, found: list[dict], o: Options, row) -> str:
    """Rows of all blocks. The first row of each run of changes gets the next index."""
    out, n, changed = [], 0, False
    for b in found:
        if b["type"] == "collapsed":
            out.append(collapsed(b["count"]))
            continue
        before = None
        for r in b["rows"]:
            index = None
            if r["type"] != "equal" and (before is None or before["type"] == "equal"):
                index, n, changed = n, n + 1, True
            out.append(row(r, index, before, o))
            before = r
    return tag("div", "".join(out) if changed else NO_CHANGES, class_=f"text-diff text-diff-{view}")


def unified_row(r: dict, index, before, o: Options) -> str:
    kind, move = r["type"], r.get("move")
    name = label(kind, r.get("oldNo", r.get("newNo")), r.get("counterpart"))
    inner = tag("span", str(r.get("oldNo", "")), class_="diff-gutter diff-gutter-old") + tag("span", str(r.get("newNo", "")), class_="diff-gutter diff-gutter-new") + sign(kind) + tag("span", R.escape(r["text"]), class_="diff-line")
    if move is not None:
        first = before is None or (before["type"], before.get("move")) != (kind, move)
        inner += move_link(kind, move, r["counterpart"], first, o)
    slot = "" if move is None else f" diff-move-{move % 6}"
    return tag("div", inner, class_=f"diff-row diff-row-{kind}{slot}", id=anchor(o, index), role="group" if name else None, aria_label=name, data_move=move, data_change_index=index)


def unified(found: list[dict], o: Options = Options()) -> str:
    return blocks("unified", found, o, unified_row)


def side(c: dict | None, which: str, first: bool, o: Options) -> str:
    if c is None:
        return tag("div", class_=f"diff-cell diff-cell-{which} diff-cell-empty")
    kind = c["type"]
    name = label(kind, c["lineNo"], c.get("counterpart"))
    if "parts" in c:
        line = "".join(tag("span", R.escape(p["value"]), class_="diff-added" if p["added"] else "diff-removed" if p["removed"] else None) for p in c["parts"] if p["value"])
    else:
        line = R.escape(c["text"])
    inner = tag("span", str(c["lineNo"]), class_="diff-gutter") + sign(kind) + tag("span", line, class_="diff-line")
    if "move" in c:
        inner += move_link(kind, c["move"], c["counterpart"], first, o)
    return tag("div", inner, class_=f"diff-cell diff-cell-{which}" + (f" diff-cell-{kind}" if name else ""), role="group" if name else None, aria_label=name)


def split_row(r: dict, index, before, o: Options) -> str:
    moved = r["type"].startswith("moved")
    move_of = lambda x: (x.get("left") or x.get("right") or {}).get("move")
    move = move_of(r) if moved else None
    first = before is None or (before["type"], move_of(before)) != (r["type"], move)
    inner = side(r.get("left"), "old", first, o) + side(r.get("right"), "new", first, o)
    slot = "" if move is None else f" diff-move-{move % 6}"
    return tag("div", inner, class_=f"diff-row diff-row-{r['type']}{slot}", id=anchor(o, index), data_move=move, data_change_index=index)


def split(found: list[dict], o: Options = Options()) -> str:
    return blocks("split", found, o, split_row)


def stats(s: dict, similarity: float | None = None) -> str:
    def one(kind: str, shown: str, n: int) -> str:
        unit = ("line" if s["unit"] == "lines" else "character") + ("" if n == 1 else "s")
        return tag("span", tag("span", f"{shown}{n}", aria_hidden="true") + tag("span", f"{n} {unit} {kind}", class_="diff-sr"), class_=f"diff-stat diff-stat-{kind}")

    inner = one("added", "+", s["added"]) + one("removed", "−", s["removed"]) + one("unchanged", "=", s["unchanged"])
    if similarity is not None:
        inner += tag("span", f"{R.percent(similarity)}% similar", class_="diff-stat diff-stat-similarity")
    return tag("div", inner, class_="text-diff-stats", data_unit=s["unit"])


def heat_label(s: dict) -> str:
    if s["status"] == "added":
        return "new sentence"
    name = "rewritten" if s["status"] == "rewritten" and s["heat"] == 4 else HEAT_LABELS[s["heat"]]
    return f"{name}, {s['changed']}% changed"


def heatmap(h: dict, o: Options = Options()) -> str:
    out, n, gone, per = [], 0, 0, [0] * 5
    for s in h["segments"]:
        shown = R.escape(s["text"])
        if s["type"] == "gap":
            out.append(tag("span", shown))
        elif s["type"] == "removed":
            if o.show_removed:
                out.append(tag("span", tag("span", "removed sentence: ", class_="diff-sr") + shown, class_="diff-heat-removed", id=anchor(o, n), data_change_index=n, title="removed sentence"))
                n, gone = n + 1, gone + 1
        else:
            per[s["heat"]] += 1
            if s["heat"] == 0:
                out.append(tag("span", shown, class_="diff-heat", data_heat=0))
            else:
                name = heat_label(s)
                out.append(tag("span", shown + tag("span", f" ({name})", class_="diff-sr"), class_="diff-heat", data_heat=s["heat"], id=anchor(o, n), data_change_index=n, title=name))
                n += 1
    inner = tag("div", "".join(out), class_="diff-heat-text")
    if o.legend:
        swatch = tag("span", class_="diff-heat-swatch", aria_hidden="true")
        items = [tag("li", f"{swatch}{HEAT_LABELS[k]} ({c})", class_="diff-heat-key", data_heat=k) for k, c in enumerate(per)]
        if o.show_removed:
            items.append(tag("li", f"{swatch}removed ({gone})", class_="diff-heat-key diff-heat-key-removed"))
        inner += tag("ul", "".join(items), class_="diff-heat-legend", aria_label="Heat legend")
    return tag("div", inner, class_="text-diff text-diff-heatmap")


def minimap(marks: list[dict], o: Options = Options()) -> str:
    p = R.escape(o.id_prefix)
    links = [tag("a", class_=f"diff-minimap-mark diff-minimap-{m['kind']}", href=f"#{p}-change-{m['index']}", style=f"top:{R.format_hundredths(m['top'])};height:{R.format_hundredths(m['height'])}", aria_label=f"Change {m['index'] + 1}: {m['kind']}") for m in marks]
    return tag("nav", "".join(links), class_="text-diff-minimap", aria_label="Change minimap")


def with_minimap(diff: str, strip: str) -> str:
    return tag("div", diff + strip, class_="text-diff-with-minimap")


def view(mode: str, model, o: Options = Options()) -> str:
    return unified(model, o) if mode == "unified" else split(model, o) if mode == "split" else text(mode, model, o)


def timeline(t: dict, o: Options = Options()) -> str:
    from dataclasses import replace

    p, out = R.escape(o.id_prefix), []
    for s in t["steps"]:
        k, caption = s["step"], f"{R.escape(s['fromLabel'])} → {R.escape(s['toLabel'])}"
        last = " checked" if k == len(t["steps"]) else ""
        out.append(f'<input class="diff-rev-input" type="radio" name="{p}-rev" id="{p}-rev-{k}"{last}>')
        out.append(tag("label", caption, class_="diff-rev-label", for_=f"{p}-rev-{k}"))
        body = view(t["mode"], s.get("changes", s.get("hunks")), replace(o, id_prefix=f"{o.id_prefix}-rev-{k}"))
        out.append(tag("div", tag("div", caption, class_="diff-rev-caption") + stats(s["stats"], s["similarity"]) + body, class_="diff-rev-panel", role="group", aria_label=caption))
    return tag("div", "".join(out) or tag("div", "Nothing to compare", class_="diff-empty"), class_="text-diff-timeline", role="group", aria_label="Revision timeline")


def html(inner: str) -> str:
    return tag("div", inner, class_="text-diff text-diff-html")
