"""Data for interactive views, navigation, option keys and the entry points."""

import random
import re
from dataclasses import replace

import pytest

from palimpsest import api
from palimpsest.functions import rules as R
from palimpsest.functions.options import Options
from palimpsest.operators import changes as C
from palimpsest.operators import lines as L
from palimpsest.operators import models as M
from palimpsest.operators import render as V
from palimpsest.operators import views as W

from .test_views import line_texts


def test_items_agree_with_the_markup():
    r = random.Random(11)
    for k in range(300):
        a, b = line_texts(r), line_texts(r)
        o = Options(context_lines=r.choice([0, 1, 3]), detect_moves=True)
        for view, blocks in (("unified", L.hunks(a, b, o)), ("split", L.split_hunks(a, b, o))):
            m, html = M.line_items(blocks), V.view(view, blocks, replace(o, anchors=True))
            numbers = [i["changeIndex"] for i in m["items"] if i["kind"] == "row" and i["changeIndex"] is not None]
            assert numbers == list(range(m["count"])) == [int(x) for x in re.findall(r'data-change-index="(\d+)"', html)] and m["hasChanges"] == bool(numbers)
            if m["hasChanges"]:
                first = {(kind, int(n)) for n, kind in re.findall(r'id="td-move-(\d+)-(from|to)"', html)}
                assert {(i["row"]["type"].removeprefix("moved-"), M.move_of(i["row"])) for i in m["items"] if i["kind"] == "row" and i["firstOfMove"]} == first
            assert m["marks"] == W.line_marks(blocks)
            whole = M.expanded(m, {i["block"] for i in m["items"] if i["kind"] == "collapsed"}, view == "split")
            assert all(i["kind"] == "row" for i in whole) and M.expanded(m, ()) == m["items"]
            news = [x["text"] for i in whole for x in [i["row"].get("right", i["row"]) if view == "split" else i["row"]] if x.get("newNo") or view == "split" and "right" in i["row"]]
            assert news == [R.display(t) for t in R.split_lines(b)]
            assert len({i["key"] for i in whole}) == len(whole)


def test_links_and_heat_items():
    marks = W.text_marks(C.changes("words", "pear fig", "pear nut"))
    assert [(x["href"], x["label"]) for x in M.minimap_links(marks, "q")] == [("#q-change-0", "Change 1: removed"), ("#q-change-1", "Change 2: added")]
    assert all(x["style"] in V.minimap(marks) and x["className"] in V.minimap(marks) for x in M.minimap_links(marks))
    old, new = "The hen sat there. It rained all day. Bye now.", "The hen sat here. Bye now. A new one came."
    for o in (Options(), Options(show_removed=False)):
        from palimpsest.operators import heatmap as H

        m, html = M.heat_items(old, new, o), V.heatmap(H.heatmap(old, new, o), o)
        assert m["count"] == html.count("data-change-index") and all(x["text"] in html for x in m["legend"]) and len(m["legend"]) == 5 + o.show_removed
        assert "".join(x["text"] for x in m["items"] if x["kind"] != "removed") == new
        assert all(x["label"] in html for x in m["items"]) and {x["kind"] for x in m["items"]} >= {"gap", "sentence"}


def test_timeline_steps_and_options():
    t = M.timeline_steps(["a", "b", "c"], [None, "draft"], "odd")
    assert t == {"mode": "words", "steps": [{"step": 1, "oldText": "a", "newText": "b", "caption": "v1 → draft"}, {"step": 2, "oldText": "b", "newText": "c", "caption": "draft → v3"}]}
    assert M.timeline_steps([], mode="split") == {"mode": "split", "steps": []}
    assert M.line_view_options(contextLines=2, detectMoves=True, ignoreCase=True) == {"contextLines": 2, "moves": {"detectMoves": True, "minMoveLines": None, "moveSimilarity": None}, "options": {"ignoreCase": True}}
    assert M.option_key({"b": 1, "a": {"d": [2, 1], "c": "é"}}) == M.option_key({"a": {"c": "é", "d": [2, 1]}, "b": 1}) == '{"a":{"c":"é","d":[2,1]},"b":1}'
    assert M.from_key(M.option_key({"x": [1, None]})) == {"x": [1, None]} and M.option_key(None) == "null"
    assert M.option_key(Options()) == M.option_key(Options.of()) != M.option_key(Options.of(ignoreCase=True))


def test_navigation():
    p = M.Place(3)
    seen = [p := p.next() for _ in range(4)]
    assert [x.at for x in seen] == [0, 1, 2, 0] and p.previous().at == 2 and M.Place(3).previous().at == 2
    assert p.go_to(-1).at == 2 and p.go_to(7).at == 1 and p.reset().at == -1
    assert M.Place(0).next().at == M.Place(0).previous().at == M.Place(0).go_to(5).at == -1


def test_entry_points(spark):
    rows = [(1, "red fox\n", "red hen\n"), (2, "", "a b. c d."), (3, "same", "same"), (4, None, "x")]
    frame = spark.createDataFrame(rows, "k int, old string, new string")
    columns = {n: getattr(api, n)("old", "new") for n in api.ENTRY_POINTS if n != "timeline"}
    got = {r.k: r for r in frame.select("k", *[c.alias(n) for n, c in columns.items()], api.stats("old", "new", "unified", with_similarity=False).alias("plain")).collect()}
    assert len(api.ENTRY_POINTS) == 13 and all(got[4][n] is None for n in columns)
    assert got[1].words == V.text("words", C.changes("words", "red fox\n", "red hen\n")) and got[1].similarity == C.similarity("red fox\n", "red hen\n")
    assert got[1].stats.endswith("% similar</span></div>") and "similar" not in got[1].plain and 'data-unit="lines"' in got[1].plain
    assert got[3].unified == V.unified(L.hunks("same", "same")) and "playback" in got[2].playback
    t = api.timeline(frame.filter("k < 4").selectExpr("'d' as d", "k", "new"), "d", "k", "new").collect()
    assert len(t) == 1 and t[0].html == V.timeline(W.timeline([x[2] for x in rows[:3]]))
    with pytest.raises(ValueError):
        api.playback("old", "new", "unified")
