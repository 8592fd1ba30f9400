"""Text modes: given cases (if a folder of them is named), hand examples, slow twins, and the same search in SQL."""

import json
import os
import random

import duckdb
import pytest

from palimpsest.functions import rules as R
from palimpsest.functions.options import Options
from palimpsest.operators import changes as C
from palimpsest.operators import engine
from palimpsest.plans import queries as Q

FOLDER = os.environ.get("PALIMPSEST_FIXTURES", "")


def cases(name):
    """Cases of a JSON file: name, old, new, options, expected; none without a folder."""
    path = f"{FOLDER}/{name}.json"
    if not FOLDER or not os.path.exists(path):
        return []
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def result(mode, case):
    got = C.changes(mode, case["old"], case["new"], Options.of(**case["options"]))
    return {"changes": [c.record() for c in got], "stats": C.stats(got)}


@pytest.mark.parametrize("mode", R.MODES)
def test_changes_and_stats(mode):
    for case in cases(mode):
        got = result(mode, case)
        assert (got["changes"], got["stats"]) == (case["expected"]["changes"], case["expected"]["stats"]), case["name"]


def test_similarity():
    for case in cases("similarity"):
        e = case["expected"]
        assert C.similarity(case["old"], case["new"]) == pytest.approx(e["similarity"], abs=1e-12)
        assert C.similarity(case["old"], case["new"], html=False) == pytest.approx(e["similarityText"], abs=1e-12)
        assert C.stats(C.changes("words", case["old"], case["new"])) == e["stats"]


@pytest.mark.parametrize("mode", R.MODES)
def test_written_cases_do_not_drift(mode, tmp_path, monkeypatch):
    """Cases written to a file and read back give what they gave; a changed result is noticed."""
    r = random.Random(mode)
    made = []
    for k in range(25):
        case = {"name": f"case {k}", "old": "".join(r.choice(FRAGMENTS) for _ in range(r.randint(0, 9))), "new": "".join(r.choice(FRAGMENTS) for _ in range(r.randint(0, 9))), "options": {"ignoreCase": True} if k % 3 == 0 else {}}
        made.append(case | {"expected": result(mode, case)})
    (tmp_path / f"{mode}.json").write_text(json.dumps(made), encoding="utf-8")
    monkeypatch.setitem(globals(), "FOLDER", str(tmp_path))
    assert cases(mode) == made
    test_changes_and_stats(mode)
    made[3]["expected"]["stats"]["added"] += 1
    (tmp_path / f"{mode}.json").write_text(json.dumps(made), encoding="utf-8")
    with pytest.raises(AssertionError):
        test_changes_and_stats(mode)


@pytest.mark.parametrize("mode", R.MODES)
def test_changes_equal_the_search_in_sql(mode):
    r = random.Random(mode)
    parts = ["a", "b", "cc", "d,", "(e)", " ", "  ", "\n", " \n", "\t", "e. ", "f! ", "\r\n"]
    rows = []
    for k in range(400):
        a = [r.choice(parts) for _ in range(r.randint(0, 14))]
        b = list(a) if r.random() < 0.6 else [r.choice(parts) for _ in range(r.randint(0, 14))]
        for _ in range(r.randint(0, 3)):
            b.insert(r.randint(0, len(b)), r.choice(parts)) if r.random() < 0.5 or not b else b.pop(r.randrange(len(b)))
        rows.append((k, "".join(a), "".join(b)))
    c = duckdb.connect()
    c.execute("create table pairs (id bigint, old varchar, new varchar)")
    c.executemany("insert into pairs values (?, ?, ?)", rows)
    got = {k: [] for k, _, _ in rows}
    for k, op, n, value in c.execute(f"{Q._found(mode, 'pairs', 'id')} SELECT id, op, n, value FROM found ORDER BY id, run").fetchall():
        got[k].append(("=+-"[op], n, value))
    for k, a, b in rows:
        assert got[k] == [(x.kind, x.count, x.value) for x in C.changes(mode, a, b)], (a, b)


def literal(a, b, limit=None):
    """Slow search by paths held in a dictionary, for comparison."""
    n, m = len(a), len(b)
    top = n + m if limit is None else min(limit, n + m)

    def slide(x, k, ops):
        y, run = x - k, 0
        while x + 1 < n and y + 1 < m and a[x + 1] == b[y + 1]:
            x, y, run = x + 1, y + 1, run + 1
        return x, y, ops + [0] * run

    def runs(ops):
        out = []
        for o in ops:
            if out and out[-1][0] == o:
                out[-1] = (o, out[-1][1] + 1)
            else:
                out.append((o, 1))
        return out

    x, y, ops = slide(-1, 0, [])
    if x + 1 >= n and y + 1 >= m:
        return runs(ops)
    best, lo, hi = {0: (x, ops)}, -(10**9), 10**9
    for d in range(1, top + 1):
        k = max(lo, -d)
        while k <= min(hi, d):
            rem, add = best.pop(k - 1, None), best.get(k + 1)
            can_add = add is not None and 0 <= add[0] - k < m
            can_rem = rem is not None and rem[0] + 1 < n
            if can_add or can_rem:
                x, ops = (add[0], add[1] + [1]) if not can_rem or (can_add and rem[0] < add[0]) else (rem[0] + 1, rem[1] + [-1])
                x, y, ops = slide(x, k, ops)
                if x + 1 >= n and y + 1 >= m:
                    return runs(ops)
                best[k] = (x, ops)
                if x + 1 >= n:
                    hi = min(hi, k - 1)
                if y + 1 >= m:
                    lo = max(lo, k + 1)
            else:
                best.pop(k, None)
            k += 2
    return None


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize("wide", [96, 2])
def test_search_equals_the_literal_one_and_is_shortest(wide, monkeypatch):
    monkeypatch.setattr(engine, "WIDE", wide)
    r = random.Random(wide)
    for _ in range(1500):
        size = r.randint(2, 8)
        a = [r.randrange(size) for _ in range(r.randint(0, 40))]
        b = list(a) if r.random() < 0.5 else [r.randrange(size) for _ in range(r.randint(0, 40))]
        for _ in range(r.randint(0, 12)):
            if b and r.random() < 0.5:
                del b[r.randrange(len(b))]
            else:
                b.insert(r.randint(0, len(b)), r.randrange(size))
        limit = r.choice([None, None, 0, 3, 10])
        got = engine.script(*engine.intern(a, b), limit)
        assert got == literal(a, b, limit), (a, b, limit)
        if got is not None:
            assert sum(n for o, n in got if o) == len(a) + len(b) - 2 * lcs(a, b)


@pytest.mark.parametrize("held", [engine.HELD, 1, 200])
def test_the_table_gives_the_script_of_the_search(held, monkeypatch):
    monkeypatch.setattr(engine, "HELD", held)
    r = random.Random(held)
    for _ in range(1500):
        size = r.choice([1, 2, 5, 30])
        a, b = ([r.randrange(size) for _ in range(r.randint(1, 40))] for _ in range(2))
        limit = r.choice([99, 99, 3, 20])
        a, b = (a, b) if a[0] != b[0] else ([size, *a], [size + 1, *b])
        assert engine.bits(a, b, limit) == literal(a, b, limit), (a, b, limit)


def test_many_edits_do_not_take_the_search_by_diagonals(monkeypatch):
    """The square of 2,000 edits took a second a pair."""
    limits, search = [], engine.search
    monkeypatch.setattr(engine, "search", lambda a, b, limit: limits.append(limit) or search(a, b, limit))
    r = random.Random(5)
    a, b = ([r.randrange(300) for _ in range(1500)] for _ in range(2))
    ops = engine.script(*engine.intern(a, b))
    assert max(limits, default=0) < 150
    assert sum(n for o, n in ops if o) == len(a) + len(b) - 2 * lcs(a, b)
    few = a[:700] + [300] + a[720:]
    assert engine.script(*engine.intern(a, few)) == [(0, 700), (-1, 20), (1, 1), (0, 780)] and engine.script(*engine.intern(a, b), 150) is None


def test_similarity_needs_no_change_list(monkeypatch):
    """It follows from the edit script: the change list's white space, which took most of the time, never counts."""
    r = random.Random(6)
    parts = ["a", "b", "cat", " ", "  ", "\n", "\x1c", "\x85", "\ufeff", "\u201c", "\u2019", '"', ".", "\u00e9", "\u00ad", "<b>", "</p>", "<", "\ud800"]
    pairs = [tuple("".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(2)) for _ in range(1500)]
    want = []
    for old, new in pairs:
        for html in (True, False):
            a, b = R.prepare(R.scrub(old), html), R.prepare(R.scrub(new), html)
            want.append(C.similarity_of(C.changes("words", a, b), a, b) if a and b else float(not a and not b))
    monkeypatch.setattr(C, "changes", None)
    assert [C.similarity(old, new, html) for old, new in pairs for html in (True, False)] == want


def test_unlike_texts_are_rebuilt_without_a_long_search(monkeypatch):
    limits, search = [], engine.search
    monkeypatch.setattr(engine, "search", lambda a, b, limit: limits.append(limit) or search(a, b, limit))
    r = random.Random(10)
    texts = [" ".join(r.choice(("la", "le ", "de\r\n", "eau.", "un\t")) + str(r.randrange(60)) for _ in range(500)) for _ in range(4)]
    for old in texts:
        for new in texts:
            c = C.changes("wordsWithSpace", old, new)
            assert "".join(x.value for x in c if x.kind != "-") == new and "".join(x.value for x in c if x.kind != "+") == old
    assert max(limits, default=0) < 150


def test_equal_texts_need_no_numbers_and_runs_no_objects(monkeypatch):
    """At 1 GB many pairs are copies, and unlike texts have a change every few tokens."""
    r = random.Random(20)
    texts = ["", " ", *(" ".join(r.choice(("la", "le ", "de\r\n", "eau!", "un\t")) + str(r.randrange(30)) for _ in range(60)) for _ in range(3))]
    want = {(m, a, b, limit): C.changes(m, a, b, Options.of(maxEditLength=limit)) for m in R.MODES for a in texts for b in texts for limit in (None, 20)}
    monkeypatch.setattr(engine, "intern", lambda a, b, f=engine.intern: f(a, b) if a != b else pytest.fail("equal texts are numbered"))
    monkeypatch.setattr(C, "Change", lambda *c, f=C.Change: f(*c) if m == "words" else pytest.fail("an object a change"))
    for (m, a, b, limit), found in want.items():
        values, ops, counts = C.columns(m, a, b, Options.of(maxEditLength=limit))
        assert [(v, "=+-"[o], n) for v, o, n in zip(values, ops, counts)] == [tuple(c) for c in found], (m, a, b, limit)


@pytest.mark.parametrize("held", [engine.HELD, 3000])
def test_the_table_of_long_texts_with_tokens_of_one_side(held, monkeypatch):
    monkeypatch.setattr(engine, "HELD", held)
    r = random.Random(held)
    for _ in range(150):
        size, other = r.choice([3, 30, 300]), r.choice([0, 20, 200])
        a, b = ([0 if r.random() < 0.3 else r.randrange(size) + start for _ in range(r.randint(60, 250))] for start in (0, other))
        a, b = engine.intern([-1, *a], [-2, *b])
        got = engine.bits(a, b, len(a) + len(b))
        assert got == engine.retrace(a, b, engine.search(a, b, len(a) + len(b))), (a, b)
        edits = sum(n for o, n in got if o)
        assert engine.bits(a, b, edits) == got and engine.bits(a, b, edits - 1) is None


def test_hand_examples():
    show = lambda mode, a, b: [c.kind + c.value for c in C.changes(mode, a, b)]
    assert show("chars", "ab", "ba") == ["-a", "=b", "+a"]
    assert show("chars", "abc", "cab") == ["+c", "=ab", "-c"]
    assert show("chars", "xaby", "xbay") == ["=x", "-a", "=b", "+a", "=y"]
    assert show("chars", "a", "aa") == ["=a", "+a"]
    assert engine.script(*engine.intern([7, 1, 2], [8, 1, 2, 1, 2])) == [(-1, 1), (1, 1), (0, 2), (1, 2)]
    for old, new, want in [
        ("foo bar baz", "foo baz", ["=foo ", "-bar ", "=baz"]),
        ("foo bar baz", "foo qux baz", ["=foo ", "-bar", "+qux", "= baz"]),
        ("foo\nbar baz", "foo baz", ["=foo", "-\nbar", "= baz"]),
        ("foo baz", "foo\nbar baz", ["=foo\n", "+bar ", "=baz"]),
        ("foo   bar baz", "foo  baz", ["=foo  ", "- bar ", "=baz"]),
        ("foo bar", "bar", ["-foo ", "=bar"]),
        ("foo bar", "foo", ["=foo", "- bar"]),
        ("Hello, world!", "Hello world!", ["=Hello", "-,", "= world!"]),
    ]:
        assert show("words", old, new) == want
    assert C.similarity("abc defghij", "abc klmnopq") == 0.3
    assert (C.similarity("cc b", "b!cc", False), C.similarity("b!cc", "cc b", False)) == (2 / 7, 4 / 7)


FRAGMENTS = ["a", "B", "é", "Σ", "İ", "😀", "東", " ", "\n", "\r\n", "\r", "\t", " ", "　", ". ", "! ", "?\n", "<", ">", "&", "ab ", "word", "é"]


def test_rebuild_and_shape():
    r = random.Random(12)
    for _ in range(1500):
        a, b = ("".join(r.choice(FRAGMENTS) for _ in range(r.randint(0, 14))) for _ in range(2))
        for mode in R.MODES:
            got = C.changes(mode, a, b)
            assert all(c.value for c in got) and all(x.kind != y.kind for x, y in zip(got, got[1:]))
            assert sum(c.count for c in got if c.kind != "+") == len(C.tokenize(mode, a))
            assert sum(c.count for c in got if c.kind != "-") == len(C.tokenize(mode, b))
            if mode != "words":
                assert "".join(c.value for c in got if c.kind != "+") == a
                assert "".join(c.value for c in got if c.kind != "-") == b
            else:
                assert R.trim("".join(R.tokens("words", "".join(c.value for c in got if c.kind != "-"))[1])) == R.trim("".join(R.tokens("words", b)[1]))
        s = C.similarity(a, b)
        assert 0 <= s <= 1 and C.similarity(a, a) == 1


def test_scrub_and_lower():
    assert R.scrub(b"a\xe2\x82b") == "a�b" and R.scrub(b"\xed\xa0\x80") == "�" * 3 and R.scrub(b"\xc0\xaf") == "�" * 2
    assert R.scrub("x\ud800y") == "x�y"
    assert R.lower("ΣΟΦΟΣ") == "σοφος" and R.lower("Σ") == "σ" and R.lower("İ") == "i̇" and R.lower("Ɤ") == "ɤ"
