import re

import pytest

from palimpsest.llm.decontaminate import decontaminate, spans

from .helpers import AWKWARD, prose, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, window=10):
    out = []
    for i, t in docs:
        w = words(t)
        hit, got = set(), set()
        for item, text in items:
            x = words(text)
            size = min(window, len(x))
            for a in range(len(x) - size + 1 if size else 0):
                for b in range(len(w) - size + 1):
                    if w[b : b + size] == x[a : a + size]:
                        hit |= set(range(b, b + size))
                        got.add(str(item))
        out.append((i, len(w), len(hit), sorted(got)))
    return sorted(out, key=str)


ITEMS = [(1, prose(50, 30)), (2, prose(51, 9)), (3, prose(52, 10)), (4, None), (5, ""), (6, "!!"), (7, "Xylo"), (8, "two words"), (9, prose(50, 30)), (10, "a a a a a a a a a a a a"), (100, "b " + prose(50, 30))]


def sample_docs():
    rows = list(AWKWARD)
    rows += [(20, prose(60, 20) + " " + ITEMS[0][1] + " " + prose(61, 5)), (21, ITEMS[1][1].upper() + "!"), (22, "x " + " ".join(ITEMS[0][1].split()[3:14])), (23, " ".join(ITEMS[0][1].split()[3:12])), (24, "hear XYLO, two\nwords; two word"), (25, "a " * 30), (25, "a " * 30), (26, ITEMS[2][1][:-2]), (None, ITEMS[2][1])]
    return rows


@pytest.mark.parametrize("block_bytes", [4 << 20, 100])
def test_spans_equal_brute_force(spark, block_bytes):
    rows = sample_docs()
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = spans(table(spark, rows), bench, block_bytes=block_bytes)
    flat = [(r.doc_id, r.n_words, sum(b - a for a, b in r.spans), r["items"]) for r in got.collect()]
    assert sorted(flat, key=str) == brute(rows, ITEMS)


def test_filter_keeps_clean_rows_and_columns(spark):
    rows = sample_docs()
    docs = table(spark, rows)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    clean = decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in clean.collect()) == sorted((i or 0) for i, _, h, _ in brute(rows, ITEMS) if not h)
    assert decontaminate(docs, bench.limit(0)).count() == len(rows)
    assert spans(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("block_bytes", [4 << 20, 100])
def test_items_without_an_id_hit_but_are_not_listed(spark, block_bytes):
    items = [*ITEMS, (None, prose(53, 30)), (None, prose(54, 12)), (None, ITEMS[0][1]), (None, None)]
    rows = [*sample_docs(), (40, "x " + prose(53, 30) + " y"), (41, prose(54, 12)), (42, prose(61, 25))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = spans(table(spark, rows), bench, block_bytes=block_bytes)
    flat = [(r.doc_id, r.n_words, sum(b - a for a, b in r.spans), r["items"]) for r in got.collect()]
    want = [(i, n, hit, [x for x in names if x != "None"]) for i, n, hit, names in brute(rows, items)]
    assert sorted(flat, key=str) == sorted(want, key=str)
    assert {i: hit for i, _, hit, _ in flat}[41] == 12
    kept = {r.doc_id for r in decontaminate(table(spark, rows), bench, block_bytes=block_bytes).collect()}
    assert 42 in kept and not {40, 41} & kept
