"""The Spark side: native columns equal the Python rules, plans equal the models, streams equal batches."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from palimpsest.functions import columns as N
from palimpsest.functions import rules as R
from palimpsest.functions import sql
from palimpsest.functions.options import Options
from palimpsest.operators import changes as C
from palimpsest.operators import frames as K
from palimpsest.operators import heatmap as H
from palimpsest.operators import html as D
from palimpsest.operators import lines as L
from palimpsest.operators import render as V
from palimpsest.operators import views as W
from palimpsest.plans import lines as LN
from palimpsest.plans import timeline as T
from palimpsest.streaming import timeline as S

from .test_text_fixtures import FRAGMENTS
from .test_views import line_texts


@pytest.fixture(scope="module")
def texts():
    r = random.Random(7)
    return ["", " ", "\n", " \t", "a.b. c", "End.\n", "x\x1ey. z"] + ["".join(r.choice(FRAGMENTS) for _ in range(r.randint(0, 14))) for _ in range(300)]


def test_native_rules(spark, texts):
    t = spark.createDataFrame([(k, x) for k, x in enumerate(texts)] + [(-1, None)], "k int, t string")
    plain = {"trim": (N.trim("t"), R.trim), "collapse": (N.collapse("t"), R.collapse), "quotes": (N.normalize_quotes("t"), R.normalize_quotes), "prepare": (N.prepare("t"), R.prepare), "text": (N.prepare("t", False), lambda s: R.prepare(s, False)),
             "solid": (N.solid_length("t"), R.solid_length), "escape": (N.escape("t"), R.escape), "display": (N.display("t"), R.display), "lines": (N.split_lines("t"), R.split_lines), "lower": (N.lower("t"), R.lower)}
    for m in R.MODES:
        plain[f"tokens_{m}"] = (N.tokens(m, "t"), lambda s, m=m: R.tokens(m, s)[0])
        plain[f"keys_{m}"] = (N.keys(m, "t", ignore_case=True), lambda s, m=m: C.keys(m, *R.tokens(m, s), Options(True)))
    plain["parts"] = (N.tokens("lines", "t", newline_is_token=True), lambda s: R.tokens("lines", s, True)[0])
    plain["no_cr"] = (N.tokens("lines", "t", strip_trailing_cr=True), lambda s: R.tokens("lines", s, False, True)[0])
    plain["ws_keys"] = (N.keys("lines", "t", ignore_whitespace=True), lambda s: C.keys("lines", *R.tokens("lines", s), Options(ignore_whitespace=True)))
    for r in t.select("k", *[c.alias(n) for n, (c, _) in plain.items()]).collect():
        for n, (_, f) in plain.items():
            assert r[n] == (f(texts[r.k]) if r.k >= 0 else None), (n, texts[r.k] if r.k >= 0 else None)


def test_native_numbers(spark):
    r = spark.range(0, 2001).select(F.col("id"), (F.col("id") / 2000).alias("s"), N.percent(F.col("id") / 2000).alias("p"), N.heat_level(F.col("id") / 2000).alias("h"), N.changed_percent(F.col("id") / 2000).alias("c"), N.hundredths("id", F.lit(2000)).alias("m"), N.format_hundredths("id").alias("f"), N.wrap_index(F.col("id") - 5, F.col("id") % 3).alias("w"), N.clamp01(F.col("id") - 3).alias("x"))
    for x in r.collect():
        assert (x.p, x.h, x.c, x.m, x.f, x.w) == (R.percent(x.s), R.heat_level(x.s), R.changed_percent(x.s), R.hundredths(x.id, 2000), R.format_hundredths(x.id), W.wrap_index(x.id - 5, x.id % 3))
        assert x.x == R.clamp01(x.id - 3)


@pytest.fixture(scope="module")
def pairs(spark, texts):
    r = random.Random(8)
    rows = [(k, r.choice(texts), r.choice(texts)) for k in range(120)] + [(200 + k, line_texts(r), line_texts(r)) for k in range(60)] + [(300, None, "a"), (301, "a", None), (302, "same. x", "same. x")]
    return rows, spark.createDataFrame(rows, "k int, old string, new string")


def test_kernels_and_native_consumers(spark, pairs):
    rows, frame = pairs
    by = {k: (a, b) for k, a, b in rows}
    p = frame.select("k", "old", "new", K.changes("wordsWithSpace", "old", "new").alias("c"), K.similarity("old", "new", html=False).alias("s"), K.html_diff("old", "new").alias("h"), K.heatmap("old", "new").alias("heat"), K.hunks("old", "new", contextLines=1).alias("hunks"), K.split_hunks("old", "new").alias("split"), K.moves("old", "new", moveSimilarity=0.6).alias("moves"), K.render("split", "old", "new", minimap=True, detectMoves=True).alias("html"))
    p = p.select("*", N.rebuilt("c", "old").alias("a"), N.rebuilt("c", "new").alias("b"), N.stats("c").alias("st"), N.render_text("wordsWithSpace", "c", anchors=True).alias("shown"), N.text_marks("c").alias("marks"), N.render_stats(N.stats("c"), F.col("s")).alias("badge"), N.similarity_of("c", "old", "new").alias("own"))
    for r in p.collect():
        a, b = by[r.k]
        if a is None or b is None:
            assert r.c is None and r.s is None and r.h is None and r.hunks is None and r.st is None
            continue
        found = C.changes("wordsWithSpace", a, b)
        assert [x.asDict() for x in r.c] == [x.record() for x in found]
        assert (r.a, r.b, r.st.asDict()) == (a, b, C.stats(found))
        assert r.shown == V.text("wordsWithSpace", found, Options(anchors=True)) and [m.asDict() for m in r.marks] == W.text_marks(found)
        assert r.badge == V.stats(C.stats(found), r.s) and r.own == C.similarity_of(found, a, b)
        assert r.s == C.similarity(a, b, False) and r.h.html == D.diff(a, b)["html"]
        drop = lambda x: {k: drop(v) for k, v in x.items() if v is not None} if isinstance(x, dict) else [drop(v) for v in x] if isinstance(x, list) else x
        assert drop(r.heat.asDict(True)) == drop(H.heatmap(a, b)) and drop(r.asDict(True)["hunks"]) == L.hunks(a, b, Options(context_lines=1))
        assert [m.asDict() for m in r.moves] == L.moves(L.rows(a, b), Options(move_similarity=0.6))
        assert len(r.split) == len(L.split_hunks(a, b))
        o = Options(anchors=True, detect_moves=True)
        model = L.split_hunks(a, b, o)
        assert r.html == V.with_minimap(V.split(model, o), V.minimap(W.line_marks(model), o))


@pytest.mark.parametrize("context", [0, 1, 3, float("inf")])
def test_line_plans_equal_the_model(spark, pairs, context):
    rows, frame = pairs
    shown = LN.folded(LN.rows(frame, ["k"]), ["k"], context)
    got = {}
    for r in LN.hunks(shown, ["k"]).orderBy("k", "block").collect():
        got.setdefault(r.k, []).append(r)
    beside = {}
    if context == 3:
        for r in LN.paired(LN.rows(frame, ["k"]), ["k"]).orderBy("k", "run", "place").collect():
            beside.setdefault(r.k, []).append((r.type, r.left_no, r.left_text, r.right_no, r.right_text))
    for k, a, b in rows:
        if a is None or b is None:
            assert k not in got
            continue
        want = L.hunks(a, b, Options(context_lines=context))
        mine = got.get(k, [])
        assert [(h["type"], h["oldStart"], h["newStart"], h["rows"]) for h in want] == [(h.type, h.old_start, h.new_start, [{n: v for n, v in (("type", x.type), ("oldNo", x.old_no), ("newNo", x.new_no), ("text", x.text)) if v is not None} for x in h.rows]) for h in mine]
        if context == 3:
            flat = [(x["type"], x.get("left", {}).get("lineNo"), x.get("left", {}).get("text"), x.get("right", {}).get("lineNo"), x.get("right", {}).get("text")) for x in L.paired(L.rows(a, b))]
            fix = lambda x: (x[0], x[1], x[4] if x[0] == "equal" else x[2], x[3], x[4])
            assert list(map(fix, flat)) == beside.get(k, [])


def test_timelines_and_streams(spark, tmp_path):
    r = random.Random(9)
    rows = [(f"d{d}", v, f"2024-01-01 00:{v:02d}:00", " ".join(r.choice("abcd") for _ in range(r.randint(0, 6)))) for d in range(4) for v in range(5)]
    frame = spark.createDataFrame(rows, "doc string, rev int, at string, body string").withColumn("at", F.to_timestamp("at"))
    batch = T.steps(frame, "doc", "rev", "body")
    want = {}
    for d in {x[0] for x in rows}:
        for s in W.timeline([x[3] for x in rows if x[0] == d])["steps"]:
            want[d, s["step"]] = (s["fromLabel"], s["toLabel"], s["stats"]["added"], s["similarity"], [c.record() for c in s["changes"]])
    assert {(x.doc, x.step): (x.from_label, x.to_label, x.stats.added, x.similarity, [c.asDict() for c in x.changes]) for x in batch.collect()} == want
    html = {x.doc: x.html for x in T.render(frame, "doc", "rev", "body", mode="split").collect()}
    assert html["d1"] == V.timeline(W.timeline([x[3] for x in rows if x[0] == "d1"], "split"))
    for k in range(5):
        frame.filter(F.col("rev") == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
        time.sleep(1.1)  # files are read in order of their times
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = S.steps(stream.select("doc", "at", "body"), "doc", "at", "body").writeStream.format("memory").queryName("palimpsest_steps").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    seen = {(x.key, x.step): (x.from_label, x.to_label, x.added, x.similarity) for x in spark.table("palimpsest_steps").collect()}
    assert seen == {k: v[:4] for k, v in want.items()}
    late = frame.filter("rev = 2").union(frame.filter("rev = 2"))  # behind what has been seen
    late.coalesce(1).write.parquet(f"{tmp_path}/in/5")
    q = S.steps(stream.select("doc", "at", "body"), "doc", "at", "body").writeStream.format("memory").queryName("palimpsest_late").option("checkpointLocation", f"{tmp_path}/state2").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("palimpsest_late").count() == len(want)


def test_sql_names(spark):
    names = sql.register(spark)
    assert {"changes_words", "similarity", "html_diff", "diff_rows"} <= set(names)
    r = spark.sql("select similarity('a b', 'a c') s, html_diff('<p>a</p>', '<p>b</p>').html h, size(changes_chars('ab', 'ba')) n").first()
    assert (r.s, r.h, r.n) == (C.similarity("a b", "a c", False), D.diff("<p>a</p>", "<p>b</p>")["html"], 3)
    got = spark.sql("select d.* from values ('a\nb', 'a\nc') t(x, y), lateral diff_rows(x, y) d order by row_no").collect()
    assert [(x.type, x.text) for x in got] == [("equal", "a"), ("removed", "b"), ("added", "c")]
    assert [x.text for x in spark.sql("select s.text from values ('Hi. There') t(x), lateral sentences_of(x) s order by position").collect()] == ["Hi.", "There"]


def test_pairs_of_a_hot_group(spark):
    from palimpsest.sources import pairs as P

    r = random.Random(12)
    rows = [(k, "hot" if k % 3 else r.choice("abcdefgh"), f"text {k}" if k % 7 else None) for k in r.sample(range(5000), 900)] + [(9000, None, "x"), (9001, None, "y")]
    frame = spark.createDataFrame(rows, "id long, g string, t string").repartition(5)
    want, last = [], {}
    for i, g, t in sorted(rows):
        if g is not None and last.get(g) is not None:
            want.append((i, last[g], t))
        last[g] = t
    assert sorted(map(tuple, P.neighbour_pairs(frame, F.col("g"), "id", "t").collect())) == want
    assert P.neighbour_pairs(frame.limit(0), F.col("g"), "id", "t").count() == 0


def test_kernels_hold_the_results_of_few_rows(spark):
    """A result is a hundred times its page in Python: those of a whole batch took more than an executor has."""
    alive = []

    class Result(str):
        def __init__(self, _):
            alive.append(1)

        def __del__(self):
            alive.pop()

    pages = spark.range(0, 1500, 1, 1).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("<p>" + "word " * 2000), F.col("id"))).alias("t"))
    got = pages.select("id", K.kernel(lambda s: Result(len(alive)), "string", "t").alias("n"), K.html_tokens("t").alias("k")).collect()
    assert len(got) == 1500 and max(int(r.n or 0) for r in got) <= 2 * K.PIECE // 10_000
    for r in got[::100]:
        assert r.k == (None if r.id % 7 == 0 else [tuple(t) for t in D.tokens(f"<p>{'word ' * 2000}{r.id}")]), r.id


def test_arrays_of_tuples(spark):
    kind = to_arrow_type(_parse_datatype_string(K.HTML_TOKENS))
    rows = [None, [], [D.Token("text", "a", "", "t>a", 1), D.Token("open", "<p>", "p", "<p")], None, [D.Token("space", " ", "", " ")], []]
    assert K.array_of(rows, kind).equals(pa.array([x if x is None else [t._asdict() for t in x] for x in rows], kind))
    assert K.array_of([None, []], kind).to_pylist() == [None, []]
    texts = pa.array(["x" * 10, None, "y" * K.PIECE * 3, "", *["z" * 1000] * 600])
    parts = list(K.pieces(texts.slice(1), texts.slice(1)))
    assert [k for at, n in parts for k in range(at, at + n)] == list(range(603)) and max(n for _, n in parts) <= K.PIECE // 2000 + 1
    assert list(K.pieces(texts.slice(0, 0))) == []


def test_arrays_of_changes(spark):
    kind = to_arrow_type(_parse_datatype_string(K.CHANGES))
    pairs = [None, ("", ""), ("a b", "a c d"), ("é\n", "é\n"), None, ("", "x"), ("y 😀", "")]
    want = [p and [c.record() for c in C.changes("wordsWithSpace", *p)] for p in pairs]
    assert K.changes_of([p and C.columns("wordsWithSpace", *p) for p in pairs], kind).equals(pa.array(want, kind))
    assert K.changes_of([], kind).to_pylist() == [] and K.changes_of([None], kind).to_pylist() == [None]
    t = spark.createDataFrame([(k, *(p or ("z", None))) for k, p in enumerate(pairs)], "k int, a string, b string")
    for mode in R.MODES:
        got = t.select("k", K.changes(mode, "a", "b").alias("c"), F.md5(N.rebuilt(K.changes(mode, "a", "b"), "new")).alias("v")).orderBy("k").collect()
        assert [r.c and [x.asDict() for x in r.c] for r in got] == [p and [c.record() for c in C.changes(mode, *p)] for p in pairs]
        assert [r.v is None for r in got] == [p is None for p in pairs]
