import random
import zlib

import numpy as np
import pytest

from palimpsest.llm import quality, toxicity
from palimpsest.llm.learn import SIGNS, structure

from .helpers import AWKWARD, prose, table


def labelled():
    r = random.Random(4)
    rows, labels = [], []
    for k in range(400):
        good, toxic = k % 4 != 0, k % 5 == 0
        words = prose(1000 + k, r.randint(20, 120)).split()
        if not good:
            words = [w + r.choice(["###", "$$$", "%%%"]) for w in words]
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["idiot", "stupid", "moron", "trash"]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(good), int(toxic)))
    return rows, labels


def test_sum_of_squares_identity():
    m = quality.Machine()
    r = np.random.Generator(np.random.PCG64(1))
    m.w = r.normal(size=m.w.shape)
    ids, x = r.integers(0, 1 << quality.BITS, 12), r.normal(size=12)
    stats = r.normal(size=(1, quality.STATS)).clip(-3, 3)
    cut = np.array([0, 12])
    feats = [*zip(ids, x), *((j + (1 << quality.BITS), v) for j, v in enumerate(stats[0]))]
    slow = m.w0 + sum(m.w[i] * v for i, v in feats) + sum((m.v[i] @ m.v[j]) * a * b for k, (i, a) in enumerate(feats) for j, b in feats[k + 1 :])
    assert m.logits(ids, x, cut, stats)[0] == pytest.approx(slow)


def test_structure_of_empty_and_mixed_rows():
    texts = [b"", b"A a 1!\nA a 1!", b"\n\n"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    s = structure(data, np.array([0, 0, len(texts[1]), len(data)]))
    assert not s[0].any()
    assert s[1, 0] == pytest.approx(2 / 13) and s[1, 8] == 0.5 and s[1, 9] == 0.5
    assert s[1, 12 + SIGNS.index(b"!")] == pytest.approx((2 / 13) ** 0.5)


def test_quality_learns_and_scores_every_row(spark):
    rows, labels = labelled()
    docs = table(spark, rows + [(1000 + i, t) for i, t in AWKWARD] + [(None, "x y")])
    marks = spark.createDataFrame(labels + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    m = quality.train(docs, marks, rows=300)
    got = {r.doc_id: r for r in quality.score(docs, m).collect()}
    assert len(got) == len({i for i, _ in rows} | {1000 + i for i, _ in AWKWARD}) + 1
    for i, good, _ in labels:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    test = [(got[i].predicted, good) for i, good, _ in labels if got[i].held_out]
    assert np.mean([p == g for p, g in test]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    kept = quality.accepted(docs, marks, rows=300)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def slow_score(m, text):
    """The machine's formula, pair by pair, for one text."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    off = np.array([0, len(raw)])
    ids, _ = quality.hashed_words(raw, off, quality.BITS)
    stats = m.rescaled(structure(raw, off))[0]
    x = {}
    for i in ids.tolist():
        x[i] = x.get(i, 0) + quality.WORD_SCALE / len(ids)
    linear = m.w0 + sum(m.w[i] * v for i, v in x.items()) + sum(m.w[(1 << quality.BITS) + j] * v for j, v in enumerate(stats))
    feats = [(m.v[i], quality.WORD_SCALE / len(ids)) for i in ids.tolist()] + [(m.v[(1 << quality.BITS) + j], v) for j, v in enumerate(stats)]
    pairs = sum(float(a @ b) * x1 * x2 for k, (a, x1) in enumerate(feats) for b, x2 in feats[k + 1 :])
    return 1 / (1 + np.exp(-(linear + pairs)))


def test_scores_equal_the_formula_pair_by_pair(spark):
    rows, labels = labelled()
    m = quality.train(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    some = [(k, " ".join(t.split()[:25])) for k, t in rows[:12]] + [(500, None), (501, ""), (502, "one"), (503, "one one ###")]
    for r in quality.score(table(spark, some), m).collect():
        assert r.score == pytest.approx(slow_score(m, dict(some)[r.doc_id]), rel=1e-9)


def test_empty_labels_and_tables(spark):
    rows, labels = labelled()
    docs, none = table(spark, rows[:20]), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(docs, quality.train(docs, none)).collect()} == {0.5}
    assert not any(r.toxic for r in toxicity.score(docs, toxicity.train(docs, none)).collect())
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert quality.score(docs.limit(0), quality.train(docs, marks)).count() == 0
    assert toxicity.score(docs.limit(0), toxicity.train(docs, marks)).count() == 0


def test_toxicity_chain(spark):
    rows, labels = labelled()
    docs = table(spark, rows + [(1000 + i, t) for i, t in AWKWARD])
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = "crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"
    chain = toxicity.train(docs, marks, rows=320, where=held)
    got = {r.doc_id: r for r in toxicity.score(docs, chain).collect()}
    rest = [(got[i].toxic, bool(t)) for i, _, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([a == b for a, b in rest]) > 0.95
    assert not any(got[1000 + i].toxic for i, _ in AWKWARD)
    assert chain.names == ("kind_1", "kind_2", "toxic") and [len(m.d) for m in chain.models] == [0, 1, 2]
    two = toxicity.train(docs, marks, rows=320, label_cols=("quality", "toxic"))
    assert set(toxicity.score(docs, two).columns) == {"doc_id", "p_quality", "p_toxic", "toxic"}


def test_links_decide_held_out_rows(spark):
    """Without the links to earlier categories the last model flags other rows."""
    rows, labels = labelled()
    docs = table(spark, rows)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, marks, where="crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    rest = docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")
    scores = lambda: {r.doc_id: (r.p_toxic, r.toxic) for r in toxicity.score(rest, chain).collect()}
    linked = scores()
    chain.models[-1].d = np.zeros_like(chain.models[-1].d)
    cut = scores()
    toxic = [i for i, _, t in labels if t and i in linked]
    assert sum(linked[i][1] for i in toxic) > 0.9 * len(toxic)
    assert any(linked[i][1] != cut[i][1] for i in linked) and np.mean([linked[i][0] - cut[i][0] for i in toxic]) > 0.1


def test_kinds_are_clusters_of_telling_words():
    r = np.random.Generator(np.random.PCG64(3))
    rows, y, truth = [], [], []
    for k in range(300):
        words = list(r.integers(1000, 9000, 20))
        kind = k % 4  # 0 and 1: two vocabularies; 2: toxic without any telling word; 3: clean
        if kind < 2:
            words += list(r.choice(np.arange(5) + 10 * kind, 3, replace=False))
        rows.append(np.unique(words)), y.append(float(kind < 3)), truth.append(kind)
    ids, cut = np.concatenate(rows), np.concatenate(([0], np.cumsum([len(x) for x in rows])))
    got, truth = toxicity.kinds(ids, cut, np.array(y)), np.array(truth)
    one, two = (set(map(tuple, got[truth == k])) for k in (0, 1))
    assert len(one) == len(two) == 1 and one != two and {sum(x) for x in one | two} == {1} and not got[truth > 1].any()
    assert not toxicity.kinds(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0)).size


def test_sample_is_bounded_in_bytes_and_one_row_an_id(spark):
    from palimpsest.llm import learn

    rows, labels = labelled()
    docs = table(spark, rows + rows[:50] + [(3, "another")] * 40)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    sample = learn.labelled_sample(docs, marks, ["toxic"], 100, "doc_id", "text")
    assert sample.count() == 100 == sample.select("id").distinct().count()
    shape = lambda s: (len(s.y), len(s.ids))
    whole = learn.learned(sample, toxicity.features, 1, shape)
    part = learn.learned(sample, toxicity.features, 1, shape, limit=20_000)
    assert whole[0] == 100 and 0 < part[0] < 100 and 8 * part[1] <= 20_000
    assert learn.learned(sample.limit(0), toxicity.features, 1, shape) is None


def test_earlier_probabilities_come_out_of_fold():
    r = np.random.Generator(np.random.PCG64(2))
    n = 60
    ids, cut = r.integers(0, 50, n * 5), np.arange(n + 1) * 5
    y = np.stack([r.integers(0, 2, n), r.integers(0, 2, n)], 1).astype(float)
    seen = []
    real = toxicity.Linear.fit

    def spy(self, i, c, dense, yy, *a, **k):
        seen.append((len(yy), dense.shape[1]))
        return real(self, i, c, dense, yy, *a, **k)

    toxicity.Linear.fit, old = spy, real
    try:
        toxicity.Chain(("a", "b")).fit(ids, cut, y)
    finally:
        toxicity.Linear.fit = old
    assert seen == [(40, 0)] * 3 + [(60, 0), (60, 1)]
