import os
import random
from hashlib import sha256

import numpy as np
import pytest

import corpus_pipeline
from palimpsest.llm import jaccard, quality, suffix_dedup

from .helpers import prose
from .test_decontaminate import brute as hits
from .test_jaccard import brute as linked

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


def cut(rows, length=50):
    """Texts without strings that a smaller id holds; characters that are cut go whole."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            first[b[k : k + length]] = min(first.get(b[k : k + length], i), i)
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None))
            continue
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = True
        runs = np.split(np.arange(len(b)), np.flatnonzero(np.diff(gone.astype(int))) + 1)
        out.append((i, "".join(b[r[0] : r[-1] + 1].decode("utf-8", "ignore") for r in runs if len(r) and not gone[r[0]]) if gone.any() else t))
    return out


def test_stages_equal_brute_force(spark, tmp_path):
    r = random.Random(9)
    bench = [(k, prose(70 + k, 30)) for k in range(3)]
    passages = [prose(90 + k, 45) for k in range(3)]
    rows = []
    for k in range(150):
        words = prose(2000 + k, r.randint(30, 90)).split()
        if k % 5 == 0:
            words = [w + "###" for w in words]
        text = " ".join(words)
        if k % 7 == 1:
            text += " " + r.choice(passages)
        if k % 11 == 2:
            text += " " + " ".join(r.choice(bench)[1].split()[4:18])
        rows.append((k, text))
    rows += [(200 + k, rows[k * 3 + 1][1] + (" more" if k % 2 else "")) for k in range(20)] + [(300, None), (301, ""), (302, "one")]
    labels = [(k, int(k % 5 != 0), 0) for k in range(150)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    got = sorted((x.doc_id, x.n_tokens, tuple(x.ids), x.decoded_sha256) for x in corpus_pipeline.run(spark, str(tmp_path)).collect())

    marks = spark.read.parquet(f"{tmp_path}/labels.parquet")
    good = {x.doc_id for x in quality.score(docs, quality.train(docs, marks)).filter("predicted = 1").collect()}
    assert not good & {k for k in range(0, 150, 5)} and good >= {k for k in range(150) if k % 5}
    rest = [(i, t) for i, t in rows if i in good]
    first = {(i, c) for i, _, c, _ in linked(rest, 5, 80, 100)}
    rest = cut([(i, t) for i, t in rest if (i, i) in first])
    bad = {i for i, _, n, _ in hits(rest, bench) if n}
    assert bad
    lib = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for i, t in rest:
        if i not in bad:
            ids = lib.encode(t or "", add_special_tokens=False).ids
            want.append((i, len(ids), tuple(ids), sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_repeated_rows_and_replacement_characters(spark):
    long = prose(7, 40)
    own = "\ufffd begin \x01B \x01A \x01 " + prose(8, 20) + " \ufffd"
    rows = [(1, long), (2, f"{own} {long} {own[::-1]}"), (2, f"{own} {long} {own[::-1]}"), (2, f"{own} {long} {own[::-1]}"), (3, "short"), (3, "short"), (None, "x"), (None, "x")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    cut_rows = corpus_pipeline.cut_repeats(spark, docs, "").collect()
    want = cut([x for x in rows if x[0] is not None]) + [x for x in rows if x[0] is None]
    assert sorted(((r.doc_id, r.text) for r in cut_rows), key=str) == sorted(want, key=str)
    first = corpus_pipeline.keep_first_of_near_copies(spark, docs, "").collect()
    assert sorted(((r.doc_id, r.text) for r in first), key=str) == sorted({x for x in rows if x[0] is not None} | set()) + [(None, "x")] * 2


NAMES = ["doc_id", "text", "key", "_key", "_kept", "_again", "digest", "row", "row_id", "body", "kept", "again", "component_id", "n.chars"]


def test_clashing_names_repeated_ids_and_empty_tables(spark):
    long = prose(17, 40)
    rows = [(1, long), (2, "a b c " + long), (2, "d e f " + long), (2, "d e f " + long), (2, None), (3, ""), (None, long), (4, "x " + long[: len(long) // 2] + "é" * 30)]
    docs = spark.createDataFrame([(i, t, *["z"] * (len(NAMES) - 2)) for i, t in rows], ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in NAMES))
    out = suffix_dedup.without_repeats(docs)
    got = sorted((tuple(r) for r in out.collect()), key=str)
    want = [x for x in cut([x for x in rows if x[0] is not None])] + [(None, long)]
    assert out.columns == NAMES and got == sorted(((i, t, *["z"] * (len(NAMES) - 2)) for i, t in want), key=str)
    first = jaccard.first_of_classes(docs)
    assert first.columns == NAMES and sorted({(r.doc_id, r.text) for r in first.collect() if r.doc_id == 1 or r.doc_id is None}, key=str) == sorted([(1, long), (None, long)], key=str)
    assert suffix_dedup.without_repeats(docs.limit(0)).count() == 0 and jaccard.first_of_classes(docs.limit(0)).count() == 0
    with pytest.raises(TypeError):
        jaccard.classes(docs, id_col="key")


def test_a_run_leaves_one_folder_until_it_is_cleaned(spark, tmp_path):
    docs = spark.createDataFrame([(k, prose(k, 30), "en", "s", 5) for k in range(5)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    folder = corpus_pipeline._FOLDERS[-1]
    assert os.listdir(folder.removeprefix("file:")) == [corpus_pipeline.STAGES[-2][0]] and out.count() == 5
    corpus_pipeline.clean(spark)
    assert not os.path.exists(folder.removeprefix("file:"))
