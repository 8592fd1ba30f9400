"""Names for Spark SQL: scalar functions and table functions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from ..operators import changes as C
from ..operators import frames as K
from ..operators import heatmap as H
from ..operators import html as D
from ..operators import lines as L
from . import rules as R


def register(spark: SparkSession) -> list[str]:
    """Registers the functions with a session and returns their names.

    ``changes_<mode>(old, new)``, ``similarity(old, new)`` (plain text), ``similarity_html``,
    ``hunks``, ``split_hunks``, ``moves``, ``heatmap``, ``html_diff``; and the table functions
    ``diff_rows(old, new)`` and ``sentences_of(text)`` for LATERAL joins.
    """
    both = {
        "similarity": (lambda a, b: C.similarity(a, b, html=False), "double"),
        "similarity_html": (C.similarity, "double"),
        "hunks": (L.hunks, K.HUNKS),
        "split_hunks": (lambda a, b: K.hidden(L.split_hunks(a, b)), K.SPLIT_HUNKS),
        "moves": (lambda a, b: L.moves(L.rows(a, b)), K.MOVES),
        "heatmap": (H.heatmap, K.HEATMAP),
        "html_diff": (D.diff, K.HTML),
    }
    for mode in R.MODES:
        name = {"wordsWithSpace": "words_with_space"}.get(mode, mode)
        both[f"changes_{name}"] = ((lambda a, b, mode=mode: [c.record() for c in C.changes(mode, a, b)]), K.CHANGES)
    for name, (function, kind) in both.items():
        type_ = _parse_datatype_string(kind)
        arrow = to_arrow_type(type_)

        def run(a: pa.Array, b: pa.Array, function=function, arrow=arrow) -> pa.Array:
            return pa.array([None if x is None or y is None else function(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], arrow)

        spark.udf.register(name, F.arrow_udf(_two(run), type_))

    class DiffRows:
        def eval(self, old: str, new: str):
            if old is not None and new is not None:
                for k, r in enumerate(L.line_rows(old, new), 1):
                    yield k, r["type"], r.get("oldNo"), r.get("newNo"), r["text"]

    class SentencesOf:
        def eval(self, text: str):
            if text is not None:
                for k, t in enumerate(C.tokenize("sentences", text), 1):
                    if R.solid_length(t):
                        yield k, t

    spark.udtf.register("diff_rows", F.udtf(DiffRows, returnType="row_no int, type string, old_no int, new_no int, text string"))
    spark.udtf.register("sentences_of", F.udtf(SentencesOf, returnType="position int, text string"))
    return [*both, "diff_rows", "sentences_of"]


def _two(run):
    """A function of exactly two arrays, as Spark counts parameters."""
    def call(a: pa.Array, b: pa.Array) -> pa.Array:
        return run(a, b)

    return call
