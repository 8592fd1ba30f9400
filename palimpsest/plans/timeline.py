"""Timelines of revisions: one row a step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import frames as K
from ..sources.pairs import spread


def steps(revisions: DataFrame, key: str, order: str, text: str, label: str | None = None, mode: str = "words", **options) -> DataFrame:
    """key, step, from_label, to_label, stats, similarity, and changes or hunks, for each revision after the first.

    An unknown mode means words. Revisions without a label are called v1, v2, ..
    """
    mode = mode if mode in R.VIEWS else "words"
    w = W.partitionBy(key).orderBy(order)
    number = F.row_number().over(w)
    name = F.concat(F.lit("v"), number.cast("string"))
    named = revisions.select(key, F.col(order).alias("_o"), F.col(text).alias("_new"), number.alias("_n"), (name if label is None else F.coalesce(F.col(label), name)).alias("_name"))
    w = W.partitionBy(key).orderBy("_n")
    pairs = named.select(key, (F.col("_n") - 1).alias("step"), F.lag("_name").over(w).alias("from_label"), F.col("_name").alias("to_label"), F.lag("_new").over(w).alias("_old"), "_new").filter("step > 0")
    pairs = spread(pairs, key, "step")
    done = pairs.select(key, "step", "from_label", "to_label", K.step(mode, "_old", "_new", **options).alias("_s"))
    return done.select(key, "step", "from_label", "to_label", "_s.stats", "_s.similarity", "_s.hunks" if mode in ("unified", "split") else "_s.changes")


def render(revisions: DataFrame, key: str, order: str, text: str, label: str | None = None, mode: str = "words", **options) -> DataFrame:
    """key, html: the timeline of each key's revisions. A key's revisions are held together, as its page shows them all."""
    import pyarrow as pa

    from ..functions.options import Options
    from ..operators import render as V
    from ..operators import views

    o = Options.of(**options)
    kind = revisions.schema[key].dataType.simpleString()

    def run(table):
        table = table.sort_by([("_o", "ascending")])
        t = views.timeline([x or "" for x in table.column("_t").to_pylist()], mode, table.column("_l").to_pylist(), o)
        return pa.table([table.column("_k").slice(0, 1), pa.array([V.timeline(t, o)], pa.string())], ["key", "html"])

    taken = revisions.select(F.col(key).alias("_k"), F.col(order).alias("_o"), F.col(text).alias("_t"), (F.lit(None).cast("string") if label is None else F.col(label).cast("string")).alias("_l"))
    return taken.groupBy("_k").applyInArrow(run, f"key {kind}, html string").withColumnRenamed("key", key)
