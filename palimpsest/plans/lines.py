"""The line model as rows of a DataFrame: windows for numbers, visibility and blocks.

All windows partition by the pair's key, so one exchange serves them; a pair's rows are
in one partition, as they come from one pair of texts.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as N
from ..functions.options import Options
from ..operators import frames as K


def rows(pairs: DataFrame, keys: list[str], old: str = "old", new: str = "new", **options) -> DataFrame:
    """keys, row_no, type, old_no, new_no, text: the numbered rows of each pair."""
    o = Options.of(**options)
    plain = {"ignoreCase": o.ignore_case, "ignoreWhitespace": o.ignore_whitespace, "stripTrailingCr": o.strip_trailing_cr}
    found = pairs.select(*keys, F.posexplode(K.changes("lines", old, new, **plain)).alias("_c", "_x"))
    found = found.select(*keys, "_c", F.col("_x.added").alias("_a"), F.col("_x.removed").alias("_r"), F.posexplode(N.split_lines("_x.value")).alias("_l", "text"))
    order = W.partitionBy(*keys).orderBy("_c", "_l")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    kind = F.when(F.col("_a"), "added").when(F.col("_r"), "removed").otherwise("equal")
    count = lambda c: F.sum((~c).cast("int")).over(so_far).cast("int")
    return found.select(*keys, F.row_number().over(order).alias("row_no"), kind.alias("type"), F.when(~F.col("_a"), count(F.col("_a"))).alias("old_no"), F.when(~F.col("_r"), count(F.col("_r"))).alias("new_no"), "text")


def folded(found: DataFrame, keys: list[str], context_lines=3) -> DataFrame:
    """Rows with ``visible`` and the number of their ``block``."""
    context = Options.of(contextLines=context_lines).context_lines
    order = W.partitionBy(*keys).orderBy("row_no")
    frame = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing) if math.isinf(context) else order.rowsBetween(-int(context), int(context))
    near = found.withColumn("_near", F.max((F.col("type") != "equal").cast("int")).over(frame) == 1).withColumn("_any", F.max((F.col("type") != "equal").cast("int")).over(W.partitionBy(*keys)) == 1)
    beside = lambda f: F.coalesce(f("_near").over(order), F.lit(True))
    shown = near.withColumn("visible", F.col("_near") | F.col("_any") & beside(F.lag) & beside(F.lead))
    step = F.coalesce((F.lag("visible").over(order) != F.col("visible")).cast("int"), F.lit(0))
    return shown.withColumn("_step", step).withColumn("block", F.sum("_step").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)).cast("int")).drop("_near", "_any", "_step")


def hunks(shown: DataFrame, keys: list[str]) -> DataFrame:
    """keys, block, type, old_start, old_lines, new_start, new_lines, count, rows: one row a block."""
    blocks = shown.groupBy(*keys, "block").agg(
        F.when(F.first("visible"), "hunk").otherwise("collapsed").alias("type"),
        F.count("old_no").alias("old_lines"),
        F.count("new_no").alias("new_lines"),
        F.count("*").alias("count"),
        F.array_sort(F.collect_list(F.struct("row_no", "type", "old_no", "new_no", "text"))).alias("rows"),
    )
    before = W.partitionBy(*keys).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    start = lambda c: (F.coalesce(F.sum(c).over(before), F.lit(0)) + 1).alias(c.replace("lines", "start"))
    return blocks.select(*keys, "block", "type", start("old_lines"), "old_lines", start("new_lines"), "new_lines", "count", "rows")


def stats(found: DataFrame, keys: list[str]) -> DataFrame:
    """Lines by kind of each pair: what unified and split views both count."""
    n = lambda t: F.count_if(F.col("type") == t)
    return found.groupBy(*keys).agg(n("added").alias("added"), n("removed").alias("removed"), n("equal").alias("unchanged"))


def paired(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, run, place, type, and the left and right line of each row of the split view (without moves).

    In a run of changed rows the n-th removed one stands beside the n-th added one: a full
    outer join on the run and the ordinal.
    """
    order = W.partitionBy(*keys).orderBy("row_no")
    same = F.col("type") == "equal"
    new_run = same | F.coalesce(F.lag("type").over(order) == "equal", F.lit(True))
    runs = found.withColumn("run", F.sum(new_run.cast("int")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    placed = runs.withColumn("place", F.row_number().over(W.partitionBy(*keys, "run", "type").orderBy("row_no")))
    # One grouping does the outer join: each (run, place) has at most one row a side.
    pick = lambda kind, c: F.max(F.when(F.col("type").isin(kind, "equal"), F.col(c)))
    both = placed.groupBy(*keys, "run", "place").agg(pick("removed", "old_no").alias("left_no"), F.max(F.when(F.col("type") == "removed", F.col("text"))).alias("_gone"), pick("added", "new_no").alias("right_no"), pick("added", "text").alias("right_text"), F.max(same.cast("int")).alias("_same"))
    kind = F.when(F.col("_same") == 1, "equal").when(F.col("left_no").isNull(), "added").when(F.col("right_no").isNull(), "removed").otherwise("modified")
    return both.select(*keys, "run", "place", kind.alias("type"), "left_no", F.when(F.col("_same") == 1, F.col("right_text")).otherwise(F.col("_gone")).alias("left_text"), "right_no", "right_text")
