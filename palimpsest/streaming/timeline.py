"""A stream of revisions as timeline steps: each one against the last seen of its key.

An extension: the batch timeline is the rule. On input in order the steps are the same.
A revision that comes after a later one of its key has been seen, or with the same time,
is dropped, however late it is; state is one text a key and stays as long as the stream.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.options import Options
from ..operators import changes as C
from ..operators import lines as L

STEP = "key string, step long, from_label string, to_label string, added long, removed long, unchanged long, unit string, similarity double"


def steps(revisions: DataFrame, key: str, time: str, text: str, mode: str = "words", **options) -> DataFrame:
    """Streaming rows of ``STEP``; ``time`` orders the revisions of a key."""
    o = Options.of(**options)

    def advance(key_, batches, state):
        seen, last, old = state.get if state.exists else (0, None, None)
        rows = pd.concat(list(batches)).sort_values("_time", kind="stable")
        out = []
        for at, new in zip(rows["_time"], rows["_text"]):
            stamp = pd.Timestamp(at).value
            if new is None or (last is not None and stamp <= last):
                continue
            if seen:
                s = L.view(mode, old, new, o)[1]
                out.append((key_[0], seen, f"v{seen}", f"v{seen + 1}", s["added"], s["removed"], s["unchanged"], s["unit"], C.similarity(old, new, html=False)))
            seen, last, old = seen + 1, stamp, new
        if seen:
            state.update((seen, last, old))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in STEP.split(", ")])

    taken = revisions.select(F.col(key).cast("string").alias("_key"), F.col(time).cast("timestamp").alias("_time"), F.col(text).cast("string").alias("_text"))
    return taken.groupBy("_key").applyInPandasWithState(advance, STEP, "seen long, last long, text string", "append", "NoTimeout")
