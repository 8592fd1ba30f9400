"""Comparison as Spark columns: one Arrow-batched kernel call a pair.

Every function takes the columns of the old and the new text and keyword options
(``Options.of``), which are settled when the plan is built. A null on either side
gives null. Equal texts need no search, so their cost is that of reading them.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, _parse_datatype_string

from ..functions import rules as R
from ..functions.columns import col
from ..functions.options import Options
from . import changes as C
from . import heatmap as H
from . import html as D
from . import lines as L
from . import render as V
from . import views as W

CHANGE = "struct<value:string,added:boolean,removed:boolean,count:int>"
CHANGES = f"array<{CHANGE}>"
STATS = "struct<added:bigint,removed:bigint,unchanged:bigint,unit:string>"
ROW = "struct<type:string,oldNo:int,newNo:int,text:string,move:int,counterpart:int>"
CELL = f"struct<type:string,lineNo:int,text:string,move:int,counterpart:int,parts:{CHANGES}>"
SPLIT_ROW = f"struct<type:string,left:{CELL},right:{CELL}>"
HUNKS = f"array<struct<type:string,oldStart:int,oldLines:int,newStart:int,newLines:int,count:int,rows:array<{ROW}>>>"
SPLIT_HUNKS = f"array<struct<type:string,oldStart:int,oldLines:int,newStart:int,newLines:int,count:int,rows:array<{SPLIT_ROW}>,hidden:array<{ROW}>>>"
MOVES = "array<struct<id:int,oldStart:int,newStart:int,lines:int>>"
HEATMAP = "struct<segments:array<struct<type:string,text:string,heat:int,status:string,similarity:double,changed:int,old:string>>,exact:boolean>"
MARKS = "array<struct<index:int,kind:string,top:int,height:int>>"
HTML = "struct<html:string,fullReplacement:boolean,similarity:double>"
OPERATIONS = "array<struct<op:tinyint,count:int>>"
SEGMENTS = "array<struct<kind:string,raw:string,name:string,closed:boolean>>"
HTML_TOKENS = "array<struct<kind:string,raw:string,name:string,key:string,size:int>>"


#: Bytes of text that a kernel's results are held for at once. Results can take a hundred times their texts.
PIECE = 1 << 18


def kernel(function, kind: str, *columns, build=None) -> Column:
    """``function`` over rows of the columns; null where any of them is null.

    A batch is answered piece by piece, so a worker holds the results of one piece (of one row,
    if that is larger). Rows of structs in a list may come as tuples in the order of their fields.
    ``build`` makes an array of the results, if ``array_of`` is not to.
    """
    type_: DataType = _ddl(kind)
    arrow = to_arrow_type(type_)

    def answers(*batch: pa.Array) -> Iterator[pa.Array]:
        for at, n in pieces(*batch):
            rows = zip(*(x.slice(at, n).to_pylist() for x in batch))
            with uncollected():
                found = (build or array_of)([None if None in row else function(*row) for row in rows], arrow)
            yield found

    if len(columns) == 1:

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for a in batches:
                yield from answers(a)

    else:

        def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for a, b in batches:
                yield from answers(a, b)

    return F.arrow_udf(run, type_)(*map(col, columns))


@contextmanager
def uncollected():
    """Without searches for cycles, of which kernels make none; many small results call for one again and again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def pieces(*batch: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of parts of a batch with about ``PIECE`` bytes each."""
    total = sum(x.nbytes for x in batch)
    if total <= PIECE or any(pa.types.is_nested(x.type) for x in batch):
        sizes = [total // max(1, len(batch[0]))] * len(batch[0])
    else:
        sizes = np.sum([pc.fill_null(pc.binary_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in batch], axis=0).tolist()
    at = held = 0
    for k, size in enumerate(sizes):
        if k > at and held + size > PIECE:
            yield at, k - at
            at, held = k, 0
        held += size
    if len(sizes) > at:
        yield at, len(sizes) - at


def array_of(results: list, kind: pa.DataType) -> pa.Array:
    """Results as an array; lists of tuples by column, without a dictionary each, one that is met again at its first place."""
    first = next((x[0] for x in results if x), None) if pa.types.is_list(kind) and pa.types.is_struct(kind.value_type) else None
    if not isinstance(first, tuple):
        return pa.array(results, kind)
    fields = list(kind.value_type)
    rows = [t for x in results if x for t in x]
    ids = list(map(id, rows))
    met = dict(zip(ids, rows))  # in the order of first places
    numbers = dict(zip(met, range(len(met))))
    place = pa.array(np.fromiter(map(numbers.__getitem__, ids), np.int32, len(ids)))
    values = pa.StructArray.from_arrays([pa.array(c, f.type).take(place) for c, f in zip(zip(*met.values()), fields)], fields=fields)
    ends = [0, *accumulate(len(x or ()) for x in results)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, kind, mask=pa.array([x is None for x in results]))


def changes_of(results: list, kind: pa.DataType) -> pa.Array:
    """Change lists that come as values, operations and counts as an array."""
    found = [x or ((), (), ()) for x in results]
    fields = list(kind.value_type)
    values, ops, counts = (list(chain.from_iterable(c)) for c in zip(*found)) if found else ((), (), ())
    ops = np.array(ops, np.int8)
    rows = pa.StructArray.from_arrays([pa.array(values, fields[0].type), pa.array(ops > 0), pa.array(ops < 0), pa.array(counts, fields[3].type)], fields=fields)
    ends = [0, *accumulate(len(x[0]) for x in found)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows, kind, mask=pa.array([x is None for x in results], pa.bool_()))


def _ddl(kind: str) -> DataType:
    return _parse_datatype_string(kind)


def mode_of(mode: str, among=R.MODES) -> str:
    if mode not in among:
        raise ValueError(f"unknown mode: {mode!r}")
    return mode


def changes(mode: str, old, new, **options) -> Column:
    o = Options.of(**options)
    mode_of(mode)
    return kernel(lambda a, b: C.columns(mode, a, b, o), CHANGES, old, new, build=changes_of)


def operations(mode: str, old, new, **options) -> Column:
    """Runs of the edit script: op -1 removed, 0 equal, 1 added; null beyond the edit limit."""
    o = Options.of(**options)
    mode_of(mode)

    def run(a, b):
        ops = C.operations(mode, a, b, o)[2]
        return None if ops is None else [{"op": op, "count": n} for op, n in ops]

    return kernel(run, OPERATIONS, old, new)


def array_operations(old, new, max_edit_length: int | None = None) -> Column:
    """The edit script of two arrays of strings, compared as they are."""
    from . import engine

    def run(a, b):
        ops = engine.script(*engine.intern(a, b), max_edit_length)
        return None if ops is None else [{"op": op, "count": n} for op, n in ops]

    return kernel(run, OPERATIONS, old, new)


def similarity(old, new, html: bool = True) -> Column:
    return kernel(lambda a, b: C.similarity(a, b, html), "double", old, new)


def statistics(mode: str, old, new, **options) -> Column:
    """Statistics of any view: code points for text modes, lines for unified and split."""
    o = Options.of(**options)
    mode_of(mode, R.VIEWS)
    return kernel(lambda a, b: L.view(mode, a, b, o)[1], STATS, old, new)


def step(mode: str, old, new, **options) -> Column:
    """Statistics, similarity of the plain texts, and change list or hunks of two versions, from one search."""
    o = Options.of(**options)
    mode_of(mode, R.VIEWS)
    name, kind = {"unified": ("hunks", HUNKS), "split": ("hunks", SPLIT_HUNKS)}.get(mode, ("changes", CHANGES))

    def run(a, b):
        model, found = L.view(mode, a, b, o)
        model = hidden(model) if mode == "split" else model if mode == "unified" else [c.record() for c in model]
        return {"stats": found, "similarity": C.similarity(a, b, html=False), name: model}

    return kernel(run, f"struct<stats:{STATS},similarity:double,{name}:{kind}>", old, new)


def hidden(blocks: list[dict]) -> list[dict]:
    """Paired blocks; a collapsed one has its rows under ``hidden``, as they are of another kind."""
    return [h if h["type"] == "hunk" else {k: v for k, v in h.items() if k != "rows"} | {"hidden": h["rows"]} for h in blocks]


def line_rows(old, new, **options) -> Column:
    o = Options.of(**options)
    return kernel(lambda a, b: L.line_rows(a, b, o), f"array<{ROW}>", old, new)


def hunks(old, new, **options) -> Column:
    o = Options.of(**options)
    return kernel(lambda a, b: L.hunks(a, b, o), HUNKS, old, new)


def split_hunks(old, new, **options) -> Column:
    """Hunks of paired rows; a collapsed block has its rows under ``hidden``."""
    o = Options.of(**options)
    return kernel(lambda a, b: hidden(L.split_hunks(a, b, o)), SPLIT_HUNKS, old, new)


def moves(old, new, **options) -> Column:
    o = Options.of(**options)
    return kernel(lambda a, b: L.moves(L.rows(a, b, o), o), MOVES, old, new)


def heatmap(old, new, **options) -> Column:
    o = Options.of(**options)
    return kernel(lambda a, b: H.heatmap(a, b, o), HEATMAP, old, new)


def minimap(mode: str, old, new, **options) -> Column:
    o = Options.of(**options)
    mode_of(mode, R.VIEWS)

    def run(a, b):
        model = L.view(mode, a, b, o)[0]
        return W.line_marks(model) if mode in ("unified", "split") else W.text_marks(model)

    return kernel(run, MARKS, old, new)


def html_diff(old, new, **options) -> Column:
    o = Options.of(**options)
    return kernel(lambda a, b: D.diff(a, b, o), HTML, old, new)


def html_segments(text) -> Column:
    return kernel(lambda s: D.segments(R.scrub(s)), SEGMENTS, text)


def html_tokens(text, **options) -> Column:
    o = Options.of(**options)
    return kernel(lambda s: D.tokens(R.scrub(s), o.ignore_case, o.ignore_formatting_tags), HTML_TOKENS, text)


def strip_formatting(text) -> Column:
    return kernel(D.strip_formatting, "string", text)


def decode_html_text(text) -> Column:
    return kernel(D.decode_text, "string", text)


def render(view: str, old, new, minimap: bool = False, **options) -> Column:
    """Markup of any view: a text mode, unified, split, heatmap, html, playback_<text mode>; with a minimap if asked."""
    from dataclasses import replace

    o = Options.of(**options)
    if minimap:
        o = replace(o, anchors=True)
    playing = view.removeprefix("playback_") if view.startswith("playback_") else None
    mode_of(playing or view, R.MODES if playing else (*R.VIEWS, "heatmap", "html"))

    def run(a, b):
        if playing:
            return V.playback(playing, C.changes(playing, a, b), o)
        if view == "heatmap":
            return V.heatmap(H.heatmap(a, b, o), o)
        if view == "html":
            return V.html(D.diff(a, b, o)["html"])
        model = L.view(view, a, b, o)[0]
        shown = V.view(view, model, o)
        if not minimap:
            return shown
        return V.with_minimap(shown, V.minimap(W.line_marks(model) if view in ("unified", "split") else W.text_marks(model), o))

    return kernel(run, "string", old, new)
