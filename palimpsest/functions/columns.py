"""The text rules as native Spark columns: whole-stage code, no Python on the executors.

A null text gives null. Patterns use Java's regex with explicit code points; ``\\s`` and
``trim`` mean other sets there and are not used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R

WS = R.WS.replace("\\u00a0", "\\x{A0}")
W = R.W
_SPACED = "\\t\\x0B\\f \\x{A0}\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
#: Stands between the pieces of a cut text while they are split; texts that hold it are cut by their parts instead.
CUT = "\x1e"

PATTERNS = {
    "chars": "(?s).",
    "words": f"[{W}]+|[{WS}]+|[^{W}]",
    "wordsWithSpace": f"\\r?\\n|[{W}]+|[{_SPACED}]+|[^{W}]",
    "lines": "[^\\n]*\\n|[^\\n]+",
    "line_parts": "\\r?\\n|(?:[^\\r\\n]|\\r(?!\\n))+",
    # A sentence runs to . ! ? before white space; the white space after it is a piece of its own.
    "sentences": f"(?s)(?<=[.!?])[{WS}]+|(?:(?!(?<=[.!?])[{WS}]).)+",
}


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scrub(text) -> Column:
    """Well-formed text: U+FFFD for each ill-formed part."""
    return F.make_valid_utf8(col(text).cast("string"))


def matches(text, pattern: str) -> Column:
    return F.regexp_extract_all(col(text), F.lit(pattern), F.lit(0))


def tokens(mode: str, text, newline_is_token: bool = False, strip_trailing_cr: bool = False) -> Column:
    """Array of a mode's tokens."""
    text = col(text)
    if mode not in R.MODES:
        raise ValueError(f"unknown mode: {mode!r}")
    if mode == "lines" and strip_trailing_cr:
        text = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    if mode == "lines" and newline_is_token:
        mode = "line_parts"
    parts = matches(text, PATTERNS[mode])
    return stitched(parts, bare=False) if mode == "words" else parts


#: Every white-space character, in one string.
SPACES = "".join(map(chr, [*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))


def is_space(c: Column) -> Column:
    """Whether a piece that isn't empty begins with white space: a search in a short string, no regex."""
    return F.lit(SPACES).contains(F.substring(c, 1, 1))


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it.

    Inside a lambda an expression would be computed again for each element; a lambda's own
    variable is not.
    """
    return F.transform(F.array(value), use)[0]


def stitched(parts: Column, bare: bool) -> Column:
    """Words from parts: each solid part, with the white space on either side unless ``bare``."""
    return once(parts, lambda p: _stitched(p, bare))


def _stitched(parts: Column, bare: bool) -> Column:
    at = lambda k: F.try_element_at(parts, k.cast("int"))
    space = lambda c: F.when(is_space(c), c).otherwise(F.lit(""))
    # try_element_at counts from 1, and from the end for a negative place; the first part has none before it.
    before = lambda k: F.when(k > 0, F.coalesce(space(at(k)), F.lit(""))).otherwise(F.lit(""))
    after = lambda k: F.coalesce(space(at(k + 2)), F.lit(""))
    pick = (lambda p, k: F.when(~is_space(p), p)) if bare else (lambda p, k: F.when(~is_space(p), F.concat(before(k), p, after(k))))
    solid = F.filter(F.transform(parts, pick), lambda x: x.isNotNull())
    only_space = (F.size(parts) == 1) & is_space(at(F.lit(1)))
    return F.when(only_space, F.transform(parts, lambda p: F.lit("")) if bare else parts).otherwise(solid)


def token_count(mode: str, text, **options) -> Column:
    return F.size(tokens(mode, text, **options))


def keys(mode: str, text, ignore_case: bool = False, ignore_whitespace: bool = False, newline_is_token: bool = False, strip_trailing_cr: bool = False) -> Column:
    """What a mode's tokens are compared by."""
    if mode == "words":
        out = stitched(matches(col(text), PATTERNS["words"]), bare=True)
    else:
        out = tokens(mode, text, newline_is_token, strip_trailing_cr)
    if mode == "lines" and ignore_whitespace:
        out = F.transform(out, lambda t: F.when(F.lit(newline_is_token) & t.contains("\n"), t).otherwise(trim(t)))
    return F.transform(out, lower) if ignore_case else out


def trim(text) -> Column:
    return F.regexp_replace(col(text), f"\\A[{WS}]+|[{WS}]+\\z", "")


def lower(text) -> Column:
    """Locale-free lower case, with letters newer than the runtime's tables."""
    new = sorted(R.NEW_CASE.items())
    return F.translate(F.lower(col(text)), "".join(chr(a) for a, _ in new), "".join(chr(b) for _, b in new))


def collapse(text) -> Column:
    return trim(F.regexp_replace(col(text), f"[{WS}]+", " "))


def normalize_quotes(text) -> Column:
    return F.translate(col(text), "“”„‘’‚", "\"\"\"'''")


def prepare(text, html: bool = True) -> Column:
    text = col(text)
    return collapse(normalize_quotes(F.regexp_replace(text, "<[^>]*>", " ") if html else text))


def solid_length(text) -> Column:
    """Code points that are not white space."""
    return F.char_length(F.regexp_replace(col(text), f"[{WS}]+", ""))


def display(text) -> Column:
    return F.regexp_replace(col(text), "\\r\\n?", "\n")


def escape(text) -> Column:
    out = display(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def split_lines(value) -> Column:
    return F.transform(matches(value, PATTERNS["lines"]), lambda x: F.regexp_replace(x, "\\r?\\n\\z", ""))


def clamp01(x) -> Column:
    x = col(x).cast("double")
    return F.when(F.isnan(x) | x.isNull() | (x <= 0), F.lit(0.0)).otherwise(F.least(x, F.lit(1.0)))


def percent(similarity) -> Column:
    return F.floor(col(similarity) * 100.0 + 0.5)


def heat_level(s) -> Column:
    s = col(s)
    return F.when(s >= 1, 0).when(s >= 0.75, 1).when(s >= 0.5, 2).when(s >= 0.25, 3).otherwise(4)


def changed_percent(s) -> Column:
    return F.when(col(s) >= 1, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), 100 - percent(s)))


def hundredths(part, total) -> Column:
    part, total = col(part).cast("long"), col(total).cast("long")
    return F.when(total <= 0, F.lit(0).cast("long")).otherwise(F.floor((2 * part * 10000 + total - F.pmod(2 * part * 10000 + total, 2 * total)) / (2 * total)).cast("long"))


def format_hundredths(h) -> Column:
    h = col(h).cast("long")
    return F.concat(F.floor(h / 100).cast("string"), F.lit("."), F.lpad(F.pmod(h, F.lit(100)).cast("string"), 2, "0"), F.lit("%"))


def wrap_index(index, count) -> Column:
    return F.when(col(count) > 0, F.pmod(col(index), col(count))).otherwise(F.lit(-1))


# --- over change lists: ARRAY<STRUCT<value, added, removed, count>> -------------------------------------------


def rebuilt(changes, side: str) -> Column:
    """The old or new text of a change list (any mode but words; default options)."""
    keep = (lambda c: ~c["added"]) if side == "old" else (lambda c: ~c["removed"])
    return F.array_join(F.transform(F.filter(col(changes), keep), lambda c: c["value"]), "")


def _sum(changes: Column, keep, of) -> Column:
    return F.aggregate(F.filter(changes, keep), F.lit(0).cast("long"), lambda t, c: t + of(c))


def stats(changes, of=lambda c: F.char_length(c["value"])) -> Column:
    """Code points by kind; ``of`` may measure something else, as c["count"] for tokens."""
    c = col(changes)
    kinds = {"added": lambda x: x["added"], "removed": lambda x: x["removed"], "unchanged": lambda x: ~x["added"] & ~x["removed"]}
    return F.when(c.isNotNull(), F.struct(*[_sum(c, keep, of).alias(k) for k, keep in kinds.items()], F.lit("codepoints").alias("unit")))


def similarity_of(changes, old, new) -> Column:
    total = solid_length(old) + solid_length(new)
    same = _sum(col(changes), lambda x: ~x["added"] & ~x["removed"], lambda c: solid_length(c["value"]))
    return F.when(total == 0, F.lit(1.0)).otherwise(clamp01((2 * same).cast("double") / total))


def indexed(changes) -> Column:
    """Changes without empty values, each with its running number among the changed ones and its offset in the new text."""
    c = F.filter(col(changes), lambda x: x["value"] != "")
    zero = F.struct(F.array().cast("array<struct<value:string,added:boolean,removed:boolean,count:int,index:int,offset:int>>").alias("done"), F.lit(0).alias("n"), F.lit(0).alias("at"))

    def step(t, x):
        changed = x["added"] | x["removed"]
        one = F.struct(x["value"].alias("value"), x["added"].alias("added"), x["removed"].alias("removed"), x["count"].cast("int").alias("count"), F.when(changed, t["n"]).alias("index"), t["at"].alias("offset"))
        return F.struct(F.array_append(t["done"], one).alias("done"), (t["n"] + changed.cast("int")).alias("n"), (t["at"] + F.when(x["removed"], 0).otherwise(F.char_length(x["value"]))).alias("at"))

    return F.aggregate(c, zero, step, lambda t: t["done"])


def render_text(mode: str, changes, id_prefix: str = "td", anchors: bool = False) -> Column:
    """Markup of a text mode's change list."""
    from ..operators.render import CLASSES

    prefix = R.escape(id_prefix)

    def span(x):
        text = F.concat(escape(x["value"]), F.lit("</span>"))
        number = x["index"].cast("string")
        anchor = F.concat(F.lit(f' id="{prefix}-change-'), number, F.lit('"')) if anchors else F.lit("")
        kind = F.when(x["added"], F.lit("added")).otherwise(F.lit("removed"))
        return F.when(x["index"].isNull(), F.concat(F.lit("<span>"), text)).otherwise(F.concat(F.lit('<span class="diff-'), kind, F.lit('"'), anchor, F.lit(' data-change-index="'), number, F.lit('">'), text))

    return F.concat(F.lit(f'<div class="text-diff text-diff-{CLASSES[mode]}">'), F.array_join(F.transform(indexed(changes), span), ""), F.lit("</div>"))


def text_marks(changes) -> Column:
    """Minimap marks of a change list."""
    total = _sum(col(changes), lambda x: ~x["removed"], lambda c: F.char_length(c["value"]))

    def one(x, total):
        end = x["offset"] + F.when(x["removed"], 0).otherwise(F.char_length(x["value"]))
        top = hundredths(x["offset"], total)
        return F.struct(x["index"].alias("index"), F.when(x["added"], F.lit("added")).otherwise(F.lit("removed")).alias("kind"), top.cast("int").alias("top"), (hundredths(end, total) - top).cast("int").alias("height"))

    # The total goes in as data: a kernel's column may not be named inside a lambda.
    whole = F.struct(total.alias("total"), F.filter(indexed(changes), lambda x: x["index"].isNotNull()).alias("marks"))
    return once(whole, lambda w: F.transform(w["marks"], lambda x: one(x, w["total"])))


def render_stats(stats, similarity=None) -> Column:
    s = col(stats)

    def one(kind, shown):
        n = s[kind]
        unit = F.concat(F.when(s["unit"] == "lines", F.lit("line")).otherwise(F.lit("character")), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))
        return F.concat(F.lit(f'<span class="diff-stat diff-stat-{kind}"><span aria-hidden="true">{shown}'), n.cast("string"), F.lit('</span><span class="diff-sr">'), n.cast("string"), F.lit(" "), unit, F.lit(f" {kind}</span></span>"))

    badge = F.lit("") if similarity is None else F.concat(F.lit('<span class="diff-stat diff-stat-similarity">'), percent(similarity).cast("string"), F.lit("% similar</span>"))
    return F.concat(F.lit('<div class="text-diff-stats" data-unit="'), s["unit"], F.lit('">'), one("added", "+"), one("removed", "−"), one("unchanged", "="), badge, F.lit("</div>"))


INFINITE = math.inf
