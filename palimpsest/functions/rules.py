"""The string rules every comparison shares, in Python (by code points)."""

from __future__ import annotations

import math
import re

#: White space: exactly these code points (fixed values), as a regex class body.
WS = "\\t-\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
#: Word characters of the text modes (fixed values), as a regex class body.
W = "a-zA-Z0-9_\\u00ad\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u02c6\\u02c8-\\u02d7\\u02de-\\u02ff\\u1e00-\\u1eff"
#: Capital letters newer than the runtime's tables, with their small forms (fixed values): single pairs, then ranges.
NEW_CASE = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
NEW_CASE |= {0x10D50 + k: 0x10D70 + k for k in range(22)} | {0x16EA0 + k: 0x16EBB + k for k in range(25)}

MODES = ("chars", "words", "wordsWithSpace", "lines", "sentences")
VIEWS = (*MODES, "unified", "split")

_ws_runs = re.compile(f"[{WS}]+").sub
_edges = re.compile(f"\\A[{WS}]+|[{WS}]+\\Z").sub
_lead = re.compile(f"[{WS}]*").match
_trail = re.compile(f"[{WS}]*\\Z").search
_tags = re.compile("<[^>]*>").sub
_quotes = re.compile("([\u201c\u201d\u201e])|[\u2018\u2019\u201a]").sub
_words = re.compile(f"[{W}]+|[{WS}]+|[^{W}]", re.S).findall
_solids = re.compile(f"[{W}]+|[^{W}{WS}]", re.S).findall
_spaced = re.compile(f"[{W}]+|\\r?\\n|[\\t\\v\\f \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+|[^{W}]", re.S).findall
_lines = re.compile("[^\\n]*\\n|[^\\n]+").findall
_line_parts = re.compile("\\r?\\n|(?:[^\\r\\n]|\\r(?!\\n))+").findall
_sentence_cuts = re.compile(f"(?<=[.!?])([{WS}]+)").split
_surrogates = re.compile("[\ud800-\udfff]").sub
_terminator = re.compile("\\r?\\n\\Z").sub


def scrub(text: str | bytes) -> str:
    """Well-formed text: U+FFFD for each ill-formed part."""
    if isinstance(text, (bytes, bytearray)):
        return bytes(text).decode("utf-8", "replace")
    return text if text.isascii() else _surrogates("�", text)


def lower(s: str) -> str:
    return s.lower().translate(NEW_CASE)


def trim(s: str) -> str:
    return _edges("", s)


def collapse(s: str) -> str:
    return trim(_ws_runs(" ", s))


def leading(s: str) -> str:
    return _lead(s)[0]


def trailing(s: str) -> str:
    return _trail(s)[0]


def solid_length(s: str) -> int:
    """Code points that are not white space."""
    return len(_ws_runs("", s))


def normalize_quotes(s: str) -> str:
    return s if s.isascii() else _quotes(lambda m: '"' if m[1] else "'", s)


def prepare(s: str, html: bool = True) -> str:
    """What similarity looks at."""
    return collapse(normalize_quotes(_tags(" ", s) if html else s))


def solids(s: str, html: bool = True) -> list[str]:
    """The words and signs of ``prepare``d text: all that is left of its tokens in words mode without white space."""
    return _solids(normalize_quotes(_tags(" ", s) if html else s))


def clamp01(x: float) -> float:
    return min(x, 1.0) if x > 0 else 0.0


def percent(similarity: float) -> int:
    return math.floor(similarity * 100 + 0.5)


def display(s: str) -> str:
    """Line ends as they are shown."""
    return s.replace("\r\n", "\n").replace("\r", "\n")


def escape(s: str) -> str:
    return display(s).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#39;")


def split_lines(value: str) -> list[str]:
    """Lines without their terminators; a lone carriage return stays."""
    return [_terminator("", x) for x in _lines(value)]


def tokens(mode: str, text: str, newline_is_token: bool = False, strip_trailing_cr: bool = False) -> tuple[list[str], list[str]]:
    """Tokens and the bare parts that words are compared by (for other modes the tokens)."""
    if mode == "chars":
        out = list(text)
    elif mode == "wordsWithSpace":
        out = _spaced(text)
    elif mode == "lines":
        text = text.replace("\r\n", "\n") if strip_trailing_cr else text
        out = _line_parts(text) if newline_is_token else _lines(text)
    elif mode == "sentences":
        out = [t for t in _sentence_cuts(text) if t]
    elif mode == "words":
        return _stitched(_words(text))
    else:
        raise ValueError(f"unknown mode: {mode!r}")
    return out, out


def _stitched(parts: list[str]) -> tuple[list[str], list[str]]:
    """Each solid part with the white space on either side of it; text of white space only is one token."""
    space = [bool(leading(p)) for p in parts]
    if len(parts) == 1 and space[0]:
        return parts, [""]
    last = len(parts) - 1
    solid = [k for k, s in enumerate(space) if not s]
    before = lambda k: parts[k - 1] if k > 0 and space[k - 1] else ""
    after = lambda k: parts[k + 1] if k < last and space[k + 1] else ""
    return [before(k) + parts[k] + after(k) for k in solid], [parts[k] for k in solid]


def heat_level(s: float) -> int:
    return 0 if s >= 1 else 1 if s >= 0.75 else 2 if s >= 0.5 else 3 if s >= 0.25 else 4


def changed_percent(s: float) -> int:
    return 0 if s >= 1 else max(1, 100 - percent(s))


def hundredths(part: int, total: int) -> int:
    """part / total in hundredths of a percent, halves up, in integers."""
    return 0 if total <= 0 else (2 * part * 10000 + total) // (2 * total)


def format_hundredths(h: int) -> str:
    return f"{h // 100}.{h % 100:02d}%"
