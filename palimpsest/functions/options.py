"""Options as callers give them, made definite before any plan is built."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

NAMES = {
    "ignoreCase": "ignore_case", "ignoreWhitespace": "ignore_whitespace", "newlineIsToken": "newline_is_token", "stripTrailingCr": "strip_trailing_cr",
    "maxEditLength": "max_edit_length", "contextLines": "context_lines", "detectMoves": "detect_moves", "minMoveLines": "min_move_lines", "moveSimilarity": "move_similarity",
    "idPrefix": "id_prefix", "showRemoved": "show_removed", "similarityThreshold": "similarity_threshold", "ignoreFormattingTags": "ignore_formatting_tags", "orphanMatchThreshold": "orphan_match_threshold",
}


def number(x) -> float | None:
    """A number other than NaN, or None."""
    return x if isinstance(x, (int, float)) and not isinstance(x, bool) and not math.isnan(x) else None


def floored(x):
    return x if math.isinf(x) else math.floor(x)


@dataclass(frozen=True)
class Options:
    ignore_case: bool = False
    ignore_whitespace: bool = False
    newline_is_token: bool = False
    strip_trailing_cr: bool = False
    max_edit_length: int | None = None
    context_lines: float = 3
    detect_moves: bool = False
    min_move_lines: float = 1
    move_similarity: float = 1.0
    id_prefix: str = "td"
    anchors: bool = False
    show_removed: bool = True
    legend: bool = True
    similarity_threshold: float | None = None
    ignore_formatting_tags: bool = True
    orphan_match_threshold: float = 0.3
    speed: object = None
    labels: tuple = ()

    @classmethod
    def of(cls, **given) -> "Options":
        """From names in either style; what has no meaning falls back to its default, unknown names are ignored."""
        known = {f.name for f in fields(cls)}
        raw = {NAMES.get(k, k): v for k, v in given.items()}
        raw = {k: v for k, v in raw.items() if k in known and v is not None}
        out = {}
        for k, v in raw.items():
            if k in ("ignore_case", "ignore_whitespace", "newline_is_token", "strip_trailing_cr"):
                out[k] = bool(v)
            elif k in ("detect_moves", "anchors"):
                out[k] = v is True
            elif k in ("show_removed", "legend", "ignore_formatting_tags"):
                out[k] = v is not False
            elif k == "max_edit_length":
                x = number(v)
                if x is not None and floored(x) >= 0 and not math.isinf(x):
                    out[k] = floored(x)
            elif k == "context_lines":
                x = number(v)
                out[k] = floored(x) if x is not None and x >= 0 else 3
            elif k == "min_move_lines":
                x = number(v)
                out[k] = floored(x) if x is not None and x >= 1 else 1
            elif k == "move_similarity":
                x = number(v)
                out[k] = float(x) if x is not None and 0 < x < 1 else 1.0
            elif k == "similarity_threshold":
                if (x := number(v)) is not None:
                    out[k] = x
            elif k == "orphan_match_threshold":
                x = number(v)
                out[k] = x if x is not None and not math.isinf(x) else 0.3
            elif k == "id_prefix":
                out[k] = v if isinstance(v, str) and v else "td"
            else:
                out[k] = tuple(v) if k == "labels" else v
        return cls(**out)

    def text(self, mode: str) -> "Options":
        """Only what a text mode knows."""
        lines = mode == "lines"
        return Options(self.ignore_case, lines and self.ignore_whitespace, lines and self.newline_is_token, lines and self.strip_trailing_cr, self.max_edit_length)


def playback_step(speed) -> int | None:
    x = number(speed)
    return math.floor(x) if x is not None and not math.isinf(x) and math.floor(x) >= 1 else None
