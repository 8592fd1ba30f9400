"""The thirteen entry points, as columns: markup of each view, statistics and similarity.

Old and new text are columns or their names; options have the names of ``Options.of``. ``timeline``
takes a DataFrame of revisions and gives one row a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from .functions import columns as N
from .operators import frames as K
from .plans import timeline as T


def _view(view: str):
    def markup(old, new, **options) -> Column:
        return K.render(view, old, new, **options)

    markup.__name__, markup.__doc__ = view, f"Markup of the {view} view."
    return markup


chars, words, words_with_space, lines, sentences = map(_view, ("chars", "words", "wordsWithSpace", "lines", "sentences"))
unified, split, heatmap, html = map(_view, ("unified", "split", "heatmap", "html"))


def stats(old, new, mode: str = "words", with_similarity: bool = True, **options) -> Column:
    """Markup of a view's statistics and, unless not wanted, the similarity of the plain texts."""
    return N.render_stats(K.statistics(mode, old, new, **options), K.similarity(old, new, html=False) if with_similarity else None)


def similarity(old, new, html: bool = True) -> Column:
    """From 0 to 1, with a direction; tags are left out unless ``html`` is false."""
    return K.similarity(old, new, html)


def timeline(revisions: DataFrame, key: str, order: str, text: str, label: str | None = None, mode: str = "words", **options) -> DataFrame:
    """key, html: each key's revisions as a step switcher."""
    return T.render(revisions, key, order, text, label, mode, **options)


def playback(old, new, mode: str = "words", **options) -> Column:
    """Markup of an animated text view."""
    return K.render(f"playback_{mode}", old, new, **options)


ENTRY_POINTS = ("chars", "words", "words_with_space", "lines", "sentences", "html", "unified", "split", "stats", "similarity", "heatmap", "timeline", "playback")
