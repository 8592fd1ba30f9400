"""Comparison of two HTML documents, shown along the new one's structure.

Tags are atomic tokens; text is cut into words, runs of white space and single
characters, and compared by decoded value. Differences are marked with spans that
hold text and images only.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import deque
from functools import lru_cache
from html.entities import name2codepoint
from itertools import takewhile
from operator import attrgetter
from typing import NamedTuple

from ..functions import rules as R
from ..functions.options import Options
from . import changes as C
from . import engine

# Element names and code-point ranges below are fixed values of the format.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style textarea title xmp iframe noembed noframes".split())
FORMATTING = frozenset("strong em b i u s mark sub sup".split())
BLOCK = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
PHRASING = frozenset("p h1 h2 h3 h4 h5 h6 pre span a em strong b i u s mark sub sup small big code abbr cite q kbd samp var time label button dt legend summary font tt del ins dfn bdi bdo".split())
BREAKING = BLOCK | frozenset("li dt dd tr td th caption thead tbody tfoot br".split())
PARENTS_OF = {
    "li": "ul ol menu", "tr": "table thead tbody tfoot", "td": "tr", "th": "tr", "thead": "table", "tbody": "table", "tfoot": "table", "caption": "table", "colgroup": "table",
    "dt": "dl", "dd": "dl", "option": "select optgroup datalist", "optgroup": "select",
}
CHILDREN_OF = {
    "ul": "li", "ol": "li", "menu": "li", "table": "caption colgroup thead tbody tfoot tr", "thead": "tr", "tbody": "tr", "tfoot": "tr", "tr": "td th", "colgroup": "col",
    "dl": "dt dd div", "select": "option optgroup", "optgroup": "option", "html": "head body", "head": "title meta link style script base noscript template",
}
WRAPPERS = {"tr": ("td",), "table": ("tr", "td"), "thead": ("tr", "td"), "tbody": ("tr", "td"), "tfoot": ("tr", "td"), "ul": ("li",), "ol": ("li",), "menu": ("li",), "dl": ("dd",)}
PARENTS_OF = {k: frozenset(v.split()) for k, v in PARENTS_OF.items()}
CHILDREN_OF = {k: frozenset(v.split()) for k, v in CHILDREN_OF.items()}

WORD_RANGES = "30-39 41-5A 5F 61-7A AA AD B5 BA C0-D6 D8-F6 F8-2FF 370-374 376-37D 37F-383 386 388-481 48A-52F 531-556 561-587 5D0-5EA 620-64A 660-669 66E-6D3 1E00-1FFF"
EXTEND_RANGES = "300-36F 483-489 1AB0-1AFF 1DC0-1DFF 20D0-20FF FE00-FE0F FE20-FE2F 1F3FB-1F3FF E0020-E007F E0100-E01EF"
SPACE_RANGES = "9-D 20 A0 1680 2000-200A 2028-2029 202F 205F 3000 FEFF"


def _classes():
    marks = [(0, "o")]
    for ranges, c in ((WORD_RANGES, "w"), (EXTEND_RANGES, "e"), (SPACE_RANGES, "s"), ("200D", "z"), ("1F1E6-1F1FF", "r")):
        for part in ranges.split():
            a, _, b = part.partition("-")
            marks += [(int(a, 16), c), (int(b or a, 16) + 1, "o")]
    # Where a range starts right after another one, its own mark counts.
    marks.sort(key=lambda m: (m[0], m[1] != "o"))
    return [m[0] for m in marks], [m[1] for m in marks]


_STARTS, _KINDS = _classes()


def class_of(ch: str) -> str:
    """s white space, w word, e extends, z joiner, r regional indicator, o other."""
    return _KINDS[bisect_right(_STARTS, ord(ch)) - 1]


def _pieces() -> re.Pattern:
    """s+|(?:w[we]*+|rr|[^s])(?:e|z[^s])*+ over the classes of characters."""
    of = {k: "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b, kind in zip(_STARTS, _STARTS[1:], _KINDS) if kind == k and a < b) for k in "swezr"}
    return re.compile("[{s}]+|(?:[{w}][{w}{e}]*+|[{r}][{r}]|[^{s}])(?:[{e}]|[{z}][^{s}])*+".format(**of))


_PIECES = _pieces()
_TAG = re.compile(r"(</?)([A-Za-z][^\t\n\f\r />\"']*+)(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_RAW_ENDS = {name: re.compile(f"</{name}[\\t\\n\\f\\r />]", re.I | re.A) for name in RAW_TEXT}
_ENTITY = re.compile(r"&(?:#([0-9]+)|#[xX]([0-9a-fA-F]+)|([A-Za-z][A-Za-z0-9]*));|(.)", re.S)
_BLANKS = re.compile(r"[\t\n\f\r ]+").sub
_BLANK = "\t\n\f\r "


class Segment(NamedTuple):
    kind: str
    raw: str
    name: str = ""
    closed: bool = True


class Token(NamedTuple):
    kind: str
    raw: str
    name: str
    key: str
    size: int = 0


_size = attrgetter("size")


class Item(NamedTuple):
    """A run that both documents share (its tokens on each side), or a change (removed, added)."""

    same: bool
    old: list
    new: list


def ascii_lower(s: str) -> str:
    return s.lower() if s.isascii() else s.translate({k: k + 32 for k in range(65, 91)})


def segments(s: str) -> list[Segment]:
    """Lossless pieces of a document."""
    out: list[Segment] = []
    text_at = at = 0
    while (at := s.find("<", at)) >= 0:
        found = construct(s, at)
        if found is None:
            at += 1
            continue
        if at > text_at:
            out.append(Segment("text", s[text_at:at]))
        out.append(found)
        at = text_at = at + len(found.raw)
    if len(s) > text_at:
        out.append(Segment("text", s[text_at:]))
    return out


def construct(s: str, at: int) -> Segment | None:
    """What starts at a ``<``; None if that is text."""
    after = s[at + 1 : at + 3]
    if after[:1] in ("!", "?"):
        if s.startswith("<!--", at):
            end = s.find("-->", at + 4)
            return Segment("comment", s[at:] if end < 0 else s[at : end + 3])
        if s.startswith("<![CDATA[", at):
            end = s.find("]]>", at + 9)
            return None if end < 0 else Segment("opaque", s[at : end + 3])
        if after[0] == "?" or after[1:].isascii() and after[1:].isalpha():
            end = s.find(">", at + 2)
            return None if end < 0 else Segment("opaque", s[at : end + 1])
        return None
    m = _TAG.match(s, at)
    if not m:
        return None
    name = ascii_lower(m[2])
    if m[1] == "</":
        return Segment("close", m[0], name)
    if name in VOID or m[0].endswith("/>"):
        return Segment("void", m[0], name)
    if name not in RAW_TEXT:
        return Segment("open", m[0], name)
    close = _RAW_ENDS[name].search(s, m.end())
    end = s.find(">", close.end() - 1) if close else -1
    return Segment("raw", s[at:], name, False) if end < 0 else Segment("raw", s[at : end + 1], name)


def strip_formatting(s: str) -> str:
    """The document without formatting tags, all else byte for byte."""
    return "".join(x.raw for x in segments(s) if x.name not in FORMATTING or x.kind not in ("open", "close", "void"))


def numeric(digits: str, base: int) -> str:
    d = digits.lstrip("0")
    v = int(d, base) if d and len(d) <= 8 else 0
    return "�" if v == 0 or v > 0x10FFFF or 0xD800 <= v <= 0xDFFF else chr(v)


def named(name: str) -> str | None:
    """The 252 names of HTML 4.01, and apos."""
    return "'" if name == "apos" else chr(name2codepoint[name]) if name in name2codepoint else None


def units(text: str) -> list[tuple[str, str]]:
    """(source form, character) of each decoded code point."""
    out = []
    for m in _ENTITY.finditer(text):
        if m[4] is not None:
            out.append(("&lt;" if m[4] == "<" else m[4], m[4]))
            continue
        ch = numeric(m[1], 10) if m[1] else numeric(m[2], 16) if m[2] else named(m[3])
        out += [(m[0], ch)] if ch is not None else [(c, c) for c in m[0]]
    return out


def decode_text(text: str) -> str:
    return "".join(c for _, c in units(text))


class Known(dict):
    """The token of each piece of plain text in one context, shared by all documents of a worker."""

    #: Pieces kept, and the longest one that is, in code points.
    MOST, LONGEST = 50_000, 64

    def __init__(self, context: str, ignore_case: bool):
        self.context, self.ignore_case = context, ignore_case

    def token(self, raw: str, piece: str) -> Token:
        shown = piece
        if not piece.isalnum():
            if class_of(piece[0]) == "s":
                return Token("space", raw, "", " ")
            shown = R.normalize_quotes(piece)
        return _token(Token, ("text", raw, "", f"t{self.context}>{R.lower(shown) if self.ignore_case else shown}", len(piece)))

    def __missing__(self, piece: str) -> Token:
        t = self.token(piece, piece)
        if len(piece) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[piece] = t
        return t


known = lru_cache(4)(Known)
_token = tuple.__new__


def text_tokens(text: str, context: str, ignore_case: bool):
    of = known(context, ignore_case)
    if "&" not in text and "<" not in text:
        return map(of.__getitem__, _PIECES.findall(text))
    u = units(text)
    raws = [r for r, _ in u]
    parts = ((m[0], "".join(raws[m.start() : m.end()])) for m in _PIECES.finditer("".join(c for _, c in u)))
    return (of[piece] if raw == piece else of.token(raw, piece) for piece, raw in parts)


def void_attributes(raw: str, name: str) -> str:
    tight = lambda s: _BLANKS(" ", s).removeprefix(" ").removesuffix(" ")
    return tight(tight(raw[1 + len(name) : -1]).removesuffix("/"))


def tokens(s: str, ignore_case: bool = False, ignore_formatting: bool = True) -> list[Token]:
    out: list[Token] = []
    formats: list[str] = []
    for x in segments(s):
        if x.kind == "comment":
            continue
        if x.kind in ("opaque", "raw"):
            raw = x.raw if x.closed else f"{x.raw}</{x.name}>"
            out.append(Token(x.kind, raw, x.name, "!" + raw))
        elif x.kind == "text":
            out += text_tokens(x.raw, ",".join(sorted(set(formats))) if formats else "", ignore_case)
        else:
            if x.name in FORMATTING:
                if ignore_formatting:
                    continue
                if x.kind == "open":
                    formats.append(x.name)
                elif x.kind == "close" and x.name in formats:
                    del formats[len(formats) - 1 - formats[::-1].index(x.name)]
            out.append(tag_token(x) if len(x.raw) <= 256 else tag_token.__wrapped__(x))
    return out


@lru_cache(4096)
def tag_token(x: Segment) -> Token:
    key = ("</" if x.kind == "close" else "<") + x.name + (f"/{void_attributes(x.raw, x.name)}" if x.kind == "void" else "")
    return Token(x.kind, x.raw, x.name, key)


def items(a: list[Token], b: list[Token], limit: int | None) -> list[Item]:
    """Shared runs and changes in turn."""
    key = attrgetter("key")
    ops = engine.script(*engine.intern(list(map(key, a)), list(map(key, b))), limit)
    if ops is None:
        ops = [(engine.REMOVE, len(a)), (engine.INSERT, len(b))]
    out: list[Item] = []
    i = j = 0
    change = None  # the last item, if it is a change
    for op, n in ops:
        if op == engine.EQUAL:
            change = None
            out.append(Item(True, a[i : i + n], b[j : j + n]))
            i, j = i + n, j + n
            continue
        if change is None:
            change = Item(False, [], [])
            out.append(change)
        if op == engine.REMOVE:
            change.old.extend(a[i : i + n])
            i += n
        else:
            change.new.extend(b[j : j + n])
            j += n
    return out


def joined(*parts: Item) -> Item:
    return Item(False, [t for p in parts for t in p.old], [t for p in parts for t in p.new])


def unpaired(run: list[Token]) -> int:
    """Tags of a run without a partner in it."""
    opens: list[str] = []
    stray = 0
    for t in run:
        if t.kind == "open":
            opens.append(t.name)
        elif t.kind == "close":
            if opens and opens[-1] == t.name:
                opens.pop()
            else:
                stray += 1
    return stray + len(opens)


def reach(a, b) -> int:
    """How many tokens in a row have the same keys."""
    return sum(1 for _ in takewhile(lambda p: p[0].key == p[1].key, zip(a, b)))


def slide(run: list[Item]) -> list[Item]:
    """Shifts one-sided changes along equal tokens where that leaves fewer unpaired tags.

    Items go from ``todo`` to ``done``; what a shift does to both neighbours is settled before
    the next item is looked at. Of the places that a change can take, the one with the fewest
    unpaired tags counts, its own one first, then the nearest, then the left one.
    """
    done: list[Item] = []
    todo = deque(run)
    while todo:
        item = todo.popleft()
        if item.same or bool(item.old) == bool(item.new):
            done.append(item)
            continue
        mine = attrgetter("old" if item.old else "new")
        mates = attrgetter("new" if item.old else "old")
        before = done[-1:] if done and done[-1].same else []
        after = [todo[0]] if todo and todo[0].same else []
        ahead, behind = ([t for x in xs for t in mine(x)] for xs in (before, after))
        line, home, size = ahead + mine(item) + behind, len(ahead), len(mine(item))
        left = [mine(done[-2])] if before and len(done) > 1 else []
        right = [mine(todo[1])] if after and len(todo) > 1 else []

        def strays(at: int) -> int:
            """Unpaired tags of the change at a place and of the changes around, which it joins at the ends."""
            window = line[at : at + size]
            apart = []
            for side, touches, order in ((left, at == 0, 1), (right, at + size == len(line), -1)):
                if touches:
                    window = [t for part in [*side, window][::order] for t in part]
                else:
                    apart += side
            return unpaired(window) + sum(map(unpaired, apart))

        first = home - reach(reversed(line[:home]), reversed(line[: home + size]))
        last = home + reach(line[home:], line[home + size :])
        best = home if first == last else min(range(first, last + 1), key=lambda at: (strays(at), at != home, abs(at - home), at))
        if best == home:
            done.append(item)
            continue
        other = [t for x in (*before, *after) for t in mates(x)]
        pair = (lambda own, their, same: Item(same, own, their)) if item.old else (lambda own, their, same: Item(same, their, own))
        del done[len(done) - len(before) :]
        if after:
            todo.popleft()
        moved = pair(line[best : best + size], [], False)
        if best:
            done.append(pair(line[:best], other[:best], True))
        elif done and not done[-1].same:
            moved = joined(done.pop(), moved)
        if best + size < len(line):
            todo.appendleft(pair(line[best + size :], other[best:], True))
        elif todo and not todo[0].same:
            moved = joined(moved, todo.popleft())
        done.append(moved)
    return done


def text_size(run: list[Token]) -> int:
    """Code points of the text; other tokens have no size."""
    return sum(map(_size, run))


def group_orphans(run: list[Item], threshold: float) -> list[Item]:
    """Takes short shared text between changes into them."""
    sizes = [text_size(x.new) if x.same else text_size(x.old) + text_size(x.new) for x in run]

    def orphan(k: int) -> bool:
        if not run[k].same or k == 0 or k + 1 >= len(run):
            return False
        around = sum(text_size(run[n].old) + sizes[n] if run[n].same else sizes[n] for n in (k - 1, k + 1))
        return around > 0 and sizes[k] / around < threshold and all(t.kind in ("text", "space") for x in (run[k].old, run[k].new) for t in x)

    out: list[Item] = []
    own = -1  # the place in ``out`` of a change with lists of its own
    k = 0
    while k < len(run):
        if orphan(k) and out and not out[-1].same:
            if own != len(out) - 1:
                own = len(out) - 1
                out[own] = joined(out[own])
            for x in (run[k], run[k + 1]):
                out[own].old.extend(x.old)
                out[own].new.extend(x.new)
            k += 2
        else:
            out.append(run[k])
            k += 1
    return out


class Writer:
    """Writes items as balanced markup; markers hold text and images only."""

    def __init__(self):
        self.open: list[str] = []
        self.out: list[str] = []
        self.index = 0

    def mark(self, kind: str, content: str) -> None:
        """A marker, inside what its parent element has to have around text."""
        if not content:
            return
        wraps: tuple[str, ...] = ()
        if self.open and self.open[-1] in CHILDREN_OF:
            if not content.strip(_BLANK):
                self.out.append(content if kind == "added" else "")
                return
            wraps = WRAPPERS.get(self.open[-1], ()) if kind == "removed" else ()
        span = f'<span class="diff-{kind}" data-change-index="{self.index}">{content}</span>'
        self.out.append("".join(f"<{w}>" for w in wraps) + span + "".join(f"</{w}>" for w in reversed(wraps)))
        self.index += 1

    def tag(self, t: Token) -> None:
        """A tag of the new document; a close tag without its element is dropped."""
        if t.kind == "open":
            self.open.append(t.name)
        elif t.kind == "close":
            if t.name not in self.open:
                return
            while self.open[-1] != t.name:
                self.out.append(f"</{self.open.pop()}>")
            self.open.pop()
        self.out.append(t.raw)

    def fits(self, name: str) -> bool:
        """Whether a removed element may stand here."""
        parent = self.open[-1] if self.open else None
        if name in ("html", "head", "body"):
            return False
        if name in PARENTS_OF:
            return parent in PARENTS_OF[name]
        if parent is None:
            return True
        if parent in CHILDREN_OF:
            return name in CHILDREN_OF[parent]
        if name in BLOCK:
            return parent not in PHRASING
        return name != "a" or "a" not in self.open

    def added(self, run: list[Token]) -> None:
        held = ""
        for t in run:
            if content(t):
                held += t.raw
            else:
                self.mark("added", held)
                held = ""
                self.tag(t)
        self.mark("added", held)

    def removed(self, run: list[Token]) -> None:
        partner: dict[int, int] = {}
        opens: list[int] = []
        for k, t in enumerate(run):
            if t.kind == "open":
                opens.append(k)
            elif t.kind == "close" and opens and run[opens[-1]].name == t.name:
                partner[opens.pop()] = k
        held, apart, kept = "", False, set()
        for k, t in enumerate(run):
            if content(t):
                if apart and held[-1:] not in _BLANK and t.raw[:1] not in _BLANK:
                    held += " "
                held, apart = held + t.raw, False
            elif k in kept or k in partner and self.fits(t.name):
                # ``fits`` looks at the stack before the text in hand is written; writing doesn't change it.
                self.mark("removed", held)
                held, apart = "", False
                self.out.append(t.raw)
                if k in kept:
                    self.open.pop()
                else:
                    kept.add(partner[k])
                    self.open.append(t.name)
            elif held and t.name in BREAKING:
                apart = True
        self.mark("removed", held)

    def text(self) -> str:
        return "".join(self.out) + "".join(f"</{x}>" for x in reversed(self.open))


def content(t: Token) -> bool:
    return t.kind in ("text", "space") or t.kind == "void" and t.name == "img"


def write(run: list[Item]) -> str:
    w = Writer()
    for it in run:
        if it.same:
            for t in it.new:
                w.out.append(t.raw) if t.kind in ("text", "space") else w.tag(t)
        else:
            w.removed(it.old)
            w.added(it.new)
    return w.text()


def diff(old: str, new: str, o: Options = Options()) -> dict:
    """html, fullReplacement and, if a threshold was given, similarity."""
    old, new = R.scrub(old), R.scrub(new)
    extra = {}
    if o.similarity_threshold is not None and old and new:
        extra["similarity"] = C.similarity(old, new)
        if extra["similarity"] < o.similarity_threshold:
            return {"html": f'<div class="diff-removed" data-change-index="0">{old}</div><div class="diff-added" data-change-index="1">{new}</div>', "fullReplacement": True, **extra}
    a, b = (tokens(s, o.ignore_case, o.ignore_formatting_tags) for s in (old, new))
    return {"html": write(group_orphans(slide(items(a, b, o.max_edit_length)), o.orphan_match_threshold)), "fullReplacement": False, **extra}
