"""Operator 8: main text of web pages by equivalence-class template deduction.

All pages of one host are compared. A page is read as tokens, tags with the path
of elements they stand in, and the texts between them. Tokens with the same occurrence
vector (how often they occur in each page of the host that has its shape) form an equivalence class. A
class is valid if its tokens keep one order in every page and each of its occurrences
lies in one gap of the class around it; valid classes nest into a template whose root
is the class that occurs once in each page. What lies between template tokens are slots.
A slot's text that most pages share is part of the template, inside an article element
too; of the other slots, on all pages, those of every element with pieces of running text
and of the heaviest elements are the article, in page order. Bare text of an element with
less than half of the heaviest one's is beside the article. The names article and main
keep text that would be taken for such, and choose nothing else.
Elements that by name, role or class are menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles or reader comments are never text. Inside an article element
only those elements, and blocks whose whole class or role says so, are left out: words
within longer names, ids and the names of paragraphs and headings do not count there.

All that a template needs are sums over pages. Hosts that hold more than a set share of all
pages are counted where their pages are, partial sums are merged, and the one template of
a host and shape is sent to all its pages; the pages of another host meet in one task. The
result is the same either way and does not depend on the number of partitions.

Null html is empty: an empty text. A null url is a host of its own. Exact copies of a
page count once in the vectors. Repeated rows and further columns change nothing; empty
tables give empty results. Each text is whole: nothing inside the article is cut.
"""

from __future__ import annotations

import html as entities
import pickle
import re
import zlib
from collections import Counter, defaultdict
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import kept

#: Pages of a host that one task compares in any case.
GROUP = 48
#: A host with more pages than a partition's share divided by this is counted by all tasks.
HOT_SHARE = 4

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|textarea|iframe|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|<(/?)([a-z][a-z0-9:-]*)([^>]*)(?:>|\Z)|([^<]+|<)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
NAMES = re.compile(r"[a-z]+|\d+")

#: Elements without content, elements that stand in a line of text, and which open elements an element ends (fixed values of HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym annotation b bdi bdo big cite code data del dfn em font g i img ins kbd label mark math mfrac mi mn mo mover mroot mrow ms msqrt mstyle msub msubsup msup mtext munder path q rp rt ruby s samp semantics small span strike strong sub sup svg text time tspan tt u var wbr".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())
SCOPE = frozenset("article aside body div footer form header html main nav ol section table td th ul".split())

#: What is not an article, by element and by words of class, id and role (our choice).
NOT_TEXT = frozenset("nav footer aside form menu dialog button select input object canvas audio video head".split())
NOT_TEXT_WORDS = frozenset("nav navigation navbar menu sidebar footer ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent notice alert popup modal overlay comment comments reply replies discussion breadcrumb breadcrumbs share sharing social related recommended newsletter subscribe subscription signup login search pagination pager toolbar widget complementary contentinfo skip disclaimer gdpr".split())
#: Whole classes and roles that are not an article's text inside an article element either, of blocks (our choice).
NOT_TEXT_BLOCKS = frozenset("nav navigation navbar menu sidebar footer ad ads advert adverts advertisement advertising sponsor sponsored promo cookie-notice cookie-banner comments comment-list breadcrumb breadcrumbs newsletter pagination share-buttons related-posts complementary contentinfo banner search".split())
BLOCKS = frozenset("div section ul ol table dl details figure".split())
HEADER_WORDS = frozenset(("header", "masthead", "topbar", "banner"))
#: Elements that hold pieces of running text rather than all of it.
FLOW = frozenset("p li ul ol h1 h2 h3 h4 h5 h6 blockquote pre dd dt dl td th tr tbody table figure figcaption".split())


class Page:
    """Tokens of a page and its blocks of text."""

    def __init__(self, source: str):
        self.tokens: list[str] = []
        #: (text, path, links' share of characters, place among the tokens, left out by name, inside an article element)
        self.blocks: list[tuple[str, tuple[str, ...], int, int, bool, bool]] = []
        self.stack: list[tuple[str, str, bool, bool]] = []  # name, signature, left out, in an article
        self.parts: list[str] = []
        self.linked = 0
        for m in TOKEN.finditer(source):
            text = m[8]
            if text is not None:
                self.parts.append(text)
                if any(s[0] == "a" for s in self.stack[-4:]):
                    self.linked += len(text)
                continue
            name = (m[3] or m[6] or "").lower()
            if not name:
                if m[1]:
                    self.tokens.append(self.where(m[1].lower()))
                    if m[1].lower() != "title":
                        continue
                    self.end_block()
                continue
            if m[2] or m[5]:
                self.close(name)
            else:
                self.open(name, m[4] or m[7] or "")
        self.end_block()
        del self.stack, self.parts

    def where(self, what: str) -> str:
        return "/".join(s[1] for s in self.stack if s[0] not in INLINE) + "/" + what

    def open(self, name: str, attributes: str) -> None:
        if name not in INLINE:
            self.end_block()
        ends = ENDS.get(name, frozenset()) | ({"p"} if name in ENDS_P else frozenset())
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in ends:
                del self.stack[k:]
                break
            if self.stack[k][0] in SCOPE:
                break
        found = {a.lower(): (b or c or d) for a, b, c, d in ATTRIBUTE.findall(attributes)} if attributes else {}
        kinds = {x for a in ("class", "role") for x in found.get(a, "").lower().split()}
        inside = bool(self.stack) and self.stack[-1][3]
        out = bool(self.stack) and self.stack[-1][2]
        article = name in ("article", "main") or found.get("role", "").lower() in ("main", "article")
        out = out or name in NOT_TEXT
        if inside:
            out = out or name in BLOCKS and bool(kinds & NOT_TEXT_BLOCKS)
        elif name not in ("body", "html"):
            words = set(NAMES.findall(" ".join(found.values()).lower()))
            out = out or bool(words & NOT_TEXT_WORDS) or not article and (name == "header" or bool(words & HEADER_WORDS))
        signature = name + "".join(f".{w}" for w in sorted(found.get("class", "").split()) if sum(c.isdigit() for c in w) < 2) + (f"#{found['id']}" if found.get("id") and not any(c.isdigit() for c in found["id"]) else "")
        if name not in INLINE:
            self.tokens.append(self.where(signature))
        if name not in VOID and not attributes.endswith("/"):
            self.stack.append((name, signature, out, (inside or article) and not out))

    def close(self, name: str) -> None:
        if name not in INLINE:
            self.end_block()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == name:
                del self.stack[k:]
                break
            if name in INLINE and self.stack[k][0] in SCOPE:
                break
        if name not in INLINE:
            self.tokens.append(self.where("/" + name))

    def end_block(self) -> None:
        if self.parts:
            text = " ".join(entities.unescape("".join(self.parts)).split())
            if text:
                top = self.stack[-1] if self.stack else ("", "", False, False)
                path = tuple(s[1] for s in self.stack if s[0] not in INLINE)
                self.blocks.append((text, path, self.linked, len(self.tokens), top[2], top[3]))
            self.parts, self.linked = [], 0


class Outline:
    """What counts are taken from: a page's tokens, and its blocks without their texts."""

    def __init__(self, page: Page, source: str):
        self.shape, self.tokens = shape(page), page.tokens
        #: (text's hash, path, characters if not mostly links, place among the tokens, left out, inside an article)
        self.blocks = [(text_hash(b[0]), b[1], len(b[0]) if b[2] * 2 <= len(b[0]) else 0, *b[3:]) for b in page.blocks]
        self.number = int.from_bytes(blake2b(source.encode("utf-8", "replace"), digest_size=8).digest(), "little")

    def places(self, among=None) -> dict[str, list[int]]:
        at = defaultdict(list)
        for k, t in enumerate(self.tokens):
            if among is None or t in among:
                at[t].append(k)
        return at


def text_hash(text: str) -> str:
    return blake2b(text.encode("utf-8", "replace"), digest_size=9).hexdigest()


# Counts of a page, (key, three or five numbers): sums over pages are all that a template needs.


def token_counts(page: Outline, template=None):
    """Occurrence vectors, as sums of a hash of (page, occurrences): equal sums, equal vectors."""
    yield "n", (1, 0, 0, 0, 0)
    for t, ks in page.places().items():
        x = (page.number ^ (len(ks) * 0x9E3779B97F4A7C15)) * 0xBF58476D1CE4E5B9 % (1 << 64)
        x = (x ^ x >> 31) * 0x94D049BB133111EB % (1 << 64)
        yield "t" + t, (1, len(ks), x >> 33, x >> 2 & 0x7FFFFFFF, ks[0])


def order_counts(page: Outline, template: Template):
    """Root tokens that the page has in another order; gaps and disorder of inner classes."""
    at, best = page.places(template.known), -1
    for t in template.root:
        if at[t][0] > best:
            best = at[t][0]
        else:
            yield "r" + t, (1, 0, 0, 0, 0)
    gap = template.gaps(page.tokens)
    for k, tokens in enumerate(template.classes):
        held = [at.get(t, []) for t in tokens]
        flat = [x for row in zip(*held) for x in row]
        if any(len(h) != len(held[0]) for h in held) or flat != sorted(flat):
            yield f"b{k}", (1, 0, 0, 0, 0)
        for g in {gap[x] for h in held for x in h}:
            yield f"g{k} {g}", (1, 0, 0, 0, 0)


def slot_counts(page: Outline, template: Template):
    """Texts by slot, and elements by their text."""
    gap, texts, homes = template.gaps(page.tokens), {}, {}
    for text, path, chars, at, out, inside in page.blocks:
        key = template.text_key(path, gap[at], text)
        chars = 0 if out else chars
        texts[key] = texts.get(key, 0) + chars
        if chars:
            h = home(path)
            n, piece = homes.get(h, (0, 0))
            homes[h] = n + chars, piece or int(inside or len(h) < len(path))
    for key, chars in texts.items():
        yield "x" + key, (1, chars, 0, 0, 0)
    for h, (chars, piece) in homes.items():
        yield "h" + "\n".join(h), (1, chars, piece, 0, 0)


class Template:
    """Nested valid equivalence classes of the tokens of a host's pages of one shape."""

    def __init__(self, pages: list[Page] | dict[str, tuple[int, ...]]):
        if isinstance(pages, list):
            outlines = [Outline(p, str(k)) for k, p in enumerate(pages)]
            self.__dict__ = next(iter(deduce(summed(outlines)).values())).__dict__
            return
        counts, classes = pages, defaultdict(list)
        self.n = counts["n"][0]
        for key, v in counts.items():
            if key[0] == "t" and v[0] * 2 >= self.n:  # on fewer pages: too few to say
                classes[v[:4]].append((v[4], key[1:]))
        once = [v for v in classes if v[0] == v[1] == self.n]
        #: Tokens of the root class, in the order they have in every page.
        self.root = [t for _, t in sorted(x for v in once for x in classes.pop(v))]
        self.classes = [[t for _, t in sorted(classes[v])] for v in sorted(classes)]
        self.index()

    def index(self) -> None:
        self.rank = {t: k for k, t in enumerate(self.root)}
        self.known = {*self.rank, *(t for c in self.classes for t in c)}

    def ordered(self, counts: dict[str, tuple[int, ...]]) -> bool:
        """Takes out what breaks the order; whether the root class was in order already."""
        bad, gaps = {k[1:] for k in counts if k[0] == "r"}, defaultdict(set)
        if bad:
            self.root = [t for t in self.root if t not in bad]
            self.index()
            return False
        for k in counts:
            if k[0] == "g":
                number, gap = k[1:].split()
                gaps[int(number)].add(int(gap))
        #: Valid inner classes: (tokens, the root slot that holds them).
        self.inner = [(c, gaps[k].pop()) for k, c in enumerate(self.classes) if len(gaps[k]) == 1 and f"b{k}" not in counts]
        self.nested = {t for tokens, _ in self.inner for t in tokens}
        return True

    def gaps(self, tokens: list[str]) -> list[int]:
        """The last root token at or before each place; one place more for text at the end."""
        out, now = [], -1
        for t in tokens:
            out.append(now)
            now = self.rank.get(t, now)
        return [*out, now]

    def text_key(self, path: tuple[str, ...], gap: int, text: str) -> str:
        """A text in its slot: the root slot, nested in it the innermost valid inner class around, and the element."""
        inner = ""
        for n in range(len(path), 0, -1):
            token = "/".join(path[:n]) if n > 1 else "/" + path[0]
            if token in self.nested:
                inner = token
                break
        return "\t".join((str(gap), text_hash(inner), text, "\n".join(home(path))))

    def choose(self, counts: dict[str, tuple[int, ...]]) -> None:
        """The texts of the template, and the elements whose varying slots are article.

        A text that most pages share in one slot, three at least (two may be near copies of an
        article), is the template's. Elements are taken with all they hold or by themselves:
        those with pieces of running text (paragraphs, headings, lists) and those that hold,
        where they occur, at least half of the heaviest one's text. A lighter element with
        bare text is a notice beside the article. An article or main element is kept
        whatever it holds; names choose nothing else.
        """
        self.fixed = {k[1:] for k, v in counts.items() if k[0] == "x" and v[0] * 2 > self.n and v[0] > 2}
        weight = Counter({k[1:]: v[1] for k, v in counts.items() if k[0] == "h"})
        for x in self.fixed:
            weight[x.split("\t", 3)[3]] -= counts["x" + x][1]
        pages = {h: counts["h" + h] for h, n in weight.items() if n > 0}
        top = max((weight[h] / v[0] for h, v in pages.items()), default=0)
        heavy = {as_path(h) for h, v in pages.items() if 2 * weight[h] >= top * v[0]}
        pieces = {as_path(h) for h, v in pages.items() if v[2]}
        self.alone = {h for h in pieces if not h or h[-1].split(".")[0].split("#")[0] in ("body", "html")}
        self.chosen = heavy | pieces - self.alone

    def article(self, page: Page) -> str:
        """A page's varying slots inside the template's containers, in page order.

        A page that has none of the containers has its own, the one of its varying slots
        or, if other pages share all its text, of its article elements or all slots.
        """
        gap = self.gaps(page.tokens)
        blocks = [b for b in page.blocks if not b[4]]
        varying = [b for b in blocks if self.text_key(b[1], gap[b[3]], text_hash(b[0])) not in self.fixed] if self.fixed else blocks
        held = [b for b in varying if home(b[1]) in self.alone or within(home(b[1]), self.chosen)]
        for others in (varying, [b for b in blocks if b[5]], blocks):
            if held:
                break
            weight = Counter()
            for b in others:
                weight[home(b[1])] += len(b[0]) if b[2] * 2 <= len(b[0]) else 0
            best = max(weight, key=lambda h: (weight[h], len(h), h), default=None)
            held = [b for b in others if weight[best] and within(home(b[1]), {best})]
        return " ".join(b[0] for b in held)


def as_path(key: str) -> tuple[str, ...]:
    return tuple(key.split("\n")) if key else ()


def add_up(totals: dict, rows) -> None:
    for key, v in rows:
        old = totals.get(key)
        totals[key] = v if old is None else tuple(map(sum, zip(old, v)))


def summed(outlines: list[Outline], host: str = ""):
    """Sums of counts over pages at hand, for ``deduce``."""

    def sum_up(count, templates):
        out = defaultdict(dict)
        for o in outlines:
            add_up(out[host, o.shape], count(o, templates.get((host, o.shape))))
        return out

    return sum_up


def deduce(sum_up) -> dict[tuple[str, str], Template]:
    """Templates by (host, shape) from sums of counts over all pages, however they were summed."""
    templates = {g: Template(c) for g, c in sum_up(token_counts, {}).items()}
    while True:
        counts = sum_up(order_counts, templates)
        if all([t.ordered(counts.get(g, {})) for g, t in templates.items()]):
            break
    counts = sum_up(slot_counts, templates)
    for g, t in templates.items():
        t.choose(counts.get(g, {}))
    return templates


def home(path: tuple[str, ...]) -> tuple[str, ...]:
    """The element that holds a block's running text, without the elements of its pieces."""
    while path and path[-1].split(".")[0].split("#")[0] in FLOW:
        path = path[:-1]
    return path


def within(path: tuple[str, ...], chosen: set[tuple[str, ...]]) -> bool:
    return any(path[:n] in chosen for n in range(len(path) + 1))


def extract(sources: list[str]) -> list[str]:
    """Main texts of pages of one host."""
    of = {s: Page(s) for s in sources}  # copies count once
    templates = deduce(summed([Outline(p, s) for s, p in of.items()]))
    texts = {s: templates["", shape(p)].article(p) for s, p in of.items()}
    return [texts[s] for s in sources]


def shape(page: Page) -> str:
    return " ".join(dict.fromkeys(t for t in page.tokens if t.count("/") <= 2 and "//" not in t))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text (empty if none), n_chars (code points)."""
    spark = pages.sparkSession
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("binary").alias("html"), host.alias("host"))
    out = f"id {rows.schema['id'].dataType.simpleString()}, url string, text string"
    # At most HOT_SHARE hosts a partition can be hot: what is sent of them has that bound.
    shares = int(spark.conf.get("spark.sql.shuffle.partitions")) * HOT_SHARE
    counts = rows.groupBy("host").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    hot = counts.filter((F.col("count") * shares > total) & (F.col("count") > GROUP)).select("host").collect()
    names = F.broadcast(spark.createDataFrame(hot, "host string"))
    cold = rows.join(names, "host", "left_anti") if hot else rows
    near = cold.repartition("host").sortWithinPartitions("host").select("id", "url", "html", "host")
    texts = near.mapInArrow(by_host, out)
    if hot:
        some = rows.join(names, "host", "left_semi").select("id", "url", "html", "host")
        outlines = kept(some.select("html", "host").mapInArrow(outlined, "host string, number long, outline binary").dropDuplicates(["host", "number"]))
        sent = spark.sparkContext.broadcast(deduce(summed_by_spark(outlines)))
        texts = texts.union(some.mapInArrow(with_templates(sent), out))
    return texts.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))


def decoded(html: bytes | None) -> str:
    return (html or b"").decode("utf-8", "replace")


def answer(schema: pa.Schema, held: list[tuple], texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], schema.field(0).type), pa.array([h[1] for h in held], pa.string()), pa.array(texts, pa.string())], ["id", "url", "text"])


def by_host(batches):
    """Texts of rows that stand host by host; a host's pages are held at once."""
    held, name = [], None
    for batch in batches:
        schema = batch.schema
        for i, u, h, key in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if held and key != name:
                yield answer(schema, held, extract([x[2] for x in held]))
                held = []
            name = key
            held.append((i, u, decoded(h)))
    if held:
        yield answer(schema, held, extract([x[2] for x in held]))


def outlined(batches):
    for batch in batches:
        for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
            pages = [Outline(Page(s), s) for s in map(decoded, part.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array([p.number - (1 << 63) for p in pages], pa.int64()), pa.array([zlib.compress(pickle.dumps(p), 6) for p in pages], pa.binary())], ["host", "number", "outline"])


def summed_by_spark(outlines: DataFrame):
    """Sums of counts over ``outlines``, for ``deduce``: added up by task, then by (host, shape, key).

    Tokens on fewer than half of the pages and texts that most pages do not share decide nothing and stay where they are.
    """
    spark, numbers = outlines.sparkSession, "abcde"
    pages: dict[tuple[str, str], int] = {}

    def sum_up(count, templates):
        sent = spark.sparkContext.broadcast((count, templates))

        def run(batches):
            count, templates = sent.value
            totals: dict = {}

            def rows():
                keys = list(totals)
                values = [pa.array([totals[k][j] for k in keys], pa.int64()) for j in range(5)]
                done = pa.RecordBatch.from_arrays([pa.array([k[j] for k in keys], pa.string()) for j in range(3)] + values, ["host", "shape", "key", *numbers])
                totals.clear()
                return done

            for batch in batches:
                for host, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    page = pickle.loads(zlib.decompress(blob))
                    add_up(totals, (((host, page.shape, key), v) for key, v in count(page, templates.get((host, page.shape)))))
                    if len(totals) > 200_000:
                        yield rows()
            yield rows()

        columns = "".join(f", {x} long" for x in numbers)
        sums = outlines.select("host", "outline").mapInArrow(run, f"host string, shape string, key string{columns}").groupBy("host", "shape", "key").agg(*(F.sum(x).alias(x) for x in numbers))
        if count is token_counts:
            sums = kept(sums)
            pages.update(((r.host, r.shape), r.a) for r in sums.filter("key = 'n'").collect())
        known = F.broadcast(spark.createDataFrame([(*g, n) for g, n in pages.items()], "host string, shape string, pages long"))
        kind = F.substring("key", 1, 1)
        wanted = sums.join(known, ["host", "shape"]).filter((kind != "t") | (F.col("a") * 2 >= F.col("pages"))).filter((kind != "x") | (F.col("a") * 2 > F.col("pages")) & (F.col("a") > 2))
        out = defaultdict(dict)
        for r in wanted.select("host", "shape", "key", *numbers).toLocalIterator():
            out[r[0], r[1]][r[2]] = tuple(r[3:])
        return out

    return sum_up


def with_templates(sent):
    def run(batches):
        templates = sent.value
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                held = list(zip(*(part.column(k).to_pylist() for k in (0, 1))))
                pages = [Page(decoded(h)) for h in part.column(2).to_pylist()]
                yield answer(part.schema, held, [templates[host, shape(p)].article(p) for host, p in zip(part.column(3).to_pylist(), pages)])

    return run
