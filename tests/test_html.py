"""HTML comparison: worked examples and properties over generated documents."""

import random
import re

from palimpsest.functions.options import Options
from palimpsest.operators import changes as C
from palimpsest.operators import engine
from palimpsest.operators import html as D


def diff(a, b, **o):
    return D.diff(a, b, Options.of(**o))["html"]


def marked(s):
    """Short notation: {-x} and {+x} for numbered markers."""
    n = iter(range(99))
    return re.sub(r"\{([-+])(.*?)\}", lambda m: f'<span class="diff-{"removed" if m[1] == "-" else "added"}" data-change-index="{next(n)}">{m[2]}</span>', s, flags=re.S)


def test_own_examples():
    for a, b, want, o in [
        ("<p>red fox</p>", "<p>red hen</p>", "<p>red {-fox}{+hen}</p>", {}),
        ("<ol><li>oak</li></ol>", "<ol><li>oak</li><li>elm</li></ol>", "<ol><li>oak</li><li>{+elm}</li></ol>", {}),
        ("<h2>top</h2><h3>low</h3>", "<h2>top</h2>", "<h2>top</h2><h3>{-low}</h3>", {}),
        ('<p id="k1">same words</p>', '<p id="k2" lang="de">same words</p>', '<p id="k2" lang="de">same words</p>', {}),
        ("<p>7 &lt; 9 &#38; more</p>", "<p>7 &#60; 9 &amp; more</p>", "<p>7 &#60; 9 &amp; more</p>", {}),
        ("<p>plain tree here</p>", "<p>plain <i>tree</i> here</p>", "<p>plain tree here</p>", {}),
        ("<p>keep</p>", "<p>keep</p><style>a{b:c}", "<p>keep</p><style>a{b:c}</style>", {}),
        ("", "<section><p>new", "<section><p>{+new}</p></section>", {}),
        ("<p>north wind</p>", "", "<p>{-north wind}</p>", {}),
    ]:
        assert diff(a, b, **o) == marked(want), (a, b, diff(a, b, **o))


def test_full_replacement():
    r = D.diff("<p>a b</p>", "<ul>x</ul>", Options.of(similarityThreshold=0.5))
    assert r == {"html": '<div class="diff-removed" data-change-index="0"><p>a b</p></div><div class="diff-added" data-change-index="1"><ul>x</ul></div>', "fullReplacement": True, "similarity": 0.0}
    assert "similarity" not in D.diff("<p>a</p>", "", Options.of(similarityThreshold=0.5))
    assert D.diff("<p>a</p>", "<p>a</p>", Options.of(similarityThreshold=0))["similarity"] == 1


def test_helpers():
    assert D.strip_formatting('<b title="a>b">x</b><i/><script>"<b>"</script><em>y</em>') == 'x<script>"<b>"</script>y'
    assert D.decode_text("&eacute;&apos;&check;&#0;&#x1F600;&amp &lt;") == "é'&check;�😀&amp <"
    soup = "<!DOCTYPE html><!-- a > b --><p a='>'>x<br/><![CDATA[y]]><style>b{}</STYLE ><3 </p><!-- open"
    assert "".join(s.raw for s in D.segments(soup)) == soup
    assert [s.kind for s in D.segments(soup)] == ["opaque", "comment", "open", "text", "void", "opaque", "raw", "text", "close", "comment"]


PIECES = ["<p>", "</p>", "<div>", "</div>", "<ul>", "<li>", "</li>", "</ul>", "<b>", "</b>", "<a href='x'>", "</a>", "<br>", "<img src=a>", "word ", "two", " ", "&amp;", "&eacute;", "“q”", "<", "<!-- c -->", "<table>", "<tr>", "<td>", "</td>", "</tr>", "</table>", "👩‍👩‍👧", "é", "<script>x</script>"]


def outside(html, cut):
    """Decoded text without markers of one kind, white space left out; fails if tags are unbalanced."""
    open_, out, index = [], "", []
    for s in D.segments(html):
        if s.kind == "open":
            m = re.search(r'class="diff-(\w+)" data-change-index="(\d+)"', s.raw)
            if m:
                index.append(int(m[2]))
                assert not any(o[1] for o in open_), "markers nest"
            open_.append((s.name, m[1] if m else None))
        elif s.kind == "close":
            assert open_ and open_[-1][0] == s.name, html
            open_.pop()
        elif s.kind == "text" and not any(o[1] == cut for o in open_):
            out += D.decode_text(s.raw)
    assert not open_ and index == list(range(len(index)))
    return re.sub(r"\s+", "", out.replace("“", '"').replace("”", '"'))


def test_generated_documents():
    r = random.Random(4)
    for _ in range(1500):
        a = [r.choice(PIECES) for _ in range(r.randint(0, 20))]
        b = list(a) if r.random() < 0.6 else [r.choice(PIECES) for _ in range(r.randint(0, 20))]
        for _ in range(r.randint(0, 4)):
            b.insert(r.randint(0, len(b)), r.choice(PIECES)) if r.random() < 0.5 or not b else b.pop(r.randrange(len(b)))
        a, b = "".join(a), "".join(b)
        html = diff(a, b)
        plain = lambda x: re.sub(r"\s+", "", "".join(D.decode_text(s.raw) for s in D.segments(x) if s.kind == "text").replace("“", '"').replace("”", '"'))
        assert outside(html, "removed") == plain(b) and outside(html, "added") == plain(a)


def test_joined_changes_are_not_copied_over_and_over(monkeypatch):
    """Texts with little in common are a long row of changes and orphans, which were copied for each that joined."""
    handled, joined = [], D.joined
    monkeypatch.setattr(D, "joined", lambda *parts: handled.append(sum(len(p.old) + len(p.new) for p in parts)) or joined(*parts))
    a = "<p>" + " ".join(f"left{k} x" for k in range(400)) + "</p>"
    b = "<p>" + " ".join(f"right{k} x" for k in range(400)) + "</p>"
    got = diff(a, b)
    assert sum(handled) < 10_000 and got.count("data-change-index") == 2
    assert re.sub("<[^>]*>", "", re.sub('<span class="diff-removed".*?</span>', "", got)) == re.sub("<[^>]*>", "", b)
    # What a joined change is made of stays as it was for the next one's neighbours.
    run = [D.Item(same, list(old), list(new)) for same, old, new in ((False, D.tokens("aaaa"), []), (True, D.tokens("b"), D.tokens("b")), (False, D.tokens("cccc"), []), (True, D.tokens("ddd"), D.tokens("ddd")), (False, [], D.tokens("eeee")))]
    before = [(len(x.old), len(x.new)) for x in run]
    D.group_orphans(run, 0.3)
    assert [(len(x.old), len(x.new)) for x in run] == before


def test_similarity_of_unlike_pages_takes_no_long_search(monkeypatch):
    limits, search = [], engine.search
    monkeypatch.setattr(engine, "search", lambda a, b, limit: limits.append(limit) or search(a, b, limit))
    r = random.Random(4)
    pages = ["<body>" + "".join(f"<p>{' '.join(r.choice('la le de eau en un') + str(r.randrange(40)) for _ in range(60))}</p>" for _ in range(10)) for _ in range(3)]
    for old in pages:
        for new in pages:
            a, b = C.R.solids(old), C.R.solids(new)
            best = [0] * (len(b) + 1)  # the heaviest common subsequence
            for x in a:
                row = best[:]
                for j, y in enumerate(b):
                    best[j + 1] = max(row[j + 1], best[j], row[j] + (x == y) * len(x))
            got = C.similarity(old, new)
            assert (got == 1) == (old == new) and got <= 2 * best[-1] / (sum(map(len, a)) + sum(map(len, b)))
    assert max(limits, default=0) < 100
