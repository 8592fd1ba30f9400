import random

from pyspark.sql import types as T

from palimpsest.llm.html_extract import Page, Template, extract, extract_pages

from .helpers import prose

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("host", T.StringType()), T.StructField("part", T.IntegerType())])


def site(k, body_tag="article", n=4):
    r = random.Random(k)
    paras = [prose(k * 10 + j, r.randint(15, 40)) for j in range(r.randint(2, n))]
    words = prose(k + 500, 6).split()
    close = body_tag.split()[0]
    page = (
        f'<!DOCTYPE html><html><head><title>{words[0]}</title><style>p{{}}</style><script>var t="</p>";</script></head><body>'
        f'<nav><ul>{"".join(f"<li><a href=/{w}>{w}</a></li>" for w in words)}</ul></nav><!-- x --><div class="ad">Buy {words[1]} now please</div>'
        f'<{body_tag}><h1>Head &amp; {k}</h1>{"".join(f"<p>{p[:5]}<b>{p[5:9]}</b>{p[9:]}" + ("</p>" if j % 2 else "<br>") for j, p in enumerate(paras))}'
        f'<form><input name=q><label>Your mail</label></form><div class="comments"><p>{prose(k + 900, 12)}</p></div></{close}>'
        f"<aside>{prose(k + 700, 20)}</aside><footer>&copy; me {prose(k + 800, 5)}</footer></body></html>"
    )
    return page, " ".join([f"Head & {k}", *paras])


def test_articles_by_name():
    pages = [site(k) for k in range(12)]
    assert extract([p for p, _ in pages]) == [t for _, t in pages]
    assert extract([pages[0][0]]) == [pages[0][1]]  # a host with one page


def test_articles_without_names_by_template():
    pages = [site(k, 'div class="k"') for k in range(12)]
    plain = [p.replace("<nav>", "<div>").replace("</nav>", "</div>").replace("<aside>", '<div class="s">').replace("</aside>", "</div>").replace("<footer>", '<div class="z">').replace("</footer>", "</div>") for p, _ in pages]
    assert extract(plain) == [t for _, t in pages]


def test_template_text_inside_article_elements_goes():
    pages = [site(k) for k in range(12)]
    marked = [p.replace("<form>", "<p>Read this in our print edition</p><form>") for p, _ in pages]
    assert extract(marked) == [t for _, t in pages]


def test_names_do_not_choose_the_container():
    pages = [site(k, 'div class="k"') for k in range(12)]
    teased = [p.replace('<div class="k">', f'<article class="t"><p>{prose(k + 40, 3)}</p></article><div class="k">') for k, (p, _) in enumerate(pages)]
    assert all(t in got for got, (_, t) in zip(extract(teased), pages))


def test_pages_without_the_article_element_keep_their_text():
    pages = [site(k) if k % 4 else site(k, 'div class="content"') for k in range(12)]
    wrapped = [p.replace("<body>", '<body><div class="wrap">').replace("</body>", "</div></body>") for p, _ in pages]
    assert extract(wrapped) == [t for _, t in pages]


def test_an_article_in_two_elements_is_whole():
    for mark in ("<p>{}</p>", "{}"):
        pages, want = [], []
        for k in range(12):
            a, b = mark.format(prose(k + 40, 60)), mark.format(prose(k + 60, 40))
            pages.append(f'<html><body><div class="menu">x</div><div class="one">{a}</div><div class="two">{b}</div></body></html>')
            want.append(f"{prose(k + 40, 60)} {prose(k + 60, 40)}")
        assert extract(pages) == want
    pages = [f"<html><body><main><h1>{prose(k, 4)}</h1><article><p>{prose(k + 40, 60)}</p></article></main></body></html>" for k in range(12)]
    assert extract(pages) == [f"{prose(k, 4)} {prose(k + 40, 60)}" for k in range(12)]


def neutral(k):
    """No article element, no telling names: menu, notice, teasers and footer differ from the article by the template alone."""
    body = [prose(k * 7 + j, 30) for j in range(3)]
    page = f'<html><body><div class="a1"><p>Home Sections About us</p></div><div class="b2"><h1>Head {k}</h1>{"".join(f"<p>{x}</p>" for x in body)}<p>All rights with the house</p></div><div class="c3"><p>Open from nine to five</p></div></body></html>'
    return page, " ".join([f"Head {k}", *body])


def test_classes_decide_where_names_say_nothing(monkeypatch):
    pages, texts = zip(*map(neutral, range(12)))
    assert extract(list(pages)) == list(texts)
    assert extract([pages[0]]) != [texts[0]]  # one page alone has no template
    real = Template.choose
    monkeypatch.setattr(Template, "choose", lambda self, counts: real(self, {k: v for k, v in counts.items() if k[0] != "x"}))
    assert extract(list(pages)) != list(texts)


def test_words_in_names_do_not_cut_an_article():
    pieces = [
        '<section id="discussion">One to keep</section>', '<p class="alert">Two to keep</p>', '<p class="related-work">Three to keep</p>', '<h2 id="search-methods">Four to keep</h2>', '<p data-id="search-3" data-class="ad">Five to keep</p>',
        "<p>Six <math><mi>x</mi><mo>+</mo><mn>1</mn></math> to keep</p>", "<p><svg><text>Seven to keep</text></svg></p>", "<noscript><p>Eight to keep</p></noscript>", '<div class="banner-story ad-hoc">Nine to keep</div>',
    ]
    gone = ['<div class="ad">No</div>', '<section class="x comments">No</section>', "<aside>No</aside>", "<form>No</form>", '<div role="navigation">No</div>', "<footer>No</footer>"]
    page = lambda k: f"<html><body><article><h1>{prose(k, 3)}</h1><p>{prose(k + 9, 30)}</p>{''.join(x.replace('to keep', f'to keep {k}') for x in pieces)}{''.join(gone)}</article></body></html>"
    for k, text in enumerate(extract([page(k) for k in range(5)])):
        assert text == " ".join([prose(k, 3), prose(k + 9, 30), *(f"{n} to keep {k}" for n in "One Two Three Four Five".split()), f"Six x+1 to keep {k}", *(f"{n} to keep {k}" for n in "Seven Eight Nine".split())])


def test_copies_keep_their_text():
    page, text = site(3)
    assert extract([page] * 5) == [text] * 5
    assert extract([page, page.replace("Head", "Other")] * 3) == [text, text.replace("Head", "Other")] * 3


def test_classes_are_valid_and_nested():
    pages = [Page(site(k)[0]) for k in range(6)]
    t = Template(pages)
    for p in pages:
        at = [p.tokens.index(x) for x in t.root]
        assert at == sorted(at) and all(p.tokens.count(x) == 1 for x in t.root)
    assert any("p" in x.rsplit("/", 1)[-1] for tokens, _ in t.inner for x in tokens)
    assert all(-1 <= slot < len(t.root) for _, slot in t.inner)


def test_broken_html():
    for source in ["", "<", "plain text", "<p", "<script>x", "<div><p>a<p>b</div>", "<article>x</article", "a<!-- b", "</p></div>", "<a href='x>y", "&am &lt; &#x41; <b>", "<ul><li>x<li>y</ul>"]:
        assert isinstance(extract([source])[0], str)
    assert extract(["<div><p>a &lt;&nbsp;b\n c<p>b</div>"]) == ["a < b c b"]


def test_rows(spark):
    pages = [(k, f"https://h{k % 3}.example.org/p{k}?x=1", site(k)[0], "clash", 7) for k in range(30)]
    pages += [(100, "https://one.example.org/", site(100)[0], None, None), (101, None, None, None, None), (102, "x", "", None, None), (None, "http://h0.example.org/q", site(102)[0], None, None), (5, pages[5][1], pages[5][2], "a", 1)]
    pages += [(200 + k, f"http://hot.example.com/{k}", site(k + 200)[0], "c", 1) for k in range(120)]
    got = extract_pages(spark.createDataFrame(pages, SCHEMA)).collect()
    want = {(i, u): (site(i if i is not None else 102)[1] if h else "") for i, u, h, _, _ in pages}
    assert len(got) == len(pages)
    for r in got:
        assert (r.text, r.n_chars) == (want[r.page_id, r.url], len(r.text))
    assert extract_pages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_template_for_all_pages_of_a_host(spark):
    pages = [site(k, 'div class="k"') for k in range(150)]
    notes = [p.replace("<aside>", '<div class="n"><p>Open from nine to five</p></div><aside>') for p, _ in pages]
    rows = [(k, f"https://big.example.com/{k}", p, None, None) for k, p in enumerate(notes)] + [(500 + k, f"https://s{k % 40}.example.com/{k}", site(k)[0], None, None) for k in range(80)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "4", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows + rows[:30], SCHEMA).repartition(3)).collect()}
            assert all(got[k] == t for k, (_, t) in enumerate(pages))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
