import html
import random
import re

import pytest
from pyspark.sql import functions as F
from sediment.llm.html_text import html_text, main_text

PAGE = """<html><body class="has-sidebar"><header class="site"><h1>Site</h1><nav><a href=x>A</a> <a>B</a></nav></header>
<div class="cookie-notice"><p>We use cookies, and this is a rather long text about why we do so, every day.</p></div>
<div class="content"><h1>Title here</h1><div class="post-body"><p>First para &amp; more text
 that is long enough.</p><ul><li>one item</li><li>two item</li></ul><p>Second</p></div>
<div class="comments"><p>Great post! I really like it a lot and this is a long comment.</p></div></div>
<div class="sidebar"><p>side text</p></div><form>Search<input></form><footer>foot</footer></div></body></html>"""


def test_page_of_divisions():
    assert main_text(PAGE) == "Title here\nFirst para & more text that is long enough.\none item\ntwo item\nSecond"


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("", ""),
        ("<p>Hi", "Hi"),
        ("plain text only < 5 and > 3 &lt;tag&gt;", "plain text only < 5 and > 3 <tag>"),
        ('<div><p>a<script>var x="</p>"; if(a<b){}</script>b</p><!-- c --><p title="a>b">c</p>', "ab\nc"),
        ("<p>x &#233; &eacute &nbsp; y</p>", "x é é y"),
        ("<!-- never closed <p>x", ""),
        ("<script>never closed <p>x", ""),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<b><p>one</b> more</p>two", "one more\ntwo"),
        ("</div></p></article>", ""),
        ('<p class="a" id=\'b" c>d</p>', "d"),
        ("<article><header><p>By someone</p><h1>Head</h1></header><p>Body text.</p></article>", "Head\nBody text."),
    ],
)
def test_markup(source, text):
    assert main_text(source) == text


def test_deep_and_long_pages():
    assert main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    long = "word " * 200_000
    assert main_text(f"<body><nav><a>x</a></nav><article><p>{long}</p></article></body>") == long.strip()
    main_text("<a href='" * 3000)


def test_built_pages_give_back_their_paragraphs():
    """Brute force: pages built from known paragraphs with all kinds of things around them."""
    for seed in range(60):
        r = random.Random(seed)
        para = lambda n: " ".join("".join(r.choice("abcdefgh&<é") for _ in range(r.randint(1, 9))) for _ in range(n))  # noqa: B023, E731
        title, paras = para(6), [para(r.randint(12, 60)) for _ in range(r.randint(2, 9))]
        body = "".join(f"<p>{html.escape(p)}</p>" if r.random() < 0.8 else f"<p><b>{html.escape(p)}<br>" for p in paras)
        inner = f"<h1>{html.escape(title)}</h1>{body}"
        links = "".join(f"<li><a href='/{i}'>{para(1)}</a></li>" for i in range(8))
        shell = r.choice(["<article>{}</article>", "<main>{}</main>", '<div id="main-content">{}</div>', '<div class="post">{}</div>'])
        page = f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul>{links}</ul></nav><div class='ad'>{para(9)}</div>" + shell.format(inner)
        page += f"<aside><p>{html.escape(para(20))}</p></aside><section class='comments'><p>{html.escape(para(30))}</p></section><footer>&copy; {para(4)}</footer></body></html>"
        assert main_text(page) == "\n".join([title, *paras]), seed


def test_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>x</p>"), (3, "v", PAGE), (3, "v", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    got = sorted((g.page_id or 0, g.url, g.text, g.n_chars) for g in html_text(df).collect() if g.url or g.page_id == 2)
    assert [g[2] for g in got if g[0] == 1] == [""]
    assert sum(g[0] == 3 for g in got) == 2 and all(g[3] == len(g[2]) for g in got)
    assert html_text(df.limit(0)).count() == 0
    assert re.match("Title", [g[2] for g in got if g[0] == 3][0])


def prose(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(n))


def unnamed(r):
    """A page whose names tell nothing: only link share and characters per tag can find the article."""
    name = lambda: f"class='{''.join(r.choice('qxzk') for _ in range(4))}{r.randint(1, 99)}'"
    title, paras = prose(r, 6), [prose(r, r.randint(40, 90)) for _ in range(r.randint(3, 8))]
    menu = lambda: f"<div {name()}>" + "".join(f"<div><a href='/{i}'>{prose(r, 2)}</a></div>" for i in range(r.randint(5, 20))) + "</div>"
    text = f"<div {name()}>" + "".join(f"<p>{p}</p>" for p in paras) + "</div>"
    body = f"<div {name()}>{menu()}</div><div {name()}><h1>{title}</h1>{text}</div><div {name()}>{menu()}<div>{prose(r, 1)} <a href=x>{prose(r, 2)}</a></div></div>"
    return f"<html><body>{body}</body></html>", "\n".join([title, *paras])


def test_density_decides_without_names(monkeypatch):
    from sediment.llm import html_text as module

    pages = [unnamed(random.Random(seed)) for seed in range(80)]
    assert [main_text(p) for p, _ in pages] == [t for _, t in pages]
    body = lambda page, d: (0, 0.0, [page.tag.index("body")])
    monkeypatch.setattr(module, "chosen", body)
    assert all(main_text(p) != t for p, t in pages)


def test_threshold_joins_blocks_beside_the_heart():
    r = random.Random(3)
    one, two, three, side = [prose(r, 60) for _ in range(4)], prose(r, 80), [prose(r, 60) for _ in range(2)], prose(r, 2)
    block = lambda ps: "<div>" + "".join(f"<p>{p}</p>" for p in ps) + "</div>"
    page = f"<body><div><div><i>{side}</i></div>{block(one)}<h2>Between</h2>{block([two])}<div><a href=x>{side}</a> {side}</div>{block(three)}</div></body>"
    got = main_text(page).split("\n")
    assert [x for x in got if x not in ("Between", side, f"{side} {side}")] == [*one, two, *three] and "Between" in got


def brute(source):
    """Density and density sum of every element by their definition, over a parsed tree of well-formed markup."""
    import math
    from xml.etree import ElementTree

    from sediment.llm.html_text import BLOCK

    root = ElementTree.fromstring(source)
    size = lambda t: len(" ".join((t or "").split()))

    def pieces(e, link):
        """(text, under a link) of the element's subtree."""
        link = link or e.tag == "a"
        yield e.text, link
        for c in e:
            yield from pieces(c, link)
            yield c.tail, link

    every = list(pieces(root, False))
    ratio = sum(size(t) for t, a in every if a) / max(sum(size(t) for t, _ in every), 1)

    def density(texts, tags, link_tags):
        c, lc = sum(size(t) for t, _ in texts), sum(size(t) for t, a in texts if a)
        if not c:
            return 0.0
        base = max(math.e, math.log(c / max(c - lc, 1) * lc + ratio * c + math.e))
        return c / tags * max(0.0, math.log(c / max(lc, 1) * tags / max(link_tags, 1))) / math.log(base)

    def run(e, link):
        """What of a block lies in no block inside it: texts, tags, link tags."""
        link = link or e.tag == "a"
        texts, tags, links = [(e.text, link)], 0, 0
        for c in e:
            if c.tag not in BLOCK:
                more = run(c, link)
                texts, tags, links = texts + more[0], tags + 1 + more[1], links + (c.tag == "a") + more[2]
            texts.append((c.tail, link))
        return texts, tags, links

    def blocks(e):
        for c in e:
            if c.tag in BLOCK:
                yield c
            else:
                yield from blocks(c)

    out = []
    for e in root.iter():
        d = density(list(pieces(e, False)), sum(1 for _ in e.iter()), sum(x.tag == "a" for x in e.iter()))
        texts, tags, links = run(e, False)
        s = 0.0
        if e.tag in BLOCK:
            s = density(texts, 1 + tags, links) + sum(density(list(pieces(c, False)), sum(1 for _ in c.iter()), sum(x.tag == "a" for x in c.iter())) for c in blocks(e))
        out.append((e.tag, round(d, 6), round(s, 6)))
    return out


def test_densities_by_definition():
    from sediment.llm.html_text import Page, densities

    def tree(r, depth):
        out = []
        for _ in range(r.randint(1, 4)):
            kind = r.random()
            if kind < 0.35 or depth > 4:
                out.append(prose(r, r.randint(1, 12)))
            elif kind < 0.5:
                out.append(f"<a>{prose(r, 2)}</a>")
            elif kind < 0.65:
                out.append(f"<b>{prose(r, 2)}<a>{prose(r, 1)}</a></b>")
            else:
                out.append(f"<div>{tree(r, depth + 1)}</div>")
        return " ".join(out)

    for seed in range(60):
        source = f"<body>{tree(random.Random(seed), 0)}</body>"
        page = Page(source)
        d = densities(page)
        assert [(t, round(x, 6), round(s, 6)) for t, x, s in zip(page.tag, d.density, d.sums, strict=True)][1:] == brute(source), seed


@pytest.mark.parametrize(
    ("inner", "kept"),
    [
        ('<section class="social-science"><h2>Studies</h2><p>Of people and of towns.</p></section>', "Studies\nOf people and of towns."),
        ("<h2>Sources</h2><ul><li><a href=a>First source</a></li><li><a href=b>Second source</a></li></ul>", "Sources\nFirst source\nSecond source"),
        ("<p><a href=a>One link</a> and <a href=b>another link</a></p>", "One link and another link"),
        ("<p>a <svg/> b</p><p>c</p>", "a b\nc"),
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>", "so x=2 holds"),
        ('<div class="ad">Buy this</div><div class="share-buttons"><a href=x>Share</a></div><div id="comments"><p>Nice one, thanks for this.</p></div>', ""),
    ],
)
def test_what_an_article_keeps(inner, kept):
    text = "A paragraph that is long enough to be the heart of its article, whatever else stands there."
    page = f"<body><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>{text}</p>{inner}<p>{text}</p></article><footer>foot</footer></body>"
    assert main_text(page) == "\n".join(x for x in ["Title", text, kept, text] if x)
