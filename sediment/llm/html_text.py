"""HTML extraction (operator 9): composite text density picks the page's main text.

Every element gets its characters, tags, link characters and link tags; its composite density is characters per tag,
adjusted by how much of them are links. An element's density sum adds up its children's densities (a run of its own
text and inline elements counts as one child). The element of the largest sum is the heart of the article; the least
density on its path up to the body is the threshold, and every other element that reaches it brings in the element of
largest sum below it. Around the heart, an article or main element (or a class or id of that meaning) gives the
article's bounds; headings between blocks that were chosen stay, and a first-level heading before them leads.

What HTML itself declares to be no article takes no part: navigation, page headers, footers, asides, forms, scripts,
styles, hidden parts. Class and id names never remove anything by themselves: a name made up of nothing but words for
menus, notices, adverts, comments and the like lowers its element's density to MARKED of what it is, unless the element
holds the page's article, main part or first heading. A block so lowered stays out unless it still reaches the
threshold; everything else within the chosen elements is kept, lists and paragraphs of links too. In the article's own
header the headings stay.

The density's logarithm has e as its least base: the published formula's base nears one for short blocks of pages with
few links, and would put a line of text above an article.

Text: character references are decoded, white space within a block becomes one space, blocks are trimmed and joined by
one line feed in page order. Nothing else is dropped or cut.

Nulls and odd rows: a null or empty html, or one without text, gives an empty text; markup that is broken or never
closed is read as far as it goes; null page_id and url stay null; repeated rows give repeated results; an empty table
gives no rows; extra columns are ignored; of equal sums the element that begins first, and so the outer one, is chosen.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp template svg".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of the key ends an open element of the values, if no fence stands between. A fence that is itself
#: among the values ends too.
ENDS = {
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "td", "th"}),
    "td": frozenset({"td", "th"}),
    "th": frozenset({"td", "th"}),
    "thead": frozenset({"tr", "td", "th", "thead", "tbody", "tfoot"}),
    "tbody": frozenset({"tr", "td", "th", "thead", "tbody", "tfoot"}),
    "tfoot": frozenset({"tr", "td", "th", "thead", "tbody", "tfoot"}),
    "option": frozenset({"option"}),
}
FENCES = frozenset("table ul ol dl select body article section div main td th".split())
#: These end an open paragraph.
ENDS_P = BLOCK - frozenset("body html br button option select title caption legend summary li dd dt td th tr tbody thead tfoot".split()) | frozenset("li dd dt".split())
LEFT_OUT = frozenset("script style noscript template head title nav footer aside form button select textarea input iframe svg annotation annotation-xml canvas object embed applet menu dialog audio video map noembed noframes xmp".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar toolbar dialog alertdialog alert form".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored sponsors promo promotion promoted banner banners cookie cookies consent gdpr notice notices notification alert popup"
    " modal overlay newsletter subscribe subscription signup sidebar sidebars aside widget widgets menu menus nav navbar navigation navi topnav subnav breadcrumb breadcrumbs crumbs footer foot masthead topbar"
    " share sharing social related recommended recommendations comment comments commentlist disqus respond replies reply discussion pagination pager toolbar copyright disclaimer login search searchbox hidden skip".split()
)
#: Words that tell nothing about what a name's other words say.
NEUTRAL = frozenset("area bar block bottom box button buttons container group header inner item items js left links list outer page panel right section site slot text thread top unit wrap wrapper".split())
#: What a name made up of WORDS (and NEUTRAL) leaves of a density.
MARKED = 0.02
HEADER_WORDS = frozenset("header head site page".split())
MAIN_WORDS = frozenset("content main article post entry story maincontent articlebody postcontent entrycontent".split())

TOKEN = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|[!?/][^>]*+(?:>|\Z))", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


class Page:
    """A page's elements in page order, and its text runs and block edges as events.

    Element i holds the elements i + 1 to last[i] and the events first[i] to after[i].
    """

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.left_out, self.marked, self.header, self.main = ["#"], [-1], [False], [False], [False], [False]
        self.first, self.after, self.last = [0], [0], [0]
        self.events: list[tuple[int, str | None]] = []  # (element, text), or (element, None) for a block's edge
        self._read(source)

    def _read(self, source: str) -> None:
        stack, at, n = [0], 0, len(source)
        events, tags, find = self.events, self.tag, TOKEN.search

        def close(upto: int) -> None:
            while len(stack) > upto:
                i = stack.pop()
                if tags[i] in BLOCK:
                    events.append((i, None))
                self.after[i], self.last[i] = len(events), len(tags) - 1

        while at < n:
            m = find(source, at)
            text = source[at : m.start()] if m else source[at:]
            if text:
                events.append((stack[-1], html.unescape(text) if "&" in text else text))
            if not m:
                break
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name, ending, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
            if ending:
                if name == "br":
                    events.append((stack[-1], None))
                    continue
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == name:
                        close(k)
                        break
                    if name not in BLOCK and tags[stack[k]] in BLOCK:
                        break  # an inline end tag ends no block
                    if tags[stack[k]] in ("article", "main", "body") and name in ("p", "li", "b", "i", "span", "a"):
                        break
                else:
                    if name == "p":
                        events.append((stack[-1], None))
                continue
            if name == "body" and "body" in tags or name == "html":
                continue
            if name in ENDS_P or name == "p":
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == "p":
                        close(k)
                        break
                    if tags[stack[k]] in BLOCK:
                        break
            if name in ENDS:
                cut = len(stack)
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] in ENDS[name]:
                        cut = k
                    elif tags[stack[k]] in FENCES:
                        break
                close(cut)
            if name == "body" or tags[stack[-1]] == "head" and name in BLOCK and name != "title":
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == "head":
                        close(k)
                        break
            if name == "br":
                events.append((stack[-1], None))
            i = self._open(name, attributes, stack[-1])
            if name in RAW and name == "svg" and attributes.endswith("/"):
                continue
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(source, at)
                at = end.end() if end else n
                self.after[i] = len(events)
            elif name not in VOID and not (attributes.endswith("/") and name not in BLOCK):
                if name in BLOCK:
                    events.append((i, None))
                stack.append(i)
        close(0)

    def _open(self, name: str, attributes: str, parent: int) -> int:
        out, marked, header, main = name in LEFT_OUT, False, name == "header", name in ("article", "main")
        if attributes.strip():
            found = {a.lower(): next((x for x in (b, c, d) if x), "") for a, b, c, d in ATTRIBUTE.findall(attributes)}
            role = found.get("role", "").lower()
            main |= role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody"
            out |= role in ROLES or "hidden" in found or found.get("aria-hidden") == "true" or bool(HIDDEN.search(found.get("style", "")))
            for value in (found.get("class", ""), found.get("id", "")):
                for word in value.split():
                    parts = [p.lower() for p in NAME_WORDS.findall(word)]
                    main |= "".join(parts) in MAIN_WORDS
                    if name not in ("html", "body", "article", "main"):
                        told = [p for p in parts if p not in NEUTRAL and not p.isdigit()]
                        marked |= bool(told) and WORDS.issuperset(told)
                        header |= bool(parts) and HEADER_WORDS.issuperset(parts)
        self.tag.append(name)
        self.parent.append(parent)
        self.left_out.append(out)
        self.marked.append(marked)
        self.header.append(header)
        self.main.append(main)
        self.first.append(len(self.events))
        self.after.append(len(self.events))
        self.last.append(len(self.tag) - 1)
        return len(self.tag) - 1


def composite(chars: float, tags: int, link_chars: float, link_tags: int, ratio: float) -> float:
    """Characters per tag, by the logarithm of how little of both are links; ratio: the page's share of link characters."""
    if not chars:
        return 0.0
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + ratio * chars + math.e)
    return chars / tags * math.log(max(chars / max(link_chars, 1) * tags / max(link_tags, 1), 1.0)) / math.log(max(base, math.e))


@dataclass
class Densities:
    """Of each element: what takes no part, its characters, density and density sum."""

    gone: list[bool]
    marked: list[bool]  # lowered, by itself or an element around it
    keep: list[bool]  # of each event: text that takes part
    chars: list[int]
    density: list[float]
    sums: list[float]


def densities(page: Page) -> Densities:
    tag, parent, n = page.tag, page.parent, len(page.tag)
    # holds[i]: the page's article, main part or a first-level heading is inside
    holds = [t == "h1" or t in ("article", "main") for t in tag]
    for i in range(n - 1, 0, -1):
        holds[parent[i]] |= holds[i]
    gone, marked, inside, heading, in_header = [False] * n, [False] * n, [False] * n, [False] * n, [False] * n
    link = [t == "a" for t in tag]
    for i in range(1, n):
        p = parent[i]
        inside[i] = inside[p] or page.main[i] and tag[i] not in HEADINGS
        heading[i] = heading[p] or tag[i] in HEADINGS
        gone[i] = gone[p] or page.left_out[i] and (tag[i] in LEFT_OUT or not holds[i]) or page.header[i] and not inside[p] and not (holds[i] and tag[i] != "header")
        marked[i] = marked[p] or page.marked[i] and not holds[i]
        # the article's own header: only headings
        in_header[i] = in_header[p] or page.header[i] and inside[p] and not (page.main[i] or tag[i] in HEADINGS)
        link[i] |= link[p]

    # an element's own run: its text and that of inline elements in it, up to the next block
    runs = list(range(n))
    for i in range(1, n):
        if tag[i] not in BLOCK:
            runs[i] = runs[parent[i]]
    chars, tags, link_chars, link_tags = [0] * n, [1] * n, [0] * n, [1 if t == "a" else 0 for t in tag]
    own_chars, own_tags, own_link_chars, own_link_tags = [0] * n, [1] * n, [0] * n, [0] * n
    all_chars = all_links = 0
    keep: list[bool] = []
    for i, text in page.events:
        ok = text is not None and not gone[i] and (heading[i] or not in_header[i])
        keep.append(ok)
        if text is None:
            continue
        size = len(" ".join(text.split()))
        all_chars += size
        all_links += size * link[i]
        if ok:
            chars[i] += size
            link_chars[i] += size * link[i]
            own_chars[runs[i]] += size
            own_link_chars[runs[i]] += size * link[i]
    for i in range(n - 1, 0, -1):
        if not gone[i]:
            p = parent[i]
            if runs[i] != i:
                own_tags[runs[i]] += 1
                own_link_tags[runs[i]] += tag[i] == "a"
            if page.marked[i] and marked[i] and not marked[p]:
                continue  # a lowered block doesn't count for what is around it
            chars[p] += chars[i]
            tags[p] += tags[i]
            link_chars[p] += link_chars[i]
            link_tags[p] += link_tags[i]
    ratio = all_links / max(all_chars, 1)
    density, sums = [0.0] * n, [0.0] * n
    for i in range(n):
        if not gone[i]:
            weight = MARKED if marked[i] else 1.0
            density[i] = weight * composite(chars[i], tags[i], link_chars[i], link_tags[i], ratio)
            sums[i] = weight * composite(own_chars[i], own_tags[i], own_link_chars[i], own_link_tags[i], ratio)
    for i in range(n - 1, 0, -1):
        if runs[i] == i:
            sums[runs[parent[i]]] += density[i]
        else:
            sums[i] = 0.0  # inline elements are part of a run
    return Densities(gone, marked, keep, chars, density, sums)


def chosen(page: Page, d: Densities) -> tuple[int, float, list[int]]:
    """(heart, threshold, elements that bring in the page's main text, in page order, none inside another)."""
    tag, parent, n = page.tag, page.parent, len(page.tag)
    body = next((i for i in range(n) if tag[i] == "body"), 0)
    span = range(body, page.last[body] + 1)
    heart = max(span, key=lambda i: (d.sums[i], -i))
    threshold, i = d.density[heart], heart
    while i != body and i > 0:
        i = parent[i]
        threshold = min(threshold, d.density[i])
    # largest[i]: the element of the largest sum in i's subtree
    largest = list(range(n))
    for i in range(n - 1, 0, -1):
        p = parent[i]
        if (d.sums[largest[i]], -largest[i]) > (d.sums[largest[p]], -largest[p]):
            largest[p] = largest[i]
    found = {heart}
    for i in span:
        if d.chars[i] and d.density[i] >= threshold and (d.marked[heart] or not d.marked[i]) and d.sums[largest[i]] > 0:
            found.add(largest[i])
    # the article, main part or the like around the heart
    i = heart
    while i > 0:
        if page.main[i]:
            found.add(i)
            if tag[i] in ("article", "main"):
                break
        i = parent[i]
    out: list[int] = []
    for i in sorted(found):
        if not out or page.last[out[-1]] < i:
            out.append(i)
    return heart, threshold, out


def main_text(source: str) -> str:
    page = Page(source)
    tag, parent = page.tag, page.parent
    d = densities(page)
    if not any(d.keep[e] and text.strip() for e, (_, text) in enumerate(page.events) if text):
        return ""
    heart, threshold, tops = chosen(page, d)
    first, last = tops[0], page.last[tops[-1]]
    parts = [(i, page.last[i]) for i in tops]
    # headings between chosen blocks
    at = 0
    for i in range(first, last + 1):
        while parts[at][1] < i:
            at += 1
        if tag[i] in HEADINGS and i < parts[at][0] and d.chars[i] and not d.marked[i]:
            parts.insert(at, (i, page.last[i]))
    if not any(tag[k] == "h1" and d.chars[k] for i, j in parts for k in range(i, j + 1)):
        # the last first-level heading that stands before the text
        lead = [k for k in range(first) if tag[k] == "h1" and not d.gone[k] and d.chars[k]]
        parts = [(k, page.last[k]) for k in lead[-1:]] + parts
    # lowered blocks that don't reach the threshold
    low = [False] * len(tag)
    if not d.marked[heart]:
        for i in range(1, len(tag)):
            low[i] = low[parent[i]] or page.marked[i] and d.marked[i] and d.density[i] < threshold
    blocks: list[str] = []
    for i, _ in parts:
        held: list[str] = []
        for e in range(page.first[i], page.after[i]):
            k, text = page.events[e]
            if text is None:
                if held:
                    blocks.append(" ".join("".join(held).split()))
                    held = []
            elif d.keep[e] and not low[k]:
                held.append(text)
        if held:
            blocks.append(" ".join("".join(held).split()))
    return "\n".join(b for b in blocks if b)


OUT = "page_id long, url string, text string, n_chars long"


def html_text(pages: DataFrame) -> DataFrame:
    """OUT for every row of pages."""
    common.ship(pages.sparkSession)
    schema = common.fields(OUT)

    def run(batches):
        for b in common.slices(batches, "html"):
            texts = [main_text(x) if x else "" for x in b.column("html").to_pylist()]
            yield common.batch(schema, page_id=b.column("page_id"), url=b.column("url"), text=texts, n_chars=[len(t) for t in texts])

    return common.picked(pages, page_id="long", url="string", html="string").mapInArrow(run, OUT)


def op9_html_text(spark, sf_dir: str) -> DataFrame:
    return html_text(common.table(spark, sf_dir, "pages"))


QUERIES = {"op9_html_text": op9_html_text}
