"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into blocks at block-level tags.  A block's features are its word count and link density,
those of the two blocks before and after it, which of them are headings or paragraphs, the longest block
before and after, the headings so far, its distance from the page's ends, and whether it stands inside
what marks the main part (article, main, ...) or what marks the rest (nav, footer, adverts, comments, ...).
The tree (CART, Gini) is trained on the blocks of a small labelled table: the pages TEACH, in which a bar
before a text marks content, and pages put together by rule, each with all its marks, with its tags' names
alone, and without any.  So marks help where a page has them, and neighbours decide where it has none.

Scripts, styles, forms' fields, comments and markup give no text.  Character references are decoded,
white space inside a block becomes one space, blocks are joined by one line end in page order.  A null
or empty page has an empty text, repeated rows each have theirs, an empty table has none.  Tags left open
end with what they are in; an element without text of its own that is never closed ends at the next tag.
Work is in proportion to a page's length.  A column of pages named text is replaced, others stay.
"""

from __future__ import annotations

import functools
import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import appended, table

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

# Element names of HTML.
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "select", "option", "button", "object", "audio", "video", "canvas"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_MAIN_TAGS = {"article", "main"}
_REST_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "head"}
_MAIN_ROLES = {"main", "article"}
_REST_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
# Words of class and id values.
_MAIN_WORDS = {"article", "content", "entry", "main", "post", "story"}
_REST_WORDS = {
    "ad", "ads", "advert", "advertisement", "advertising", "adverts", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "commentlist", "comments", "consent", "cookie", "cookies",
    "copyright", "disclaimer", "disqus", "foot", "footer", "gdpr", "legal", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "overlay", "pager",
    "pagination", "popular", "popup", "promo", "promotion", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored",
    "subscribe", "subscription", "toolbar", "topbar", "trending", "widget",
}

MAIN, REST, LINK, HEADING, PARAGRAPH = 1, 2, 4, 8, 16
_PARAGRAPHS = {"p", "blockquote", "pre"}
#: Blocks on either side that a block's features tell of.
REACH = 2
FEATURES = 4 * (2 * REACH + 1) + 8


def _kind(name: str, attributes: str, inside: int) -> int:
    """What an element adds to what its text is inside of."""
    out = LINK if name == "a" else HEADING if name in _HEADINGS else PARAGRAPH if name in _PARAGRAPHS else 0
    if name in _MAIN_TAGS:
        out |= MAIN
    elif name in _REST_TAGS or name == "header" and not inside & MAIN:
        out |= REST
    if attributes and name not in ("html", "body"):
        for m in _ATTR.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id"):
                words = set(re.split(r"[^a-z0-9]+", value))
                if words & _REST_WORDS and name not in _MAIN_TAGS or "header" in words and name not in _HEADINGS and not inside & MAIN:
                    out |= REST
                elif words & _MAIN_WORDS and name in ("div", "section", "td"):
                    out |= MAIN
                if name in _MAIN_TAGS and words & {"comment", "comments", "related", "teaser", "ad", "promo"}:
                    out |= REST
            elif key == "role":
                out |= MAIN if value in _MAIN_ROLES else REST if value in _REST_ROLES else 0
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                out |= REST
    return out


class _Open:
    """The open elements, block by block: a closing tag that matches none of them costs nothing."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = [("", 0)]  # element, what its text is inside of
        self.blocks: dict[str, int] = {}  # open block elements by name
        self.inline: list[dict[str, int]] = [{}]  # open inline elements by name, within each open block element

    @property
    def inside(self) -> int:
        return self.stack[-1][1]

    def push(self, name: str, attributes: str) -> None:
        self.stack.append((name, self.inside | _kind(name, attributes, self.inside)))
        if name in _INLINE:
            self.inline[-1][name] = self.inline[-1].get(name, 0) + 1
        else:
            self.blocks[name] = self.blocks.get(name, 0) + 1
            self.inline.append({})

    def pop(self) -> str:
        name = self.stack.pop()[0]
        if name in _INLINE:
            self.inline[-1][name] -= 1
        else:
            self.blocks[name] -= 1
            self.inline.pop()
        return name

    def close(self, name: str) -> None:
        """A closing inline tag ends nothing outside its block."""
        if (self.inline[-1] if name in _INLINE else self.blocks).get(name):
            while self.pop() != name:
                pass

    def begin(self, name: str) -> None:
        """A paragraph or list item ends at the next one, and inline tags left open end with it."""
        while len(self.stack) > 1 and (self.stack[-1][0] in _INLINE or self.stack[-1][0] == "p" or self.stack[-1][0] == name and name in ("li", "dt", "dd", "tr", "td", "th")):
            self.pop()


def blocks(page: str | None) -> list[tuple[str, int, int, int]]:
    """(text, words, words inside links, what it is inside of) of each block with text."""
    out: list[tuple[str, int, int, int]] = []
    if not page:
        return out
    opened, parts = _Open(), []
    links = state = 0
    empty, endless = True, set()  # no text in parts yet; names of elements that have no end from here on

    def close() -> None:
        nonlocal links, state, empty
        if not empty:
            words = "".join(parts).split()
            if words:
                out.append((" ".join(words), len(words), min(links, len(words)), state))
        parts.clear()
        links, state, empty = 0, 0, True

    def text(raw: str) -> None:
        nonlocal links, state, empty
        raw = entities.unescape(raw) if "&" in raw else raw
        parts.append(raw)
        if raw.isspace():
            return
        if empty:
            state, empty = opened.inside, False
        if opened.inside & LINK:
            links += len(raw.split())

    at, n = 0, len(page)
    tags = page.rfind(">") + 1  # no tag ends behind it
    while at < n:
        m = _TOKEN.search(page, at, tags)
        if m is None:
            left = _DECLARATION.search(page, max(at, tags))
            text(page[at : left.start() if left else n])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if at == tags and _DECLARATION.match(m[0]) and not m[0].endswith(">" if m[0][2] not in "-[" else "-->" if m[0][2] == "-" else "]]>"):
                break
            continue
        name = name.lower()
        attributes = m[3] or m[6] or ""
        if m[1] or m[4]:
            if name not in _INLINE:
                close()
            opened.close(name)
        elif name in _RAW:
            if name not in ("button", "select", "option", "svg", "math"):
                close()
            if attributes.rstrip().endswith("/") and name not in ("script", "style"):
                continue
            end = None if name in endless else _END[name].search(page, at)
            if end is None:
                endless.add(name)
                at = n if name in ("script", "style") else page.find("<", at) % (n + 1)
            else:
                at = end.end()
        elif name == "br":
            parts.append(" ")
        else:
            if name not in _INLINE:
                close()
                opened.begin(name)
                if name == "body":
                    opened.close("head")
            if name not in _VOID:
                opened.push(name, attributes)
    close()
    return out


_DECLARATION = re.compile(r"<[!?]")
_END = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in _RAW}


def features(page: list[tuple[str, int, int, int]]) -> np.ndarray:
    """A row for each block: of it and its neighbours words, link density, heading, paragraph; then of the page around it, and marks."""
    n = len(page)
    words = np.array([b[1] for b in page], dtype=np.float64)
    inside = np.array([b[3] for b in page], dtype=np.int64)
    own = np.stack([words, np.array([b[2] for b in page]) / np.maximum(words, 1), (inside & HEADING) > 0, (inside & PARAGRAPH) > 0], axis=1).astype(np.float64).reshape(n, 4)
    wide = np.concatenate([np.full((REACH, 4), -1.0), own, np.full((REACH, 4), -1.0)])
    near = [wide[k : k + n] for k in range(2 * REACH + 1)]
    plain = np.where(own[:, 1] < 0.5, words, 0)  # of blocks that are not links
    before = np.concatenate([[0], np.maximum.accumulate(plain)[:-1]]) if n else plain
    after = np.concatenate([np.maximum.accumulate(plain[::-1])[::-1][1:], [0]]) if n else plain
    heads = np.minimum(np.cumsum(own[:, 2]), 3)
    marked = bool(((inside & MAIN) > 0)[(inside & REST) == 0].any())
    place = np.arange(n)
    rest = np.stack([before, after, heads, np.minimum(place, 8), np.minimum(n - 1 - place, 8), (inside & MAIN) > 0, (inside & REST) > 0, np.full(n, marked)], axis=1).astype(np.float64)
    return np.concatenate([*near, rest.reshape(n, 8)], axis=1).reshape(n, FEATURES)


#: The labelled pages; a bar before a text marks a block of the main text.
TEACH = [
    "<nav><a href=x>Home</a> <a href=y>News today</a></nav><article><h1>|A short title</h1><p>|Here is a paragraph of text that goes on for a while and says a few things.<p>|Yes.<p>|It ends with <a href=z>a link</a> in it.</article><footer>Copyright and so on, with all rights reserved by the owner of this site and nobody else.</footer>",
    "<header><h1>Site name</h1><p>The best site for news that anyone could ever want to read at any time of day</p></header><main><h2>|Heading</h2><p>|<a href=a>Only a link</a><p>|One two.<ul><li>|First point<li>|Second point</ul><div class=ad>Buy this thing now, it is the very best thing and costs very little money</div><p>|Last words of it.</main><aside><h3>Read more</h3><p>Other things to read that have nothing to do with this, but many words about them all</aside>",
    "<div class=menu><a href=a>One</a><a href=b>Two</a></div><h1>|The title of this page without marks</h1><p>|This page has no marks, so long blocks with few links are what its main text is made of, one after another.</p><p>|A second paragraph follows, somewhat shorter than the first one but with enough words in it.</p><p>|Short but in between.</p><p>|And a third long paragraph goes on to the end of this page, where nothing else is left to say about it.</p><div><a href=a>Terms</a> <a href=b>Contact</a></div><p>Top</p>",
    "<table><tr><td><a href=a>Left</a><br><a href=b>Links</a><td><p>|Old pages put their text into cells of tables, and it is long and has few links in it, as this one shows.<p>|More of the same text in the same cell, which again has more than a few words and not one link.<td><a href=c>Right links here</a></table><p><a href=d>Back</a> <a href=e>Forward</a>",
    "<article><p>|Text of an article that is not too long.<p>|Go on.</article><section class=comments><h3>Comments</h3><p>I like what this article says about the thing, and would like to add that I have seen it too, many times.<p>Me too</section>",
    "<div id=cookie-notice>We use cookies for many reasons that are told about in a long text, please agree to all of them now</div><div role=main><h1>|Title</h1><p>|Body.</div><form><p>Your name and your address please, we will write to you each week with all the news that is fit for you<p>Send</form>",
    "<div><a href=a>A</a> | <a href=b>B</a> | <a href=c>C</a></div><p>|A plain page with one long paragraph and a bar of links before it, and nothing besides these two blocks, really.</p><div>Written in May</div>",
    "<article><header><h1>|Title in a header</h1></header><p>|Word.<div class=share><a href=a>Share</a></div><p>|Another paragraph.<aside class=related><a href=b>Related story about something else</a></aside><p>|End.</article><div class=sidebar><p>Popular now: many words about other stories that are liked by everyone who reads them on this site</div>",
    "<nav><a href=a>Start</a></nav><article><h2>|News</h2><p>|Rain.<p>|Sun is back.</article>",
    "<main><p>|A lone paragraph with just a few words.</main>",
    "<article><p>|Something is told here in one paragraph of some length.</p><p>|Fin</p></article>",
    "<p>Menu<article><p>|Text.<p>|<a href=a>Source</a></article><p>A line of words that follows the article and is not a part of it at all, though it is long enough to be one.",
    "<p>|A page without any marks whose one paragraph is followed by a long footer and by what readers said.</p><section id=comments><p>I have read this page twice now and find that it has very much to say about little, thank you for it.</p></section><footer>All rights reserved by the owners of this site, who would like to hear from you about anything on it.</footer>",
    "<div class=sidebar>Subscribe to the letter that we write each week to tell you what is new here and elsewhere in the world.</div><p>|What this page is about is told in this paragraph, which is followed by no other one at all, sadly.</p>",
    "<p><a href=a>Index of all pages</a></p><p><a href=b>Another index with more words in the link</a></p><p>Nothing here</p>",
    "<div class=popup><p>Sign up now</p></div><div class=content><p>|Para one of the content.</p><blockquote>|A quote.</blockquote><pre>|Code</pre></div><div>Some words that stand outside of the content part of this page, and go on for quite a long while too.</div>",
]


class Tree:
    """CART with the Gini impurity, as flat arrays: feature, threshold, left, right and share of label 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 1):
        self.nodes: list[list[float]] = []
        self._grow(x, y, depth, least)
        self.table = np.array(self.nodes)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int) -> int:
        at = len(self.nodes)
        self.nodes.append([-1, 0, 0, 0, y.mean() if len(y) else 0])
        best = (1e-9, -1, 0.0)
        gini = lambda p: p * (1 - p)
        if depth and 0 < y.mean() < 1:
            for f in range(x.shape[1]):
                order = np.argsort(x[:, f], kind="stable")
                v, c = x[order, f], np.cumsum(y[order])
                n = np.arange(1, len(y))
                cost = n * gini(c[:-1] / n) + (len(y) - n) * gini((c[-1] - c[:-1]) / (len(y) - n))
                gain = np.where((v[1:] > v[:-1]) & (n >= least) & (len(y) - n >= least), len(y) * gini(y.mean()) - cost, -1)
                k = int(np.argmax(gain))
                if gain[k] > best[0] + 1e-9:
                    best = (gain[k], f, (v[k] + v[k + 1]) / 2)
        if best[1] >= 0:
            low = x[:, best[1]] <= best[2]
            left = self._grow(x[low], y[low], depth - 1, least)
            right = self._grow(x[~low], y[~low], depth - 1, least)
            self.nodes[at][:4] = [best[1], best[2], left, right]
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while len(x):
            f = self.table[at, 0].astype(np.int64)
            inner = f >= 0
            if not inner.any():
                break
            low = x[np.arange(len(x)), np.maximum(f, 0)] <= self.table[at, 1]
            at = np.where(inner, np.where(low, self.table[at, 2], self.table[at, 3]).astype(np.int64), at)
        return self.table[at, 4] >= 0.5


def _page(r: np.random.Generator) -> tuple[list[tuple[str, str, str, bool]], bool, bool]:
    """Parts of a page put together by rule: (tag that marks it, class that marks it, markup, whether it is content); with comments; with paragraphs of links."""
    some = lambda lo, hi: " ".join(["word"] * int(r.integers(lo, hi + 1)))
    link = lambda n: f"<a href=x>{some(1, n)}</a>"
    items = lambda: "<ul>" + "".join(f"<li>{link(3)}</li>" for _ in range(r.integers(2, 9))) + "</ul>"
    line = lambda: " ".join(link(2) for _ in range(r.integers(2, 6)))
    parts, odds = [], r.random(12)
    linked = bool(odds[9] < 0.2)
    if odds[0] < 0.9:
        parts.append(("nav", "menu", items() if odds[1] < 0.7 else line(), False))
    if odds[2] < 0.3:
        parts.append(("header", "header", f"{some(1, 6)}" + (f"<div>{some(3, 12)}</div>" if odds[1] < 0.5 else ""), False))
    if odds[3] < 0.5:
        parts.append(("div", "ad", some(3, 14), False))
    elif odds[3] < 0.65:
        parts.append(("div", "notice", some(8, 25), False))
    size = int(r.choice([8, 40, 120]))
    body = f"<h1>{some(1, 16)}</h1>"
    for k in range(int(r.choice([1, 2, 4, 9, 16]))):
        body += f"<h2>{some(1, 6)}</h2>" if k and r.random() < 0.08 else ""
        if r.random() < 0.06:
            body += "<ul>" + "".join(f"<li>{some(2, 20)}</li>" for _ in range(r.integers(2, 5))) + "</ul>"
        if linked and r.random() < 0.4:
            body += f"<p>{link(8)}</p>" if r.random() < 0.5 else f"<p>{some(1, 2)}{link(6)}</p>"
        body += f"<p>{some(1, 5) if r.random() < 0.2 else some(4, size)}{' ' + link(3) + ' ' + some(1, 9) if r.random() < 0.1 else ''}</p>"
    parts.append(("article", "content", body, True))
    if odds[4] < 0.25:
        parts.append(("aside", "sidebar", f"<h3>{some(1, 3)}</h3>{items()}", False))
    if odds[5] < 0.15:
        parts.append(("form", "subscribe", f"{some(3, 20)}", False))
    if odds[6] < 0.8:
        parts.append(("footer", "footer", some(3, 16) if odds[7] < 0.7 else f"{some(1, 5)} {line()}", False))
    if linked and odds[10] < 0.5:  # nothing but such a paragraph
        parts = [(tag, name, f"<p>{some(0, 1)}{link(6)}</p>" if good else text, good) for tag, name, text, good in parts]
    return parts, bool(odds[8] < 0.15), linked


#: Pages put together by rule, and the seed.
RULED, SEED = 160, 11


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled table."""
    rows, labels = [], []
    for page in TEACH:
        cut = blocks(page)
        rows.append(features([(t.lstrip("|"), *rest) for t, *rest in cut]))
        labels += [t.startswith("|") for t, *_ in cut]
    r = np.random.default_rng(SEED)
    for _ in range(RULED):
        parts, comments, linked = _page(r)
        for marks in range(2 if linked else 3):  # all, tags alone, none: then a paragraph of links can't be told from a menu
            more = [("section", "comments", "<h3>word</h3>" + "<p>word word word word word word word</p>" * 3, False)] if comments and marks == 0 else []
            named = [(tag if marks < 2 and tag != "div" else "div", f" class={name}" if marks == 0 and tag != "article" else "", body, good) for tag, name, body, good in parts + more]
            cut = [blocks(f"<{tag}{name}>{body}</{tag}>") for tag, name, body, _ in named]
            rows.append(features(blocks("".join(f"<{tag}{name}>{body}</{tag}>" for tag, name, body, _ in named))))
            labels += [good for (_, _, _, good), own in zip(named, cut) for _ in own]
    return np.concatenate(rows), np.array(labels, dtype=np.float64)


@functools.cache
def tree() -> Tree:
    return Tree(*labelled(), depth=14)


def main_texts(pages: list[str | None]) -> list[str]:
    """The main text of each page."""
    cut = [blocks(p) for p in pages]
    x = [features(p) for p in cut]
    good = tree().predict(np.concatenate(x)) if x else []
    out, at = [], 0
    for page in cut:
        out.append("\n".join(b[0] for b, g in zip(page, good[at : at + len(page)]) if g))
        at += len(page)
    return out


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with text; a column of that name is replaced."""
    return appended(pages, lambda batch: {"text": pa.array(main_texts(batch.column(html).to_pylist()), pa.string())}, "text string")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op1_html": op1_html}
