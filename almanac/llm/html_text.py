"""Main text of web pages by tag-path ratios.

A page is read once into blocks: runs of text between the borders of block elements, each with its root-to-leaf
path of element names and classes (inline elements belong to the block around them, so a paragraph stays whole).
Elements that are no part of an article by their kind are left out with all they hold: scripts, styles, forms, menus,
footers, sidebars, page headers, and elements whose class, id or role names an advert, a notice, comments and the like.

Of the rest the ratios decide. Text length outside links, and punctuation, are summed per path and divided by the path's
blocks; both are smoothed over neighbouring blocks of the page, so that short lines amid long ones take part; their
logarithms are fused as a product; paths whose smoothed fused ratio reaches a share of the page's text-weighted mean are
content. The innermost element around nearly all content blocks (the whole ``article`` or ``main`` around it, where there is one)
is the article, and its headings, paragraphs, items, cells and quotations stay even if short, unless their path
is made of links. Nothing else is dropped, and no text is cut.

White space is what ``str.split`` splits at. Null pages and pages without content give an empty text; unclosed elements,
stray end tags, cut-off pages and broken character references are read as browsers do; a repeated page is
extracted each time; columns other than id, url and html are not read."""

from __future__ import annotations

import html as entity
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output "
                   "picture q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
LEFT_OUT = frozenset("script style noscript template head title nav footer aside form button select option textarea input "
                     "iframe object embed svg canvas audio video menu dialog map noembed noframes".split())
#: Text-level blocks, which an article keeps however short they are.
TEXT_BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p li blockquote pre td th dt dd figcaption caption summary address article main section".split())
#: Elements whose start ends an open element of the same group.
CLOSES = {name: frozenset(closes.split()) for name, closes in (
    ("li", "li"), ("dt", "dt dd"), ("dd", "dt dd"), ("td", "td th"), ("th", "td th"), ("tr", "td th tr"), ("thead", "td th tr"),
    ("tbody", "td th tr thead"), ("tfoot", "td th tr tbody"), ("option", "option"))}
#: Elements beyond which an end tag or an implied end does not reach.
SCOPE = frozenset("html body table td th article main section div ul ol dl blockquote aside nav footer header form".split())
HOLDERS = frozenset("article main section body".split())
PARAGRAPH, OUTERMOST, DRAWN = frozenset(("p",)), frozenset(("html", "body")), frozenset("path circle rect line use polygon".split())
# Words of classes, ids and roles of what surrounds an article.
AROUND = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promotions banner "
                   "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription "
                   "signup login nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside widget widgets related "
                   "recommended recommendations share sharing social comment comments commentlist disqus respond replies reply "
                   "footer masthead contentinfo complementary pagination pager search searchform toolbar copyright disclaimer paywall".split())
WRAPPERS = frozenset("html body article main".split())
JOINERS = frozenset("has no with without is".split())

#: A comment; a start tag (one with an unpaired quotation mark ends at the next >); an end tag; other markup; a tag cut off.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
                   r"|<(?P<odd>[a-zA-Z][^\s/>]*)(?P<rest>[^>]*)>|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<]*\Z", re.S)
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
MARKS = re.compile(r"[.,;:!?…。，、；：！？،؛؟।]")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}

#: Share of the page's mean ratio from which a path is content, share of content that the article holds, share of link
#: text from which a path is made of links, weight of the neighbours in smoothing.
CONTENT_SHARE, HOLDS, LINKS, NEIGHBOUR = 0.3, 0.8, 0.75, 0.25
ROWS = 64


class Element:
    """An open element. ``path`` numbers its root-to-leaf path (the block around it for inline ones), ``out`` says how it is
    left out, ``article`` and ``link`` whether it stands in an article and, within its block, in a link."""

    __slots__ = ("name", "path", "parent", "out", "depth", "article", "link", "block", "held", "home")

    def __init__(self, name: str, path: int, parent, out: str, inline: bool):
        self.name, self.path, self.parent, self.out = name, path, parent, out
        self.depth = 0 if parent is None else parent.depth + 1
        self.article = name in ("article", "main") or parent is not None and parent.article
        self.link = inline and (name == "a" or parent.link)
        self.block = parent.block if inline else self
        self.held, self.home = 0, False


class Block:
    __slots__ = ("element", "text", "links")

    def __init__(self, element: Element, text: str, links: int):
        self.element, self.text, self.links = element, text, links


def _surrounds(name: str, attributes: str) -> tuple[str, str]:
    """('' | 'hard' | 'soft', class label): whether an element's attributes place it outside the article."""
    soft, label = "", ""
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return "hard", label
        if key in ("class", "id", "role"):
            if key == "class":
                label = "." + ".".join(sorted(value.split()))
            for token in value.split():
                words = [w.lower() for w in WORDS.findall(token)]
                if not JOINERS.intersection(words[:1]) and AROUND.intersection(words):
                    soft = "soft"
    return ("" if name in WRAPPERS - {"article"} else soft), label


def _out(name: str, attributes: str, parent: Element) -> tuple[str, str]:
    """How an element stands: '' (may be content), 'soft' (by its class; an article in it is content again) or 'hard'."""
    by_class, label = _surrounds(name, attributes) if attributes.strip() else ("", "")
    if parent.out == "hard" or by_class == "hard" or name in LEFT_OUT:
        return "hard", label
    if name == "header" and not parent.article:
        return "hard", label
    if name in ("article", "main") and not by_class:
        return "", label
    return (by_class or parent.out), label


class Reader:
    """Reads a page into blocks, in one pass; every element is opened and closed once."""

    def __init__(self) -> None:
        self.found: list[Block] = []
        self.elements: list[Element] = []  # block elements, outer ones first
        self.at = self.top = Element("", 0, None, "", False)  # innermost open element
        self.open: Counter = Counter()
        self.paths: dict[tuple, int] = {}
        self.texts: list[str] = []
        self.links = 0

    def text(self, piece: str) -> None:
        if piece and not self.at.out:
            piece = entity.unescape(piece)
            self.texts.append(piece)
            if self.at.link:
                self.links += sum(map(len, piece.split()))

    def border(self) -> None:
        if self.texts:
            words = "".join(self.texts).split()
            if words:
                self.found.append(Block(self.at.block, " ".join(words), self.links))
            self.texts, self.links = [], 0

    def start(self, name: str, out: str, label: str) -> None:
        inline = name in INLINE
        if inline and out and not self.at.out:  # what is left out parts the text around it
            self.border()
        path = self.at.block.path if inline else self.paths.setdefault((self.at.block.path, name, label), len(self.paths) + 1)
        self.at = Element(name, path, self.at, out, inline)
        self.open[name] += 1
        if not inline:
            self.elements.append(self.at)

    def end(self, names: frozenset, stops: frozenset) -> None:
        """Ends the innermost open element of these names, with all in it, if no element of ``stops`` lies between."""
        if not any(self.open[n] for n in names):
            return
        element = self.at
        while element.name not in names:
            if element.name in stops or element is self.top:
                return
            element = element.parent
        if element.name not in INLINE:
            self.border()
        while self.at is not element.parent:
            self.open[self.at.name] -= 1
            self.at = self.at.parent

    def begin(self, name: str) -> None:
        """The ends that a block's start implies."""
        self.border()
        if name not in RAW and name not in VOID:
            self.end(PARAGRAPH, SCOPE)
        if name in CLOSES:
            closes = CLOSES[name]
            for _ in range(3 if name in ("tbody", "tfoot") else 2 if name in ("tr", "thead") else 1):  # cell, row, row group
                self.end(closes, SCOPE - closes)


def read(page: str) -> Reader:
    r = Reader()
    pos, size = 0, len(page)
    while pos < size:
        m = TOKEN.search(page, pos)
        if m is None:
            r.text(page[pos:])
            break
        r.text(page[pos:m.start()])
        pos = m.end()
        if m["start"] or m["odd"]:
            name, attributes = (m["start"] or m["odd"]).lower(), m["attributes"] or m["rest"] or ""
            if name == "br":
                if not r.at.out:
                    r.texts.append("\n")
                continue
            if name not in INLINE:
                r.begin(name)
            if name in RAW:
                end = RAW_END[name].search(page, pos)
                if end is None:
                    break
                pos = page.find(">", end.end()) + 1 or size
            elif name not in VOID and not (name in DRAWN and attributes.endswith("/")):
                r.start(name, *_out(name, attributes, r.at))
        elif m["end"]:
            name = m["end"].lower()
            if name == "p":
                r.border()
            r.end(frozenset((name,)), SCOPE if name == "p" or name in INLINE else OUTERMOST - {name})
    r.border()
    return r


def _score(found: list[Block]) -> dict[str, float]:
    """Smoothed, fused ratio of each path."""
    n, length, marks = Counter(), Counter(), Counter()
    for b in found:
        p = b.element.path
        n[p] += 1
        length[p] += max(0, len(b.text) - b.links)
        marks[p] += len(MARKS.findall(b.text))
    ratios = [(length[p] / n[p], marks[p] / n[p]) for p in (b.element.path for b in found)]
    smooth = []
    for i, b in enumerate(found):
        around = [ratios[j] for j in (i - 1, i + 1) if 0 <= j < len(found) and _kin(found[j].element, b.element)]
        own = ratios[i]
        smooth.append(tuple((1 - NEIGHBOUR * len(around)) * own[k] + NEIGHBOUR * sum(a[k] for a in around) for k in (0, 1)))
    fused = Counter()
    for b, (l, m) in zip(found, smooth):
        fused[b.element.path] += math.log1p(l) * math.log1p(m + l / 80) / n[b.element.path]
    return fused


def _kin(a: Element, b: Element) -> bool:
    """Whether blocks stand in the same element (or one in the other's)."""
    return a.parent is b.parent or a.parent is b or b.parent is a


def content(page: Reader) -> list[Block]:
    found = page.found
    if not found:
        return []
    scores = _score(found)
    weight = sum(len(b.text) for b in found)
    mean = sum(scores[b.element.path] * len(b.text) for b in found) / weight
    linked, total = Counter(), Counter()
    for b in found:
        linked[b.element.path] += b.links
        total[b.element.path] += len(b.text.replace(" ", ""))
    of_links = {p for p in total if linked[p] >= LINKS * total[p]}
    chosen = {p for p in scores if scores[p] >= CONTENT_SHARE * mean and p not in of_links}
    for b in found:
        if b.element.path in chosen:
            (b.element if b.element.parent is None or b.element.name in HOLDERS else b.element.parent.block).held += len(b.text)
    for e in reversed(page.elements):  # inner elements come after outer ones
        e.parent.block.held += e.held
    least = HOLDS * page.top.held
    home = max((e for e in [page.top, *page.elements] if e.held >= least), key=lambda e: e.depth)
    up = home
    while up is not None:
        if up.name in ("article", "main"):
            home = up
        up = up.parent
    home.home = True
    for e in page.elements:
        e.home = e.home or e.parent.block.home

    def stays(b: Block) -> bool:
        e = b.element
        if e.path in of_links:
            return False
        return e.name == "h1" or e.home and (e.path in chosen or e.name in TEXT_BLOCKS or e.article)
    return [b for b in found if stays(b)] if chosen else []


def main_text(page: str) -> str:
    return " ".join(b.text for b in content(read(page)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text (empty if none), n_chars (its code points). One pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [main_text(page or "") for page in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()),
                                                  pa.array([len(t) for t in texts], pa.int64())],
                                                 names=["page_id", "url", "text", "n_chars"])

    return (pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                         F.col(html_col).cast("string").alias("html"))
            .mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint"))
