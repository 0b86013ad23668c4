"""Main text of HTML pages: flat text blocks classified by a small decision tree.

A page is cut into blocks at its block-level tags.  Of each block the tree sees its word
count and link density, those of the blocks before and after it, whether it stands inside
page furniture (by element, role or class name), inside an article, and whether it is a
heading.  The tree is grown from the labelled blocks in ``EXAMPLES``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarrylens.llm.common import append_columns
from quarrylens.llm.tree import Tree, decide, grow

# Element names of the HTML standard.
RAW_TEXT = ("script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp")
HIDDEN = frozenset("noscript template object svg math canvas audio video select button datalist".split())
FOREIGN = frozenset(("svg", "math"))
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section "
    "summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Starting one of these ends an open one of the listed kinds, up to the nearest limit.
IMPLIED_END = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "tr": (("tr",), ("table",)),
    "option": (("option",), ("select",)),
}
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog search".split())
ARTICLE_TAGS = frozenset(("article", "main"))
FURNITURE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split()
)
FURNITURE_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs masthead banner header topbar footer bottombar sidebar "
    "aside widget widgets related recommended recommendations trending ad ads adv advert adverts advertisement "
    "advertisements advertising adbox sponsor sponsored promo promoted promotion cookie cookies consent gdpr notice "
    "notices alert alerts popup modal overlay toast newsletter subscribe subscription signup login signin comment "
    "comments disqus replies respond responses share sharing social pagination pager toolbar search copyright legal "
    "disclaimer paywall".split()
)
# A class such as "has-sidebar" or "header-layout" describes the whole page.
LAYOUT_WORDS = frozenset("has with no without layout page site".split())

# (words, link density, words before, density before, words after, density after, furniture, in article, heading,
# page has an article) and whether the block belongs to the main text.  These are typical blocks of pages that mark
# no article.
UNMARKED = (
    ((60, 0.00, 0, 0.00, 45, 0.00, 0, 0, 0, 0), 1),
    ((50, 0.00, 5, 0.00, 60, 0.00, 0, 0, 0, 0), 1),
    ((80, 0.10, 50, 0.00, 20, 0.00, 0, 0, 0, 0), 1),
    ((30, 0.00, 0, 0.00, 0, 0.00, 0, 0, 0, 0), 1),
    ((22, 0.00, 4, 0.00, 3, 0.00, 0, 0, 0, 0), 1),
    ((18, 0.20, 30, 0.00, 25, 0.00, 0, 0, 0, 0), 1),
    ((6, 0.00, 40, 0.00, 45, 0.00, 0, 0, 0, 0), 1),
    ((4, 0.00, 50, 0.00, 30, 0.00, 0, 0, 1, 0), 1),
    ((8, 0.00, 0, 0.00, 30, 0.00, 0, 0, 1, 0), 1),
    ((3, 0.00, 25, 0.00, 20, 0.00, 0, 0, 0, 0), 1),
    ((7, 0.00, 30, 0.00, 0, 0.00, 0, 0, 0, 0), 1),
    ((9, 0.00, 20, 0.00, 5, 0.00, 0, 0, 0, 0), 1),
    ((5, 0.00, 0, 0.00, 0, 0.00, 0, 0, 0, 0), 1),
    ((2, 0.00, 6, 0.00, 4, 0.00, 0, 0, 0, 0), 1),
    ((12, 0.25, 8, 0.00, 9, 0.00, 0, 0, 0, 0), 1),
    ((14, 0.30, 40, 0.00, 35, 0.00, 0, 0, 0, 0), 1),
    ((2, 1.00, 2, 1.00, 2, 1.00, 0, 0, 0, 0), 0),
    ((1, 1.00, 0, 0.00, 1, 1.00, 0, 0, 0, 0), 0),
    ((4, 1.00, 3, 1.00, 5, 0.00, 0, 0, 0, 0), 0),
    ((12, 0.90, 10, 0.90, 14, 1.00, 0, 0, 0, 0), 0),
    ((25, 0.80, 8, 0.00, 9, 1.00, 0, 0, 0, 0), 0),
    ((5, 0.60, 6, 0.00, 3, 1.00, 0, 0, 0, 0), 0),
    ((3, 1.00, 40, 0.00, 50, 0.00, 0, 0, 0, 0), 0),
    ((6, 0.80, 30, 0.00, 0, 0.00, 0, 0, 0, 0), 0),
    ((40, 0.70, 20, 0.00, 15, 0.00, 0, 0, 0, 0), 0),
    ((2, 1.00, 0, 0.00, 60, 0.00, 0, 0, 0, 0), 0),
    ((7, 0.50, 5, 0.60, 6, 0.70, 0, 0, 0, 0), 0),
    ((10, 1.00, 55, 0.00, 2, 1.00, 0, 0, 0, 0), 0),
    ((6, 0.00, 2, 1.00, 2, 1.00, 0, 0, 0, 0), 0),
    ((3, 0.00, 1, 1.00, 4, 1.00, 0, 0, 1, 0), 0),
    ((8, 0.00, 4, 1.00, 3, 0.00, 0, 0, 0, 0), 0),
    ((5, 0.00, 9, 0.00, 3, 1.00, 0, 0, 0, 0), 0),
    ((12, 0.00, 6, 1.00, 0, 0.00, 0, 0, 0, 0), 0),
    ((4, 0.00, 0, 0.00, 2, 1.00, 0, 0, 0, 0), 0),
    ((2, 0.10, 3, 0.80, 5, 0.00, 0, 0, 0, 0), 0),
    ((10, 0.20, 2, 0.90, 2, 1.00, 0, 0, 0, 0), 0),
    ((45, 0.00, 2, 1.00, 30, 0.00, 0, 0, 0, 0), 1),
    ((25, 0.00, 3, 1.00, 4, 0.00, 0, 0, 0, 0), 1),
    ((20, 0.00, 6, 0.00, 3, 1.00, 0, 0, 0, 0), 1),
    ((70, 0.10, 2, 1.00, 2, 1.00, 0, 0, 0, 0), 1),
    ((6, 0.00, 2, 1.00, 40, 0.00, 0, 0, 1, 0), 1),
    ((9, 0.00, 3, 1.00, 55, 0.00, 0, 0, 0, 0), 1),
    ((18, 0.00, 5, 0.90, 5, 0.90, 0, 0, 0, 0), 1),
    ((30, 0.20, 40, 0.00, 4, 1.00, 0, 0, 0, 0), 1),
    ((4, 0.00, 60, 0.00, 2, 1.00, 0, 0, 0, 0), 1),
)


def _marked_examples() -> tuple:
    """Blocks of pages with an article: whatever their words and links, its own blocks are the text."""
    shapes = [
        (words, density, *before, *after)
        for words, density in ((1, 0.0), (9, 0.0), (60, 0.0), (5, 1.0))
        for before in ((0, 0.0), (8, 1.0), (50, 0.0))
        for after in ((0, 0.0), (2, 1.0), (12, 0.0), (50, 0.0))
    ]
    places = (((0, 1), 1), ((1, 1), 0), ((0, 0), 0))  # (furniture, in article) and the label
    return tuple(((*shape, *place, 0, 1), label) for shape in shapes for place, label in places)


EXAMPLES = UNMARKED + _marked_examples()
DEPTH = 12

_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|$))"
    r"|<(?P<raw>" + "|".join(RAW_TEXT) + r")(?=[\s/>])(?P<raw_attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*>"
    r"|<[!?/][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.IGNORECASE)
_WORD_OF_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_CUT_TAG = re.compile(r"<(?:[a-zA-Z!?]|/[a-zA-Z])[^>]*\Z")


@dataclass
class Block:
    """A run of text without a block-level tag inside."""

    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    furniture: bool = False
    article: bool = False
    heading: bool = False
    text: str = ""
    words: int = 0
    density: float = 0.0


@dataclass
class Open:
    name: str
    furniture: bool
    article: bool
    link: bool
    heading: bool
    # The nearest hidden element around the text, and whether its own end was found.
    hidden: Open | None = None
    outer: Open | None = None
    ended: bool = False
    lost: bool | None = None

    def dropped(self) -> bool:
        """Whether a hidden element around has its end; asked when the page has been read."""
        around, asked = self if self.name in HIDDEN else self.hidden, []
        while around is not None and around.lost is None and not around.ended:
            asked.append(around)
            around = around.outer
        lost = around is not None and (around.ended or bool(around.lost))
        for x in asked:
            x.lost = lost
        return lost


def _is_furniture(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element begins page furniture, by its own name, role, class and id."""
    if name in FURNITURE_TAGS or (name == "header" and not in_article):
        return True
    if not attributes or name in ("html", "body"):
        return False
    for kind, *values in _ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "")
        kind = kind.lower()
        if kind == "role" and value.lower() in FURNITURE_ROLES:
            return True
        if kind == "hidden" or (kind == "aria-hidden" and value.lower() == "true"):
            return True
        if kind == "style" and "display:none" in value.lower().replace(" ", ""):
            return True
        if kind in ("class", "id"):
            for label in value.split():
                words = [w.lower() for w in _WORD_OF_NAME.findall(label)]
                if LAYOUT_WORDS.isdisjoint(words) and not FURNITURE_WORDS.isdisjoint(words):
                    # The heading part of an article is called a header, too.
                    if in_article and FURNITURE_WORDS.intersection(words) <= {"header", "banner"}:
                        continue
                    return True
    return False


def blocks_of(html: str) -> tuple[list[Block], bool]:
    """The text blocks of a page in order, and whether it has an article."""
    stack: list[Open] = []
    # Texts, and None where a block ends, with the element around them: an element without an end hides nothing.
    events: list[tuple[str | None, Open | None]] = []
    articles: list[Open] = []

    def flush() -> None:
        events.append((None, stack[-1] if stack else None))

    def add(raw: str) -> None:
        events.append((unescape(raw) if "&" in raw else raw, stack[-1] if stack else None))

    def close(position: int, own: bool = False) -> None:
        stack[position].ended = own
        events.extend((None, x) for x in stack[position:] if x.name in BLOCK)
        del stack[position:]

    at, end = 0, len(html)
    while at < end:
        tag = _TAG.search(html, at)
        text = html[at : tag.start()] if tag else _CUT_TAG.sub("", html[at:])
        if text:
            add(text)
        if tag is None:
            break
        at = tag.end()
        raw = tag["raw"]
        # Inside svg and math there are no raw texts.
        if raw and not any(x.name in FOREIGN for x in stack):
            stop = re.compile(rf"</{raw}\b[^>]*>", re.IGNORECASE).search(html, at)
            at = stop.end() if stop else end
            continue
        name = raw or tag["name"]
        if not name:
            continue
        name, attributes = name.lower(), tag["raw_attrs"] if raw else tag["attrs"]
        if tag["close"]:
            for position in range(len(stack) - 1, -1, -1):
                if stack[position].name == name:
                    close(position, own=True)
                    break
            else:
                if name in BLOCK:
                    flush()
            continue
        if name == "br":
            add(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if attributes.endswith("/") and (name in FOREIGN or any(x.name in FOREIGN for x in stack)):
            continue
        if name in BLOCK:
            # A block ends an open paragraph, with what is open inside it.
            for position in range(len(stack) - 1, -1, -1):
                if stack[position].name == "p":
                    close(position)
                    break
                if stack[position].name in BLOCK or stack[position].name in HIDDEN:
                    break
            flush()
        if name in IMPLIED_END:
            ended, limits = IMPLIED_END[name]
            for position in range(len(stack) - 1, -1, -1):
                if stack[position].name in ended:
                    close(position)
                    break
                if stack[position].name in limits or stack[position].name in HIDDEN:
                    break
        if name == "a":
            for position in range(len(stack) - 1, -1, -1):
                if stack[position].name == "a":
                    close(position)
                    break
                if stack[position].name in BLOCK or stack[position].name in HIDDEN:
                    break
        top = stack[-1] if stack else Open("", False, False, False, False)
        furniture = _is_furniture(name, attributes, top.article)
        is_article = name in ARTICLE_TAGS or "role=\"main\"" in attributes or "role=\"article\"" in attributes
        opened = Open(
            name,
            furniture or top.furniture,
            is_article or top.article,
            name == "a" or (top.link and name != "p"),
            name in HEADINGS or top.heading,
        )
        around = top if top.name in HIDDEN else top.hidden
        opened.hidden = opened.outer = around
        if is_article and not opened.furniture:
            articles.append(opened)
        stack.append(opened)
    flush()
    return _blocks(events), any(not x.dropped() for x in articles)


def _blocks(events: list[tuple[str | None, Open | None]]) -> list[Block]:
    found: list[Block] = []
    current = Block()
    begun = False
    for text, top in events:
        if top is not None and (top.hidden or top.name in HIDDEN) and top.dropped():
            continue
        if text is None:
            whole = " ".join("".join(current.pieces).split())
            if whole:
                current.text = whole
                current.words = whole.count(" ") + 1
                current.density = min(1.0, current.linked / current.words)
                found.append(current)
            if current.pieces:
                current, begun = Block(), False
            continue
        if not begun and text.strip():
            begun = True
            current.furniture = bool(top and top.furniture)
            current.article = bool(top and top.article)
            current.heading = bool(top and top.heading)
        current.pieces.append(text)
        if top and top.link:
            current.linked += len(text.split())
    return found


def features(blocks: list[Block], has_article: bool) -> list[tuple[float, ...]]:
    """A row for each block, as in ``EXAMPLES``."""
    # Furniture next to a block says nothing about it: there it counts as the page's edge.
    sides = [(0, 0.0), *[(0, 0.0) if b.furniture else (b.words, b.density) for b in blocks], (0, 0.0)]
    rows = []
    for i, block in enumerate(blocks):
        before, after = sides[i], sides[i + 2]
        rows.append(
            (block.words, block.density, *before, *after, block.furniture, block.article, block.heading, has_article)
        )
    return rows


def block_tree(examples=EXAMPLES, depth: int = DEPTH) -> Tree | float:
    """The tree grown from labelled blocks."""
    return grow(np.array([x for x, _ in examples], dtype=float), np.array([y for _, y in examples]), depth)


def main_text(html: str | None, tree: Tree | float) -> str:
    """The blocks that the tree takes for main text, joined by an empty line."""
    if not html:
        return ""
    blocks, has_article = blocks_of(html)
    rows = features(blocks, has_article)
    return "\n\n".join(b.text for b, row in zip(blocks, rows, strict=True) if decide(tree, row) >= 0.5)


def extract_text(pages: DataFrame, html: str = "html", examples=EXAMPLES) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``.

    Nulls: a null or empty page has an empty text.  Pages are read whole, cut tags and unclosed
    elements included; nothing of the kept blocks is shortened.  Repeated rows get equal texts,
    an empty table stays empty, and an input column named like a result is replaced by it.
    """
    added = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    tree = block_tree(examples)

    def make():
        def compute(values: pa.Array) -> list:
            texts = [main_text(x, tree) for x in values.to_pylist()]
            return [pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]

        return compute

    return append_columns(pages, [html], added, make)
