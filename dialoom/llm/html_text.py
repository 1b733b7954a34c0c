"""Main text of HTML pages: flat text blocks classified by a decision tree trained on a small labelled table."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Markup: comments, elements whose content isn't text, declarations, tags with their attributes, and text. A quote begins
#: a value only after an equals sign; a tag that the page's end cuts off is markup still. Nothing is tried twice: parts
#: are possessive, so that reading a page takes time in proportion to its length.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|title|noscript|template|svg|textarea|iframe|object|math)\b[^>]*+(?:(?<=/)>|>.*?(?:</\1\s*+>|\Z)|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)|([^<]++|<)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|style)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|\b(hidden)\b", re.I)
#: Characters of scripts that are written without spaces; each counts as a word.
UNSPACED = re.compile("[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Tags that stay inside a block; every other tag ends the block before it.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements with an end tag that hold blocks, so that what they say of their content ends with them.
HOLDERS = frozenset("address article aside blockquote body button center details dialog div dl fieldset figure footer form head header html label legend main menu nav ol section select table tbody td tfoot th thead tr ul".split())
CLUTTER_TAGS = frozenset("aside button dialog fieldset footer form head label legend menu nav option select".split())
CLUTTER_NAMES = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs captcha comment comments consent cookie cookies disclaimer disqus footer form gdpr login menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted recommended related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe tagcloud tags toolbar topbar widget widgets".split()
)
CONTENT_TAGS = frozenset(("article", "main"))
CONTENT_NAMES = frozenset("article articlebody body content entry main post story text".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def word_count(text: str) -> int:
    return len(text.split()) + (0 if text.isascii() else len(UNSPACED.findall(text)))


@dataclass
class Block:
    """One run of text without a block-level tag inside, and what its surroundings say."""

    text: str
    words: int
    linked: int
    clutter: bool
    content: bool
    heading: bool
    item: bool

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def surroundings(tag: str, attributes: str, inside: tuple[bool, bool]) -> tuple[bool, bool]:
    """(clutter, content) of an element from its tag and names, given those of the element around it."""
    clutter, content = inside
    names, hidden = set(), False
    for key, value, flag in ATTRIBUTE.findall(attributes):
        if key.lower() == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
        else:
            names |= {x.lower() for x in NAME_PART.findall(value)}
            hidden |= bool(flag)
    clutter |= hidden or tag in CLUTTER_TAGS or bool(names & CLUTTER_NAMES)
    if tag == "header" or "header" in names:  # an article's own header is part of it
        clutter |= not content
    content |= tag in CONTENT_TAGS or (tag != "body" and bool(names & CONTENT_NAMES))
    return clutter, content


def muted(tag: str, attributes: str) -> bool:
    """Whether what an inline element holds is no text of its block: it is hidden, or a span named as clutter."""
    names = set()
    for key, value, flag in ATTRIBUTE.findall(attributes):
        if flag or (key.lower() == "style" and "display:none" in value.replace(" ", "").lower()):
            return True
        names |= {x.lower() for x in NAME_PART.findall(value)} if key.lower() != "style" else set()
    return tag == "span" and bool(names & CLUTTER_NAMES)


#: Inline tags without content.
EMPTY = frozenset("br img input wbr".split())


#: Inline elements inside a muted one that are followed; deeper ones end with those around them.
DEEPEST = 64


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in order. What a muted inline element holds goes, up to its end tag or the end of the
    element around it."""
    out, text, linked, anchors, tag = [], [], [], 0, ""
    quiet: list[tuple[str, int]] = []  # open inline elements from the first muted one on, and the depth they began at
    stack: list[tuple[str, tuple[bool, bool]]] = [("", (False, False))]
    open_: Counter[str] = Counter()

    def flush() -> None:
        words = " ".join("".join(text).split())
        if words:
            clutter, content = stack[-1][1]
            out.append(Block(words, word_count(words), word_count("".join(linked)), clutter, content, tag in HEADINGS, tag == "li"))
        text.clear(), linked.clear()

    for m in MARKUP.finditer(page):
        raw, end, name, attributes, chars = m.groups()
        if chars is not None:
            if quiet:
                continue
            chars = html.unescape(chars)
            text.append(chars)
            if anchors:
                linked.append(chars)
        elif name:
            name = name.lower()
            if name == "a":
                anchors = 0 if end else 1
                linked.append(" ")
            elif name == "br":
                text.append(" ")
            if name in INLINE:
                if end:
                    at = next((i for i in range(len(quiet) - 1, -1, -1) if quiet[i][0] == name), None) if quiet else None
                    if at is not None:
                        del quiet[at:]
                elif name not in EMPTY and (quiet or (attributes and muted(name, attributes))) and len(quiet) < DEEPEST:
                    quiet.append((name, len(stack)))
                continue
            flush()
            tag = "" if end else name
            if name in HOLDERS:
                if not end:
                    if not attributes.endswith("/"):
                        stack.append((name, surroundings(name, attributes, stack[-1][1])))
                        open_[name] += 1
                elif open_[name]:
                    while True:
                        ended = stack.pop()[0]
                        open_[ended] -= 1
                        if ended == name:
                            break
                    while quiet and quiet[-1][1] > len(stack):
                        quiet.pop()
                anchors = 0
    flush()
    return out


FEATURES = ("words", "density", "words before", "density before", "words after", "density after", "clutter", "content", "heading", "item")


def features(found: list[Block]) -> list[tuple[float, ...]]:
    """FEATURES of each block; a page's first and last block have neighbours without words."""
    sizes = [(0, 0.0), *((b.words, b.density) for b in found), (0, 0.0)]
    return [(*sizes[i], *sizes[i - 1], *sizes[i + 1], float(b.clutter), float(b.content), float(b.heading), float(b.item)) for i, b in enumerate(found, 1)]


PROSE = "The committee met again on Tuesday and agreed, after a long debate, that the old bridge should be repaired before the winter."
#: The labelled table: pages as (block markup, 1 for main text or 0) in order.
LABELLED = (
    (("<header><h2>The Daily Planet", 0), ("</header><nav><ul><li><a href=/a>Home</a>", 0), ("<li><a href=/b>World news</a></ul></nav>", 0), ("<article><h1>Bridge to be repaired</h1>", 1), (f"<p>{PROSE}", 1), ("<p>So it goes.", 1), (f"<p>{PROSE} <a href=/x>Read the report</a>", 1), ("<div class=ad>Buy two lamps and get a third one free today.</div>", 0), (f"<p>{PROSE} {PROSE}", 1), ("<p>No.</article>", 1), ("<footer>&copy; 2020 The Daily Planet. All rights reserved.</footer>", 0)),
    (("<div class=topbar>Call us on working days between nine and five.</div>", 0), ("<ul class=menu><li><a href=/1>Start</a>", 0), ("<li><a href=/2>Shop</a></ul>", 0), ("<main><h1>How to plant beans</h1>", 1), (f"<p>{PROSE}", 1), ("<ul><li>A spade", 1), ("<li>Water and some patience</ul>", 1), (f"<p>{PROSE} {PROSE}", 1), ("</main><aside>Popular posts of this week, as chosen by our readers and friends.</aside>", 0), (f"<div id=comments><p>{PROSE}", 0), ("<p>I agree!</div>", 0), ("<form>Your name <input> and message", 0), ("<button>Send</button></form>", 0)),
    (("<h1>Notes on a storm</h1>", 1), (f"<p>{PROSE} {PROSE}", 1), (f"<p>{PROSE}", 1), ("<p>It rained.", 1), (f"<p>{PROSE}", 1), ("<p><a href=/next>Next</a> <a href=/prev>Previous</a>", 0), ("<p><a href=/t>Terms</a> <a href=/p>Privacy</a> <a href=/c>Contact</a>", 0)),
    (("<div><a href=/>Home</a> <a href=/f>Forum</a>", 0), ("</div><div><a href=/l>Log in</a></div>", 0), ("<div>Posted in <a href=/g>Gardens</a> <a href=/r>Roses</a> <a href=/i>Ivy</a>", 0), ("</div><h2>A letter from the coast</h2>", 1), (f"<div>{PROSE}</div>", 1), (f"<div>{PROSE} {PROSE} <a href=/m>map</a></div>", 1), ("<div>Share <a href=/1>this</a></div>", 0), ("<div><a href=/2>More stories from the coast and the islands</a></div>", 0)),
    (("<div class=cookie-notice>We use cookies to make this site work, and to learn how you use it, as our policy explains at length.</div>", 0), ("<div class=content><h1>On reading slowly</h1>", 1), (f"<p>{PROSE} {PROSE} {PROSE}", 1), ("<blockquote>Haste is a thief.</blockquote>", 1), (f"<p>{PROSE}", 1), ("<table><tr><td>Pages", 1), ("<td>212</table>", 1), (f"<div class='newsletter-signup'><p>{PROSE}</div>", 0), ("<p>The end.</div>", 1), ("<div class=sidebar><p>About the author, who lives by the sea with two dogs and a cat.</div>", 0), ("<div class=footer>Made with care in a small town.</div>", 0)),
    (("<div>Advertisement</div>", 0), ("<div>Edition for subscribers</div>", 0), ("<h1>The clock on the tower</h1>", 1), (f"<p>{PROSE}", 1), ("<p>Quite so.", 1), (f"<p>{PROSE} {PROSE}", 1), ("<div>Page 3 of 12</div>", 0), ("<div>Copyright 2019</div>", 0)),
    (("<div>Twelve degrees, light rain</div>", 0), ("<div>Tuesday, 4 May</div>", 0), ("<div>Text size: small, large</div>", 0), ("<h2>A short history of salt</h2>", 1), (f"<p>{PROSE} {PROSE}", 1), ("<p>Yes.", 1), (f"<p>{PROSE}", 1), ("<div>Print this page</div>", 0), ("<div>Back to top</div>", 0)),
    (("<h1>A walk before breakfast</h1>", 1), (f"<p>{PROSE}", 1), (f"<p>{PROSE} {PROSE}", 1)),
    (("<h2>Letters</h2>", 1), (f"<p>{PROSE}", 1), (f"<p>{PROSE}", 1)),
    (("<article><h1>Two brothers</h1>", 1), (f"<p>{PROSE}", 1), ("<p>They agreed.</article>", 1)),
    (("<main><h1>Three short lines</h1>", 1), ("<p>Snow.", 1), ("<p>Then wind.", 1), ("<p>Then snow again.", 1), ("<p>No more.</main>", 1), ("<div>Terms and conditions</div>", 0)),
)


def grow(rows: list[tuple[tuple[float, ...], int]], depth: int) -> tuple:
    """A decision tree by Gini impurity: (share of main text,) or (feature, bound, at most, above)."""
    ones = sum(y for _, y in rows)
    share = ones / len(rows)
    impurity = lambda part: len(part) * (s := sum(y for _, y in part) / len(part)) * (1 - s)
    best = (impurity(rows) - 1e-9, None)
    if depth and 0 < ones < len(rows):
        for f in range(len(FEATURES)):
            values = sorted({x[f] for x, _ in rows})
            for lo, hi in zip(values, values[1:], strict=False):
                bound = (lo + hi) / 2
                parts = [r for r in rows if r[0][f] <= bound], [r for r in rows if r[0][f] > bound]
                best = min(best, (sum(map(impurity, parts)), (f, bound, *parts)), key=lambda b: b[0])
    if best[1] is None:
        return (share,)
    f, bound, low, high = best[1]
    return f, bound, grow(low, depth - 1), grow(high, depth - 1)


def train(pages: tuple = LABELLED, depth: int = 5) -> tuple:
    """The tree of a labelled table."""
    rows = []
    for page in pages:
        found = blocks("".join(part for part, _ in page))
        if len(found) != len(page):
            raise ValueError(f"{len(page)} labels for {len(found)} blocks")
        rows += zip(features(found), (y for _, y in page), strict=True)
    return grow(rows, depth)


def is_main(tree: tuple, x: tuple[float, ...]) -> bool:
    while len(tree) > 1:
        f, bound, low, high = tree
        tree = low if x[f] <= bound else high
    return tree[0] >= 0.5


def main_text(page: str, tree: tuple) -> str:
    """The page's main blocks, joined by blank lines."""
    found = blocks(page)
    return "\n\n".join(b.text for b, x in zip(found, features(found), strict=True) if is_main(tree, x))


def extract(pages: DataFrame, labelled: tuple = LABELLED) -> DataFrame:
    """One row (page_id, url, text, n_chars) per row of pages: the main text of the whole html.

    Pages become flat blocks of text between block-level tags; a block's word count and link density, those of its
    neighbours and what the elements around it are named are judged by a tree trained on `labelled`. Character
    references are decoded, white space in a block becomes one space, and blocks are joined by a blank line. Pages
    that are null, empty or without main text give an empty text. Unclosed tags end where an element around them
    does. Repeated rows and null ids are extracted each; extra columns are ignored.
    """
    tree = train(labelled)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [main_text(x, tree) if x else "" for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return chosen.mapInArrow(texts, "page_id long, url string, text string, n_chars long")
