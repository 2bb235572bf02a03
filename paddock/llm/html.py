"""Main text of web pages from flat blocks and a decision tree.

A page is cut into blocks of text at tags that begin or end a block.  Each
block is described by its number of words, the share of them in links, the same
of the blocks before and after it, and the region it stands in.  A decision
tree trained on a small labelled table of such blocks says which belong to the
article.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.texts import small_batches

# Fixed values of HTML: elements that don't break a block, that hold raw text, that stand for parts of a page.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img "
    "math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub "
    "msubsup msup mtable mtd mtext mtr munder munderover none semantics".split()
)
# Elements whose content is not text of the page; of these only the first two run to the page's end if they aren't closed.
RAW = frozenset(
    "script style noscript template title textarea svg annotation annotation-xml iframe object canvas audio video select button".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SIDE = frozenset("nav footer header aside form menu dialog head fieldset".split())
ARTICLE = frozenset("article main".split())
# Words of class, id and role that name a part of a page.
SIDE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo "
    "adsbygoogle cookie cookies copyright disqus footer form gdpr header login masthead menu menubar modal nav navbar navigation newsletter "
    "notice notices overlay pagination pager popular popup promo promoted promotion recommended related replies reply search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe tagcloud taglist tags toolbar toc trending widget widgets".split()
)
# Parts of a compound name behind the part that names the thing, and parts that make it a property of something else.
PLACES = frozenset(
    "area articles bar block body bottom box buttons card cards container content group inner item items left links list message outer policy "
    "posts right section slot stories text thread top trail unit wrap wrapper".split()
)
# Pairs of parts that name a part of a page only together.
SIDE_PAIRS = frozenset([("tag", "cloud"), ("tag", "links"), ("tag", "list")])
PROPERTIES = frozenset("category format has hide is js no not show status tag type with without".split())
ARTICLE_WORDS = frozenset("article articlebody content entry main maincontent post postcontent story storybody".split())

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*)(?P<rest2>[^>]*+)(?:>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)|</[^>]*+(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.IGNORECASE) for tag in RAW}
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")

#: Of a block: words, share in links, both of the block before, both of the block after, region (1 article, 0 unknown, -1 aside).
Features = tuple[float, float, float, float, float, float, float]
FEATURE_NAMES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "region")

#: The labelled table: features of a block and whether it is main text.
LABELLED: tuple[tuple[Features, bool], ...] = (
    # In a marked article everything is main text, however short.
    ((9, 0.0, 8, 0.0, 90, 0.0, 1), True),
    ((120, 0.0, 9, 0.0, 75, 0.0, 1), True),
    ((75, 0.05, 120, 0.0, 3, 0.0, 1), True),
    ((3, 0.0, 75, 0.05, 1, 0.0, 1), True),
    ((1, 0.0, 3, 0.0, 60, 0.0, 1), True),
    ((60, 0.0, 1, 0.0, 12, 0.0, 1), True),
    ((12, 0.3, 60, 0.0, 10, 0.0, 1), True),
    ((4, 1.0, 80, 0.0, 50, 0.1, 1), True),
    ((30, 0.0, 4, 1.0, 7, 0.0, 1), True),
    ((1, 0.0, 1, 0.0, 1, 0.0, 1), True),
    ((1, 0.0, 0, 0.0, 2, 1.0, 1), True),
    ((8, 0.0, 1, 1.0, 6, 0.8, 1), True),
    ((2, 1.0, 1, 1.0, 3, 1.0, 1), True),
    ((50, 0.0, 2, 1.0, 0, 0.0, 1), True),
    ((6, 0.0, 20, 0.4, 9, 0.3, 1), True),
    ((15, 0.6, 6, 0.5, 4, 0.9, 1), True),
    ((3, 0.0, 5, 0.9, 0, 0.0, 1), True),
    ((12, 0.0, 0, 0.0, 0, 0.0, 1), True),
    ((9, 0.9, 0, 0.0, 1, 1.0, 1), True),
    ((2, 0.0, 3, 0.7, 30, 0.6, 1), True),
    ((40, 0.1, 2, 0.8, 5, 0.5, 1), True),
    ((5, 0.5, 40, 0.1, 0, 0.0, 1), True),
    # Beside it nothing is.
    ((1, 1.0, 0, 0.0, 1, 1.0, -1), False),
    ((1, 1.0, 1, 1.0, 1, 1.0, -1), False),
    ((2, 1.0, 1, 1.0, 8, 0.0, -1), False),
    ((8, 0.0, 1, 1.0, 9, 0.0, -1), False),
    ((45, 0.0, 2, 0.0, 30, 0.0, -1), False),
    ((90, 0.1, 45, 0.0, 60, 0.0, -1), False),
    ((10, 0.0, 60, 0.0, 0, 0.0, -1), False),
    ((25, 0.0, 90, 0.0, 10, 0.0, -1), False),
    ((6, 0.0, 12, 0.0, 40, 0.0, -1), False),
    ((60, 0.0, 70, 0.0, 80, 0.0, -1), False),
    ((70, 0.0, 60, 0.0, 0, 0.0, -1), False),
    ((80, 0.0, 5, 0.0, 20, 0.1, -1), False),
    ((35, 0.0, 80, 0.0, 35, 0.0, -1), False),
    ((120, 0.0, 40, 0.2, 100, 0.0, -1), False),
    ((55, 0.3, 120, 0.0, 65, 0.0, -1), False),
    ((38, 0.0, 25, 0.0, 44, 0.0, -1), False),
    ((5, 0.0, 38, 0.0, 150, 0.0, -1), False),
    ((9, 1.0, 22, 0.0, 48, 0.0, -1), False),
    ((200, 0.0, 2, 0.0, 3, 0.0, -1), False),
    ((64, 0.1, 33, 0.0, 1, 1.0, -1), False),
    # Pages without marks: long blocks with few links, and short ones between them.
    ((80, 0.0, 9, 0.0, 60, 0.0, 0), True),
    ((60, 0.05, 80, 0.0, 45, 0.0, 0), True),
    ((45, 0.1, 60, 0.05, 5, 0.0, 0), True),
    ((30, 0.0, 45, 0.1, 40, 0.0, 0), True),
    ((22, 0.0, 30, 0.0, 35, 0.1, 0), True),
    ((35, 0.2, 22, 0.0, 18, 0.0, 0), True),
    ((18, 0.0, 35, 0.2, 50, 0.0, 0), True),
    ((5, 0.0, 45, 0.1, 70, 0.0, 0), True),
    ((7, 0.0, 60, 0.0, 55, 0.0, 0), True),
    ((3, 0.0, 50, 0.0, 40, 0.0, 0), True),
    ((2, 0.0, 40, 0.0, 38, 0.0, 0), True),
    ((50, 0.0, 60, 0.0, 0, 0.0, 0), True),
    ((40, 0.0, 30, 0.0, 3, 1.0, 0), True),
    ((34, 0.1, 40, 0.0, 2, 0.5, 0), True),
    ((65, 0.0, 2, 1.0, 4, 0.0, 0), True),
    ((28, 0.0, 0, 0.0, 6, 0.0, 0), True),
    ((90, 0.05, 3, 1.0, 8, 0.9, 0), True),
    # A page of a sentence or two, with a heading or without.
    ((5, 0.0, 0, 0.0, 0, 0.0, 0), True),
    ((10, 0.0, 0, 0.0, 0, 0.0, 0), True),
    ((14, 0.2, 0, 0.0, 0, 0.0, 0), True),
    ((3, 0.0, 0, 0.0, 15, 0.0, 0), True),
    ((2, 0.0, 0, 0.0, 12, 0.0, 0), True),
    ((15, 0.0, 3, 0.0, 0, 0.0, 0), True),
    ((12, 0.0, 2, 0.0, 0, 0.0, 0), True),
    ((2, 1.0, 0, 0.0, 0, 0.0, 0), False),
    # And what surrounds them.
    ((2, 1.0, 1, 1.0, 70, 0.0, 0), False),
    ((1, 1.0, 2, 1.0, 9, 0.0, 0), False),
    ((3, 0.0, 5, 1.0, 5, 0.0, 0), False),
    ((4, 0.0, 2, 0.0, 6, 0.0, 0), False),
    ((6, 0.0, 4, 0.0, 7, 0.0, 0), False),
    ((5, 1.0, 4, 1.0, 60, 0.0, 0), False),
    ((1, 1.0, 70, 0.0, 0, 0.0, 0), False),
    ((2, 1.0, 60, 0.0, 3, 1.0, 0), False),
    ((3, 0.7, 50, 0.1, 2, 0.0, 0), False),
    ((4, 1.0, 35, 0.0, 9, 0.0, 0), False),
    ((4, 0.0, 55, 0.0, 0, 0.0, 0), False),
    ((6, 0.0, 80, 0.0, 2, 1.0, 0), False),
    ((2, 1.0, 1, 1.0, 2, 1.0, 0), False),
    ((3, 1.0, 2, 1.0, 4, 0.9, 0), False),
    ((15, 0.9, 3, 1.0, 20, 0.95, 0), False),
    ((40, 0.8, 15, 0.9, 3, 1.0, 0), False),
    ((30, 0.6, 40, 0.8, 2, 1.0, 0), False),
    ((4, 0.0, 2, 1.0, 3, 1.0, 0), False),
    ((6, 0.0, 0, 0.0, 2, 1.0, 0), False),
    ((8, 0.0, 3, 0.5, 4, 0.0, 0), False),
    ((5, 0.2, 8, 0.0, 0, 0.0, 0), False),
    ((9, 0.0, 5, 0.2, 0, 0.0, 0), False),
    ((12, 0.5, 6, 0.0, 3, 0.4, 0), False),
)


@dataclass(frozen=True)
class Tree:
    """A leaf has a verdict; else ``low`` holds the blocks with the feature at most ``at``."""

    main: bool
    feature: int = -1
    at: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def decide(self, x: Features) -> bool:
        node = self
        while node.low is not None:
            node = node.low if x[node.feature] <= node.at else node.high
        return node.main


def _impurity(rows: list[tuple[Features, bool]]) -> float:
    p = sum(y for _, y in rows) / len(rows)
    return len(rows) * p * (1 - p)


def train(rows: tuple | list = LABELLED, depth: int = 8) -> Tree:
    """A tree that splits where the classes separate best, midway between two values; of equal splits the first."""
    rows = list(rows)
    main = 2 * sum(y for _, y in rows) > len(rows)
    best, chosen = _impurity(rows) - 1e-9 if rows else 0.0, None
    if depth and best > 0:
        for f in reversed(range(len(FEATURE_NAMES))):  # the region first
            values = sorted({x[f] for x, _ in rows})
            for a, b in zip(values, values[1:]):
                at = (a + b) / 2
                sides = [r for r in rows if r[0][f] <= at], [r for r in rows if r[0][f] > at]
                left = _impurity(sides[0]) + _impurity(sides[1])
                if left < best:
                    best, chosen = left, (f, at, sides)
    if chosen is None:
        return Tree(main)
    f, at, (low, high) = chosen
    return Tree(main, f, at, train(low, depth - 1), train(high, depth - 1))


@dataclass
class Block:
    text: str
    words: int
    links: float
    region: int


def _named(name: str) -> int:
    """What one class, id or role says of an element: 1 article, -1 aside, 0 nothing.

    The part that names the thing is the last one that isn't a place: ``left-sidebar`` and ``comments-area`` are
    aside, ``comments-open`` and ``has-sidebar`` say nothing, and ``entry-header`` is the article's own.
    """
    parts = _WORD.findall(name)
    held = set(parts)
    aside = held & SIDE_WORDS
    if tuple(parts[-2:]) in SIDE_PAIRS:
        return -1
    if not aside:
        return 1 if held & ARTICLE_WORDS else 0
    if aside == {"header"} and held & {"article", "entry", "post", "story"}:
        return 1
    while len(parts) > 1 and parts[-1] in PLACES:
        parts.pop()
    return -1 if parts[-1] in SIDE_WORDS and not held & PROPERTIES else 0


def _region(tag: str, rest: str, now: int) -> int:
    """The region inside an element that stands in region ``now``."""
    if tag in ARTICLE:
        return 1
    if tag == "header" and now == 1:  # of the article itself
        return 1
    if tag in SIDE:
        return -1
    if now != -1 or tag not in ("html", "body"):
        names = set()
        if tag not in ("html", "body"):
            for m in _NAMES.finditer(rest):
                names.update(map(_named, (m[1] or m[2] or m[3] or "").lower().split()))
        if -1 in names:
            return -1
        if now == 0 and 1 in names:
            return 1
    return now


def blocks(page: str) -> list[Block]:
    """Non-empty blocks of a page in order; references decoded, white space turned into one space."""
    found: list[Block] = []
    open_tags: list[tuple[str, int]] = []  # elements that aren't inline, with the region outside them
    region, in_link, at = 0, False, 0
    parts: list[tuple[str, bool]] = []
    unclosed: set[str] = set()  # raw elements that no end tag follows any more

    def close():
        if parts:
            text = " ".join(html.unescape("".join([p for p, _ in parts])).split())
            if text:
                linked = sum(len(html.unescape(p).split()) for p, link in parts if link)
                n = len(text.split())
                found.append(Block(text, n, min(1.0, linked / n), region))
            parts.clear()

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            parts.append((page[at : m.start()], in_link))
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        ends = bool(m["end"] or m["end2"])
        rest = m["rest"] or m["rest2"] or ""
        if tag in ("svg", "math") and rest.endswith("/"):
            continue
        if tag in RAW and not ends and tag not in unclosed:
            if tag in ("select", "button", "textarea"):
                close()
            if end := _RAW_ENDS[tag].search(page, at):
                at = end.end()
                continue
            if tag in ("script", "style"):
                at = len(page)
                break
            unclosed.add(tag)
        if tag in INLINE:
            if tag == "a":
                in_link = not ends
            continue
        close()
        in_link = False if ends else in_link
        if tag in VOID:
            continue
        if ends:
            for k in range(len(open_tags) - 1, -1, -1):
                if open_tags[k][0] == tag:
                    region = open_tags[k][1]
                    del open_tags[k:]
                    break
        else:
            if tag in ("p", "li") and open_tags and open_tags[-1][0] == tag:  # the end tag may be missing
                region = open_tags.pop()[1]
            if tag == "body":
                open_tags.clear()
                region = 0
            open_tags.append((tag, region))
            region = _region(tag, rest, region)
    if at < len(page):
        parts.append((page[at:], in_link))
    close()
    return found


def features(found: list[Block]) -> list[Features]:
    none = Block("", 0, 0.0, 0)
    around = zip([none, *found[:-1]], found, [*found[1:], none])
    return [(b.words, b.links, a.words, a.links, c.words, c.links, b.region) for a, b, c in around]


def main_text(page: str | None, tree: Tree) -> str:
    """The blocks that the tree takes for main text, joined by one space."""
    if not page:
        return ""
    found = blocks(page)
    return " ".join([b.text for b, x in zip(found, features(found)) if tree.decide(x)])


def extract(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text and its number of characters.

    A null or empty page, and one without main text, gives the empty text.
    Repeated rows give repeated rows; other columns are ignored.
    """
    small_batches(pages.sparkSession)
    known = tree or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, known) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
