"""Main text of HTML pages by tree scoring.

The page's elements form a tree (unclosed and stray tags are put right as far as
it takes to tell blocks apart). Every paragraph of running text passes points
for its length and commas to its ancestors, the nearer ones more, discounted by
the share of its text that is in links. The container with the most points is
kept, with those siblings that have a good part of its points or are paragraphs
and headings of their own.

Left out wherever they are: scripts, styles, forms and their controls, menus,
footers, sidebars, page headers, dialogs, hidden elements, and elements whose
class, id or role says that they are one of these, an advert, a notice or reader
comments; and lists, tables and boxes that mostly are links. They end where HTML ends
them, also without an end tag. A name only says so if no has, no or with goes before
it. The scores decide on a block whose other names are of a main text, and on one that
holds most of the running text and an article, main or h1 where none stands elsewhere.

A block is a run of text and inline elements between block tags. Character
references are decoded, white space (with line breaks) becomes one space, blocks
are trimmed and joined by ``\\n`` in page order. Nothing else is dropped.

Edge cases: null and empty pages, and pages without text, give an empty string;
a page that ends in the middle of a tag or element counts up to there; without
any scored container all text that isn't left out counts; repeated rows are
worked on each; extra columns are not read.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, row_ranges

BATCH_BYTES = 8 << 20

# Elements of the HTML standard by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr br img".split())
RAW = frozenset("script style noscript template textarea title iframe noframes xmp svg math object".split())
DROPPED = frozenset("nav footer aside form button select option dialog menu head".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
                     "footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: A tag of a group ends an open element of the group.
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
            "th": ("td", "th"), "option": ("option",)}
ENDED_BY |= dict.fromkeys(("tbody", "thead", "tfoot"), ("tbody", "thead", "tfoot", "caption", "tr", "td", "th"))
#: Elements that only tags of a table end from within.
CELLS = frozenset("table caption td th".split())
TABLE_TAGS = frozenset("table caption thead tbody tfoot tr td th".split())
#: Where the search for an element to end stops.
LIMITS = frozenset("ul ol dl table body html article section main div".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre blockquote li td dd div section article main body".split())
BOXES = frozenset("ul ol dl table div section".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())

#: Words of class and id names. Elements named by the first kind are left out (or
#: doubtful, see ``unwanted``); those of the second kind too, unless a word of the third
#: kind stands beside it.
NEVER = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion comment "
                  "comments disqus replies respond cookie cookies consent gdpr popup modal overlay newsletter subscribe "
                  "signup login breadcrumb breadcrumbs pagination pager sidebar sidebars footer nav navbar navigation "
                  "menu menus social share sharing related recommended toolbar skip".split())
SELDOM = frozenset("header masthead banner notice notices notification alert widget widgets aside topbar meta tags "
                   "search bar".split())
GOOD = frozenset("article content entry main post body text story page".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)"
                 r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: What a word says after one of these is a trait of the element, not its kind.
TRAIT = frozenset("has no not with without".split())
#: What ``unwanted`` says: left out unless it holds the main text; the scores decide.
UNLESS_MAIN, BY_SCORE = 2, 3
MAIN_TAGS = frozenset("article main h1".split())


def unwanted(tag: str, attributes: str, in_article: bool) -> int:
    """Whether an element is left out with all that it holds: 0, 1 or a doubtful case."""
    if tag in DROPPED or tag == "header" and not in_article:
        return 1
    if not attributes or tag in ("html", "body"):
        return 0
    words: set[str] = set()
    beside = False  # a name of words of a main text only
    for name, a, b, c, bare in ATTRIBUTE.findall(attributes):
        value = a or b or c
        name = name.lower()
        if bare or name == "hidden":
            return 1
        if name == "role" and value.lower() in ROLES or name == "aria-hidden" and value.lower() == "true":
            return 1
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 1
        if name in ("class", "id"):
            for one in value.split():
                own = [w.lower() for w in NAME_WORD.findall(one)]
                own = own[:next((i for i, w in enumerate(own) if w in TRAIT), len(own))]
                words.update(own)
                beside = beside or not GOOD.isdisjoint(own) and NEVER.isdisjoint(own) and SELDOM.isdisjoint(own)
    if tag in ("article", "main"):
        return int(bool(words & {"comment", "comments", "ad", "ads", "advert"}))
    if words & NEVER:
        return BY_SCORE if beside else UNLESS_MAIN
    return UNLESS_MAIN if words & SELDOM and not words & GOOD else 0


class Element:
    __slots__ = ("tag", "parent", "points", "chars", "linked", "good", "order", "doubt")

    def __init__(self, tag: str, parent: "Element | None", good: bool, order: int):
        self.tag, self.parent, self.good, self.order = tag, parent, good, order
        self.points, self.chars, self.linked, self.doubt = 0.0, 0, 0, False

    def link_share(self) -> float:
        return self.linked / self.chars if self.chars else 0.0


def block_points(text: str, in_links: int) -> float:
    commas = sum(text.count(c) for c in ",،、，")
    return (1 + commas + min(len(text) / 100, 3.0)) * (1 - in_links / len(text))


class Page:
    """The elements and blocks of one page."""

    def __init__(self, source: str):
        self.root = Element("html", None, False, 0)
        self.blocks: list[tuple[Element, str, int]] = []  # (element, text, characters in links)
        self.elements = [self.root]
        self._read(source)
        self._leave_out()
        self._score()

    def _read(self, source: str) -> None:
        stack = [self.root]
        text: list[str] = []
        linked = link_chars = articles = 0
        left_out = 0  # place in the stack of the element that is left out, if any

        def flush() -> None:
            nonlocal link_chars
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                self.blocks.append((stack[-1], joined, min(link_chars, len(joined))))
            text.clear()
            link_chars = 0

        def close(upto: int) -> None:
            nonlocal articles, left_out
            if left_out:
                inside = upto > left_out or upto == left_out and stack[upto].tag in INLINE  # the line goes on
                del stack[max(upto, left_out):]
                if upto <= left_out:
                    left_out = 0
                if inside:
                    return
            flush()
            for e in stack[upto:]:
                articles -= e.tag in ("article", "main")
            del stack[upto:]

        at, end = 0, len(source)
        while at < end:
            found = TAG.search(source, at)
            stop = found.start() if found else end
            if left_out and stack[left_out].tag == "head" and source[at:stop].strip():
                close(left_out)
            if stop > at and not left_out:
                piece = source[at:stop]
                text.append(piece)
                if linked:
                    link_chars += len(html.unescape(piece).strip())
            if not found:
                break
            at = found.end()
            name = found.group(1)
            if name is None:
                continue
            tag, closing = name.lower(), source[stop + 1] == "/"
            attributes = found.group(2)
            empty = attributes.endswith("/>") or tag in VOID
            if tag in RAW:
                if not closing and not empty:
                    over = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(source, at)
                    at = over.end() if over else end
                continue
            if left_out and stack[left_out].tag == "head" and not closing and tag != "html" and tag not in VOID:
                close(left_out)
            if tag == "br":
                if not left_out:
                    text.append(" ")
                continue
            if tag in INLINE:
                if left_out:  # of those inside only the namesakes count
                    if tag == stack[left_out].tag and closing:
                        close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
                    elif tag == stack[left_out].tag and not empty:
                        stack.append(Element(tag, stack[-1], False, -1))
                    continue
                if tag == "a":
                    linked = 0 if closing else 1
                if not closing and not empty and tag != "a" and unwanted(tag, attributes[:-1], True):
                    left_out = len(stack)
                    stack.append(Element(tag, stack[-1], False, -1))
                continue
            if tag in ("html", "body"):
                if not left_out:
                    flush()
                continue
            if closing:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
                    if i >= left_out > 0 and stack[i].tag in CELLS and tag not in TABLE_TAGS:
                        break
                if not left_out:
                    flush()
                    linked = 0
                continue
            # an opening block tag ends an open paragraph and its like
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ENDED_BY.get(tag, ()) or stack[i].tag == "p" and tag in CLOSES_P \
                        or stack[i].tag in HEADINGS and tag in HEADINGS:
                    close(i)
                    if tag not in ("tr", "tbody", "thead", "tfoot"):  # these end a cell and its row
                        break
                elif stack[i].tag in LIMITS or stack[i].tag in DROPPED:
                    break
            if left_out:
                if not empty:
                    stack.append(Element(tag, stack[-1], False, -1))
                continue
            linked = 0
            flush()
            if empty:
                continue
            doubt = unwanted(tag, attributes[:-1], articles > 0)
            if doubt == 1:
                left_out = len(stack)
                stack.append(Element(tag, stack[-1], False, -1))
                continue
            words = {w.lower() for _, a, b, c, _ in ATTRIBUTE.findall(attributes) for w in NAME_WORD.findall(a or b or c)} \
                if len(attributes) > 1 else set()
            element = Element(tag, stack[-1], tag in ("article", "main") or bool(words & GOOD), len(self.elements))
            element.doubt = doubt == UNLESS_MAIN
            articles += tag in ("article", "main")
            self.elements.append(element)
            stack.append(element)
        if left_out:
            del stack[left_out:]
        flush()

    def _leave_out(self) -> None:
        """Takes the doubtful elements that don't hold the main text off the page."""
        if not any(e.doubt for e in self.elements):
            return

        def doubts(e: Element | None):
            while e is not None:
                if e.doubt:
                    yield e
                e = e.parent

        weight: dict[Element, float] = {}
        total = 0.0
        for element, text, in_links in self.blocks:
            if element.tag in PARAGRAPHS:
                points = block_points(text, in_links)
                total += points
                for e in doubts(element):
                    weight[e] = weight.get(e, 0.0) + points
        # elements of a main text by the nearest doubtful element around them
        holders = {next(doubts(e), None) for e in self.elements if e.tag in MAIN_TAGS}
        if None not in holders:
            for e in {d for h in holders for d in doubts(h)}:
                e.doubt = 2 * weight.get(e, 0.0) <= total
        out: set[int] = set()
        for e in self.elements:
            if e.doubt or e.parent is not None and e.parent.order in out:
                out.add(e.order)
        self.blocks = [b for b in self.blocks if b[0].order not in out]
        self.elements = [e for e in self.elements if e.order not in out]

    def _score(self) -> None:
        for element, text, in_links in self.blocks:
            e: Element | None = element
            while e is not None:
                e.chars += len(text)
                e.linked += in_links
                e = e.parent
        for element, text, in_links in self.blocks:
            if element.tag not in PARAGRAPHS:
                continue
            points = block_points(text, in_links)
            holder = element if element.tag in ("div", "section", "article", "main", "body", "html") else element.parent
            share = 1.0
            while holder is not None:
                holder.points += points * share
                share = 0.5 if share == 1.0 else share / 1.5
                holder = holder.parent

    def text(self) -> str:
        best, most = None, 0.0
        for e in self.elements:
            points = e.points * (1 - e.link_share()) * (1.25 if e.good else 1.0)
            if points > most:
                best, most = e, points
        if best is None:
            kept = {self.root.order}
        else:
            kept = {best.order}
            least = max(1.0, 0.2 * most)
            for e in self.elements:
                if e.parent is best.parent and e.parent is not None and (
                        e.points * (1 - e.link_share()) >= least
                        or e.tag in HEADINGS and e.order < best.order
                        or e.tag == "p" and e.chars and e.link_share() < 0.25):
                    kept.add(e.order)
        out = []
        for element, text, _ in self.blocks:
            e, inside, menu = element, False, False
            while e is not None:
                if e.order in kept:
                    inside = True
                    break
                menu = menu or e.tag in BOXES and e.link_share() > 0.66
                e = e.parent
            if not inside and best is not None and element.parent is None is best.parent:
                inside = True  # text of the page itself, which is the best container
            if inside and not menu:
                out.append(text)
        return "\n".join(out)


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, text and n_chars of every page; one narrow stage."""
    src = pages.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)),
                       F.col(f"`{html_col}`").cast("string").alias("text"))

    def run(it):
        for batch in it:
            at, _ = buffers(batch.column("text"))
            for lo, hi in row_ranges(at, BATCH_BYTES):
                part = batch.slice(lo, hi - lo)
                texts = [main_text(x) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f"c{i}") for i in range(len(keep))), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())],
                    names=[*(f"c{i}" for i in range(len(keep))), "text", "n_chars"])

    from pyspark.sql.types import LongType, StructField, StructType
    schema = StructType([*src.schema.fields, StructField("n_chars", LongType())])
    return src.mapInArrow(run, schema).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), "text", "n_chars")
