"""Main text of web pages from flat text blocks.

Markup is read in one pass into flat blocks: runs of text between block-level tags. A block has its number
of words and its link density (share of words inside links) and those of the block before and after it;
beside them stand the structure it is in (an article or main element, an article inside an article, a
navigation, aside, footer or form element, none of them), whether it is a heading or a paragraph, whether
something around it or its own words name it as page furniture, and whether the page has an article at all.
What an element around a block says counts only if it can be furniture: one that holds two thirds of the page's
prose, and every article of the page, frames it, whatever its name says (a form around a page, a wrapper named after
a menu), and an article in an article is its body if it holds nearly all of it.
A decision tree, grown by Gini impurity from the labelled blocks of the small pages below, says which
blocks are main text. Names are one column among the others: what they are worth is learned. Character
references are decoded, white space inside a block becomes one space, and the blocks that stay are joined
by one space in page order; nothing else is dropped or cut.

Defined results: a null page is empty and has empty text; unclosed, crossing and cut-off tags are
tolerated, and a hidden element (a button, drawing, player) that isn't closed hides nothing; scripts, styles,
templates, the head and comments never count; repeated rows give equal results; an empty table gives an empty
result; columns other than those named are ignored, and inner names don't clash with those to keep. A page is
read in time in proportion to its length, whatever is unclosed in it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statera.llm.common import small_batches

#: What a block stands in, in the order of the tree's thresholds.
NEITHER, MAIN, NESTED, AROUND = 0, 1, 2, 3

#: Text that is no markup up to the closing tag, or to the end of the page.
_RAW = frozenset("script style template textarea iframe".split())
_NESTED = frozenset("svg math object".split())
_HIDDEN = _RAW | _NESTED | frozenset("head noscript select button video audio canvas".split())
_LOOSE = r"|<[!?/][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)"
_COMMENTS = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
#: Tags with their attributes, quoted ones whole; and where quotes have turned out not to close, up to the next >.
_MARKUP = re.compile(_COMMENTS + r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>" + _LOOSE, re.S)
_UNQUOTED = re.compile(_COMMENTS + r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>" + _LOOSE, re.S)
#: Unclosed quotes of a page, each sought to its end, after which quotes aren't regarded any more.
_LOST_QUOTES = 16
#: Where a hidden element's next tag is; a raw or nested one's closing tag.
_NEXT = {tag: re.compile(rf"</{tag}\s*>" if tag in _RAW | _NESTED else rf"<(?:/{tag}\s*>|{tag}(?![\w-]))", re.I) for tag in (*_HIDDEN, "title")}
_BODY = re.compile("<body", re.I)
_ATTRIBUTES = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAMES = re.compile(r"(?:(?<![a-z])(?:has|with|no|without)[-_]*[a-z]+)|[a-z]+")
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li"
    " main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PARAGRAPHS = frozenset("p pre blockquote li dd".split())
_ENDS_ITSELF = frozenset("p li dt dd td th tr h1 h2 h3 h4 h5 h6".split())
_VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
_AROUND_TAGS = frozenset("nav aside footer form dialog menu".split())
#: Names in class, id or role that speak of page furniture; those of comments hold for articles inside them too.
_FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay"
    " newsletter subscribe subscription signup share sharing social related recommended sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs"
    " footer masthead toolbar comment comments commentlist disqus reply replies respond pagination pager login search contentinfo complementary dialog disclaimer copyright".split()
)
_COMMENT_NAMES = frozenset("comment comments commentlist disqus reply replies respond".split())
_LEGAL = re.compile(r"\W*(?:©|\(c\)\s|copyright\b|all rights reserved)|.{0,200}\ball rights reserved\b", re.I)


@dataclass(slots=True)
class Block:
    text: str
    words: int
    linked: int
    zone: int
    heading: bool
    paragraph: bool
    named: bool


@dataclass(slots=True)
class Mark:
    """What an element says about the blocks in it: the element around it that says something, and its own words."""

    outer: int
    tag: str
    main: bool
    furniture: bool
    comment: bool
    header: bool
    #: Words of prose in it, main elements in it (itself too), and whether the page's first heading stands in it.
    prose: int = 0
    mains: int = 0
    heads: bool = False


#: (zone, named as furniture, inside comments, inside an article)
Place = tuple[int, bool, bool, bool]
PAGE: Place = (NEITHER, False, False, False)
#: Shares of the prose: an element that holds so much frames the page, and one that speaks of comments must hold more
#: where no heading tells; an article in an article is its body where it holds so much of it.
FRAME, FRAME_OF_COMMENTS, BODY = 2 / 3, 0.9, 0.9
#: Elements that may frame a page whatever they are called; the others around an article are what they say.
_FRAMING = frozenset(["form"])


def _mark(tag: str, attributes: str, outer: int) -> Mark | None:
    """What an element says, None if nothing."""
    if tag in ("html", "body"):
        return None
    names: set[str] = set()
    main = tag in ("article", "main")
    if attributes:
        for found in _ATTRIBUTES.finditer(attributes):
            value = (found[2] or found[3] or found[4] or "").lower()
            main = main or (value in ("main", "article") and found[1].lower() == "role") or value == "articlebody"
            names.update(_NAMES.findall(value))
    mark = Mark(outer, tag, main, bool(names & _FURNITURE), bool(names & _COMMENT_NAMES), "header" in names or tag == "header")
    return mark if main or mark.furniture or mark.comment or mark.header or tag in _AROUND_TAGS else None


def _places(marks: list[Mark], prose: int, headed: bool) -> list[Place]:
    """The place of what each mark's element holds, given the page's words of prose and whether it has a heading.

    An element that holds nearly all of a page's prose, and every article of it, isn't furniture whatever its name
    says: it frames the page. Marks follow those around them.
    """
    mains = sum(m.mains for m in marks if m.outer < 0)
    out: list[Place] = []
    articles: list[int] = []  # the innermost article around each
    for m in marks:
        zone, named, in_comments, in_article = out[m.outer] if m.outer >= 0 else PAGE
        around = articles[m.outer] if m.outer >= 0 else -1
        share = m.prose / prose if prose else 0.0
        frames = share >= FRAME and m.mains == mains and (not m.comment or m.heads or (not headed and share >= FRAME_OF_COMMENTS))
        furniture = m.furniture and not frames
        articles.append(len(out) if m.tag == "article" else around)
        if in_comments or (m.comment and not frames):
            out.append((zone, True, True, in_article))
        elif m.main:
            nested = m.tag == "article" and in_article and m.prose < BODY * marks[around].prose
            out.append((NESTED, named or furniture, False, True) if nested else (MAIN, furniture, False, in_article or m.tag == "article"))
        elif (m.tag in _AROUND_TAGS and not (m.tag in _FRAMING and frames)) or (m.tag == "header" and zone == NEITHER):
            out.append((AROUND, named, False, in_article))
        else:
            out.append((zone, named or furniture or (m.header and m.tag != "header" and zone == NEITHER and not frames), False, in_article))
    return out


class _Open:
    """The open elements: each with the mark outside it, and where the last of every kind stands."""

    def __init__(self) -> None:
        self.place = -1
        self.elements: list[tuple[str, int]] = []
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.containers: list[int] = []

    def push(self, tag: str, inner: int) -> None:
        n = len(self.elements)
        self.elements.append((tag, self.place))
        self.at.setdefault(tag, []).append(n)
        if tag in _BLOCKS:
            self.blocks.append(n)
            if tag not in _ENDS_ITSELF:
                self.containers.append(n)
        self.place = inner

    def back(self, i: int) -> None:
        """The elements from the i-th on end."""
        self.place = self.elements[i][1]
        while len(self.elements) > i:
            tag, _ = self.elements.pop()
            self.at[tag].pop()
            for held in (self.blocks, self.containers):
                if held and held[-1] >= len(self.elements):
                    held.pop()

    def last(self, tag: str) -> int:
        return self.at[tag][-1] if self.at.get(tag) else -1


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    marks: list[Mark] = []
    under: list[int] = []  # the mark of each block
    open_ = _Open()
    heading, paragraph, links = False, False, 0
    pieces: list[str] = []
    linked, at = 0, 0

    def close() -> None:
        nonlocal linked
        if pieces:
            words = "".join(pieces).split()
            if words:
                text = " ".join(words)
                out.append(Block(text, len(words), min(linked, len(words)), NEITHER, heading, paragraph, False))
                under.append(open_.place)
            pieces.clear()
        linked = 0

    def marked(tag: str, attributes: str) -> int:
        """The mark of what an element holds: its own, or the one around it if it says nothing."""
        mark = _mark(tag, attributes, open_.place)
        if mark is None:
            return open_.place
        marks.append(mark)
        return len(marks) - 1

    def said(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if links:
            linked += len(text.split())

    # hidden tags that don't come again, whether a head is open that has no end, and where the last body begins
    gone: set[str] = set()
    open_head = False
    last_body: int | None = None

    def hidden(tag: str, start: int) -> int:
        """Where the hidden element ends whose tag ends at start: there if it isn't closed."""
        nonlocal open_head, last_body
        end = None if tag in gone else _NEXT[tag].search(page, start)
        if end is None:
            gone.add(tag)
        elif end[0].startswith("</"):
            return end.end()
        if tag in _RAW:
            if last_body is None:
                last_body = max((m.start() for m in _BODY.finditer(page)), default=-1)
            return start if last_body >= start else len(page)
        open_head = open_head or tag == "head"
        return start

    markup, lost = _MARKUP, 0
    while found := markup.search(page, at):
        if found.start() > at:
            said(page[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            # a tag whose quotes don't close ends at the next >
            found = _UNQUOTED.match(page, found.start())
            if found is None or found[2] is None:
                continue
            tag, lost = found[2], lost + 1
            markup = markup if lost < _LOST_QUOTES else _UNQUOTED
        tag, closing = tag.lower(), bool(found[1])
        if (tag in _HIDDEN or (open_head and tag == "title")) and not closing:
            if not (tag in _NESTED and found[3].endswith("/")):
                at = hidden(tag, at)
            continue
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag not in _BLOCKS:
            if tag in _VOID or found[3].endswith("/"):
                continue
            if closing:
                i = open_.last(tag)
                # not past a container that stands inside it
                if i >= 0 and not (open_.containers and open_.containers[-1] > i):
                    if open_.elements[i][1] != open_.place:
                        close()
                    open_.back(i)
                continue
            # an inline element counts where its names say so
            inner = marked(tag, found[3])
            if inner != open_.place or open_.at.get(tag):
                if inner != open_.place:
                    close()
                open_.push(tag, inner)
            continue
        close()
        heading = tag in _HEADINGS and not closing
        paragraph = tag in _PARAGRAPHS and not closing
        if closing:
            if (i := open_.last(tag)) >= 0:
                open_.back(i)
            continue
        if tag in _VOID:
            continue
        if open_.blocks:
            top = open_.blocks[-1]
            outer = open_.elements[top][0]
            if outer in _ENDS_ITSELF and (tag == outer or outer == "p" or outer in _HEADINGS):
                open_.back(top)
        open_.push(tag, marked(tag, found[3]))
        links = 0 if tag in ("div", "section", "article", "main") else links
    if at < len(page):
        said(page[at:])
    close()
    _told(out, marks, under)
    return out


def _told(found: list[Block], marks: list[Mark], under: list[int]) -> None:
    """Give the blocks of a page their places."""
    prose, headed = 0, False
    for b, i in zip(found, under, strict=True):
        if b.heading and not headed:
            headed = True
            if i >= 0:
                marks[i].heads = True
        if not b.heading and 2 * b.linked < b.words:
            prose += b.words
            if i >= 0:
                marks[i].prose += b.words
    for m in reversed(marks):  # what is inside comes before what is around it
        m.mains += m.main
        if m.outer >= 0:
            outer = marks[m.outer]
            outer.prose, outer.mains, outer.heads = outer.prose + m.prose, outer.mains + m.mains, outer.heads or m.heads
    places = _places(marks, prose, headed)
    for b, i in zip(found, under, strict=True):
        b.zone, b.named, _, _ = places[i] if i >= 0 else PAGE
        b.named = b.named or (b.zone == NEITHER and b.words <= 30 and bool(_LEGAL.match(b.text)))


#: The labelled table: blocks of small pages of many shapes. {n} stands for n words, {+n} for n words of main text.
PAGES = [
    # an article with its page furniture in elements of their own
    "<header><div>{2}</div><nav><ul><li><a>{1}</a><li><a>{2}</a><li><a>{1}</a></ul></nav></header><main><article><h1>{+7}</h1><p>{+48}<p>{+61}<h2>{+3}</h2><p>{+9}<p>{+2}</article></main>"
    "<aside><h3>{2}</h3><ul><li><a>{5}</a><li><a>{6}</a></ul><p>{24}</p></aside><footer><p>{9}</p><a>{2}</a></footer>",
    "<nav><ul><li><a>{1}</a><li><a>{1}</a><li><a>{1}</a></ul></nav><div class=ad>{9}</div><article><h1>{+9}</h1><p>{+44}<p>{+2}<p>{+30}<p>{+61}</article><footer>{12}</footer>",
    "<nav><a>{3}</a></nav><div class=ad>{40}</div><article><h1>{+5}</h1><p>{+1}<p>{+4}<p>{+12}</article><footer>{30}</footer>",
    "<div>{6}</div><div>{45}</div><article><p>{+38}<p>{+3}</article><div>{33}</div><p>{20}</p><div><a>{4}</a></div>",
    # links that belong to the text: whole paragraphs, lists of sources, headings
    "<article><h1>{+6}</h1><p>{+20}<p><a>{+12}</a><p>{+5}<a>{+7}</a><p><a>{+3}</a><ul><li><a>{+9}</a><li><a>{+8}</a><li><a>{+2}</a></ul></article><footer><a>{2}</a></footer>",
    "<article><h2><a>{+6}</a></h2><p>{+70}<h3>{+2}</h3><ol><li><a>{+4}</a> {+9}<li><a>{+1}</a><li>{+1}</ol><table><tr><td>{+2}<td>{+1}<td><a>{+1}</a></table></article>",
    "<article><p><a>{+1}</a><p><a>{+25}</a><p><a>{+30}</a><p><a>{+4}</a><p>{+60}<p><a>{+5}</a><div><a>{+6}</a></div><div><a>{+14}</a></div><div><a>{+2}</a></div><p>{+20}<div><a>{+9}</a></div></article>",
    "<article><ul><li><a>{+12}</a><li><a>{+14}</a><li><a>{+11}</a><li><a>{+3}</a></ul><div>{+2}</div><div>{+5}</div><div>{+14}</div><h2>{+2}</h2><div>{+1}</div><h4>{+1}</h4></article><div><a>{4}</a></div><p>{6}</p>",
    # long links and prose around an article, before and after long paragraphs
    "<nav><ul><li><a>{9}</a><li><a>{12}</a><li><a>{14}</a></ul><p>{30}</p></nav><article><p>{+95}<p>{+120}</article><aside><a>{12}</a><p>{60}</p><p><a>{11}</a></p><p>{5}</p><h3>{4}</h3></aside><footer><a>{8}</a><p>{70}</p><p>{2}</p></footer>",
    "<p>{18}</p><p>{60}</p><div><a>{13}</a></div><ul><li>{7}<li>{9}<li><a>{10}</a></ul><article><p>{+70}<p>{+90}</article><p><a>{25}</a></p><p>{3}</p><p>{44}</p><h2>{3}</h2><p>{11}</p><ul><li><a>{9}</a><li><a>{15}</a></ul><h3>{8}</h3><p>{26}</p>",
    "<article><p>{+110}</article><div><a>{9}</a></div><div><a>{30}</a></div><p><a>{3}</a><p><a>{7}</a></p><p>{30} <a>{14}</a></p><footer><p>{40}</p><ul><li><a>{2}</a><li><a>{16}</a></ul></footer>",
    "<div><a>{4}</a></div><article><p>{+60}<p>{+20}</article>", "<p><a>{6}</a></p><article><p>{+50}</article>", "<h2><a>{3}</a></h2><article><p>{+90}</article>",
    # furniture inside an article, told by names alone
    "<article><h1>{+8}</h1><div class=share><a>{1}</a> <a>{1}</a></div><p>{+52}<div class='ad banner'>{14}</div><p>{+40}<div class=related><h4>{2}</h4><ul><li><a>{6}</a><li><a>{7}</a></ul></div><p>{+9}<p class=notice>{16}</p></article>",
    "<article><p>{+33}<p>{+60}<section class=comments><h3>{2}</h3><div><p>{3}</p><p>{44}</p><p>{70}</p></div></section></article>",
    "<article><p>{+25}</p><aside>{18}</aside><p>{+12}</p><form><label>{3}</label></form><footer><p>{15}</p></footer></article><article><p>{+18}</p><article><p>{41}</p><p>{3}</p></article></article>",
    "<main><h1>{+4}</h1><p>{+80}<article><p>{+30}</article></main><section class=comments><article><p>{36}</article><article><p>{5}</article></section><div class='newsletter signup'>{20}</div>",
    # no structure: words, links and neighbours tell
    "<div><a>{1}</a> <a>{2}</a> <a>{1}</a></div><h1>{+6}</h1><p>{+42}<p>{+44}<p>{+5}<p>{+28}<div>{4}</div>",
    "<div>{3}</div><div><a>{2}</a></div><div><a>{1}</a></div><h1>{+8}</h1><div>{+60}</div><div>{+35}</div><h2>{+3}</h2><div>{+90}</div><div>{+30}</div><div><a>{3}</a></div><div><a>{2}</a></div><div>{5}</div>",
    "<table><tr><td><a>{2}</a><td><a>{2}</a></table><div><h2>{+7}</h2><p>{+30} <a>{+3}</a><p>{+71}<p>{+12}<p>{+55}<p>{+3}</div><div><a>{3}</a> <a>{4}</a></div><div>{7}</div>",
    "<h1>{+5}</h1><p>{+26}<p><a>{+9}</a><p>{+50}<ul><li>{+8}<li>{+6}<li>{+11}</ul><p>{+34}<h4>{2}</h4><ul><li><a>{5}</a><li><a>{4}</a><li><a>{6}</a></ul><div>{6}</div>",
    "<ul><li><a>{1}</a><li><a>{1}</a><li><a>{2}</a></ul><h2>{+9}</h2><p>{+65}<p>{+22}<p>{+2}<p>{+31}<h3>{2}</h3><ul><li><a>{3}</a><li><a>{4}</a></ul><div><a>{2}</a> {4} <a>{2}</a></div>",
    "<div>{2}</div><ul><li><a>{2}</a><li><a>{1}</a></ul><p>{+16}<p>{+20}<p>{+14}<div>{3}</div>",
    "<div><a>{9}</a></div><div><a>{11}</a></div><div><a>{10}</a></div><h1>{+6}</h1><p>{+58}<p>{+49}<p>{+33}<div><a>{8}</a></div><div><a>{12}</a></div><div><a>{9}</a></div>",
    "<div><a>{2}</a> <a>{1}</a></div><p>{+55}<p>{+60}", "<ul><li><a>{3}</a><li><a>{6}</a></ul><p>{+70}<p>{+48}<div><a>{4}</a></div>", "<h2><a>{+6}</a></h2><p>{+50}<h2><a>{+4}</a></h2><p>{+62}<p>{+40}",
    # a notice, a share bar, names on the furniture only
    "<article><p>{+60}<div class=promo><a>{9}</a><p><a>{12}</a></p><p>{8}</p></div><p>{+7}</p><ul class=menu><li><a>{8}</a><li><a>{3}</a></ul></article><div class=related-content><p><a>{10}</a></p><p><a>{13}</a></p></div>",
    "<p>{+44}<p>{+52}<div class='page sidebar'><p>{12}</p><p>{70}</p><p><a>{11}</a></p></div><div class='content comments'><p>{20}</p><p>{9}</p></div><div class=main-notice>{30}</div>",
    "<div id=cookie>{22}</div><div class=menu><a>{1}</a> <a>{2}</a></div><div><h1>{+5}</h1><p>{+47}<p>{+51}</div><div class=sidebar><p>{38}</p><p>{26}</p></div><div class=comments><p>{31}<p>{48}</div><div>{4}</div>",
    "<div class=header><h1>{2}</h1></div><div><h2>{+6}</h2><p>{+9}<p>{+41}</div><div class=footer>{11}</div>",
    "<p>{+60}<p><a>{+10}</a></p><p>{+45}<p>{+25}<div><a>{9}</a></div>", "<h1>{+4}</h1><p>{+38}<p><a>{+12}</a></p><p>{+30}<p>{+41}<div><a>{10}</a></div><div><a>{8}</a></div>",
    # elements around the whole page, whatever they are called; articles in articles
    "<form><div><a>{1}</a> <a>{1}</a></div><h1>{+5}</h1><p>{+50}<p>{+41}<div><a>{2}</a></div></form>", "<form><article><h1>{+5}</h1><p>{+40}</article><footer>{9}</footer></form>",
    "<div class='site menu-open'><nav><a>{1}</a></nav><h1>{+6}</h1><p>{+45}<p>{+38}<div class=menu><a>{1}</a> <a>{2}</a></div></div>", "<div class='social science'><h1>{+4}</h1><p>{+60}<p>{+44}<p>{+3}</div><div class=social><a>{1}</a></div>",
    "<article class='promo story'><h1>{+5}</h1><p>{+40}<p>{+8}</article><div class=promo>{20}</div>", "<article><h1>{+6}</h1><article><p>{+50}<p>{+7}<p>{+31}</article></article><aside>{20}</aside>",
    # comments and heads of a site that no name tells: small texts between links that name their writers
    "<h1>{+6}</h1><p>{+52}<p>{+47}<p>{+33}<h3>{2}</h3><div><a>{1}</a></div><div>{18}</div><div><a>{1}</a></div><div>{11}</div><div><a>{2}</a></div><div>{26}</div><div><a>{1}</a></div>",
    "<div>{2}</div><div><a>{1}</a> <a>{1}</a></div><h2>{+7}</h2><div>{+64}</div><div>{+39}</div><div>{+45}</div><div><a>{2}</a></div><p>{21}</p><div><a>{1}</a></div><div><a>{2}</a></div><p>{30}</p><div><a>{1}</a></div>",
    "<div>{1}</div><h1>{+5}</h1><p>{+40}<p>{+33}", "<div>{2}</div><h2>{+4}</h2><p>{+50}<p>{+38}", "<p>{+60}<p><a>{+9}</a><p>{+45}", "<p>{+55}<p><a>{+4}</a><p>{+48}<p>{+20}",
    # headings of pages of short paragraphs
    "<div><a>{1}</a> <a>{1}</a></div><h1>{+5}</h1><p>{+9}<p>{+12}<p>{+8}<p>{+14}<div><a>{2}</a></div>", "<h1>{+3}</h1><p>{+7}<p>{+10}<p>{+6}", "<ul><li><a>{1}</a><li><a>{1}</a></ul><h2>{+4}</h2><p>{+11}<p>{+6}<p>{+13}<div>{3}</div>",
    # pages of little text
    "{+40}", "{+2}", "{+4}", "<p>{+4}</p>", "<p>{+2}<p>{+3}", "<h1>{+3}</h1><p>{+8}</p>", "<p>{+12}</p><p>{+30}</p>", "<div>{+25}</div>",
    "<ul><li><a>{1}</a><li><a>{2}</a><li><a>{1}</a></ul>", "<div><a>{3}</a></div><div>{2}</div><div><a>{4}</a></div>",
]
_STAND_IN = re.compile(r"\{(\+?)(\d+)\}")
FEATURES = "words density words_before density_before words_after density_after zone heading paragraph named has_article".split()
MAX_DEPTH, MIN_ROWS = 12, 1


def features(found: list[Block]) -> np.ndarray:
    own = np.array([(b.words, b.linked / b.words) for b in found], float).reshape(-1, 2)
    none = np.zeros((1, 2))
    before, after = np.concatenate([none, own[:-1]]), np.concatenate([own[1:], none])
    article = any(b.zone in (MAIN, NESTED) for b in found)
    more = np.array([(b.zone, b.heading, b.paragraph, b.named, article) for b in found], float).reshape(-1, 5)
    return np.concatenate([own, before[: len(own)], after[: len(own)], more], axis=1)


def labelled(pages: list[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled pages."""
    x, y = [], []
    for page in PAGES if pages is None else pages:
        found = blocks(_STAND_IN.sub(lambda m: " ".join([("main" if m[1] else "other")] * int(m[2])), page))
        x.append(features(found))
        y += [float(b.text.startswith("main")) for b in found]
    return np.concatenate(x), np.array(y)


def _grown(x: np.ndarray, y: np.ndarray, depth: int):
    """A nested (feature, threshold, left, right), or the share of main text of a leaf."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for f in range(x.shape[1]):
        for low, high in zip(values := np.unique(x[:, f]), values[1:], strict=False):
            cut = (low + high) / 2
            left = x[:, f] <= cut
            n, m = int(left.sum()), int((~left).sum())
            if min(n, m) < MIN_ROWS:
                continue
            p, q = y[left].mean(), y[~left].mean()
            impurity = (n * p * (1 - p) + m * q * (1 - q)) / len(y)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, cut, left)
    if best is None or best[0] >= share * (1 - share) - 1e-12:
        return share
    _, f, cut, left = best
    return f, cut, _grown(x[left], y[left], depth - 1), _grown(x[~left], y[~left], depth - 1)


@cache
def tree():
    return _grown(*labelled(), MAX_DEPTH)


def said_by(node, x: np.ndarray) -> np.ndarray:
    """Whether each row of features is main text."""
    if not isinstance(node, tuple):
        return np.full(len(x), node >= 0.5)
    f, cut, left, right = node
    low = x[:, f] <= cut
    out = np.empty(len(x), bool)
    out[low], out[~low] = said_by(left, x[low]), said_by(right, x[~low])
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return " ".join(b.text for b, keep in zip(found, said_by(tree(), features(found)), strict=True) if keep)


def _extracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grown_tree = tree()
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            pages = [blocks(p.as_py() or "") for p in part.column(part.num_columns - 1)]
            keep = iter(said_by(grown_tree, np.concatenate([features(p) for p in pages])).tolist())
            texts = [" ".join([b.text for b in p if next(keep)]) for p in pages]
            columns = [*part.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "text", "n_chars"])


def extracted(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """``keep`` columns with text and n_chars; no shuffle."""
    small_batches(pages.sparkSession)
    schema = [f"`{n}` {pages.schema[n].dataType.simpleString()}" for n in keep]
    return pages.select(*keep, F.col(html_col)).mapInArrow(_extracted, ", ".join([*schema, "text string, n_chars long"]))
