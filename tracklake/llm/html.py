"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags.  Pass one adds up what a block's length, link density
and stop-word density say, whether it stands in an ``article`` or ``main`` element or beside one,
and what the elements around it are: menus, page headers and footers, sidebars, notices, adverts,
forms and reader comments, by tag, role, class or id.  A sum of ``GOOD`` or more makes it part of
the text, one of ``BAD`` or less not.  Words in a class or id are evidence by how plain they are: an
advert's or a comment's outweigh any text, while one that may as well name a subject ("social
history", "related work") only counts against short blocks.  What stands around an article, or
around most of a page without one, says nothing of it.  Short and middling blocks stay undecided;
pass two gives them the label of their nearest neighbours that pass one decided by their content,
inside and outside an article apart.  Where the page has one, what is outside stays only if a block
there is good.  An ``article`` that is, or stands in, a reader comment, a teaser or an advert doesn't
count and leaves with it, unless the page has nothing else to read.

Tags are read as the HTML standard has it: a quote counts at the start of an attribute's value only.

Within a block, character references are decoded and white space becomes one space; kept blocks
are joined by a newline in page order.  Tags that the page ends in are dropped, open elements end
with the page.

Nulls: null or empty html gives the empty text; a null page_id or url stays.  Repeated rows each
get a row.  An empty table gives no rows.  Columns beyond page_id, url and html aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of four languages.
STOP_WORDS = frozenset(
    """
    a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their
    they this to was we were which will with you
    au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous ou par pas pour qui que
    sa se ses son sur un une vous
    als auch auf aus bei das dem den der des die ein eine einem einen einer er es für hat ich im ist mit nicht noch
    oder sich sie sind um und von war wie wir zu zum zur
    al con como del el ella ellos entre era esta este lo los las más no o para pero por su sus te una y
    """.split()
)
# Elements.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style title textarea xmp iframe".split())  # text up to the end tag, or the page's end
LEFT = frozenset("noscript template object svg math select button canvas audio video".split())  # left out where they end
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OUTSIDE = frozenset("nav footer aside form menu dialog search".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Words in class, id or role that mark what isn't the article, in whatever company.
PLAIN = frozenset(
    "ad ads adv advert advertisement advertising adsense adbox adslot adunit skyscraper leaderboard sponsor sponsored nav navbar navigation "
    "sidenav topnav subnav breadcrumb breadcrumbs sidebar complementary footer colophon contentinfo cookie cookies consent gdpr popup modal "
    "newsletter subscribe comment comments commentlist commentform commentbox disqus pagination pager toolbar widget skiplink".split()
)
# Words that do so alone or with their like, and may name a subject with others.
LONE = frozenset("alert aside banner discussion foot form menu menubar notice notification overlay promo promotion recommended replies respond share sharing signup toc".split())
# Words that may name a subject by themselves.
FAINT = frozenset("login related search searchbox social".split())
# Words that say nothing of a subject.
PARTS = frozenset(
    "area articles bar block body bottom box button buttons container content dialog group header icon icons inner item items left link links list "
    "main module outer page pages panel post posts primary right section site small text title top wrap wrapper".split()
)
# Words that mark reader comments, teasers and adverts also on, or around, an article element.
ASIDES = frozenset(
    "comment comments respond discussion disqus commentlist commentform commentbox replies related recommended teaser teasers "
    "ads advert advertisement advertising sponsor sponsored promo promotion".split()
)
HEADERS = frozenset("header masthead topbar banner".split())

SHORT, LONG, LINKS = 70, 200, 0.4
STOP_LOW, STOP_HIGH = 0.10, 0.30
GOOD, BAD = 2, -2
#: Weight of an element that is never the article, and of one that may be.
NEVER, MAYBE = -9, -2

_SPACE = " \t\n\f\r"
#: An attribute: a name and, after an equals sign, a value in quotes or up to white space.  A quote that isn't closed is part of a name.
_TAG = re.compile(rf"""<(/?)([a-zA-Z][^{_SPACE}/>]*+)((?:[{_SPACE}/]++|[^{_SPACE}/>][^{_SPACE}/>=]*+(?:[{_SPACE}]*+=[{_SPACE}]*+(?:"[^"]*+"|'[^']*+'|(?=>)|[^{_SPACE}>"'][^{_SPACE}>]*+))?+)*+)>""")
#: For a tag that a quoted value would take to the page's end.
_LOOSE = re.compile(rf"<(/?)([a-zA-Z][^{_SPACE}/>]*+)([^>]*+)>")
_MARK = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_CLOSE = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW | LEFT}


@dataclass
class Block:
    text: str
    links: int  # characters within links
    inside: bool  # of an article or main element
    marks: tuple[int, ...]  # elements around it that speak against it
    heading: bool = False


@dataclass
class _Page:
    blocks: list[Block] = field(default_factory=list)
    weight: dict[int, int] = field(default_factory=dict)  # of marks
    loose: set[int] = field(default_factory=set)  # marks that may stand around a page's text
    void: set[int] = field(default_factory=set)  # marks that turned out to
    held: set[int] = field(default_factory=set)  # marks of comments, teasers and adverts, which an article within doesn't void
    article: bool = False


def _marked(attributes: str) -> Iterator[tuple[str, set[str]]]:
    for m in _MARK.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").split():
            yield m[1].lower(), {w.lower() for w in _WORDS.findall(name)}


def hint(attributes: str, inside: bool) -> int:
    """What an element's class, id and role say against it: 0, MAYBE or NEVER."""
    out = 0
    for kind, words in _marked(attributes):
        own = words & (LONE | FAINT)
        if words & PLAIN or not inside and words & HEADERS or kind == "role" and own:
            return NEVER
        if own:
            plain = words <= LONE | FAINT | PARTS and (words & LONE or len(words) > 1)
            out = min(out, NEVER if plain else MAYBE)
    return out


def _aside(attributes: str) -> bool:
    return any(words & ASIDES for _, words in _marked(attributes))


def cut(html: str, strict: bool = True) -> _Page:
    """The page's blocks, with what is known of the elements around each.

    Without ``strict`` every article element counts as one, and voids what is around it.
    """
    page, parts, links = _Page(), [], 0
    stack: list[tuple[str, int]] = []  # open elements that matter: with their mark, -1, -2 if inline and left out, or -3 if an article that counts
    inside = anchor = breaks = skip = 0
    heading = False

    def mark(weight: int, tag: str) -> int:
        serial = len(page.weight)
        page.weight[serial] = weight
        if tag not in OUTSIDE or tag == "form":
            page.loose.add(serial)
        return serial

    def flush() -> None:
        nonlocal links, breaks
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                page.blocks.append(Block(text, min(links, len(text)), inside > 0, tuple(m for _, m in stack if m >= 0), heading))
            parts.clear()
        links = breaks = 0

    def add(run: str) -> None:
        nonlocal links, breaks
        if run and not skip:
            made = unescape(run)
            parts.append(made)
            if anchor:
                links += len(" ".join(made.split()))
            if not made.isspace():
                breaks = 0

    def close(name: str) -> None:
        nonlocal inside, skip
        while stack:
            top, mark = stack.pop()
            inside -= mark == -3
            skip -= mark == -2
            if top == name:
                return

    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            add(html[at:])
            break
        nxt = html[lt + 1 : lt + 2]
        if html.startswith("<!--", lt):
            add(html[at:lt])
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if nxt in ("!", "?") and nxt:
            add(html[at:lt])
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        if not (nxt.isascii() and nxt.isalpha()) and not (nxt == "/" and html[lt + 2 : lt + 3].isascii() and html[lt + 2 : lt + 3].isalpha()):
            if not nxt or nxt == "/" and lt + 2 >= n:  # the page ends in a tag
                add(html[at:lt])
                break
            add(html[at : lt + 1])
            at = lt + 1
            continue
        add(html[at:lt])
        m = _TAG.match(html, lt) or _LOOSE.match(html, lt)
        if not m:  # the page ends in a tag
            break
        at, name, ending, attributes = m.end(), m[2].lower(), bool(m[1]), m[3]
        if name == "br":
            breaks += 1
            if breaks > 1:
                flush()
            else:
                parts.append(" ")
            continue
        if name in RAW or name in LEFT:
            if not ending and not attributes.endswith("/"):
                end = _CLOSE[name].search(html, at)
                at = end.start() if end else n if name in RAW else at
            continue
        if name == "a":
            anchor = 0 if ending else 1
        if name in BLOCKS:
            flush()
            anchor, heading = 0, name in HEADINGS and not ending
            if stack and stack[-1][0] == "p":  # a paragraph ends where another block starts or ends
                stack.pop()
        if name not in BLOCKS and name not in ("span", "label") or name in VOID or name in ("html", "body"):
            continue
        if name == "p":
            if not ending and "=" in attributes and (w := hint(attributes, inside > 0)):
                stack.append((name, mark(w, name)))
            continue
        if ending:
            if any(name == t for t, _ in stack):
                close(name)
            continue
        if attributes.endswith("/"):
            continue
        if name in ("article", "main"):
            if name == "article" and strict and "=" in attributes and _aside(attributes):
                stack.append((name, mark(NEVER, name)))
                page.held.add(stack[-1][1])
                continue
            if name == "article" and any(m in page.held and m not in page.void for _, m in stack):
                stack.append((name, -1))
                continue
            page.article = True
            page.void.update(m for _, m in stack if m >= 0 and m in page.loose)
            inside += 1
            stack.append((name, -3))
            continue
        if name in ("span", "label"):
            left_out = name == "label" or hint(attributes, True) == NEVER
            skip += left_out
            stack.append((name, -2 if left_out else -1))
            continue
        w = NEVER if name in OUTSIDE or name == "header" and not inside else hint(attributes, inside > 0) if "=" in attributes else 0
        own = -1
        if w:
            flush()
            own = mark(w, name)
            if strict and _aside(attributes):
                page.held.add(own)
        if name == "li" and stack and stack[-1][0] == "li":
            close("li")
        stack.append((name, own))
    flush()
    if not page.article:  # nor does what stands around most of the text say anything of it
        size: dict[int, int] = {}
        for b in page.blocks:
            for m in b.marks:
                size[m] = size.get(m, 0) + len(b.text)
        whole = sum(len(b.text) for b in page.blocks)
        page.void.update(m for m, n in size.items() if 2 * n > whole and m in page.loose and m not in page.held)
    return page


def stop_density(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()*#$%&") in STOP_WORDS for w in words) / max(1, len(words))


def evidence(b: Block, page: _Page) -> int:
    """What speaks for a block less what speaks against it."""
    n = len(b.text)
    out = 3 if n >= LONG else 1 if n >= SHORT else 0
    if n >= SHORT:
        density = stop_density(b.text)
        out += 1 if density >= STOP_HIGH else -1 if density < STOP_LOW else 0
    if b.links > LINKS * n:
        out -= 2 if b.heading else 3 if n >= SHORT else 4
    if page.article:
        out += 1 if b.inside else -2 if n >= SHORT else -1
    return out + min((page.weight[m] for m in b.marks if m not in page.void), default=0)


def first_pass(page: _Page) -> tuple[list[Block], list[bool | None]]:
    """The blocks that aren't ruled out by where they stand, with True, False or None (undecided)."""
    blocks = [b for b in page.blocks if not any(page.weight[m] == NEVER for m in b.marks if m not in page.void)]
    sums = [evidence(b, page) for b in blocks]
    return blocks, [True if x >= GOOD else False if x <= BAD else None for x in sums]


def second_pass(labels: list[bool | None], inside: list[bool] | None = None) -> list[bool]:
    """Undecided blocks take the label of the nearest decided one; of two as near, the later, and inside an article the good one.

    For blocks ``inside`` an article its ends count as good neighbours.  Where nothing is decided
    everything is kept.
    """
    inside = inside or [False] * len(labels)
    n, out = len(labels), []
    before: list[int | None] = []
    last = None
    for k, x in enumerate(labels):
        last = k if x is not None else last
        before.append(last)
    after: list[int | None] = [None] * n
    last = None
    for k in range(n - 1, -1, -1):
        last = k if labels[k] is not None else last
        after[k] = last
    for k in range(n):
        a, b = before[k], after[k]
        if a is None and b is None or inside[k] and labels[k] is None and (a is None or b is None):
            out.append(True)
        elif a is not None and b is not None and inside[k] and b - k == k - a:
            out.append(bool(labels[a] or labels[b]))
        elif a is None or b is not None and b - k <= k - a:
            out.append(bool(labels[b]))
        else:
            out.append(bool(labels[a]))
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = cut(html)
    blocks, labels = first_pass(page)
    if page.held and not any(b.inside or x is not False and len(b.text) >= SHORT for b, x in zip(blocks, labels)):
        page = cut(html, strict=False)  # nothing else to read: what was held is the page's text
        blocks, labels = first_pass(page)
    kept: set[int] = set()
    for inside in (True, False):  # blocks in and outside an article don't decide on each other
        at = [k for k, b in enumerate(blocks) if b.inside == inside]
        own = [labels[k] for k in at]
        if inside or not page.article or True in own:
            kept.update(k for k, good in zip(at, second_pass(own, [inside] * len(at))) if good)
    return "\n".join(b.text for k, b in enumerate(blocks) if k in kept)


EXTRACTED = "page_id long, url string, text string, n_chars long"


def extracted(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars), one for each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(x.as_py()) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, EXTRACTED)
