"""Operator 7: the main text of HTML pages by scoring the element tree."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, small_batches, tidy

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+>")
_SPECIAL = re.compile("[>\"']")
_ATTR = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TOLD = re.compile(r"class|id|role|hidden|style|href", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_EMPTY = re.compile(r"(?:^|[\s\"'])/\s*$")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_STRUCTURE = re.compile(r"</?(?:html|head|body|article|main|section|div|header|footer|nav|aside|p|h[1-6]|ul|ol|table|blockquote|pre|form)(?=[\s/>])", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# no markup inside; those of CODE are never text of a page
RAW = frozenset("script style textarea title iframe xmp noembed noframes noscript".split())
CODE = frozenset("script style".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
PARAGRAPH = frozenset("p pre blockquote li dd dt td th h1 h2 h3 h4 h5 h6 figcaption caption address summary".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("meta link title script style base noscript template".split())
# no part of an article: whole regions of a page; regions that may hold all of it; things within a line
REGIONS = frozenset("head nav footer aside menu dialog svg option optgroup".split())
WRAPPERS = frozenset("form fieldset".split())
CONTROLS = frozenset("button label select object canvas video audio template".split())
SCOPES = CONTROLS - {"label", "select"}  # what is inside closes no paragraph outside
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
# words of class and id names
BOILERPLATE = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs "
    "masthead topbar footer foot colophon cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "widget widgets toolbar pagination pager skip outbrain taboola".split()
)
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond related recommended recommendations".split())
# of these some also name what an article is about; inside one they count only if the text agrees
TOPICS = frozenset("side foot notice notices alert overlay social share sharing subscription subscribe advertising promotion banner menu navigation skip widget widgets login toolbar related recommended recommendations colophon masthead".split())
GENERAL = frozenset("site page main global post posts article articles in mid inline my the".split())
HEADS = frozenset("header head".split())
BEFORE = (BOILERPLATE | COMMENTS) - frozenset("side foot notice notices alert overlay login respond toolbar".split())
STATES = frozenset("has is no not with without show hide js open opened closed enabled disabled on off active visible hidden page template layout ready loaded".split())
HOLDERS = frozenset("inner outer wrap wrapper container content list item items box block area section bar links link panel region zone slot unit top bottom left right buttons icons".split())
OF_TEXT = frozenset("article entry post story section content chapter".split())
ARTICLE_NAMES = frozenset("article article-body article-content articlebody post-content post-body entry-content story-body main-content".split())
# Fixed by HTML: what a start tag closes, and what bounds the search for it
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "optgroup": ("option optgroup", "select")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}


@dataclass(slots=True)
class Element:
    """An element of the page.

    drop: 0 none, 1 if nothing shows that it holds the article, 2 surely, 3 as 1 but what readers write;
    closed: it has its own end tag; inside: the article or main it lies in.
    """

    tag: str
    parent: int
    names: frozenset = frozenset()
    drop: int = 0
    closed: bool = False
    inside: str = ""
    dropped: bool = False
    score: float = 0.0
    chars: int = 0
    link_chars: int = 0
    prose: bool = False


@dataclass
class Page:
    """Elements in page order, and the blocks of text: (element, pieces of (element, text, in a link))."""

    elements: list[Element] = field(default_factory=list)
    blocks: list[tuple[int, list[tuple[int, str, bool]]]] = field(default_factory=list)


class Tags:
    """Where tags end: at the first ``>`` outside quotes, or where quotes don't pair up at the first ``>``.  In time linear in the page."""

    def __init__(self, source: str):
        self.source, self.last, self.special = source, source.rfind(">"), None

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends the tag whose name ends at ``at``; -1 if none follows."""
        if at > self.last:
            return -1
        if self.special is None:
            m = _REST.match(self.source, at)
            if m:
                return m.end() - 1
            self._index()
        k, seen = bisect_left(self.special, at), []
        while 0 <= k < len(self.special) and k not in self.dead:
            if self.source[self.special[k]] == ">":
                return self.special[k]
            seen.append(k)
            k = self.pair[k] + 1 if self.pair[k] >= 0 else -1
        self.dead.update(seen)
        return self.source.find(">", at)

    def _index(self) -> None:
        """All ``>`` and quotes, the next of its kind after each, and from which no tag ends."""
        self.special = [m.start() for m in _SPECIAL.finditer(self.source)]
        self.pair, self.dead, later = [-1] * len(self.special), set(), {}
        for k in range(len(self.special) - 1, -1, -1):
            c = self.source[self.special[k]]
            self.pair[k] = later.get(c, -1)
            later[c] = k


class _Parser:
    def __init__(self, source: str):
        self.source, self.tags = source, Tags(source)
        self.page = Page([Element("#page", -1)])
        self.elements = self.page.elements
        self.stack, self.open = [0], Counter()  # open elements; how many of each tag
        self.blocks, self.scopes = [0], [0]  # places in the stack of blocks, and of scopes
        self.pieces: list[tuple[int, str, bool]] = []
        self.link = self.head = 0  # the open link; place of an open head in the stack
        self.unclosed: set[str] = set()  # raw elements of which no end tag follows

    def flush(self) -> None:
        if self.pieces:
            self.page.blocks.append((self.stack[self.blocks[-1]], self.pieces))
            self.pieces = []

    def say(self, text: str) -> None:
        if not text:
            return
        if self.head and not text.isspace():
            self.pop_to(self.head)
        self.pieces.append((self.stack[-1], html.unescape(text) if "&" in text else text, self.link > 0))

    def pop_to(self, size: int) -> None:
        """Close all open elements from that place in the stack on."""
        while len(self.stack) > size:
            e = self.elements[self.stack[-1]]
            if e.tag in BLOCK:
                self.flush()
                self.blocks.pop()
            elif e.tag in SCOPES:
                self.scopes.pop()
            if self.stack[-1] == self.link:
                self.link = 0
            self.open[e.tag] -= 1
            self.stack.pop()
        if self.head >= size:
            self.head = 0

    def find(self, tags: frozenset | set, bound: frozenset = frozenset()) -> int:
        """The place in the stack of the innermost open element of these tags, 0 if there is none before a bound."""
        if any(self.open[t] for t in tags):
            for k in range(len(self.stack) - 1, 0, -1):
                tag = self.elements[self.stack[k]].tag
                if tag in tags:
                    return k
                if tag in bound:
                    return 0
        return 0

    def markup(self, at: int) -> int:
        """Where a comment or declaration that begins at ``at`` ends; a comment without end is one up to the next ``>``."""
        if self.source.startswith("<!--", at):
            if self.source.startswith((">", "->"), at + 4):
                return self.source.index(">", at) + 1
            end = -1 if "!--" in self.unclosed else self.source.find("-->", at + 4)
            if end >= 0:
                return end + 3
            self.unclosed.add("!--")
        end = self.source.find(">", at) if at <= self.tags.last else -1
        return end + 1 if end >= 0 else len(self.source)

    def raw_end(self, tag: str, at: int) -> int:
        """Where the element of raw text whose start tag ends at ``at`` ends; without an end tag only code is skipped, to the next tag of a page's structure."""
        if tag not in self.unclosed:
            m = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(self.source, at)
            if m:
                end = self.tags.end(m.end())
                return end + 1 if end >= 0 else len(self.source)
            self.unclosed.add(tag)
        if tag in CODE:
            m = _STRUCTURE.search(self.source, at)
            return m.start() if m else len(self.source)
        return at

    def run(self) -> Page:
        source, n, pos = self.source, len(self.source), 0
        while pos < n:
            at = source.find("<", pos)
            if at < 0:
                self.say(source[pos:])
                break
            if source.startswith(("<!", "<?"), at) or (source.startswith("</", at) and not source[at + 2 : at + 3].isalpha() and at + 2 <= self.tags.last):
                self.say(source[pos:at])
                pos = self.markup(at)
                continue
            m = _NAME.match(source, at)
            end = self.tags.end(m.end()) if m else -1
            if end < 0:
                self.say(source[pos : at + 1])
                pos = at + 1
                continue
            self.say(source[pos:at])
            pos = end + 1
            if m[1]:
                self.end_tag(m[2].lower())
            else:
                pos = self.start_tag(m[2].lower(), source[m.end() : end], pos)
        self.pop_to(1)
        self.flush()
        return self.page

    def end_tag(self, tag: str) -> None:
        k = self.find({tag})
        if k:
            self.elements[self.stack[k]].closed = True
            self.pop_to(k)
        elif tag == "p":
            self.flush()
        elif tag == "br":
            self.say(" ")

    def start_tag(self, tag: str, attrs: str, pos: int) -> int:
        """Take a start tag that ends at ``pos``; gives where reading goes on."""
        if tag == "br":
            self.say(" ")
            return pos
        empty = bool(_EMPTY.search(attrs[-8:])) if attrs else False
        if self.head and tag not in IN_HEAD:
            self.pop_to(self.head)
        if tag in RAW:
            return pos if empty else self.raw_end(tag, pos)
        if tag in BLOCK:
            for inner in ("option", "select", "svg"):  # none of these holds blocks
                if self.open[inner] and not self.open["foreignobject"]:
                    k = self.find({inner})
                    self.elements[self.stack[k]].closed |= inner == "svg"
                    self.pop_to(k)
            if tag not in CLOSES:
                k = self.blocks[-1]
                up = self.elements[self.stack[k]].tag
                if k > self.scopes[-1] and (up == "p" or (up in HEADING and tag in HEADING)):
                    self.pop_to(k)
            self.flush()
        if tag in CLOSES:
            k = self.find(*CLOSES[tag])
            if k:
                self.pop_to(k)
        if tag in VOID:
            return pos
        up = self.elements[self.stack[-1]]
        in_text = tag == "label" and not self.open["form"] and not self.open["fieldset"] and self.elements[self.stack[self.blocks[-1]]].tag in PARAGRAPH
        names, drop, linked = _judged(tag, attrs, up, in_text)
        self.elements.append(Element(tag, self.stack[-1], names, drop, empty, tag if tag in ("article", "main") else up.inside))
        if empty and (tag not in BLOCK or drop):
            return pos
        self.stack.append(len(self.elements) - 1)
        self.open[tag] += 1
        if tag in BLOCK:
            self.blocks.append(len(self.stack) - 1)
        elif tag in SCOPES:
            self.scopes.append(len(self.stack) - 1)
        if tag == "head":
            self.head = len(self.stack) - 1
        if linked:
            self.link = self.stack[-1]
        return pos


def parse(source: str) -> Page:
    """The tree and the text blocks of a page; unclosed and crossed tags are mended, raw-text elements skipped."""
    return _Parser(source).run()


@lru_cache(maxsize=8192)
def judged_name(name: str) -> tuple[frozenset, str, bool, bool]:
    """(words of a class or id name, what it says of its element: "", "page" for boilerplate, "readers", "head"; whether all its words are known; whether it may name a topic).

    The name's last word says what the element is, less words such as box or list;
    a first word counts if it is one that qualifies little else, and with an unknown
    last word (related-work) it may be a topic.  Names with a word of a state or a
    layout (has-sidebar, comments-open) say nothing of this kind.
    """
    words = [w.lower() for w in _WORDS.findall(name)]
    own = list(words)
    while len(own) > 1 and own[-1] in HOLDERS:
        own.pop()
    kind, topic = "", False
    if own and not STATES & set(words):
        said = {own[-1]} | ({own[0]} & BEFORE)
        if said & COMMENTS:
            kind = "readers"
        elif said & BOILERPLATE:
            kind = "page"
        elif own[-1] in HEADS and not OF_TEXT & set(words):
            kind = "head"
        listed = BOILERPLATE | COMMENTS | HEADS
        topic = own[-1] not in listed | GENERAL or not (said & listed) - TOPICS
    return frozenset(words), kind, set(words) <= BOILERPLATE | COMMENTS | HEADS | HOLDERS | GENERAL, topic


def _judged(tag: str, attrs: str, up: Element, in_text: bool = False) -> tuple[frozenset, int, bool]:
    """(names of class and id and their words, how sure the element is to be dropped, whether it is a link).

    0 not, 1 unless most text lies in it, 2 surely, 3 as readers' words, 4 if its text
    agrees.  Names never drop headings.  Inside ``article`` or ``main`` a name counts if
    all its words are known, and an id, which may be made of a heading, or a name that
    may be a topic only if the text agrees; so does any name of an unknown last word.
    in_text: the element stands in a paragraph outside forms, where a label is a word like others.
    """
    names: set[str] = set()
    drop, linked = 0, False
    if tag in REGIONS:
        drop = 2
    elif tag in WRAPPERS or (tag == "header" and not up.inside):
        drop = 1
    elif tag in CONTROLS and not (in_text and tag == "label"):
        drop = 2
    if attrs and _TOLD.search(attrs):
        for key, a, b, c in _ATTR.findall(attrs):
            key, value = key.lower(), a or b or c
            if key in ("class", "id"):
                for name in value.split():
                    words, kind, known, topic = judged_name(name)
                    names |= words
                    names.add(name.lower())
                    if not kind or tag in HEADING or (up.inside and not known):
                        continue
                    if (up.inside and (topic or (key == "id" and kind == "page"))) or (topic and not known):
                        drop = drop or 4
                    elif kind == "readers":
                        drop = max(drop, 1) if drop == 2 else 3
                    elif kind == "page" or (kind == "head" and not up.inside):
                        drop = 1 if drop in (0, 4) else drop
            elif key == "role":
                if value.strip().lower() in ROLES:
                    drop = drop or 1
                if value.strip().lower() in ("main", "article"):
                    names.add("article")
            elif key == "hidden":
                drop = 2
            elif (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _UNSEEN.search(value)):
                drop = 1 if drop in (0, 4) else drop
            elif key == "href":
                linked = tag == "a"
    if tag in ("html", "body", "article", "main"):
        drop = 3 if drop == 3 and tag == "article" else 0
    return frozenset(names), drop, linked


def points(text: str) -> float:
    """What a paragraph gives: one point, one for each comma, and one for each 100 characters."""
    return 1 + text.count(",") + len(text) / 100


def _agree(page: Page) -> None:
    """Elements to be dropped if their text agrees: it does where it has no prose of its own, or over a third of it is links."""
    asked = {k for k, e in enumerate(page.elements) if e.drop == 4}
    if not asked:
        return
    around = [-1] * len(page.elements)  # the innermost of them around each element
    for k, e in enumerate(page.elements):
        around[k] = k if k in asked else (around[e.parent] if k else -1)
    chars, links, prose = Counter(), Counter(), Counter()
    for at, pieces in page.blocks:
        own: dict[int, list[int]] = {}
        for k, text, link in pieces:
            n = len(" ".join(text.split()))
            total = own.setdefault(around[k], [0, 0])
            total[0] += n
            total[1] += n if link else 0
        for k, (n, linked) in own.items():
            chars[k] += n
            links[k] += linked
            prose[k] += n >= 80 and 3 * linked < n
    for k in sorted(asked, reverse=True):  # children come after parents
        text = prose[k] > 0 or (page.elements[k].tag in PARAGRAPH and chars[k] >= 40)
        page.elements[k].drop = 0 if text and 3 * links[k] < chars[k] else 1
        up = around[page.elements[k].parent] if k else -1
        if up >= 0:
            chars[up], links[up], prose[up] = chars[up] + chars[k], links[up] + links[k], prose[up] + prose[k]


def settle(page: Page, least: float = 2.0, times: float = 10.0) -> None:
    """Decide which elements are dropped.

    Controls in a line only if they have an end tag, as nothing tells where others end; regions without one
    are as doubtful as names.  A doubtful element is dropped unless most of the page's text lies in it:
    ``times`` as many points as all that stays, and ``least`` or more.  Then it and its ancestors hold the
    article.  What readers write is never that; an element that holds ``main`` or the page's sole ``article`` always is.
    """
    elements = page.elements
    _agree(page)
    doubt = [0] * len(elements)
    sole = sum(e.tag == "article" and e.drop != 3 for e in elements) == 1
    for k, e in enumerate(elements):
        doubt[k] = e.drop
        if e.drop == 2 and not e.closed and e.tag not in ("head", "svg", "option", "optgroup"):
            doubt[k] = 0 if e.tag in CONTROLS else 1
        if e.tag == "main" or (sole and e.tag == "article" and not doubt[k]):
            up = e.parent
            while up > 0 and doubt[up] < 2:
                doubt[up], up = 0, elements[up].parent
    owner, lost = [-1] * len(elements), [False] * len(elements)  # the innermost doubtful element around each; surely dropped
    readers = [False] * len(elements)
    for k, e in enumerate(elements):
        lost[k] = doubt[k] == 2 or (k > 0 and lost[e.parent])
        owner[k] = k if doubt[k] in (1, 3) else (owner[e.parent] if k else -1)
        readers[k] = doubt[k] == 3 or (k > 0 and readers[e.parent])
    own = Counter()
    for _, pieces in page.blocks:
        for k, text, link in pieces:
            if not lost[k] and not link:
                own[owner[k]] += text.count(",") + len(text) / 100
    stays = own.pop(-1, 0.0)
    for k, n in own.most_common():
        if readers[k]:
            continue
        if n < least or n <= times * stays:
            break
        up = k
        while up > 0:
            if doubt[up] == 1:
                doubt[up] = 0
                stays += own[up]
            up = elements[up].parent
    for k, e in enumerate(elements):
        e.dropped = doubt[k] > 0 or (k > 0 and elements[e.parent].dropped)


def texts(page: Page) -> list[tuple[int, str, int]]:
    """(element, text, characters in links) of the blocks that are not dropped and not blank."""
    out = []
    for at, pieces in page.blocks:
        kept = [(t, link) for k, t, link in pieces if not page.elements[k].dropped]
        text = " ".join("".join(t for t, _ in kept).split())
        if text:
            out.append((at, text, min(sum(len(t.strip()) for t, link in kept if link), len(text))))
    return out


def chosen(page: Page, blocks: list[tuple[int, str, int]]) -> set[int]:
    """The elements whose text is kept: the best container and those beside it and its ancestors that read like it."""
    elements = page.elements
    for at, text, link_chars in blocks:
        e = elements[at]
        e.chars += len(text)
        e.link_chars += link_chars
        e.prose |= len(text) >= 80 and link_chars < 0.33 * len(text)
        give, share = points(text) * (1 - link_chars / len(text)), 1.0
        up = e.parent if e.tag in PARAGRAPH and e.parent > 0 else at
        for level in range(4):
            if up < 0:
                break
            elements[up].score += give * share
            share, up = 1 / (2 + level), elements[up].parent
    for e in reversed(elements[1:]):
        up = elements[e.parent]
        up.chars, up.link_chars, up.prose = up.chars + e.chars, up.link_chars + e.link_chars, up.prose or e.prose
    best, most = -1, 0.0
    for k, e in enumerate(elements):
        if e.dropped or not e.chars or e.tag in PARAGRAPH - {"td", "blockquote"} or (e.tag not in BLOCK and k):
            continue
        worth = e.score * (1 - e.link_chars / e.chars)
        if e.tag in ("article", "main") or e.names & ARTICLE_NAMES:
            worth = worth * 2 + 25
        elif e.names & {"content", "post", "entry", "story", "body", "text", "main"}:
            worth *= 1.25
        if worth > most:
            best, most = k, worth
    if best < 0:
        return set()
    up, outer = best, best
    while up > 0:
        if elements[up].tag == "article" or (elements[up].tag == "main" and elements[outer].tag != "article"):
            outer = up
        up = elements[up].parent
    beside: dict[int, list[int]] = {}
    for k, e in enumerate(elements):
        if e.chars and not e.dropped:
            beside.setdefault(e.parent, []).append(k)
    roots, level, floor = {outer}, outer, 0.2 * elements[best].score
    while level > 0 and elements[level].tag not in ("main", "body"):
        inner = elements[elements[level].parent].tag not in ("body", "html", "#page")  # not among the regions of the page
        near = inner and level == outer
        for k in beside.get(elements[level].parent, ()):
            e = elements[k]
            density = e.link_chars / e.chars
            if k == level or density >= 0.33:
                continue
            if elements[outer].tag == "article":  # what stands beside an article is another or none of it
                fits = e.tag == "article" and e.score >= 1.5 * floor
            elif e.tag in PARAGRAPH:
                fits = near or density < 0.25 and (inner or e.tag in HEADING or e.chars > 80 or (density == 0 and e.chars > 20))
            else:
                fits = near or e.score >= max(10.0, floor) or (inner and (e.prose or (density == 0 and e.chars > 20)))
            if fits:
                roots.add(k)
        if elements[outer].tag == "article":
            break
        level = elements[level].parent
    keep = set(roots)
    for k, e in enumerate(elements):  # parents come before children
        if e.parent in keep:
            keep.add(k)
    return keep


def main_text(source: str) -> str:
    """The main text: blocks in page order, white space in each as one space, joined by an empty line."""
    page = parse(source)
    settle(page)
    blocks = texts(page)
    keep = chosen(page, blocks)
    return "\n\n".join(text for at, text, _ in blocks if at in keep)


def extracted(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (its code points) in place of the page's source.

    Null, empty and text-free pages give an empty text.  Whole pages are read, in time
    that grows with their length.  Existing columns of these two names are replaced;
    rows are kept one for one.
    """
    small_batches(pages.sparkSession)
    others = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    source = pages.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{html_col}`").cast("string").alias("_html"))
    schema = source.drop("_html").withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in byte_slices(whole, "_html"):
                found = [main_text(x) if x else "" for x in b.column("_html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], [*others, "text", "n_chars"])
        tidy()

    return source.mapInArrow(run, schema)
