"""Main text of HTML pages by block rules in two passes.

A page is cut into blocks at block-level tags. The first pass decides blocks by themselves: blocks that are mostly link text
are bad; long blocks with many stop words are good; others are near good, short or open. The second pass gives each
of those the label of its nearest decided neighbours, for paragraphs and headings those in the same element if one of them is good: both
sides alike, or else the nearer side, where a near-good block and a heading before good text count as good. Inside an article or main element only its own good blocks are neighbours: link
lists and asides in it say nothing about the text around them. If such elements hold the larger part of a page's text, blocks outside them are bad, and an
article whose blocks no rule decides is good as a whole: its text may be in no known language.

What no density tells, such as a notice or a reader's comment in whole sentences, is named by its page. Elements whose tag can't
hold main text (a menu, a footer) are left out. Forms, and elements that a class, id or role names as boilerplate, are marked: a
name counts if all its words are of boilerplate or of layout ("cookie-notice", "comment-list", but not "related-work" or
"has-comments"). A label or button is a form's unless it stands in a sentence. Readers' comments are marked by a name, by a heading that says so (what
follows it in its element), or by their structure: two or more children of an element, of one tag and class and without headings, that each show a person and a time or a reply.
Density overrules marks: a form with more running text than the page has outside it, and with parts of a page (a first heading, a menu) or more running
blocks than fields, wraps the page and isn't one; a section of an article that its name may give a subject ("legal", "search") stays if most of it is running text;
if no running text is left unmarked, the mark around the most of it is lifted, from the outermost inwards; an article or main element
lifts the marks around it, but for comments. An open element is found by its tag and a mark by its parent, so a page takes time in proportion to its length.

Text: character references are decoded, white space becomes single spaces, blocks are joined in page order by
line feeds; nothing is capped.

Defined cases: null or empty html gives the empty text; broken markup (unclosed or crossed tags, ends of nothing, an end inside a
tag, stray "<") is read to its end, as are very long and deep pages; a block as near to a good as to a bad one is good; repeated rows come out as
often as they came in; an empty table gives no rows; columns named text and n_chars are replaced, further ones kept.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gleaner.llm.common import pieces_of

SHORT_CHARS, LONG_CHARS = 70, 200
STOP_HIGH, STOP_LOW = 0.30, 0.20
LINKED = 0.5
#: Share of a page's free text that article and main elements must hold to be taken as the place of the main text.
ARTICLE_SHARE = 0.4

# Frequent function words.
STOP_WORDS = frozenset(
    # English
    "a an and are as at be but by for from had has have he her his i in is it its not of on or that the their they this to was were which with you"
    # German
    " als am auch auf aus bei das dass dem den der des die ein eine einer es für hat im ist mit nach nicht sich sie sind und von war wie wird zu zum"
    # French
    " au aux avec ce cette dans de des du elle en est et il la le les leur mais ou par pas plus pour que qui sa se ses son sur un une"
    # Spanish
    " al como con del el ella era esta fue ha las lo los más no para pero por se sin su sus también una y ya".split()
)
# Tags.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title xmp".split())
BAD_TAGS = frozenset("aside audio canvas datalist dialog footer head iframe input map menu nav noscript object option select svg template video".split())
CONTROLS = frozenset("button label".split())
FIELDS = frozenset("button input label select textarea".split())
PAGE_PARTS = frozenset("article footer h1 header main nav".split())
PARAGRAPHS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROOTS = frozenset(("article", "main"))
# Words of class, id and role that name boilerplate.
BAD_WORDS = frozenset(
    "ad ads adsense advert advertisement advertisements advertising adverts banner banners breadcrumb breadcrumbs complementary consent contentinfo cookie "
    "cookies copyright dialog disclaimer footer gdpr legal login masthead menu menus modal nav navbar navigation newsletter newsletters notice notices "
    "outbrain pager pagination popup popups promo promoted promos promotion recommendations recommended related search share sharing sidebar sidebars signin "
    "signup skip social sponsor sponsored sponsors subscribe subscription taboola toolbar tooltip tracking widget widgets".split()
)
# Of these, words that may name what a section of an article is about.
SUBJECT_WORDS = frozenset("consent copyright dialog disclaimer legal login menu menus navigation notice notices recommendations recommended related search share sharing social subscription tracking".split())
# Outside an article or main element these too.
OUTER_WORDS = frozenset("header teaser teasers".split())
COMMENT_WORDS = frozenset("comment commentlist comments disqus replies reply respond".split())
# Words of class and rel that show who wrote a comment, and when or how to answer.
PERSON_WORDS = frozenset("author avatar byline commenter name nick user username writer".split())
TIME_WORDS = frozenset("ago date posted reply time timestamp votes".split())
# Headings of comments, whole; "discussion" only outside an article or main element.
COMMENT_HEADING = re.compile(r"(?:\d+ |all |leave a |post a |reader |readers' |your )*(?:comments?|repl(?:y|ies)|responses?|readers? (?:said|say|wrote|write)|kommentare?|leserbriefe|commentaires?|comentarios?)(?: \(?\d+\)?)?:?", re.I)
OUTER_HEADING = re.compile(r"(?:join the )?discussions?:?", re.I)
# Words that may stand beside them in a name.
LAYOUT_WORDS = frozenset(
    "aligned area article articles bar block body bottom box button buttons card cards center col column columns container content desktop div element entry "
    "first fixed follow form global grid group head heading holder icon icons inner item items last layer layout left link links list listing local main "
    "message mobile more outer overlay page panel placeholder policy post posts primary reading region right row secondary section site slot "
    "sticky stories story strip tab tabs text thread title top unit user users us view wrap wrapper".split()
)


_TAG = re.compile(
    r"<(?:!--.*?(?:--!?>|\Z)|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)|[!?/][^>]*(?:>|\Z))", re.S
)
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_WORD = re.compile(r"[^\W\d_]+")
_PART = re.compile(r"[a-z]{2,}")
_CASE = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")

GOOD, BAD, NEAR, SHORT, OPEN = "good", "bad", "near", "short", "open"


class Block:
    __slots__ = ("text", "linked", "excluded", "mark", "root", "heading", "place", "label")

    def __init__(self, text: str, linked: int, excluded: bool, mark: int, root: int, heading: bool, place: int):
        self.text, self.linked, self.excluded, self.mark, self.root, self.heading = text, linked, excluded, mark, root, heading
        self.place = place  # of a paragraph: the element it stands in, or else 0
        self.label = ""


class Marks:
    """Marks around blocks, each after the one it stands in; 0 is none. A kind of "" may become one of comments and says nothing till then."""

    def __init__(self) -> None:
        self.kind, self.parent, self.fields, self.parts = [""], [0], [0], [False]

    def add(self, kind: str, parent: int) -> int:
        for column, value in ((self.kind, kind), (self.parent, parent), (self.fields, 0), (self.parts, False)):
            column.append(value)
        return len(self.kind) - 1


class Open:
    """An open element."""

    __slots__ = ("tag", "excluded", "mark", "form", "root", "link", "heading", "element", "place", "name", "signs", "alike")

    def __init__(self, tag: str, around: Open | None):
        self.tag = tag
        self.excluded, self.mark, self.form, self.root, self.link, self.heading, self.element, self.place = (
            (around.excluded, around.mark, around.form, around.root, around.link, around.heading, around.element, around.place) if around else (False, 0, 0, 0, False, False, 1, 0)
        )
        self.name = ""  # its class
        self.signs = 0  # 1: a person, 2: a time or reply, 4: a heading in it
        self.alike: dict[tuple[str, str], int] | None = None  # children that look like comments, by tag and class


def _named(names: str, in_root: bool) -> str:
    """Whether one of the names, separated by white space, is a name of boilerplate: "comments", "words", or "subject" if it may be of something else."""
    found = ""
    for name in names.split():
        parts = {*_PART.findall(_CASE.sub("-", name).lower())}
        bad = parts - LAYOUT_WORDS
        if not bad:
            continue
        if bad <= COMMENT_WORDS | BAD_WORDS and bad & COMMENT_WORDS:
            return "comments"
        if bad <= SUBJECT_WORDS:
            found = found or "subject"
        elif bad <= BAD_WORDS or (not in_root and bad <= BAD_WORDS | OUTER_WORDS):
            found = "words"
    return found


def _kind(tag: str, own: dict[str, str], in_root: bool) -> str:
    """Why an element's text may be left out: "tag" (it is), "form", "comments", "words", "subject" (if it isn't running), or nothing."""
    if tag in BAD_TAGS or (tag == "header" and not in_root):
        return "tag"
    kind = "form" if tag == "form" or tag in CONTROLS else ""
    if not own or tag in ("html", "body"):
        return kind
    if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(own.get("style", "").lower()):
        return "tag"
    named = _named(" ".join(own.get(k, "") for k in ("class", "id", "role")), in_root)
    if named == "subject" and not (in_root and (tag == "section" or not own.get("class") and not own.get("role"))):
        named = "words"
    return named if named and (named == "comments" or tag not in ROOTS) else kind


def _signs(tag: str, own: dict[str, str]) -> int:
    words = {*_PART.findall(_CASE.sub("-", f"{own.get('class', '')} {own.get('rel', '')} {own.get('itemprop', '')}").lower())} if own else set()
    return (tag == "cite" or bool(words & PERSON_WORDS)) | 2 * (tag == "time" or bool(words & TIME_WORDS)) | 4 * (tag in HEADINGS)


def blocks(html: str) -> tuple[list[Block], Marks]:
    """The page's blocks that have text, in page order, and the marks around them."""
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    marks = Marks()
    stack = [Open("", None)]
    opened: dict[str, list[int]] = {}  # where open elements of a tag stand in the stack, and those of any block-level tag
    levels: list[int] = []
    roots, elements = 0, 1

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                top = stack[-1]
                if top.heading and (COMMENT_HEADING.fullmatch(text) or (not top.root and OUTER_HEADING.fullmatch(text))):
                    at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in HEADINGS), 1)
                    for own in stack[at - 1 :]:  # the heading, and what follows in the element around it
                        own.mark = mark = marks.add("comments", own.mark) if own is stack[at - 1] else mark
                out.append(Block(text, len(" ".join(" ".join(linked).split())), top.excluded, top.mark, top.root, top.heading, top.place))
            parts.clear()
        linked.clear()

    def add(raw: str) -> None:
        text = unescape(raw) if "&" in raw else raw
        parts.append(text)
        if stack[-1].link:
            linked.append(text)

    def close(at: int) -> None:
        """Ends the elements from this place in the stack on."""
        while len(stack) > at:
            own = stack.pop()
            opened[own.tag].pop()
            if levels and levels[-1] == len(stack):
                levels.pop()
            around = stack[-1]
            if own.tag in BLOCK_TAGS and own.signs & 7 == 3:
                around.alike = around.alike or {}
                key = own.tag, own.name
                around.alike[key] = around.alike.get(key, 0) + 1
                if around.alike[key] == 2 and around.mark and marks.kind[around.mark] == "":
                    marks.kind[around.mark] = "comments"
            if own.tag not in ROOTS:
                around.signs |= own.signs

    at = 0
    while True:
        m = _TAG.search(html, at)
        if m is None:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            if tag in BLOCK_TAGS or tag in BAD_TAGS:
                flush()
            if places := opened.get(tag):
                i = places[-1]
                if tag in BLOCK_TAGS or not levels or levels[-1] <= i:
                    if (stack[i].excluded, stack[i].mark) != (stack[i - 1].excluded, stack[i - 1].mark):  # a marked inline element's text is a block
                        flush()
                    close(i)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        around = stack[-1]
        if around.form and tag in FIELDS:
            marks.fields[around.form] += 1
        if around.form and tag in PAGE_PARTS:
            marks.parts[around.form] = True
        if tag in RAW_TAGS:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag in BLOCK_TAGS:
            flush()
            # A block-level tag ends an open paragraph, and the inline elements left open in it.
            if levels and stack[levels[-1]].tag == "p":
                close(levels[-1])
        if tag in VOID_TAGS or m["attrs"].endswith("/") and tag in BAD_TAGS:
            continue
        around = stack[-1]
        own: dict[str, str] = {}
        for name, x, y, z in _ATTR.findall(m["attrs"]) if m["attrs"] else ():
            own.setdefault(name.lower(), x or y or z)
        new = Open(tag, around)
        new.name = own.get("class", "")
        new.signs = _signs(tag, own)
        kind = _kind(tag, own, around.root > 0)
        if kind == "form" and tag in CONTROLS and any(not x.isspace() for x in parts):
            kind = ""  # in a sentence
        if tag in ROOTS:
            while new.mark and marks.kind[new.mark] != "comments":  # the place of the main text in a wrapper named for what's beside it
                new.mark = marks.parent[new.mark]
            if not new.root:
                roots += 1
                new.root = roots
        if kind and not around.excluded and tag not in BLOCK_TAGS:
            flush()
        if kind and kind != "tag" or tag in BLOCK_TAGS and tag not in PARAGRAPHS:
            new.mark = marks.add("" if kind == "tag" else kind, new.mark)
        if tag == "form":
            new.form = new.mark
        if tag in BLOCK_TAGS:
            elements += 1
            new.element, new.place = elements, new.element if tag in PARAGRAPHS else 0
            levels.append(len(stack))
        new.excluded = around.excluded or kind == "tag"
        new.link, new.heading = around.link or tag == "a", around.heading or tag in HEADINGS
        opened.setdefault(tag, []).append(len(stack))
        stack.append(new)
    flush()
    close(1)
    return out, marks


def _stops(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def _lift(found: list[Block], marks: Marks, stops: list[float]) -> None:
    """Excludes the marked blocks, but for those whose marks density overrules."""
    n = len(marks.kind)
    running = [len(b.text) if not b.excluded and len(b.text) > LONG_CHARS and b.linked <= LINKED * len(b.text) else 0 for b in found]
    if any(x and s >= STOP_LOW for x, s in zip(running, stops, strict=True)):
        running = [x if s >= STOP_LOW else 0 for x, s in zip(running, stops, strict=True)]
    inside, all_text, blocks_in = [0] * n, [0] * n, [0] * n
    for x, b in zip(running, found, strict=True):
        if not b.excluded:
            inside[b.mark] += x
            all_text[b.mark] += len(b.text)
            blocks_in[b.mark] += x > 0
    direct = inside[:]
    below: dict[int, list[int]] = {}
    for i in range(n - 1, 0, -1):  # what stands in a mark comes after it
        for total in (inside, all_text, blocks_in):
            total[marks.parent[i]] += total[i]
        below.setdefault(marks.parent[i], []).append(i)
    lifted = [False] * n
    free, forms, others = 0, [], []

    def lift(first: int) -> None:
        nonlocal free
        todo = [first]
        while todo:
            i = todo.pop()
            lifted[i] = True
            free += direct[i]
            for j in below.get(i, ()):
                kind = marks.kind[j]
                if kind == "" or (kind == "subject" and 2 * inside[j] >= all_text[j]):
                    todo.append(j)
                elif inside[j]:
                    heapq.heappush(others, (-inside[j], j))
                    if kind == "form" and (marks.parts[j] or blocks_in[j] > max(4, marks.fields[j])):
                        heapq.heappush(forms, (-inside[j], j))

    lift(0)
    while True:
        while forms and lifted[forms[0][1]]:
            heapq.heappop(forms)
        if forms and -forms[0][0] > free:
            lift(heapq.heappop(forms)[1])
            continue
        while others and lifted[others[0][1]]:
            heapq.heappop(others)
        if free or not others:
            break
        lift(heapq.heappop(others)[1])
    for b in found:
        b.excluded = b.excluded or not lifted[b.mark]


def decide(found: list[Block], marks: Marks) -> None:
    """Gives each block the label good or bad."""
    stops = [_stops(b.text) for b in found]
    _lift(found, marks, stops)
    free = [b for b in found if not b.excluded]
    inside = sum(len(b.text) for b in free if b.root)
    placed = inside > 0 and inside >= ARTICLE_SHARE * sum(len(b.text) for b in free)
    for b, stop in zip(found, stops, strict=True):
        n = len(b.text)
        link = b.linked / n
        if b.excluded or (placed and not b.root) or (link > LINKED and not b.heading):
            b.label = BAD
        elif n < SHORT_CHARS:
            b.label = BAD if not b.root and ("\N{COPYRIGHT SIGN}" in b.text or link > STOP_LOW) else SHORT
        elif stop >= STOP_HIGH and n > LONG_CHARS:
            b.label = GOOD
        elif stop >= STOP_LOW:
            b.label = NEAR
        else:
            b.label = OPEN
    first = [b.label for b in found]
    # Nearest decided blocks before and after each, of the same place if it has a good one, or else of the page. If nothing is good,
    # what elements decide doesn't speak about the text beside them.
    good = {b.place for b in found if b.label == GOOD and b.place}
    keys = [(b.root, b.place if b.place in good else 0) for b in found]

    def nearest(order: range) -> list[int]:
        out, last = [-1] * len(found), {}
        for i in order:
            b = found[i]
            out[i] = last.get(keys[i], -1)
            if first[i] == GOOD or (first[i] == BAD and not b.root and (GOOD in first or not b.excluded)):
                last[b.root, 0] = i
                if b.place and not b.excluded:
                    last[b.root, b.place] = i
        return out

    before, behind = nearest(range(len(found))), nearest(range(len(found) - 1, -1, -1))
    for i, (b, prior, after) in enumerate(zip(found, before, behind, strict=True)):
        if first[i] in (GOOD, BAD):
            continue
        sides = [first[j] for j in (prior, after) if j >= 0]
        if not sides:
            b.label = GOOD
        elif len(set(sides)) == 1:
            # Bad neighbours don't speak against long text of a page without any good text.
            b.label = GOOD if sides[0] == BAD and first[i] in (NEAR, OPEN) and GOOD not in first else sides[0]
        elif first[i] == NEAR or (b.heading and first[after] == GOOD):
            b.label = GOOD
        else:
            gap = (i - prior) - (after - i)  # equally near: good
            b.label = GOOD if gap == 0 else first[prior if gap < 0 else after]


def main_text(html: str | None) -> str:
    found, marks = blocks(html or "")
    decide(found, marks)
    return "\n".join(b.text for b in found if b.label == GOOD)


def with_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without html, with text and n_chars (code points)."""
    kept = [f for f in pages.schema.fields if f.name not in (html, "text", "n_chars")]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches, html):
            texts = [main_text(h.as_py()) for h in b.column(html)]
            own = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *own], names=[*names, "text", "n_chars"])

    return pages.select(*names, html).mapInArrow(run, schema)


def report(pages: DataFrame) -> DataFrame:
    return with_text(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
