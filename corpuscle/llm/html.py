"""HTML extraction by two passes of block rules.

The markup is read once, in linear time, into blocks: runs of text between block-level tags. First pass: a block made of links is bad,
or undecided if it is short and in an article; a long one with stop words, or a long one inside an article element, is good; the others
are undecided. Second pass: an undecided block takes the label of the nearest decided neighbour, looking within its article first, and
never at parts that are no article text; where two are equally near, good wins inside an article or if the block is a heading. Blocks
that no decided one stands beside are good; headings right before reader comments are bad.

Parts that are no article text, whatever their words: navigation, footers, asides, forms; elements with a class, id or role of which
any word is a strong name (nav, sidebar, ad, cookie, comments), unless another word takes it back (no-sidebar), or the page's main article,
or, but for comments, most of its text stands inside; and threads: elements of one kind beside each other of which most tell an author and a time. Words of a looser kind (login,
related, social, legal) are evidence only: inside an article a long block with stop words and few links is good in spite of one.

Character references are decoded, white space inside a block becomes one space, ends are trimmed, and blocks are joined by one
space. Null and empty pages give an empty text, as do pages without a good block. Broken markup is read as browsers do, roughly: unknown and
unclosed tags are passed over; a quote inside an unquoted value is a plain character; a quoted value that never ends, ends with its
tag; an unfinished comment or script hides the rest. Rows are handled one by one, so repeated rows give alike texts; other columns
pass through, but one with the name of the text column is replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tags that end a block, tags whose content is not markup, tags whose text is not shown as text, tags that hold no article text, tags without an end.
BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
HIDDEN_TAGS = frozenset("template svg math object canvas select button datalist head audio video".split())
OUTSIDE_TAGS = frozenset("nav footer aside form menu dialog".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE_TAGS = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags that end an open one of their kind.
SIBLINGS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
#: Words in a class, id or role that name a part other than the article; such words for reader comments; words that only hint at one; words that take a name back.
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer "
    "cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription share sharing pagination pager contentinfo complementary".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus".split())
HINT_WORDS = frozenset(
    "aside header banner masthead topbar toolbar alert notice notices login signup discussion replies reply respond search social related recommended recommendations widget widgets copyright legal disclaimer skip".split()
)
BACK_WORDS = frozenset("no without has with free hide hidden disable disabled open closed layout".split())
#: Words in a class, or tags, that tell an author or a time.
AUTHOR_WORDS = frozenset("author byline user username commenter nick nickname poster avatar vcard".split())
TIME_WORDS = frozenset("time date datetime timestamp ago posted published when".split())
#: A time as it stands behind an author's name.
_TIMED = re.compile(r"\b(?:\d+|an?|one) (?:second|minute|hour|day|week|month|year)s? ago\b|\b\d{1,2}:\d{2}\b|\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b")
#: Characters of a block in which an author and a time are looked for.
BYLINE = 80
#: Frequent function words of the corpora's languages.
STOP_WORDS = frozenset(
    "the of and to in is a for it on that was with as by are be this at from or an not have he you der die das und zu den von mit ist ein eine im nicht sich auf auch für des dem als es "
    "le la les de et que un une en est pour dans du pas qui au sur par avec el los las y con para se del al no su lo como más".split()
)
_EDGES = ".,;:!?()[]\"'“”„«»#*$%&|"

_MARKUP = re.compile(r"<(?=[a-zA-Z/!?])")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_BETWEEN = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"[^\s/>][^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")


@dataclass(frozen=True)
class Rules:
    long_chars: int = 70
    max_link_density: float = 0.4
    stop_density: float = 0.15


@dataclass
class Block:
    text: str
    links: int  # characters of it inside links
    outside: bool
    hinted: bool
    article: int  # number of the article it stands in, or 0
    heading: bool
    element: int  # number of the innermost element
    label: bool | None = None
    comment: bool = False


@dataclass
class Element:
    """A block-level element, or one that a name sets apart, and what stands inside."""

    parent: int
    tag: str
    kind: str  # its class
    name: int  # 3: comments, 2: another part that is no article text, else 0
    article: int  # number of the article that it opens, or 0
    author: bool
    time: bool
    chars: int = 0
    bylines: int = 0  # characters of short blocks that tell an author and a time
    comment: bool = False
    outside: bool = False


class _Page:
    """Reads tags. Remembers which characters don't occur any more, so that no tag looks for them again."""

    def __init__(self, html: str):
        self.html = html
        self.missing: dict[str, int] = {}  # from where on

    def find(self, text: str, at: int) -> int:
        if at >= self.missing.get(text, len(self.html) + 1):
            return -1
        found = self.html.find(text, at)
        if found < 0:
            self.missing[text] = at
        return found

    def attributes(self, at: int) -> tuple[list[tuple[str, str]], bool, int]:
        """(names and values of class, id, role, rel and itemprop; whether the tag closes itself; the place behind the tag)."""
        html, out = self.html, []
        end = self.find(">", at)
        if end < 0:
            return out, False, len(html)
        if "=" not in html[at:end]:
            return out, html[end - 1] == "/", end + 1
        while True:
            start = at
            at = _BETWEEN.match(html, at).end()
            if at >= len(html) or html[at] == ">":
                return out, at > start and html[at - 1] == "/", min(at + 1, len(html))
            m = _ATTRIBUTE.match(html, at)
            name, value, at = m[0].lower(), "", m.end()
            if m := _EQUALS.match(html, at):
                at = m.end()
                quote = html[at : at + 1]
                if quote in ("'", '"') and (close := self.find(quote, at + 1)) >= 0:
                    value, at = html[at + 1 : close], close + 1
                elif quote in ("'", '"'):
                    close = self.find(">", at)
                    value, at = html[at + 1 : close if close >= 0 else len(html)], close if close >= 0 else len(html)
                else:
                    m = _BARE.match(html, at)
                    value, at = m[0], m.end()
            if name in ("class", "id", "role", "rel", "itemprop"):
                out.append((name, value))


def _words(name: str) -> set[str]:
    return set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())) - {""}


def named(attributes: list[tuple[str, str]]) -> int:
    """3 if a class, id or role names reader comments, 2 if another part that is no article text, 1 if it hints at one, else 0."""
    most = 0
    for key, value in attributes:
        for name in value.split() if key in ("class", "id", "role") else ():
            words = _words(name)
            if words & BACK_WORDS:
                continue
            most = max(most, 3 if words & COMMENT_WORDS else 2 if words & OUTSIDE_WORDS else 1 if words & HINT_WORDS else 0)
    return most


def told(tag: str, attributes: list[tuple[str, str]]) -> tuple[bool, bool]:
    """Whether an element tells an author, and a time."""
    words = {w for _, value in attributes for name in value.split() for w in _words(name)}
    return tag in ("cite", "address") or bool(words & AUTHOR_WORDS), tag == "time" or bool(words & TIME_WORDS)


@dataclass(frozen=True)
class _Open:
    """What holds inside an element."""

    tag: str = ""
    outside: bool = False
    hinted: bool = False
    hidden: bool = False
    article: int = 0
    heading: bool = False
    element: int = 0


def read_blocks(html: str) -> list[Block]:
    page, blocks, parts = _Page(html), [], []
    stack, now, opened = [], _Open(), Counter()
    elements = [Element(-1, "", "", 0, 0, False, False)]
    links = articles = in_link = 0

    def close() -> None:
        nonlocal links
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                blocks.append(Block(text, links, now.outside, now.hinted, now.article, now.heading, now.element))
            parts.clear()
            links = 0

    def leave(tag: str) -> None:
        nonlocal now
        while True:
            inner, now = now, stack.pop()
            opened[inner.tag] -= 1
            if inner.tag == tag:
                return

    at, end = 0, len(html)
    while at < end:
        m = _MARKUP.search(html, at)
        text = html[at : m.start() if m else end]
        if text and not now.hidden:
            parts.append(text)
            if in_link:
                links += len(text.strip())
        if not m:
            break
        at = m.end()
        if html.startswith("!--", at):
            at = found + 3 if (found := page.find("-->", at + 3)) >= 0 else end
            continue
        closing = html[at] == "/"
        m = _NAME.match(html, at + closing)
        if not m:  # a declaration, or a bogus comment
            at = found + 1 if (found := page.find(">", at)) >= 0 else end
            continue
        tag = m[0].lower()
        attributes, empty, at = page.attributes(m.end())
        if tag in RAW_TAGS and not closing:
            if tag in BLOCK_TAGS:
                close()
            if not empty:
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
                at = page.attributes(stop.end())[2] if stop else end
            continue
        if tag == "br" and not now.hidden:
            parts.append(" ")
        elif tag == "a":
            in_link = max(0, in_link + (-1 if closing else 1))
        if closing:
            if tag in BLOCK_TAGS:
                close()
            if opened[tag]:
                leave(tag)
            continue
        if tag in VOID_TAGS or empty:
            if tag in BLOCK_TAGS:
                close()
            continue
        kind = 0 if tag in ("html", "body") else named(attributes)
        if tag in ARTICLE_TAGS and kind < 3:
            kind = 0
        author, time = told(tag, attributes) if attributes or tag in ("cite", "address", "time") else (False, False)
        outside, hidden = tag in OUTSIDE_TAGS or (tag == "header" and not now.article) or (kind == 1 and not now.article), tag in HIDDEN_TAGS
        if tag in BLOCK_TAGS:
            close()
            if now.tag == "p":
                leave("p")  # a paragraph ends where the next block begins
            if now.tag in SIBLINGS.get(tag, "").split():
                leave(now.tag)
            if opened["head"] and tag == "body":
                leave("head")
        elif not (outside or hidden or kind):  # inline, and nothing changes inside
            own = elements[now.element]
            own.author, own.time = own.author or author, own.time or time
            continue
        stack.append(now)
        opened[tag] += 1
        article = now.article
        if tag in ARTICLE_TAGS and not now.outside and not outside and not article and kind < 3:
            articles += 1
            article = articles
        elements.append(Element(now.element, tag, " ".join(v for k, v in attributes if k == "class"), kind if kind > 1 else 0, article if article != now.article else 0, author, time))
        now = _Open(tag, now.outside or outside, now.hinted or kind == 1, now.hidden or hidden, article, tag in HEADINGS, len(elements) - 1)
    close()
    set_apart(elements, blocks)
    return blocks


def set_apart(elements: list[Element], blocks: list[Block]) -> None:
    """Marks the blocks of elements that a name, or a thread, sets apart."""
    size = Counter()
    for b in blocks:
        e = elements[b.element]
        e.chars += len(b.text)
        size[b.article] += len(b.text)
        if len(b.text) <= BYLINE and (m := _TIMED.search(b.text)) and m.start() > 1:
            e.author = e.time = True
            e.bylines += len(b.text)
    for e in reversed(elements[1:]):  # an element comes before those inside it
        up = elements[e.parent]
        up.chars, up.bylines, up.author, up.time = up.chars + e.chars, up.bylines + e.bylines, up.author or e.author, up.time or e.time
    del size[0]
    main = max(size, key=lambda a: (size[a], -a), default=0)
    at, around, inside = next((k for k, e in enumerate(elements) if main and e.article == main), -1), set(), [False] * len(elements)
    up = at
    while up >= 0:
        around.add(up)
        up = elements[up].parent
    whole, rows = elements[0].chars, {}
    for k, e in enumerate(elements[1:], 1):
        inside[k] = k == at or inside[e.parent]
        if e.name and k not in around and (main or e.name == 3 or 2 * e.chars <= whole):
            e.outside, e.comment = True, e.name == 3
        if e.tag not in ("p", "tr", "td", "th", *HEADINGS) and (inside[e.parent] or e.tag not in ARTICLE_TAGS):
            rows.setdefault((e.parent, e.tag, e.kind), []).append(k)
    for same in rows.values():
        telling = sum(e.author and e.time and (not e.bylines or e.chars >= e.bylines + BYLINE // 4) for e in map(elements.__getitem__, same))
        if telling > 1 and 10 * telling >= 6 * len(same) and not around.intersection(same) and sum(elements[k].chars for k in same) < whole:
            for k in same:
                elements[k].outside = elements[k].comment = True
    for e in elements[1:]:
        e.outside, e.comment = e.outside or elements[e.parent].outside, e.comment or elements[e.parent].comment
    for b in blocks:
        b.outside, b.comment = b.outside or elements[b.element].outside, elements[b.element].comment


def stop_density(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(_EDGES) in STOP_WORDS for w in words) / len(words)


def first_pass(b: Block, rules: Rules) -> bool | None:
    if b.outside:
        return False
    if b.links > rules.max_link_density * len(b.text):
        return None if b.article and not b.hinted and len(b.text) < rules.long_chars else False
    if len(b.text) >= rules.long_chars:
        dense = stop_density(b.text) >= rules.stop_density
        return True if dense or (b.article and not b.hinted) else False if b.hinted else None
    return False if b.hinted else None


def second_pass(blocks: list[Block]) -> None:
    """Labels the undecided blocks. Neighbours that are outside by their element don't tell."""

    def nearest(order) -> list[tuple[int, bool] | None]:
        """Place and label of the last decided block before each, within its article if it stands in one."""
        out: list[tuple[int, bool] | None] = [None] * len(blocks)
        last: dict[int, tuple[int, bool]] = {}
        for k in order:
            b = blocks[k]
            out[k] = last.get(b.article) if b.article else last.get(-1)
            if b.label is not None and not b.outside:
                last[b.article] = last[-1] = (k, b.label)
        return out

    before, after = nearest(range(len(blocks))), nearest(range(len(blocks) - 1, -1, -1))
    for k, (b, x, y) in enumerate(zip(blocks, before, after, strict=True)):
        if b.label is None and b.heading and k + 1 < len(blocks) and blocks[k + 1].comment:
            b.label = False
        if b.label is None:
            found = sorted((abs(k - at), label) for at, label in (z for z in (x, y) if z is not None))
            if len(found) == 2 and found[0][0] == found[1][0] and found[0][1] != found[1][1]:
                b.label = bool(b.article or b.heading)
            else:
                b.label = found[0][1] if found else True


def main_text(html: str | None, rules: Rules = Rules()) -> str:
    if not html:
        return ""
    blocks = read_blocks(html)
    for b in blocks:
        b.label = first_pass(b, rules)
    second_pass(blocks)
    return " ".join(b.text for b in blocks if b.label)


@F.pandas_udf(T.StringType())
def _main_texts(pages: pd.Series) -> pd.Series:
    return pages.map(main_text)


def extracted(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """pages with the main text, in a column that replaces one of the same name."""
    return pages.withColumn(text, _main_texts(F.coalesce(F.col(html), F.lit(""))))
