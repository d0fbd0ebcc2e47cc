"""Main text of web pages by line-block distribution.

Markup is stripped and the page cut into lines, one for each block element. Text of parts that
say what they are (menus, page headers and footers, sidebars, adverts, notices, forms, reader
comments, scripts) makes no line. Every other line weighs as many characters as it has outside
links; markup of an article only changes weights: inside it lines weigh ARTICLE_FACTOR times as
much and half of their link text too, beside it OTHER_FACTOR as much.

Weights are summed over windows of a line and its REACH neighbours on either side. A window sum
that rises from nothing opens a stretch, one that falls to nothing closes it. A stretch whose
sums reach SURGE has a surge point; the text between it and the dive point is kept, from the
first line that weighs something to the last one, short lines between them too. If no stretch
surges, the heaviest one is kept, so a short article isn't lost. Windows don't reach across the
edge of a marked article.

Defined results: null, empty and text-free pages give an empty text with 0 characters. A page
cut off anywhere is read as far as it goes; unclosed elements end with the page, paragraphs and
list items where the next one begins. Repeated rows each get their own result, null ids and urls
stay null. Very long pages are read whole. An empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import DataFrame

from veilspan.llm.arrowtext import map_texts

#: Lines summed on either side of a line, and the window sum that makes a surge.
REACH, SURGE = 1, 80
#: What lines weigh inside a marked article, and beside it on a page that marks one.
ARTICLE_FACTOR, OTHER_FACTOR = 4.0, 0.1

#: Elements that start a line of their own, those whose content is never text
#: of a page, those outside an article, and those that never have an end tag.
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead title tr ul".split())
RAW = set("script style noscript template textarea title iframe svg math object canvas audio video noframes noembed xmp".split())
OUTSIDE = set("nav footer aside form head button select option menu dialog fieldset label input datalist".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a new one of the same group ends, and where the search for it stops.
ENDED_BY_NEXT = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"})}

#: Words that name parts outside an article, and words that may stand beside them
#: in a class or id. A name with any other word in it (`related-work`) is no such part.
PARTS = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted "
    "nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar masthead footer sidebar aside rail widget widgets "
    "related recommended recommendations popular trending cookie cookies consent gdpr notice alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social comment comments commentlist disqus discussion replies respond "
    "pagination pager search tags skip copyright disclaimer contentinfo complementary".split()
)
BESIDE = set(
    "area articles bar block body bottom box button buttons column container content cta footer form frame global group header heading "
    "holder icons inline inner item items large layer left link links list main media message mobile module off out outer page panel policy "
    "post posts primary right row secondary section site slot small stories sticky sub text thread title to top unit us user warning wrap wrapper".split()
)

_QUOTED = r"\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+"
#: Quotes count only where a value starts, as browsers read them.
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:{_QUOTED})?+)*+)(?:>|\Z)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(rf"([^\s/>=\"']+)(?:\s*=\s*({_QUOTED}))?")
SPACE = re.compile(r"\s+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
LETTERS = re.compile(r"[a-z]+")


def names_part(name: str) -> bool:
    """Whether a class, id or role says that its element is no part of an article."""
    words = LETTERS.findall(CAMEL.sub("-", name).lower())
    return any(w in PARTS for w in words) and all(w in PARTS or w in BESIDE for w in words)


def is_outside(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in OUTSIDE or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and HIDDEN.search(value.lower())):
            return True
        if name in ("class", "id", "role") and tag != "main" and any(map(names_part, value.split())):
            return True
    return False


@dataclass
class Line:
    """One block's text, its characters outside and inside of links, and whether it stands in a marked article."""

    text: str
    plain: int
    linked: int
    marked: bool


class Reader:
    """Reads the markup once and collects the lines."""

    def __init__(self):
        self.lines: list[Line] = []
        self.open: list[tuple[str, bool, bool]] = []  # tag, starts an outside part, is an article
        self.outside = self.articles = 0
        self.in_link = False
        self._start()

    def _start(self) -> None:
        self.parts: list[str] = []
        self.plain = self.linked = 0

    def end_line(self) -> None:
        joined = SPACE.sub(" ", "".join(self.parts)).strip()
        if joined:
            self.lines.append(Line(joined, self.plain, self.linked, self.articles > 0))
        self._start()

    def text(self, raw: str) -> None:
        if self.outside:
            return
        part = entities.unescape(raw)
        self.parts.append(part)
        if self.in_link:
            self.linked += len(part.strip())
        else:
            self.plain += len(part.strip())

    def _pop(self, k: int) -> None:
        for _, outside, article in self.open[k:]:
            self.outside -= outside
            self.articles -= article
        del self.open[k:]

    def _end_open(self, tags: set[str], stops: set[str]) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in tags:
                return self._pop(k)
            if self.open[k][0] in stops:
                return None
        return None

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.end_line()
            self._end_open({"p"}, BLOCKS - {"p"})
        if tag in ENDED_BY_NEXT:
            self._end_open(*ENDED_BY_NEXT[tag])
        if tag in ("br", "td", "th") and not self.outside:
            self.parts.append(" ")
        if tag == "a":
            self.in_link = True
        if tag not in VOID:
            outside = is_outside(tag, attributes, self.articles > 0)
            article = not outside and (tag in ("article", "main") or bool(re.search(r"role\s*=\s*[\"']?main\b", attributes)))
            if outside or article or tag in BLOCKS or tag in ("span", "ins", "b", "i", "em", "strong", "td", "th"):
                self.open.append((tag, outside, article))
                self.outside += outside
                self.articles += article

    def end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_line()
        if tag == "a" or tag in BLOCKS:
            self.in_link = False
        # Only a block ends what was left open inside it; an inline end tag stops at the next block.
        self._end_open({tag}, set() if tag in BLOCKS else BLOCKS)


def read(page: str) -> list[Line]:
    """The lines of a page, without those of parts that say they are outside its article."""
    reader, at, size = Reader(), 0, len(page)
    while at < size:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                reader.text(m[0])
            continue
        tag = tag.lower()
        if m[1]:
            reader.end(tag)
        elif tag in RAW:
            if tag in BLOCKS:
                reader.end_line()
            found = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = found.end() if found else at if m[3].endswith("/") else size
        else:
            reader.start(tag, m[3])
    reader.end_line()
    return reader.lines


def stretches(weights: list[float]) -> list[tuple[int, int, float]]:
    """(first, end, largest window sum) of each stretch between a rise from nothing and a fall to nothing."""
    n, out, i = len(weights), [], 0
    sums = [sum(weights[max(0, k - REACH) : k + REACH + 1]) for k in range(n)]
    while i < n:
        j = i
        while j < n and sums[j] > 0:
            j += 1
        if j > i:
            heavy = [k for k in range(i, j) if weights[k] > 0]
            out.append((heavy[0], heavy[-1] + 1, max(sums[i:j])))
        i = j + 1
    return out


def main_text(page: str | None) -> str:
    """The article's blocks, joined by one line feed."""
    lines = read(page) if page else []
    has_article = any(x.marked for x in lines)

    def weight(x: Line) -> float:
        if x.marked:
            return ARTICLE_FACTOR * (x.plain + 0.5 * x.linked)
        return (OTHER_FACTOR if has_article else 1.0) * x.plain

    found, at = [], 0
    for _, zone in groupby(lines, key=lambda x: x.marked):
        part = list(zone)
        found += [(at + a, at + b, top) for a, b, top in stretches([weight(x) for x in part])]
        at += len(part)
    kept = [(a, b) for a, b, top in found if top >= SURGE]
    if found and not kept:
        a, b, _ = max(found, key=lambda s: (sum(weight(x) for x in lines[s[0] : s[1]]), -s[0]))
        kept = [(a, b)]
    return "\n".join(x.text for a, b in kept for x in lines[a:b])


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """`keep` columns, text and n_chars of every page."""
    kinds = dict(pages.dtypes)

    def work():
        def step(columns, texts):
            found = [main_text(t) for t in texts]
            return {**dict(zip(keep, columns)), "text": found, "n_chars": [len(t) for t in found]}

        return step

    return map_texts(pages, [*keep, html], html, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", text string, n_chars long", work)
