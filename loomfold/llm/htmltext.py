"""Main text of HTML pages: parser events, text-to-tag ratios, smoothing, threshold clustering.

The standard library's streaming parser sends events. Block-level tags end a line; a line has its
text and the number of tags since the line before. What the markup itself names as menu, form,
advert, comment and so on is left out first: an element by its tag, role or hidden state, or by a
class or id whose words all name boilerplate or layout (`ad-slot`, `comments-area`; but not
`related-work`, `has-sidebar`). Of the lines that are left, the ratios of text to tags are smoothed
along the page with a Gaussian; the lines whose smoothed ratio reaches the standard deviation of
all are the content cluster. The cluster chooses the region: the innermost container of most of its
text, and then the whole that this is part of, be it an article element or what stands beside it
(see _region). Each line of the region is content, be it a title, short, a list or a link, but for a
last line that is a copyright notice and nothing else. No cluster, no text: ratios that are constant or
negated give other results.

Defined cases: null or empty html, and pages without content, give an empty text; a tag left open
ends with its parent or the page; a tag cut off by the end of the page is no text; a comment that
is never closed runs to the end; `<![` opens CDATA up to `]]>`, or else a comment up to `>`; a
character reference of any length is read, one beyond all code points as U+FFFD; an end tag
without a start is ignored, in constant time; white space inside a block becomes one space, blocks
are joined by a newline; texts of any length are read whole; an empty table has no rows.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfold.llm.common import pick

# Element and attribute names of HTML, and words that name boilerplate in class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
UNREAD = frozenset("script style noscript template svg math iframe object head title select option button textarea form nav aside footer dialog menu audio video canvas map".split())
UNSEEN = frozenset("script style noscript template svg math iframe object canvas map".split())  # interrupt no line
WHOLE = frozenset(("article", "main"))  # a header inside one is the article's own
CONTAINERS = frozenset("html body main article section div center table tbody tr td".split())
BOUNDS = frozenset("ul ol dl table article main body section div".split())  # what an end left out does not reach beyond
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BOILERPLATE = frozenset("ad ads adbox adsense adslot advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer gdpr hidden legal login masthead menu modal nav navbar navigation newsletter notice notification pager pagination paywall popular popup promo promoted promotion recommended recommendations related replies reply respond search share sharing sidebar signup skip skiplink social sponsor sponsored subscribe subscription teaser toolbar trending widget".split())
LAYOUT = frozenset("area bar block body bottom box center column container content fixed float footer global grid group header holder inner item items left link links list main outer page panel right row section site slot sticky top unit wrap wrapper".split())  # say nothing of themselves
HEADER = frozenset(("header",))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
SIGMA = 1.0
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


_CLOSE = re.compile(r"--!?>")
_CUT_OFF = re.compile(r"<[A-Za-z/!?]")
_CDATA, _CDATA_END = re.compile(r"(?i)<!\[\s*cdata\s*\["), re.compile(r"\]\s*\]\s*>")
# a line that is nothing but a notice: the sign, a year, a name without the end of a sentence in it
_NOTICE = re.compile(r"(?i)(?:(?:copyright|\(c\)|\u00a9)\s*)+[0-9]{4}(?:\s*[-\u2013]\s*[0-9]{4})?\b[^.!?]{0,80}(?:\.?|[.,]?\s*all rights reserved\.?)")
_LONG_NUMBER = re.compile(r"&#0*([0-9]{8,})")


class Line:
    __slots__ = ("text", "tags", "at", "linked")

    def __init__(self, text: str, tags: int, at: int, linked: bool = False):
        self.text, self.tags, self.at, self.linked = text, tags, at, linked


class _Reader(HTMLParser):
    """Events to lines that are not named boilerplate. The stack holds (tag, boilerplate?, inside a line?) of open elements,
    `places` the depths at which each tag is open. Elements that are not inside a line are numbered as they open (0: the
    page), so that those within element e are e to ends[e]."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack: list[tuple[str, bool, bool]] = []
        self.places: dict[str, list[int]] = {}
        self.bounds: list[int] = []
        self.open = [0]
        self.tag, self.parent, self.ends = ["html"], [0], [0]
        self.wholes = self.out = self.drops = 0
        self.parts: list[str] = []
        self.tags, self.linked = 0, False
        self.cdata_ends = True  # perhaps, further on

    def _named(self, tag: str, attrs: list) -> bool:
        """Whether the markup says that this is boilerplate."""
        if tag in UNREAD or tag == "header" and not self.wholes:
            return True
        if not attrs or tag in ("html", "body", "main") or tag in INLINE and tag not in ("span", "a"):
            return False
        said = dict(attrs)
        if "hidden" in said or said.get("aria-hidden") == "true" or "display:none" in (said.get("style") or "").replace(" ", ""):
            return True
        if (said.get("role") or "").lower() in ROLES:
            return True
        tells = BOILERPLATE if self.wholes else BOILERPLATE | HEADER
        for name in f"{said.get('class') or ''} {said.get('id') or ''}".split():
            words = {w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)}
            if words & tells and words <= tells | LAYOUT:
                return True
        return False

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text and not self.out:
            self.lines.append(Line(text, self.tags, self.open[-1], self.linked))
        if text:
            self.tags, self.linked = 0, False

    def _pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            if not self.stack[-1][2]:
                self._end_line()
            tag, named, inline = self.stack.pop()
            self.places[tag].pop()
            if tag in BOUNDS:
                self.bounds.pop()
            self.out -= named
            self.drops -= named and inline
            self.wholes -= tag in WHOLE
            if not inline:
                self.ends[self.open.pop()] = len(self.tag) - 1

    def _open(self, *tags: str) -> int:
        """Depth of the innermost open element of these, within the innermost of BOUNDS; else -1."""
        at = max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)
        return at if not self.bounds or at >= self.bounds[-1] else -1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        self.linked |= tag == "a"
        if tag in VOID:
            if tag == "hr":
                self._end_line()
            else:
                self.parts.append(" " if tag == "br" else "")
            return
        if tag in CLOSES_P and (at := self._open("p")) >= 0:
            self._pop_to(at)
        if tag in SELF_CLOSING and (at := self._open(*SELF_CLOSING[tag])) >= 0:
            self._pop_to(at)
        inline = tag in INLINE or tag in UNSEEN
        if not inline:
            self._end_line()
        named = self._named(tag, attrs)
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BOUNDS:
            self.bounds.append(len(self.stack))
        self.stack.append((tag, named, inline))
        self.out += named
        self.drops += named and inline  # boilerplate within a line is no part of it
        self.wholes += tag in WHOLE
        if not inline:
            self.parent.append(self.open[-1])
            self.open.append(len(self.tag))
            self.tag.append(tag)
            self.ends.append(0)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if self.places.get(tag):
            self._pop_to(self.places[tag][-1])

    def handle_data(self, data: str) -> None:
        if not self.drops:
            self.parts.append(data)

    def parse_comment(self, i: int, report: int = 1) -> int:
        found = _CLOSE.search(self.rawdata, i + 4)
        return found.end() if found else len(self.rawdata)  # never closed: to the end

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        if self.cdata_ends and _CDATA.match(self.rawdata, i):
            if found := _CDATA_END.search(self.rawdata, i):
                return found.end()
            self.cdata_ends = False
        return self.rawdata.find(">", i) + 1 or len(self.rawdata)

    def finish(self) -> None:
        self.close()
        self._pop_to(0)
        self._end_line()
        self.ends[0] = len(self.tag) - 1


def ratios(lines: list[Line]) -> np.ndarray:
    """Code points of text for each tag."""
    return np.array([len(line.text) / max(1, line.tags) for line in lines], float)


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(values, reach, mode="edge"), kernel / kernel.sum(), "valid")


def clustered(lines: list[Line]) -> np.ndarray:
    """Whether each line is in the content cluster. Of ratios from 0 up one line at least is."""
    flat = smoothed(ratios(lines))
    return flat >= flat.std()


def _sums(reader: _Reader, amounts: list[tuple[int, int]]) -> list[int]:
    """For each element the sum of the (element, amount) in it."""
    out = [0] * len(reader.tag)
    for at, n in amounts:
        out[at] += n
    for e in range(len(out) - 1, 0, -1):
        out[reader.parent[e]] += out[e]
    return out


def _region(reader: _Reader, cluster: np.ndarray) -> list[int]:
    """The elements that the cluster chooses, whose lines are the text.

    The search goes down from the page while one container holds more than half of the cluster's text and nothing beside
    it holds lines of the cluster among several. What it finds is part of a whole: the article or main element around it. Without one it goes up again, as long as
    all that stands beside it is text as well: a block of a tag for text, or one with a line of the cluster, or in which
    no more than half of the lines have links. At the page's own level only the headings right before it are taken."""
    lines = reader.lines
    text = _sums(reader, [(line.at, len(line.text)) for line, chosen in zip(lines, cluster) if chosen])
    said = _sums(reader, [(line.at, len(line.text)) for line in lines])
    linked = _sums(reader, [(line.at, int(line.linked)) for line in lines])
    number = _sums(reader, [(line.at, 1) for line in lines])
    children: dict[int, list[int]] = {}
    for e in range(1, len(reader.tag)):
        if said[e]:
            children.setdefault(reader.parent[e], []).append(e)

    def reads(e: int) -> bool:
        return reader.tag[e] not in CONTAINERS or text[e] > 0 or 2 * linked[e] <= number[e]

    at = 0
    while best := next((e for e in children.get(at, ()) if reader.tag[e] in CONTAINERS and 2 * text[e] > text[at]), 0):
        if any(text[e] and number[e] > 1 for e in children[at] if e != best):
            break
        at = best
    up = at
    while up:
        if reader.tag[up] in WHOLE:
            return [up]
        up = reader.parent[up]
    while at and reader.tag[reader.parent[at]] not in ("html", "body") and all(reads(e) for e in children[reader.parent[at]] if e != at):
        at = reader.parent[at]
    found, beside = [at], children.get(reader.parent[at], []) if at else []
    for e in reversed(beside[: beside.index(at)] if at in beside else []):
        if reader.tag[e] not in HEADINGS:
            break
        found.append(e)
    return found


def main_text(html: str) -> str:
    cut = _CUT_OFF.search(html, html.rfind(">") + 1)
    html = html[: cut.start()] if cut else html
    reader = _Reader()
    # eight digits are beyond all code points, as more are, which Python does not read
    reader.feed(_LONG_NUMBER.sub(lambda m: f"&#{m[1][:8]}", html))
    reader.finish()
    lines = reader.lines
    if not lines:
        return ""
    cluster = clustered(lines)
    if not cluster.any():
        return ""
    chosen = _region(reader, cluster)
    inside = [line.text for line in lines if any(e <= line.at <= reader.ends[e] for e in chosen)]
    if len(inside) > 1 and _NOTICE.fullmatch(inside[-1]):
        inside.pop()
    return "\n".join(inside)


@F.arrow_udf(T.StringType())
def _main_text(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(p.as_py() or "") for p in pages], pa.string())


def extracted(html: Column) -> Column:
    """The main text of a page; never null."""
    return _main_text(html)


def articles(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """For each page its id, url, main text, and the text's code points."""
    found = pick(pages, page_id, url, html).select(page_id, url, extracted(F.col(html)).alias("text"))
    return found.select(page_id, url, "text", F.char_length("text").cast("long").alias("n_chars"))
