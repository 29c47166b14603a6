"""Main text of web pages: text-to-tag ratios of lines, smoothed and cut at a threshold.

The standard library's parser streams events; no tree is built.  A block's text is a line, with the
characters outside links, the tags met since the line before, and the number of its block element.  The ratio of characters to tags,
smoothed by a Gaussian over the lines, is high inside running text and low in menus and frames;
lines above the standard deviation of the smoothed ratios (or their mean, if that is lower) are the content cluster.

The region is the element that holds the cluster: the ``article`` (else ``main``) with most of it, else the deepest
element with nearly all of it.  A region is taken whole, short paragraphs too, but for
what markup names as something else: frames of the page, forms, notices, adverts, comments.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import rebatch, text_of

#: Lines that the Gaussian reaches to either side, and its standard deviation in lines.
REACH, SIGMA = 3, 1.0
#: Share of the content cluster that an element must hold for the region to move down into it.
HOLDS = 0.85
#: Times the text outside frames that an article inside one must have to count (a wrapper may be named like a frame).
WRAPPED = 4
#: Links of a list or row that is nothing but links, from which on it is a menu.
MENU_LINKS = 3
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
                   "legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul "
                   "audio button canvas iframe noscript object script style svg template textarea video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are part of a region and never one.
INNER = HEADINGS | frozenset("p li ul ol dl dd dt blockquote pre figure figcaption section".split())
#: Elements that are never part of an article.
APART = frozenset("aside audio button canvas dialog fieldset footer form head iframe menu nav noscript object option script search select style svg template textarea title video".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Words of class and id that name something else than the article.
NAMED = frozenset("ad ads adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs colophon comment commentlist comments consent cookie cookies copyright disclaimer discussion disqus footer gdpr "
                  "header login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination paywall popular popup promo promoted promotion recommendations recommended "
                  "related replies reply respond responses search share sharebar sharing sidebar signup skyscraper social sponsor sponsored subscribe subscription teaser toolbar topbar trending widget widgets".split())
REPLIES = frozenset("comment commentlist comments discussion disqus replies reply respond responses".split())
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
_COMMENTS = re.compile(r"(?:\d+\s+)?(?:reader |user )?(?:comments?|responses|replies|leave a (?:comment|reply)|kommentare?|commentaires?|comentarios?)(?:\s*\(?\d*\)?)\s*:?", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Start tags that end an open element of these kinds (markup often leaves its end tag out).
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead"), "tfoot": ("tr", "td", "th", "tbody")}
SCOPES = frozenset("table ul ol dl select".split())


def _whole(html: str) -> str:
    """*html* up to a comment or tag that never ends, which would take the rest of the page."""
    at = html.find("<!--", html.rfind("-->") + 1)
    if at >= 0:
        html = html[:at]
    tail = html.rfind(">") + 1
    cut = re.search(r"<[a-zA-Z/!?]", html[tail:])
    return html[:tail + cut.start()] if cut else html


class Lines(HTMLParser):
    """Blocks as lines, and block elements by number in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.apart, self.reply = [-1], [""], [False], [False]
        self.open: list[tuple[str, int]] = []  # every open element and its block element's number
        self.named: Counter = Counter()
        self.lines: list[tuple[int, str, int, int, int]] = []  # element, text, characters outside links, tags, links
        self.pieces: list[str] = []
        self.linked = self.tags = self.links = 0

    @property
    def here(self) -> int:
        return self.open[-1][1] if self.open else 0

    def _end_line(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            self.lines.append((self.here, text, max(0, len(text) - self.linked), self.tags, self.links))
        if text or self.pieces:
            self.linked = self.tags = self.links = 0
        self.pieces = []

    def _pop(self, to: int) -> None:
        for tag, _ in self.open[to:]:
            self.named[tag] -= 1
        del self.open[to:]

    def _apart(self, tag: str, attrs: dict[str, str]) -> tuple[bool, bool]:
        """Whether the element is no part of an article, and whether it holds readers' comments."""
        within = self.named["article"] or self.named["main"]
        if not attrs:
            return tag in APART or tag == "header" and not within, False
        words = {w.lower() for w in _WORD.findall(f"{attrs.get('class') or ''} {attrs.get('id') or ''}")}
        reply = bool(words & REPLIES) and not (tag in ("html", "body", "main") or tag == "article" and not self.named["article"])
        if tag in ("html", "body", "main") or tag == "article":
            return reply, reply
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(_HIDDEN.search(attrs.get("style") or ""))
        frame = tag in APART or tag == "header" and not within or (attrs.get("role") or "").lower() in ROLES
        named = bool(words & NAMED) and not (tag in HEADINGS or tag == "header" and within)
        return frame or hidden or named or reply, reply

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self._end_line()
            if self.named["p"] and tag not in ("script", "style", "template", "noscript"):  # a paragraph ends where a block begins
                self._close("p")
            for other in ENDS.get(tag, ()):
                if self.named[other]:
                    self._close(other, SCOPES)
            apart, reply = self._apart(tag, dict(attrs))
            if tag != "hr":
                self.parent.append(self.here)
                self.tag.append(tag)
                self.apart.append(apart)
                self.reply.append(reply)
                self.open.append((tag, len(self.tag) - 1))
                self.named[tag] += 1
        elif tag in VOID:
            if tag in ("br", "wbr"):
                self.pieces.append(" " if tag == "br" else "")
        else:
            self.open.append((tag, self.here))
            self.named[tag] += 1
            self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("script", "style", "svg", "iframe", "path", "use"):  # elsewhere the slash means nothing
            self.handle_endtag(tag)

    def _close(self, tag: str, within: frozenset[str] = frozenset()) -> None:
        """End the innermost open *tag*, unless an element of *within* began inside it."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if tag in BLOCKS:
                    self._end_line()
                self._pop(i)
                return
            if self.open[i][0] in within:
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if self.named[tag]:
            self._close(tag, frozenset(("td", "th")) if tag not in ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "body", "html") else frozenset())
        elif tag in ("p", "br"):
            self._end_line() if tag == "p" else self.pieces.append(" ")

    def handle_data(self, data: str) -> None:
        self.pieces.append(data)
        if self.named["a"] > 0:
            self.linked += len("".join(data.split()))

    def updatepos(self, i: int, j: int) -> int:
        return j  # nobody asks for line numbers

    def finish(self) -> None:
        self.close()
        self._end_line()


def smoothed(ratios: np.ndarray) -> np.ndarray:
    kernel = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SIGMA) ** 2)
    return np.convolve(ratios, kernel / kernel.sum())[REACH:REACH + len(ratios)]


def _lifted(values: list[float], parent: list[int], stop: list[bool] | None = None) -> list[float]:
    """Sums over the elements below each one, leaving out what lies below an element of *stop*."""
    for i in range(len(values) - 1, 0, -1):
        if values[i] and not (stop and stop[i]):
            values[parent[i]] += values[i]
    return values


def _region(page: Lines, content: list[float], open_: list[bool], parent: list[int], apart: list[bool], bad: list[int]) -> int:
    """The element that holds the content cluster."""
    held, whole = [0.0] * len(parent), [0.0] * len(parent)
    for (n, _, all_, *_), chars, o in zip(page.lines, content, open_):
        held[n] += chars
        whole[n] += all_ * o
    _lifted(held, parent, apart), _lifted(whole, parent, apart)
    for kind, held_ in (("article", held), ("article", whole), ("main", held), ("main", whole)):
        found = [i for i in range(1, len(parent)) if page.tag[i] == kind and not apart[i] and held_[i] > 0 and not page.reply[bad[i]]]
        if found := [i for i in found if bad[i] == 0] or [i for i in found if held_[i] > WRAPPED * held_[0]]:
            best = max(found, key=lambda i: (held_[i], -i))
            outer = sum(held_[i] for i in found if parent[i] == parent[best])
            return best if held_[best] >= 0.5 * outer else parent[best]
    at, children = 0, [[] for _ in parent]
    for i in range(1, len(parent)):
        if not apart[i] and held[i] > 0:
            children[parent[i]].append(i)
    while True:
        down = [i for i in children[at] if held[i] >= HOLDS * held[0] and page.tag[i] not in INNER]
        if not down:
            return at
        at = down[0]


def _menus(page: Lines, parent: list[int]) -> list[int]:
    """Lists that are nothing but links, and single lines that are."""
    loose, links = [0.0] * len(parent), [0.0] * len(parent)
    for n, text, chars, _, many in page.lines:
        loose[n] += chars > 0.2 * len(text) if many else bool(text.strip(" |/·•»>,-"))
        links[n] += many
    if sum(links) < MENU_LINKS:
        return []
    _lifted(loose, parent), _lifted(links, parent)
    return [i for i in range(1, len(parent)) if loose[i] == 0 and links[i] >= MENU_LINKS and page.tag[i] in ("ul", "ol", "p", "div", "table", "tr", "td", "dl", "section")]


def _innermost(apart: list[bool], parent: list[int]) -> list[int]:
    """The innermost element of *apart* around each one, itself included (0: none)."""
    out = [0] * len(parent)
    for i in range(1, len(parent)):
        out[i] = i if apart[i] else out[parent[i]]
    return out


def extract(html: str | None) -> str:
    """The main text of one page: its blocks, joined by line feeds."""
    page = Lines()
    page.feed(_whole(html or ""))
    page.finish()
    if not page.lines:
        return ""
    parent, apart = page.parent, page.apart
    for i in _menus(page, parent):
        apart[i] = True
    bad = _innermost(apart, parent)
    if all(bad[n] for n, *_ in page.lines):  # a form may wrap the whole page
        apart = [a and t not in ("form", "fieldset") for a, t in zip(apart, page.tag)]
        bad = _innermost(apart, parent)
    home = [t in ("article", "main") for t in page.tag]
    for i in range(1, len(parent)):
        home[i] = home[i] or home[parent[i]]
    open_ = [not bad[n] or home[n] and page.tag[n] not in ("script", "style") and not page.reply[bad[n]] for n, *_ in page.lines]  # an article counts in whatever it stands
    even = smoothed(np.array([chars / max(1, tags) if o else 0.0 for (_, _, chars, tags, _), o in zip(page.lines, open_)]))
    cluster = even >= max(min(even.std(), even.mean()), 1e-9)
    content = [float(chars) if o and c else 0.0 for (_, _, chars, _, _), o, c in zip(page.lines, open_, cluster.tolist())]
    root = _region(page, content, open_, parent, apart, bad)
    below = [i == root for i in range(len(parent))]
    for i in range(root + 1, len(parent)):
        below[i] = below[parent[i]]
    kept = [i for i, (n, *_) in enumerate(page.lines) if below[n] and bad[n] <= root]
    if page.tag[root] not in ("article", "main"):
        kept = _clustered(page, kept, content, root, parent)
    kept = _before_comments(page, kept, parent)
    return "\n".join(page.lines[i][1] for i in _headline(page, kept, bad) + kept)


def _up(node: int, parent: list[int]) -> Iterator[int]:
    while node > 0:
        yield node
        node = parent[node]


def _clustered(page: Lines, kept: list[int], content: list[float], root: int, parent: list[int]) -> list[int]:
    """Without an element made for articles: the children of the region from its first to its last content line, a heading before and blocks of the same kind around them."""
    child = [root] * len(parent)
    for n in range(root + 1, len(parent)):
        child[n] = n if parent[n] == root else child[parent[n]]
    owner = {i: child[page.lines[i][0]] for i in kept}
    good = {owner[i] for i in kept if content[i] > 0 and owner[i] != root}
    kinds = {(page.tag[page.lines[i][0]], parent[page.lines[i][0]]) for i in kept if content[i] > 0}
    first = min((i for i in kept if content[i] > 0), default=0)
    last = max((i for i in kept if content[i] > 0), default=-1)

    def wanted(i: int) -> bool:
        node = page.lines[i][0]
        tag = page.tag[node]
        if content[i] > 0 or owner[i] in good:
            return True
        if (tag, parent[node]) in kinds and tag in ("p", "li", "blockquote", "pre", "td", "dd", "dt"):
            return True
        linked = page.lines[i][2] < 0.5 * len(page.lines[i][1])
        return not linked and (first < i < last or tag in HEADINGS and i < first)

    return [i for i in kept if wanted(i)]


def _before_comments(page: Lines, kept: list[int], parent: list[int]) -> list[int]:
    """Lines without those that stand under a heading of readers' comments."""
    out, within = [], None
    for i in kept:
        node, text = page.lines[i][:2]
        if within is not None and within in (0, *_up(node, parent)):
            continue
        within = None
        if page.tag[node] in HEADINGS and _COMMENTS.fullmatch(text):
            within = parent[node]
            continue
        out.append(i)
    return out


def _headline(page: Lines, kept: list[int], bad: list[int]) -> list[int]:
    """The page's one top heading, if the region starts without a heading and the former stands before it."""
    top = [i for i, (n, *_) in enumerate(page.lines) if page.tag[n] == "h1" and bad[n] == 0]
    if kept and len(top) == 1 and top[0] < kept[0] and page.tag[page.lines[kept[0]][0]] not in HEADINGS:
        return top
    return []


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rebatch(batches, 256):
        texts = [extract(h) for h in batch.column("__html").to_pylist()]
        keep = [n for n in batch.schema.names if n != "__html"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], pa.array(texts, pa.string())], [*keep, "text"])


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of *pages*: ``page_id, url, text, n_chars``; the article's blocks in page order, one a line.

    Character references are decoded, white space inside a block is one space.  A null or empty page, or one
    without an article, has an empty text.  Rows are told apart by nothing: repeated rows, null ids and urls come back as they
    are.  A page of any length is read whole.  An empty table gives an empty table; other columns are ignored.
    """
    asked = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_of(html_col).alias("__html"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema if f.name != "__html")
    return asked.mapInArrow(_texts, f"{fields}, text string").withColumn("n_chars", F.length("text").cast("long"))
