"""Main text of web pages (operator 3).

The standard library's parser is fed each page and its events are taken as they come: a stack of open elements, and a
*line* for every block of text (all text between two block-level tags).  Each line has a text-to-tag ratio; the ratios
are smoothed by a Gaussian along the page, and lines whose smoothed ratio reaches the standard deviation form the
content clusters.  The clusters choose the content region: the ``article`` or ``main`` elements that hold their
text (see :func:`article_regions` for several of them), or else the deepest element that holds all of it.  All lines of the
region are returned, however short, except those inside elements that are no article text (menus, headers, footers,
adverts, comments ...).  A ``form``, an ``aside``, or a word of a class or id (``MARKS``) only suggests such an element: it counts
where the element holds a minor share (``MINOR_PART``, ``MINOR_WHOLE``) of the page's content text, so a wrapper of the page or of the
article stays text whatever its name, or where it is named after comments and follows the article.

Edge cases: null or empty html gives an empty text; markup that never closes or is cut off ends with the page; a page
without cluster falls back to all lines outside excluded elements; repeated rows are extracted each on its own.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard, by their part in a page.
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary
table tbody td tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset("""audio button canvas dialog footer head iframe math menu nav noscript object search select
script style svg template textarea title video""".split())
#: Elements that are side matter unless they hold the page: a form around everything, an aside that never closes.
SIDE = frozenset("aside form".split())
IN_HEAD = frozenset("base link meta noscript script style template title head html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
REGION = frozenset("article main section div td body".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Words in a class or id that mark an element as no article text.
MARKS = frozenset("""ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs captcha comment
commentlist comments consent cookie cookies copyright disclaimer disqus foot footer form gdpr login masthead menu modal
nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion
related replies reply search share sharing sidebar signup social sponsor sponsored subscribe subscription teaser toolbar
widget""".split())
#: Words in a class or id of reader comments, and words beside them that name the article instead ("post comments-open").
COMMENTS = frozenset("comment commentlist comments disqus replies reply".split())
ARTICLE_WORDS = frozenset("article entry main page post story wrapper".split())
#: Content text from which something is an article of its own, so that comments and the like may follow it.
ARTICLE_CHARS = 120
#: Share of link text from which an article beside the main one is a teaser.
TEASER_LINKS = 0.2
#: Share of the page's content text from which an element is no side matter, where a mark is a whole class or id, or a part of one.
MINOR_WHOLE, MINOR_PART = 0.9, 0.5
#: An element that opens ends the open elements named here (up to the nearest element of the second set).
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "option": ({"option"}, {"select"})}
#: A tag that the end of the page cuts off.
UNFINISHED = re.compile(r"<[!/?a-zA-Z][^<>]*\Z")
ENDS_P = BLOCK - {"html", "body", "head", "title"}


class _Element:
    __slots__ = ("tag", "skip", "header", "region", "mark")

    def __init__(self, tag, skip, header, region, mark):
        self.tag, self.skip, self.header, self.region, self.mark = tag, skip, header, region, mark


class PageLines(HTMLParser):
    """Collects lines as ``(text, tags, skipped, region, link characters, mark)``, regions as ``(tag, parent)`` and, of the
    innermost marked element around each line, the next one outside, the share that clears it, and whether it is named after
    comments (``marks``; 0 is none)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, bool, int, int, int]] = []
        self.marks: list[tuple[int, float, bool]] = [(-1, 0.0, False)]
        self.regions: list[tuple[str, int]] = [("body", -1)]
        self.stack: list[_Element] = []
        self.open: dict[str, int] = defaultdict(int)
        self.parts: list[str] = []
        self.skipped: list[str] = []
        self.tags = 0
        self.link = 0

    def _skips(self) -> bool:
        if not self.stack:
            return False
        top = self.stack[-1]
        return top.skip or top.header and not any(e.tag in HEADINGS for e in self.stack)

    def _end_line(self):
        for parts, skip in ((self.parts, False), (self.skipped, True)):
            if parts and (text := " ".join("".join(parts).split())):
                top = self.stack[-1] if self.stack else None
                self.lines.append((text, self.tags, skip, top.region if top else 0, self.link, top.mark if top else 0))
                self.tags = 0
        self.parts, self.skipped, self.link = [], [], 0

    def _drop(self, k: int):
        """Close the open elements from the ``k``-th on."""
        for e in self.stack[k:]:
            self.open[e.tag] -= 1
        del self.stack[k:]

    def _close(self, k: int):
        self._end_line()
        self._drop(k)

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            (self.skipped if self._skips() else self.parts).append(" ")
            return
        if tag in BLOCK:
            self._end_line()
            self._implied_ends(tag)
        if tag in VOID:
            return
        top = self.stack[-1] if self.stack else None
        skip = bool(top and top.skip) or tag in NO_TEXT
        header = bool(top and top.header)
        mark = top.mark if top else 0
        if not skip and tag not in ("html", "body", "main"):
            names = ()
            if tag in SIDE:
                self.marks.append((mark, MINOR_WHOLE, False))
                mark = len(self.marks) - 1
            if attrs:
                a = {k: (v or "") for k, v in attrs}
                names = set(re.split(r"[^a-z0-9]+", f"{a.get('class', '')} {a.get('id', '')}".lower()))
                skip = (a.get("role", "").lower() in ROLES or "hidden" in a
                        or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", ""))
                if not skip and names & MARKS:
                    self._end_line()
                    whole = f"{a.get('class', '')} {a.get('id', '')}".lower().split()
                    self.marks.append((mark, MINOR_PART if MARKS.isdisjoint(whole) else MINOR_WHOLE,
                                       bool(names & COMMENTS) and not names & ARTICLE_WORDS))
                    mark = len(self.marks) - 1
            if not skip and (tag == "header" or "header" in names):
                # a header inside the article keeps its headings
                skip, header = not (self.open["article"] or self.open["main"]), True
        region = top.region if top else 0
        if tag in REGION:
            self.regions.append((tag, region))
            region = len(self.regions) - 1
        self.open[tag] += 1
        self.stack.append(_Element(tag, skip, header, region, mark))

    def _last(self, tags, within=()) -> int:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag in tags:
                return k
            if self.stack[k].tag in within:
                break
        return -1

    def _implied_ends(self, tag):
        """Elements that end, without an end tag, where ``tag`` begins."""
        if self.open["head"] and tag not in IN_HEAD:
            self._close(self._last(("head",)))
        if tag in ENDS_P and self.open["p"]:
            self._close(self._last(("p",)))
        if tag in CLOSES and (k := self._last(*CLOSES[tag])) >= 0:
            self._close(k)
        if tag in ("article", "main"):
            # a menu, header, footer or form that never closed ends where the article begins
            while (k := self._last(("nav", "header", "footer", "form"), ("article", "main"))) >= 0:
                self._close(k)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK:
            self._end_line()
            if self.open[tag] > 0 and tag not in ("html", "body"):
                self._drop(self._last((tag,)))
        elif self.open[tag] > 0 and (k := self._last((tag,), BLOCK)) >= 0:
            if self.stack[-1].mark != (self.stack[k - 1].mark if k else 0):
                self._end_line()
            self._drop(k)

    def handle_data(self, data):
        if self._skips():
            self.skipped.append(data)
            return
        self.parts.append(data)
        if self.open["a"] > 0:
            self.link += len(data)

    def close(self):
        super().close()
        self._end_line()


def content_clusters(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Which lines belong to content: Gaussian-smoothed ratio at least the standard deviation of all of them."""
    radius = max(1, int(round(2 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    smooth = np.convolve(np.pad(ratios, radius, mode="edge"), kernel / kernel.sum(), mode="valid")
    return smooth >= smooth.std()


def side_matter(page: PageLines, weight: np.ndarray) -> np.ndarray:
    """Which lines lie in a marked element that is no article text.

    That is one which holds a minor share of the content text (``weight``), or one that is named after comments and
    begins after the text of an article: its share is no sign then, as a page may have more comments than text.
    """
    at = [x[5] for x in page.lines]
    held, first = np.zeros(len(page.marks)), np.full(len(page.marks), len(at))
    for j in range(len(at) - 1, -1, -1):
        held[at[j]] += weight[j]
        first[at[j]] = j
    for m in range(len(held) - 1, 0, -1):  # inner marks come after the outer ones
        outer = page.marks[m][0]
        held[outer] += held[m]
        first[outer] = min(first[outer], first[m])
    side = np.zeros(len(held), bool)
    seen, before = 0, 0.0  # lines, and content text that is no side matter, before the mark: marks are in page order
    for m in range(1, len(held)):
        outer, share, comments = page.marks[m]
        while seen < first[m]:
            before += 0.0 if side[at[seen]] else weight[seen]
            seen += 1
        side[m] = (side[outer] or held[m] < share * weight.sum() or not weight.any()
                   or comments and before >= ARTICLE_CHARS)
    return side[at]


def article_regions(page: PageLines, held: np.ndarray, text: np.ndarray, links: np.ndarray) -> tuple[set[int], set[int]]:
    """The ``article`` or ``main`` elements that are the article, and elements inside these that are not.

    ``held`` is the content text of each region, ``text`` and ``links`` all its text and link text.  Of nested elements with
    the same text the inner one is taken; elements side by side all are, but for teasers, whose text is links in good part.  An
    ``article`` inside an article that has text of its own is a comment on it.
    """
    tags, parents = [t for t, _ in page.regions], [p for _, p in page.regions]

    def above(r):
        while r >= 0:
            yield r
            r = parents[r]
    named = [r for r, tag in enumerate(tags) if tag in ("article", "main") and held[r] > 0]
    best, around = set(), set()
    for r in sorted(named, key=lambda r: (held[r], r), reverse=True):
        if r not in around and best.isdisjoint(above(r)):
            best.add(r)
            around.update(above(r))

    def teaser(r):
        return links[r] >= TEASER_LINKS * max(text[r], 1)
    if best and not teaser(top := max(best, key=lambda r: held[r])):
        best = {r for r in best if r == top or not teaser(r)}
    out = set()
    for r in best:
        inner = [n for n in named if n != r and tags[n] == "article" and r in above(n)]
        outermost = [n for n in inner if not any(o != n and o in inner for o in above(n))]
        # a wrapper holds one article and siblings of it; an article holds text of its own, and comments
        own = held[r] - sum(held[n] for n in outermost)
        if tags[r] == "article" and own >= ARTICLE_CHARS:
            out.update(outermost)
        elif len(outermost) > 1 and not teaser(top := max(outermost, key=lambda n: held[n])):
            out.update(n for n in outermost if n != top and teaser(n))
    return best, out


def main_text(html: str | None, sigma: float = 1.0, share: float = 1.0) -> str:
    """The article of one page, blocks in page order joined by an empty line."""
    if not html:
        return ""
    page = PageLines()
    page.feed(UNFINISHED.sub("", html))
    page.close()
    lines = page.lines
    if not lines:
        return ""
    size = np.array([len(x[0]) for x in lines], float)
    content = content_clusters(size / np.array([max(1, x[1]) for x in lines]), sigma)
    usable = np.array([not x[2] for x in lines])
    usable &= ~side_matter(page, size * (content & usable) if (content & usable).any() else size * usable)
    weight = size * (content & usable)
    if not weight.any():
        weight = size * usable
    if not weight.any():
        return ""
    sums = np.zeros((3, len(page.regions)))  # content text, all text, link text
    for j, x in enumerate(lines):
        if usable[j]:
            sums[:, x[3]] += weight[j], size[j], x[4]
    for r in range(len(page.regions) - 1, 0, -1):  # children come after their parents
        sums[:, page.regions[r][1]] += sums[:, r]
    held = sums[0]
    best, out = article_regions(page, held, sums[1], sums[2])
    named = bool(best)
    if not named:
        best = {max((r for r in range(len(held)) if held[r] >= share * held[0]), default=0)}
    inside = [False] * len(page.regions)
    for r, (_, parent) in enumerate(page.regions):
        inside[r] = r not in out and (r in best or (parent >= 0 and inside[parent]))
    return "\n\n".join(x[0] for x, ok, c in zip(lines, usable, content)
                       if ok and inside[x[3]] and (named or c or 2 * x[4] <= len(x[0])))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(h.as_py()) for h in b.column(2)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["key", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key, url, text, n_chars`` for every page; ``n_chars`` counts code points."""
    key_type = pages.schema[key].dataType.simpleString()
    out = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"),
                       F.col(html).cast("string").alias("html"))
    return out.mapInArrow(_extract, f"key {key_type}, url string, text string, n_chars long").withColumnRenamed("key", key)
