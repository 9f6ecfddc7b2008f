"""Main text of web pages by text-to-tag ratios.

The standard library's streaming parser gives events; block-level tags cut
them into lines, and each line keeps its text, its number of tags and what it
stands in.  A line's ratio is its characters for each tag.  What the markup
says goes before the ratios: lines in menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments are never content.
Over all other lines the ratios decide: their logarithms, level from ``FULL``
characters a tag on and raised by ``BONUS`` in a marked article, are smoothed
with a Gaussian and split in two clusters (one-dimensional 2-means).  The upper
cluster is content; so is the lower if its mean is less than ``APART`` below,
a heading before a line of content, and up to ``BETWEEN`` lines between others or at the ends of an article.
Names of classes and ids that may be a topic (discussion, legal, related) part
nothing inside an article, and names of headings there nothing at all.

Cases: null and empty pages have empty text; markup may be cut off or left
open anywhere; a page without any tag is one block; repeated rows give
repeated results; an empty table gives no row; other columns aren't read.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, texts_of

#: Width of the Gaussian in lines, and the lines it reaches to either side.
SIGMA, REACH = 1.0, 3
#: Characters a tag of running text; what an article adds to the logarithm, and how far apart the means of two kinds of lines are.
#: An article alone parts nothing, as BONUS < APART.
FULL, BONUS, APART = 40.0, 1.0, 1.5
#: Lines in a row that are kept between two lines of content.
BETWEEN = 2

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never content.
DROPPED = frozenset("head nav footer aside form script style noscript template iframe object svg canvas button select textarea dialog menu title audio video".split())
PAGE_PARTS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|signup|sign-up|login|search|sidebar|side-bar|rail|widget|menu|navbar|nav|navigation|breadcrumbs?|toolbar|masthead|site-header|page-header|top-bar|topbar|footer|foot|copyright|legal|share|sharing|social|related|recommend\w*|pagination|pager|skip-link|comments?|comment-\w+|disqus|discussion|replies|respond)(?:$|[\s_-])", re.I)
#: Inside an article: a whole class or id, so that ``share-prices`` is a topic.
ARTICLE_PARTS = re.compile(r"(?:^|\s)(?:(?:ads?|advert\w*|adsense|sponsor(?:ed)?|promo\w*|cookies?|newsletter|subscribe|signup|sign-up|sidebar|side-bar|widget|menu|navbar|nav|navigation|breadcrumbs?|toolbar|share|sharing|social|pagination|pager|comments?|disqus)(?:[_-](?:ads?|area|banner|bar|block|box|button|buttons|container|content|form|inner|item|items|link|links|list|menu|notice|section|slot|thread|unit|widget|wrapper|wrap|\d+))*|comment-\w+|(?:related|recommended)[_-](?:articles?|links?|posts?|stories)|skip-link)(?:$|\s)", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
CONTENT_ROLES = frozenset("main article".split())
#: An end tag isn't looked for beyond these.
FENCES = {"p": frozenset("article section div main body td th li blockquote".split()), "li": frozenset("ul ol menu".split())}
SPACE = re.compile(r"\s+")


class Lines(HTMLParser):
    """Collects [text, tags, inside an article, heading] for each line.  Data and tags in what is never content don't count, wherever in a line it stands."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool]] = []  # tag, drops, is an article
        self.places: dict[str, list[int]] = {}  # of each tag that is open, in the stack
        self.drops = self.articles = self.headings = 0
        self.lines: list[list] = []
        self.parts: list[str] = []
        self.tags = 0

    def cut(self) -> None:
        if self.parts:
            text = SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.lines.append([text, self.tags, self.articles > 0, self.headings > 0])
                self.tags = 0
            self.parts = []

    def pop_to(self, at: int) -> None:
        for tag, drops, article in self.stack[at:]:
            self.drops -= drops
            self.articles -= article
            self.headings -= tag in HEADINGS
            self.places[tag].pop()
        del self.stack[at:]

    def last(self, *tags: str) -> int:
        """Place of the last open one of the tags, -1 without one."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def handle_starttag(self, tag, attrs):
        self.tags += not self.drops
        if tag in BLOCKS:
            if not self.drops:
                self.cut()
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") or tag[0] == "h" and tag[1:].isdigit():
                self.close_open("p" if tag[0] == "h" else tag)
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        found = dict(attrs)
        role = (found.get("role") or "").lower()
        named = f"{found.get('class') or ''} {found.get('id') or ''}".strip()
        article = (tag in ("article", "main") or role in CONTENT_ROLES or found.get("itemprop") == "articleBody") and not (named and PAGE_PARTS.search(named))
        drops = tag in DROPPED or role in ROLES or "hidden" in found or found.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", found.get("style") or "", re.I)) or (tag == "header" and not self.articles)
        if not drops and named and tag not in ("html", "body", "main", "p", "h1", "b", "i", "em", "strong", "a") and not article:
            parts = ARTICLE_PARTS if self.articles else PAGE_PARTS
            drops = not (self.articles and tag in HEADINGS) and bool(parts.search(named))
        if article and not drops and self.drops and not any(t in ("aside", "form", "template", "noscript", "dialog") for t, d, _ in self.stack if d) and tag in ("article", "main") and not self.articles:
            # a menu or advert left open before the article begins
            self.pop_to(next(i for i, x in enumerate(self.stack) if x[1]))
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, drops, article))
        self.drops += drops
        self.articles += article
        self.headings += tag in HEADINGS

    def close_open(self, tag: str) -> None:
        at = self.last(tag)
        if at > self.last(*FENCES.get(tag, ("table", "dl", "select", "article", "body"))):
            self.pop_to(at)

    def handle_endtag(self, tag):
        self.tags += not self.drops
        if tag in BLOCKS and not self.drops:
            self.cut()
        if tag in VOID:
            return
        at = self.last(tag)
        if at >= 0 and (tag in ("main", "body", "html") or at >= self.last("article", "main", "body")):
            self.pop_to(at)

    def handle_data(self, data):
        if not self.drops:
            self.parts.append(data)

    def unknown_decl(self, data):
        pass

    def end(self) -> None:
        self.close()
        self.cut()


def smooth(x: np.ndarray, sigma: float = SIGMA, reach: int = REACH) -> np.ndarray:
    """Gaussian mean of each value and its neighbours; weights beyond the ends fall away."""
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = np.convolve(np.ones(len(x)), kernel)[reach : reach + len(x)]
    return np.convolve(x, kernel)[reach : reach + len(x)] / full


def threshold(x: np.ndarray) -> float:
    """Boundary between the two clusters of 2-means on a line; the least value if they aren't ``APART``."""
    least = low = float(x.min())
    high = float(x.max())
    if high - low < APART:
        return least
    for _ in range(50):
        cut = (low + high) / 2
        a, b = float(x[x < cut].mean()), float(x[x >= cut].mean())
        if (a, b) == (low, high):
            break
        low, high = a, b
    return (low + high) / 2 if high - low >= APART else least


def content(lines: list[list]) -> np.ndarray:
    """Which of the lines that the markup leaves are content."""
    ratios = np.array([len(x[0]) / max(1, x[1]) for x in lines], np.float64)
    scores = smooth(np.log1p(np.minimum(ratios, FULL)) + BONUS * np.array([x[2] for x in lines]))
    keeps = scores >= threshold(scores)
    opens = keeps | np.array([x[3] for x in lines])
    at = np.flatnonzero(opens)
    for i, j in zip(at[:-1][::-1], at[1:][::-1], strict=True):
        if keeps[j] and j - i <= BETWEEN + 1:
            keeps[i:j] = True
    # what begins or ends an article has content on one side only
    inside = np.array([x[2] for x in lines])
    edges = np.flatnonzero(np.diff(np.concatenate([[True], keeps, [True]]).astype(np.int8)))
    for i, j in zip(edges[::2], edges[1::2], strict=True):
        beside = (i > 0 and inside[i - 1]) or (j < len(lines) and inside[j])
        if j - i <= BETWEEN and beside and inside[i:j].all():
            keeps[i:j] = True
    return keeps


def main_text(html: str | None) -> str:
    """The main text of a page.

    >>> main_text("<nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>one\\n two</article>")
    'A & B\\none two'
    """
    if not html:
        return ""
    page = Lines()
    # behind the last > no tag ends: what looks like one is text (the parser would try each anew, to the end)
    cut = html.rfind(">") + 1
    page.feed(html[:cut])
    page.feed(html[cut:].replace("<", "&lt;"))
    page.end()
    if not page.lines:
        return ""
    return "\n".join(x[0] for x, keeps in zip(page.lines, content(page.lines), strict=True) if keeps)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches):
        for b in batches:
            found = [main_text(x) for x in texts_of(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    d = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return map_arrow(d, run, "page_id long, url string, text string, n_chars long")
