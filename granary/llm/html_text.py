"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines, one for each block of the page, keeping how much of a line is link text, whether it
is a heading, and where it stands: in furniture (menus, headers, footers, asides, adverts, notices, forms,
comments), which is no text; in an article, where the page marks one, where a line weighs ARTICLE times its length;
under a class that may name furniture or content (``related-work``, ``side-by-side``), where it weighs DOUBT times
as much; outside of articles mostly-link lines weigh nothing.

Weights are summed over sliding windows of WINDOW lines, which do not reach over the edge of an article or of a
doubtful block. Text surges where a window exceeds SURGE of the page's median window, and dives behind the last
line of the last such window; what lies between the surge and the dive points of one stretch is text, mostly-link
lines too. On a page's unmarked parts, lines at the ends of a stretch that weigh less than LINE, and less than EDGE of
its heaviest one, are boilerplate that the window touched, but headings stay before text. Of the stretches, those
stay that weigh FLOOR of the heaviest, doubtful ones DOUBT_FLOOR; an article's stretches weigh as one.

Each page is one row of an Arrow batch; there is no shuffle. Defined cases: null, empty or text-free
html gives an empty text; broken or truncated markup ends open elements; nothing is cut from long
pages; repeated rows each get their row; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 4
#: Share of the page's median window, of those with any weight, that a window of main text exceeds.
SURGE = 0.01
#: Weight of a character in an article against one outside, and of one under a doubtful class against others.
ARTICLE, DOUBT = 5, 0.1
#: What a line at the end of a stretch weighs at least, outside of articles, or which share of the heaviest line.
LINE, EDGE = 40, 0.1
#: Share of the heaviest stretch's weight that a stretch weighs at least, and a doubtful one, whose weight is reduced already.
FLOOR, DOUBT_FLOOR = 0.1, 0.02

# Element names of HTML and common class words.
BLOCKS = frozenset(
    "address article aside blockquote body br button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol option p pre section select summary table "
    "tbody td tfoot th thead title tr ul video".split()
)
RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript".split())
FURNITURE = frozenset("head nav header footer aside form button select option textarea iframe noscript template menu dialog svg canvas object script style title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adbox|banner\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|notification\w*|newsletter|"
    r"popup|modal|sidebar\w*|widget\w*|menu\w*|nav\w*|breadcrumbs?|pagination|pager|footer\w*|header|masthead|toolbar|social\w*|"
    r"comments?|commentlist|disqus|login|signup|copyright)(?:$|[\s_-])"
)
DOUBTFUL_WORDS = re.compile(r"(?:^|[\s_-])(?:side|related|recommend\w*|search\w*|legal|share\w*|alert|subscribe\w*|replies|respond)(?:$|[\s_-])")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_TAG = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
# Whole name=value pairs, so that neither values nor longer names are taken for a name.
_ATTR = re.compile(r"([^\s/>=\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?")
# A paragraph, list item, cell or option ends where the next one starts.
_SIBLINGS = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}


_OUTSIDE = ("", False, False, False, False, False)


def _standing(name: str, attributes: str) -> tuple[bool, bool]:
    """(furniture, doubtful) of an element by its name and attributes."""
    if name in FURNITURE:
        return True, False
    if not attributes or name in ("html", "body", "article", "main"):
        return False, False
    doubtful = False
    for key, a, b, c in _ATTR.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in FURNITURE_ROLES:
            return True, False
        if key in ("class", "id"):
            if FURNITURE_WORDS.search(value):
                return True, False
            doubtful = doubtful or bool(DOUBTFUL_WORDS.search(value))
    return False, doubtful


def page_lines(page: str) -> list[tuple[str, int, bool, bool, bool, bool]]:
    """(text, characters in links, in furniture, in article, under a doubtful class, heading) of each block with text, in page order."""
    lines, parts, linked = [], [], 0
    stack: list[tuple[str, bool, bool, bool, bool, bool]] = []  # name, furniture, article, link, doubtful, heading

    def close_line() -> None:
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            _, furniture, article, _, doubtful, heading = stack[-1] if stack else _OUTSIDE
            lines.append((text, linked, furniture, article, doubtful, heading))
        parts, linked = [], 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            parts.append(raw)
            if stack and stack[-1][3]:
                linked += len("".join(raw.split()))

    at = 0
    while True:
        m = _TAG.search(page, at)
        if not m:
            add(page[at:])
            close_line()
            return lines
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            close_line()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    # An inline element doesn't end the blocks inside it, nor a paragraph its container.
                    if name in BLOCKS or not any(s[0] in BLOCKS for s in stack[i + 1 :]):
                        del stack[i:]
                    else:
                        del stack[i]
                    break
            continue
        if name in RAW:
            close_line()
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID or m[3].endswith("/"):
            continue
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in _SIBLINGS.get(name, ()):
                del stack[i:]
                break
            if stack[i][0] in BLOCKS and stack[i][0] not in ("p", "td", "th"):
                break
        _, furniture, article, link, doubtful, heading = stack[-1] if stack else _OUTSIDE
        gone, doubt = _standing(name, m[3])
        stack.append((name, furniture or gone, article or name in ("article", "main"), link or name == "a", doubtful or doubt, heading or name in HEADINGS))


def main_text(page: str | None) -> str:
    """The page's main text, blocks joined by one space."""
    lines = [x for x in page_lines(page or "") if not x[2]]
    if not lines:
        return ""
    size = np.array([len(t.replace(" ", "")) for t, *_ in lines])
    links, article, doubtful, heading = (np.array([x[i] for x in lines]) for i in (1, 3, 4, 5))
    weight = np.where(article, ARTICLE * size, np.where(2 * links > size, 0, size - links)) * np.where(doubtful, DOUBT, 1.0)
    sums = np.concatenate([[0.0], np.cumsum(weight)])
    # Parts of the page that windows stay within, and the window that begins at each line.
    part = np.cumsum(np.diff(article * 2 + doubtful, prepend=0) != 0)
    end = np.searchsorted(part, part, "right")
    reach = np.minimum(np.arange(len(lines)) + WINDOW, end)
    window = sums[reach] - sums[:-1]
    heavy = window[window > 0]
    surging = np.flatnonzero(window > SURGE * np.median(heavy)) if len(heavy) else heavy
    stretches = []
    for p in np.unique(part[surging]):
        own = surging[part[surging] == p]
        first, last = own[0], reach[own[-1]]
        while weight[first] == 0:
            first += 1
        while weight[last - 1] == 0:
            last -= 1
        if not article[first]:
            least = min(LINE, EDGE * weight[first:last].max())
            while weight[last - 1] < least:
                last -= 1
            while weight[first] < least and not heading[first]:
                first += 1
        stretches.append((first, last))
    marked = weight[article & ~doubtful].sum()
    weights = [marked if article[s] and not doubtful[s] else sums[d] - sums[s] for s, d in stretches]
    kept = [(s, d) for (s, d), w in zip(stretches, weights, strict=True) if w >= (DOUBT_FLOOR if doubtful[s] else FLOOR) * max(weights)]
    return " ".join(lines[i][0] for s, d in kept for i in range(s, d))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([main_text(h.as_py()) for h in b.column("html")], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), text], ["page_id", "url", "text"])

    found = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
