"""Operator 4: main text of web pages by line-block distribution.

Markup is stripped so that every block element is a line; menus, headers,
footers, sidebars, notices, adverts, forms and reader comments become empty
lines, known by their elements, roles and class names, and lines made of links
weigh nothing. Over windows of ``WIDTH`` lines the weights are summed: a line
where the sum rises above the threshold is a surge, the line after which the
windows stay empty is a dive, and the lines between are the text. Lines in a
marked article (article, main, or a role or property of that meaning) weigh
``LIFT`` times as much, their links too. The windows
run over the marked lines and over the others; the side with the heavier block
is the text, where a marked element counts ``MARKED`` times, so teasers that are
marked do not displace a body that is not. Class names count as whole
words only, and an element that holds most of the page's text is not set apart
by its name.

White space in a block becomes one space, character references are decoded,
empty blocks go, blocks are joined by an empty line in page order. Null and
empty pages, and pages without text, give an empty text; broken markup is read
as far as it goes; a very long page is read whole, in time that grows as its
length; repeated rows each get a row; an empty table gives no rows; other
columns are ignored, whatever they are called.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 3
THRESHOLD = 86
MARKED = 4
LIFT = 16

# Elements of HTML by their role in a page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = "script|style|noscript|template|svg|math|iframe|object|textarea|select|button|canvas|audio|video"
APART = frozenset("nav footer aside form menu dialog head".split())
VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
PART = (
    r"(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|"
    r"nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|sidebar|side|widget|footer|masthead|topbar|toolbar|share|sharing|social|related|recommended|trending|comments?|commentlist|"
    r"disqus|replies|reply|respond|reviews?|skip-link|copyright|disclaimer|tags?)"
)
KIND = (
    r"(?:buttons?|btns?|links?|icons?|bar|box|list|lists|cloud|items?|area|section|container|wrapper|wrap|inner|outer|block|unit|slot|panel|group|row|title|header|heading|text|message|policy|"
    r"form|thread|stories|posts?|articles?|content|media|left|right|top|bottom|primary|secondary|sticky|fixed|mobile|desktop)"
)
# A whole class or id: "share-buttons" or "site-footer", but not "tag-news" or "no-sidebar", which say something else.
NAMES = re.compile(rf"(?:(?:post|entry|article|page|site|main|global|blog|user|reader)[-_]+)?{PART}(?:[-_]+(?:{PART}|{KIND}))*|(?:ads?|banner|comment|reply|sidebar|widget)[-_]?\d+", re.IGNORECASE)
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][\w:-]*+)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+|[^<>]*+)/?>",
    re.IGNORECASE | re.DOTALL,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-hidden|hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.IGNORECASE)


def _about(attributes: str) -> tuple[bool, bool]:
    """Whether an element's attributes say that it stands apart from the article, or is the article."""
    apart = article = False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            apart |= any(NAMES.fullmatch(x) for x in value.split())
        elif name == "role":
            apart |= value in ROLES
            article |= value in ("main", "article")
        elif name == "itemprop":
            article |= value == "articlebody"
        elif name == "hidden" or value == "true":
            apart = True
    return apart, article


def lines(page: str, exempt: set[int] | None, named: dict[int, list[int]]) -> list[tuple[str, int, int]]:
    """(text, weight, number of the marked element or 0) of each line; what stands apart is an empty line.

    Of elements that stand apart by name only, ``named`` gets the place, the
    weight and whether they are marked as an article. Those at the places in
    ``exempt`` (None: at any place) do not stand apart.
    """
    out: list[tuple[str, int, int]] = []
    parts: list[str] = []
    linked = 0
    skip, depth = "", 0
    inside: list[str] = []
    in_link = False
    marked, name = 0, None

    def end() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        out.append((text, max(0, len(text) - linked), marked if inside else 0))
        parts.clear()
        linked = 0

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at and not skip:
            parts.append(page[at : m.start()])
            if in_link:
                linked += m.start() - at
        elif name is not None and not in_link:
            named[name][0] += len(" ".join(page[at : m.start()].split()))
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        closing = bool(m[2])
        if skip:
            if tag == "a":
                in_link = not closing
            if tag == skip:
                depth += -1 if closing else 1
            gone = depth == 0 or (skip == "p" and tag in BLOCKS and tag != "p")
            if skip == "p" and tag == "p" and not closing:
                gone = True
            if gone or (not closing and tag in ("article", "main", "body") and tag != skip and not inside) or (closing and tag in ("article", "main", "body") and tag != skip):
                was, skip, depth, name = skip, "", 0, None
                end()
                if closing and tag == was:
                    continue
            else:
                continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = not closing
        if tag not in BLOCKS:
            continue
        end()
        if closing:
            if tag in inside:
                while inside.pop() != tag:
                    pass
            continue
        apart, article = _about(m[4]) if m[4] else (False, False)
        article |= tag in ("article", "main")
        by_name = apart and tag not in ("body", "html", "main") and exempt is not None and m.start() not in exempt
        if tag in APART or (tag == "header" and not inside) or by_name:
            if tag not in VOID:
                skip, depth = tag, 1
                if by_name and tag not in APART and tag != "header":
                    name = m.start()
                    named[name] = [0, article]
        elif article or (inside and tag in inside):
            marked += not inside
            inside.append(tag)
    if not skip:
        parts.append(page[at:])
    elif name is not None:
        named[name][0] += len(" ".join(page[at:].split()))
    end()
    return out


def between(weights: list[int], threshold: int, width: int = WIDTH) -> list[tuple[int, int]]:
    """Runs of lines from a surge to its dive."""
    n = len(weights)
    sums, total = [0] * n, 0
    for i in range(n - 1, -1, -1):
        total += weights[i] - (weights[i + width] if i + width < n else 0)
        sums[i] = total
    found, i = [], 0
    while i < n:
        if sums[i] > threshold and weights[i]:
            start = i
            while i < n and sums[i] > 0:
                i += 1
            found.append((start, i))
        else:
            i += 1
    return found


def text_lines(page: str) -> list[tuple[str, int, int]]:
    """Lines of a page, where elements that hold most of its text stay whatever they are called."""
    exempt: set[int] | None = set()
    while True:
        named: dict[int, list[int]] = {}
        rows = lines(page, exempt, named)
        if not named:
            return rows
        left = sum(w for _, w, _ in rows)
        total = left + sum(n for n, _ in named.values())
        articles = [at for at, (_, article) in named.items() if article]
        found = {at for at, (n, _) in named.items() if 3 * n > 2 * total}
        if 2 * sum(named[at][0] for at in articles) > total:
            found.update(articles)
        if not found and not left and total:
            found.update(named)
        if not found:
            return rows
        # Names nested deeper than any real page's say nothing.
        exempt = exempt | found if len(exempt) < 64 else None


def extract(page: str | None, width: int = WIDTH, threshold: int = THRESHOLD) -> str:
    rows = text_lines(page or "")
    rows = [r for i, r in enumerate(rows) if r[0] or (i and rows[i - 1][0])]
    # A marked line, its links included, weighs LIFT times its length, so that short headings and closing lines surge too.
    inner = [LIFT * len(text) if mark else 0 for text, _, mark in rows]
    outer = [0 if mark else w for _, w, mark in rows]
    elements: dict[int, int] = {}
    for text, _, mark in rows:
        elements[mark] = elements.get(mark, 0) + MARKED * len(text)
    elements.pop(0, None)
    runs = between(outer, threshold, width)
    # The densest block wins; a marked element counts MARKED times.
    if max(elements.values(), default=0) and max(elements.values()) >= max((sum(outer[a:b]) for a, b in runs), default=0):
        kept = [text for a, b in between(inner, threshold, max(width, 1)) for (text, _, _), w in zip(rows[a:b], inner[a:b]) if w]
        return "\n\n".join(kept or [text for text, _, mark in rows if text and mark])
    kept = [text for a, b in runs for text, _, mark in rows[a:b] if text and not mark]
    return "\n\n".join(kept or [text for (text, _, _), w in zip(rows, outer) if w])


def extract_pages(pages: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """One row per page: page_id, url, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py(), width, threshold) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string")
