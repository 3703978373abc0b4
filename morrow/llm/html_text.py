"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines, one per block of the page.  Lines of parts that no article
holds (menus, headers, footers, sidebars, notices, adverts, forms, reader comments, lists of
links) weigh nothing.  Text lengths are summed over sliding windows of lines; text starts
where the sum first surges, by the measure of the page's largest window, and ends where it
dives to nothing for good; all lines in between that weigh something are kept.  Where an
article or main element holds text, any text in it is a surge: only tags and classes decide.
Each page is handled by itself in one task.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
#: Characters that a window must hold for a surge, or the part of the page's largest window where
#: that is less; inside an article element any text does.
SURGE, SURGE_PART = 80, 0.25

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<[a-zA-Z/!?][^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[^a-z0-9]+")

# Element names of HTML by their part in a page, and usual class words.
_RAW = frozenset(
    "script style noscript template title textarea iframe svg math object canvas audio video select datalist".split()
)
_OUTSIDE = frozenset("nav footer aside form menu dialog button".split())
_MAIN = frozenset("article main".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search "
    "section summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLASS_WORDS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising sponsor sponsored sponsors promo promotion "
    "banner banners cookie cookies consent gdpr notice notices alert popup modal overlay sidebar widget widgets "
    "nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer copyright comment comments "
    "respond disqus reply replies share sharing social related recommended newsletter subscribe subscription "
    "signup login search form toolbar pagination pager contentinfo complementary".split()
)


def _is_outside(name: str, attrs: str) -> bool:
    if name in _OUTSIDE:
        return True
    if name in ("html", "body", "main") or not attrs:
        return False
    for found in _ATTRIBUTE.finditer(attrs):
        value = found[1] or found[2] or found[3] or ""
        if not _CLASS_WORDS.isdisjoint(_PART.split(value.lower())):
            return True
    return False


def page_lines(page: str) -> list[tuple[str, bool, bool]]:
    """Lines of the page as (text, weighs, in an article element)."""
    lines: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    linked = 0  # characters of the line that stand in links
    in_link = False
    main_depth, seen_main = 0, False
    skip, depth = "", 0  # the element that is left out, and how often its name is open
    heading_in_header = header_depth = 0
    at = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            raw = "".join(parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                links_only = not main_depth and linked >= 0.8 * len(raw.strip())
                aside = header_depth > 0 and not (main_depth and heading_in_header)
                lines.append((text, not (skip or links_only or aside), main_depth > 0))
        parts, linked = [], 0

    end = len(page)
    while at < end:
        found = _TAG.search(page, at)
        if not found:
            parts.append(page[at:])
            linked += in_link * (end - at)
            break
        if found.start() > at:
            parts.append(page[at : found.start()])
            linked += in_link * (found.start() - at)
        at = found.end()
        name = (found["name"] or "").lower()
        if not name:
            continue
        closing, attrs = found["close"] == "/", found["attrs"] or ""
        if name in _RAW:
            if not closing and not attrs.rstrip().endswith("/"):
                stop = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = stop.end() if stop else end
            if name in _BLOCKS:
                flush()
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name == "a":
            in_link = not closing
            continue
        if name in _BLOCKS or name == skip:
            flush()
        if name in _VOID:
            continue
        if skip:
            if name in _MAIN and not closing and not seen_main:
                skip, depth = "", 0  # an element left open, or a layout around the article
            elif name == skip:
                depth += -1 if closing else 1
                if depth == 0:
                    skip = ""
                continue
            else:
                continue
        if name in _MAIN:
            if not closing and _is_outside(name, attrs):
                skip, depth = name, 1
                continue
            main_depth = max(0, main_depth - 1) if closing else main_depth + 1
            seen_main = True
        elif name == "header":
            header_depth = max(0, header_depth - 1) if closing else header_depth + 1
        elif name in _HEADINGS:
            heading_in_header = int(not closing)
        elif not closing and _is_outside(name, attrs):
            skip, depth = name, 1
    flush()
    return lines


def main_text(page: str) -> str:
    """The blocks between surge and dive points, one per line."""
    lines = page_lines(page)
    marked = any(weighs and inside for _, weighs, inside in lines)
    weight = [len(text) if weighs and (inside or not marked) else 0 for text, weighs, inside in lines]
    total = sum(weight[:WINDOW])
    sums = []
    for i in range(len(weight)):
        sums.append(total)
        total += (weight[i + WINDOW] if i + WINDOW < len(weight) else 0) - weight[i]
    if marked:
        surge = 1
    elif _TAG.search(page):
        surge = max(1, min(SURGE, SURGE_PART * max(sums, default=0)))
    else:
        surge = SURGE  # no markup: not a page
    start = next((i for i, held in enumerate(sums) if held >= surge), len(sums))
    while start and start < len(sums) and weight[start - 1]:
        start -= 1  # short lines right before the surge belong to it
    # A later dive is an advert or a list of links inside the text: what follows is text again.
    return "\n".join(line[0] for line, held in zip(lines[start:], weight[start:], strict=True) if held)


def extract_text(pages: DataFrame) -> DataFrame:
    """Main text of every page: ``page_id, url, text, n_chars`` (code points).

    Defined cases: a null or empty html, and a page without main text, give an empty text;
    markup that is cut off or not closed is read as far as it goes; rows are independent, so
    null or repeated page_ids and repeated rows need no care; pages of any length are read
    whole; other columns are ignored; an empty table gives an empty result.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page or "") for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )
    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
