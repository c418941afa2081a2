"""Main text of web pages by the line-block distribution.

Markup is stripped so that every block element begins a line; what can't be main text (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, comments) leaves empty lines behind. The text lengths are summed over windows of
consecutive lines; where the sum surges a text begins, where it falls back to zero it ends. The stretch with most text is kept,
with others that are of its order. A line in an article element weighs ``ARTICLE`` times, so on pages that have one it decides
which stretch is kept; the distribution decides on every page.

An element is noise by its tag or role, or by its class or id: a token whose first or last word is listed, unless another word
says that it holds the text (``post``) or has only to do with what is listed (``with-sidebar``). Where nearly all text would go by
classes, they are left out of account.

Cases: null or empty html, or a page without text, gives an empty text. Markup that is cut off or never closed ends with
the page; a container left open ends at the article. Quotes that are never closed end at the next ``>``. Long pages are read in one
pass, in time proportional to their length. Equal pages give equal texts. Other columns are not read and may have any names; an
empty table gives an empty one.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

WINDOW, SURGE = 3, 60
#: Stretches with this share of the largest one's weight belong to the main text too.
SHARE, ARTICLE = 0.4, 1000
#: Classes are left out of account if what they drop holds so many times the text that is left.
MOST = 20

_OPEN = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_RAW = frozenset("script style noscript template iframe textarea title svg object".split())
_NOISE = frozenset("nav header footer aside form button select dialog menu head".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_IMPLIED_END = frozenset("p li dt dd option tr td th".split())
_KEEP = frozenset("html body main article".split())
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promoted banner cookie cookies consent gdpr notice notices alert popup modal overlay"
    " sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs topbar masthead header footer comment comments disqus reply replies respond"
    " related recommended share sharing social newsletter subscribe subscription login signup search widget toolbar pagination pager copyright disclaimer skip hidden".split()
)
#: Words of a class or id beside which a listed one does not count.
_TEXT = frozenset("article body content entry main page post story text with without has have no not is enabled disabled to from after before".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())


def _listed(token: str) -> bool:
    words = [w for w in re.split(r"[^a-z0-9]+", token) if w]
    return bool(words) and (words[0] in _WORDS or words[-1] in _WORDS) and (_TEXT.isdisjoint(words) or token.endswith(("header", "footer")))


def _noise(tag: str, attrs: str, in_article: bool, classes: bool = True) -> bool:
    """Whether an element holds no main text; an article's own header holds its title."""
    if tag in _NOISE:
        return not (tag == "header" and in_article)
    if not attrs or tag in ("html", "body", "main"):
        return False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if classes and name in ("class", "id") and any(map(_listed, value.split())):
            return True
        if name == "role" and value in _ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def lines_of(html: str, classes: bool = True) -> tuple[list[tuple[str, int]], int]:
    """Lines of text with the number of the article they stand in (0: none), with empty lines where something was left out; and how
    many characters of markup and text went by class or id."""
    lines: list[tuple[str, int]] = []
    parts: list[str] = []
    article, depth, articles = 0, 0, 0
    skip, nested = "", 0  # the element that is being left out, and how many of its kind are open
    at, n, loose = 0, len(html), False
    by_class, dropped = False, 0

    def flush(gap=0):
        text = " ".join(entities.unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if text:
            lines.append((text, article))
        lines.extend([("", 0)] * gap)

    while at < n:
        m = _OPEN.search(html, at)
        if m and m[0] != "<!--":
            rest = None if loose else _REST.match(html, m.end())
            if not rest and m[2]:
                loose = True  # some quote is never closed: from here on a tag ends at the first >
            stop = rest.end() if rest and m[2] else html.find(">", m.end()) + 1
        if not m or m[0] != "<!--" and not stop:
            # a tag that is cut off at the end of the page is no text
            if not skip:
                parts.append(html[at : m.start()] if m else html[at:])
            break
        if not skip and m.start() > at:
            parts.append(html[at : m.start()])
        elif skip and by_class:
            dropped += m.start() - at
        if m[0] == "<!--":
            end = html.find("-->", m.end())
            at = n if end < 0 else end + 3
            continue
        at = stop
        tag, closing, attrs = (m[2] or "").lower(), m[1] == "/", html[m.end() : stop - 1] if m[2] else ""
        if not tag:
            continue
        if tag in _RAW and not closing:
            if not attrs.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else n
            if not skip and tag not in _INLINE:
                flush()
            continue
        if skip:
            if tag == skip and tag not in _VOID:
                nested += -1 if closing else 1
                if nested <= 0:
                    skip = ""
                    flush(0 if article else WINDOW if tag in _NOISE else 1)
                    continue
                if closing or skip not in _IMPLIED_END:
                    continue
            if skip in _IMPLIED_END and tag not in _INLINE and tag not in _VOID:
                skip = ""  # its end is implied by the next block
            elif tag in ("article", "main") and not closing and not article and not _noise(tag, attrs, False, classes):
                skip = ""  # a container round or before the article was left open
            else:
                continue
        if not closing and (tag not in _VOID and tag not in _KEEP | _INLINE or tag in ("article", "span", "a")) and _noise(tag, attrs, article > 0, classes):
            flush(0 if article else WINDOW if tag in _NOISE else 1)
            skip, nested, by_class = tag, 1, not _noise(tag, attrs, article > 0, False)
            continue
        if tag in _INLINE:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        boundary = tag in ("article", "main")
        flush(WINDOW if boundary and not article else 0)
        if boundary:
            if closing:
                depth = max(0, depth - 1)
                if not depth and article:
                    article = 0
                    lines.extend([("", 0)] * WINDOW)
            else:
                depth += 1
                if depth == 1:
                    articles += 1
                    article = articles
    flush()
    return lines, dropped


def main_lines(lines: list[tuple[str, int]], window: int = WINDOW, surge: int = SURGE) -> list[str]:
    """The lines between surge and dive points."""
    sizes = [len(t) * (ARTICLE if a else 1) for t, a in lines]
    sums, total = [], sum(sizes[: window - 1])
    for i in range(len(sizes)):
        total += sizes[i + window - 1] if i + window - 1 < len(sizes) else 0
        sums.append(total)
        total -= sizes[i]
    surge = min(surge, max(sums, default=0))
    stretches, i = [], 0
    while i < len(sums):
        if not sums[i]:
            i += 1
            continue
        j = i
        while j < len(sums) and sums[j]:
            j += 1  # the dive: a window without text
        if max(sums[i:j]) >= surge:
            last = min(len(lines), j + window - 1)
            stretches.append((sum(sizes[i:last]), [t for t, _ in lines[i:last] if t]))
        i = j
    most = max((weight for weight, _ in stretches), default=0)
    return [t for weight, own in stretches if weight >= SHARE * most for t in own]


def main_text(html: str | None) -> str:
    """The main text, blocks in page order joined by one space."""
    if not html:
        return ""
    lines, dropped = lines_of(html)
    found = main_lines(lines)
    if dropped > MOST * sum(map(len, found)):
        found = main_lines(lines_of(html, classes=False)[0]) or found
    return " ".join(found)


def extract(pages: DataFrame, html="html", page_id="page_id", url="url") -> DataFrame:
    """page_id, url, text and n_chars (its code points) of every page."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("h"))

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b["h"].to_pylist()]
            yield pa.record_batch([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")
