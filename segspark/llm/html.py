"""Main text of web pages by the line-block distribution.

Markup is stripped into lines, one for each block of the page. Lines of menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments, known by element, class, id
or role, and lines outside of a marked article that are mostly links, have length zero. The lengths of three lines are summed at each
place; the text from where they surge, that is exceed SURGE characters, to where they dive to zero is kept. Lines
that the page marks as its article or main part weigh SURGE more, other lines of that page a quarter (OUTSIDE). A page without any surge keeps all cleaned
lines. So what is lost are short stretches that zero lines part from the text, and what is kept too many are two short
lines at most that stand right before an unmarked text.

A null or empty page gives an empty text. Extra columns are not read. Each input row gives one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from segspark.llm.text import chunks

WINDOW, SURGE, OUTSIDE = 3, 86, 4

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']++|\"[^\"<]*\"|'[^'<]*'|[\"'])*+)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

# Elements.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_RAW = set("script style noscript template textarea title iframe svg math object canvas select option xmp noembed noframes audio video".split())
_DROPPED = set("nav footer aside form button dialog menu head fieldset".split())
_REGIONS = ("article", "main")
_TEXT = set("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: Words of class, id or role that mark what is no part of an article.
_MARKS = set(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead banner ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup social share sharing sharebar related recommended recommendations comment comments commentlist reply replies respond disqus popup modal overlay widget toolbar pagination pager login search searchbox copyright disclaimer contentinfo complementary skip".split()
)
_NOT_IN_ARTICLES = {"header"}
_NEGATIONS = {"has", "with", "no", "without"}


def _words(value: str) -> set[str]:
    return {w.lower() for w in _CAMEL.findall(value)}


def _is_marked(name: str, attributes: str, in_region: bool) -> bool:
    """Whether an element holds no article text."""
    if name in _DROPPED or (name == "header" and not in_region):
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key == "style":
            if "display:none" in value.replace(" ", "").lower():
                return True
        elif key in ("class", "id", "role", "aria-label"):
            for token in value.split():
                w = _words(token)
                # of a paragraph all words must tell: social-history names its subject, not its place
                if not w & _NEGATIONS and ((w and w <= _MARKS if name in _TEXT else w & _MARKS) or (not in_region and w & _NOT_IN_ARTICLES)):
                    return True
    return False


def lines(page: str) -> list[tuple[str, int, int, bool]]:
    """(text, characters in links, number of the marked article or 0, kept) of each block of a page."""
    out: list[tuple[str, int, int, bool]] = []
    lower = page.lower()
    if len(lower) != len(page):  # some letters have a longer lower case
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in page)
    stack: list[tuple[str, bool, int]] = []  # name, dropped, region
    text: list[str] = []
    at = linked = regions = 0
    in_link = False

    def end_block() -> None:
        nonlocal linked
        joined = " ".join(unescape("".join(text)).split())
        if joined:
            out.append((joined, linked, stack[-1][2] if stack else 0, not (stack and stack[-1][1])))
        text.clear()
        linked = 0

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            text.append(page[at : m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), m[1] == "/"
        if name in _RAW and not closing:
            if not m[3].endswith("/"):
                end = lower.find(f"</{name}", at)
                stop = lower.find(">", end) if end >= 0 else -1
                at = stop + 1 if stop >= 0 else len(page)
            if name not in _INLINE and name != "svg":
                end_block()
            continue
        if name == "a":
            in_link = not closing
        inline = name in _INLINE
        if not inline:
            end_block()
        if name in _VOID:
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    end_block() if inline else None
                    del stack[i:]
                    break
                if inline and stack[i][0] not in _INLINE:
                    break
            continue
        while stack and not inline and (stack[-1][0] == "p" or stack[-1][0] in _INLINE or (stack[-1][0] == "head" and name == "body") or (name == "li" and stack[-1][0] == "li")):
            stack.pop()
        dropped, region = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
        marked = _is_marked(name, m[3], region > 0)
        if inline or name == "p":  # only matters if it is marked
            if marked and not dropped:
                end_block()
                stack.append((name, True, region))
            elif stack and stack[-1][1] and stack[-1][0] == name:
                stack.append((name, True, region))
            continue
        if name in _REGIONS and not marked and not dropped and not region:
            regions += 1
            region = 2 * regions + (name == "article")
        elif name == "article" and not marked and not dropped and region % 2 == 0:  # an article within main
            regions += 1
            region = 2 * regions + 1
        stack.append((name, dropped or marked, region))
    if at < len(page):
        text.append(page[at:])
    end_block()
    return out


def main_text(page: str | None, window: bool = True) -> str:
    """The lines between surge and dive points. Without the ``window`` step, which is for measurements, all cleaned lines."""
    found = lines(page or "")
    lengths = [len(t) if kept and (region or 2 * linked <= len(t)) else 0 for t, linked, region, kept in found]
    if not window:
        return " ".join(t for (t, *_), n in zip(found, lengths) if n)
    # where a page marks an article, its lines weigh more, so that short ones surge too, and lines outside weigh less
    marked = any(n and region for n, (_, _, region, _) in zip(lengths, found))
    weights = [(n + SURGE if region else n // OUTSIDE) if n and marked else n for n, (_, _, region, _) in zip(lengths, found)]
    cuts = [0, *(i for i in range(1, len(found)) if found[i][2] != found[i - 1][2]), len(found)]
    parts = [(a, spans(weights[a:b], SURGE)) for a, b in zip(cuts, cuts[1:])]  # a mark's edge is a dive
    between = [(a + i, a + j) for a, part in parts for i, j in part] or spans(weights, 0)
    return " ".join(found[i][0] for a, b in between for i in range(a, b) if lengths[i])


def spans(lengths: list[int], surge: int) -> list[tuple[int, int]]:
    """(surge point, dive point) of the sums over WINDOW lines."""
    out, start = [], None
    for i in range(len(lengths)):
        total = sum(lengths[i : i + WINDOW])
        if start is None and total > surge:
            start = i
        elif start is not None and not total:
            out.append((start, i))
            start = None
    return out + [(start, len(lengths))] if start is not None else out


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text): the main text of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, pages in chunks(batches, "html"):
            texts = [main_text(p.decode("utf-8", "replace")) for p in pages]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")
