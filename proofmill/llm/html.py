"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block, in page order; what stands in a menu, advert,
form, script or the like becomes an empty line.  Sums of text lengths over a sliding window of
lines form the distribution; it surges where text begins and dives where it has ended.
Lines between a surge and its dive are kept.  Markup only weighs lines; on every page the sums decide.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from html import unescape

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of HTML elements by their part in a page.
DROPPED = frozenset("head title script style noscript template svg math iframe object canvas audio video map form button select textarea input nav footer aside menu dialog".split())
RAW = frozenset("script style noscript template textarea title iframe svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul aside head title".split())
#: Words in class, id or role of elements that are not the article.
CHROME = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "menu nav navbar navigation breadcrumb breadcrumbs sidebar side aside footer header masthead topbar toolbar share sharing social related recommended recommendations "
    "newsletter subscribe subscription signup login search widget widgets comment comments disqus respond reply replies pagination pager skip contentinfo complementary".split()
)
#: Classes of articles that are not the page's own.
FOREIGN = frozenset("comment comments disqus respond reply replies related recommended recommendations promo promoted sponsored teaser ad ads advert advertisement".split())
NAME = regex.compile(r"[a-zA-Z][^\s/>]*+")
PLAIN = regex.compile(r"[^>\"']*+")
ATTRIBUTE = regex.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", regex.I)
HIDDEN = regex.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", regex.I)
#: Words beside those of CHROME that only say where or in what box it stands.
PLACES = frozenset("site global top bottom left right primary secondary first second upper lower main box container wrapper wrap block list item items area section inner outer bar links link unit slot bottom mobile desktop".split())
#: Elements that the start of another one ends, and those around them where the search stops.
IMPLIED = {
    "li": (("li",), BLOCKS - {"address", "div", "p", "li"}),
    **{n: (("dd", "dt"), BLOCKS - {"address", "div", "p", "dd", "dt"}) for n in ("dd", "dt")},
    **{n: (("td", "th"), ("table", "tr")) for n in ("td", "th")},
    "tr": (("tr", "td", "th"), ("table",)),
    **{n: (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)) for n in ("tbody", "thead", "tfoot")},
}
HEAD = frozenset("base link meta noscript script style template title head".split())
PARTS = regex.compile(r"[a-z]+").findall
#: Lines in a block of the distribution, its own line in the middle.
WINDOW = 5
#: Characters in a block at which text surges, or fewer where no block of the page has them; the part of these at which it has dived.
SURGE, DIVE = 60, 0.2
#: Weights of lines in article and main elements and beside them, where these hold most of the text.
INSIDE, OUTSIDE = 4, 0.25
#: Weight of lines of chrome by class, and the unlinked characters from which they count at all.
CHROME_WEIGHT, MUCH = 0.5, 400


class Tags:
    """Markup of a page from left to right: (start, end, slash, name, rest of the tag); name is empty for comments and the like.

    Linear in the page: a quote that nothing closes, or that hides every later end of a tag, is an
    ordinary character from there on.
    """

    def __init__(self, page: str):
        self.page, self.quotes, self.last_cdata = page, True, page.rfind("]]>")

    def end_of_tag(self, at: int) -> int:
        """Place of the ``>`` that ends a tag open at ``at``, or -1."""
        page = self.page
        if not self.quotes:
            return page.find(">", at)
        k = at
        while (k := PLAIN.match(page, k).end()) < len(page):
            if page[k] == ">":
                return k
            shut = page.find(page[k], k + 1)
            if shut < 0:
                break
            k = shut + 1
        self.quotes = False
        return page.find(">", at)

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return at, end + 3 if end >= 0 else len(page), False, "", ""
            if page.startswith("<![CDATA[", at) and at < self.last_cdata:
                return at, page.find("]]>", at) + 3, False, "", ""
            if page.startswith(("<!", "<?"), at):
                end = page.find(">", at)
                return at, end + 1 if end >= 0 else len(page), False, "", ""
            slash = page.startswith("/", at + 1)
            name = NAME.match(page, at + 1 + slash)
            if name:
                end = self.end_of_tag(name.end())
                if end < 0:
                    return None
                return at, end + 1, slash, name[0].lower(), page[name.end() : end]
            at += 1
        return None


def chrome(name: str, rest: str, inside: bool) -> float:
    """Weight of an element's lines: 0 outside the article by its name or hidden, CHROME_WEIGHT by its class, id or role, else 1.

    A token of these counts as a whole: each of its word parts is of CHROME or PLACES, and one of CHROME.
    """
    if name in DROPPED or (name == "header" and not inside):
        return 0
    if not rest or name in ("html", "body", "main"):
        return 1
    words = FOREIGN if name == "article" else CHROME
    if HIDDEN.search(rest):
        return 0
    for m in ATTRIBUTE.finditer(rest):
        for token in (m[1] or m[2] or m[3] or "").lower().split():
            parts = PARTS(token)
            if not words.isdisjoint(parts) and all(p in CHROME or p in words or p in PLACES for p in parts):
                return CHROME_WEIGHT
    return 1


def stripped(page: str) -> list[tuple[str, int, bool, float]]:
    """Lines of a page: text, characters of it inside links, whether an article or main element holds it, and weight.

    Elements end where HTML ends them: by their end tag, that of an element around them, or, where that
    may be left out, by what cannot stand inside.  Lines of an element of weight 0 are one empty line, as
    are those of chrome by class, unless its own lines hold MUCH unlinked text and half of the page's.
    """
    out: list[tuple[str, int, bool, int]] = []
    words: list[str] = []
    frames = [1.0]  # weights of the page and of chrome elements
    stack: list[tuple[str, int, bool]] = []  # open blocks and chrome: name, frame around, link around
    places: defaultdict[str, list[int]] = defaultdict(list)  # of each name in the stack
    linked, frame, link, at = 0, 0, False, 0
    size, tags = len(page), Tags(page)

    def close() -> None:
        nonlocal linked
        out.append((" ".join(unescape("".join(words)).split()), linked, bool(places["article"] or places["main"]), frame))
        words.clear()
        linked = 0

    def pop(depth: int) -> None:
        """Ends the elements from ``depth`` on."""
        nonlocal frame, link
        if len(stack) > depth:
            close()
        while len(stack) > depth:
            name, around, before = stack.pop()
            places[name].pop()
            frame, link = around, link and before

    def implied(name: str) -> None:
        """Ends what the start of ``name`` ends in HTML."""
        ends, walls = IMPLIED.get(name, ((), ()))
        if any(places[e] for e in ends):
            wall = max((places[w][-1] for w in walls if places[w]), default=-1)
            above = [places[e][k] for e in ends if (k := bisect_right(places[e], wall)) < len(places[e])]
            if above:
                pop(min(above))
        if name in BLOCKS and places["p"]:
            k = len(stack) - 1
            while k >= 0 and stack[k][0] not in BLOCKS:
                k -= 1
            if k >= 0 and stack[k][0] == "p":
                pop(k)
        if places["head"] and name not in HEAD:
            pop(places["head"][0])

    while at < size:
        tag = tags.next(at)
        text = page[at : tag[0] if tag else size]
        if text and frames[frame]:
            words.append(text)
            if link:
                linked += len(text.strip())
        if not tag:
            break
        _, at, slash, name, rest = tag
        if not name:
            continue
        if slash:
            if places[name]:
                pop(places[name][-1])
            elif name in BLOCKS:
                close()
            if name == "a":
                link = False
            continue
        if name == "br":
            words.append(" ")
            continue
        implied(name)
        if name in BLOCKS:
            close()
        if name in VOID:
            continue
        shut = rest.endswith("/")
        if name in RAW:  # its content is no markup
            if not shut:
                end = regex.compile(rf"</{regex.escape(name)}\s*>", regex.I).search(page, at)
                at = end.end() if end else size
            continue
        weight = 1 if shut else chrome(name, rest, bool(places["article"] or places["main"]))
        if name == "a":
            link = True
        if not shut and (weight < 1 or name in BLOCKS or places[name]):
            if weight < 1:
                close()
            places[name].append(len(stack))
            stack.append((name, frame, link and name != "a"))
            if weight < 1:
                frames.append(min(weight, frames[frame] and 1))
                frame = len(frames) - 1
    close()
    own = [0] * len(frames)
    for text, linked, _, f in out:
        own[f] += len(text) if 2 * linked <= len(text) else 0
    total = sum(own)
    weights = [w if w == 1 or (n >= MUCH and 2 * n >= total) else 0 for w, n in zip(frames, own, strict=True)]
    lines: list[tuple[str, int, bool, float]] = []
    silent = False
    for text, linked, inside, f in out:
        if weights[f]:
            lines.append((text, linked, inside, weights[f]))
        elif not silent:
            lines.append(("", 0, inside, 1))
        silent = not weights[f]
    return lines


def between_surge_and_dive(lines: list[tuple[str, int, bool, float]], window: int = WINDOW, surge: float = SURGE, dive: float = DIVE) -> list[str]:
    """Non-empty lines between the dives of the distribution, where it surges between them.

    Each line's block sums the lines around it.  A run is a stretch of lines whose blocks all hold more
    than the part ``dive`` of ``surge``; it is kept where a line of text in it has a block of ``surge``.
    Article and main elements only scale the sums: where they hold at least half of the unlinked text,
    their lines, linked or not, count INSIDE times and those outside OUTSIDE times; where they hold
    less, as teasers and stubs do, all lines weigh the same.  Sums are taken apart within and outside of them.
    """
    plain = [0 if 2 * linked > len(text) else weight * len(text) for text, linked, _, weight in lines]
    held = sum(n for n, (_, _, inside, _) in zip(plain, lines, strict=True) if inside)
    marked = any(inside and text for text, _, inside, _ in lines) and 2 * held >= sum(plain)
    rows = [(text, (INSIDE * len(text) if inside else OUTSIDE * n) if marked else n, marked and inside) for n, (text, _, inside, _) in zip(plain, lines, strict=True)]
    before, after = (window - 1) // 2, window // 2 + 1
    blocks = [sum(n for _, n, within in rows[max(0, i - before) : i + after] if within == row[2]) for i, row in enumerate(rows)]
    surge = min(surge, max(blocks, default=0))
    keep, run, on = [], [], False
    for i, (text, n, within) in enumerate(rows):
        dived = blocks[i] <= dive * surge
        if dived or (i and within != rows[i - 1][2]):
            keep += run if on else []
            run, on = [], False
        if n and not dived:
            run.append(text)
            on = on or blocks[i] >= surge
    return keep + (run if on else [])


def extract(page: str | None) -> str:
    return "\n\n".join(between_surge_and_dive(stripped(page or "")))


def main_text(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages(page_id, url, html)``: page_id, url, text and n_chars.

    Null or empty html gives an empty text; repeated rows, and null ids or urls, each get their row;
    other columns are not read, whatever their names; an empty table gives none.  Pages of any length
    are read whole, in time that grows with them; nothing is capped.  No shuffle.
    """

    def run(frames):
        for pdf in frames:
            part = pdf["html"].str.len().to_numpy().cumsum() // 2_000_000 if len(pdf) else np.zeros(0)
            for _, some in pdf.groupby(part, sort=True):
                yield pd.DataFrame({"page_id": some["page_id"], "url": some["url"], "text": [extract(h) for h in some["html"]]})

    out = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).mapInPandas(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
