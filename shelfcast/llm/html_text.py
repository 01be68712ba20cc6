"""Main-text extraction by line-block distribution.

Markup is stripped into lines, one per block element; text in menus, headers, footers, sidebars,
notices, adverts, forms, scripts and comments leaves empty lines of the page's skeleton instead. Text
lengths (without link text) are summed over sliding windows of lines. Text surges where a window reaches a
share of the page's highest sum (or the density of prose, if that is less) and dives where none does any more;
the text from the first surge to the last dive is kept. What only touches those points, as menus of links and
short lines in boxes of their own, is not part of it; headings at them, and unlinked lines in a container of the
article's lines, are. An article or main element that holds most of the unlinked text is evidence that the rest
is not the article; what is in an article element is kept. An element with the class of a notice or the like, or a
form, that holds the article or most of the page's text is the page's layout and is not emptied, and within an
article or main element a class means something only as a whole."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A tag ends at its '>' or, lacking one, before the next '<': no page makes a search run to its end at every start.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^<>]*+(?:>|(?=<)|\Z)"
                   r"|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/<>]*+)(?P<attrs>(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^<>])*+)(?:>|(?=<)|\Z)", re.S)
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "noscript", "template", "iframe", "xmp", "title")}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
             "small span strike strong sub sup time tt u var wbr img".split())
DROPPED = set("nav header footer aside form button select svg canvas audio video object dialog menu map math fieldset "
              "head noframes figure".split()) - {"figure", "math"}
NOISE = re.compile(r"(^|[\s_-])(ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|nav|navbar|navigation|menu\w*|sidebar\w*|"
                   r"side-?bar|aside|footer\w*|header|masthead|breadcrumbs?|cookies?|consent|gdpr|notices?|alert|popup|modal|"
                   r"overlay|comments?|commentlist|respond|disqus|replies|reply|social|share\w*|sharing|related|recommend\w*|"
                   r"newsletter|subscribe\w*|subscription|signup|login|search|widget\w*|toolbar|pagination|pager|skip-?link|"
                   r"copyright|disclaimer|hidden|tags?|toc)($|[\s_-])", re.I)
#: What such a name means inside an article: only as a whole, with words of layout around it.
_PLACE = (r"(?:box|block|slot|unit|wrap(?:per)?|container|inner|outer|list|section|area|panel|bar|buttons?|links?|items?|form|"
          r"top|bottom|left|right|inline|site|page|post|posts|article|articles|stories|content|reader|user|thread|[0-9]+)")
_PART = (r"(?:ads?|advert(?:s|ising|isement|isements)?|sponsor(?:ed|s)?|promos?|promotions?|banners?|nav|navbar|navigation|menus?|"
         r"sidebar|aside|footer|header|masthead|breadcrumbs?|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|comments?|"
         r"commentlist|respond|disqus|replies|reply|social|share|sharing|related|recommended|recommendations?|newsletter|"
         r"subscribe|subscription|signup|login|search|widgets?|toolbar|pagination|pager|skiplink|copyright|disclaimer|hidden|toc)")
WHOLE_NOISE = re.compile(rf"(?:{_PLACE}[-_]+)*{_PART}(?:[-_]+(?:{_PLACE}|{_PART}))*", re.I)
ROLES = re.compile(r"navigation|banner|contentinfo|complementary|search|form|dialog|alert|menu", re.I)
ATTR = re.compile(r"\b(class|id|role|aria-hidden|hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
#: What such a name stands for is not the article, however long it is.
APART = re.compile(r"(^|\s)(comments?|comment-?list|respond|disqus|replies|related|sidebar|footer|copyright|disclaimer)($|\s)", re.I)
MAIN = {"article", "main"}
#: An open element of these is closed by the next one, whatever lies between.
CLOSED_BY = {"p", "li", "dt", "dd", "td", "th", "tr", "option"}
#: Lines in these belong to the container around them.
PARTS = CLOSED_BY | set("h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre figure figcaption table thead tbody tfoot caption center address".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
GAP = 4  # empty lines that a dropped element outside the article leaves: more than a window


def is_noise(tag: str, attrs: str, inside: bool = False) -> bool:
    """Is the element no part of an article, by its kind? ``inside``: it lies in an article or main element."""
    if tag in DROPPED:
        return True
    if tag in MAIN or tag in ("body", "html") or not attrs:
        return False
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            if any(map(WHOLE_NOISE.fullmatch, value.split())) if inside else NOISE.search(value):
                return True
        elif (name == "role" and ROLES.fullmatch(value)) or (name == "hidden") or (
                name == "aria-hidden" and value.lower() == "true") or (
                name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return True
    return False


def is_layout(tag: str, attrs: str) -> bool:
    """May this noise element be the layout around the article, by its kind: a form, or of a class or an id
    that does not name a part of its own, and shown?"""
    if tag in ("form", "fieldset"):
        return True
    if tag in DROPPED:
        return False
    values = [(name.lower(), value.strip("\"'")) for name, value in ATTR.findall(attrs)]
    return not any(name not in ("class", "id") or APART.search(value) for name, value in values
                   if name in ("class", "id") or is_noise("", f"{name}='{value}'"))


#: (text, length without link text, start of its container in the page or -1, 2 in an article, 1 in main, else 0,
#: is a heading)
Line = tuple[str, int, int, int, bool]
BLANK: Line = ("", 0, -1, 0, False)


def lines_of(page: str) -> list[Line]:
    """The page's lines; one without text is ``BLANK``."""
    lines, kept_main, noise, total, in_main = scan(page, frozenset())
    # Text in a clean article or main: nothing that is dropped holds the article.
    spared = set()
    if not kept_main:
        for start, layout, text, main, own_main in sorted(noise):  # outer elements first
            if not kept_main and 2 * main > in_main or layout and 2 * text > total:
                spared.add(start)
                kept_main += own_main
    return scan(page, frozenset(spared))[0] if spared else lines


def scan(page: str, spared: frozenset[int]) -> tuple[list[Line], int, list[tuple[int, bool, int, int, int]], int, int]:
    """Lines; unlinked text kept in article or main; the noise elements (start, may be layout, unlinked text,
    unlinked text in article or main, and that without inner noise), not those that begin at ``spared``; unlinked text of the page, and in
    article or main."""
    lines: list[Line] = []
    parts: list[str] = []
    linked = 0
    # open elements: (tag, dropped, start, start of the container, place of the innermost that a part does not close)
    stack: list[tuple[str, bool, int, int, int]] = []
    places: dict[str, list[int]] = defaultdict(list)  # of a tag's open elements in the stack
    dropped = links = main = total = in_main = kept_main = 0
    began: dict[int, list] = {}  # open noise elements: may be layout, text before, in main before, in main of inner noise
    noise: list[tuple[int, bool, int, int, int]] = []

    def end_line(gap: int = 0):
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            where = 2 if places["article"] else 1 if main else 0
            lines.append((text, max(0, len(text) - linked), stack[-1][3] if stack else -1, where,
                          bool(stack) and stack[-1][0] in HEADINGS))
        lines.extend([BLANK] * gap)
        linked = 0

    def say(s: str):
        nonlocal linked, total, in_main, kept_main
        if s and not links:
            n = len("".join(s.split()))
            total += n
            if main:
                in_main += n
                kept_main += 0 if dropped else n
        if not dropped and s:
            parts.append(s)
            if links:
                linked += len(s)

    def weigh(start: int):
        layout, text, before, inner = began.pop(start)
        noise.append((start, layout, total - text, in_main - before, in_main - before - inner))
        if began:
            began[next(reversed(began))][3] += in_main - before

    def pop():
        nonlocal dropped, links, main
        tag, off, start, _, _ = stack.pop()
        places[tag].pop()
        if off:
            weigh(start)
        dropped -= off
        links -= tag == "a"
        main -= tag in MAIN
        if off and not dropped:
            end_line(0 if main else GAP)

    at = 0
    while m := TOKEN.search(page, at):
        say(page[at:m.start()])
        at = m.end()
        if m["tag"] is None:
            if m["cdata"]:
                say(html.escape(m["cdata"]))
            continue
        tag = m["tag"].lower()
        if m["close"]:
            if places[tag]:
                # an end tag of a part of the page does not close what lies outside its article
                while stack[-1][0] != tag:
                    pop()
                if tag not in INLINE:
                    end_line()
                pop()
            elif tag not in INLINE:
                end_line()
            continue
        if tag in RAW:
            end = RAW[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag not in INLINE:
            end_line()
        if tag in VOID or m["attrs"].endswith("/"):
            continue
        if tag in CLOSED_BY and places[tag] and places[tag][-1] > (stack[-1][4] if stack else -1):
            k = places[tag][-1]
            while len(stack) > k:
                pop()
        off = m.start() not in spared and is_noise(tag, m["attrs"], main > 0)
        if off:
            began[m.start()] = [is_layout(tag, m["attrs"]), total, in_main, 0]
        if off and not dropped:
            end_line(0 if main else GAP)
        around, block = (stack[-1][3], stack[-1][4]) if stack else (-1, -1)
        stack.append((tag, off, m.start(), around if tag in INLINE or tag in PARTS else m.start(),
                      block if tag in INLINE or tag in CLOSED_BY else len(stack)))
        places[tag].append(len(stack) - 1)
        dropped += off
        links += tag == "a"
        main += tag in MAIN
        if tag in MAIN and main == 1 and not dropped:
            end_line(GAP)
    say(page[at:])
    end_line()
    for start in list(reversed(began)):
        weigh(start)
    return lines, kept_main, noise, total, in_main


def main_text(page: str | None, window: int = 3, share: float = 0.25, prose: int = 86) -> str:
    """The text between surge and dive points of the line-block distribution, lines joined by a space. ``share``
    of the highest window sum, ``prose`` characters at most, is where text surges and dives."""
    lines = lines_of(page or "")
    inside = sum(x[1] for x in lines if x[3])
    if inside and 2 * inside >= sum(x[1] for x in lines):
        lines = [x if x[3] else BLANK for x in lines]
    size = [x[1] for x in lines]
    upto = [0, *accumulate(size)]
    sums = [upto[min(i + window, len(lines))] - upto[i] for i in range(len(lines))]
    low = min(share * max(sums, default=0), prose)
    body = [s > 0 and window * s >= low for s in size]
    around = {x[2] for x, b in zip(lines, body) if b}

    def joins(k: int) -> bool:
        """Is this line one of the article's where text surges or dives?"""
        text, n, at, where, heading = lines[k]
        return bool(text) and (body[k] or heading or where == 2 or n > 0 and (where == 1 or at in around))

    high = [i for i, s in enumerate(sums) if s and s >= low]
    if not high:
        return " ".join(x[0] for x in lines if x[3] == 2 and x[0])
    first, last = high[0], min(high[-1] + window, len(lines))
    while not joins(first):
        first += 1
    while not joins(last - 1):
        last -= 1
    out = []
    for k, (text, n, at, where, heading) in enumerate(lines):
        if not text:
            continue
        if where == 2 or (n > 0 or at in around or heading if first <= k < last else n > 0 and (where or at in around)):
            out.append(text)
    return " ".join(out)


def extract_main_text(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with ``out_col``: the main text of each whole page.

    A null or empty page, and one without text, give an empty string; equal peaks are all kept; repeated
    rows are treated alike; no rows give no rows; a same-named column is replaced."""
    @F.pandas_udf("string")
    def run(col: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in col], dtype=object)
    return pages.withColumn(out_col, run(F.col(html_col)))
