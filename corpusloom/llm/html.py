"""Main text of HTML pages by the distribution of text over line blocks.

Markup is stripped into lines, one for each block of text; what belongs to menus,
headers, footers, sidebars, adverts, forms and comments leaves a gap of empty
lines. The text lengths of each window of lines are summed: where the sums surge
a stretch of main text begins, where they dive to nothing it ends, and the lines
between are kept. An element that marks the article adds weight to its lines, so
any of them surges; it takes nothing from the text around it.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in a window; the sum at which text surges at the latest (a page whose largest sum is
#: smaller surges there), and the weight of a character in an element that marks the article.
WINDOW, SURGE = 3, 80
#: A line counts as a menu if more than this share of its text is links.
LINKS = 0.6

# Elements by role, and words in class, id and role that mark boilerplate.
RAW = {"script", "style", "title", "noscript", "template", "iframe", "textarea", "svg", "object", "math", "canvas", "noframes", "xmp", "noembed"}
CHROME = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "audio", "video", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary",
    "table", "tbody", "tfoot", "thead", "tr", "ul",
}
MARKED = {
    "ad", "ads", "adbox", "adsense", "advert", "advertisement", "adverts", "alert", "banner", "breadcrumb", "breadcrumbs", "captcha",
    "comment", "commentlist", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "gdpr",
    "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo",
    "promoted", "promotion", "recommended", "related", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor",
    "responses", "sponsored", "subscribe", "toolbar", "topbar", "widget", "widgets",
}
#: Words that may stand beside those in one name ("ad-box", "site-footer", "related-posts").
BESIDE = {
    "area", "articles", "bar", "block", "bottom", "box", "container", "form", "global", "group", "header", "inner", "items", "left", "links", "list",
    "body", "content", "main", "message", "outer", "page", "text", "title", "panel", "post", "posts", "right", "section", "site", "slot", "stories", "thread", "top", "unit", "wrap", "wrapper",
}
COMMENTS = {"comment", "comments", "commentlist", "replies", "responses", "disqus"}
ROOTS = {"html", "body", "main", "article"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}

_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*\Z""", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")


def _named(value: str, words: set[str]) -> bool:
    """Whether a whole name of the value is made of `words`, beside words that say nothing."""
    for name in value.split():
        parts = {x for x in re.split(r"[-_:]+", re.sub(r"\d+", "", name)) if x}
        if parts & words and parts <= words | BESIDE:
            return True
    return False


def _boilerplate(name: str, attrs: str, inside: bool) -> bool:
    """Whether an element holds no main text; inside: within an article.

    Names count for block elements alone, so no words of a line are lost, and not for
    headings; within an article an id, which may come from a title, only for comments."""
    if name in CHROME or (name == "header" and not inside):
        return True
    if not attrs:
        return False
    named = False
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True
        if name not in BLOCK or name in HEADINGS or key not in ("class", "id", "role"):
            continue
        if name in ROOTS:
            named |= name == "article" and _named(value, COMMENTS)
        elif key == "id" and inside:
            named |= _named(value, COMMENTS)
        else:
            named |= _named(value, MARKED) or (not inside and value.split() == ["header"])
    return named


def lines_of(page: str) -> list[tuple[str, int, int]]:
    """(text, link characters, container) for each line; container: 2 in an article, 1 in main, 0.

    Boilerplate leaves WINDOW empty lines."""
    out: list[tuple[str, int, int]] = []
    open_: list[str] = []
    count: Counter[str] = Counter()  # of the names in open_
    words: list[str] = []
    state = {"article": 0, "main": 0, "a": 0}
    links = skip = at = 0  # skip: depth of `open_` at which the boilerplate began

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(words).split())
        if text:
            out.append((text, min(links, len(text)), 2 if state["article"] else 1 if state["main"] else 0))
        words.clear()
        links = 0

    def text(raw: str) -> None:
        nonlocal links
        if raw and not skip:
            raw = unescape(raw)
            words.append(raw)
            if state["a"]:
                links += len(raw.strip())

    def close(depth: int) -> None:
        nonlocal skip
        for n in open_[depth:]:
            count[n] -= 1
            if n in state:
                state[n] -= 1
        del open_[depth:]
        if skip and depth < skip:
            skip = 0

    n = len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if not m:  # a bare "<" is text
            text(page[at : lt + 1])
            at = lt + 1
            continue
        text(page[at:lt])
        at = m.end()
        if not m.lastindex or m.group(2) is None:
            continue
        end, name, attrs = m.group(1), m.group(2).lower(), m.group(3)
        if end:
            if count[name]:
                if name in BLOCK and not skip:
                    flush()
                d = len(open_) - 1
                while open_[d] != name:
                    d -= 1
                close(d)
            elif name == "p" and not skip:
                flush()
            continue
        if name in RAW:
            shut = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = shut.end() if shut else n
            if not skip:
                words.append(" ")
            continue
        if name in BLOCK and not skip:
            flush()
        elif name in ("br", "td", "th") and not skip:
            words.append(" ")
        if name in VOID or attrs.endswith("/") and name not in BLOCK:
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and count[name] and not skip:
            # These end an open one of their kind, unless a list or table stands between.
            for d in range(len(open_) - 1, -1, -1):
                if open_[d] == name:
                    close(d)
                    break
                if open_[d] in BLOCK and open_[d] != "p" or open_[d] == "td":
                    break
        if not skip and _boilerplate(name, attrs, bool(state["article"])):
            if name in BLOCK or name in CHROME and name not in ("button", "select"):
                flush()
                out += [("", 0, 0)] * WINDOW
            open_.append(name)
            count[name] += 1
            skip = len(open_)
            if name in state:
                state[name] += 1
            continue
        open_.append(name)
        count[name] += 1
        if name in state:
            state[name] += 1
    if not skip:
        flush()
    return out


def surges(sizes: list[int], surge: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """Line ranges from a surge point to the next dive point: the stretches that hold a
    window that reaches `surge`."""
    return [(a, b) for a, b, top in stretches(sizes, window) if top >= surge]


def stretches(sizes: list[int], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(first line, line after the last, largest sum) of each run of windows that are not
    empty. sums[i] adds the sizes of lines i .. i + window - 1."""
    n = len(sizes)
    total = [0]
    for s in sizes:
        total.append(total[-1] + s)
    sums = [total[min(i + window, n)] - total[i] for i in range(n)]
    out, i = [], 0
    while i < n:
        if not sums[i]:
            i += 1
            continue
        j = i
        while j < n and sums[j]:
            j += 1
        first = next(x for x in range(i, n) if sizes[x])
        last = next(x for x in range(min(j, n) - 1, -1, -1) if sizes[x])
        out.append((first, last + 1, max(sums[i:j])))
        i = j
    return out


def main_text(page: str | None) -> str:
    """The article of a page, its blocks joined by line ends; empty if there is none."""
    if not page:
        return ""
    lines = lines_of(page)
    sizes = [len(t) * SURGE if c else len(t) if k <= LINKS * len(t) else 0 for t, k, c in lines]
    found = stretches(sizes)
    surge = min(SURGE, max((top for *_, top in found), default=0))  # on a page of short lines the largest sums surge
    # Outside those elements, a short stretch between two that surge by their own text belongs to them.
    plain = [x for x, (a, b, _) in enumerate(found) if sum(sizes[i] for i in range(a, b) if not lines[i][2]) >= surge]
    between = range(plain[0], plain[-1]) if plain else range(0)
    kept = [(a, b) for x, (a, b, top) in enumerate(found) if top >= surge or x in between]
    return "\n".join(lines[i][0] for a, b in kept for i in range(a, b) if sizes[i])


def _extract(batches):
    for batch in batches:
        for lo in range(0, len(batch), 500):
            part = batch.slice(lo, 500)
            texts = [main_text(h) for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each page, n_chars in code points.

    Every row is returned, repeated and null ids and null addresses too; a null or empty
    page has an empty text. Pages of any length and nesting are read whole, in time in
    proportion to their length. Further columns, whatever their names, are ignored; an empty
    table gives no rows.
    """
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return base.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
