"""The main subtree of a page, by a document tree kept as arrays.

A page becomes one array of nodes in pre-order with the end of each node's subtree, so the
length of the text, of the linked text and of the markup in any subtree is a difference of two
prefix sums: all candidates of a page are judged in one pass over arrays, however deep it is.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.session import spread

# What is no content, which containers count as the main one in which order, and
# the elements among which else the densest is taken.
CHROME_TAGS = {"script", "style", "noscript", "iframe", "svg", "canvas", "template", "nav", "footer", "header", "aside", "form", "button"}
CHROME_ROLES = {"navigation", "banner", "contentinfo"}
CHROME_CLASSES = {"cookie", "cookies", "cookie-banner", "sidebar", "breadcrumb", "breadcrumbs", "toc", "advert", "ads"}
MAIN = ("main", "article", "[role=main]", "#content", "#main", ".content", ".post", ".article")
CONTAINERS = ("div", "section", "article", "td")
LEAST = 200

# Elements without an end tag, and those that an element of the same group ends.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ENDED_BY = {"li": {"li"}, "p": {"p"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
SCOPES = {"table", "ul", "ol", "dl", "select", "div", "section", "article", "main", "body"}
BLOCK = {"p": "paragraph", "li": "list", "pre": "code", "table": "table", "blockquote": "quote", "dd": "paragraph", "dt": "paragraph", "figure": "paragraph", "hr": "paragraph"} | {f"h{i}": "heading" for i in range(1, 7)}


@dataclass
class Dom:
    """Nodes in pre-order; a text is a node of its own, with an empty tag."""

    tag: list[str] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    attrs: list[dict[str, str]] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    span: list[list[int]] = field(default_factory=list)  # of the source, from the start tag to the end of the end tag


class _Builder(HTMLParser):
    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.dom, self.open = Dom(), []
        self.lines = np.append(0, 1 + np.flatnonzero(np.frombuffer(html.encode("utf-32-le"), np.uint32) == 10))
        self.size = len(html)
        self.feed(html)
        self.close()
        while self.open:
            self._close(self.size)

    def _at(self) -> int:
        line, column = self.getpos()
        return min(int(self.lines[line - 1]) + column, self.size)

    def _add(self, tag: str, attrs: dict[str, str], text: str) -> None:
        d, at = self.dom, self._at()
        d.tag.append(tag)
        d.attrs.append(attrs)
        d.text.append(text)
        d.end.append(len(d.tag))
        d.span.append([at, at + len(self.get_starttag_text() or "") if tag else at + len(text)])

    def _close(self, at: int) -> None:
        i = self.open.pop()
        self.dom.end[i] = len(self.dom.tag)
        self.dom.span[i][1] = max(at, self.dom.span[i][1])

    def handle_starttag(self, tag, attrs):
        if tag in ENDED_BY:
            for back in range(len(self.open) - 1, -1, -1):
                name = self.dom.tag[self.open[back]]
                if name in ENDED_BY[tag]:
                    while len(self.open) > back:
                        self._close(self._at())
                    break
                if name in SCOPES:
                    break
        self._add(tag, {k: v or "" for k, v in attrs}, "")
        if tag not in VOID:
            self.open.append(len(self.dom.tag) - 1)

    def handle_startendtag(self, tag, attrs):
        self._add(tag, {k: v or "" for k, v in attrs}, "")

    def handle_endtag(self, tag):
        for back in range(len(self.open) - 1, -1, -1):
            if self.dom.tag[self.open[back]] == tag:
                while len(self.open) > back:
                    self._close(self._at() + (len(tag) + 3 if len(self.open) == back + 1 else 0))
                return

    def handle_data(self, data):
        if data:
            self._add("", {}, data)


def build(html: str) -> Dom:
    return _Builder(html or "").dom


def clean(text: str) -> str:
    return " ".join(text.split())


def _classes(attrs: dict[str, str]) -> set[str]:
    return set(attrs.get("class", "").split())


def is_chrome(tag: str, attrs: dict[str, str]) -> bool:
    return tag in CHROME_TAGS or attrs.get("role") in CHROME_ROLES or attrs.get("aria-hidden") == "true" or bool(CHROME_CLASSES & _classes(attrs))


def matches(selector: str, tag: str, attrs: dict[str, str]) -> bool:
    if selector[0] == "#":
        return attrs.get("id") == selector[1:]
    if selector[0] == ".":
        return selector[1:] in _classes(attrs)
    return attrs.get("role") == "main" if selector[0] == "[" else tag == selector


@dataclass
class Sums:
    """For each node: length of its subtree's text (pieces cleaned and joined by a space), of
    the links in it, and of its markup; `shown` tells nodes outside the page's chrome."""

    text: np.ndarray
    links: np.ndarray
    markup: np.ndarray
    shown: np.ndarray


def sums(d: Dom) -> Sums:
    n = len(d.tag)
    end = np.array(d.end, np.int64)
    chrome = np.array([bool(t) and is_chrome(t, a) for t, a in zip(d.tag, d.attrs, strict=True)], bool)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, np.flatnonzero(chrome), 1)
    np.add.at(cover, end[chrome], -1)
    depth = np.cumsum(cover)[:n]
    shown = depth == 0
    span = np.array(d.span, np.int64).reshape(-1, 2)
    own = np.array([len(clean(t)) + 1 if t and s and t.strip() else 0 for t, s in zip(d.text, shown, strict=True)], np.int64)
    total = lambda x: np.append(0, np.cumsum(x))
    within = lambda sums_: sums_[end] - sums_[:n]
    text = np.maximum(within(total(own)) - 1, 0)
    anchor = np.array([t == "a" for t in d.tag], bool) & shown
    outermost = chrome & (np.append(0, depth[:-1]) == 0) if n else chrome  # chrome that begins here
    outermost |= chrome & (depth == 1)
    gone = np.where(outermost, span[:, 1] - span[:, 0], 0) if n else np.zeros(0, np.int64)
    return Sums(text, within(total(np.where(anchor, text, 0))), np.maximum(span[:, 1] - span[:, 0] - within(total(gone)), 1), shown)


def main_node(d: Dom, s: Sums) -> int:
    """The first match of the first selector whose first match has LEAST characters; else the
    container of the highest density of unlinked text times the root of its length; else the body (-1: no body)."""
    seen = np.flatnonzero(s.shown)
    for selector in MAIN:
        first = next((i for i in seen if d.tag[i] and matches(selector, d.tag[i], d.attrs[i])), None)
        if first is not None and s.text[first] >= LEAST:
            return int(first)
    body = next((int(i) for i in seen if d.tag[i] == "body"), -1)
    lo, hi = (body + 1, d.end[body]) if body >= 0 else (0, len(d.tag))
    rows = np.array([i for i in seen if lo <= i < hi and d.tag[i] in CONTAINERS and s.text[i] >= LEAST], np.int64)
    if not len(rows):
        return body
    score = (s.text[rows] - s.links[rows]) / s.markup[rows] * np.sqrt(s.text[rows])
    return int(rows[score.argmax()]) if score.max() > 0 else body


def blocks(d: Dom, s: Sums, root: int) -> list[tuple[str, int, str]]:
    """(kind, heading level, text) of the blocks below `root`, outside the chrome."""
    lo, hi = (root, d.end[root]) if root >= 0 else (0, len(d.tag))
    kind_of = [("paragraph", 0)] * (hi - lo + 1)
    breaks = np.zeros(hi - lo + 1, bool)
    for i in range(lo, hi):  # a block element rules its subtree; an inner one rules its own
        if d.tag[i] in BLOCK or d.tag[i] in ("div", "section", "article", "main", "ul", "ol", "tr", "body", "td", "th"):
            kind = BLOCK.get(d.tag[i])
            for edge in (i, d.end[i]):
                breaks[min(edge, hi) - lo] = True
            if kind:
                level = int(d.tag[i][1]) if kind == "heading" else 0
                kind_of[i - lo : d.end[i] - lo] = [(kind, level)] * (min(d.end[i], hi) - i)
    out, parts, now = [], [], ("paragraph", 0)

    def flush():
        raw = "".join(parts)
        text = raw.strip("\n") if now[0] == "code" else clean(raw)
        if text.strip():
            out.append((*now, text))
        parts.clear()

    for i in range(lo, hi):
        if breaks[i - lo]:
            flush()
        if s.shown[i]:
            if d.tag[i] == "br":
                parts.append(" ")
            elif d.text[i]:
                now = kind_of[i - lo]
                parts.append(d.text[i])
    flush()
    return out


def _first(d: Dom, tag: str, **attrs: str) -> int | None:
    return next((i for i in range(len(d.tag)) if d.tag[i] == tag and all(d.attrs[i].get(k) == v for k, v in attrs.items())), None)


def _text(d: Dom, i: int) -> str:
    return clean("".join(d.text[i : d.end[i]]))


def metadata(d: Dom, url: str | None) -> tuple[str | None, str | None, str | None, dict[str, str]]:
    """(title, canonical address on the page's own host, language, named metadata)."""
    i, og, h1 = _first(d, "title"), _first(d, "meta", property="og:title"), _first(d, "h1")
    title = (_text(d, i) if i is not None else "") or (clean(d.attrs[og].get("content", "")) if og is not None else "") or (_text(d, h1) if h1 is not None else "")
    link = _first(d, "link", rel="canonical")
    href = d.attrs[link].get("href", "") if link is not None else ""
    try:
        same = urlparse(href).scheme in ("http", "https") and urlparse(href).netloc.lower() == urlparse(url or "").netloc.lower()
    except ValueError:  # no address
        same = False
    html = _first(d, "html")
    named = {}
    for a in (d.attrs[i] for i in range(len(d.tag)) if d.tag[i] == "meta"):
        key = a.get("property", "") if a.get("property", "").startswith("og:") else a.get("name", "")
        if a.get("content") and (key.startswith("og:") or key in ("description", "author")):
            named[key] = clean(a["content"])[:500]
    return title or None, href if same else None, (d.attrs[html].get("lang") or None) if html is not None else None, named


def links(html: str, url: str) -> list[str]:
    """Addresses that a page's anchors lead to, in order, resolved against its base."""
    d = build(html)
    base = next((d.attrs[i].get("href", "") for i in range(len(d.tag)) if d.tag[i] == "base" and d.attrs[i].get("href")), "")
    out = []
    for i in range(len(d.tag)):
        if d.tag[i] == "a" and "href" in d.attrs[i]:
            try:
                out.append(urljoin(urljoin(url, base), d.attrs[i]["href"].split("#", 1)[0]))
            except ValueError:  # no address
                continue
    return out


_BLOCKS = pa.list_(pa.struct([("kind", pa.string()), ("level", pa.int32()), ("text", pa.string())]))
_KINDS = {"main_tag": pa.string(), "n_nodes": pa.int32(), "n_chars": pa.int64(), "n_link_chars": pa.int64(), "n_markup": pa.int64(), "title": pa.string(), "canonical": pa.string(), "lang": pa.string(), "meta": pa.map_(pa.string(), pa.string()), "blocks": _BLOCKS}


def _page(html: str | None, url: str | None) -> tuple:
    d = build(html or "")
    s = sums(d)
    i = main_node(d, s)
    title, canonical, lang, named = metadata(d, url)
    whole = (int(s.text[i]), int(s.links[i]), int(s.markup[i])) if i >= 0 else (0, 0, 0)
    rows = [{"kind": k, "level": n, "text": t} for k, n, t in blocks(d, s, i)]
    return (d.tag[i] if i >= 0 else None, len(d.tag), *whole, title, canonical, lang, list(named.items()), rows)


def _parse(batches):
    for batch in batches:
        found = [_page(h, u) for h, u in zip(batch.column("html").to_pylist(), batch.column("url").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *(pa.array([f[i] for f in found], k) for i, k in enumerate(_KINDS.values()))], ["page_id", "url", *_KINDS])


def main_subtree(pages: DataFrame) -> DataFrame:
    """The main subtree of each of pages(page_id, url, html): its element (null: no body), the
    lengths it was chosen by, the page's metadata, and its blocks. A null page has none."""
    kind = pages.schema["page_id"].dataType.simpleString()
    return spread(pages.select("page_id", "url", "html")).mapInArrow(_parse, f"page_id {kind}, url string, main_tag string, n_nodes int, n_chars long, n_link_chars long, n_markup long, title string, canonical string, lang string, meta map<string,string>, blocks array<struct<kind:string,level:int,text:string>>")
