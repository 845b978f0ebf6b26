"""Web pages as a source: title, canonical address, metadata and blocks.

Fetching lies outside Spark; the table pages(url, html) stands for what a crawl brought.
Columns that a pattern can find stay in the JVM; the walk over the page is in Arrow batches.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements without content of their own, and those that begin a block.
SKIP = {"script", "style", "noscript", "template", "svg", "nav", "footer", "aside", "form", "iframe", "head"}
BLOCKS = {"p": "paragraph", "li": "list", "pre": "code", "table": "table", "blockquote": "quote", "td": "table", "th": "table"} | {f"h{i}": "heading" for i in range(1, 7)}
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "#39": "'", "nbsp": " ", "copy": "©", "middot": "·"}


def decode(text: Column) -> Column:
    """The common character references, the ampersand last."""
    for name, char in [*((n, c) for n, c in NAMED.items() if n != "amp"), ("amp", "&")]:
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return text


def title(html: Column) -> Column:
    """The text of <title>, white space collapsed; null if there is none."""
    raw = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    flat = F.trim(F.regexp_replace(decode(raw), r"\s+", " "))
    return F.when(flat != "", flat)


def looks_like_html(content: Column) -> Column:
    return F.substring(content, 1, 2048).rlike(r"(?is)<!doctype html|<html|<head|<body")


def allowed(url: Column, allow: list[str] = (), deny: list[str] = ()) -> Column:
    out = F.lit(True)
    if allow:
        out = url.rlike("|".join(f"(?:{p})" for p in allow))
    if deny:
        out = out & ~url.rlike("|".join(f"(?:{p})" for p in deny))
    return out


class _Walk(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, str]] = []
        self.kind, self.level, self.parts, self.skip = "paragraph", 0, [], []

    def flush(self) -> None:
        raw = "".join(self.parts)
        text = raw.strip("\n") if self.kind == "code" else " ".join(raw.split())
        if text.strip():
            self.blocks.append((self.kind, self.level, text))
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in SKIP:
            self.flush()
            self.skip.append(tag)
        elif not self.skip and (tag in BLOCKS or tag in ("div", "section", "article", "main", "ul", "ol")):
            self.flush()
            self.kind, self.level = BLOCKS.get(tag, "paragraph"), int(tag[1]) if tag[0] == "h" and tag[1:].isdigit() else 0
        elif tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if self.skip:
            if tag in self.skip:
                del self.skip[self.skip.index(tag) :]
        elif tag in BLOCKS:
            self.flush()
            self.kind, self.level = "paragraph", 0

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def parse_html(html: str) -> list[tuple[str, int, str]]:
    """(kind, heading level, text) of each block outside the page's chrome."""
    w = _Walk()
    w.feed(html or "")
    w.close()
    w.flush()
    return w.blocks


def to_markdown(blocks: list[tuple[str, int, str]]) -> str:
    """Blocks as Markdown, which the chunker reads."""
    form = {"heading": lambda n, t: "#" * n + " " + t, "list": lambda n, t: "- " + t, "code": lambda n, t: f"```\n{t}\n```", "quote": lambda n, t: "> " + t}
    return "\n\n".join(form.get(k, lambda n, t: t)(n, t) for k, n, t in blocks)


def _parse(batches):
    for batch in batches:
        found = [parse_html(h) for h in batch.column("html").to_pylist()]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("level", pa.int32()), ("text", pa.string())]))
        rows = [[{"kind": k, "level": n, "text": t} for k, n, t in b] for b in found]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(rows, kind), pa.array([to_markdown(b) for b in found])], ["page_id", "blocks", "markdown"])


def parse_pages(pages: DataFrame) -> DataFrame:
    """(page_id, blocks, markdown) of each page."""
    return pages.select("page_id", "html").mapInArrow(_parse, "page_id long, blocks array<struct<kind:string,level:int,text:string>>, markdown string")
