"""Documents from blocks: the text, and sorted arrays that tell where everything in it is.

A parser gives blocks with kind, level, text and page. Assembled, a document is one text and
arrays of offsets: where blocks, pages and lines begin, and for each block the nearest heading
above and for each heading its parent. Any stretch of the text then finds its pages, lines,
blocks and heading path by binary search, in Columns, without the text.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import let

BLOCKS = "array<struct<kind:string,level:int,text:string,page:int>>"
_MAP = "text string, block_starts array<int>, block_ends array<int>, page_starts array<int>, pages array<int>, line_starts array<int>, headings array<int>, parents array<int>, titles array<string>"


def render(kind: str, level: int | None, text: str) -> str:
    """A block as Markdown."""
    if kind == "heading":
        return f"{'#' * max(1, min(6, level or 1))} {text}"
    return {"list": f"- {text}", "code": f"```\n{text}\n```", "quote": "\n".join(f"> {line}" for line in text.split("\n"))}.get(kind, text)


def assemble_one(blocks: list[dict]) -> tuple:
    """The columns of _MAP for one document. Of pages that begin where no later block does, the
    last counts; blocks without a page are on the one before. A heading's parent is the last
    heading above it of a lower level; a block's heading is the last one, for a heading itself."""
    parts = [render(b["kind"], b["level"], b["text"] or "") for b in blocks]
    ends = list(accumulate(len(p) + 2 for p in parts))
    starts = [0, *ends[:-1]][: len(parts)]
    text = "\n\n".join(parts)
    page_starts: list[int] = []
    pages: list[int] = []
    for at, b in zip(starts, blocks, strict=True):
        if b["page"] is not None and (not pages or pages[-1] != b["page"]):
            page_starts.append(at)
            pages.append(b["page"])
    headings, parents, titles, stack = [], [], [], []
    for i, b in enumerate(blocks):
        parent = -1
        if b["kind"] == "heading":
            while stack and (blocks[stack[-1]]["level"] or 1) >= (b["level"] or 1):
                stack.pop()
            parent = stack[-1] if stack else -1
            stack.append(i)
        headings.append(stack[-1] if stack else -1)
        parents.append(parent)
        titles.append(b["text"] if b["kind"] == "heading" else None)
    lines = np.append(0, 1 + np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10)).tolist()
    return text, starts, [a + len(p) for a, p in zip(starts, parts, strict=True)], page_starts, pages, lines, headings, parents, titles


def assemble(docs: DataFrame, id_col: str = "document_id", blocks_col: str = "blocks") -> DataFrame:
    """(id, text and the arrays of _MAP) of each document; null blocks give an empty text."""
    kind = docs.schema[id_col].dataType.simpleString()
    arrays = [pa.string(), *[pa.list_(pa.int32())] * 7, pa.list_(pa.string())]
    names = [c.split()[0] for c in _MAP.split(", ")]

    def run(batches):
        for batch in batches:
            found = [assemble_one(b or []) for b in batch.column("blocks").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([f[i] for f in found], k) for i, k in enumerate(arrays))], ["id", *names])

    out = docs.select(F.col(id_col).alias("id"), F.col(blocks_col).cast(BLOCKS).alias("blocks")).mapInArrow(run, f"id {kind}, {_MAP}")
    return out.withColumnRenamed("id", id_col)


def count_up_to(values: Column, x: Column) -> Column:
    """How many of a sorted array's values are at most x, by binary search."""
    bound = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        return F.when(s["lo"] >= s["hi"], s).when(F.get(values, mid) <= x, bound(mid + 1, s["hi"])).otherwise(bound(s["lo"], mid))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1)).cast("int"))
    return F.aggregate(steps, bound(F.lit(0), F.size(values)), halve, lambda s: s["lo"])


def heading_path(at: Column, parents: Column, titles: Column) -> Column:
    """Titles from the outermost heading down to that of block `at` (-1: none)."""
    climb = lambda s, _: F.when(s["at"] < 0, s).otherwise(F.struct(F.get(parents, s["at"]).alias("at"), F.concat(F.array(F.get(titles, s["at"])), s["path"]).alias("path")))
    # a parent has a lower level, and there are six
    return F.aggregate(F.sequence(F.lit(1), F.lit(6)), F.struct(at.alias("at"), F.array().cast("array<string>").alias("path")), climb, lambda s: s["path"])


def locate(start: Column, end: Column) -> dict[str, Column]:
    """Where the stretch [start, end) of an assembled document lies, by its arrays: pages, lines (from 1), blocks
    (from 0) and the heading path of the first block. Pages are null where none is known."""
    last = F.greatest(start, end - 1)
    page = lambda at: let(count_up_to(F.col("page_starts"), at), lambda n: F.when(n > 0, F.get("pages", n - 1)))
    block = lambda at: count_up_to(F.col("block_starts"), at) - 1
    first = block(start)
    return {
        "page_start": page(start),
        "page_end": page(last),
        "line_start": count_up_to(F.col("line_starts"), start),
        "line_end": count_up_to(F.col("line_starts"), last),
        "block_start": first,
        "block_end": block(last),
        "heading_path": heading_path(let(first, lambda b: F.when(b >= 0, F.get("headings", b)).otherwise(F.lit(-1))), F.col("parents"), F.col("titles")),
    }


def locate_chunks(chunks: DataFrame, assembled: DataFrame) -> DataFrame:
    """Chunk rows with pages, lines, blocks and heading path from their documents' arrays; only the
    arrays meet them, the text stays behind."""
    places = locate(F.col("start_char"), F.col("end_char"))
    maps = assembled.drop("text")
    out = chunks.drop(*places).join(maps, "document_id")
    return out.withColumns(places).drop(*(c for c in maps.columns if c != "document_id"))
