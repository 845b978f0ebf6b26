"""Blocks from the layout of pages: positioned spans of text, as a PDF reader gives them.

spans(document_id, page, height, x, x1, y, size, font, text): a piece of text in one font, with its
left and right edge and its top. Reading the file lies outside; from here on everything is a
DataFrame: lines, repeated bands, sizes of type, tables and paragraphs are groups and windows
over a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Height of a row, the bands in which running heads and feet stand, the share of the
# pages on which they repeat, how much larger than the body a heading is, levels of headings, and fonts of code.
ROW, BAND, REPEATED, LEAST_PAGES, LARGER, LEVELS = 3.0, 0.08, 0.6, 3, 1.15, 4
LONGEST_HEADING, LONGEST_BOLD = 120, 80
MONO = r"mono|courier|consol|menlo|code"
#: A gap between the columns of a table, in sizes of type.
GAP = 1.5


def lines(spans: DataFrame) -> DataFrame:
    """(document_id, page, height, row, y, size, bold, mono, text, cells) in reading order: spans of
    one row from left to right. cells: the texts between wide gaps. Spans without letters count for nothing."""
    font = F.lower(F.coalesce("font", F.lit("")))
    s = spans.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("row", F.round(F.col("y") / ROW).cast("long")).repartition("document_id")  # all that follows is by document
    span = F.struct("x", "x1", "y", F.round("size", 1).alias("size"), font.rlike("bold").alias("bold"), font.rlike(MONO).alias("mono"), "text")
    g = s.groupBy("document_id", "page", "row").agg(F.array_sort(F.collect_list(span)).alias("s"), F.max("height").alias("height"))
    wide = lambda i: F.get("s", i)["x"] - F.get("s", i - 1)["x1"] > GAP * F.get("s", i)["size"]
    marked = F.transform("s", lambda p, i: F.concat(F.when((i > 0) & wide(i), "\x1f").otherwise(F.when(i > 0, " ").otherwise("")), F.trim(p["text"])))
    joined = F.array_join(marked, "")
    length = lambda p: F.length(p["text"]).cast("long")
    most = F.array_max(F.transform("s", lambda p: F.struct(length(p).alias("n"), p["size"].alias("size"))))["size"]  # of the longest span
    g = g.select("document_id", "page", "row", "height", F.array_min(F.transform("s", lambda p: p["y"])).alias("y"), most.alias("size"), F.forall("s", lambda p: p["bold"]).alias("bold"), F.forall("s", lambda p: p["mono"]).alias("mono"), joined.alias("joined"))
    return g.select(*g.columns[:-1], F.trim(F.regexp_replace("joined", "\x1f| +", " ")).alias("text"), F.split("joined", "\x1f").alias("cells"))


def _running() -> Column:
    """Whether a line is a running head or foot: lines of the outer bands, digits aside, that stand on
    most pages of a document of LEAST_PAGES pages or more; such a line goes wherever it stands."""
    document = Window.partitionBy("document_id")
    inside = (F.col("y") < BAND * F.col("height")) | (F.col("y") > (1 - BAND) * F.col("height"))
    on = F.size(F.collect_set(F.when(inside, F.struct("page"))).over(Window.partitionBy("document_id", "norm")))
    n = F.max("page").over(document) - F.min("page").over(document) + 1
    return F.coalesce((n >= LEAST_PAGES) & (on >= F.greatest(F.lit(2), F.floor(REPEATED * n))), F.lit(False))


def _levels(lines_: DataFrame) -> DataFrame:
    """Adds body and headings: the size of most lines of the document (of equally many the smaller), and the larger ones from the largest on."""
    document = Window.partitionBy("document_id")
    by = lines_.withColumn("n", F.count("*").over(Window.partitionBy("document_id", "size")))
    by = by.withColumn("body", F.max(F.struct("n", (-F.col("size")).alias("s"), "size")).over(document)["size"]).withColumn("sizes", F.collect_set("size").over(document))
    return by.withColumn("headings", F.slice(F.sort_array(F.filter("sizes", lambda s: s >= F.col("body") * LARGER), False), 1, LEVELS)).drop("n", "sizes")


def _level(text: Column, size: Column, bold: Column) -> Column:
    """The level of a heading, 0 for other lines."""
    no = (F.length(text) > LONGEST_HEADING) | text.endswith(".") | (F.size("headings") == 0)
    at = F.array_position("headings", size)
    heavy = bold & (size >= F.col("body")) & (F.length(text) < LONGEST_BOLD)
    return F.when(no, 0).when(at > 0, at).when(heavy, F.least(F.size("headings") + 1, F.lit(6))).otherwise(0).cast("int")


def _table(rows: Column) -> Column:
    """Rows of cells as a Markdown table, the first one as its head, short ones filled up."""
    n = F.array_max(F.transform(rows, lambda r: F.size(r)))
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.trim(F.get(r, i)), F.lit(""))), " | "), F.lit(" |"))
    shown = F.transform(rows, row)
    return F.array_join(F.concat(F.slice(shown, 1, 1), F.array(F.concat(F.lit("|"), F.repeat(F.lit("---|"), n))), F.slice(shown, 2, 1_000_000_000)), "\n")


def blocks(spans: DataFrame) -> DataFrame:
    """(document_id, ordinal, page, kind, level, text) of a document's blocks in reading order.

    Running heads and feet go. A line is a heading by its size, or if it is bold throughout; code if
    all of it is in a font of code; rows with two cells or more that follow one another are a
    table from two rows on. Lines of one kind that follow one another on a page are one block; a
    word that was cut at a line's end is joined. Documents without text have no row. Spans are
    dealt by document once; sizes, heads and neighbours are windows over a document."""
    every = lines(spans.where("document_id is not null")).withColumn("norm", F.regexp_replace("text", r"\d+", "#"))
    kept = _levels(every.withColumn("running", _running())).where("not running")
    order = Window.partitionBy("document_id").orderBy("page", "row")
    kept = kept.withColumn("level", _level(F.col("text"), F.col("size"), F.col("bold")))
    row = (F.size("cells") >= 2) & (F.col("level") == 0)
    beside = lambda f: F.coalesce(f(row).over(order) & (f("page").over(order) == F.col("page")), F.lit(False))
    kind = F.when(F.col("level") > 0, "heading").when(row & (beside(F.lag) | beside(F.lead)), "table").when(F.col("mono"), "code").otherwise("paragraph")
    kept = kept.withColumn("kind", kind)
    same = (F.lag("kind").over(order) == F.col("kind")) & (F.lag("page").over(order) == F.col("page")) & (F.col("kind") != "heading")
    kept = kept.withColumn("ordinal", F.sum(F.when(same, 0).otherwise(1)).over(order) - 1)
    part = F.struct("row", "text", "cells")
    g = kept.groupBy("document_id", "ordinal", "page", "kind", "level").agg(F.array_sort(F.collect_list(part)).alias("p"))
    joined = lambda sep: F.array_join(F.transform("p", lambda x: x["text"]), sep)
    prose = F.regexp_replace(F.regexp_replace(joined("\n"), r"(\w)-\n(\w)", "$1$2"), "\n", " ")
    text = F.when(F.col("kind") == "table", _table(F.transform("p", lambda x: x["cells"]))).when(F.col("kind") == "code", joined("\n")).when(F.col("kind") == "heading", joined(" ")).otherwise(prose)
    return g.select("document_id", F.col("ordinal").cast("int").alias("ordinal"), "page", "kind", "level", text.alias("text"))


def documents(spans: DataFrame) -> DataFrame:
    """(document_id, blocks) for operators.assemble: pages and headings come along."""
    b = blocks(spans)
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "kind", "level", "text", "page")))
    return b.groupBy("document_id").agg(F.transform(parts, lambda x: F.struct(x["kind"].alias("kind"), x["level"].alias("level"), x["text"].alias("text"), x["page"].cast("int").alias("page"))).alias("blocks"))
