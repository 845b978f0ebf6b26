"""Front matter and MDX of Markdown files as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.patterns import LEVELS
from corpusloom.functions.text import let

_ENTRY = r"(?m)^([A-Za-z_][A-Za-z0-9_.-]*):[ \t]*((?:.*)(?:\n[ \t]*-[ \t]+.*)*)"


def front(text: Column) -> Column:
    """What stands between the rules at the very beginning; empty if nothing does."""
    return F.regexp_extract(text, r"(?s)\A---[ \t]*\r?\n(.*?)(?:\n)?---[ \t]*(?:\r?\n|\z)", 1)


def body(text: Column) -> Column:
    """The text behind the front matter."""
    return F.regexp_replace(text, r"(?s)\A---[ \t]*\r?\n.*?(?:\n)?---[ \t]*(?:\r?\n|\z)", "")


def _scalar(value: Column) -> Column:
    """A plain or quoted value; what follows a sharp after a space is a comment."""
    bare = F.trim(F.regexp_replace(value, r"[ \t]#.*$", ""))
    return F.when(bare.rlike(r"""^(["']).*\1$"""), F.substring(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare)


def _value(raw: Column) -> Column:
    """Lists, in brackets or one item a line, are joined by a comma."""
    flow = F.transform(F.split(F.regexp_extract(raw, r"(?s)^\[(.*)\][ \t]*$", 1), ","), lambda x: _scalar(F.trim(x)))
    items = F.transform(F.regexp_extract_all(raw, F.lit(r"\n[ \t]*-[ \t]+(.*)"), F.lit(1)), _scalar)
    return F.when(raw.rlike(r"(?s)^\[.*\][ \t]*$"), F.array_join(F.filter(flow, lambda x: x != ""), ", ")).when(F.size(items) > 0, F.array_join(items, ", ")).otherwise(_scalar(raw))


def front_matter(text: Column) -> Column:
    """The front matter's fields by name: single values and lists of them, the last of equal names.
    Nested fields are left out."""

    def fields(raw: Column) -> Column:
        names, values = (F.regexp_extract_all(raw, F.lit(_ENTRY), F.lit(i)) for i in (1, 2))

        def last(n: Column) -> Column:
            return let(names, lambda all_: F.get(values, F.size(all_) - F.array_position(F.reverse(all_), n).cast("int")))

        return F.map_from_entries(F.transform(F.array_distinct(names), lambda n: F.struct(n.alias("key"), _value(last(n)).alias("value"))))

    return let(front(text), fields)


def raise_only(level: Column, requested: Column) -> Column:
    """The stricter of two levels: a file may raise its level but never lower it; an unknown wish is none."""
    rank = lambda c: F.coalesce(F.array_position(F.array(*map(F.lit, LEVELS)), c), F.lit(0))
    return F.when(rank(requested) > rank(level), requested).otherwise(level)


def strip_mdx(text: Column) -> Column:
    """Markdown of an MDX file: without its imports, exports and component tags; what components enclose stays."""
    plain = F.regexp_replace(text, r"(?m)^(?:import|export)\s.*(?:\n|\z)", "")
    return F.regexp_replace(plain, r"""</?[A-Z][A-Za-z0-9.]*(?:\s+[^<>]*?)?/?>""", "")
