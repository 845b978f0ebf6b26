"""From what a user typed to what the search legs are asked: one row in, one row out."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import patterns
from corpusloom.functions.text import let, normalise_query
from corpusloom.operators.answers import spell_correct

# Fixed value: code-like tokens, which are neither corrected nor lower-cased away.
PROTECTED = (
    r"(?:https?://\S+)|(?:[A-Za-z0-9_.-]+/[A-Za-z0-9_./-]+)|(?:\b[A-Z]{3}-[EW]\d{4}\b)|(?:\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b)"
    r"|(?:\b[a-z]+(?:_[a-z0-9]+)+\b)|(?:\b[a-z]+(?:[A-Z][a-z0-9]+)+\b)|(?:\bv?\d+\.\d+(?:\.\d+)?\b)|(?:`[^`]+`)"
)
QUERY_TOKEN = r"[\p{L}\p{N}_'`./:-]+"
#: The filters a caller may set, and the code of an empty query.
DIMENSIONS, EMPTY = ("source_type", "repo", "code_language", "updated_after"), "E6001"


def nfc(text: Column) -> Column:
    """Unicode composed form, which no built-in function makes; ASCII is left as it is."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))

    return run(text)


def protected(text: Column) -> Column:
    return F.array_distinct(F.transform(patterns.find_all(text, PROTECTED), lambda t: F.btrim(t, F.lit("`"))))


def query_tokens(text: Column) -> Column:
    return F.filter(patterns.find_all(text, QUERY_TOKEN), lambda t: F.btrim(t, F.lit("'`.:/-")) != "")


def process(queries: DataFrame, now: Column, vocab: DataFrame | None = None, dual: bool = True, q: str = "query_id", text_col: str = "text", hard: str = "filters") -> DataFrame:
    """Adds to each query: normalised, sparse_text, variants (texts to embed), tokens, protected,
    corrections, intent, top_k, sparse_weight, exact_terms, soft (filters to be relaxed) and
    error (E6001 for an empty one).

    Unprotected words that `vocab` lacks are corrected; with `dual`, the text as typed is
    embedded too. A filter that the caller sets (column `hard`, a struct, may be missing)
    takes the place of an inferred one of the same dimension."""
    base = queries.withColumn("normalised", normalise_query(nfc(F.col(text_col))))
    n = F.col("normalised")
    base = base.withColumns({"protected": protected(n), "tokens": query_tokens(n), "error": F.when(F.coalesce(n, F.lit("")) == "", EMPTY)})
    if vocab is None:
        base = base.withColumn("corrections", F.create_map().cast("map<string,string>"))
    else:
        free = base.select(q, F.explode(F.array_except("tokens", "protected")).alias("typed")).select(q, "typed", F.lower("typed").alias("word"))
        found = free.join(spell_correct(free, vocab), "word").groupBy(q).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("typed", "correction")))).alias("corrections"))
        base = base.join(found, q, "left").withColumn("corrections", F.coalesce("corrections", F.create_map().cast("map<string,string>")))
    swap = F.transform(F.split("normalised", " "), lambda w: F.coalesce(F.try_element_at("corrections", w), w))
    corrected = F.array_join(swap, " ")
    soft = let(patterns.soft_filters(n, now), lambda s: F.struct(*(_unless_set(queries, hard, d, s[d]).alias(d) for d in DIMENSIONS)))
    changed = F.size(F.map_keys("corrections")) > 0
    return base.withColumns(
        {
            "sparse_text": F.lower(corrected),
            "variants": F.when(changed & F.lit(dual), F.array_distinct(F.array(n, corrected))).otherwise(F.array(corrected)),
            "intent": patterns.intent(n),
            "exact_terms": patterns.exact_terms(n),
            "soft": soft,
        }
    ).withColumns({"top_k": patterns.profile(F.col("intent"), 0), "sparse_weight": patterns.profile(F.col("intent"), 1)})


def _unless_set(queries: DataFrame, hard: str, dimension: str, inferred: Column) -> Column:
    if hard not in queries.columns or dimension not in queries.schema[hard].dataType.names:
        return inferred
    return F.when(F.col(f"{hard}.{dimension}").isNull(), inferred)
