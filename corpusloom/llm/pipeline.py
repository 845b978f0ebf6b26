"""The corpus pipeline: documents without toxic texts, boilerplate lines, near-duplicates
and personal data, packed into training sequences. Part of the llm subpackage.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its
output is written as Parquet and read again as the next one's docs. Every stage keeps
columns that it doesn't know, takes null ids, texts and sources, empty and very long texts
as its operator states, and gives no rows for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import linededup, minhash, packing, pii, toxicity
from corpusloom.llm.common import broadcast_if_small, materialize, table
from corpusloom.llm.queries import tokenizer_path


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns, n_chars (where it is one) counted anew."""
    out = docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else docs
    return out.select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the toxicity model, trained on the labels, doesn't reject."""
    return toxicity.drop_toxic(docs, toxicity.train_on(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source."""
    return _counted(linededup.line_dedup(docs), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, a similarity of 0.8 or more), the
    one with the smallest id; of rows that share that id, the one with the smallest text. Rows
    without an id stay."""
    groups = minhash.minhash_dedup(docs, k=5, percent=80)
    kept = docs.join(groups.where(~F.col("kept")).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
    again = materialize(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    n = again.count()
    if not n:
        return kept
    again = broadcast_if_small(again, n)
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(*(c for c in ["text", *docs.columns] if c != "doc_id")))
    rank = next(r for i in range(len(docs.columns) + 1) if (r := f"rank_{i}") not in docs.columns)
    one = kept.join(again, "doc_id", "left_semi").withColumn(rank, first).where(F.col(rank) == 1).select(*docs.columns)
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).union(one)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the personal data in their texts replaced by <KIND>."""
    return _counted(pii.redact_pii(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), keep_words=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("pii", hide_personal_data),
    ("packing", pack),
]

#: No SQL expresses the toxicity model, MinHash groups or the random field.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the rows of the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
