"""Current state as queries over append-only history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import breadcrumb


def latest(df: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order; the filter stays right above the window,
    so Spark keeps only one row for each key before the shuffle."""
    keys = [key] if isinstance(key, str) else key
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rank).where("_rn = 1").drop("_rn")


def current_documents(documents: DataFrame) -> DataFrame:
    """Rank first, then drop deleted: a tombstone hides all older versions."""
    return latest(documents, "document_id", F.desc("parsed_at"), F.desc("document_version_id")).where("not is_deleted")


def current_chunks(chunks: DataFrame, documents: DataFrame, chunker_version: str = "*", config_hash: str = "*") -> DataFrame:
    live = latest(chunks, "chunk_id", F.desc("created_at"), F.desc("document_version_id")).where("is_current and not is_deleted")
    if chunker_version != "*":
        live = live.where(F.col("chunker_version") == chunker_version)
    if config_hash != "*":
        live = live.where(F.col("chunk_config_hash") == config_hash)
    return live.join(current_documents(documents).select("document_id", "document_version_id"), ["document_id", "document_version_id"], "left_semi")


def active_units(units: DataFrame, chunks: DataFrame, documents: DataFrame, **versions: str) -> DataFrame:
    live = latest(units, "chunk_id", F.desc("created_at"), F.desc("gold_snapshot_id"))
    return live.join(current_chunks(chunks, documents, **versions).select("chunk_id"), "chunk_id", "left_semi")


def embedding_coverage(units: DataFrame, embeddings: DataFrame, version: str) -> DataFrame:
    """Units with has_embedding and stale_embedding (null-safe difference of the digests)."""
    emb = latest(embeddings.where(F.col("embedding_version") == version), "chunk_id", F.desc("embedded_at"), F.desc("embedded_text_sha256"))
    emb = emb.select("chunk_id", "embedding_version", "embedded_at", F.col("embedded_text_sha256").alias("_sha"), F.lit(True).alias("_has"))
    has = F.coalesce("_has", F.lit(False))
    out = units.join(emb, "chunk_id", "left").withColumn("has_embedding", has)
    return out.withColumn("stale_embedding", has & ~F.col("_sha").eqNullSafe(F.col("embedded_text_sha256"))).drop("_sha", "_has")


def coverage_ratio(coverage: DataFrame) -> DataFrame:
    """Covered and fresh over all; 1 when there is nothing to cover."""
    ok = F.col("has_embedding") & ~F.col("stale_embedding")
    return coverage.agg(F.coalesce(F.avg(ok.cast("double")), F.lit(1.0)).alias("coverage"))


def embedding_backlog(coverage: DataFrame) -> DataFrame:
    return coverage.where("not has_embedding or stale_embedding").orderBy("chunk_id")


def retrieval_units(chunks: DataFrame, documents: DataFrame, units: DataFrame, snapshot: str, now: Column, chunk_min: float = 0.30, document_min: float = 0.35, refresh: bool = False) -> DataFrame:
    """New Gold rows: current chunks of good documents that Gold doesn't have.

    refresh=True also gives rows of chunks that moved to a new document version, which
    a test on chunk_id alone leaves with the old version's title and permissions."""
    docs = current_documents(documents)
    known = ["chunk_id", "document_version_id"] if refresh else ["chunk_id"]
    meta = F.col("d.metadata")
    out = (
        current_chunks(chunks, documents).alias("c")
        .join(docs.alias("d"), (F.col("c.document_id") == F.col("d.document_id")) & (F.col("c.document_version_id") == F.col("d.document_version_id")))
        .where((F.col("c.quality_score") >= chunk_min) & (F.col("d.quality_score") >= document_min) & F.col("d.is_duplicate_of").isNull())
        .where(~F.coalesce(F.array_contains("c.quality_flags", "low_quality"), F.lit(False)))
    )
    out = out.select(
        *(f"c.{x}" for x in ("chunk_id", "chunk_key", "lineage_id", "chunk_checksum", "embedded_text_sha256", "document_id", "document_version_id", "chunk_index", "source_type")),
        *(f"d.{x}" for x in ("canonical_source_uri", "source_uri", "title")),
        "c.heading_path",
        breadcrumb(F.col("c.heading_path")).alias("heading_breadcrumb"),
        *(f"c.{x}" for x in ("chunk_type", "code_language", "text", "context_prefix", "token_count", "page_start", "page_end", "line_start", "line_end", "security_level", "allowed_groups")),
        F.try_element_at(meta, F.lit("git.repo")).alias("repo"),
        F.try_element_at(meta, F.lit("git.branch")).alias("branch"),
        F.try_element_at(meta, F.lit("git.path")).alias("path"),
        F.coalesce(F.try_element_at(meta, F.lit("source.updated_at")).try_cast("timestamp"), F.col("d.parsed_at")).alias("document_updated_at"),
        *(f"c.{x}" for x in ("quality_score", "quality_flags", "language")),
        F.lit(snapshot).alias("gold_snapshot_id"),
        now.alias("created_at"),
    )
    return out.join(units.select(*known).distinct(), known, "left_anti")


def tombstones(history: DataFrame, gone: DataFrame, key: str, time: str, now: Column) -> DataFrame:
    """A deletion row for each key of `gone` that is alive: its latest row, marked deleted."""
    live = latest(history, key, F.desc(time), F.xxhash64(*history.columns)).where("not is_deleted")  # of equal times any, but always the same
    flags = {"is_deleted": F.lit(True), time: now} | ({"is_current": F.lit(False)} if "is_current" in history.columns else {})
    return live.join(gone.select(key).distinct(), key, "left_semi").withColumns(flags).select(*history.columns)


def corpus_stats(documents: DataFrame, chunks: DataFrame, units: DataFrame, coverage: DataFrame) -> DataFrame:
    """metric, value: five counts in long form, one pass over each table."""
    one = lambda df, name, value: df.agg(value.cast("double").alias("value")).select(F.lit(name).alias("metric"), "value")
    return (
        one(documents, "documents_current", F.count("*"))
        .union(one(chunks, "chunks_current", F.count("*")))
        .union(one(units, "units_active", F.count("*")))
        .union(one(coverage, "embedding_coverage", F.coalesce(F.avg((F.col("has_embedding") & ~F.col("stale_embedding")).cast("double")), F.lit(1.0))))
        .union(one(chunks, "tokens_total", F.coalesce(F.sum("token_count"), F.lit(0))))
    )
