"""Datasets: schemas with partition and sort columns, enforced on write."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SchemaError(ValueError):
    """A table that does not fit its dataset."""


@dataclass(frozen=True)
class Dataset:
    """name: layer/dataset; schema: DDL, NOT NULL marks required columns."""

    name: str
    ddl: str
    partition_by: tuple[str, ...] = ()
    sort_by: tuple[str, ...] = ()
    version: str = "1.0.0"

    @cached_property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)  # needs a session, so not at import

    def empty(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([], T.StructType([T.StructField(f.name, f.dataType) for f in self.schema]))

    def enforce(self, df: DataFrame) -> DataFrame:
        """Columns in order and cast (a lossy cast fails under ANSI mode); nullable ones that
        are missing become null, others and unknown ones are errors; required nulls fail."""
        known = set(self.schema.names)
        if extra := [c for c in df.columns if c not in known]:
            raise SchemaError(f"{self.name}: unknown columns {extra}")
        out = []
        for f in self.schema:
            if f.name not in df.columns:
                if not f.nullable:
                    raise SchemaError(f"{self.name}: required column {f.name} is missing")
                out.append(F.lit(None).cast(f.dataType).alias(f.name))
                continue
            c = F.col(f.name)
            if not f.nullable:
                c = F.when(c.isNotNull(), c).otherwise(F.raise_error(F.lit(f"{self.name}: {f.name} is null")).cast(df.schema[f.name].dataType))
            out.append(c.cast(f.dataType).alias(f.name, metadata={"dataset": self.name, "version": self.version}))
        return df.select(*out)


_CHUNK = (
    "chunk_id STRING NOT NULL, chunk_key STRING, lineage_id STRING, chunk_checksum STRING, embedded_text_sha256 STRING, document_id STRING NOT NULL, "
    "document_version_id STRING, chunk_index INT, source_type STRING, heading_path ARRAY<STRING>, chunk_type STRING, code_language STRING, text STRING, "
    "context_prefix STRING, token_count INT, start_char INT, end_char INT, page_start INT, page_end INT, line_start INT, line_end INT, security_level STRING, "
    "allowed_groups ARRAY<STRING>, quality_score DOUBLE, quality_flags ARRAY<STRING>, language STRING, chunker_version STRING, chunk_config_hash STRING, "
    "prev_chunk_id STRING, next_chunk_id STRING, section_ordinal INT, overlap_prev_tokens INT, status STRING, is_current BOOLEAN, is_deleted BOOLEAN, "
    "created_at TIMESTAMP, ingest_date DATE"
)

DATASETS = {
    d.name: d
    for d in (
        Dataset(
            "bronze/manifest",
            "manifest_id STRING NOT NULL, document_id STRING NOT NULL, source_type STRING, source_uri STRING, canonical_source_uri STRING, content_sha256 STRING NOT NULL, "
            "size_bytes BIGINT, mime STRING, etag STRING, fetched_at TIMESTAMP, run_id STRING, security_level STRING, allowed_groups ARRAY<STRING>, "
            "metadata MAP<STRING,STRING>, ingest_date DATE",
            ("ingest_date",),
            ("document_id", "fetched_at"),
        ),
        Dataset(
            "bronze/repo_snapshots",
            "repo STRING NOT NULL, commit_sha STRING NOT NULL, branch STRING, path STRING NOT NULL, blob_sha STRING, size_bytes BIGINT, fetched_at TIMESTAMP",
            ("repo", "commit_sha"),
            ("path",),
        ),
        Dataset(
            "silver/documents",
            "document_id STRING NOT NULL, document_version_id STRING NOT NULL, source_type STRING, source_uri STRING, canonical_source_uri STRING, title STRING, "
            "language STRING, language_confidence DOUBLE, text STRING, structure STRING, blocks STRING, tables STRING, code_blocks STRING, images STRING, page_map STRING, "
            "word_count INT, char_count INT, quality_score DOUBLE, quality_flags ARRAY<STRING>, simhash BIGINT, is_duplicate_of STRING, content_sha256 STRING, "
            "parser_version STRING, metadata MAP<STRING,STRING>, security_level STRING, allowed_groups ARRAY<STRING>, is_current BOOLEAN, is_deleted BOOLEAN, "
            "parsed_at TIMESTAMP, run_id STRING, ingest_date DATE",
            ("source_type", "ingest_date"),
            ("document_id", "parsed_at"),
        ),
        Dataset("silver/chunks", _CHUNK, ("source_type", "ingest_date"), ("document_id", "chunk_index")),
        Dataset(
            "silver/dedup_ledger",
            "duplicate_document_id STRING NOT NULL, canonical_document_id STRING NOT NULL, hamming_distance INT, fingerprint BIGINT, decided_at TIMESTAMP",
            (),
            ("canonical_document_id",),
        ),
        Dataset(
            "gold/retrieval_units",
            "chunk_id STRING NOT NULL, chunk_key STRING, lineage_id STRING, chunk_checksum STRING, embedded_text_sha256 STRING, document_id STRING, document_version_id STRING, "
            "chunk_index INT, source_type STRING, canonical_source_uri STRING, source_uri STRING, title STRING, heading_path ARRAY<STRING>, heading_breadcrumb STRING, "
            "chunk_type STRING, code_language STRING, text STRING, context_prefix STRING, token_count INT, page_start INT, page_end INT, line_start INT, line_end INT, "
            "security_level STRING, allowed_groups ARRAY<STRING>, repo STRING, branch STRING, path STRING, document_updated_at TIMESTAMP, quality_score DOUBLE, "
            "quality_flags ARRAY<STRING>, language STRING, gold_snapshot_id STRING, created_at TIMESTAMP",
            ("source_type", "security_level"),
            ("document_id", "chunk_index"),
        ),
        Dataset(
            "gold/chunk_embeddings",
            "chunk_id STRING NOT NULL, document_id STRING, source_type STRING, embedding_version STRING NOT NULL, model_id STRING, dim INT, vector ARRAY<FLOAT> NOT NULL, "
            "embedded_text_sha256 STRING, embedded_at TIMESTAMP, run_id STRING, norm DOUBLE, cache_hit BOOLEAN",
            ("embedding_version", "source_type"),
            ("chunk_id",),
        ),
        Dataset(
            "gold/qa_pairs",
            "qa_id STRING NOT NULL, version STRING, question STRING, reference_answer STRING, expected_chunk_ids ARRAY<STRING>, document_id STRING, kind STRING, created_at TIMESTAMP",
            ("version",),
            ("qa_id",),
        ),
        Dataset("gold/stats", "snapshot_date DATE, metric STRING NOT NULL, dimension STRING, value DOUBLE, run_id STRING, computed_at TIMESTAMP", ("snapshot_date",), ("metric", "dimension")),
        Dataset(
            "quarantine/reasons",
            "quarantine_id STRING NOT NULL, document_id STRING, content_sha256 STRING, source_uri STRING, stage STRING, code STRING, detail STRING, raw_key STRING, "
            "run_id STRING, status STRING, created_at TIMESTAMP, ingest_date DATE",
            ("ingest_date",),
            ("created_at",),
        ),
    )
}
