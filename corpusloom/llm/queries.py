"""The operators as registered queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import codes, decontam, enrich, html, linededup, minhash, packing, pieces, pii, toxicity, vectors
from corpusloom.llm.common import table


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary files lie; they are never copied into the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(table(spark, sf_dir, "pages"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.embedding_dedup(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.sentencepiece_digest(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_dedup(table(spark, sf_dir, "documents"), k=5, percent=85)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), length=4096, end=2)


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.exact_top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train_on(docs, table(spark, sf_dir, "labels")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op11_sale_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.enrich_sales(table(spark, sf_dir, "sales"), table(spark, sf_dir, "client_changes"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.encode_vectors(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_main_text": op1_main_text,
        "op2_embedding_dedup": op2_embedding_dedup,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_minhash_dedup": op4_minhash_dedup,
        "op5_token_counts": op5_token_counts,
        "op6_packing": op6_packing,
        "op7_exact_top_k": op7_exact_top_k,
        "op8_toxicity": op8_toxicity,
        "op9_line_dedup": op9_line_dedup,
        "op10_pii": op10_pii,
        "op11_sale_enrichment": op11_sale_enrichment,
        "op12_vector_codes": op12_vector_codes,
        "op13_decontamination": op13_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_line_dedup": linededup.SQL, "op11_sale_enrichment": enrich.SQL, "op12_vector_codes": codes.SQL, "op13_decontamination": decontam.SQL}
