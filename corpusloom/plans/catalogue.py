"""The engine's operators as queries over the test tables, each with SQL to check it by.

The tables have no versions, permissions or chunks; they are derived: events give versions
(user as document, event as version, an error as deletion), ids give levels and groups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import ids, patterns, quality, text
from corpusloom.operators import answers, chunking, dedup, evaluation, governance, retrieval
from corpusloom.operators import query as query_
from corpusloom.plans import views
from corpusloom.plans.schemas import Dataset
from corpusloom.session import spread, written
from corpusloom.sources import lakehouse, pages
from corpusloom.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = "TIMESTAMP '2024-02-01 00:00:00'"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("{now}", NOW)
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def now() -> F.Column:
    return F.expr(NOW)


# -- versions and views ------------------------------------------------------


def _versions(spark, d):
    return table(spark, d, "events").select(
        F.col("user_id").alias("document_id"), F.col("event_id").alias("document_version_id"), F.col("ts").alias("parsed_at"), (F.col("event_type") == "error").alias("is_deleted"), "value"
    )


_VERSIONS = "v AS (SELECT user_id AS document_id, event_id AS document_version_id, ts AS parsed_at, event_type = 'error' AS is_deleted, value FROM events)"
_CURRENT = f"{_VERSIONS}, cur AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY parsed_at DESC, document_version_id DESC) AS rn FROM v) WHERE rn = 1 AND NOT is_deleted)"


@query(f"WITH {_CURRENT} SELECT * FROM cur")
def current_documents(spark, d):
    return views.current_documents(_versions(spark, d))


def _event_chunks(spark, d):
    return table(spark, d, "events").select(
        (F.col("event_id") % 700).alias("chunk_id"), F.col("user_id").alias("document_id"), F.col("event_id").alias("document_version_id"), F.col("ts").alias("created_at"),
        (F.col("event_type") == "error").alias("is_deleted"), (F.col("event_type") != "click").alias("is_current"),
    )


_CHUNKS = (
    "c AS (SELECT event_id % 700 AS chunk_id, user_id AS document_id, event_id AS document_version_id, ts AS created_at, event_type = 'error' AS is_deleted, event_type <> 'click' AS is_current FROM events), "
    "lc AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY created_at DESC, document_version_id DESC) AS rn FROM c) WHERE rn = 1), "
    "cc AS (SELECT lc.* FROM lc WHERE is_current AND NOT is_deleted AND EXISTS (SELECT 1 FROM cur WHERE cur.document_id = lc.document_id AND cur.document_version_id = lc.document_version_id))"
)


@query(f"WITH {_CURRENT}, {_CHUNKS} SELECT * FROM cc")
def current_chunks_semi(spark, d):
    return views.current_chunks(_event_chunks(spark, d), _versions(spark, d))


@query(f"WITH {_CURRENT}, {_CHUNKS}, u AS (SELECT event_id % 700 AS chunk_id, ts AS created_at, event_id AS gold_snapshot_id, value FROM events WHERE event_type IN ('view', 'purchase')), lu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY created_at DESC, gold_snapshot_id DESC) AS rn FROM u) WHERE rn = 1) SELECT chunk_id, created_at, gold_snapshot_id, value FROM lu WHERE chunk_id IN (SELECT chunk_id FROM cc)")
def gold_active_units(spark, d):
    units = table(spark, d, "events").where("event_type in ('view', 'purchase')").select((F.col("event_id") % 700).alias("chunk_id"), F.col("ts").alias("created_at"), F.col("event_id").alias("gold_snapshot_id"), "value")
    return views.active_units(units, _event_chunks(spark, d), _versions(spark, d))


@query(f"WITH {_CURRENT} SELECT document_id, document_version_id, {{now}} AS parsed_at, true AS is_deleted, value FROM cur WHERE document_id % 7 = 0")
def tombstone_apply(spark, d):
    history = _versions(spark, d)
    gone = history.where("document_id % 7 = 0").select("document_id")
    return views.tombstones(history, gone, "document_id", "parsed_at", F.expr(NOW.replace("TIMESTAMP", "TIMESTAMP_NTZ")))


def _library(spark, d):
    """documents and one chunk of each as Silver rows, half of them in Gold."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", "left")
    base = docs.select(
        F.col("doc_id").alias("document_id"), F.col("doc_id").alias("document_version_id"), F.lit("2024-01-01").cast("timestamp").alias("parsed_at"), F.lit(False).alias("is_deleted"),
        F.coalesce(F.col("quality").cast("double"), F.lit(0.5)).alias("quality_score"), F.when(F.col("doc_id") % 11 == 0, F.col("doc_id") - 1).alias("is_duplicate_of"),
        F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("doc_id").cast("string")).alias("source_uri"), F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("doc_id").cast("string")).alias("canonical_source_uri"),
        F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), F.create_map(F.lit("git.repo"), "source", F.lit("source.updated_at"), F.when(F.col("doc_id") % 2 == 0, "2023-05-06 07:08:09").otherwise("unknown")).alias("metadata"), "text", "lang", "source", "n_chars",
    )
    chunks = base.select(
        F.col("document_id").alias("chunk_id"), "document_id", "document_version_id", F.col("parsed_at").alias("created_at"), F.lit(True).alias("is_current"), "is_deleted", F.lit(0).alias("chunk_index"), F.col("source").alias("source_type"),
        F.array("source", "lang").alias("heading_path"), F.when(F.length("text") < 300, F.array(F.lit("low_quality"))).alias("quality_flags"), text.text_density(F.col("text")).alias("quality_score"), "text",
        *(F.lit(None).cast("string").alias(c) for c in ("chunk_key", "lineage_id", "chunk_checksum", "embedded_text_sha256", "chunk_type", "code_language", "context_prefix", "security_level", "language")),
        *(F.lit(None).cast("int").alias(c) for c in ("token_count", "page_start", "page_end", "line_start", "line_end")), F.lit(None).cast("array<string>").alias("allowed_groups"),
    )
    return base, chunks


@query("""
WITH q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
base AS (SELECT d.*, coalesce(q.quality::DOUBLE, 0.5) AS qs,
  CASE WHEN length(text) = 0 THEN 0.0 ELSE length(regexp_replace(text, '[^\\p{L}\\p{N}\\s]', '', 'g'))::DOUBLE / length(text) END AS dens FROM documents d LEFT JOIN q USING (doc_id))
SELECT doc_id AS chunk_id, 'Doc ' || doc_id AS title, source || ' › ' || lang AS heading_breadcrumb, source AS repo, CAST(NULL AS VARCHAR) AS branch,
  CASE WHEN doc_id % 2 = 0 THEN TIMESTAMP '2023-05-06 07:08:09' ELSE TIMESTAMP '2024-01-01' END AS document_updated_at, 'snap-1' AS gold_snapshot_id
FROM base WHERE dens >= 0.3 AND qs >= 0.35 AND doc_id % 11 <> 0 AND length(text) >= 300 AND doc_id % 2 <> 1
""")
def gold_projection(spark, d):
    docs, chunks = _library(spark, d)
    gold = chunks.where("chunk_id % 2 = 1").select("chunk_id", "document_version_id")
    out = views.retrieval_units(chunks, docs, gold, "snap-1", now())
    return out.select("chunk_id", "title", "heading_breadcrumb", "repo", "branch", F.col("document_updated_at").cast("timestamp_ntz").alias("document_updated_at"), "gold_snapshot_id")


def _coverage(spark, d):
    units = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.sha2("text", 256).alias("embedded_text_sha256"))
    emb = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("v"), (F.col("label") % 2).cast("string")).alias("embedding_version"), F.lit("2024-01-01").cast("timestamp_ntz").alias("embedded_at"))
    emb = emb.join(units, "chunk_id").withColumn("embedded_text_sha256", F.when(F.col("chunk_id") % 3 == 0, "old").otherwise(F.col("embedded_text_sha256")))
    return views.embedding_coverage(units, emb, "v0")


_COVERAGE = """
WITH e AS (SELECT vec_id, label FROM embeddings WHERE label % 2 = 0),
cov AS (SELECT d.doc_id AS chunk_id, e.vec_id IS NOT NULL AS has_embedding, e.vec_id IS NOT NULL AND d.doc_id % 3 = 0 AS stale_embedding FROM documents d LEFT JOIN e ON e.vec_id = d.doc_id)
"""


@query(_COVERAGE + "SELECT * FROM cov")
def embedding_coverage(spark, d):
    return _coverage(spark, d).select("chunk_id", "has_embedding", "stale_embedding")


@query(_COVERAGE + "SELECT coalesce(avg((has_embedding AND NOT stale_embedding)::INT::DOUBLE), 1.0) AS coverage FROM cov")
def coverage_ratio(spark, d):
    return views.coverage_ratio(_coverage(spark, d))


@query(_COVERAGE + "SELECT chunk_id FROM cov WHERE NOT has_embedding OR stale_embedding")
def embedding_backlog(spark, d):
    return views.embedding_backlog(_coverage(spark, d)).select("chunk_id")


@query(_COVERAGE + """SELECT 'documents_current' AS metric, count(*)::DOUBLE AS value FROM documents UNION ALL SELECT 'chunks_current', count(*)::DOUBLE FROM documents
UNION ALL SELECT 'units_active', count(*)::DOUBLE FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'embedding_coverage', coalesce(avg((has_embedding AND NOT stale_embedding)::INT::DOUBLE), 1.0) FROM cov
UNION ALL SELECT 'tokens_total', sum(n_chars)::DOUBLE FROM documents""")
def corpus_stats(spark, d):
    docs = table(spark, d, "documents")
    return views.corpus_stats(docs, docs.withColumn("token_count", F.col("n_chars")), docs.where("doc_id % 2 = 0"), _coverage(spark, d))


_ORDERS = Dataset("silver/orders", "o_orderkey BIGINT NOT NULL, o_totalprice DECIMAL(12,2), o_orderdate DATE, note STRING")


@query("SELECT o_orderkey, o_totalprice::DECIMAL(12,2)::DOUBLE AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, CAST(NULL AS VARCHAR) AS note FROM orders")
def schema_enforce_cast(spark, d):
    out = _ORDERS.enforce(table(spark, d, "orders").select("o_orderdate", "o_totalprice", "o_orderkey"))
    return out.select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), F.col("o_orderdate").cast("string").alias("o_orderdate"), "note")


@query("WITH {c} SELECT event_id, ts, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 3".replace("WITH {c} ", ""))
def versions_newest_first(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("event_id", "ts", "user_id")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id")
def document_status(spark, d):
    return governance.status_now(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


# -- filters and permissions -------------------------------------------------


def _acl(spark, d):
    level = F.element_at(F.array(*map(F.lit, patterns.LEVELS)), (F.col("doc_id") % 3 + 1).cast("int"))
    groups = F.when(F.col("doc_id") % 4 == 0, F.array().cast("array<string>")).when(F.col("doc_id") % 4 == 1, F.array(F.lit("eng"))).when(F.col("doc_id") % 4 == 2, F.array(F.lit("hr"), F.lit("eng")))
    return table(spark, d, "documents").select("doc_id", "lang", "source", level.alias("security_level"), groups.alias("allowed_groups"))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 IN (0, 1) AND doc_id % 4 IN (0, 2, 3)")
def acl_filter(spark, d):
    return _acl(spark, d).where(patterns.may_read(F.col("security_level"), F.col("allowed_groups"), ["public", "internal"], ["hr"])).select("doc_id")


@query("SELECT doc_id FROM documents WHERE source IN ('src1', 'src2') AND lang = 'en' AND doc_id % 5 >= 2")
def metadata_filter(spark, d):
    docs = table(spark, d, "documents").withColumns({"source_type": F.col("source"), "code_language": F.col("lang"), "document_updated_at": F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 5).cast("int")).cast("timestamp")})
    return docs.where(patterns.metadata_filter(source_types=["src1", "src2"], code_languages=["en"], updated_after=F.lit("2024-01-03").cast("timestamp"))).select("doc_id")


@query("SELECT doc_id, CASE WHEN source IN ('src1', 'src11') AND doc_id % 3 < 2 THEN 'restricted' WHEN source LIKE 'src1%' AND source NOT IN ('src1', 'src11') AND doc_id % 3 = 0 THEN 'internal' ELSE ['public', 'internal', 'restricted'][doc_id % 3 + 1] END AS security_level FROM documents")
def path_level_rules(spark, d):
    return _acl(spark, d).select("doc_id", patterns.raise_level(F.col("source"), F.col("security_level"), [("^src11?$", "restricted"), ("^src1", "internal")]).alias("security_level"))


@query("SELECT doc_id, CASE WHEN user_id IS NULL THEN ['public', 'internal', 'restricted'][doc_id % 3 + 1] ELSE 'restricted' END AS security_level FROM documents LEFT JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup') ON user_id = doc_id")
def permission_change(spark, d):
    change = table(spark, d, "events").where("event_type = 'signup'").select(F.col("user_id").alias("doc_id"), F.col("ts").alias("changed_at"), F.lit("restricted").alias("security_level"), F.array().cast("array<string>").alias("allowed_groups"))
    return governance.with_permissions(_acl(spark, d), change, "doc_id").select("doc_id", "security_level")


@query("SELECT page_id, lower(url) LIKE '%.example.com/%' AND NOT regexp_matches(url, '/de/') AS allowed FROM pages")
def url_rules(spark, d):
    return table(spark, d, "pages").select("page_id", pages.allowed(F.lower("url"), [r"\.example\.com/"], ["/de/"]).alias("allowed"))


# -- text and quality --------------------------------------------------------

_DENSITY = "CASE WHEN length(text) = 0 THEN 0.0 ELSE length(regexp_replace(text, '[^\\p{L}\\p{N}\\s]', '', 'g'))::DOUBLE / length(text) END"
_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
_NWORDS = "len(list_filter(regexp_split_to_array(trim(text, ' '), '\\s+'), lambda w: w <> ''))"


@query(f"SELECT doc_id, round({_DENSITY}, 6) AS density, {_NWORDS}::INT AS n_words FROM documents")
def text_density(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(text.text_density(F.col("text")), 6).alias("density"), text.word_count(F.col("text")).alias("n_words"))


_REPEAT = f"""
w AS (SELECT doc_id, text, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, text, w, list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')) AS g FROM w),
rep AS (SELECT doc_id, text, CASE WHEN len(w) < 6 THEN 0.0 ELSE (len(g) - len(list_distinct(g)))::DOUBLE / len(g) END AS r FROM g)
"""


@query(f"WITH {_REPEAT} SELECT doc_id, round(r, 6) AS repetition FROM rep")
def repetition_ratio(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(text.repetition_ratio(F.col("text")), 6).alias("repetition"))


@query(f"SELECT doc_id, round(0.35 * {_DENSITY} + 0.2 * least(1.0, (doc_id % 4) / greatest(1.0, {_NWORDS} / 400)) + 0.15 * (CASE WHEN lang = 'en' THEN 0.9 ELSE 0.6 END) + 0.15 + 0.15 * least(1.0, {_NWORDS} / 300), 4) AS score FROM documents")
def doc_quality(spark, d):
    conf = F.when(F.col("lang") == "en", 0.9).otherwise(0.6)
    score = quality.document_quality(F.col("text"), (F.col("doc_id") % 4).cast("double"), conf)
    return table(spark, d, "documents").select("doc_id", score.alias("score"))


_TOKENS = r"""
tok AS (SELECT doc_id, text, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS t FROM documents),
cnt AS (SELECT doc_id, text, coalesce(list_sum(list_transform(t, lambda x: CASE WHEN regexp_full_match(x, '\p{L}+') THEN CASE WHEN length(x) <= 6 THEN 1 ELSE 1 + (length(x) - 1) // 5 END WHEN regexp_full_match(x, '\p{Nd}+') THEN 1 + (length(x) - 1) // 3 ELSE 1 END)), 0)::INT AS n FROM tok)
"""


@query(f"WITH {_TOKENS} SELECT doc_id, n AS tokens FROM cnt")
def token_count_heuristic(spark, d):
    return table(spark, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query(f"""WITH {_TOKENS}, {_REPEAT}, s AS (
SELECT c.doc_id, c.n, r.r, {_DENSITY.replace('text', 'c.text')} AS dens,
  (CASE WHEN regexp_matches(trim(c.text, ' '), '^[\\p{{Lu}}\\p{{N}}\\-*`\\[#]') THEN 0.5 ELSE 0.0 END) + (CASE WHEN regexp_matches(trim(c.text, ' '), '[.!?:`)"'']$') THEN 0.5 ELSE 0.0 END) AS compl,
  CASE WHEN c.n <= 0 THEN 0.0 WHEN c.n < 64 THEN greatest(0.0, least(1.0, (c.n - 64) / 256.0)) WHEN c.n <= 320 THEN 1.0 WHEN c.n >= 672 THEN 0.0 ELSE 1 - (c.n - 320) / 352.0 END AS fit
FROM cnt c JOIN rep r USING (doc_id))
SELECT doc_id, round(0.3 * fit + 0.2 * dens + 0.15 * compl + 0.15 + 0.1 * (doc_id % 2) + 0.1 * (1 - r), 4) AS score FROM s""")
def chunk_quality(spark, d):
    c = F.col("text")
    score = quality.chunk_quality(c, F.lit("prose"), text.token_estimate(c), F.col("doc_id") % 2 == 1)
    return table(spark, d, "documents").select("doc_id", score.alias("score"))


_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
_HUMPS = "regexp_replace(regexp_replace(t, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"


@query(f"""SELECT doc_id, array_to_string(flatten(list_transform(r, lambda t: CASE WHEN {_HUMPS} <> t OR regexp_matches(t, '[_./\\-]')
  THEN list_concat([lower(t)], list_transform(list_filter(string_split_regex({_HUMPS}, '[ _./\\-]+'), lambda p: length(p) > 1), lambda p: lower(p)))
  WHEN len(r) > 3 AND lower(t) IN ({_STOP}) THEN []::VARCHAR[] ELSE [lower(t)] END)), ' ') AS tokens
FROM (SELECT doc_id, regexp_extract_all(text, '{text.SEARCH_WORD}') AS r FROM documents)""")
def bm25_tokenize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(text.search_tokens(F.col("text")), " ").alias("tokens"))


_SECRET = "(" + " OR ".join(f"regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}')" for p in patterns.SECRETS.values()) + ")"


@query(f"""SELECT doc_id, CASE WHEN length(trim(text, ' ')) < 100 THEN 'E3005' WHEN {_SECRET} THEN 'E3008' WHEN n_chars < 64 THEN 'E3001' END AS reject_code,
{_DENSITY} < 0.4 AS low_density FROM documents""")
def validate_reject_code(spark, d):
    codes = quality.violations(F.col("text"), size=F.col("n_chars"))
    return table(spark, d, "documents").select("doc_id", quality.reject_code(codes).alias("reject_code"), F.array_contains(quality.warning_flags(codes), "w3006").alias("low_density"))


@query("SELECT doc_id, " + ", ".join(f"regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}') AS {n}" for n, p in patterns.SECRETS.items()) + " FROM documents")
def secret_scan(spark, d):
    found = patterns.secrets(F.col("text"))
    return table(spark, d, "documents").select("doc_id", *(F.array_contains(found, n).alias(n) for n in patterns.SECRETS))


@query(r"""SELECT doc_id, len(list_distinct(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')))::INT AS emails,
len(list_distinct(regexp_extract_all(text, '\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b')))::INT AS ips FROM documents""")
def pii_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(patterns.pii_values(F.col("text"), "email")).alias("emails"), F.size(patterns.pii_values(F.col("text"), "ip_address")).alias("ips"))


@query()
def pii_mentions(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(patterns.pii_mentions(F.col("text"))).alias("m")).select("doc_id", "m.kind", "m.value_sha256")


# -- duplicates --------------------------------------------------------------


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS canonical_id, count(*) OVER (PARTITION BY sha256(text)) AS copies FROM documents")
def exact_dups(spark, d):
    return dedup.exact_duplicates(table(spark, d, "documents"), "doc_id", "text")


_SIMHASH = f"""
w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' ')) END) AS s FROM w),
h AS (SELECT doc_id, ('0x' || substr(md5(s), 1, 16))::UBIGINT AS h FROM s WHERE s <> ''),
b AS (SELECT doc_id, i, sum(2 * ((h >> i) & 1)::INT - 1) AS v FROM h, range(64) t(i) GROUP BY doc_id, i),
f AS (SELECT doc_id, bit_or(CASE WHEN v > 0 THEN 1::UBIGINT << i ELSE 0::UBIGINT END) AS fp FROM b GROUP BY doc_id)
"""


@query(f"WITH {_SIMHASH} SELECT d.doc_id, lower(printf('%016x', coalesce(f.fp, 0))) AS simhash FROM documents d LEFT JOIN f USING (doc_id)")
def simhash_fp(spark, d):
    fp = dedup.simhash(table(spark, d, "documents"), "doc_id", "text")
    return fp.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("simhash"))


@query(f"""WITH {_SIMHASH}, u AS (SELECT DISTINCT fp FROM f WHERE fp <> 0)
SELECT lower(printf('%016x', least(a.fp, b.fp))) AS fp_a, lower(printf('%016x', greatest(a.fp, b.fp))) AS fp_b, bit_count(xor(a.fp, b.fp)::BIT)::INT AS hamming
FROM u a JOIN u b ON a.fp < b.fp WHERE bit_count(xor(a.fp, b.fp)::BIT) <= 3""")
def near_dups(spark, d):
    pairs = dedup.near_pairs(dedup.simhash(table(spark, d, "documents"), "doc_id", "text"), "doc_id")
    a, b = (F.lpad(F.lower(F.hex(c)), 16, "0") for c in ("fp_a", "fp_b"))
    return pairs.select(F.least(a, b).alias("fp_a"), F.greatest(a, b).alias("fp_b"), F.col("hamming").cast("int").alias("hamming"))


@query()
def simhash_blake2b(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", dedup.simhash_blake2b(F.col("text")).alias("simhash"))


@query()
def dedup_ledger(spark, d):
    docs = table(spark, d, "documents")
    quality_ = F.round(text.text_density(F.col("text")), 4)
    return dedup.dedup_ledger(dedup.simhash(docs, "doc_id", "text").join(docs.select("doc_id", quality_.alias("quality")), "doc_id"))


@query(f"""
WITH t AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (SELECT side, id, {_WORDS} AS w FROM t),
g AS (SELECT side, id, list_distinct(CASE WHEN len(w) < 3 THEN w ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')) END) AS g FROM w),
e AS (SELECT side, id, len(g) AS n, unnest(g) AS g FROM g),
p AS (SELECT b.id AS item_id, d.id AS doc_id, b.n AS nb, d.n AS nd, count(*) AS c FROM e b JOIN e d ON b.g = d.g AND b.side = 'b' AND d.side = 'd' GROUP BY ALL)
SELECT item_id, doc_id, round(c::DOUBLE / (nb + nd - c), 6) AS jaccard, round(c::DOUBLE / nb, 6) AS contained FROM p WHERE c::DOUBLE / nb >= 0.5
""")
def jaccard_pairs(spark, d):
    """Documents that hold at least half of the trigrams of a benchmark item."""

    def grams(df: DataFrame, i: str) -> DataFrame:
        # The size is taken below the explode: beside it, it would be computed for each row.
        sets = df.select(i, text.trigram_set(F.col("text")).alias("set"))
        return sets.select(i, F.size("set").alias("n"), "set").select(i, "n", F.explode("set").alias("g"))

    b = grams(table(spark, d, "benchmark"), "item_id").withColumnRenamed("n", "nb")
    docs = grams(table(spark, d, "documents"), "doc_id").withColumnRenamed("n", "nd")
    few = b.limit(1_000_001).count() <= 1_000_000  # the items' trigrams go to the documents then
    p = docs.join(F.broadcast(b) if few else b, "g").groupBy("item_id", "doc_id", "nb", "nd").agg(F.count("*").alias("c"))
    return p.where(F.col("c") / F.col("nb") >= 0.5).select("item_id", "doc_id", F.round(F.col("c") / (F.col("nb") + F.col("nd") - F.col("c")), 6).alias("jaccard"), F.round(F.col("c") / F.col("nb"), 6).alias("contained"))


# -- retrieval ---------------------------------------------------------------

def _tokens(source: str, key: str, keep: str = "len(r) <= 3") -> str:
    """(key, term) rows by the search tokenizer: identifiers whole and in parts. A mark is put
    at each hump, as DuckDB's patterns can't look around."""
    return f"""SELECT {key}, unnest(CASE WHEN m <> t OR regexp_matches(t, '[_./\\-]') THEN list_concat([lower(t)], list_transform(list_filter(string_split_regex(m, '[ _./\\-]+'), lambda p: length(p) > 1), lambda p: lower(p)))
  WHEN NOT ({keep}) AND lower(t) IN ({_STOP}) THEN []::VARCHAR[] ELSE [lower(t)] END) AS term
  FROM (SELECT *, regexp_replace(regexp_replace(t, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g') AS m
    FROM (SELECT {key}, r, unnest(r) AS t FROM (SELECT {key}, regexp_extract_all(text, '{text.SEARCH_WORD}') AS r FROM {source})))"""


_BM25 = f"""
qt AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM ({_tokens("benchmark", "item_id")}) GROUP BY ALL),
tk AS ({_tokens("documents", "doc_id")}),
sz AS (SELECT doc_id, count(term) AS dl FROM documents LEFT JOIN tk USING (doc_id) GROUP BY doc_id),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM sz),
pt AS (SELECT doc_id, dl, term, count(*) AS tf FROM tk JOIN sz USING (doc_id) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM pt GROUP BY term),
rw AS (SELECT query_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS raw FROM pt JOIN dfs USING (term) JOIN qt USING (term), st GROUP BY query_id, doc_id),
sc AS (SELECT query_id, doc_id, round(raw, 6) AS score FROM rw),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM sc WHERE score > 0)
"""


def _questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM bm WHERE rank <= 5")
def bm25_topk(spark, d):
    return retrieval.bm25(table(spark, d, "documents"), _questions(spark, d), k=5)


@query(f"""WITH {_BM25}, ex AS (SELECT item_id AS query_id, unnest(list_filter(regexp_extract_all(text, '{text.SEARCH_WORD}'), lambda t: length(t) >= 10)) AS t FROM benchmark),
ht AS (SELECT DISTINCT query_id, doc_id FROM ex JOIN tk ON term = lower(t)), tp AS (SELECT query_id, max(raw) AS top FROM rw GROUP BY 1),
bo AS (SELECT query_id, doc_id, round(raw + CASE WHEN ht.doc_id IS NULL THEN 0 ELSE top END, 6) AS score FROM rw JOIN tp USING (query_id) LEFT JOIN ht USING (query_id, doc_id))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM bo WHERE score > 0) WHERE rank <= 5""")
def bm25_exact_boost(spark, d):
    """The long terms of a question count as its exact terms."""
    found = F.regexp_extract_all(F.col("text"), F.lit(f"({text.SEARCH_WORD})"), F.lit(1))
    asked = _questions(spark, d).withColumn("exact_terms", F.filter(found, lambda t: F.length(t) >= 10))
    return retrieval.bm25(table(spark, d, "documents"), asked, k=5, exact_terms=True)


@query(f"WITH {_BM25.replace(' WHERE term IN (SELECT term FROM qt)', '')} SELECT doc_id, dl::INT AS dl, count(term)::INT AS n_terms, max(tf)::INT AS max_tf FROM (SELECT doc_id, dl, term, tf FROM sz LEFT JOIN pt USING (doc_id, dl)) GROUP BY ALL")
def bm25_index(spark, d):
    made = retrieval.index(table(spark, d, "documents"))
    return made.select(F.col("id").alias("doc_id"), "dl", F.size("terms").alias("n_terms"), F.array_max("tfs").alias("max_tf"))


_DENSE = """
qv AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
ds AS (SELECT query_id, vec_id, round(list_cosine_similarity(q, embedding::DOUBLE[]), 6) + 0.0 AS score FROM qv, embeddings WHERE vec_id <> query_id),
dn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM ds)
"""


@query(f"WITH {_DENSE} SELECT query_id, vec_id, score, rank FROM dn WHERE rank <= 10")
def dense_topk(spark, d):
    v = table(spark, d, "embeddings")
    return retrieval.dense(v, v.where("vec_id % 100 = 0"), k=10)


def _hybrid(spark, d, keep=None):
    """Both legs, each under the filter: BM25 over the documents, and cosine over the vectors,
    which have the ids of their documents; a question asks with the vector of its own id."""
    docs, q, vectors = table(spark, d, "documents"), _questions(spark, d), table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    sparse = retrieval.bm25(docs, q, k=10, among=keep)
    kept = vectors if keep is None else vectors.join(docs.where(keep).select("doc_id"), "doc_id", "left_semi")
    asks = vectors.join(q.select(F.col("query_id").alias("doc_id")), "doc_id", "left_semi")
    return retrieval.dense(kept, asks, k=10, id_col="doc_id", skip_self=False).select("query_id", "doc_id", "rank"), sparse


def _legs(keep: str = "true") -> str:
    """fu: the fused hits of both legs over the documents for which `keep` holds."""
    return f"""
ok AS (SELECT doc_id FROM documents WHERE {keep}),
sp AS (SELECT query_id, doc_id, rank FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm JOIN ok USING (doc_id)) WHERE rank <= 10),
ve AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v FROM embeddings),
de AS (SELECT query_id, doc_id, rank FROM (SELECT q.doc_id AS query_id, ve.doc_id, row_number() OVER (PARTITION BY q.doc_id ORDER BY round(list_cosine_similarity(q.v, ve.v), 6) + 0.0 DESC, ve.doc_id) AS rank FROM ve q, ve JOIN ok USING (doc_id) WHERE q.doc_id IN (SELECT item_id FROM benchmark)) WHERE rank <= 10),
fu AS (SELECT coalesce(de.query_id, sp.query_id) AS query_id, coalesce(de.doc_id, sp.doc_id) AS doc_id, de.rank::INT AS dense_rank, sp.rank::INT AS sparse_rank, round(coalesce(1.0 / (60 + de.rank), 0) + coalesce(1.3 / (60 + sp.rank), 0), 8) AS rrf_score
  FROM de FULL JOIN sp ON de.query_id = sp.query_id AND de.doc_id = sp.doc_id)
"""


_HYBRID = f"{_BM25}, {_legs().replace('FROM ve q, ve JOIN ok USING (doc_id)', 'FROM ve q, ve').replace('FROM bm JOIN ok USING (doc_id)', 'FROM bm')}"


@query(f"WITH {_HYBRID} SELECT query_id, doc_id, rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, doc_id)::INT AS rank FROM fu")
def rrf_hybrid(spark, d):
    return retrieval.rrf(*_hybrid(spark, d), sparse_weight=1.3).select("query_id", "doc_id", "rrf_score", "rank")


@query(f"WITH {_BM25}, {_legs("source IN ('src1', 'src2', 'src3', 'src4', 'src5')")} SELECT query_id, doc_id, coalesce(dense_rank, 0)::INT AS dense_rank, coalesce(sparse_rank, 0)::INT AS sparse_rank, rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, doc_id)::INT AS rank FROM fu")
def acl_hybrid(spark, d):
    """Hybrid search over what a caller may see: the predicate holds inside both legs."""
    fused = retrieval.rrf(*_hybrid(spark, d, F.col("source").isin("src1", "src2", "src3", "src4", "src5")), sparse_weight=1.3)
    return fused.fillna(0, ["dense_rank", "sparse_rank"])


@query(f"WITH {_HYBRID} SELECT sp.query_id, sp.doc_id, sp.rank::INT AS rank, round(1.3 / (60 + sp.rank), 8) AS rrf_score, 'dense_unavailable' AS degraded FROM sp")
def degraded_search(spark, d):
    """What is left of a hybrid search whose vector leg fails: the sparse hits, and a flag."""
    def broken():
        raise OSError("no vectors")

    legs, flags = retrieval.legs({"dense": broken, "sparse": lambda: _hybrid(spark, d)[1]}, "query_id long, doc_id long, rank int")
    fused = retrieval.rrf(legs["dense"], legs["sparse"], sparse_weight=1.3)
    return fused.select("query_id", "doc_id", "rank", "rrf_score", F.lit(",".join(flags)).alias("degraded"))


@query(f"""WITH {_HYBRID}, ad AS (SELECT query_id, doc_id, round(rrf_score * (CASE WHEN n_chars < 300 THEN 0.9 ELSE 1 END) * (CASE WHEN lang = 'en' THEN 1.05 ELSE 1 END) * (CASE WHEN lang = 'en' THEN 1 ELSE 0.85 END) * (CASE WHEN source IN ('src1', 'src2') THEN 1.05 ELSE 1 END), 8) AS rrf_score FROM fu JOIN documents USING (doc_id))
SELECT query_id, doc_id, rrf_score FROM ad""")
def type_boost(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") < 300, F.array(F.lit("marginal"))).alias("quality_flags"), (F.col("lang") == "en").alias("soft_match"), F.col("source").alias("chunk_type"))
    fused = retrieval.rrf(*_hybrid(spark, d), sparse_weight=1.3).join(docs, "doc_id")
    return retrieval.adjust(fused, True, F.array(F.lit("src1"), F.lit("src2"))).select("query_id", "doc_id", "rrf_score")


@query(f"""WITH {_BM25}, fi AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm JOIN documents USING (doc_id) WHERE lang = 'en') WHERE rank <= 8),
n AS (SELECT query_id, count(*) AS n FROM fi GROUP BY 1),
ex AS (SELECT al.query_id, al.doc_id, al.rank FROM bm al LEFT JOIN n USING (query_id) WHERE al.rank <= 20 AND coalesce(n.n, 0) < 8 AND NOT EXISTS (SELECT 1 FROM fi WHERE fi.query_id = al.query_id AND fi.doc_id = al.doc_id)),
un AS (SELECT *, true AS soft_match FROM fi UNION ALL SELECT *, false FROM ex)
SELECT query_id, doc_id, soft_match, row_number() OVER (PARTITION BY query_id ORDER BY soft_match DESC, rank, doc_id)::INT AS rank FROM un""")
def soft_filter_relax(spark, d):
    """The best documents under the filter, filled up from the unfiltered pass where few."""
    docs, q = table(spark, d, "documents"), _questions(spark, d)
    made = written(retrieval.index(docs, lang=F.col("lang")), "bm25")
    hits = retrieval.search(made, q, k=20).select("query_id", "doc_id", "rank")
    filtered = retrieval.search(made, q, k=8, among=F.col("lang") == "en").select(*hits.columns)
    return retrieval.soft_relax(filtered, hits, 8).select("query_id", "doc_id", "soft_match", "rank")


def _two_legs(spark, d):
    """Dense hits by hashed vectors of all documents, and sparse hits."""
    docs, q = table(spark, d, "documents"), _questions(spark, d)
    embedded = lambda df, i: df.select(F.col(i).alias("doc_id"), answers.hash_embed(F.col("text")).alias("embedding"))
    vectors = written(embedded(spread(docs.select("doc_id", "text")), "doc_id"), "vectors")  # embedded once, not by each filter and block
    dense = retrieval.dense(vectors, embedded(q, "query_id"), k=10, id_col="doc_id", skip_self=False)
    return dense.select("query_id", "doc_id", "rank"), retrieval.bm25(docs, q, k=10)


@query()
def hybrid_search(spark, d):
    """rrf_hybrid with a dense leg that searches vectors; no SQL has the hash embedder."""
    return retrieval.rrf(*_two_legs(spark, d), sparse_weight=1.3).select("query_id", "doc_id", "rrf_score", "rank")


@query()
def hybrid_type_boost(spark, d):
    """type_boost over hybrid_search."""
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") < 300, F.array(F.lit("marginal"))).alias("quality_flags"), (F.col("lang") == "en").alias("soft_match"), F.col("source").alias("chunk_type"))
    fused = retrieval.rrf(*_two_legs(spark, d), sparse_weight=1.3).join(docs, "doc_id")
    return retrieval.adjust(fused, True, F.array(F.lit("src1"), F.lit("src2"))).select("query_id", "doc_id", "rrf_score")


@query(f"""WITH {_HYBRID}, rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, doc_id)::INT AS rank FROM fu)
SELECT query_id, rank, doc_id, round(rrf_score, 4) AS score, substr(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' '), 1, 200) AS snippet FROM rk JOIN documents USING (doc_id) WHERE rank <= 8""")
def search_results(spark, d):
    return retrieval.result_rows(retrieval.rrf(*_hybrid(spark, d), sparse_weight=1.3), table(spark, d, "documents"))


@query(f"""WITH n AS (SELECT conv_id, turn, trim(substr(trim(regexp_replace(regexp_replace(nfc_normalize(text), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', ' ', 'g'), '\\s+', ' ', 'g'), ' '), 1, 2000), ' ') AS t FROM conversations WHERE role = 'user'),
p AS (SELECT conv_id, turn, t, list_distinct(list_transform(regexp_extract_all(t, '{query_.PROTECTED}'), lambda x: trim(x, '`'))) AS p, list_filter(regexp_extract_all(t, '{query_.QUERY_TOKEN.replace(chr(39), chr(39) * 2)}'), lambda x: trim(x, chr(39) || '`.:/-') <> '') AS k FROM n)
SELECT conv_id, turn, t AS normalised, lower(t) AS sparse_text, len(p)::INT AS n_protected, len(k)::INT AS n_tokens, CASE WHEN t = '' THEN 'E6001' END AS error FROM p""")
def query_process(spark, d):
    turns = table(spark, d, "conversations").where("role = 'user'").withColumn("query_id", F.struct("conv_id", "turn"))
    out = query_.process(turns, now())
    return out.select("conv_id", "turn", "normalised", "sparse_text", F.size("protected").alias("n_protected"), F.size("tokens").alias("n_tokens"), "error")


@query("SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text) AS n FROM conversations WHERE role = 'assistant') WHERE n = 1")
def last_assistant_turn(spark, d):
    return answers.last_turns(table(spark, d, "conversations").where("role = 'assistant'"), 1).select("conv_id", "turn", "text")


@query("SELECT vec_id AS chunk_id, label::VARCHAR AS sha, 'v1' AS version FROM embeddings WHERE vec_id % 5 <> 4")
def vector_store_apply(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("sha"), F.lit("v1").alias("version"))
    stored = v.where("chunk_id % 5 <> 3").withColumn("sha", F.when(F.col("sha").cast("int") % 2 == 1, "old").otherwise(F.col("sha")))
    return retrieval.apply_actions(v.where("chunk_id % 5 <> 4"), stored)


def _reranked(spark, d):
    docs, q = table(spark, d, "documents"), _questions(spark, d)
    hits = written(retrieval.bm25(docs, q, k=10), "hits")
    cores = 2 * spark.sparkContext.defaultParallelism
    found = docs.select("doc_id", "text").join(hits.select("doc_id").distinct(), "doc_id", "left_semi").repartition(cores)  # terms once for each passage
    rows = hits.join(found.select("doc_id", text.content_terms(F.col("text")).alias("passage_terms")), "doc_id").repartition(cores, "query_id", "doc_id").join(q.select("query_id", text.content_terms(F.col("text")).alias("query_terms")), "query_id")
    return retrieval.rerank(rows, 8)


_RERANK = _BM25 + f""",
qw AS (SELECT item_id AS query_id, list_distinct(list(term)) AS qw FROM ({_tokens("benchmark", "item_id", "false")}) WHERE term NOT IN ({_STOP}) GROUP BY 1),
dw AS (SELECT doc_id, list(term) AS w FROM ({_tokens("(SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM bm WHERE rank <= 10))", "doc_id", "false")}) WHERE term NOT IN ({_STOP}) GROUP BY 1),
ca AS (SELECT bm.query_id, bm.doc_id, bm.rank, coalesce(qw, []) AS qw, coalesce(w, []) AS w, list_distinct(coalesce(w, [])) AS bag FROM bm LEFT JOIN qw USING (query_id) LEFT JOIN dw USING (doc_id) WHERE bm.rank <= 10),
ma AS (SELECT *, list_filter(qw, lambda t: list_contains(bag, t) OR (length(t) >= 5 AND len(list_filter(bag, lambda x: length(x) >= 5 AND (starts_with(x, t) OR starts_with(t, x)))) > 0)) AS m FROM ca),
re AS (SELECT query_id, doc_id, rank, CASE WHEN rank <= 8 AND (len(qw) = 0 OR len(w) = 0) THEN 0.0 WHEN rank <= 8 THEN round(least(1.0, 0.75 * len(m) / len(qw) + 0.25 * least(1.0, 10.0 * len(list_filter(w, lambda x: list_contains(m, x) OR (length(x) >= 5 AND len(list_filter(m, lambda t: length(t) >= 5 AND (starts_with(x, t) OR starts_with(t, x)))) > 0))) / len(w))), 4) END AS rerank_score FROM ma)
"""


@query(f"WITH {_RERANK} SELECT query_id, doc_id, rerank_score FROM re")
def lexical_rerank(spark, d):
    return _reranked(spark, d).select("query_id", "doc_id", "rerank_score")


@query(f"""WITH {_RERANK}, g AS (SELECT query_id, max(rerank_score) AS c, count(*) FILTER (rerank_score >= 0.2) AS strong FROM re GROUP BY 1)
SELECT query_id, c AS confidence, strong, CASE WHEN c < 0.35 THEN 'low_confidence' WHEN c < 0.6 AND strong < 2 THEN 'insufficient_candidates' END AS reason FROM g""")
def confidence_gate(spark, d):
    return retrieval.confidence_gate(_reranked(spark, d)).select("query_id", "confidence", "strong", "reason")


def _context(spark, d):
    docs = table(spark, d, "documents")
    hits = _reranked(spark, d).select("query_id", "doc_id", F.col("final_rank").alias("rank"), F.coalesce("rerank_score", F.lit(0.0)).alias("score"))
    return answers.build_context(hits.join(docs.select("doc_id", "text", F.col("source").alias("document_id"), F.lit(0).alias("chunk_index")), "doc_id"))


@query()
def context_build(spark, d):
    return _context(spark, d)


@query()
def extractive_answer(spark, d):
    return answers.extractive_answer(_context(spark, d))


@query("SELECT vec_id AS chunk_id, CASE WHEN vec_id % 5 = 4 THEN 'delete' WHEN vec_id % 5 = 3 OR label % 2 = 1 THEN 'upsert' ELSE 'keep' END AS action FROM embeddings")
def index_reconcile(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("sha"), F.lit("v1").alias("version"))
    stored = v.where("chunk_id % 5 <> 3").withColumn("sha", F.when(F.col("sha").cast("int") % 2 == 1, "old").otherwise(F.col("sha")))
    return retrieval.reconcile(v.where("chunk_id % 5 <> 4"), stored)


# -- queries and conversations ----------------------------------------------


def _rules(column: str) -> str:
    quoted = {n: p.replace("'", "''") for n, p in patterns.INTENTS.items()}
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p}') THEN '{n}'" for n, p in quoted.items()) + " ELSE 'factual_lookup' END"


@query(f"SELECT conv_id, turn, {_rules('text')} AS intent FROM conversations")
def intent_classify(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", patterns.intent(F.col("text")).alias("intent"))


@query(f"WITH i AS (SELECT conv_id, turn, {_rules('text')} AS intent FROM conversations) SELECT conv_id, turn, CASE intent WHEN 'how_to' THEN 10 WHEN 'comparison' THEN 10 WHEN 'summarization' THEN 12 WHEN 'chitchat' THEN 0 ELSE 8 END::INT AS top_k, CASE WHEN intent IN ('code_search', 'troubleshooting') THEN 1.3 WHEN intent = 'summarization' THEN 0.8 WHEN intent = 'chitchat' THEN 0.0 ELSE 1.0 END::DOUBLE AS sparse_weight FROM i")
def intent_profile(spark, d):
    i = table(spark, d, "conversations").select("conv_id", "turn", patterns.intent(F.col("text")).alias("intent"))
    return i.select("conv_id", "turn", patterns.profile(F.col("intent"), 0).alias("top_k"), patterns.profile(F.col("intent"), 1).alias("sparse_weight"))


@query(r"""SELECT doc_id, len(list_distinct(regexp_extract_all(text, '\bv?\d+\.\d+(?:\.\d+)?\b')))::INT AS versions, len(list_distinct(regexp_extract_all(text, 'https?://\S+')))::INT AS urls,
len(list_distinct(regexp_extract_all(text, '\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b')))::INT AS env_vars FROM documents""")
def entity_extract(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", *(F.size(patterns.entities(c, k)).alias(k) for k in ("versions", "urls", "env_vars")))


@query(rf"""SELECT conv_id, turn, regexp_matches(text, '{patterns.SOURCE_HINT}') AS pdf, nullif(lower(regexp_extract(text, '{patterns.LANGUAGE_HINT}', 1)), '') AS code_language,
CASE WHEN regexp_matches(text, '{patterns.TEMPORAL}') THEN {{now}} - INTERVAL 90 DAYS END AS updated_after FROM conversations""")
def soft_filters(spark, d):
    s = patterns.soft_filters(F.col("text"), F.expr(NOW.replace("TIMESTAMP", "TIMESTAMP_NTZ")))
    return table(spark, d, "conversations").select("conv_id", "turn", s.alias("s")).select("conv_id", "turn", F.col("s.source_type").isNotNull().alias("pdf"), "s.code_language", "s.updated_after")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def history_last_n(spark, d):
    return answers.last_turns(table(spark, d, "conversations"), 3).select("conv_id", "turn", "role")


@query(rf"""
WITH m AS (SELECT *, len(list_filter(regexp_split_to_array(trim(text, ' '), '\s+'), lambda x: x <> '')) AS nw, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS p,
  CASE WHEN role = 'user' THEN replace(list_last(regexp_extract_all(text, '{answers._ENTITY}')), '`', '') END AS e FROM conversations),
f AS (SELECT *, last_value(e IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS le FROM m)
SELECT conv_id, turn, p IS NOT NULL AND (nw < 4 OR regexp_matches(text, '{patterns.ANAPHORA}')) AS needs_rewrite,
  CASE WHEN p IS NOT NULL AND (nw < 4 OR regexp_matches(text, '{patterns.ANAPHORA}')) THEN text || ' ' || coalesce(le, substr(p, 1, 80)) ELSE text END AS rewritten
FROM f WHERE role = 'user'""")
def conversation_rewrite(spark, d):
    return answers.rewrite_queries(table(spark, d, "conversations")).select("conv_id", "turn", "needs_rewrite", "rewritten")


@query("SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS digest FROM conversations WHERE conv_id % 10 <> 3 GROUP BY conv_id")
def gdpr_export(spark, d):
    m = table(spark, d, "conversations")
    kept = governance.erase(m, m.where("conv_id % 10 = 3").select("conv_id"), "conv_id")
    turns = F.from_json("turns", "array<struct<turn:long,role:string,text:string>>")
    joined = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return governance.export_conversations(kept).select("conv_id", "n_turns", F.sha2(joined, 256).alias("digest"))


@query("SELECT user_id, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-02-20' - INTERVAL 30 DAYS GROUP BY user_id")
def conversation_ttl(spark, d):
    return governance.expired(table(spark, d, "events"), "ts", F.expr("TIMESTAMP_NTZ '2024-02-20'"), governance.KEEP_DAYS["conversations"]).groupBy("user_id").agg(F.count("*").alias("n"))


@query()
def spell_correct(spark, d):
    vocab = answers.vocabulary(table(spark, d, "documents"))
    terms = table(spark, d, "conversations").where("role = 'user'").select(F.explode(text.words(F.col("text"))).alias("word"))
    return answers.spell_correct(terms, vocab)


@query()
def hash_embed(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", answers.hash_embed(F.col("text"), 64).alias("vector"))


# -- chunks ------------------------------------------------------------------


def _talks(spark, d, version):
    """Each conversation as a document with a heading for each turn; the second version edits
    some turns and leaves out others, of three conversations in four."""
    t = table(spark, d, "conversations").where("text is not null and turn is not null and conv_id is not null")
    words = F.concat(F.lit("said "), F.substring_index(F.trim(F.regexp_replace("text", "[^A-Za-z]+", " ")), " ", 60))
    t = t.groupBy("conv_id", "turn").agg(F.min(words).alias("said"))
    if version == 2:
        kept = (F.col("conv_id") % 4 == 0) | (F.col("turn") % 5 != 4)
        t = t.where(kept).withColumn("said", F.when((F.col("conv_id") % 4 != 0) & (F.col("turn") % 3 == 1), F.concat("said", F.lit(" edited"))).otherwise(F.col("said")))
    part = F.concat(F.lit("# turn "), F.col("turn"), F.lit("\n\n"), F.col("said"), F.lit("\n"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))), lambda x: x["part"]), "\n")
    return t.groupBy("conv_id").agg(whole.alias("text")).select(F.col("conv_id").cast("string").alias("document_id"), F.concat(F.lit(f"v{version}-"), F.col("conv_id")).alias("document_version_id"), "text", F.lit(f"2024-01-0{version}").cast("timestamp").alias("parsed_at"), F.lit(False).alias("is_deleted"))


_TALKS = """WITH t AS (SELECT conv_id, turn, min('said ' || array_to_string(string_split(trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')), ' ')[1:60], ' ')) AS said FROM conversations WHERE text IS NOT NULL AND turn IS NOT NULL AND conv_id IS NOT NULL GROUP BY conv_id, turn),
n AS (SELECT *, conv_id % 4 <> 0 AND turn % 3 = 1 AS edited FROM t WHERE conv_id % 4 = 0 OR turn % 5 <> 4),
g AS (SELECT conv_id FROM n GROUP BY conv_id) """


def _two_runs(spark, d):
    """(history of chunk rows after a run over each version, documents, counts of the second run)"""
    docs = [_talks(spark, d, v) for v in (1, 2)]
    first, _, _ = chunking.chunk_run(docs[0], chunking.no_chunks(spark), F.lit("2024-01-01").cast("timestamp"))
    rows = first.withColumns({"is_deleted": F.lit(False), "is_current": F.lit(True)})
    every = docs[0].unionByName(docs[1])
    current = views.current_documents(every)
    fresh, dead, counts = chunking.chunk_run(current, rows, F.lit("2024-01-02").cast("timestamp"))
    history = rows.unionByName(fresh.withColumns({"is_deleted": F.lit(False), "is_current": F.lit(True)})).unionByName(dead.select(*rows.columns))
    return history, every, counts


@query(_TALKS + """SELECT conv_id::VARCHAR AS document_id, 'turn ' || turn AS heading_breadcrumb, said || CASE WHEN edited THEN ' edited' ELSE '' END AS text, 'v2-' || conv_id AS document_version_id, NOT edited AS first_of_lineage FROM n
UNION ALL SELECT t.conv_id::VARCHAR, 'turn ' || turn, said, 'v1-' || t.conv_id, true FROM t WHERE t.conv_id NOT IN (SELECT conv_id FROM g)""")
def chunk_run(spark, d):
    """What is current after two versions of every conversation were cut one after the other."""
    history, docs, _ = _two_runs(spark, d)
    now_current = views.current_chunks(history, docs)
    body = F.regexp_extract("text", r"(?s)(said.*)$", 1)
    return now_current.select("document_id", "heading_breadcrumb", F.trim(body).alias("text"), "document_version_id", (F.col("lineage_id") == F.col("chunk_id")).alias("first_of_lineage"))


@query(_TALKS + """SELECT status, count(*) AS n FROM (
  SELECT CASE WHEN n.conv_id IS NULL THEN 'removed' WHEN n.edited THEN 'modified' ELSE 'unchanged' END AS status FROM t LEFT JOIN n USING (conv_id, turn) WHERE t.conv_id IN (SELECT conv_id FROM g)
  UNION ALL SELECT 'superseded' FROM n WHERE edited) GROUP BY status""")
def chunk_run_counts(spark, d):
    return _two_runs(spark, d)[2]


def _doc_chunks(spark, d):
    docs = table(spark, d, "documents").withColumn("document_id", F.col("doc_id").cast("string"))
    return chunking.chunk_documents(docs, title=F.col("source"))


@query()
def chunk_documents(spark, d):
    return _doc_chunks(spark, d).drop("prev_chunk_id", "next_chunk_id")


@query()
def chunk_links(spark, d):
    return _doc_chunks(spark, d).select("document_id", "chunk_index", "chunk_id", "prev_chunk_id", "next_chunk_id")


@query("""
WITH o AS (SELECT doc_id, (doc_id // 4)::VARCHAR AS document_id, 'k' || (doc_id % 4) AS chunk_key, sha256(text) AS s FROM documents WHERE doc_id % 9 <> 0),
n AS (SELECT doc_id, (doc_id // 4)::VARCHAR AS document_id, CASE WHEN doc_id % 10 = 1 THEN 'm' ELSE 'k' END || (doc_id % 4) AS chunk_key, CASE WHEN doc_id % 6 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS s FROM documents WHERE doc_id % 8 <> 0),
k AS (SELECT n.*, o.s AS os, o.document_id IS NOT NULL AS keyed FROM n LEFT JOIN o ON n.document_id = o.document_id AND n.chunk_key = o.chunk_key),
fr AS (SELECT *, row_number() OVER (PARTITION BY document_id, s ORDER BY chunk_key) AS i FROM k WHERE NOT keyed),
fo AS (SELECT *, row_number() OVER (PARTITION BY document_id, s ORDER BY chunk_key) AS i FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.document_id = o.document_id AND n.chunk_key = o.chunk_key)),
mo AS (SELECT fr.document_id, fr.chunk_key, CASE WHEN fo.s IS NULL THEN 'added' ELSE 'moved' END AS status, fo.doc_id AS claims, fr.s, fo.document_id || ':' || fo.chunk_key || ':' || fo.s AS lineage FROM fr LEFT JOIN fo ON fr.document_id = fo.document_id AND fr.s = fo.s AND fr.i = fo.i),
g AS (SELECT document_id, chunk_key, CASE WHEN s = os THEN 'unchanged' ELSE 'modified' END AS status, document_id || ':' || chunk_key || ':' || s AS chunk, document_id || ':' || chunk_key || ':' || os AS lineage FROM k WHERE keyed
  UNION ALL SELECT document_id, chunk_key, status, document_id || ':' || chunk_key || ':' || s, coalesce(lineage, document_id || ':' || chunk_key || ':' || s) FROM mo
  UNION ALL SELECT document_id, chunk_key, 'superseded', document_id || ':' || chunk_key || ':' || s, document_id || ':' || chunk_key || ':' || s FROM o WHERE EXISTS (SELECT 1 FROM k WHERE keyed AND k.document_id = o.document_id AND k.chunk_key = o.chunk_key AND k.s <> o.s)
  UNION ALL SELECT document_id, chunk_key, CASE WHEN doc_id IN (SELECT claims FROM mo WHERE claims IS NOT NULL) THEN 'superseded' ELSE 'removed' END, document_id || ':' || chunk_key || ':' || s, document_id || ':' || chunk_key || ':' || s FROM fo)
SELECT document_id, chunk_key, status, chunk, lineage FROM g""")
def chunk_diff(spark, d):
    base = table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 4).cast("string").alias("document_id"), (F.col("doc_id") % 4).cast("string").alias("k"), "text")
    ident = lambda df: df.withColumn("chunk_id", F.concat("document_id", F.lit(":"), "chunk_key", F.lit(":"), "chunk_checksum")).withColumn("lineage_id", F.col("chunk_id"))
    old = ident(base.where("doc_id % 9 <> 0").withColumn("chunk_key", F.concat(F.lit("k"), "k")).withColumn("chunk_checksum", F.sha2("text", 256)))
    edited = F.when(F.col("doc_id") % 6 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    new = ident(base.where("doc_id % 8 <> 0").withColumn("chunk_key", F.concat(F.when(F.col("doc_id") % 10 == 1, "m").otherwise("k"), "k")).withColumn("chunk_checksum", F.sha2(edited, 256)))
    return chunking.chunk_diff(new, old).select("document_id", "chunk_key", "status", F.col("chunk_id").alias("chunk"), F.col("lineage_id").alias("lineage"))


# -- pages and identities ----------------------------------------------------


@query("""SELECT page_id, nullif(trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g'), ' '), '') AS title,
regexp_matches(substr(html, 1, 2048), '(?is)<!doctype html|<html|<head|<body') AS is_html FROM pages""")
def html_titles(spark, d):
    return table(spark, d, "pages").select("page_id", pages.title(F.col("html")).alias("title"), pages.looks_like_html(F.col("html")).alias("is_html"))


@query()
def html_main_text(spark, d):
    return pages.parse_pages(table(spark, d, "pages"))


_URI = r"regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*')) || regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', '')"


@query(f"SELECT page_id, CASE WHEN regexp_matches({_URI}, '^[a-z]+://[^/]*$') THEN {_URI} || '/' ELSE {_URI} END AS uri FROM pages")
def url_canonical(spark, d):
    return table(spark, d, "pages").select("page_id", ids.canonical_uri(F.col("url")).alias("uri"))


def _uuid5(namespace, name: str) -> str:
    h = f"sha1('{''.join(f'{chr(92)}x{x:02X}' for x in namespace.bytes)}'::BLOB || encode({name}))"
    return f"(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || lower(printf('%02x', (('0x' || substr(h, 17, 2))::INT & 63) | 128)) || substr(h, 19, 2) || '-' || substr(h, 21, 12) FROM (SELECT {h} AS h))"


@query(f"""WITH u AS (SELECT page_id, html, CASE WHEN regexp_matches({_URI}, '^[a-z]+://[^/]*$') THEN {_URI} || '/' ELSE {_URI} END AS uri FROM pages),
d AS (SELECT page_id, html, {_uuid5(ids.NS_DOCUMENT, "uri")} AS document_id FROM u)
SELECT page_id, document_id, {_uuid5(ids.NS_DOCUMENT, "document_id || ':' || sha256(html) || ':1'")} AS version_id FROM d""")
def document_ids(spark, d):
    p = table(spark, d, "pages")
    doc = ids.document_id(F.col("url"))
    return p.select("page_id", doc.alias("document_id"), ids.document_version_id(doc, F.sha2("html", 256), "1").alias("version_id"))


@query("SELECT l_orderkey % 5 AS part, count(*) AS n_files, sum(l_partkey)::BIGINT AS n_bytes, count(*) FILTER (l_partkey < 40) AS n_small, count(*) >= 2 AND (count(*) > 8 OR count(*) FILTER (l_partkey < 40) > 0) AS compact FROM lineitem GROUP BY 1")
def compaction_plan(spark, d):
    files = table(spark, d, "lineitem").select((F.col("l_orderkey") % 5).alias("partition"), F.col("l_partkey").alias("length"))
    return lakehouse.compaction_plan(files, small=40).withColumnRenamed("partition", "part")


@query("""WITH b AS (SELECT doc_id, n_chars FROM documents WHERE doc_id % 7 <> 0), n AS (SELECT doc_id, n_chars + (CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END) AS n_chars FROM documents WHERE doc_id % 3 <> 0)
SELECT coalesce(b.doc_id, n.doc_id)::VARCHAR AS path, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN b.n_chars <> n.n_chars THEN 'changed' ELSE 'same' END AS change FROM b FULL JOIN n ON b.doc_id = n.doc_id""")
def listing_diff(spark, d):
    f = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.lit(0).alias("modificationTime"), F.col("n_chars").alias("length"))
    fresh = f.where("doc_id % 3 <> 0").withColumn("length", F.col("length") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0))
    return lakehouse.listing_diff(f.where("doc_id % 7 <> 0"), fresh)


@query("SELECT sha256(text) AS content_sha256 FROM documents EXCEPT SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0")
def new_objects(spark, d):
    f = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_sha256"))
    return lakehouse.new_objects(f, f.where("doc_id % 2 = 0")).select("content_sha256")


# -- evaluation and governance ----------------------------------------------

_IR = """
WITH r AS (SELECT conv_id, list(turn ORDER BY sha256(conv_id || ':' || turn)) AS got, list(turn ORDER BY turn) FILTER (role = 'user') AS want FROM conversations GROUP BY conv_id),
m AS (SELECT conv_id, list_slice(got, 1, 3) AS top, got, want, len(list_intersect(list_slice(got, 1, 3), want)) AS hits FROM r),
s AS (SELECT conv_id, hits::DOUBLE / len(want) AS recall, hits::DOUBLE / len(top) AS prec,
 1.0 / list_min(list_filter(list_transform(got, lambda x, i: CASE WHEN list_contains(want, x) THEN i ELSE 999999 END), lambda i: i < 999999)) AS mrr,
 list_sum(list_transform(top, lambda x, i: CASE WHEN list_contains(want, x) THEN 1.0 / log2(i + 1) ELSE 0.0 END)) / list_sum(list_transform(range(1, least(len(want), 3) + 1), lambda i: 1.0 / log2(i + 1))) AS ndcg FROM m)
"""


def _rankings(spark, d):
    key = F.sha2(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")), 256)
    got = F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), "turn"))), lambda x: x["turn"])
    return table(spark, d, "conversations").groupBy("conv_id").agg(got.alias("retrieved"), F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.col("turn")))).alias("relevant"))


@query(_IR + "SELECT conv_id, round(recall, 6) AS recall_at_3, round(prec, 6) AS precision_at_3, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg_at_3 FROM s")
def ir_metrics(spark, d):
    s = evaluation.score_rows(_rankings(spark, d), 3)
    return s.select("conv_id", *(F.round(c, 6).alias(c) for c in ("recall_at_3", "precision_at_3", "mrr", "ndcg_at_3")))


def _gate_rows(spark, d):
    return table(spark, d, "events").select((F.col("value") / 100).alias("confidence"), (F.col("event_id") % 3).alias("strong"), (F.col("event_type") != "error").alias("answerable"))


_GATE = "WITH r AS (SELECT value / 100 AS confidence, event_id % 3 AS strong, event_type <> 'error' AS ok FROM events)"


@query(_GATE + """, a AS (SELECT ok, NOT (confidence < 0.35 OR (confidence < 0.6 AND strong < 2)) AS ans FROM r)
SELECT count(*) FILTER (NOT ok AND NOT ans) AS refused_rightly, count(*) FILTER (ok AND NOT ans) AS refused_wrongly, count(*) FILTER (ok AND ans) AS answered_rightly, count(*) FILTER (NOT ok AND ans) AS answered_wrongly FROM a""")
def refusal_counts(spark, d):
    r = _gate_rows(spark, d).withColumn("ans", retrieval.gate_reason(F.col("confidence"), F.col("strong")).isNull())
    c = evaluation.refusal(F.col("answerable"), F.col("ans"))
    return r.agg(*(c[n].alias(n) for n in ("refused_rightly", "refused_wrongly", "answered_rightly", "answered_wrongly")))


@query(_GATE + """, t AS (SELECT round(0.05 * i, 2)::DOUBLE AS threshold FROM range(1, 19) g(i)), a AS (SELECT threshold, ok, NOT (confidence < threshold OR (confidence < 0.6 AND strong < 2)) AS ans FROM r, t),
c AS (SELECT threshold, count(*) FILTER (NOT ok AND NOT ans) AS tp, count(*) FILTER (ok AND NOT ans) AS fp, count(*) FILTER (NOT ok AND ans) AS fn, avg(ans::INT) FILTER (ok) AS sr FROM a GROUP BY 1)
SELECT threshold, round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 1 END, 6) AS refusal_precision, round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 1 END, 6) AS refusal_recall, round(coalesce(sr, 0), 6) AS sufficient_rate FROM c""")
def threshold_sweep(spark, d):
    return evaluation.sweep(_gate_rows(spark, d))


@query("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    return evaluation.latency(table(spark, d, "events"), "event_type", "value")


@query(f"""WITH {_HYBRID}, gt AS (SELECT query_id, list(doc_id) AS want FROM de WHERE rank <= 3 GROUP BY 1),
ht AS (SELECT query_id, list(doc_id ORDER BY rank) AS got FROM sp WHERE rank <= 5 GROUP BY 1),
r AS (SELECT b.item_id, coalesce(got, []) AS got, coalesce(want, []) AS want FROM benchmark b LEFT JOIN ht ON ht.query_id = b.item_id LEFT JOIN gt ON gt.query_id = b.item_id),
m AS (SELECT *, len(list_intersect(got, want)) AS hit, coalesce(list_min(list_filter(list_transform(want, lambda w: list_position(got, w)), lambda p: p > 0)), 0) AS first FROM r),
t AS (SELECT coalesce(avg(hit / len(want)) FILTER (len(want) > 0), 0) AS rec, coalesce(avg(CASE WHEN len(got) = 0 THEN 0 ELSE hit / len(got) END) FILTER (len(want) > 0), 0) AS pre, coalesce(avg(CASE WHEN first > 0 THEN 1.0 / first ELSE 0 END) FILTER (len(want) > 0), 0) AS mrr,
  count(*) FILTER (len(want) = 0 AND len(got) = 0) AS tp, count(*) FILTER (len(want) > 0 AND len(got) = 0) AS fp FROM m)
SELECT metric, value, threshold, threshold IS NULL OR value >= threshold AS passed FROM (
  SELECT 'recall_at_5' AS metric, round(rec, 6)::DOUBLE AS value, 0.85::DOUBLE AS threshold FROM t UNION ALL SELECT 'precision_at_5', round(pre, 6), NULL FROM t UNION ALL SELECT 'mrr', round(mrr, 6), 0.7 FROM t
  UNION ALL SELECT 'refusal_precision', CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 1.0 END, 0.8 FROM t)""")
def eval_run(spark, d):
    """BM25 held against the three nearest vectors of each question, with the gate's thresholds."""
    dense, sparse = _hybrid(spark, d)
    want = dense.where("rank <= 3").groupBy("query_id").agg(F.collect_list("doc_id").alias("relevant"))
    asked = _questions(spark, d).select("query_id").join(want, "query_id", "left").withColumn("relevant", F.coalesce("relevant", F.array().cast("array<bigint>")))
    out = evaluation.run(asked, sparse, 5, {"recall_at_5": 0.85, "mrr": 0.7, "refusal_precision": 0.8})
    return out.where(F.col("metric").isin("recall_at_5", "precision_at_5", "mrr", "refusal_precision"))


_TOPIC = "CASE WHEN lower(source) <> lower(lang) THEN source ELSE lang END"


@query(f"""WITH u AS (SELECT *, doc_id::VARCHAR AS chunk_id FROM documents ORDER BY md5('seed-1:' || doc_id::VARCHAR), doc_id::VARCHAR LIMIT 20)
SELECT {_uuid5(ids.NS_QA, "'v1:' || chunk_id")} AS qa_id, 'v1' AS version, replace([{", ".join(f"'{t}'" for t in evaluation.TEMPLATES)}][('0x' || substr(md5(chunk_id), 1, 4))::INT % 3 + 1], '{{}}', {_TOPIC}) AS question,
CASE WHEN regexp_extract(text, '^\\s*(.*?[.!?])(?:\\s|$)', 1) <> '' THEN regexp_extract(text, '^\\s*(.*?[.!?])(?:\\s|$)', 1) ELSE text END AS reference_answer, chunk_id AS expected_chunk_ids, source AS document_id FROM u""")
def question_set(spark, d):
    units = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("document_id"), F.col("lang").alias("title"), F.concat("lang", F.lit(" › "), "source").alias("heading_breadcrumb"), "text")
    return evaluation.question_set(units, 20, "seed-1", "v1").withColumn("expected_chunk_ids", F.array_join("expected_chunk_ids", ","))


@query("SELECT doc_id FROM documents ORDER BY md5('seed-1:' || doc_id), doc_id LIMIT 50")
def seeded_sample(spark, d):
    return evaluation.sample_by_seed(table(spark, d, "documents").select("doc_id"), "doc_id", 50, "seed-1")


@query("""WITH l AS (SELECT unnest(['view', 'click', 'refund']) AS event_type, unnest([60, 100000, 120]) AS lim), m AS (SELECT event_type, max(ts) AS last FROM events GROUP BY 1)
SELECT l.event_type, round(epoch_us({now} - INTERVAL 0 DAY)::DOUBLE / 60e6 - epoch_us(last)::DOUBLE / 60e6, 3) AS age_minutes, last IS NULL OR round(epoch_us({now})::DOUBLE / 60e6 - epoch_us(last)::DOUBLE / 60e6, 3) > lim AS stale FROM l LEFT JOIN m USING (event_type)""")
def freshness(spark, d):
    limits = spark.createDataFrame([("view", 60), ("click", 100000), ("refund", 120)], "event_type string, limit_minutes int")
    return governance.freshness(table(spark, d, "events"), limits, now(), "event_type", "ts")


@query("""WITH s AS (SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS statuses FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1)
SELECT user_id, statuses, count(DISTINCT event_id) AS n_versions, min(event_id) AS first_version, max(event_id) AS last_version FROM events JOIN s USING (user_id) GROUP BY ALL""")
def lineage_trace(spark, d):
    t = governance.document_trace(table(spark, d, "events"), "user_id", "event_type", "event_id")
    return t.withColumn("statuses", F.array_join(F.transform("statuses", lambda s: F.concat(s["status"], F.lit("="), s["n"].cast("string"))), ","))


@query("SELECT event_id, ts, user_id, event_type FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-10' ORDER BY ts DESC, event_id DESC LIMIT 100")
def audit_query(spark, d):
    log = table(spark, d, "events").withColumn("action", F.col("event_type"))
    return governance.audit(log, action="purchase", since=F.expr("TIMESTAMP_NTZ '2024-01-10'")).select("event_id", "ts", "user_id", "event_type")


@query("""WITH c AS (SELECT count(*) FILTER (event_type <> 'error') AS p, count(*) FILTER (event_type = 'error') AS q, count(*) FILTER (event_type = 'click') AS cf, count(*) FILTER (event_type = 'view') AS cc, avg((event_type <> 'signup')::INT) AS cov FROM events)
SELECT 'quarantine_ratio' AS gate, p + q > 0 AND q / greatest(p + q, 1) > 0.25 AS failed FROM c UNION ALL SELECT 'zero_parse', p + q > 0 AND p = 0 FROM c UNION ALL SELECT 'chunk_failures', cf / greatest(cf + cc, 1) > 0.3 FROM c UNION ALL SELECT 'embedding_coverage', cov < 0.99 FROM c""")
def quality_gates(spark, d):
    e = F.col("event_type")
    c = table(spark, d, "events").agg(F.count_if(e != "error").alias("parsed"), F.count_if(e == "error").alias("quarantined"), F.count_if(e == "click").alias("chunk_failures"), F.count_if(e == "view").alias("chunked"), F.avg((e != "signup").cast("double")).alias("coverage"))
    return governance.gates(c)


@query("SELECT event_id FROM events WHERE event_type = 'view' AND ts < {now} - INTERVAL 20 DAYS AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 95)")
def retention_plan(spark, d):
    e = table(spark, d, "events")
    used = e.where("event_type = 'purchase' and value > 95").select("user_id")
    return governance.unreferenced(e.where("event_type = 'view'"), used, "user_id", "ts", F.expr(NOW.replace("TIMESTAMP", "TIMESTAMP_NTZ")), 20).select("event_id")


@query("SELECT user_id, max(ts) AS newest FROM events GROUP BY 1 HAVING max(ts) < {now} - INTERVAL 2 DAYS AND user_id <> 5")
def stale_embedding_versions(spark, d):
    return governance.stale_versions(table(spark, d, "events"), "user_id", "ts", F.expr(NOW.replace("TIMESTAMP", "TIMESTAMP_NTZ")), 2).where("user_id <> 5")


@query("SELECT user_id, count(*) AS n, min(ts) AS started, max(ts) AS finished, round((epoch_us(max(ts)) - epoch_us(min(ts)))::DOUBLE / 1e6, 3) AS seconds, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY user_id")
def run_log(spark, d):
    return governance.run_log(table(spark, d, "events"), "user_id", "ts", "event_type")


# -- SQL surface -------------------------------------------------------------


def _sql(spark, d, q: str, *tables: str) -> DataFrame:
    """Ad-hoc SQL over the tables: names in braces are DataFrames, so no view is left behind."""
    return spark.sql(q, **{t: table(spark, d, t) for t in tables})


@query("""SELECT n_name, o_orderpriority, count(*) AS n, sum((l_extendedprice * (1 - l_discount))::DECIMAL(18, 6))::DOUBLE AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def sql_revenue(spark, d):
    li = table(spark, d, "lineitem").where("l_shipdate < TIMESTAMP_NTZ '1998-09-02'").select("l_orderkey", "l_extendedprice", "l_discount")
    o = table(spark, d, "orders").where("o_orderdate >= TIMESTAMP_NTZ '1995-01-01'").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("n"), F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,6)")).cast("double").alias("revenue"))


@query("""SELECT 'inner' AS kind, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey UNION ALL SELECT 'left', count(*) FROM customer LEFT JOIN orders ON c_custkey = o_custkey UNION ALL SELECT 'full', count(*) FROM customer FULL JOIN supplier ON c_custkey = s_suppkey + 50
UNION ALL SELECT 'semi', count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'anti', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'range', count(*) FROM part JOIN supplier ON p_retailprice BETWEEN s_acctbal AND s_acctbal + 10""")
def sql_join_kinds(spark, d):
    c, o, s, p = (table(spark, d, t) for t in ("customer", "orders", "supplier", "part"))
    on = F.col("c_custkey") == F.col("o_custkey")
    one = lambda df, k: df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    # The range join: both sides fall into bins of the width, so it is an equi join.
    bins = s.select("s_acctbal", F.explode(F.array(F.floor(F.col("s_acctbal") / 10), F.floor(F.col("s_acctbal") / 10) + 1)).alias("b"))
    near = p.select("p_retailprice", F.floor(F.col("p_retailprice") / 10).alias("b")).join(bins, "b").where("p_retailprice between s_acctbal and s_acctbal + 10")
    out = one(c.join(o, on), "inner")
    for how, k in (("left", "left"), ("left_semi", "semi"), ("left_anti", "anti")):
        out = out.union(one(c.join(o, on, how), k))
    return out.union(one(c.join(s, F.col("c_custkey") == F.col("s_suppkey") + 50, "full"), "full")).union(one(near, "range"))


@query("SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, grouping(l_returnflag, l_linestatus)::BIGINT AS g, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def sql_cube(spark, d):
    c = table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))
    return c.select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "g", "n", "qty")


@query("SELECT coalesce(r_name, '*') AS region, coalesce(n_name, '*') AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def sql_rollup(spark, d):
    return _sql(spark, d, "SELECT coalesce(r_name, '*') AS region, coalesce(n_name, '*') AS nation, count(*) AS n FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)", "customer", "nation", "region")


@query("SELECT 'union' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'union_all', count(*) FROM (SELECT c_custkey FROM customer UNION ALL SELECT o_custkey FROM orders)")
def sql_set_ops(spark, d):
    c, o, s = (table(spark, d, t) for t in ("customer", "orders", "supplier"))
    one = lambda df, k: df.agg(F.count("*").alias("n")).select(F.lit(k).alias("op"), "n")
    ck, ok = c.select("c_custkey"), o.select("o_custkey")
    return one(c.select("c_nationkey").union(s.select("s_nationkey")).distinct(), "union").union(one(ck.intersect(ok), "intersect")).union(one(ck.exceptAll(ok).distinct(), "except")).union(one(ck.union(ok), "union_all"))


@query("""SELECT o_orderkey, rank() OVER w AS rnk, dense_rank() OVER w AS drnk, ntile(4) OVER w AS quart, round(lag(o_totalprice) OVER w, 2) AS prev, round(sum(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS run3, round(first_value(o_totalprice) OVER w, 2) AS first_price
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def sql_window_frames(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    p = F.col("o_totalprice")
    out = table(spark, d, "orders").select("o_orderkey", F.rank().over(w).cast("long").alias("rnk"), F.dense_rank().over(w).cast("long").alias("drnk"), F.ntile(4).over(w).cast("long").alias("quart"), F.round(F.lag(p).over(w), 2).alias("prev"), F.round(F.sum(p).over(w.rowsBetween(-2, 0)), 2).alias("run3"), F.round(F.first(p).over(w), 2).alias("first_price"))
    return out


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def sql_topk(spark, d):
    return retrieval.top_k(table(spark, d, "orders"), 3, "o_custkey", "o_orderkey", "o_totalprice").select("o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT p.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY ALL) v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def sql_asof(spark, d):
    """The last view of a user at each purchase: one sort, no join."""
    e = table(spark, d, "events").where("event_type in ('purchase', 'view')")
    view = F.when(F.col("event_type") == "view", F.col("event_id"))
    w = Window.partitionBy("user_id").orderBy("ts", F.desc("event_type"), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("view_id", F.last(view, ignorenulls=True).over(w)).where("event_type = 'purchase'").select("event_id", "view_id")


@query("SELECT c_mktsegment, count(DISTINCT o_orderpriority) AS priorities, count(DISTINCT o_orderkey) AS orders_, round(stddev_samp(o_totalprice), 4) AS spread, round(median(o_totalprice), 4) AS mid FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def sql_distinct_aggs(spark, d):
    return _sql(spark, d, "SELECT c_mktsegment, count(DISTINCT o_orderpriority) AS priorities, count(DISTINCT o_orderkey) AS orders_, round(stddev_samp(o_totalprice), 4) AS spread, round(median(o_totalprice), 4) AS mid FROM {customer} JOIN {orders} ON c_custkey = o_custkey GROUP BY 1", "customer", "orders")


@query("SELECT event_type, count(*) FILTER ((props->>'k')::INT < 50) AS low, max((props->>'k')::INT) AS top FROM events GROUP BY event_type")
def sql_json(spark, d):
    k = F.from_json("props", "k int")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(k < 50).alias("low"), F.max(k).alias("top"))


# -- streams -----------------------------------------------------------------


def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    return streams.tumbling(_events(spark, d)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT w AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 3 HOURS, ts), time_bucket(INTERVAL 3 HOURS, ts) - INTERVAL 3 HOURS]) AS w FROM events) GROUP BY ALL")
def stream_sliding(spark, d):
    return streams.sliding(_events(spark, d)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), s AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 30 MINUTES THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM l)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, g""")
def stream_session(spark, d):
    return streams.sessions(_events(spark, d)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, d):
    return streams.deduplicated(_events(spark, d), ["user_id", "event_type"]).select("user_id", "event_type")


# -- further operators -------------------------------------------------------

_HITS = ", ".join(
    f"len(list_filter(w, lambda x: list_contains([{', '.join(chr(39) + x + chr(39) for x in p.split())}], x))) AS {n}" for n, p in text.PROFILES.items()
)


@query(f"""WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents), h AS (SELECT doc_id, text, {_HITS} FROM w), b AS (SELECT *, greatest(de, en, es, fr) AS top, de + en + es + fr AS total FROM h)
SELECT doc_id, CASE WHEN length(text) < 20 OR total = 0 OR top < 0.7 * total THEN 'und' WHEN de = top THEN 'de' WHEN en = top THEN 'en' WHEN es = top THEN 'es' ELSE 'fr' END AS language FROM b""")
def language_detect(spark, d):
    return table(spark, d, "documents").select("doc_id", text.language(F.col("text")).alias("language"))


@query("SELECT doc_id FROM documents WHERE text ILIKE '%licens%' OR source ILIKE 'SRC1%'")
def substring_search(spark, d):
    return table(spark, d, "documents").where(F.col("text").ilike("%licens%") | F.col("source").ilike("SRC1%")).select("doc_id")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def upsert_last_wins(spark, d):
    return views.latest(table(spark, d, "events"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id", "value")


@query("SELECT vec_id AS id, 'kept' AS origin FROM embeddings UNION ALL SELECT doc_id, 'new' FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def insert_or_ignore(spark, d):
    have = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit("kept").alias("origin"))
    fresh = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("new").alias("origin"))
    return have.union(fresh.join(have.select("id"), "id", "left_anti"))


@query("SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS epoch_s, user_id::VARCHAR AS id, event_type IN ('view', 'click') AND user_id % 3 = 0 AS untrusted FROM events")
def vector_payload(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("epoch_s"), F.col("user_id").cast("string").alias("id"), (F.col("event_type").isin("view", "click") & (F.col("user_id") % 3 == 0)).alias("untrusted"))


@query(f"""WITH c AS (SELECT conv_id, turn, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]') AS t FROM conversations),
n AS (SELECT conv_id, turn, coalesce(list_sum(list_transform(t, lambda x: CASE WHEN regexp_full_match(x, '\\p{{L}}+') THEN CASE WHEN length(x) <= 6 THEN 1 ELSE 1 + (length(x) - 1) // 5 END WHEN regexp_full_match(x, '\\p{{Nd}}+') THEN 1 + (length(x) - 1) // 3 ELSE 1 END)), 0)::BIGINT AS n FROM c),
u AS (SELECT conv_id, turn, sum(n) OVER (PARTITION BY conv_id ORDER BY turn DESC)::BIGINT AS used FROM n) SELECT conv_id, turn, used FROM u WHERE used <= 400""")
def prompt_history(spark, d):
    return answers.prompt_history(table(spark, d, "conversations"), 400).select("conv_id", "turn", F.col("used").cast("long").alias("used"))


@query("SELECT source, count(*) AS n, count(*) FILTER (is_dup) AS dups, round(avg(n_chars), 4) AS mean_chars FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS is_dup FROM documents) GROUP BY source")
def source_summary(spark, d):
    docs = table(spark, d, "documents")
    first = dedup.exact_duplicates(docs, "doc_id", "text")
    return docs.join(first, "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("doc_id") != F.col("canonical_id")).alias("dups"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@query(f"""WITH b AS (SELECT doc_id::VARCHAR AS document_id, sha256(text) AS content_sha256, source AS source_uri,
  CASE WHEN contains(text, chr(0)) OR length(regexp_replace(text, '[^\ufffd]', '', 'g')) > 0.01 * greatest(1, length(text)) THEN 'E3004' WHEN length(trim(text, ' ')) < 100 THEN 'E3005' WHEN {_SECRET} THEN 'E3008' END AS code FROM documents)
SELECT {_uuid5(ids.uuid.NAMESPACE_URL, "document_id || ':' || content_sha256 || ':' || code || ':run-1'")} AS quarantine_id, document_id, content_sha256, source_uri, 'validate' AS stage, code, '' AS detail, 'run-1' AS run_id, 'open' AS status
FROM b WHERE code IS NOT NULL""")
def quarantine_rows(spark, d):
    docs = table(spark, d, "documents").withColumn("code", quality.reject_code(quality.violations(F.col("text"))))
    bad = docs.where("code is not null").select(F.col("doc_id").cast("string").alias("document_id"), F.sha2("text", 256).alias("content_sha256"), F.col("source").alias("source_uri"), F.lit("validate").alias("stage"), "code", F.lit("").alias("detail"))
    return lakehouse.quarantine(bad, "run-1", now()).drop("created_at", "ingest_date")  # the run's own time


@query()
def cited_answers(spark, d):
    return answers.cite_answers(answers.extractive_answer(_context(spark, d)).withColumn("n_blocks", F.lit(8)))


@query()
def embed_with_cache(spark, d):
    whole = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = whole.withColumn("embedded_text_sha256", F.sha2("text", 256))
    cache = docs.where("chunk_id % 2 = 0").select("embedded_text_sha256", answers.hash_embed(F.col("text"), 32).alias("vector"))
    return answers.embed_backlog(docs, cache, lambda c: answers.hash_embed(c, 32), 32).select("chunk_id", "cache_hit", "vector")
