"""Sparse, dense and hybrid retrieval of batches of queries as joins and windows."""

from __future__ import annotations

from collections import Counter
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from corpusloom.functions.batches import slices
from corpusloom.functions.text import let, search_terms, search_tokens
from corpusloom.session import spread, written

K1, B = 1.5, 0.75
RRF_K, FUSED, MARGINAL, SOFT_BONUS, SOFT_PENALTY, TYPE_BOOST = 60, 40, 0.9, 1.05, 0.85, 1.05
MIN_CONFIDENCE, STRONG, MIN_CANDIDATES, FLOOR = 0.35, 0.60, 2, 0.20
#: Query vectors, and distinct terms of queries, that are sent to every task at once; more
#: go in rounds. QUERY_BLOCK: queries whose weights are one matrix.
QUERY_VECTORS, QUERY_TERMS, QUERY_BLOCK = 4096, 500_000, 256
#: Query vectors whose scores a task of `dense` holds at once.
QUERY_TILE = 256


def index(docs: DataFrame, id_col: str = "doc_id", text: Column | None = None, tokens=None, **more: Column) -> DataFrame:
    """(id, dl, terms, tfs, more): the distinct terms of each document and how often each occurs.

    Counting happens where a document lies, so nothing is shuffled. `text` may put a prefix
    before the text; `more` are columns to filter by later. tokens: another tokenizer than
    search_terms, as a function of a Column."""
    source = F.col("text") if text is None else text
    base = docs.select(F.col(id_col).alias("id"), (tokens(source) if tokens else source.cast("string")).alias("toks"), *(c.alias(n) for n, c in more.items()))
    rest = [f for f in base.schema if f.name not in ("id", "toks")]

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "toks")):  # dictionaries of a slice only
            counts = [Counter(t or ()) if tokens else Counter(search_terms(t)) for t in batch.column("toks").to_pylist()]
            own = [pa.array([sum(c.values()) for c in counts], pa.int32()), pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *own, *(batch.column(f.name) for f in rest)], ["id", "dl", "terms", "tfs", *(f.name for f in rest)])

    base = spread(base)
    schema = StructType([base.schema["id"], StructField("dl", IntegerType()), StructField("terms", ArrayType(StringType())), StructField("tfs", ArrayType(IntegerType())), *rest])
    return base.mapInArrow(run, schema)


def save_index(index: DataFrame, path: str, version: str, id_kind: str = "long") -> None:
    """Write an index as a version of its own: documents, document frequencies and totals."""
    index.write.mode("overwrite").parquet(f"{path}/version={version}/documents")
    written = index.sparkSession.read.parquet(f"{path}/version={version}/documents")
    _frequencies(written).write.mode("overwrite").parquet(f"{path}/version={version}/frequencies")
    _totals(written).write.mode("overwrite").parquet(f"{path}/version={version}/totals")


def load_index(spark: SparkSession, path: str, version: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, frequencies, totals) of a version; a missing one raises an error."""
    return tuple(spark.read.parquet(f"{path}/version={version}/{name}") for name in ("documents", "frequencies", "totals"))


def _frequencies(index: DataFrame) -> DataFrame:
    return index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def _totals(index: DataFrame) -> DataFrame:
    return index.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def _statistics(index: DataFrame, terms: set[str], frequencies: DataFrame | None, totals: DataFrame | None) -> tuple[int, float, dict[str, int]]:
    """(documents, average length, documents of each of the terms): of a saved index, or by one
    pass over a new one, in which the empty term stands for the document itself."""
    names = F.broadcast(index.sparkSession.createDataFrame([(t,) for t in sorted(terms | {""})], "term string"))
    if frequencies is not None and totals is not None:
        n, avgdl = totals.first()
        return n, avgdl, {x["term"]: x["df"] for x in frequencies.join(names, "term", "left_semi").collect()}
    each = index.select(F.explode(F.concat(F.array(F.lit("")), "terms")).alias("term"), "dl").join(names, "term", "left_semi")
    found = {x["term"]: x for x in each.groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("size")).collect()}
    own = found.pop("", None)
    return (own["df"], own["size"] / own["df"], {t: x["df"] for t, x in found.items()}) if own else (0, 0.0, {})


def _best(found: list[tuple], k: int) -> tuple:
    """Of (query, kind, score, id) arrays the k best of each query and kind, ties to the smaller id."""
    q, kind, s, i = (np.concatenate([f[c] for f in found]) for c in range(4))
    by = np.unique(i, return_inverse=True)[1] if len(i) else np.zeros(0, np.int64)
    order = np.lexsort((by, -np.round(s, 6), kind, q))
    group = q[order].astype(np.int64) * 2 + kind[order]
    first = np.searchsorted(group, group)
    order = order[np.arange(len(order)) - first < k]
    return q[order], kind[order], s[order], i[order]


def _ranked(terms: list[str], owner: np.ndarray, term: np.ndarray, weight: np.ndarray, exact: np.ndarray, qids: list, avgdl: float, k: int):
    """Documents against all queries: each batch becomes a matrix of its terms that queries
    have, a block of queries one of their weights; the k best of either kind (with an exact
    term, without) of each query leave the task."""
    wanted = pa.array(terms, pa.string())
    blocks = []
    for lo in range(0, len(qids), QUERY_BLOCK):
        mine = (owner >= lo) & (owner < lo + QUERY_BLOCK)
        names, col = np.unique(term[mine], return_inverse=True)
        blocks.append((lo, min(QUERY_BLOCK, len(qids) - lo), names, col, owner[mine] - lo, weight[mine], exact[mine]))

    def run(batches):
        kept: list[list[tuple]] = [[] for _ in blocks]  # of each block: (query, kind, score, id) arrays of what may be among the k best
        id_kind = pa.int64()
        for batch in batches:
            id_kind = batch.column("id").type
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                hit = pc.index_in(part.column("terms").flatten(), value_set=wanted)
                ok = pc.is_valid(hit).to_numpy(zero_copy_only=False)
                doc = pc.list_parent_indices(part.column("terms")).to_numpy(zero_copy_only=False)[ok]
                which, tf = hit.drop_null().to_numpy(zero_copy_only=False), part.column("tfs").flatten().to_numpy(zero_copy_only=False)[ok]
                dl, ids = part.column("dl").to_numpy(zero_copy_only=False), np.array(part.column("id").to_pylist(), dtype=object)
                share = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[doc] / avgdl))
                for b, (lo, n, names, col, own, w, e) in enumerate(blocks):
                    place = np.searchsorted(names, which)
                    inside = place < len(names)
                    inside[inside] = names[place[inside]] == which[inside]
                    m = np.zeros((len(part), len(names)))
                    m[doc[inside], place[inside]] = share[inside]
                    weights, marks = np.zeros((len(names), n)), np.zeros((len(names), n))
                    weights[col, own], marks[col, own] = w, e
                    score = (m @ weights).T
                    exact_hit = ((m > 0).astype(np.float64) @ marks).T > 0 if e.any() else np.zeros(score.shape, dtype=bool)
                    for kind in (0, 1) if e.any() else (0,):
                        s = np.where((exact_hit == bool(kind)) & (score > 0), score, 0.0)
                        edge = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)]
                        rows, cols = np.nonzero((s > 0) & (np.round(s, 6) >= np.round(edge, 6)[:, None]))
                        kept[b].append((rows + lo, np.full(len(rows), kind), s[rows, cols], ids[cols]))
                    if sum(len(x[0]) for x in kept[b]) > 8 * (n * k + 1000):
                        kept[b] = [_best(kept[b], k)]
        out = [_best(x, k) for x in kept if x]
        if out and sum(len(x[0]) for x in out):
            q, kind, s, i = (np.concatenate([x[c] for x in out]) for c in range(4))
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(i.tolist(), id_kind), pa.array(s, pa.float64()), pa.array(kind == 1, pa.bool_())], ["n", "id", "s", "hit"])

    return run


def search(index: DataFrame, queries: DataFrame, k: int = 5, query_col: str = "query_id", id_col: str = "doc_id", text_col: str = "text", tokens=search_tokens, exact_terms: bool = False, among: Column | None = None, frequencies: DataFrame | None = None, totals: DataFrame | None = None) -> DataFrame:
    """(query, id, score, rank) of the k best positive scores, ties to the smaller id.

    idf = ln(1 + (N - df + .5) / (df + .5)); repeated query terms count again. The queries'
    terms, counted first and sent out QUERY_TERMS at a time, travel to the documents, whose
    task keeps the k best of a query, so k rows for a query and task are shuffled. With
    exact_terms, a document with an exact term of the query (column exact_terms) gains the
    query's highest score. With `among`, only documents where it is true are ranked; the
    corpus statistics are of all documents."""
    asked = queries.select(F.col(query_col).alias("q"), F.explode(tokens(F.col(text_col))).alias("term"), F.lit(0).alias("exact"))
    if exact_terms:
        named = queries.select(F.col(query_col).alias("q"), F.explode("exact_terms").alias("term"))
        asked = asked.union(named.select("q", F.lower("term"), F.lit(1)))
    asked = asked.groupBy("q", "term").agg(F.sum(1 - F.col("exact")).alias("qtf"), F.max("exact").alias("exact"))
    kind, id_kind = queries.schema[query_col].dataType, index.schema["id"].dataType.simpleString()
    rows = index if among is None else index.where(among)
    every, spark = None, index.sparkSession
    first = asked.limit(QUERY_TERMS + 1).collect()
    rounds = 1 if len(first) <= QUERY_TERMS else -(-asked.count() // QUERY_TERMS) + 1
    for r in range(rounds):
        given = first if rounds == 1 else asked.where(F.pmod(F.xxhash64("q"), F.lit(rounds)) == r).collect()
        n, avgdl, df = _statistics(index, {x["term"] for x in given}, frequencies, totals)
        have = [x for x in given if x["term"] in df]
        qids = sorted({x["q"] for x in have})
        if not qids:
            continue
        place, at = {t: i for i, t in enumerate(df)}, {q: i for i, q in enumerate(qids)}
        idf = {t: log(1.0 + (n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
        arrays = (np.array([at[x["q"]] for x in have]), np.array([place[x["term"]] for x in have]), np.array([x["qtf"] * idf[x["term"]] for x in have]), np.array([x["exact"] for x in have], dtype=np.float64))
        found = rows.select("id", "dl", "terms", "tfs").mapInArrow(_ranked(list(df), *arrays, qids, avgdl, k), f"n int, id {id_kind}, s double, hit boolean")
        numbered = spark.createDataFrame(list(enumerate(qids)), StructType([StructField("n", IntegerType()), StructField("q", kind)]))
        found = found.join(F.broadcast(numbered), "n").select("q", "id", "s", "hit")
        every = found if every is None else every.union(found)
    if every is None:
        every = spark.createDataFrame([], f"q {kind.simpleString()}, id {id_kind}, s double, hit boolean")
    top = F.max("s").over(Window.partitionBy("q"))
    score = every.withColumn("score", F.round(F.col("s") + F.when(F.col("hit"), top).otherwise(0.0), 6)) if exact_terms else every.withColumn("score", F.round("s", 6))
    return top_k(score.where("score > 0"), k).select(F.col("q").alias(query_col), F.col("id").alias(id_col), "score", "rank")


def bm25(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", query_col: str = "query_id", k: int = 5, text_col: str = "text", tokens=None, exact_terms: bool = False, among: Column | None = None) -> DataFrame:
    """`search` over an index made for the call and written once; see there."""
    more = {} if among is None else {"among": among}
    made = written(index(docs, id_col, F.col(text_col), tokens, **more), "bm25")
    return search(made, queries, k, query_col, id_col, text_col, tokens or search_tokens, exact_terms, None if among is None else F.col("among"))


def top_k(scores: DataFrame, k: int, q: str = "q", i: str = "id", score: str = "score") -> DataFrame:
    """The k best rows of each query with their rank; the limit is applied below the shuffle."""
    w = Window.partitionBy(q).orderBy(F.desc(score), i)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _dense(ids: np.ndarray, q: np.ndarray, k: int, digits: int, skip_self: bool):
    def run(batches):
        top, name = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), dtype=np.int64)
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                own = part.column("id").to_numpy(zero_copy_only=False)
                v = part.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1)
                norm = np.sqrt((v**2).sum(axis=1))
                norm[norm == 0] = 1.0
                v /= norm[:, None]
                for lo in range(0, len(ids), QUERY_TILE):  # a task holds the scores of a tile, not of all queries
                    mine = slice(lo, lo + QUERY_TILE)
                    s = np.round(q[mine] @ v.T, digits) + 0.0
                    if skip_self:
                        s[ids[mine, None] == own[None, :]] = -np.inf
                    s, i = np.hstack([top[mine], s]), np.hstack([name[mine], np.broadcast_to(own, s.shape)])
                    take = np.lexsort((i, -s), axis=1)[:, :k]  # ties to the smaller id
                    top[mine], name[mine] = np.take_along_axis(s, take, 1), np.take_along_axis(i, take, 1)
        row, col = np.nonzero(top > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(name[row, col]), pa.array(top[row, col])], ["q", "id", "score"])

    return run


def dense(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", digits: int = 6, skip_self: bool = True, among: Column | None = None) -> DataFrame:
    """(query_id, id, score, rank): exact cosine top k of each query vector.

    Vectors that are null, empty or hold null or non-finite components take no part, nor do
    pairs of unequal length. Queries travel to the vectors, never the other way: each task
    keeps the k best of its own rows, so k rows for a query and task are shuffled. Queries
    go out in blocks of QUERY_VECTORS, whose size bounds what a task holds. With `among`,
    only vectors where it is true are ranked."""
    usable = F.expr("vec is not null and size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")

    def given(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(usable).withColumn("dim", F.size("vec"))

    rows, data, out = given(queries), given(vectors if among is None else vectors.where(among)), None
    for dim, n in rows.groupBy("dim").count().collect():  # the lengths that occur
        blocks = -(-n // QUERY_VECTORS)
        for b in range(blocks):
            part = rows.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)).collect()
            ids = np.array([r["id"] for r in part], dtype=np.int64)
            q = np.array([r["vec"] for r in part], dtype=np.float64).reshape(len(part), -1)
            norm = np.sqrt((q**2).sum(axis=1))
            norm[norm == 0] = 1.0
            found = data.where(F.col("dim") == dim).select("id", "vec").mapInArrow(_dense(ids, q / norm[:, None], k, digits, skip_self), "q long, id long, score double")
            out = found if out is None else out.union(found)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], "q long, id long, score double")
    return top_k(out, k).select(F.col("q").alias("query_id"), F.col("id").alias(id_col), "score", "rank")


def dense_variants(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", among: Column | None = None) -> DataFrame:
    """(query_id, id, score, rank) for queries(query_id, vec) of several vectors each: a passage
    counts by its best score over the variants. The k best of a query are among the k best of
    its variants, so nothing else leaves the search. Equal rows of a query count once."""
    kept = written(queries.select("query_id", F.col(vec_col).alias("vec")).distinct().withColumn("n", F.monotonically_increasing_id()), "variants")
    hits = dense(vectors, kept.select(F.col("n").alias(id_col), F.col("vec").alias(vec_col)), k, id_col, vec_col, skip_self=False, among=among)
    best = hits.withColumnRenamed("query_id", "n").join(kept.select("n", "query_id"), "n").groupBy(F.col("query_id").alias("q"), F.col(id_col).alias("id")).agg(F.max("score").alias("score"))
    return top_k(best, k).select(F.col("q").alias("query_id"), F.col("id").alias(id_col), "score", "rank")


def rrf(dense_hits: DataFrame, sparse_hits: DataFrame, sparse_weight: Column | float = 1.0, k: int = RRF_K, keep: int = FUSED, q: str = "query_id", i: str = "doc_id") -> DataFrame:
    """(query, id, dense_rank, sparse_rank, rrf_score, rank) by reciprocal ranks."""
    d = dense_hits.select(q, i, F.col("rank").alias("dense_rank"))
    s = sparse_hits.select(q, i, F.col("rank").alias("sparse_rank"))
    both = d.join(s, [q, i], "full")
    weight = F.lit(sparse_weight) if isinstance(sparse_weight, (int, float)) else sparse_weight
    score = F.coalesce(1.0 / (k + F.col("dense_rank")), F.lit(0.0)) + F.coalesce(weight / (k + F.col("sparse_rank")), F.lit(0.0))
    return top_k(both.withColumn("rrf_score", F.round(score, 8)), keep, q, i, "rrf_score")


# The flags of a leg that fails.
LEG_FLAGS = {"dense": "dense_unavailable", "sparse": "sparse_failed"}


def legs(sources: dict, schema: str) -> tuple[dict[str, DataFrame], list[str]]:
    """(hits of each leg, flags): a leg that fails is empty and flagged; if all fail, the last
    error is raised. A leg's plan is tried by one row, as plans are lazy."""
    out, flags, error, spark = {}, [], None, SparkSession.active()
    for name, make in sources.items():
        try:
            out[name] = make()
            out[name].limit(1).count()
        except Exception as e:  # whatever a store or a plan may raise
            out[name], error = spark.createDataFrame([], schema), e
            flags.append(LEG_FLAGS.get(name, f"{name}_failed"))
    if error is not None and len(flags) == len(sources):
        raise error
    return out, flags


def result_rows(hits: DataFrame, docs: DataFrame, top: int = 8, q: str = "query_id", i: str = "doc_id", score: str = "rrf_score", snippet: int = 200) -> DataFrame:
    """What a caller gets: the first `top` hits with the start of their text on one line."""
    line = F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, snippet)
    best = hits.where(F.col("rank") <= top).select(q, i, "rank", F.round(score, 4).alias("score"))
    return best.join(docs.select(i, line.alias("snippet")), i).select(q, "rank", i, "score", "snippet")


def apply_actions(wanted: DataFrame, stored: DataFrame, key: str = "chunk_id", columns: tuple[str, ...] = ("sha", "version")) -> DataFrame:
    """The store after `reconcile`: upserts from `wanted`, kept points as stored, deletes gone."""
    actions = reconcile(wanted, stored, key, columns)
    put = wanted.join(actions.where("action = 'upsert'").select(key), key, "left_semi")
    return put.unionByName(stored.join(actions.where("action = 'keep'").select(key), key, "left_semi"))


def adjust(fused: DataFrame, soft_active: bool = False, boost_types: Column | None = None, q: str = "query_id", i: str = "doc_id") -> DataFrame:
    """Scores after the marginal penalty, the soft-match bonus or penalty and the favoured
    kinds; needs quality_flags, soft_match and chunk_type. Ranks are counted anew."""
    c = F.col("rrf_score")
    c = c * F.when(F.array_contains("quality_flags", "marginal"), MARGINAL).otherwise(1.0)
    if soft_active:
        c = c * F.when(F.col("soft_match"), SOFT_BONUS).otherwise(1.0)
    c = c * F.when(F.col("soft_match"), 1.0).otherwise(SOFT_PENALTY)
    if boost_types is not None:
        c = c * F.when(F.array_contains(boost_types, F.col("chunk_type")), TYPE_BOOST).otherwise(1.0)
    return top_k(fused.withColumn("rrf_score", F.round(c, 8)).drop("rank"), 1 << 30, q, i, "rrf_score")


def soft_relax(filtered: DataFrame, unfiltered: DataFrame, top: int = 8, q: str = "query_id", i: str = "doc_id") -> DataFrame:
    """Hits of the filtered pass; queries with fewer than `top` of them are filled up from
    the unfiltered pass, whose own hits are marked soft_match = false and follow."""
    n = filtered.groupBy(q).agg(F.count("*").alias("n"))
    thin = unfiltered.join(n, q, "left").where(F.coalesce("n", F.lit(0)) < top).drop("n")
    extra = thin.join(filtered.select(q, i), [q, i], "left_anti").withColumn("soft_match", F.lit(False))
    rows = filtered.withColumn("soft_match", F.lit(True)).unionByName(extra)
    w = Window.partitionBy(q).orderBy(F.desc("soft_match"), "rank", i)
    return rows.withColumn("rank", F.row_number().over(w))


def lexical_score(query_terms: Column, passage_terms: Column) -> Column:
    """0.75 coverage + 0.25 min(1, 10 density), words of five letters or more matching by
    prefix; 4 digits, 0 if either side is empty."""
    near = lambda t, among: F.array_contains(among, t) | ((F.length(t) >= 5) & F.exists(among, lambda w: (F.length(w) >= 5) & (w.startswith(t) | t.startswith(w))))

    def share(terms: Column, matched: Column) -> Column:
        dense_ = F.size(F.filter(passage_terms, lambda w: near(w, matched))) / F.size(passage_terms)
        return 0.75 * F.size(matched) / F.size(terms) + 0.25 * F.least(F.lit(1.0), dense_ * 10)

    bag, terms = F.array_distinct(passage_terms), F.array_distinct(query_terms)
    score = let(bag, lambda b: let(terms, lambda t: let(F.filter(t, lambda x: near(x, b)), lambda m: share(t, m))))
    return F.when((F.size(query_terms) == 0) | (F.size(passage_terms) == 0), 0.0).otherwise(F.round(F.least(F.lit(1.0), score), 4))


def rerank(candidates: DataFrame, top_n: int = 40, q: str = "query_id", i: str = "doc_id") -> DataFrame:
    """Only the first top_n are scored (columns query_terms, passage_terms); the rest follow."""
    pool = F.col("rank") <= top_n
    scored = candidates.withColumn("rerank_score", F.when(pool, lexical_score(F.col("query_terms"), F.col("passage_terms"))))
    w = Window.partitionBy(q).orderBy(F.desc(pool), F.desc_nulls_last("rerank_score"), "rank", i)
    return scored.withColumn("final_rank", F.row_number().over(w))


def confidence_gate(reranked: DataFrame, q: str = "query_id") -> DataFrame:
    """(query, confidence, strong, sufficient, reason) by the best score and the number of
    candidates above the floor."""
    g = reranked.groupBy(q).agg(F.max("rerank_score").alias("confidence"), F.count_if(F.col("rerank_score") >= FLOOR).alias("strong"))
    reason = gate_reason(F.col("confidence"), F.col("strong"))
    return g.withColumn("reason", reason).withColumn("sufficient", F.col("reason").isNull())


def gate_reason(confidence: Column, strong: Column, minimum: Column | float = MIN_CONFIDENCE) -> Column:
    return F.when(confidence.isNull(), "no_candidates").when(confidence < minimum, "low_confidence").when((confidence < STRONG) & (strong < MIN_CANDIDATES), "insufficient_candidates")


def reconcile(wanted: DataFrame, stored: DataFrame, key: str = "chunk_id", columns: tuple[str, ...] = ("sha", "version")) -> DataFrame:
    """(key, action): upsert what is missing or different, delete what is extra, else keep."""
    w = wanted.select(key, F.struct(*columns).alias("w"))
    s = stored.select(key, F.struct(*columns).alias("s"))
    action = F.when(F.col("w").isNull(), "delete").when(F.col("s").isNull() | (F.col("w") != F.col("s")), "upsert").otherwise("keep")
    return w.join(s, key, "full").select(key, action.alias("action"))
