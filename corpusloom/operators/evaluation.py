"""Retrieval metrics, refusal counts, threshold sweeps, latency figures, question sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import ids
from corpusloom.operators.retrieval import gate_reason


def recall_at(got: Column, want: Column, k: int) -> Column:
    top = F.slice(got, 1, k)
    hits = F.size(F.array_intersect(top, want))
    return F.when(F.size(want) == 0, (F.size(top) == 0).cast("double")).otherwise(hits / F.size(want))


def precision_at(got: Column, want: Column, k: int) -> Column:
    top = F.slice(got, 1, k)
    return F.when(F.size(top) == 0, 0.0).otherwise(F.size(F.array_intersect(top, want)) / F.size(top))


def reciprocal_rank(got: Column, want: Column) -> Column:
    at = F.filter(F.transform(got, lambda x, i: F.when(F.array_contains(want, x), i + 1)), lambda i: i.isNotNull())
    return F.coalesce(1.0 / F.get(at, F.lit(0)), F.lit(0.0))


def ndcg_at(got: Column, want: Column, k: int) -> Column:
    gain = lambda i: 1.0 / F.log2(i + 2.0)
    top = F.transform(F.slice(got, 1, k), lambda x, i: F.when(F.array_contains(want, x), gain(i)).otherwise(0.0))
    dcg = F.aggregate(top, F.lit(0.0), lambda a, x: a + x)
    n = F.least(F.size(F.array_distinct(want)), F.lit(k))
    ideal = F.aggregate(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), gain), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(want) == 0, 1.0).otherwise(dcg / ideal)


def score_rows(rows: DataFrame, k: int) -> DataFrame:
    """Adds the metrics to rows of (retrieved, relevant) arrays."""
    g, w = F.col("retrieved"), F.col("relevant")
    return rows.withColumns({f"recall_at_{k}": recall_at(g, w, k), f"precision_at_{k}": precision_at(g, w, k), "mrr": reciprocal_rank(g, w), f"ndcg_at_{k}": ndcg_at(g, w, k)})


def refusal(expected: Column, answered: Column) -> dict[str, Column]:
    """Confusion counts of refusals and their precision and recall (1 where undefined)."""
    tp, fp, fn = F.count_if(~expected & ~answered), F.count_if(expected & ~answered), F.count_if(~expected & answered)
    ratio = lambda a, b: F.when(a + b > 0, a / (a + b)).otherwise(1.0)
    return {"refused_rightly": tp, "refused_wrongly": fp, "answered_rightly": F.count_if(expected & answered), "answered_wrongly": fn, "refusal_precision": ratio(tp, fp), "refusal_recall": ratio(tp, fn)}


def summarise(scored: DataFrame, k: int) -> DataFrame:
    expected, answered = F.size("relevant") > 0, F.size("retrieved") > 0
    means = [F.round(F.coalesce(F.avg(F.when(expected, F.col(c))), F.lit(0.0)), 6).alias(c) for c in (f"recall_at_{k}", f"precision_at_{k}", "mrr", f"ndcg_at_{k}")]
    return scored.agg(F.count("*").alias("n"), F.count_if(expected).alias("n_answerable"), *means, *(c.alias(n) for n, c in refusal(expected, answered).items()))


def run(questions: DataFrame, hits: DataFrame, k: int, thresholds: dict[str, float], q: str = "query_id", i: str = "doc_id", relevant: str = "relevant") -> DataFrame:
    """(metric, value, threshold, passed) of an evaluation: the hits of each question in their
    order against its relevant ids. A question without hits counts as refused; a metric below
    its threshold fails the run."""
    got = hits.where(F.col("rank") <= k).groupBy(q).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(i).alias("i")))).alias("h"))
    rows = questions.join(got, q, "left").select(q, F.coalesce(F.transform("h", lambda h: h["i"]), F.array().cast(questions.schema[relevant].dataType)).alias("retrieved"), F.col(relevant).alias("relevant"))
    total = summarise(score_rows(rows, k), k)
    names = [c for c in total.columns if c not in ("n", "n_answerable")]
    each = total.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.round(F.col(c).cast("double"), 6).alias("value"), F.lit(thresholds.get(c)).cast("double").alias("threshold")) for c in names))).alias("m")).select("m.*")
    return each.withColumn("passed", F.col("threshold").isNull() | (F.col("value") >= F.col("threshold")))


#: Thresholds tried by the sweep.
GRID = [round(0.05 * i, 2) for i in range(1, 19)]


def sweep(rows: DataFrame, grid: list[float] | None = None) -> DataFrame:
    """Refusal figures at each threshold, rows of (confidence, strong, answerable). The grid
    is exploded on the rows (a handful of constants), so there is no join."""
    each = rows.withColumn("threshold", F.explode(F.array(*map(F.lit, grid or GRID))))
    each = each.withColumn("sufficient", gate_reason(F.col("confidence"), F.col("strong"), F.col("threshold")).isNull())
    rate = F.coalesce(F.avg(F.when(F.col("answerable"), F.col("sufficient").cast("double"))), F.lit(0.0))
    r = refusal(F.col("answerable"), F.col("sufficient"))
    return each.groupBy("threshold").agg(F.round(r["refusal_precision"], 6).alias("refusal_precision"), F.round(r["refusal_recall"], 6).alias("refusal_recall"), F.round(rate, 6).alias("sufficient_rate"))


def recommend(points: DataFrame, least: float = 0.8) -> DataFrame:
    return points.where(F.col("sufficient_rate") >= least).agg(F.max("threshold").alias("threshold"))


def latency(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Exact interpolated percentiles, mean and range of each group."""
    p = lambda q: F.round(F.percentile(F.col(value), q), 6)
    return rows.groupBy(by).agg(F.count("*").alias("n"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))


# The question templates.
TEMPLATES = ("What does the documentation say about {}?", "How is {} described?", "Explain {}.")


def sample_by_seed(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows in the order of a seeded digest: a stable draw that needs no shuffle of the rest."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def question_set(units: DataFrame, n: int, seed: str, version: str) -> DataFrame:
    """Questions from the last breadcrumb part that isn't the title, the first sentence as the
    reference answer."""
    part = F.element_at(F.filter(F.split("heading_breadcrumb", " › "), lambda p: F.lower(p) != F.lower(F.coalesce("title", F.lit("")))), -1)
    topic = F.coalesce(part, F.col("title"))
    pick = F.conv(F.substring(F.md5("chunk_id"), 1, 4), 16, 10).cast("int") % len(TEMPLATES)
    forms = F.array(*(F.regexp_replace(F.lit(t), r"\{\}", "\u0001") for t in TEMPLATES))
    question = F.replace(F.get(forms, pick), F.lit("\u0001"), topic)
    first = F.regexp_extract("text", r"^\s*(.*?[.!?])(?:\s|$)", 1)
    return sample_by_seed(units, "chunk_id", n, seed).select(
        ids.uuid5(ids.NS_QA, F.concat_ws(":", F.lit(version), "chunk_id")).alias("qa_id"), F.lit(version).alias("version"), question.alias("question"),
        F.when(first != "", first).otherwise(F.col("text")).alias("reference_answer"), F.array("chunk_id").alias("expected_chunk_ids"), "document_id",
    )
