"""Lineage: which datasets came from which, by the edges that runs leave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import checkpointed

EDGE = "run_id string, task_id string, input string, input_partition string, output string, output_partition string, rows_in long, rows_out long, created_at timestamp"


def reachable(edges: DataFrame, roots: DataFrame, direction: str = "down", max_depth: int = 64) -> DataFrame:
    """(root, node, distance) of what `roots`(root) lead to (down: outputs, up: inputs), over
    edges(input, output). A node comes once, with its least distance; cycles end by an anti join
    with what was reached. Each round joins only the nodes that the round before has added.
    A root isn't reached from itself unless a cycle leads back to it."""
    a, b = ("input", "output") if direction == "down" else ("output", "input")
    step = checkpointed(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("node"), F.col(b).alias("to")).distinct())
    new = roots.select("root").where("root is not null").distinct().select("root", F.col("root").alias("node"), F.lit(0).alias("distance"))
    found = None
    for depth in range(1, max_depth + 1):
        seen = new.join(step, "node").select("root", F.col("to").alias("node")).distinct()
        if found is not None:
            seen = seen.join(found.select("root", "node"), ["root", "node"], "left_anti")
        new = checkpointed(seen.withColumn("distance", F.lit(depth)))
        if new.isEmpty():
            break
        found = new if found is None else found.union(new)
    return new if found is None else found


def for_run(edges: DataFrame, run_id: str) -> DataFrame:
    """The edges of a run in order."""
    return edges.where(F.col("run_id") == run_id).orderBy("created_at", "output")


def latest_for(edges: DataFrame, output: str, limit: int = 50) -> DataFrame:
    """The newest edges that lead to a dataset."""
    return edges.where(F.col("output") == output).orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit)


def trace(documents: DataFrame, versions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each document with its versions in order, and its current chunks by chunker and by state of embedding."""
    v = versions.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("fetched_at", "document_version_id", "content_sha256"))).alias("versions"))
    live = chunks.where("is_current")
    states = live.groupBy("document_id", "embedding_status").agg(F.count("*").alias("n")).groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("embedding_status", "n")))).alias("embedding"))
    c = live.groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.sort_array(F.collect_set("chunker_version")).alias("chunkers"))
    out = documents.join(v, "document_id", "left").join(c, "document_id", "left").join(states, "document_id", "left")
    return out.withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
