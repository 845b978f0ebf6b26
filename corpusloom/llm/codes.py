"""Vector code compression: product codes by delta-maintained Lloyd rounds.

Components become integers (floor of 256 times the value), a vector is cut into equal
consecutive parts, and every part position has a codebook. A round assigns each part to the
nearest entry and writes the assignments beside the ones before; only parts whose assignment
changed send a minus to the old entry and a plus to the new one. These are summed in each task
first, so a round shuffles at most tasks x parts x entries rows, and far fewer when few parts
moved. The running integer sums and counts, parts x entries x width numbers whatever the rows,
are kept by the driver and turned into the next codebooks there.

All sums are integers, so the result doesn't depend on how rows are dealt. Rows whose vector is
null, or holds a null or non-finite component, go, as the contract says. So do vectors whose
length isn't the one of the smallest kept id, or isn't a multiple of `parts`, and those with an
integer beyond 2**26, which 64-bit squared distances can't hold. With fewer than `entries`
vectors a codebook has as many entries as there are vectors. Repeated ids are rows of their own
(equal ids start the codebooks in the order of their components); a null id comes last. Null
labels count as one label. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import broadcast_if_small, materialize

#: Integers up to which squared distances are exact in 64 bits.
LARGEST = 2**26


def to_integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, exact; null for a vector that can't be coded."""
    x = vector.cast("array<double>")
    fits = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= LARGEST / scale))
    return F.when(fits, F.transform(x, lambda v: F.floor(v * scale)))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) for each row of `x`, ties to the lower index."""
    exact = np.abs(x).max(initial=0) < 2**22 and np.abs(book).max(initial=0) < 2**22
    a, b = (x.astype(float), book.astype(float)) if exact and x.shape[1] <= 64 else (x, book)  # doubles hold such integers
    d = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
    best = d.argmin(1)
    return best.astype(np.uint8 if len(book) <= 256 else np.uint16), d[np.arange(len(x)), best].astype(np.int64)


def _blocks(batches, rows: int = 20_000):
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim).astype(np.int64)


def _codes(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, parts)


def _assign(books: np.ndarray, last: bool):
    """Parts to their nearest entries. `new` becomes `old`; the last time the distances are kept."""
    parts, _, width = books.shape

    def run(batches):
        for batch in _blocks(batches):
            x = _matrix(batch.column("q"), parts * width)
            found = [nearest(x[:, p * width : (p + 1) * width], books[p]) for p in range(parts)]
            new = pa.array([r.tobytes() for r in np.stack([f[0] for f in found], 1).astype(np.uint16)], pa.binary())
            if last:
                code = pa.array(["".join(f"{i:02x}" for i in r) for r in np.stack([f[0] for f in found], 1).tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), code, pa.array(sum(f[1] for f in found), pa.int64())], ["vec_id", "label", "code", "error"])
            else:
                old = batch.column("new") if "new" in batch.schema.names else pa.nulls(len(batch), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("q"), old, new], ["vec_id", "label", "q", "old", "new"])

    return run


def _deltas(parts: int, entries: int, width: int):
    """What a task's parts take from their old entries and give to the new ones, summed."""

    def run(batches):
        moved = np.zeros((parts, entries, width + 1), np.int64)
        for batch in _blocks(batches):
            x, new = _matrix(batch.column("q"), parts * width), _codes(batch.column("new"), parts)
            first = batch.column("old").null_count > 0  # of the first round: nothing to take back
            old = None if first else _codes(batch.column("old"), parts)
            for p in range(parts):
                here = np.arange(len(new)) if first else np.flatnonzero(new[:, p] != old[:, p])
                of = np.column_stack([x[here, p * width : (p + 1) * width], np.ones(len(here), np.int64)])
                np.add.at(moved[p], new[here, p], of)
                if not first:
                    np.subtract.at(moved[p], old[here, p], of)
        p, e = np.nonzero(moved.any(2))
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(list(moved[p, e]), pa.list_(pa.int64()))], ["part", "entry", "delta"])

    return run


def encode_vectors(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each vector that can be coded."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), to_integers(F.col(vector_col), scale).alias("q")).where("q is not null")
    start = [r["q"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).collect()]  # `entries` vectors
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    empty = spark.createDataFrame([], f"vec_id {kinds['vec_id']}, code string, error long, label_error long, codebooks_sha256 string")
    if not start or not start[0] or len(start[0]) % parts:
        return empty
    dim = len(start[0])
    rows, start = rows.where(F.size("q") == dim), [q for q in start if len(q) == dim]
    width = dim // parts
    books = np.array(start, np.int64).reshape(-1, parts, width).transpose(1, 0, 2)
    n = books.shape[1]
    sums = np.zeros((parts, n, width + 1), np.int64)
    kept = f"vec_id {kinds['vec_id']}, label {kinds['label']}, q array<long>, old binary, new binary"
    for _ in range(rounds):
        rows = materialize(rows.mapInArrow(_assign(books, False), kept), "codes")
        moved = rows.mapInArrow(_deltas(parts, n, width), "part int, entry int, delta array<long>")
        summed = moved.groupBy("part", "entry").agg(F.array(*(F.sum(F.col("delta")[i]) for i in range(width + 1))).alias("delta"))
        for r in summed.collect():  # at most parts x entries rows
            sums[r["part"], r["entry"]] += np.array(r["delta"], np.int64)
        used = sums[:, :, width:] > 0
        books = np.where(used, sums[:, :, :width] // np.maximum(sums[:, :, width:], 1), books)
    coded = materialize(rows.mapInArrow(_assign(books, True), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), "coded")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    labels = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    return with_label_error(coded, materialize(labels, "labels")).withColumn("codebooks_sha256", F.lit(digest)).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def with_label_error(coded: DataFrame, labels: DataFrame) -> DataFrame:
    """Each vector beside the sum of its label. The sums are broadcast up to a counted bound;
    with more labels than that, only those of many vectors are, and the others meet by a shuffle."""
    right = labels.select(F.col("label").alias("_label"), "label_error", "n")
    same = F.col("label").eqNullSafe(F.col("_label"))
    total = right.count()
    if broadcast_if_small(right, total) is not right:
        return coded.join(F.broadcast(right), same)
    often = right.orderBy(F.desc("n")).limit(1000)
    with_often = coded.join(F.broadcast(often), same, "left")
    first = with_often.where("n is not null")
    rest = with_often.where("n is null").drop("_label", "label_error", "n").join(right, same)
    return first.select(*coded.columns, "label_error").union(rest.select(*coded.columns, "label_error"))


def _round(k: int, old: str) -> str:
    """SQL of one round: the nearest entries of book `old`, then book `k`."""
    return f"""
n{k} AS (SELECT vec_id, p, x, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
  SELECT q.vec_id, q.p, q.x, b.e, list_sum(list_transform(list_zip(q.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint AS d FROM parts q JOIN {old} b USING (p)
) GROUP BY ALL),
b{k} AS (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM {old} b LEFT JOIN (
    SELECT p, e, list(s ORDER BY i) AS c FROM (
      SELECT p, e, i, floor(sum(x[i])::double / count(*))::bigint AS s FROM n{k}, (SELECT unnest(range(1, 5)) AS i) GROUP BY p, e, i
    ) GROUP BY p, e
  ) m USING (p, e)
)"""


#: DuckDB, for vectors of 64 components and ids without repeats.
SQL = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, p, v[4 * p + 1 : 4 * p + 4] AS x FROM kept, (SELECT unnest(range(16)) AS p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
{_round(1, "b0")}, {_round(2, "b1")}, {_round(3, "b2")},
r AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::bigint AS error FROM n3 GROUP BY vec_id),
l AS (SELECT label, sum(error)::bigint AS label_error FROM r JOIN kept USING (vec_id) GROUP BY label)
SELECT r.vec_id, r.code, r.error, l.label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256
FROM r JOIN kept USING (vec_id) JOIN l ON l.label IS NOT DISTINCT FROM kept.label
"""
