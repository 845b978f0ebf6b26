"""Exact and near duplicates by SimHash, and the duplicate ledger."""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import combinations, islice, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.batches import bounds
from corpusloom.functions.text import words
from corpusloom.session import checkpointed, spread

#: Bits in which fingerprints of near duplicates may differ.
DISTANCE = 3
#: A later document takes an earlier one's place if its quality is better by this much.
MARGIN = 0.1


def exact_duplicates(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, canonical id (the smallest with the same content) of each row."""
    keyed = df.select(F.col(id_col), F.sha2(F.col(text_col), 256).alias("sha"))
    first = keyed.groupBy("sha").agg(F.min(id_col).alias("canonical_id"), F.count("*").alias("copies"))
    return keyed.join(first, "sha").select(id_col, "canonical_id", "copies")


def _vote(digests: list[bytes], signed: bool = True) -> int:
    """The bits that more than half of the 64-bit hashes have."""
    if not digests:
        return 0
    bits = np.unpackbits(np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(digests)).tobytes(), "big", signed=signed)


def _grams(words: list[str], n: int) -> list[str]:
    return [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)]


def simhash(df: DataFrame, id_col: str, text_col: str, n: int = 4) -> DataFrame:
    """(id, simhash): each occurrence of a shingle votes with the bits of its hash, the first
    64 of MD5. A document is counted where it lies; nothing is shuffled."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda w: _vote([hashlib.md5(g.encode()).digest()[:8] for g in _grams(list(w), n) if g]) if w is not None else 0)

    return spread(df.select(id_col, text_col)).select(id_col, F.coalesce(run(words(F.col(text_col))), F.lit(0).cast("long")).alias("simhash"))


_TOKEN = re.compile(r"\w+")


#: Words of a text whose shingles are hashed at once.
WORDS_AT_ONCE = 10_000


def simhash_blake2b(text: Column) -> Column:
    """The same vote over 64-bit BLAKE2b hashes, with signed 64-bit results. A task holds the
    texts of a slice of its batch and the hashes of WORDS_AT_ONCE words."""

    def one(text: str | None, n: int = 4) -> int:
        text = text or ""
        found = (m.group().lower() for m in _TOKEN.finditer(text)) if len(text) > 8 * WORDS_AT_ONCE else iter([w.lower() for w in _TOKEN.findall(text)])
        votes, total, last = np.zeros(64, dtype=np.int64), 0, list(islice(found, n - 1))
        if len(last) < n - 1 or not (part := list(islice(found, WORDS_AT_ONCE))):
            return _vote([hashlib.blake2b(" ".join(last).encode(), digest_size=8).digest()] if last else [])
        while part:
            grams = _grams(last + part, n)
            digests = b"".join([hashlib.blake2b(g.encode(), digest_size=8).digest() for g in grams])
            votes += np.unpackbits(np.frombuffer(digests, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            total += len(grams)
            last, part = (last + part)[1 - n :], list(islice(found, WORDS_AT_ONCE))
        return int.from_bytes(np.packbits(2 * votes > total).tobytes(), "big", signed=True)

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([one(t) for at, n in bounds([texts]) for t in texts.slice(at, n).to_pylist()], pa.int64())

    return run(text)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _masks(distance: int) -> list[int]:
    """The bits of every choice of three of distance + 3 blocks, as signed longs."""
    edges = [round(64 * i / (distance + 3)) for i in range(distance + 4)]
    masks = [sum(((1 << b) - 1) ^ ((1 << a) - 1) for a, b in chosen) for chosen in combinations(list(pairwise(edges)), 3)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def block_keys(rows: DataFrame, fp_col: str, distance: int = DISTANCE) -> DataFrame:
    """The rows, once for each choice of three blocks: its number i and the fingerprint's bits v there."""
    return rows.select("*", F.posexplode(F.array(*(F.col(fp_col).bitwiseAND(F.lit(m).cast("long")) for m in _masks(distance)))).alias("i", "v"))


def near_pairs(fingerprints: DataFrame, id_col: str, fp_col: str = "simhash", distance: int = DISTANCE) -> DataFrame:
    """(fp_a, fp_b, hamming) of distinct fingerprints that differ in 1 to `distance` bits.

    Cut into distance + 3 blocks, fingerprints that near agree in three of them, so an equi
    join on every choice of three blocks (20 of about 32 bits for a distance of 3) finds them
    all; with a third of the bits, four bands would put 15,000 of 1e9 into each bucket.
    Copies share a fingerprint and are not expanded into pairs; fingerprint 0 (no words)
    links with nothing. A pair comes from the first choice in which it agrees, so none is
    found twice."""
    fps = checkpointed(fingerprints.where(F.col(fp_col) != 0).select(F.col(fp_col).alias("fp")).distinct())
    cut = block_keys(fps, "fp", distance)
    a, b = cut.select(F.col("fp").alias("fp_a"), "i", "v"), cut.select(F.col("fp").alias("fp_b"), "i", "v")
    apart = F.col("fp_a").bitwiseXOR(F.col("fp_b"))
    first = F
    for i, m in enumerate(_masks(distance)):
        first = first.when(apart.bitwiseAND(F.lit(m).cast("long")) == 0, i)
    # The table of fingerprints is small as a file, but its rows come here twenty times: it must not be broadcast.
    pairs = a.join(b.hint("merge"), ["i", "v"]).where((F.col("fp_a") < F.col("fp_b")) & (hamming(F.col("fp_a"), F.col("fp_b")) <= distance) & (F.col("i") == first))
    return pairs.select("fp_a", "fp_b", hamming(F.col("fp_a"), F.col("fp_b")).alias("hamming"))


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest reachable node. A round takes the smallest label among the
    neighbours and then the label of that label, so a chain of n nodes needs about log n rounds
    instead of n. Each round is written, so what follows doesn't work it out again."""
    both = checkpointed(pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).union(pairs.select(F.col(b), F.col(a))).distinct())
    labels = checkpointed(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("l")))
    while True:
        near = both.join(labels.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("l").alias("m"))
        step = checkpointed(near.join(labels, "x").select("x", F.col("l").alias("was"), F.least("m", "l").alias("l")))
        jump = step.select(F.col("x").alias("l"), F.col("l").alias("further"))
        new = checkpointed(step.join(jump, "l").select("x", F.least("l", "further").alias("l"), (F.least("l", "further") < F.col("was")).alias("moved")))
        if new.where("moved").isEmpty():
            return new.select(F.col("x").alias("node"), F.col("l").alias("component"))
        labels = new.select("x", "l")


def _neighbours(fps: np.ndarray, distance: int, block: int = 2048) -> list[np.ndarray]:
    """For each of some distinct fingerprints, which are within `distance` bits, itself included."""
    out = []
    for at in range(0, len(fps), block):
        near = np.bitwise_count(fps[at : at + block, None] ^ fps[None, :]) <= distance
        out += [np.flatnonzero(row) for row in near]
    return out


def decide(ids: np.ndarray, fps: np.ndarray, quality: np.ndarray, distance: int = DISTANCE, margin: float = MARGIN, pool: int = 0) -> pd.DataFrame:
    """(duplicate_id, canonical_id, hamming_distance, fingerprint) of documents in order.

    A document is compared with those that stand so far: the one that came first within
    `distance` bits is canonical, unless the newcomer is better by the margin and takes its
    place. The first `pool` documents stand already. Copies share a fingerprint, whose
    neighbours are looked up once; of those that stand with a fingerprint only the first counts,
    so the work is documents times neighbouring fingerprints."""
    distinct, which = np.unique(fps, return_inverse=True)
    near = _neighbours(distinct, distance)
    standing: list[list[int]] = [[] for _ in distinct]  # heaps of positions
    beaten, winner = [], []
    for n in range(len(ids)):
        f = which[n]
        if not fps[n]:  # no words: near nothing
            continue
        rival = None
        if n >= pool:
            firsts = [standing[g][0] for g in near[f] if standing[g] and distinct[g]]
            if any(ids[x] == ids[n] for x in firsts):  # a repeated row of one document is no rival
                firsts = [x for g in near[f] if distinct[g] for x in standing[g] if ids[x] != ids[n]]
            rival = min(firsts, default=None)
        wins = rival is None or quality[n] >= quality[rival] + margin
        if rival is not None:
            beaten.append(rival if wins else n)
            winner.append(n if wins else rival)
        if wins:
            heapq.heappush(standing[f], n)
            if rival is not None:
                heap = standing[which[rival]]
                heap.remove(rival)
                heapq.heapify(heap)
    gone, stays = np.array(beaten, dtype=np.int64), np.array(winner, dtype=np.int64)
    return pd.DataFrame({"duplicate_id": ids[gone], "canonical_id": ids[stays], "hamming_distance": np.bitwise_count(fps[gone] ^ fps[stays]).astype(np.int32), "fingerprint": fps[gone].view(np.int64)})


def dedup_ledger(docs: DataFrame, id_col: str = "doc_id", fp_col: str = "simhash", quality_col: str = "quality", distance: int = DISTANCE) -> DataFrame:
    """(duplicate_id, canonical_id, hamming_distance, fingerprint).

    Documents of linked fingerprints are decided together in id order; the pool holds one
    number pair for each document that stands, never a text."""
    live = docs.where(F.col(fp_col) != 0).select(F.col(id_col).alias("id"), F.col(fp_col).alias("fp"), F.col(quality_col).cast("double").alias("q"))
    return _decided(live.withColumn("new", F.lit(True)), distance)


def _decided(rows: DataFrame, distance: int, margin: float = MARGIN) -> DataFrame:
    """The ledger of rows(id, fp, q, new); those that aren't new stand already."""
    links = near_pairs(rows, "id", "fp", distance)
    groups = components(links, "fp_a", "fp_b").select(F.col("node").alias("fp"), "component")
    grouped = rows.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    many = grouped.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["new", "id"])
        return decide(group["id"].to_numpy(), group["fp"].to_numpy(np.int64).view(np.uint64), group["q"].to_numpy(), distance, margin, int((~group["new"]).sum()))

    return grouped.join(many, "component", "left_semi").groupBy("component").applyInPandas(run, "duplicate_id long, canonical_id long, hamming_distance int, fingerprint long")


class FingerprintIndex:
    """The ledger's pool kept over runs: a table of block keys in buckets on disk.

    A batch meets the pool by its own keys: the batch is shuffled to the buckets, the pool is read
    where it lies. What has been beaten since is in a table in buckets by document. Batches
    that come in the order of their ids give the ledger of one run over all of them. Both are
    appended after the ledger's rows are known; `run_id` makes a repeated batch return its rows anew."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = 64, distance: int = DISTANCE, margin: float = MARGIN) -> None:
        self.spark, self.name, self.buckets, self.distance, self.margin = spark, name, buckets, distance, margin

    def _append(self, df: DataFrame, table: str, *keys: str) -> None:
        df.write.bucketBy(self.buckets, *keys).sortBy(*keys).mode("append").format("parquet").saveAsTable(f"{self.name}_{table}")

    def _read(self, table: str, schema: str, run_id: str) -> DataFrame:
        whole = f"{self.name}_{table}"
        rows = self.spark.table(whole) if self.spark.catalog.tableExists(whole) else self.spark.createDataFrame([], schema)
        return rows.where(F.col("run") != run_id)  # what the run itself left when it died

    def candidates(self, live: DataFrame, run_id: str) -> DataFrame:
        """(id, fp, q) of documents of the pool within reach of live(id, fp, q)."""
        pool = self._read("pool", "id long, fp long, q double, i int, v long, run string", run_id).select("id", "fp", "q", "i", "v")
        keys = block_keys(live.select("fp").distinct(), "fp", self.distance).withColumnRenamed("fp", "new")
        near = pool.join(keys, ["i", "v"]).where(hamming(F.col("fp"), F.col("new")) <= self.distance).select("id", "fp", "q").distinct()
        gone = self._read("beaten", "id long, run string", run_id).select("id")
        return near.join(gone, "id", "left_anti")

    def add(self, docs: DataFrame, run_id: str, id_col: str = "doc_id", fp_col: str = "simhash", quality_col: str = "quality") -> DataFrame:
        """The ledger's rows of a batch, which then belongs to the pool."""
        live = checkpointed(docs.where(F.col(fp_col) != 0).select(F.col(id_col).cast("long").alias("id"), F.col(fp_col).alias("fp"), F.col(quality_col).cast("double").alias("q")))
        pool = checkpointed(self.candidates(live, run_id))
        ledger = checkpointed(_decided(live.withColumn("new", F.lit(True)).union(pool.withColumn("new", F.lit(False))), self.distance, self.margin))
        self._append(block_keys(live, "fp", self.distance).withColumn("run", F.lit(run_id)), "pool", "i", "v")
        self._append(ledger.select(F.col("duplicate_id").alias("id")).distinct().withColumn("run", F.lit(run_id)), "beaten", "id")
        return ledger
