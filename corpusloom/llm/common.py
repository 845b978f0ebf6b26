"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x = x ^ (x >> _S33)
    x = x * _M2
    return x ^ (x >> _S33)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where the
    cluster names one, else (tests, one machine) a temporary folder of our own. Executors
    of a cluster can't see such a folder, so there the setting is asked for."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^,]*(,\d+)?\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpusloom-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def _clean() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone at exit; the folder is scratch space
            return


atexit.register(_clean)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of `df` by a Parquet table in the shared folder.

    A lost executor then costs a re-read, not a recomputation, and the reader
    knows the real size of the table. The table goes when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch of texts. Each running task has one whole, in the JVM and in its worker.
BATCH_BYTES = 4 << 20


@contextlib.contextmanager
def text_batches(spark: SparkSession):
    """For the time of a write: batches of texts go to Python by bytes, not by 10,000 rows. A
    longer text is a batch of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(name, None)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


#: Rows of 8-byte keys up to which a key set is broadcast: at most about 10 MB.
BROADCAST_KEYS = 250_000


def broadcast_if_small(keys: DataFrame, rows: int, limit: int = BROADCAST_KEYS) -> DataFrame:
    """Broadcast behind a check of the counted rows; else Spark shuffles."""
    return F.broadcast(keys) if rows <= limit else keys


#: Rows of one key from which they are joined by a broadcast of that key's row.
HEAVY = 1000


def join_split(rows: DataFrame, keyed: DataFrame, on: list[str], count: str, how: str = "inner") -> DataFrame:
    """`rows` joined to `keyed`, which has each key once and in `count` the rows of the key.

    Keys of more than HEAVY rows, of which there are few, are broadcast behind a check of
    their number, so that no task has to hold one; the others meet by a shuffle. Both
    tables are read more than once and should be written ones."""
    heavy = keyed.where(F.col(count) > HEAVY)
    n = heavy.count()
    if not n or n > BROADCAST_KEYS:
        return rows.join(keyed.drop(count), on, how)
    light = keyed.where(F.col(count) <= HEAVY).drop(count)
    rest = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(light, on, how)
    found = rows.join(F.broadcast(heavy.drop(count)), on)
    return found.union(rest.select(*found.columns))


_holder = None


def hold_cache(owner) -> None:
    """Called in a Python worker by who fills a cache of its own (None: nobody). Workers serve
    later stages too, so the last holder's cache is emptied first: one at a time is in memory."""
    global _holder
    if _holder is not owner:
        if _holder is not None:
            _holder.empty_cache()
        _holder = owner
    release()


def release() -> None:
    """Give what this worker has freed back to the system, so that it does not add up over
    the stages that one worker serves."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library: it keeps what it keeps
        return


class UnionFind:
    """Disjoint sets over arbitrary integers, smallest member as the root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up, root = self.up, x
        while (p := up.get(root, root)) != root:
            root = p
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        self.up.setdefault(a, a)
        return True


def _contract(batches):
    """Union-find over the links of one partition: a star for each local group."""
    import pyarrow as pa

    sets, n = UnionFind(), 0

    def stars():
        nodes = [(x, sets.find(x)) for x in list(sets.up)]
        nodes = [(x, r) for x, r in nodes if x != r]
        return pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in nodes], pa.int64()), pa.array([r for _, r in nodes], pa.int64())], ["u", "v"]
        )

    for batch in batches:
        for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            n += sets.union(a, b)
            if n >= 500_000:  # bounded memory: hand over the stars made so far and start anew
                yield stars()
                sets, n = UnionFind(), 0
    if sets.up:
        yield stars()


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the graph with links (u, v): one row (node, component_id) for
    each node that has a link, component_id being its smallest reachable node.

    Union-find runs inside each partition first; alternating large-star and
    small-star steps then join the local groups until nothing changes. Every
    step is a shuffle on a node with map-side minima; nodes of many links are
    broadcast instead, and nothing is collected.
    """
    e = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
    e = materialize(e.mapInArrow(_contract, "u long, v long"), "links")

    def lowest(rows: DataFrame) -> DataFrame:
        return materialize(rows.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "lowest")

    seen = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = join_split(both, lowest(both), ["u"], "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large")
        small = join_split(large, lowest(large), ["u"], "n").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        e = materialize(small, "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
    stars = e.groupBy("u").agg(F.min("v").alias("c"))
    return stars.select(F.col("u").alias("node"), F.col("c").alias("component_id")).union(stars.select("c", "c").distinct())
