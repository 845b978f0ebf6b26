"""Valid-time enrichment of sales: a streaming as-of join against versioned clients.

One transformWithState stage, keyed by a hash of the client. It holds a sale until the horizon
H of the batch has passed its time and keeps every client's unpruned versions: it takes up the
batch's versions, answers the released sales and prunes. Waiting sales and versions are one
Arrow table each a key and are worked on by whole columns, so the cost follows the rows, not
the number of clients. One stage and not two: each start opens a store a partition and stage,
and Spark never frees part of a closed store's memory.

A key is one of `keys` hash ranges, whose number follows the counted rows. The sales of a client with more than 1/SHARES of all are dealt over several keys, in proportion;
this client's versions go to each of these keys. At most SHARES clients can be so frequent, so
their list is broadcast. The versions of one client stay together.

Nulls: a sale without a time is released in its batch and has no version; one without a client
has none either, and 0 held. A sale without an arrival belongs to the last batch. Changes
without valid_at are ignored; without a client they are at most late. Of null seq or change_id
the order is first. Repeated sales are answered each; repeated changes (in all nine columns)
count once. A NaN balance counts as null. Empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

import contextlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from corpusloom.llm.common import _written, shared_dir

#: A client with more than one SHARES-th of the sales is dealt over several keys.
SHARES = 64
#: Rows of all batches that a key is meant for, and the least number of keys.
ROWS_A_KEY, KEYS = 40_000, 96
#: Sales that are answered together.
STEP = 20_000
#: MB of cached blocks and write buffers of all stores of an executor: a start reads and writes each state once.
STORES_MB = 64
#: Stand for null and for the ends of time in long columns: pandas has no long with nulls.
NONE, END = -(2**63), 2**63 - 1

_CHANGE = ["change_id", "client_id", "seq", "op", "valid_at", "source", "segment", "city", "balance"]
_SALES = "key int, id long, client long, at long, h long, h_before long, batch int"
_CHANGES = "key int, id long, client long, at long, seq long, cents long, op string, copy int, late_before long, h long, h_before long, batch int"
_OUT = "rec string, id long, batch int, n_held long, change_id long, balance_cents long, op string"


def _micros(at: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), at.cast("timestamp_ntz"))


def _known(c: Column) -> Column:
    return F.coalesce(c.cast("long"), F.lit(NONE))


def _batch(day: Column, batches: int, first_day: int, days: int) -> Column:
    n = F.floor((day - first_day) * batches / F.lit(days))
    return F.coalesce(F.greatest(F.least(n, F.lit(batches - 1)), F.lit(0)), F.lit(batches - 1)).cast("int")


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _load(state) -> pa.Table | None:
    return pa.ipc.open_stream(state.get()[0]).read_all() if state.exists() else None


def prune(client: np.ndarray, at: np.ndarray, h: int) -> np.ndarray:
    """Which rows stay, the rows being sorted by client and version: those after `h`, and of
    those up to `h` each client's last."""
    if not len(client):
        return np.zeros(0, bool)
    after = at > h
    last = np.append((client[1:] != client[:-1]) | after[1:], True)
    return after | last


def answer(client: np.ndarray, at: np.ndarray, who: np.ndarray, when: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of the version or -1, number of versions) for each of `who` at `when`, the versions
    being sorted by client, time and rank: the client's last version not after the time."""
    lo, hi = np.searchsorted(client, who, "left"), np.searchsorted(client, who, "right")
    n = len(client)
    sale = np.repeat([0, 1], [n, len(who)])
    order = np.lexsort((sale, np.concatenate([at, when]), np.concatenate([client, who])))
    seen = np.maximum.accumulate(np.where(order < n, order, -1)) if len(order) else order
    row = np.empty(len(who), np.int64)
    mine = order >= n
    row[order[mine] - n] = seen[mine]
    return np.where((row >= lo) & (row < hi) & (when != NONE), row, -1), hi - lo


class Enrich(StatefulProcessor):
    """A key's waiting sales and its clients' unpruned versions. A batch's tick brings H to every
    key, also to one without rows; with that of the last batch what still waits goes behind it,
    as one batch more. Pruning by a batch's H is done when the key is met next: nothing is
    added between, so the outcome is the same."""

    _WAITS = ("id", "client", "at")
    _KEPT = ("client", "at", "seq", "id", "cents", "op")

    def __init__(self, batches: int) -> None:
        self.batches = batches

    def init(self, handle) -> None:
        self.waiting = handle.getValueState("waiting", "rows binary")
        self.versions = handle.getValueState("versions", "rows binary")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        sales, changes, late = [], [], []
        for f in rows:
            h, before, batch = (int(f[c].iloc[0]) for c in ("h", "h_before", "batch"))  # a start reads one batch
            change, at = f["rec"].to_numpy() == "change", f["at"].to_numpy("int64")
            gone = change & (at < f["late_before"].to_numpy("int64"))
            late.append(f.loc[gone & (f["copy"].to_numpy() == 0), ["id", "batch"]])
            changes.append(f.loc[change & ~gone & (f["client"].to_numpy() != NONE), list(self._KEPT)])
            sales.append(f.loc[~change & (at != END), list(self._WAITS)])  # without the tick
        for f in late:
            if len(f):
                yield self._rows("late", f, NONE, NONE, NONE, None)
        now = self._versions_now(pd.concat(changes, ignore_index=True), before)
        go, rest = self._released(pd.concat(sales, ignore_index=True), h, batch == self.batches - 1)
        yield from self._answers(now, go.assign(batch=batch))
        if len(rest):  # behind the last batch, and so behind its pruning
            yield from self._answers(now[prune(now["client"].to_numpy("int64"), now["at"].to_numpy("int64"), h)], rest.assign(batch=self.batches))

    def _released(self, new, h: int, last: bool):
        """The sales to answer now, and those to answer behind the last batch; the others wait."""
        held = _load(self.waiting)
        every = pa.table({c: pa.array(new[c].to_numpy("int64")) for c in self._WAITS})
        every = every if held is None else pa.concat_tables([held, every])
        at = every["at"].to_numpy()
        go = (at == NONE) | (at < h)
        stay = every.filter(pa.array(~go))
        if len(stay) and not last:
            self.waiting.update((_ipc(stay),))
        elif held is not None:
            self.waiting.clear()
        return every.filter(pa.array(go)).to_pandas(), (stay if last else stay.slice(0, 0)).to_pandas()

    def _versions_now(self, new, before: int):
        """The versions of the batch, sorted by client and version, which are kept."""
        import pandas as pd

        held = _load(self.versions)
        if held is None:
            now = new
        else:
            kept = held.filter(pa.array(prune(held["client"].to_numpy(), held["at"].to_numpy(), before))).to_pandas()
            now = pd.concat([kept, new], ignore_index=True) if len(new) else kept
        if len(new):
            now = now.iloc[np.lexsort([now[c].to_numpy("int64") for c in ("id", "seq", "at", "client")])].reset_index(drop=True)
        if len(new) or (held is not None and held.num_rows != len(now)):
            self.versions.update((_ipc(pa.Table.from_pandas(now[list(self._KEPT)], pa.schema([(c, pa.string() if c == "op" else pa.int64()) for c in self._KEPT]), preserve_index=False)),))
        return now

    def _answers(self, now, sales):
        if not len(sales):
            return
        client, at = now["client"].to_numpy("int64"), now["at"].to_numpy("int64")
        ids, cents, op = now["id"].to_numpy("int64"), now["cents"].to_numpy("int64"), now["op"].astype(object).where(now["op"].notna(), None).to_numpy(object)
        for lo in range(0, len(sales), STEP):
            f = sales.iloc[lo : lo + STEP]
            row, n = answer(client, at, f["client"].to_numpy("int64"), f["at"].to_numpy("int64"))
            hit = row >= 0
            take = lambda a, none, row=row, hit=hit: np.where(hit, a[row], none) if len(a) else np.full(len(row), none)
            yield self._rows("sale", f, np.where(f["client"].to_numpy() == NONE, 0, n), take(ids, NONE), take(cents, NONE), take(op, None))

    @staticmethod
    def _rows(rec, f, held, change, cents, op):
        import pandas as pd

        return pd.DataFrame({"rec": rec, "id": f["id"].to_numpy("int64"), "batch": f["batch"].to_numpy("int32"), "n_held": held, "change_id": change, "balance_cents": cents, "op": op})

    def close(self) -> None:
        pass


@contextlib.contextmanager
def _stores(spark: SparkSession):
    """Settings for the time of a run: transformWithState asks for RocksDB, and as a start reads
    one batch, its stores are closed with it instead of being kept on the executors' disks.
    A store's own block cache isn't freed when it closes, so all stores of an executor share one."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.unloadOnCommit": "true",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": str(STORES_MB),
    }
    old = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _largest(rows: DataFrame, batches: int) -> list[int | None]:
    """The largest time of each batch: one row a batch comes to the driver."""
    found = {r["batch"]: r["m"] for r in rows.groupBy("batch").agg(F.max("at").alias("m")).collect()}
    return [found.get(b) for b in range(batches)]


def horizons(sold: list[int | None], valid: list[int | None], delay: int) -> tuple[list[int], list[int]]:
    """(watermark of the versions, H) of each batch, from each batch's largest times."""

    def marks(largest):
        out, top = [], None
        for m in largest:
            out.append(NONE if top is None else top - delay)
            top = m if top is None else top if m is None else max(top, m)
        return out

    s, v = marks(sold), marks(valid)
    return v, [min(a, b) for a, b in zip(s, v, strict=True)]


def enrich_sales(sales: DataFrame, changes: DataFrame, batches: int = 8, first_day: int = 19723, days: int = 152, delay_hours: int = 12, spread: int = 4) -> DataFrame:
    """(rec, id, batch, n_held, change_id, balance_cents, op) of every sale and late change.

    Both tables are cut into `batches` by the day of arrival (a change arrives up to `spread` - 1
    days after its time), written under spark.checkpoint.dir and shown to the query in
    order, which is started anew for each on one checkpoint and ends when it has read
    the batch. With the last one what still waits is released behind it, as batch `batches`."""
    spark = sales.sparkSession
    home = f"{shared_dir(spark)}/corpusloom-enrich-{uuid.uuid4().hex}"
    day = lambda c: F.unix_date(F.col(c).cast("date"))
    s = sales.select(F.col("sale_id").cast("long").alias("id"), F.col("client_id").cast("long").alias("client"), _micros(F.col("sold_at")).alias("at"), _batch(day("arrived_at"), batches, first_day, days).alias("batch"))
    shift = F.coalesce(F.crc32(F.col("change_id").cast("string")) % spread, F.lit(0))
    c = changes.select(*_CHANGE).where("valid_at is not null").withColumn("batch", _batch(day("valid_at") + shift, batches, first_day, days)).withColumn("at", _micros(F.col("valid_at")))
    late, h = horizons(_largest(s, batches), _largest(c, batches), delay_hours * 3_600_000_000)
    before = [NONE, *h[:-1]]
    at_batch = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), F.col("batch") + 1)

    n_sales = s.count()
    keys = max(KEYS, (n_sales + changes.count()) // ROWS_A_KEY)
    counts = s.where("client is not null").groupBy("client").agg(F.count("*").alias("n"))
    hot = F.broadcast(counts.where(F.col("n") * SHARES > n_sales).select(F.col("client").alias("_hot"), F.ceil(F.col("n") * SHARES / F.lit(n_sales)).cast("int").alias("_parts")))  # under SHARES rows
    dealt = lambda rows: rows.join(hot, F.col("client") == F.col("_hot"), "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    key = lambda part: F.pmod(F.xxhash64("client", part), F.lit(keys)).cast("int")

    own = F.pmod(F.xxhash64("id", "at"), F.lit(2**31 - 1))
    known = [_known(F.col(x)).alias(x) for x in ("id", "client", "at")]
    fed = dealt(s).select(key(F.pmod(F.shiftright(own, 8), F.col("_parts")).cast("int")).alias("key"), *known, at_batch(h).alias("h"), at_batch(before).alias("h_before"), "batch")
    ticks = spark.range(keys * batches).select((F.col("id") % keys).cast("int").alias("key"), F.lit(NONE).alias("none"), F.lit(NONE).alias("client"), F.lit(END).alias("at"), F.floor(F.col("id") / keys).cast("int").alias("batch"))
    ticks = ticks.select("key", F.col("none").alias("id"), "client", "at", at_batch(h).alias("h"), at_batch(before).alias("h_before"), "batch")
    fed.union(ticks).write.partitionBy("batch").parquet(f"{home}/staged/sales")

    cents = F.floor(F.nullif(F.col("balance"), F.lit(float("nan"))) * 100 + F.lit(0.5))
    # every one of the nine columns tells changes apart; only then are some left out
    v = c.dropDuplicates(_CHANGE).select(F.col("change_id").alias("id"), F.col("client_id").cast("long").alias("client"), "at", "seq", cents.alias("cents"), F.col("op").cast("string").alias("op"), "batch")
    v = dealt(v)  # a key takes one copy, however many of a client's parts it has
    v = v.select("*", F.posexplode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), key))).alias("copy", "key"))
    v = v.select("key", *known, _known(F.col("seq")).alias("seq"), _known(F.col("cents")).alias("cents"), "op", "copy", at_batch(late).alias("late_before"), at_batch(h).alias("h"), at_batch(before).alias("h_before"), "batch")
    v.write.partitionBy("batch").parquet(f"{home}/staged/changes")

    fs, path = _files(spark, home)
    for side in ("sales", "changes"):
        fs.mkdirs(path(f"{home}/fed/{side}"))
    _written.append((spark, home))
    with _stores(spark):
        for b in range(batches):
            for side in ("sales", "changes"):
                if fs.exists(path(f"{home}/staged/{side}/batch={b}")):
                    fs.rename(path(f"{home}/staged/{side}/batch={b}"), path(f"{home}/fed/{side}/batch={b}"))
            _stream(spark, home, batches).start(f"{home}/found").awaitTermination()
    found = spark.read.schema(_OUT).parquet(f"{home}/found")
    real = [F.when(F.col(x) != NONE, F.col(x)).alias(x) for x in ("n_held", "change_id", "balance_cents")]
    return found.select("rec", F.when(F.col("id") != NONE, F.col("id")).alias("id"), F.col("batch").cast("long").alias("batch"), *real, "op")


def _files(spark: SparkSession, home: str):
    """The file system of the shared folder, and its paths."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(home).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _stream(spark: SparkSession, home: str, batches: int):
    """The query on the files shown so far and the state of earlier starts."""
    sales = spark.readStream.schema(_SALES).parquet(f"{home}/fed/sales")
    changes = spark.readStream.schema(_CHANGES).parquet(f"{home}/fed/changes")
    lit = lambda v, kind: F.lit(v).cast(kind)
    a = sales.select("key", F.lit("sale").alias("rec"), "id", "client", "at", lit(NONE, "long").alias("seq"), lit(NONE, "long").alias("cents"), lit(None, "string").alias("op"), lit(0, "int").alias("copy"), lit(NONE, "long").alias("late_before"), "h", "h_before", "batch")
    b = changes.select("key", F.lit("change").alias("rec"), "id", "client", "at", "seq", "cents", "op", "copy", "late_before", "h", "h_before", "batch")
    out = a.union(b).groupBy("key").transformWithStateInPandas(Enrich(batches), _OUT, "append", "none")
    return out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True)


#: DuckDB: the same by closed form. A sale leaves in the first batch from its own whose H has
#: passed it; what it then sees is what came by then and wasn't pruned by the H before.
SQL = """
WITH s AS (SELECT sale_id, client_id, sold_at, least(7, floor((date_diff('day', DATE '1970-01-01', arrived_at::date) - 19723) * 8 / 152))::int AS b FROM sales),
d AS (SELECT DISTINCT * FROM client_changes WHERE valid_at IS NOT NULL),
c AS (
  SELECT *, least(7, floor((date_diff('day', DATE '1970-01-01', valid_at::date) - 19723 + (xor(list_reduce(
    list_prepend(4294967295::ubigint, list_transform(string_split(change_id::varchar, ''), lambda x: ascii(x)::ubigint)),
    lambda h, x: list_reduce(list_prepend(xor(h, x), list_transform(range(8), lambda i: i::ubigint)), lambda y, i: CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384::ubigint) ELSE y >> 1 END)
  ), 4294967295::ubigint) % 4)::int) * 8 / 152))::int AS b FROM d
),
w AS (
  SELECT n.b, (SELECT max(sold_at) FROM s WHERE s.b < n.b) - INTERVAL 12 HOUR AS ws, (SELECT max(valid_at) FROM c WHERE c.b < n.b) - INTERVAL 12 HOUR AS wv
  FROM (SELECT unnest(range(8))::int AS b) n
),
h AS (
  SELECT b, wv, CASE WHEN ws IS NULL OR wv IS NULL THEN NULL ELSE least(ws, wv) END AS h FROM w
  UNION ALL SELECT 8, NULL, TIMESTAMP '9999-01-01'
),
v AS (SELECT c.*, h.wv IS NOT NULL AND c.valid_at < h.wv AS late FROM c JOIN h USING (b)),
e AS (
  SELECT s.*, CASE WHEN sold_at IS NULL THEN s.b ELSE (SELECT min(h.b) FROM h WHERE h.b >= s.b AND s.sold_at < h.h) END AS eb,
    row_number() OVER () AS n FROM s
),
p AS (
  SELECT e.n, e.sale_id, e.sold_at, e.eb, v.change_id, v.seq, v.valid_at, v.op, v.balance, v.b, hb.h AS hb,
    row_number() OVER (PARTITION BY e.n, v.b < e.eb AND v.valid_at <= hb.h ORDER BY v.valid_at DESC, v.seq DESC, v.change_id DESC) AS k
  FROM e LEFT JOIN h hb ON hb.b = e.eb - 1 JOIN v ON v.client_id = e.client_id AND NOT v.late AND v.b <= e.eb
),
u AS (SELECT * FROM p WHERE NOT coalesce(b < eb AND valid_at <= hb, false) OR k = 1),
a AS (
  SELECT n, count(*) AS n_held, arg_max({'i': change_id, 'c': floor(100 * balance + 0.5)::bigint, 'o': op}, (valid_at, seq, change_id)) FILTER (WHERE valid_at <= sold_at) AS x
  FROM u GROUP BY n
)
SELECT 'sale' AS rec, e.sale_id AS id, e.eb::bigint AS batch, coalesce(a.n_held, 0)::bigint AS n_held, a.x.i AS change_id, a.x.c AS balance_cents, a.x.o AS op
FROM e LEFT JOIN a USING (n)
UNION ALL SELECT 'late', change_id, b::bigint, NULL, NULL, NULL, NULL FROM v WHERE late
"""
