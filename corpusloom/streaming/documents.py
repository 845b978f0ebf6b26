"""Documents as streams: a chain of datasets that follow each other, and the status of each document.

The chain is Bronze to Silver to chunks. Silver takes micro-batches by foreachBatch, each in
one commit named after (query, batch), so a batch that is run again adds nothing. What
follows a dataset reads the rows that its commits added since the cursor of its own last
commit, and moves the cursor in the commit with its rows: it can die anywhere and be started again.

The status machine is keyed by document. Events wait in state until the watermark has
passed them and are then taken in order of time by timers, so the outcome doesn't depend on how
events are dealt over batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from corpusloom.operators import chunking
from corpusloom.plans import views
from corpusloom.plans.schemas import DATASETS
from corpusloom.sources.lakehouse import Lakehouse

# -- the chain -----------------------------------------------------------------


def into(stream: DataFrame, lake: Lakehouse, dataset: str, query: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Take what a stream has, a commit a micro-batch, and stop."""

    def put(batch: DataFrame, number: int) -> None:
        lake.write(dataset, prepare(batch), run_id=f"{query}:{number}")

    stream.writeStream.foreachBatch(put).queryName(query).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def follow(lake: Lakehouse, source: str, target: str, step: Callable[[DataFrame], DataFrame]) -> tuple[int, int]:
    """Give `step` the rows that `source` got since the cursor of `target`, and append what it
    returns in one commit with the cursor. Returns (cursor before, cursor after)."""
    done, last = int(lake.log(target).cursor(source) or 0), lake.log(source).state().version
    if done < last:
        rows = lake.log(source).added(done, last, DATASETS[source].schema)
        lake.write(target, step(rows), run_id=f"{source}:{done}-{last}", cursors={source: str(last)})
    return done, last


def cut_new(lake: Lakehouse, now: Column, settings: chunking.Settings | None = None) -> Callable[[DataFrame], DataFrame]:
    """The step from Silver documents to Silver chunks: new versions are cut, and the rows to
    append are those of chunking.chunk_run with tombstones of what is gone."""
    columns = set(DATASETS["silver/chunks"].schema.names)

    def step(added: DataFrame) -> DataFrame:
        documents = views.current_documents(lake.read("silver/documents").join(added.select("document_id").distinct(), "document_id", "left_semi"))
        stored = views.latest(lake.read("silver/chunks", missing_ok=True), "chunk_id", F.desc("created_at"), F.desc("document_version_id")).where("is_current and not is_deleted")
        fresh, dead, _ = chunking.chunk_run(documents.select("document_id", "document_version_id", "text", "title"), stored, now, settings, title=F.col("title"))
        of = documents.select("document_id", "source_type", "security_level", "allowed_groups", "language")
        fresh = fresh.drop("source_type", "security_level", "allowed_groups", "language").join(of, "document_id").withColumns({"is_current": F.lit(True), "is_deleted": F.lit(False), "ingest_date": F.to_date("created_at")})
        keep = lambda df: df.select(*(c for c in df.columns if c in columns))
        gone = added.where("is_deleted").select("document_id").distinct().join(documents.select("document_id"), "document_id", "left_anti")
        orphans = stored.join(gone, "document_id", "left_semi").withColumns({"is_deleted": F.lit(True), "created_at": now})
        return keep(fresh).unionByName(keep(dead), allowMissingColumns=True).unionByName(keep(orphans), allowMissingColumns=True)

    return step


# -- the status of a document ----------------------------------------------------

_STATUS = "document_id long, event_id long, us long, status string"


class Status(StatefulProcessor):
    """fetch of new content, or of any while deleted: bronze. parsed, unless deleted or never
    fetched: silver. delete: deleted. Other events change nothing. A document that after a
    deletion is neither fetched nor deleted for `retention_us` is purged: what it ever contained
    is forgotten with its state."""

    def __init__(self, retention_us: int) -> None:
        self.retention = retention_us

    def init(self, handle) -> None:
        self.handle, self.nothing = handle, None
        self.waiting = handle.getListState("waiting", "us long, event_id long, kind string, content string")
        self.status = handle.getValueState("status", "status string, deleted_us long")
        self.contents = handle.getMapState("contents", "content string", "first_us long")
        self.alarm = handle.getValueState("alarm", "ms long")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        earliest = None
        for frame in rows:
            self.waiting.appendList([(int(u), int(e), k, c) for u, e, k, c in zip(frame["us"], frame["event_id"], frame["kind"], frame["content"], strict=True)])
            first = -(-int(frame["us"].min()) // 1000) if len(frame) else None
            if first is not None and (earliest is None or first < earliest):
                earliest = first
        # One timer a document, at its earliest event: what expires takes all that is due and sets the next.
        if earliest is not None:
            set_to = self.alarm.get()[0] if self.alarm.exists() else None
            if set_to is None or earliest < set_to:
                self.handle.registerTimer(earliest)
                self.alarm.update((earliest,))
        if self.nothing is None:
            self.nothing = pd.DataFrame({"document_id": [], "event_id": [], "us": [], "status": []}).astype({"document_id": "int64", "event_id": "Int64", "us": "int64", "status": object})
        yield self.nothing

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        now = timerValues.getCurrentWatermarkInMs() * 1000  # whatever is older has come by now
        held = list(self.waiting.get()) if self.waiting.exists() else []
        due, rest = sorted((x for x in held if x[0] <= now), key=lambda x: (x[0], x[1])), [x for x in held if x[0] > now]
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
        if rest:
            following = -(-min(x[0] for x in rest) // 1000)
            self.handle.registerTimer(following)
            self.alarm.update((following,))
        else:
            self.alarm.clear()
        status, deleted = self.status.get() if self.status.exists() else (None, None)
        out = []
        known, new, cleared = set(), {}, False  # contents seen, those to be stored, and whether the stored ones are void
        for us, event, kind, content in [*due, (now + 1, None, None, None)]:
            if status == "deleted" and us > deleted + self.retention:
                out.append((None, deleted + self.retention, "purged"))
                status = None
                known, new, cleared = set(), {}, True
            after = None
            if kind == "fetch":
                fresh = content not in known and (cleared or not self.contents.containsKey((content,)))
                known.add(content)
                after = "bronze" if fresh or status == "deleted" else None
                if fresh:
                    new[content] = us
            elif kind == "parsed" and status not in (None, "deleted"):
                after = "silver"
            elif kind == "delete":
                after, deleted = "deleted", us
            if after:
                out.append((event, us, after))
                status = after
        if cleared:
            self.contents.clear()
        for content, us in new.items():
            self.contents.updateValue((content,), (us,))
        if status is None:
            self.status.clear()
        elif due:
            self.status.update((status, deleted))
        if status == "deleted":
            self.handle.registerTimer((deleted + self.retention) // 1000 + 1)
        yield pd.DataFrame({"document_id": key[0], "event_id": pd.array([e for e, _, _ in out], "Int64"), "us": pd.Series([u for _, u, _ in out], dtype="int64"), "status": pd.Series([s for *_, s in out], dtype=object)})

    def close(self) -> None:
        pass


def status_changes(events: DataFrame, retention_hours: int = 24 * 30, late: str = "1 hour") -> DataFrame:
    """(document_id, event_id, ts, status) of every change, as the watermark passes it; `events`
    is a stream of (document_id, event_id, ts, kind, content). Needs the RocksDB state store."""
    e = events.select("document_id", "event_id", "ts", "kind", F.coalesce("content", F.lit("")).alias("content"), F.unix_micros("ts").alias("us")).withWatermark("ts", late)
    out = e.groupBy("document_id").transformWithStateInPandas(Status(retention_hours * 3_600_000_000), _STATUS, "append", "eventTime")
    return out.select("document_id", "event_id", F.timestamp_micros("us").alias("ts"), "status")


def status_changes_batch(events: DataFrame, until: Column, retention_hours: int = 24 * 30) -> DataFrame:
    """The same by windows over a finished table, up to a time. A life of a document ends where
    its last fetch or deletion was a deletion longer ago than the retention."""
    by = Window.partitionBy("document_id").orderBy("ts", "event_id")
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(1, Window.unboundedFollowing)
    keep = F.expr(f"INTERVAL {retention_hours} HOURS")
    move = F.when(F.col("kind").isin("fetch", "delete"), F.struct(F.col("kind").alias("kind"), "ts"))
    e = events.where(F.col("ts") <= until).withColumns({"was": F.last(move, True).over(before), "next": F.first(move, True).over(after)})
    anew = F.coalesce(move.isNotNull() & (F.col("was.kind") == "delete") & (F.col("ts") > F.col("was.ts") + keep), F.lit(False))
    e = e.withColumn("life", F.sum(anew.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.row_number().over(Window.partitionBy("document_id", "life", "kind", F.coalesce("content", F.lit(""))).orderBy("ts", "event_id")) == 1
    status = F.when(F.col("kind") == "delete", "deleted").when((F.col("kind") == "fetch") & (F.col("first") | (F.col("was.kind") == "delete")), "bronze").when((F.col("kind") == "parsed") & (F.col("was.kind") == "fetch"), "silver")
    out = e.withColumn("first", first).withColumn("status", status)
    end = F.col("ts") + keep
    purged = out.where((F.col("kind") == "delete") & (end <= until) & (F.col("next").isNull() | (F.col("next.ts") > end)))
    return out.where("status is not null").select("document_id", "event_id", "ts", "status").union(purged.select("document_id", F.lit(None).cast("long"), end, F.lit("purged")))


def run_status(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str, **options) -> None:
    """Run the status machine over what a stream has, and stop."""
    key, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    old = spark.conf.get(key, None)
    spark.conf.set(key, rocks)
    try:
        status_changes(stream, **options).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)
