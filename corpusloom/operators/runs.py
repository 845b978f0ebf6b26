"""What a run did, observed while it ran: rows in, out and rejected, without a second pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from corpusloom.operators.lineage import EDGE
from corpusloom.sources.lakehouse import Lakehouse

RUN = "run_id string, task_id string, status string, rows_in long, rows_out long, rows_rejected long, metrics map<string,double>, started_at timestamp, finished_at timestamp, error string"


class Run:
    """A run of a task. `reads` and `writes` are put into its plan; the numbers are there once the
    plan has run, and come with its own job. Each may be used once a run.

        with Run(lake, "r1", "chunk", "silver/documents", "silver/chunks") as run:
            lake.write("silver/chunks", run.writes(cut(run.reads(docs))), run_id="r1")
    """

    def __init__(self, lake: Lakehouse, run_id: str, task_id: str, source: str, target: str) -> None:
        self.lake, self.run_id, self.task_id, self.source, self.target = lake, run_id, task_id, source, target
        self.seen: dict[str, Observation] = {}

    def _observe(self, name: str, df: DataFrame, *exprs: Column) -> DataFrame:
        self.seen[name] = Observation()
        return df.observe(self.seen[name], *exprs)

    def reads(self, df: DataFrame) -> DataFrame:
        return self._observe("in", df, F.count(F.lit(1)).alias("rows"))

    def writes(self, df: DataFrame, rejected: Column | None = None, **metrics: Column) -> DataFrame:
        """`rejected` tells which rows are rejects; `metrics` are further aggregates."""
        bad = F.lit(False) if rejected is None else F.coalesce(rejected, F.lit(False))
        return self._observe("out", df, F.count_if(~bad).alias("rows"), F.count_if(bad).alias("rejected"), *(c.cast("double").alias(k) for k, c in metrics.items()))

    def __enter__(self) -> Run:
        self.started = self.lake.spark.sql("SELECT now() AS t")
        self.started = self.started.first()["t"]
        return self

    def __exit__(self, kind, error, trace) -> None:
        """Append the run's row, and its lineage edge if it succeeded."""
        got = {} if kind else {k: o.get for k, o in self.seen.items()}  # of a plan that has failed nothing may ever come
        out = got.get("out", {})
        rows_in, rows_out = got.get("in", {}).get("rows"), out.get("rows")
        extra = {k: v for k, v in out.items() if k not in ("rows", "rejected") and v is not None}
        spark = self.lake.spark
        row = (self.run_id, self.task_id, "failed" if kind else "ok", rows_in, rows_out, out.get("rejected"), extra, self.started, None, str(error)[:2000] if kind else None)
        key = f"{self.run_id}:{self.task_id}:{self.started}"
        self.lake.log("ops/runs").write(spark.createDataFrame([row], RUN).withColumn("finished_at", F.now()), run=key)
        if not kind:
            edge = (self.run_id, self.task_id, self.source, None, self.target, None, rows_in, rows_out, self.started)
            self.lake.log("ops/lineage").write(spark.createDataFrame([edge], EDGE), run=key)


class Progress(StreamingQueryListener):
    """Keeps the numbers of each micro-batch: query, batch, rows in, rows a second, rows and bytes of state."""

    def __init__(self) -> None:
        self.batches: list[tuple] = []
        self.ended: list[tuple[str, str | None]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches.append((p.name, p.batchId, p.numInputRows, p.processedRowsPerSecond, sum(s.numRowsTotal for s in p.stateOperators), sum(s.memoryUsedBytes for s in p.stateOperators)))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.append((str(event.id), event.exception))

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.batches, "query string, batch long, rows_in long, rows_per_second double, state_rows long, state_bytes long")
