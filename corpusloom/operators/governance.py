"""Retention, freshness, lineage, audit, quality gates, erasure and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Days that each kind of data is kept, minutes that sources stay fresh.
KEEP_DAYS = {"bronze": 365, "quarantine": 90, "backups": 14, "embedding_versions": 30, "audit": 400, "conversations": 30}
FRESH_MINUTES = {"github": 60, "markdown": 90, "html": 120, "pdf": 120}


def expired(df: DataFrame, time: str, now: Column, days: int) -> DataFrame:
    return df.where(F.col(time) < now - F.make_dt_interval(F.lit(days)))


def unreferenced(raw: DataFrame, used: DataFrame, key: str, time: str, now: Column, days: int) -> DataFrame:
    """Old raw files that nothing refers to."""
    return expired(raw, time, now, days).join(used.select(key).distinct(), key, "left_anti")


def stale_versions(df: DataFrame, version: str, time: str, now: Column, days: int, active: str | None = None) -> DataFrame:
    """Versions whose newest row is too old; the active one stays."""
    out = df.groupBy(version).agg(F.max(time).alias("newest")).where(F.col("newest") < now - F.make_dt_interval(F.lit(days)))
    return out.where(F.col(version) != active) if active else out


def freshness(runs: DataFrame, limits: DataFrame, now: Column, key: str, time: str) -> DataFrame:
    """(key, age_minutes, stale): stale if there is no success or the last is over the limit."""
    last = runs.groupBy(key).agg(F.max(time).alias("last"))
    age = (F.unix_micros(now) - F.unix_micros(F.col("last").cast("timestamp"))) / 60e6
    out = limits.join(last, key, "left").withColumn("age_minutes", F.round(age, 3))
    return out.select(key, "age_minutes", (F.col("last").isNull() | (F.col("age_minutes") > F.col("limit_minutes"))).alias("stale"))


def gates(counts: DataFrame) -> DataFrame:
    """(gate, failed) from one row of parsed, quarantined, chunk_failures, chunked and coverage."""
    total = F.col("parsed") + F.col("quarantined")
    rules = {
        "quarantine_ratio": (total > 0) & (F.col("quarantined") / F.greatest(total, F.lit(1)) > 0.25),
        "zero_parse": (total > 0) & (F.col("parsed") == 0),
        "chunk_failures": F.col("chunk_failures") / F.greatest(F.col("chunk_failures") + F.col("chunked"), F.lit(1)) > 0.30,
        "embedding_coverage": F.col("coverage") < 0.99,
    }
    return counts.select(F.explode(F.array(*(F.struct(F.lit(k).alias("gate"), c.alias("failed")) for k, c in rules.items()))).alias("g")).select("g.*")


class GateFailed(RuntimeError):
    """A run that must not be published."""


def require(gate_rows: DataFrame) -> None:
    if bad := [r["gate"] for r in gate_rows.where("failed").collect()]:  # one row for each gate
        raise GateFailed(", ".join(sorted(bad)))


def audit(log: DataFrame, principal: str | None = None, action: str | None = None, since: Column | None = None, until: Column | None = None, limit: int = 100) -> DataFrame:
    """The newest entries of a log (ts, principal, action), filtered."""
    for name, value in (("principal", principal), ("action", action)):
        if value is not None:
            log = log.where(F.col(name) == value)
    log = log.where(F.col("ts") >= since) if since is not None else log
    log = log.where(F.col("ts") < until) if until is not None else log
    return log.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)


def document_trace(versions: DataFrame, key: str, status: str, version: str) -> DataFrame:
    """Status counts and distinct versions of each document."""
    counts = versions.groupBy(key, status).agg(F.count("*").alias("n")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(status).alias("status"), "n"))).alias("statuses"))
    return counts.join(versions.groupBy(key).agg(F.count_distinct(version).alias("n_versions"), F.min(version).alias("first_version"), F.max(version).alias("last_version")), key)


def status_now(events: DataFrame, key: str, order: list[str], status: str) -> DataFrame:
    """The latest status of each key from appended status events."""
    return events.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias("status"))


def export_conversations(messages: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row a conversation with its turns in order, as JSON."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return messages.groupBy(conv).agg(F.count("*").alias("n_turns"), F.to_json(turns).alias("turns"))


def erase(messages: DataFrame, principals: DataFrame, key: str) -> DataFrame:
    """What remains after the conversations of the principals are erased."""
    return messages.join(principals.select(key).distinct(), key, "left_anti")


def with_permissions(units: DataFrame, permissions: DataFrame, key: str = "document_id", time: str = "changed_at") -> DataFrame:
    """Units with the level and groups of the newest permission row, if there is one."""
    w = Window.partitionBy(key).orderBy(F.desc(time), F.desc("security_level"), F.desc(F.to_json(F.struct("allowed_groups"))))
    new = permissions.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(key, F.col("security_level").alias("_l"), F.col("allowed_groups").alias("_g"), F.lit(True).alias("_has"))
    out = units.join(new, key, "left")
    return out.withColumns({"security_level": F.coalesce("_l", "security_level"), "allowed_groups": F.when(F.col("_has"), F.col("_g")).otherwise(F.col("allowed_groups"))}).drop("_l", "_g", "_has")


def purge(units: DataFrame, deleted: DataFrame, key: str = "document_id") -> DataFrame:
    """Rows without those of hard-deleted documents, to be written in their place."""
    return units.join(deleted.select(key).distinct(), key, "left_anti")


def run_log(events: DataFrame, key: str, time: str, status: str) -> DataFrame:
    """(key, n, started, finished, seconds, failures) of each run."""
    seconds = (F.unix_micros(F.max(F.col(time).cast("timestamp"))) - F.unix_micros(F.min(F.col(time).cast("timestamp")))) / 1e6
    return events.groupBy(key).agg(F.count("*").alias("n"), F.min(time).alias("started"), F.max(time).alias("finished"), F.round(seconds, 3).alias("seconds"), F.count_if(F.col(status) == "error").alias("failures"))
