"""Session settings that the engine relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# What every session of the engine sets. Sizes are left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "parquet.compression.codec.zstd.level": "3",
}


def get_session(app: str = "corpusloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive plans; `conf` keys use "__" for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def object_store(endpoint: str, access_key: str, secret_key: str, path_style: bool = True, tls: bool = True) -> dict[str, str]:
    """Hadoop settings for an S3-compatible store, to be passed at session start."""
    return {
        "spark.hadoop.fs.s3a.endpoint": endpoint,
        "spark.hadoop.fs.s3a.access.key": access_key,
        "spark.hadoop.fs.s3a.secret.key": secret_key,
        "spark.hadoop.fs.s3a.path.style.access": str(path_style).lower(),
        "spark.hadoop.fs.s3a.connection.ssl.enabled": str(tls).lower(),
    }


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over all cores if their files are fewer than these: one file is often one row
    group, and so one task for all work that needs no shuffle. Of more files it changes nothing."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if 0 < len(df.inputFiles()) < cores else df


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where the session names
    one. On one machine without that setting (tests) it is a temporary folder of our own; on a
    cluster, whose executors can't see such a folder, the setting is asked for."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpusloom-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: made once, read by column by all that follows."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written once, their lineage cut. A table is used for it, as a reliable checkpoint of an RDD
    works its rows out a second time to write them."""
    return written(df, "rows")
