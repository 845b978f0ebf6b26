"""Reading and writing the layers of the lakehouse, content-addressed raw files, listings."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import ids
from corpusloom.plans.schemas import DATASETS, Dataset
from corpusloom.sources.commitlog import CommitLog

#: Files of a partition from which it is compacted, and the size that counts as small.
COMPACT_FILES, COMPACT_BYTES = 8, 32 * 1024 * 1024


def run_token(run_id: str) -> str:
    """A run id that is safe in a key; what was changed gets a digest."""
    safe = re.sub(r"[^A-Za-z0-9._-]", "-", run_id)
    return safe if safe == run_id else f"{safe}-{hashlib.blake2b(run_id.encode(), digest_size=4).hexdigest()}"


class MissingDataset(FileNotFoundError):
    """E2003: a dataset that has no files."""


class Lakehouse:
    """Datasets below a root path that Spark can read, local or in an object store."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def log(self, name: str) -> CommitLog:
        return CommitLog(self.spark, self.path(name))

    def exists(self, name: str) -> bool:
        """Whether a dataset has a version, or is a plain folder; what a writer that died before its
        first commit left is neither."""
        fs, p = self._fs(self.path(name))
        return fs.exists(p) and (self.log(name).exists() or any(f.getPath().getName() not in ("_log", "data") for f in fs.listStatus(p)))

    def read(self, name: str, columns: list[str] | None = None, where: str | Column | None = None, partition: dict[str, str] | None = None, missing_ok: bool = False, version: int | None = None) -> DataFrame:
        """A dataset by its schema, files united by name; filters on partition columns prune.
        What its log names, at a version; a folder without a log is read as it is."""
        if not self.exists(name):
            if missing_ok and name in DATASETS:
                return DATASETS[name].empty(self.spark)
            raise MissingDataset(f"E2003: {name} has no files")
        log = self.log(name)
        if log.exists():
            df = log.read(version, DATASETS[name].schema if name in DATASETS else None)
        else:
            reader = self.spark.read
            reader = reader.schema(DATASETS[name].schema) if name in DATASETS else reader.option("mergeSchema", True)
            df = reader.parquet(self.path(name))
        for key, value in (partition or {}).items():
            df = df.where(F.col(key) == value)
        if where is not None:
            df = df.where(where)
        return df.select(*columns) if columns else df

    def write(self, name: str, df: DataFrame, run_id: str | None = None, mode: str = "append", cursors: dict[str, str] | None = None) -> int:
        """Enforce the schema and append or overwrite in one commit, clustered by partition and
        sorted within files, so min/max statistics are tight. Partitions meet by a rebalancing
        shuffle, which splits large ones over several tasks and needs no sampling run. A run
        that dies is invisible, a repeated run adds nothing, and `cursors` advance with the rows.
        Returns the version."""
        d = DATASETS[name]
        keys = [*d.partition_by, *d.sort_by]
        df = d.enforce(df)
        df = (df.hint("rebalance", *d.partition_by) if d.partition_by else df).sortWithinPartitions(*keys) if keys else df
        return self.log(name).write(df, mode, run_id and run_token(run_id), d.partition_by, cursors)

    def register(self, names: list[str] | None = None) -> None:
        """A view for each dataset that has files: layer/dataset becomes layer_dataset."""
        for name in names or DATASETS:
            self.read(name, missing_ok=True).createOrReplaceTempView(name.replace("/", "_"))

    def sql(self, query: str, limit: int | None = None, **args) -> DataFrame:
        df = self.spark.sql(query, args=args) if args else self.spark.sql(query)
        return df.limit(limit) if limit else df

    def scalar(self, query: str):
        row = self.spark.sql(query).first()
        return row[0] if row else None

    # -- files ---------------------------------------------------------------

    def files(self, name: str = "", pattern: str = "*") -> DataFrame:
        """path, length, modificationTime of all files below a prefix; contents are not read."""
        df = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(self.path(name))
        return df.select("path", "length", "modificationTime")

    def delete(self, keys: list[str]) -> int:
        """Delete files by key; raw bronze files are protected."""
        if bad := [k for k in keys if k.startswith("bronze/raw")]:
            raise PermissionError(f"raw files are immutable: {bad[:3]}")
        n = 0
        for k in keys:
            fs, p = self._fs(self.path(k))
            n += bool(fs.delete(p, False))
        return n

    def put_raw(self, source_type: str, content: bytes, extension: str) -> str:
        """Store bytes under their digest; present ones are left alone. Returns the key."""
        sha = hashlib.sha256(content).hexdigest()
        key = f"bronze/raw/source_type={source_type}/sha256={sha}.{extension}"
        fs, p = self._fs(self.path(key))
        if not fs.exists(p):
            out = fs.create(p, False)
            out.write(bytearray(content))
            out.close()
        return key

    def raw(self, prefix: str = "bronze/raw") -> DataFrame:
        """Raw files with `ok`: the content has the digest of its name."""
        df = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(self.path(prefix))
        return df.withColumn("sha256", F.regexp_extract("path", r"sha256=([0-9a-f]{64})", 1)).withColumn("ok", F.sha2("content", 256) == F.col("sha256"))

    # -- compaction ----------------------------------------------------------

    def compaction_plan(self, name: str) -> DataFrame:
        live = [(p, f["size"], f["partition"]) for p, f in self.log(name).state().files.items()]
        return compaction_plan(self.spark.createDataFrame(live, "path string, length long, partition string"))

    def compact(self, name: str, partition: str) -> int:
        """Rewrite one partition as sorted files of good size, in one commit; returns the rows.
        What is appended meanwhile stays, readers see the old files or the new ones."""
        d: Dataset = DATASETS[name]

        def rewrite(rows: DataFrame, size: int) -> DataFrame:
            sort = [c for c in d.sort_by if c in rows.columns]
            parts = max(1, round(size / (4 * COMPACT_BYTES)))
            return (rows.repartitionByRange(parts, *sort) if sort else rows.repartition(parts)).sortWithinPartitions(*sort)

        return self.log(name).compact(partition, rewrite)


def compaction_plan(files: DataFrame, most: int = COMPACT_FILES, small: int = COMPACT_BYTES) -> DataFrame:
    """Partitions (path prefix) with two files or more that are many or small."""
    out = files.groupBy("partition").agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"), F.count_if(F.col("length") < small).alias("n_small"))
    return out.withColumn("compact", (F.col("n_files") >= 2) & ((F.col("n_files") > most) | (F.col("n_small") > 0)))


def listing_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """path, change: added, changed, removed or same, by (mtime, size)."""
    b = before.select("path", F.struct("modificationTime", "length").alias("b"))
    n = now.select("path", F.struct("modificationTime", "length").alias("n"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("b") != F.col("n"), "changed").otherwise("same")
    return b.join(n, "path", "full").select("path", change.alias("change"))


def directory(spark: SparkSession, path: str, glob: str = "*", include: str | None = None, exclude: str | None = None) -> DataFrame:
    """Files below a directory with contents, by glob and regular expressions on the path."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    if include:
        df = df.where(F.col("path").rlike(include))
    if exclude:
        df = df.where(~F.col("path").rlike(exclude))
    return df


def manifest(files: DataFrame, source_type: str, run_id: str, level: str = "internal") -> DataFrame:
    """Manifest rows of fetched files (path, content, length, modificationTime)."""
    uri = F.when(F.col("path").rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("path")).otherwise(F.concat(F.lit("file://"), F.regexp_replace("path", "^file:/*", "/")))
    df = files.withColumn("canonical_source_uri", ids.canonical_uri(uri)).withColumn("content_sha256", F.sha2("content", 256))
    df = df.withColumn("document_id", ids.uuid5(ids.NS_DOCUMENT, F.col("canonical_source_uri")))
    return df.select(
        ids.manifest_id(F.col("document_id"), F.col("content_sha256"), run_id).alias("manifest_id"),
        "document_id",
        F.lit(source_type).alias("source_type"),
        F.col("path").alias("source_uri"),
        "canonical_source_uri",
        "content_sha256",
        F.col("length").alias("size_bytes"),
        mime(F.col("path")).alias("mime"),
        F.col("modificationTime").alias("fetched_at"),
        F.lit(run_id).alias("run_id"),
        F.lit(level).alias("security_level"),
        F.to_date("modificationTime").alias("ingest_date"),
    )


# Media types by extension.
MIME = {"md": "text/markdown", "markdown": "text/markdown", "html": "text/html", "htm": "text/html", "pdf": "application/pdf", "txt": "text/plain", "rst": "text/x-rst", "json": "application/json", "py": "text/x-python"}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def mime(path: Column) -> Column:
    ext = extension(path)
    out = F
    for e, m in MIME.items():
        out = out.when(ext == e, m)
    return out.otherwise("application/octet-stream")


def new_objects(fetched: DataFrame, known: DataFrame) -> DataFrame:
    """Fetched rows whose content no manifest row has yet, one for each content."""
    return fetched.dropDuplicates(["content_sha256"]).join(known.select("content_sha256").distinct(), "content_sha256", "left_anti")


def quarantine(rejected: DataFrame, run_id: str, now: Column) -> DataFrame:
    """Reason rows of rejected documents (document_id, content_sha256, source_uri, stage, code, detail)."""
    key = F.concat_ws(":", "document_id", "content_sha256", "code", F.lit(run_id))
    return rejected.select(
        ids.uuid5(ids.uuid.NAMESPACE_URL, key).alias("quarantine_id"), "document_id", "content_sha256", "source_uri", "stage", "code",
        F.substring("detail", 1, 2000).alias("detail"), F.lit(run_id).alias("run_id"), F.lit("open").alias("status"), now.alias("created_at"), F.to_date(now).alias("ingest_date"),
    )
