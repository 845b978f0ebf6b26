"""The commit log, the chain of datasets and the status machine: crashes, two writers, streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunking
from corpusloom.plans import views
from corpusloom.sources import commitlog
from corpusloom.sources.lakehouse import Lakehouse
from corpusloom.streaming import documents


def rows(spark, *values):
    return spark.createDataFrame([(v, f"p{v % 2}") for v in values], "v int, p string")


def values(log, version=None):
    return sorted(r["v"] for r in log.read(version).collect())


def test_versions_runs_and_cursors(spark, tmp_path):
    log = commitlog.CommitLog(spark, str(tmp_path / "t"))
    assert not log.exists() and log.cursor("s") is None and log.read().columns == []
    assert log.write(rows(spark, 1, 2), run="a", partition_by=("p",), cursors={"s": "10"}) == 1
    assert log.write(rows(spark, 3), run="b", partition_by=("p",)) == 2
    assert log.write(rows(spark, 1, 2), run="a", partition_by=("p",), cursors={"s": "99"}) == 1  # a repeated run
    assert values(log) == [1, 2, 3] and values(log, 1) == [1, 2] and log.cursor("s") == "10"
    assert log.read().where("p = 'p1'").count() == 2 and log.read().dtypes == [("v", "int"), ("p", "string")]
    log.write(rows(spark, 7), mode="overwrite", partition_by=("p",))
    assert values(log) == [7] and values(log, 2) == [1, 2, 3]
    with pytest.raises(ValueError):
        log.read(9)


def test_schemas_grow(spark, tmp_path):
    log = commitlog.CommitLog(spark, str(tmp_path / "t"))
    log.write(spark.createDataFrame([(1,)], "a int"))
    log.write(spark.createDataFrame([("x", 2)], "b string, a int"))
    assert sorted(map(tuple, log.read().collect()), key=repr) == [(1, None), (2, "x")]
    with pytest.raises(TypeError):
        log.write(spark.createDataFrame([("x",)], "a string"))


@pytest.mark.parametrize("step", ["stage", "_put", "after"])
def test_a_writer_may_die_anywhere(spark, tmp_path, monkeypatch, step):
    log = commitlog.CommitLog(spark, str(tmp_path / "t"))
    log.write(rows(spark, 1), run="one")
    put, stage = commitlog.CommitLog._put, commitlog.CommitLog.stage

    def die(*a):
        if step == "stage":
            stage(*a)  # files are there, the log doesn't know
        if step == "after":
            put(*a)
        raise OSError("killed")

    with monkeypatch.context() as m:
        m.setattr(commitlog.CommitLog, "stage" if step == "stage" else "_put", die)
        with pytest.raises(OSError):
            log.write(rows(spark, 2, 3), mode="overwrite", run="two")
    assert values(log) == ([2, 3] if step == "after" else [1])
    log.write(rows(spark, 2, 3), mode="overwrite", run="two")
    assert values(log) == [2, 3] and log.state().version == 2
    assert log.vacuum(0.0) >= 1 and values(log) == [2, 3]


def test_two_writers_both_count(spark, tmp_path, monkeypatch):
    a, b = (commitlog.CommitLog(spark, str(tmp_path / "t")) for _ in range(2))
    a.write(rows(spark, 1))
    put = commitlog.CommitLog._put

    def slower(self, name, content):
        if self is a:
            monkeypatch.setattr(commitlog.CommitLog, "_put", put)
            b.write(rows(spark, 2))  # takes the number that `a` is about to take
        return put(self, name, content)

    monkeypatch.setattr(commitlog.CommitLog, "_put", slower)
    a.write(rows(spark, 3))
    assert values(a) == [1, 2, 3] and a.state().version == 3
    assert not a._put(a._name(3), {}) and not list((tmp_path / "t" / "_log").glob(".*[0-9a-f]"))


def test_compaction_beside_writers(spark, tmp_path):
    log = commitlog.CommitLog(spark, str(tmp_path / "t"))
    for v in (1, 3, 5):
        log.write(rows(spark, v), partition_by=("p",))

    def rewrite(df, size):
        log.write(rows(spark, 7, 2), partition_by=("p",))  # while it runs
        return df.coalesce(1)

    assert log.compact("p=p1", rewrite) == 3 and values(log) == [1, 2, 3, 5, 7]
    assert sum(f["partition"] == "p=p1" for f in log.state().files.values()) == 2
    assert log.added(0, log.state().version).count() == 5  # what was rewritten isn't new

    def overtaken(df, size):
        log.write(rows(spark, 9), mode="overwrite", partition_by=("p",))
        return df.coalesce(1)

    with pytest.raises(commitlog.Conflict):
        log.compact("p=p1", overtaken)
    assert values(log) == [9] and log.compact("p=p7", rewrite) == 0


def test_states_are_written_now_and_then(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commitlog, "CHECKPOINT", 3)
    log = commitlog.CommitLog(spark, str(tmp_path / "t"))
    for v in range(7):
        log.write(rows(spark, v), run=f"r{v}", cursors={"s": str(v)})
    assert len(list((tmp_path / "t" / "_log").glob("*.state"))) == 2
    for f in sorted((tmp_path / "t" / "_log").glob("*.json"))[:5]:
        f.unlink()  # readers start from the last state
    assert values(log) == list(range(7)) and log.state().runs["r0"] == 1 and log.cursor("s") == "6"


# -- the chain -------------------------------------------------------------------

DOC = "document_id string, document_version_id string, source_type string, title string, text string, parsed_at timestamp, is_deleted boolean"


def arrivals(spark, path, *docs):
    spark.createDataFrame([(d, f"{d}-{v}", "markdown", d, text, None, gone) for d, v, text, gone in docs], DOC).withColumn("parsed_at", F.timestamp_seconds(F.lit(1_700_000_000 + sum(int(x[1]) for x in docs)))).coalesce(1).write.mode("append").parquet(path)


def chain(spark, lake, source, checkpoint, second):
    stream = spark.readStream.schema(DOC).option("maxFilesPerTrigger", 1).parquet(source)
    prepare = lambda df: df.withColumn("ingest_date", F.to_date("parsed_at"))
    documents.into(stream, lake, "silver/documents", "silver", checkpoint, prepare)
    return documents.follow(lake, "silver/documents", "silver/chunks", documents.cut_new(lake, F.timestamp_seconds(F.lit(1_700_001_000 + second))))


def current(lake):
    c = views.current_chunks(lake.read("silver/chunks"), lake.read("silver/documents"))
    return sorted((r["document_id"], r["document_version_id"], r["text"]) for r in c.collect())


A, B = "# A\n\nfirst words here", "# A\n\nfirst words here\n\n# B\n\nother words"


def test_two_runs_of_the_chain_equal_one(spark, tmp_path):
    lake, source, mark = Lakehouse(spark, str(tmp_path / "lake")), str(tmp_path / "in"), str(tmp_path / "mark")
    arrivals(spark, source, ("a", "1", A, False), ("b", "1", B, False))
    chain(spark, lake, source, mark, 1)
    assert current(lake) == [("a", "a-1", "first words here"), ("b", "b-1", "first words here"), ("b", "b-1", "other words")]
    before = lake.log("silver/chunks").state().version
    assert chain(spark, lake, source, mark, 2) == (1, 1) and lake.log("silver/chunks").state().version == before
    arrivals(spark, source, ("a", "2", B, False))
    arrivals(spark, source, ("b", "2", "", True))
    chain(spark, lake, source, mark, 3)
    assert current(lake) == [("a", "a-2", "first words here"), ("a", "a-2", "other words")]
    one, all_in, mark2 = Lakehouse(spark, str(tmp_path / "one")), source, str(tmp_path / "mark2")
    chain(spark, one, all_in, mark2, 1)
    assert current(one) == current(lake)


@pytest.mark.parametrize("where", ["silver", "chunks"])
def test_a_chain_killed_between_write_and_commit(spark, tmp_path, monkeypatch, where):
    lake, source, mark = Lakehouse(spark, str(tmp_path / "lake")), str(tmp_path / "in"), str(tmp_path / "mark")
    arrivals(spark, source, ("a", "1", A, False), ("b", "1", B, False))
    commit = commitlog.CommitLog.commit

    def die(self, *a, **k):
        if where in self.path.rpartition("/")[2] or (where == "silver" and "documents" in self.path):
            raise OSError("killed")
        return commit(self, *a, **k)

    with monkeypatch.context() as m:
        m.setattr(commitlog.CommitLog, "commit", die)
        with pytest.raises(Exception, match="killed"):
            chain(spark, lake, source, mark, 1)
    assert not lake.log("silver/chunks").exists()
    chain(spark, lake, source, mark, 1)
    assert [c[:2] for c in current(lake)] == [("a", "a-1"), ("b", "b-1"), ("b", "b-1")] and lake.read("silver/documents").count() == 2


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    lake, source, mark = Lakehouse(spark, str(tmp_path / "lake")), str(tmp_path / "in"), str(tmp_path / "mark")
    arrivals(spark, source, ("a", "1", A, False))
    chain(spark, lake, source, mark, 1)
    for name in ("0", ".0.crc"):
        (tmp_path / "mark" / "commits" / name).unlink()  # it died after its rows and before the stream's own commit
    chain(spark, lake, source, mark, 2)
    assert lake.read("silver/documents").count() == 1 and len(current(lake)) == 1


# -- chunks of two versions --------------------------------------------------------


def test_unchanged_chunks_stay_current_and_gold_follows(spark):
    docs = lambda v, text: spark.createDataFrame([("d", f"v{v}", text)], "document_id string, document_version_id string, text string").withColumns({"parsed_at": F.timestamp_seconds(F.lit(v)), "is_deleted": F.lit(False)})
    live = lambda df: df.withColumns({"is_current": F.lit(True), "is_deleted": F.lit(False)})
    one = docs(1, B)
    first, _, _ = chunking.chunk_run(one, chunking.no_chunks(spark), F.timestamp_seconds(F.lit(1)))
    first = live(first)
    for text, n in ((B.replace("other", "changed"), 2), (B, 2), (A, 1)):
        two = docs(2, text)
        fresh, dead, _ = chunking.chunk_run(two, first, F.timestamp_seconds(F.lit(2)))
        history = first.unionByName(live(fresh)).unionByName(dead.select(*first.columns))
        now = views.current_chunks(history, one.union(two)).collect()
        assert len(now) == n and {r["document_version_id"] for r in now} == {"v2"}
        again, _, counts = chunking.chunk_run(two, views.current_chunks(history, one.union(two)), F.timestamp_seconds(F.lit(3)))
        assert again.count() == 0 and counts.count() == 0  # nothing is cut again
        old = {r["chunk_key"]: r["chunk_id"] for r in first.collect()}
        assert all(r["lineage_id"] == old[r["chunk_key"]] for r in now if r["chunk_key"] in old)


def test_links_of_any_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("document_id"), "text")
    made = chunking.chunk_documents(docs).checkpoint()
    key = lambda df: sorted(map(tuple, df.select("document_id", "chunk_index", "chunk_id", "prev_chunk_id", "next_chunk_id").collect()), key=repr)
    want = key(made)
    assert sum(r[3] is not None for r in want) == sum(r[4] is not None for r in want) > 0
    for n in (1, 7):
        assert key(chunking.link_chunks(made.drop("prev_chunk_id", "next_chunk_id").repartition(n))) == want


def test_extensions_reach_the_parsers(spark):
    rows = [("a", "x = 1\n\ndef f():\n    return 2\n", "PY"), ("b", "Title\n=====\n\ntext\n\n```\ncode here\n```\n", "txt"), ("c", "# H\n\ntext", None), ("d", None, "md")]
    df = spark.createDataFrame(rows, "document_id string, text string, ext string")
    got = {(r["document_id"], r["chunk_type"], r["code_language"], tuple(r["heading_path"])) for r in chunking.chunk_documents(df, extension=F.col("ext")).collect()}
    assert ("a", "code", "python", ()) in got and ("c", "prose", None, ("H",)) in got and not any(g[0] == "d" for g in got)
    assert ("b", "mixed", None, ("Title",)) in got


# -- the status of documents --------------------------------------------------------


def test_status_stream_equals_the_windows(spark, tmp_path):
    h = 3600
    events = [
        (1, 1, 0, "fetch", "x"), (1, 2, 10, "parsed", None), (1, 3, 20, "fetch", "x"), (1, 4, 30, "fetch", "y"), (1, 5, 40, "delete", None), (1, 6, 50, "parsed", None), (1, 7, 60, "fetch", "x"),
        (2, 8, 5, "parsed", None), (2, 9, 6, "delete", None), (2, 10, 6 + 9 * h, "fetch", "z"), (2, 11, 7 + 9 * h, "fetch", "z"),
        (3, 12, 3, "fetch", "q"), (3, 13, 4, "delete", None), (3, 14, 4 + h, "delete", None), (3, 15, 4 + 11 * h, "fetch", "q"), (3, 16, 5 + 11 * h, "view", None), (4, 17, 1, "fetch", None), (4, 18, 1, "fetch", None),
        (5, 19, 2, "delete", None),
    ]
    df = spark.createDataFrame(events, "document_id long, event_id long, s long, kind string, content string").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_000_000)).drop("s")
    for part in df.randomSplit([1.0, 1.0, 1.0], 3):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(-1, -1, "none", None)], "document_id long, event_id long, kind string, content string").withColumn("ts", F.timestamp_seconds(F.lit(10**9))).select(*df.columns[:2], "kind", "content", "ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    documents.run_status(spark, stream, str(tmp_path / "out"), str(tmp_path / "mark"), retention_hours=10, late="4000 days")
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=repr)
    want = sorted(map(tuple, documents.status_changes_batch(df, F.timestamp_seconds(F.lit(10**8)), 10).collect()), key=repr)
    assert got == want and {r[3] for r in got} == {"bronze", "silver", "deleted", "purged"}
    mine = [(r[1], r[3]) for r in sorted(want, key=lambda r: r[2]) if r[0] == 3]
    assert mine == [(12, "bronze"), (13, "deleted"), (14, "deleted"), (15, "bronze")]


def test_status_sets_one_timer_a_document():
    """A timer is a call of its own: a document of many events must not set one for each."""
    import pandas as pd

    class Cell:
        def __init__(self):
            self.rows = None

        exists = lambda self: self.rows is not None
        get = lambda self: self.rows

        def update(self, row):
            self.rows = row

        put = update

        def appendList(self, rows):
            self.rows = [*(self.rows or []), *rows]

        def clear(self):
            self.rows = None

    class Handle:
        def __init__(self):
            self.timers, self.asked = [], 0

        getListState = getValueState = lambda self, *_: Cell()
        getMapState = lambda self, *_: None
        registerTimer = lambda self, ms: self.timers.append(ms)

    handle, machine = Handle(), documents.Status(10**9)
    machine.init(handle)
    us = [5_000_000 + 1_000 * n for n in range(500)]
    frame = pd.DataFrame({"us": us, "event_id": range(500), "kind": "other", "content": ""})
    list(machine.handleInputRows((1,), iter([frame[250:], frame[:250]]), None))
    assert handle.timers == [5000]

    class Now:
        getCurrentWatermarkInMs = lambda self: 5100

    list(machine.handleExpiredTimer((1,), Now(), None))
    assert handle.timers == [5000, 5101]  # the first of those that wait
