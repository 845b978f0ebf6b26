"""What a task holds is bounded by bytes, and what it gives doesn't depend on how rows are cut."""

from __future__ import annotations

import hashlib
import re
from itertools import pairwise

import numpy as np
import pyarrow as pa

from corpusloom.functions.batches import slices
from corpusloom.operators import answers


def _plain(text, dim):
    """Every feature hashed and added by itself."""
    w = [x.lower() for x in re.findall(r"\w+", text)]
    out = np.zeros(dim)
    for f in [*w, *map(" ".join, pairwise(w)), *(f"#{x}#"[i : i + 3] for x in w for i in range(len(x)))]:
        h = hashlib.blake2b(f.encode(), digest_size=8).digest()
        out[int.from_bytes(h[:4], "big") % dim] += (1 if h[4] & 1 else -1) * (0.5 if " " not in f and len(f) <= 3 else 1)
    norm = np.linalg.norm(out.astype(np.float32))
    return out.astype(np.float32) / np.float32(norm if norm else 1)


def test_slices_by_bytes():
    texts = ["a" * 700, None, "b" * 100, "c" * 5000, "", "é" * 300]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts), pa.array([[t] * 3 if t else None for t in texts])], ["i", "text", "toks"]).slice(1)
    got = list(slices(batch, "text", size=1000))
    assert [x.column("i").to_pylist() for x in got] == [[1, 2], [3], [4, 5]]
    assert [x for p in slices(batch, "toks", size=1000) for x in p.column("i").to_pylist()] == [1, 2, 3, 4, 5]
    assert len(list(slices(batch, "toks", size=1000))) == 4 and list(slices(batch.slice(0, 0), "text")) == []


def test_hasher_forgets(monkeypatch):
    texts = ["The cat, the CAT; a b_1 ²³ ΟΔΟΣ'Α İX", "", "one", "x y " * 50, " ".join(f"w{i}" for i in range(300))]
    want = np.array([_plain(t, 24) for t in texts])
    assert np.array_equal(answers.hash_vectors([*texts, None], 24)[:-1], want)
    monkeypatch.setattr(answers, "KEPT", 20)
    monkeypatch.setattr(answers, "WORDS_AT_ONCE", 7)
    hasher = answers.Hasher(24)
    assert np.array_equal(answers.hash_vectors(texts, 24, hasher), want) and np.array_equal(answers.hash_vectors(texts, 24, hasher), want)
    assert len(hasher.known) <= 20


def test_embed_backlog_makes_a_cached_vector_once(spark):
    """The cache's plan, which may itself embed, is worked out once and not in the hits and the misses."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, f"text {i // 2}") for i in range(8)], "chunk_id long, text string").withColumn("embedded_text_sha256", F.sha2("text", 256))
    cache = docs.where("chunk_id < 4").select("embedded_text_sha256", answers.hash_embed(F.col("text"), 8).alias("vector"))
    out = answers.embed_backlog(docs, cache, lambda c: answers.hash_embed(c, 8), 8)
    got = {r["chunk_id"]: (r["cache_hit"], list(r["vector"])) for r in out.collect()}
    assert {i: x[0] for i, x in got.items()} == {i: i < 4 for i in range(8)}
    assert all(got[i][1] == answers.hash_vectors([f"text {i // 2}"], 8)[0].tolist() for i in range(8))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") + plan.count("run(") <= 2  # of the misses alone


def test_layout_deals_spans_once(spark):
    """Lines, sizes and heads need one shuffle by document; no line is worked out again for a join."""
    from corpusloom.sources import layout

    span = "document_id string, page int, height double, x double, x1 double, y double, size double, font string, text string"
    rows = [(d, p, 800.0, 50.0, 90.0, y, 16.0 if y == 100.0 else 10.0, "Serif", f"{t} {p}") for d in ("a", None) for p in (1, 2, 3) for y, t in ((20.0, "Head"), (100.0, "Title"), (200.0, "some words"))]
    out = layout.blocks(spark.createDataFrame(rows, span))
    assert [tuple(r) for r in out.orderBy("ordinal").collect()] == [("a", i, i // 2 + 1, *(("heading", 1, f"Title {i // 2 + 1}") if i % 2 == 0 else ("paragraph", 0, f"some words {i // 2 + 1}"))) for i in range(6)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("RepartitionByExpression") == 1


def test_tokens_of_spans(monkeypatch):
    """Spans of a text are counted from sums over the whole text, which is read once."""
    import random

    from corpusloom.operators import chunking

    draw = random.Random(7)
    for _ in range(200):
        text = "".join(draw.choice("abcdefghB1²_ \n.!;'é٣Ⅷ\x1c中") for _ in range(60))
        tokens = chunking.Tokens(text)
        for _ in range(20):
            a, b = sorted(draw.randint(0, 60) for _ in range(2))
            assert tokens.count(a, b) == chunking.count_tokens(text[a:b])
    read = []
    plain = chunking.count_tokens
    monkeypatch.setattr(chunking, "count_tokens", lambda t: (read.append(len(t)), plain(t))[1])
    text = "\n\n".join("Some words stand here, and a few more of them follow. " * 30 for _ in range(5))
    assert len(chunking.chunk_text(text)) > 3 and sum(read) == 0


def test_parts_of_an_arrow_batch():
    """Tasks give their rows in slices: Python objects of a whole batch of long texts are never held at once."""
    from corpusloom.functions import batches
    from corpusloom.operators import chunking, ingest

    texts = pa.array(["word " * 60_000] * 10)
    assert batches.SLICE < 10 * 300_000
    batch = pa.RecordBatch.from_arrays([pa.array(["d"] * 10), pa.array(["t"] * 10), texts, pa.array(["md"] * 10)], ["document_id", "title", "text", "extension"])
    got = list(chunking._chunks(chunking.Settings())(iter([batch])))
    assert [p.num_rows for p in got] == [3, 3, 3, 1]
    raw = pa.RecordBatch.from_arrays([pa.array(["a.md"] * 10), pa.array(["md"] * 10), pa.nulls(10, pa.string()), texts.cast(pa.binary())], ["uri", "extension", "code", "content"])
    got = list(ingest._parse(ingest.PARSERS)(iter([raw])))
    assert [p.num_rows for p in got] == [3, 3, 3, 1]


def test_simhash_blake2b_by_parts(spark):
    from pyspark.sql import functions as F

    from corpusloom.operators import dedup

    texts = ["", None, "One two", "one two three", "one two three four", " ".join(f"w{i % 7}x{i % 11}" for i in range(12_000))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    got = [r["s"] for r in rows.select("i", dedup.simhash_blake2b(F.col("text")).alias("s")).orderBy("i").collect()]
    words = [[w.lower() for w in re.findall(r"\w+", t or "")] for t in texts]
    assert got == [dedup._vote([hashlib.blake2b(g.encode(), digest_size=8).digest() for g in dedup._grams(w, 4) if g]) for w in words]
