"""Sale enrichment, vector codes and decontamination against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import codes, decontam, enrich, queries
from corpusloom.llm.common import table

BASE = datetime(2024, 1, 1)
SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"
CHANGES = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double"


def same(spark, sf, name, tables):
    """The query's rows are those of its SQL."""
    got = queries.queries()[name](spark, sf).toPandas()
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    con.register("got", got)
    con.sql(f"CREATE TABLE want AS {queries.oracle_sql()[name]}")
    names = ", ".join(f'"{r[0]}"::VARCHAR AS "{r[0]}"' for r in con.sql("DESCRIBE want").fetchall())
    numbers = [c for c in got.columns if got[c].dtype.kind == "f"]
    assert sorted(got.columns) == sorted(r[0] for r in con.sql("DESCRIBE want").fetchall())
    exact = lambda t: ", ".join(f"{c}::BIGINT::VARCHAR AS {c}" if c in numbers else f'"{c}"::VARCHAR AS "{c}"' for c in sorted(got.columns))
    assert len(got) and names
    for a, b in (("got", "want"), ("want", "got")):
        assert con.sql(f"SELECT {exact(a)} FROM {a} EXCEPT ALL SELECT {exact(b)} FROM {b}").fetchall() == []


@pytest.mark.parametrize("name,tables", [("op11_sale_enrichment", ["sales", "client_changes"]), ("op12_vector_codes", ["embeddings"]), ("op13_decontamination", ["documents", "benchmark"])])
def test_query_equals_its_sql(spark, sf, name, tables):
    same(spark, sf, name, tables)


# -- op11 ----------------------------------------------------------------------


def plain_enrichment(sales, changes):
    """The contract, one row after the other."""
    micros = lambda t: int((t - datetime(1970, 1, 1)) / timedelta(microseconds=1))
    number = lambda day: max(0, min(7, (day - 19723) * 8 // 152))
    epoch = lambda t: (t.date() - datetime(1970, 1, 1).date()).days
    delay, low = 12 * 3_600_000_000, float("-inf")
    bs = [[] for _ in range(8)]
    for s in sales:
        bs[number(epoch(s[5])) if s[5] else 7].append((s[0], s[1], micros(s[4]) if s[4] else None))
    bc = [[] for _ in range(8)]
    for c in set(changes):
        if c[4]:
            shift = zlib.crc32(str(c[0]).encode()) % 4 if c[0] is not None else 0
            bc[number(epoch(c[4]) + shift)].append(c)
    rank = lambda c: (micros(c[4]), c[2] is not None, c[2] or 0, c[0] is not None, c[0] or 0)
    held, waiting, out, ws, wv = {}, [], [], low, low
    for b in range(9):
        h = min(ws, wv) if b < 8 else float("inf")
        for c in bc[b] if b < 8 else ():
            if micros(c[4]) < wv:
                out.append(("late", c[0], b, None, None, None, None))
            elif c[1] is not None:
                held.setdefault(c[1], []).append(c)
        waiting += bs[b] if b < 8 else []
        for s in waiting:
            if s[2] is None or s[2] < h:
                mine = held.get(s[1], []) if s[1] is not None else []
                seen = [c for c in mine if s[2] is not None and micros(c[4]) <= s[2]]
                last = max(seen, key=rank) if seen else None
                cents = None if last is None or last[8] is None else int(np.floor(100 * last[8] + 0.5))
                out.append(("sale", s[0], b, len(mine), last and last[0], cents, last and last[3]))
        waiting = [s for s in waiting if s[2] is not None and s[2] >= h]
        for k, mine in held.items():
            below = [c for c in mine if micros(c[4]) <= h]
            held[k] = [c for c in mine if micros(c[4]) > h] + ([max(below, key=rank)] if below else [])
        if b < 8:
            ws = max([ws, *(s[2] - delay for s in bs[b] if s[2] is not None)])
            wv = max([wv, *(micros(c[4]) - delay for c in bc[b])])
    return sorted(out, key=repr)


def some_sales(seed, n):
    r = random.Random(seed)
    at = lambda: BASE + timedelta(hours=r.choice([0, 12, 24, 400, 401]) if r.random() < 0.2 else r.randint(0, 150 * 24))
    sales = []
    for i in range(n):
        sold = at() if r.random() > 0.05 else None
        sales.append((i, None if r.random() < 0.05 else 1 if r.random() < 0.4 else r.randint(2, 9), "x", 1.0, sold, (sold or at()) + timedelta(hours=r.choice([0, 1, 30, 400])), 1))
    sales += sales[:5] + [(n, 1, None, None, None, None, None)]
    changes = [(i, 1 if r.random() < 0.4 else r.choice([2, 3, 4, None]), r.choice([0, 1, None]), r.choice("IUD"), at() if r.random() > 0.05 else None, "s", "g", "c", r.choice([None, 1.005, -955.63, 2984.2])) for i in range(n)]
    changes += changes[:9] + [(3, *changes[3][1:7], "other", 5.0), (None, 1, 0, "U", BASE + timedelta(days=40), None, None, None, 7.0)]
    return sales, changes


def test_enrichment_by_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(enrich, "KEYS", 5)
    sales, changes = some_sales(1, 160)
    s, c = spark.createDataFrame(sales, SALES), spark.createDataFrame(changes, CHANGES)
    got = [tuple(r) for r in enrich.enrich_sales(s.withColumn("batch", F.lit("own")), c.withColumn("key", F.lit(1))).collect()]
    assert sorted(got, key=repr) == plain_enrichment(sales, changes)
    assert {r[0] for r in got} == {"sale", "late"} and {r[2] for r in got} >= {1, 8}


def test_enrichment_of_empty_tables(spark):
    s, c = spark.createDataFrame([], SALES), spark.createDataFrame([], CHANGES)
    assert enrich.enrich_sales(s, c, batches=2).count() == 0
    lone = spark.createDataFrame([(1, 1, "x", 1.0, BASE, BASE, 1)], SALES)
    assert [tuple(r) for r in enrich.enrich_sales(lone, c, batches=2).collect()] == [("sale", 1, 2, 0, None, None, None)]


def test_stores_of_an_executor_share_one_bound(spark, monkeypatch):
    """A store's own cache outlives it, so many short-lived stores would add up."""
    name, seen, start = "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", [], enrich._stream
    before = spark.conf.get(name, None)
    monkeypatch.setattr(enrich, "_stream", lambda s, *a: seen.append(s.conf.get(name)) or start(s, *a))
    lone = spark.createDataFrame([(1, 1, "x", 1.0, BASE, BASE, 1)], SALES)
    assert enrich.enrich_sales(lone, spark.createDataFrame([], CHANGES), batches=2).count() == 1
    assert seen == ["true", "true"] and spark.conf.get(name, None) == before != "true"


def test_a_start_opens_one_store_a_partition(spark, monkeypatch):
    """Part of a closed store's memory is never freed, and each start opens a store a partition and stage."""
    monkeypatch.setattr(enrich, "KEYS", 5)
    seen, start = [], enrich._stream

    class Watched:
        def __init__(self, writer):
            self.writer = writer

        def start(self, path):
            seen.append(self.writer.start(path))
            return seen[-1]

    monkeypatch.setattr(enrich, "_stream", lambda *a: Watched(start(*a)))
    sales, changes = some_sales(2, 40)
    s, c = spark.createDataFrame(sales, SALES), spark.createDataFrame(changes, CHANGES)
    got = [tuple(r) for r in enrich.enrich_sales(s, c).collect()]
    assert sorted(got, key=repr) == plain_enrichment(sales, changes)
    assert len(seen) == 8 and all(len(p["stateOperators"]) == 1 for q in seen for p in q.recentProgress)
    assert sum(p["numInputRows"] for q in seen for p in q.recentProgress) >= len(sales)


def test_answer_and_prune():
    client, at = np.array([1, 1, 1, 4]), np.array([5, 5, 9, 2])
    row, n = enrich.answer(client, at, np.array([1, 1, 1, 2, 4, 1]), np.array([4, 5, 100, 7, 2, enrich.NONE]))
    assert row.tolist() == [-1, 1, 2, -1, 3, -1] and n.tolist() == [3, 3, 3, 0, 1, 3]
    assert enrich.prune(client, at, 5).tolist() == [False, True, True, True]
    assert enrich.prune(client, at, 100).tolist() == [False, False, True, True]
    assert enrich.prune(client[:0], at[:0], 1).tolist() == []


# -- op12 ----------------------------------------------------------------------


def plain_codes(rows, parts, entries, rounds):
    kept = [(i, [int(np.floor(256 * x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda part, book: min(range(len(book)), key=lambda e: (dist(part, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            found = [near(cut(v)[p], books[p]) for _, v, _ in kept]
            for e in range(len(books[p])):
                of = [cut(v)[p] for (_, v, _), f in zip(kept, found, strict=True) if f == e]
                if of:
                    books[p][e] = [sum(c) // len(of) for c in zip(*of, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, total = [], {}
    for i, v, label in kept:
        e = [near(cut(v)[p], books[p]) for p in range(parts)]
        error = sum(dist(cut(v)[p], books[p][e[p]]) for p in range(parts))
        total[label] = total.get(label, 0) + error
        out.append((i, "".join(f"{x:02x}" for x in e), error, label))
    return sorted(((i, c, e, total[label], digest) for i, c, e, label in out), key=repr)


def test_codes_by_plain_loop(spark):
    r = random.Random(3)
    rows = [(r.randint(0, 60), [r.uniform(-2, 2) for _ in range(8)], r.choice([None, 1, 1, 2])) for _ in range(90)]
    rows += [rows[0], (None, [0.0] * 8, 2), (500, None, 1), (501, [None] + [0.0] * 7, 1), (502, [float("nan")] + [0.0] * 7, 1), (503, [float("inf")] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("code", F.lit("own"))
    for entries in (4, 7, 200):
        got = sorted((tuple(x) for x in codes.encode_vectors(df, parts=4, entries=entries).collect()), key=repr)
        assert got == plain_codes(rows, 4, entries, 2)


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert codes.encode_vectors(spark.createDataFrame([], schema)).count() == 0
    assert codes.encode_vectors(spark.createDataFrame([(1, [], 1)], schema)).count() == 0
    assert codes.encode_vectors(spark.createDataFrame([(1, [0.5, 1.0, 2.0], 1)], schema), parts=2).count() == 0
    mixed = spark.createDataFrame([(1, [0.5, 1.0], 1), (2, [0.5], 1), (3, [float("3e38"), 0.0], 1)], schema)
    assert [r["vec_id"] for r in codes.encode_vectors(mixed, parts=2).collect()] == [1]


def test_later_rounds_move_only_what_changed(spark, monkeypatch):
    moved = []
    plain = codes._deltas

    def counted(parts, entries, width):
        inner = plain(parts, entries, width)

        def run(batches):
            for b in batches:
                yield b

        moved.append((inner, run))
        return inner

    monkeypatch.setattr(codes, "_deltas", counted)
    r = random.Random(5)
    df = spark.createDataFrame([(i, [float(r.randint(0, 3))] * 4, 1) for i in range(200)], "vec_id long, embedding array<double>, label int")
    got = codes.encode_vectors(df, parts=2, entries=200, rounds=3)
    assert got.count() == 200 and got.agg(F.sum("error")).first()[0] == 0 and len(moved) == 3


def test_label_sums_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(codes, "broadcast_if_small", lambda keys, n: keys)
    coded = spark.createDataFrame([(i, None if i % 3 == 0 else i % 3, "aa", i) for i in range(30)], "vec_id long, label int, code string, error long")
    labels = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    got = {r["vec_id"]: r["label_error"] for r in codes.with_label_error(coded, labels).collect()}
    assert got == {i: sum(j for j in range(30) if j % 3 == i % 3) for i in range(30)}


# -- op13 ----------------------------------------------------------------------


def plain_words(text):
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small)


def plain_hits(docs, items, size, near):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        for k in range(max(len(w) - size + 1, 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, exact, close = plain_words(text), set(), set(), set()
        for k in range(len(w)):
            stretch = set(w[k : k + near])
            for g, of in windows.items():
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    exact |= of
                if set(g) <= stretch:
                    close |= of
        named = sorted(str(i) for i in exact if i is not None)
        out.append((doc, len(w), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit), len({i for i in close if i is not None})))
    return sorted(out, key=repr)


def some_texts(seed):
    r = random.Random(seed)
    vocabulary = ["ab", "b", "C", "dé", "e9", "漢字", "g", "h"]
    text = lambda n: r.choice(["", " ", "("]) + "".join(r.choice(vocabulary) + r.choice([" ", ", ", "\n", "-", "\x00"]) for _ in range(n))
    items = [(i, text(r.choice([1, 2, 3, 4, 5, 9]))) for i in range(12)] + [(50, None), (51, ""), (52, "!?"), (3, "ab b"), (None, "e9 e9 g"), (53, "unseen ab b g")]
    docs = [(i, text(r.choice([0, 1, 3, 30, 200]))) for i in range(40)] + [(7, "ab b C"), (90, None), (None, "AB b c"), (91, "x" * 10_000)]
    return docs, items


@pytest.mark.parametrize("segment", [1, 300, 1 << 20])
def test_hits_by_plain_loop(spark, monkeypatch, segment):
    docs, items = some_texts(segment)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit("own")).repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("segment", F.lit(1))
    monkeypatch.setattr(decontam, "SEGMENT", segment)
    index = [tuple(r) for r in decontam.decontaminate(d, i, window=3, near=5).collect()]
    assert sorted(index, key=repr) == plain_hits(docs, items, 3, 5)
    alone = decontam.decontaminate(d, i, window=3, near=None)
    assert sorted((tuple(r) for r in alone.collect()), key=repr) == sorted((r[:6] for r in plain_hits(docs, items, 3, 5)), key=repr)


def test_hits_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontam.decontaminate(docs.limit(0), items).count() == 0
    assert [r["contaminated"] for r in decontam.decontaminate(docs, items.limit(0)).orderBy("doc_id").collect()] == [False, False]
    assert [r["n_hit"] for r in decontam.decontaminate(docs, items).orderBy("doc_id").collect()] == [2, 0]


def test_gaps_and_words():
    import pyarrow as pa

    x = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**28, 2**31])
    data, ends = decontam.pack_gaps(x)
    assert decontam.unpack_gaps(data).tolist() == x.tolist() and ends[-1] == len(data)
    words, n = decontam.split_words(pa.array(["Ab,c", None, "", "d", "éÀ x"]).slice(1))
    assert words.to_pylist() == ["d", "éÀ", "x"] and n.tolist() == [0, 0, 1, 2]


def test_index_holds_every_word(spark, sf):
    docs = table(spark, sf, "documents")
    index = decontam.build_index(docs)
    words = docs.agg(F.sum(F.size(F.regexp_extract_all(F.translate("text", decontam.UPPER, decontam.LOWER), F.lit(f"({decontam.WORD})"), F.lit(1))))).first()[0]
    assert index.where("term is not null").agg(F.sum("n")).first()[0] == words
