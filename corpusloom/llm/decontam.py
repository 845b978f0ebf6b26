"""Benchmark decontamination by a distributed positional inverted index.

`build_index` writes the postings of every word of every document. A task cuts its documents
into segments of bounded size; a segment has one row for each of its terms, with the term's
positions as gaps of seven bits a byte, and one row that lists its documents. No row is
shuffled, a frequent term is spread over all segments, and a search reads nothing but the rows
of its own terms.

`find` cuts test texts into windows, takes each window's terms from the rarest to the most
frequent by their counts over the whole index, and sends a window only to the segments that
hold its rarest term. There the candidates are that term's positions; the lists of the
other terms, less their offsets, are intersected with them one by one. All windows of a
segment are searched at once: a posting is one number (term, position), so each step is one
binary search of all candidates, and those that fail go. Candidates are first held to the
neighbourhood `near`, which gives the proximity matches too: the window's distinct words
within `near` words of one another, in any order.

Words are compared themselves (a term is its text), so nothing rests on hashes. Null and empty
texts have no words; a document without words is in the result with zeros. An item without an
id marks hit words, but isn't counted. Repeated rows of documents are rows of their own;
repeated items and equal windows count once. Texts are read whole: a very long one is a
segment by itself. Empty tables give no rows, or no hits. Extra columns are not read. A task
holds one segment's lists of test terms and the windows that begin there: about 300 bytes for
each window of the test set at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import BROADCAST_KEYS, broadcast_if_small, materialize, release

#: Bytes of text in a segment.
SEGMENT = 12 << 20
#: Words of a window, and the stretch within which its words are a proximity match.
WINDOW, NEAR = 10, 14

# What a word is made of; capital letters become small ones.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[: 0x80] = 0
for _c in "0123456789" + LOWER:
    _BYTES[ord(_c)] = ord(_c)
for _u, _l in zip(UPPER, LOWER, strict=True):
    _BYTES[ord(_u)] = ord(_l)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts one after another, number of words of each text)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if not len(texts) or data is None or offsets[-1] == offsets[0]:
        return pa.array([], pa.large_string()), np.zeros(len(texts), np.int64)
    low = _BYTES[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]]
    ends = offsets - offsets[0]
    inside = low != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = ends[:-1][ends[:-1] < len(low)]
    begins[edge] = inside[edge]  # a word ends with its text
    kept = low[inside]
    at = np.append(np.flatnonzero(begins[inside]), len(kept))
    words = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(kept))
    return words, np.diff(np.searchsorted(np.flatnonzero(begins), ends))


def pack_gaps(gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, end of each number): seven bits a byte, lowest first, the high bit for more."""
    size = np.ones(len(gaps), np.int64)
    for k in range(1, 5):
        size += gaps >= 1 << 7 * k
    ends = np.cumsum(size)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    rest, at, size = gaps, ends - size, size
    while len(rest):
        more = size > 1
        out[at] = (rest & 127) | (more.astype(np.int64) << 7)
        rest, at, size = rest[more] >> 7, at[more] + 1, size[more] - 1
    return out, ends


def unpack_gaps(data: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(data < 128)
    first = np.append(0, last[:-1] + 1)
    shift = np.arange(len(data)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * shift, first)


def _segment(ids: pa.Array, texts: pa.Array, number: int):
    """The rows of one segment: its terms, and its documents."""
    words, counts = split_words(texts)
    yield [pa.array([number], pa.int64()), pa.nulls(1, pa.string()), pa.array([len(words)], pa.int64()), pa.nulls(1, pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([counts], pa.list_(pa.int64()))]
    if not len(words):
        return
    coded = words.dictionary_encode()
    codes, terms = np.asarray(coded.indices), coded.dictionary.cast(pa.string())
    order = np.argsort(codes, kind="stable")
    n = np.bincount(codes, minlength=len(terms))
    ends = np.cumsum(n)
    gaps = np.diff(order, prepend=0)
    gaps[ends - n] = order[ends - n]  # a term's first position is whole
    data, at = pack_gaps(gaps)
    cut = np.append(0, at[ends - 1]).astype(np.int32)
    blobs = pa.BinaryArray.from_buffers(pa.binary(), len(terms), [None, pa.py_buffer(cut), pa.py_buffer(data)])
    for i in range(0, len(terms), 50_000):
        m = min(50_000, len(terms) - i)
        yield [pa.array(np.full(m, number), pa.int64()), terms.slice(i, m), pa.array(n[i : i + m], pa.int64()), blobs.slice(i, m), pa.nulls(m, pa.list_(ids.type)), pa.nulls(m, pa.list_(pa.int64()))]


_NAMES = ["segment", "term", "n", "positions", "ids", "words"]


def _index(batches):
    from pyspark import TaskContext

    base, k = TaskContext.get().partitionId() << 24, 0
    held, size = [], 0

    def flush():
        rows = pa.Table.from_batches(held).combine_chunks()
        ids, texts = (rows.column(c).combine_chunks() if rows.num_rows else pa.array([], rows.schema.field(c).type) for c in ("id", "text"))
        for columns in _segment(ids, texts, base + k):
            yield pa.RecordBatch.from_arrays(columns, _NAMES)

    for batch in batches:
        length = np.append(0, np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0))))
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(length, length[at] + SEGMENT - size, "right")) - 1) if size < SEGMENT else at
            held.append(batch.slice(at, to - at))
            size += int(length[to] - length[at])
            at = to
            if size >= SEGMENT or at < len(batch):
                yield from flush()
                held, size, k = [], 0, k + 1
                release()
    if held:
        yield from flush()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written index of every word of `docs`: (segment, term, n, positions) for each
    term of a segment, and a row without term with the segment's ids and numbers of words."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return materialize(rows.mapInArrow(_index, f"segment long, term string, n long, positions binary, ids array<{kind}>, words array<long>"), "index")


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(window, terms, item_id): every run of `size` words, or all of a shorter text."""
    words = F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(f"({WORD})"), F.lit(1))
    rows = items.select(F.col(id_col).cast("string").alias("item_id"), words.alias("w")).where(F.size("w") > 0)
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))))
    terms = F.slice("w", F.col("at"), F.lit(size))
    return rows.select(F.concat_ws(" ", terms).alias("window"), terms.alias("terms"), "item_id").distinct()


def _plan(windows: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(each window's (count, offset, term) from the rarest on, all terms of such windows).
    A window with a term that no document has is left out."""
    one = windows.select("window", "terms").dropDuplicates(["window"])
    each = one.select("window", F.size("terms").alias("length"), F.posexplode("terms").alias("offset", "term"))
    terms = materialize(each.select("term").distinct(), "terms")
    known = broadcast_if_small(terms, terms.count())
    counts = index.where("term is not null").select("term", "n").join(known, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("count"))
    counts = materialize(counts, "counts")
    ranked = each.join(broadcast_if_small(counts, counts.count()), "term").groupBy("window", "length").agg(F.array_sort(F.collect_list(F.struct("count", "offset", "term"))).alias("by"))
    return materialize(ranked.where(F.size("by") == F.col("length")).select("window", "by"), "windows"), terms


def _near(keys, code, at, valid, doc_end, doc_start, near):
    """Which candidates (positions of the rarest terms) have the other terms near by, and within one stretch."""
    big = np.int64(1) << 32
    live = np.arange(len(at))
    for j in range(1, code.shape[1]):
        c, p = code[live, j], at[live]
        lo = np.maximum(p - near + 1, doc_start[live])
        i = np.searchsorted(keys, c * big + lo)
        there = (i < len(keys)) & (keys[np.minimum(i, len(keys) - 1)] <= c * big + np.minimum(p + near - 1, doc_end[live] - 1))
        live = live[there | ~valid[live, j]]
    ok = np.zeros(len(at), bool)
    for back in range(near):  # stretches that begin so far before the candidate
        todo = live[~ok[live]]
        start = at[todo] - back
        todo, start = todo[start >= doc_start[todo]], start[start >= doc_start[todo]]
        stop = np.minimum(start + near, doc_end[todo])
        fits = np.ones(len(todo), bool)
        for j in range(code.shape[1]):
            i = np.searchsorted(keys, code[todo, j] * big + start)
            fits &= ~valid[todo, j] | ((i < len(keys)) & (keys[np.minimum(i, len(keys) - 1)] < code[todo, j] * big + stop))
        ok[todo[fits]] = True
    return live, ok[live]


def _search(near: int | None):
    names = ["segment", "row", "doc_id", "n_words", "n_hit", "windows", "near"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        about = left.filter(pc.is_null(left["term"]))
        segment = about["segment"][0].as_py()
        ids = about["ids"].combine_chunks().flatten()
        words = np.asarray(about["words"].combine_chunks().flatten())
        ends = np.cumsum(words)
        total = int(ends[-1]) if len(ends) else 0
        hit, found = np.zeros(total + 1, np.int64), {True: ([], []), False: ([], [])}
        terms = left.filter(pc.is_valid(left["term"]))
        if right.num_rows and terms.num_rows:
            n = np.asarray(terms["n"])
            blobs = terms["positions"].combine_chunks()
            gaps = unpack_gaps(np.frombuffer(b"".join(blobs.to_pylist()), np.uint8))
            first = np.cumsum(n) - n
            run_up = np.cumsum(gaps)
            positions = run_up - np.repeat(run_up[first] - gaps[first], n)
            keys = np.repeat(np.arange(len(n)), n) * (np.int64(1) << 32) + positions
            by = right["by"].combine_chunks()
            size = np.asarray(pc.list_value_length(by)).astype(np.int64)
            flat = by.flatten()
            found_at = pc.index_in(flat.field("term"), value_set=terms["term"].combine_chunks())
            row = np.repeat(np.arange(len(size)), size)
            column = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            code = np.full((len(size), int(size.max())), -1, np.int64)
            offset = np.zeros_like(code)
            code[row, column] = np.asarray(pc.fill_null(found_at, -1))
            offset[row, column] = np.asarray(flat.field("offset"))
            valid = np.arange(code.shape[1])[None, :] < size[:, None]
            whole = ~((code < 0) & valid).any(1)  # all terms are in this segment
            which = np.flatnonzero(whole)
            for some in np.array_split(which, max(1, int(n[code[which, 0]].sum()) // 500_000 + 1)) if len(which) else ():
                k = n[code[some, 0]]
                w = np.repeat(some, k)
                at = positions[np.repeat(first[code[some, 0]] - np.cumsum(k) + k, k) + np.arange(len(w))]
                doc = np.searchsorted(ends, at, "right")
                if near:
                    live, close = _near(keys, code[w], at, valid[w], ends[doc], ends[doc] - words[doc], near)
                    w, doc, at = w[live], doc[live], at[live]
                    found[False][0].extend(doc[close])
                    found[False][1].extend(w[close])
                start = at - offset[w, 0]
                exact = (start >= ends[doc] - words[doc]) & (start + size[w] <= ends[doc])
                w, doc, start = w[exact], doc[exact], start[exact]
                for j in range(1, code.shape[1]):
                    want = code[w, j] * (np.int64(1) << 32) + start + offset[w, j]
                    i = np.searchsorted(keys, want)
                    there = ~valid[w, j] | ((i < len(keys)) & (keys[np.minimum(i, len(keys) - 1)] == want))
                    w, doc, start = w[there], doc[there], start[there]
                np.add.at(hit, start, 1)
                np.add.at(hit, start + size[w], -1)
                found[True][0].extend(doc)
                found[True][1].extend(w)
        inside = np.append(0, np.cumsum(np.cumsum(hit)[:total] > 0))
        lists = []
        for exact in (True, False):
            pairs = np.unique(np.column_stack([np.array(found[exact][i], np.int64) for i in (0, 1)]), axis=0)
            cut = np.searchsorted(pairs[:, 0], np.arange(len(ids) + 1)).astype(np.int32)
            names_of = right["window"].combine_chunks().take(pa.array(pairs[:, 1])) if len(pairs) else pa.array([], pa.string())
            lists.append(pa.ListArray.from_arrays(pa.array(cut), names_of))
        return pa.Table.from_arrays([pa.array(np.full(len(ids), segment), pa.int64()), pa.array(np.arange(len(ids)), pa.int64()), ids, pa.array(words, pa.int64()), pa.array(inside[ends] - inside[ends - words], pa.int64()), *lists], names)

    return run


def find(index: DataFrame, windows: DataFrame, near: int | None = NEAR) -> DataFrame:
    """(segment, row, doc_id, n_words, n_hit, windows, near) for each document of the index: its
    words inside exact matches, the windows that occur, and those whose words are near."""
    kind = index.schema["ids"].dataType.elementType.simpleString()
    planned, terms = _plan(windows, index)
    wanted = broadcast_if_small(terms, terms.count())
    lists = index.where("term is not null").join(wanted, "term", "left_semi").select(*_NAMES).union(index.where("term is null").select(*_NAMES))
    rarest = planned.withColumn("term", F.col("by")[0]["term"])
    n = planned.count()
    there = index.where("term is not null").select("segment", "term").join(F.broadcast(rarest) if n <= BROADCAST_KEYS // 20 else rarest, "term").select(F.col("segment").alias("part"), "window", "by")
    return lists.groupBy("segment").cogroup(there.groupBy("part")).applyInArrow(_search(near), f"segment long, row long, doc_id {kind}, n_words long, n_hit long, windows array<string>, near array<string>")


def _digest(items: Column) -> Column:
    return F.sha2(F.concat_ws(",", items), 256)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, near: int | None = NEAR) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each document and, unless
    `near` is None, n_near: the items with a window whose words stand within `near` words."""
    windows = materialize(item_windows(items, size=window), "items")
    found = materialize(find(build_index(docs), windows, near), "found")
    of = windows.where("item_id is not null").select("window", "item_id")
    some = found.where((F.size("near") > 0) | (F.size("windows") > 0))
    tagged = lambda c, exact: F.transform(c, lambda w: F.struct(w.alias("window"), F.lit(exact).alias("exact")))
    each = some.select("segment", "row", F.explode(F.concat(tagged("windows", True), tagged("near", False))).alias("x")).select("segment", "row", "x.*")
    items_of = each.join(broadcast_if_small(of, of.count()), "window").groupBy("segment", "row").agg(F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("item_id")))).alias("items"), F.countDistinct("item_id").alias("n_near"))
    # `row` is unique in a segment; documents that nothing matches never meet a shuffle
    matched = some.select("segment", "row", "doc_id", "n_words", "n_hit").join(items_of, ["segment", "row"], "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    clean = found.where((F.size("near") == 0) & (F.size("windows") == 0)).select("doc_id", "n_words", "n_hit", F.array().cast("array<string>").alias("items"), F.lit(0).cast("long").alias("n_near"))
    every = matched.select("doc_id", "n_words", "n_hit", "items", F.coalesce("n_near", F.lit(0)).alias("n_near")).union(clean)
    out = every.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), _digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near")
    return out if near else out.drop("n_near")


#: DuckDB. A proximity match is looked for around the window's rarest word.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}'), []) AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
x AS (SELECT DISTINCT item_id, m, array_to_string(w[k : k + m - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS m, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
p AS (SELECT r, m, k, array_to_string(w[k : k + m - 1], ' ') AS g
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM x) WHERE len(w) >= m)),
hit AS (SELECT p.r, p.m, p.k, x.item_id FROM p JOIN x USING (m, g)),
n AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(k, k + m)) AS j FROM (SELECT DISTINCT r, m, k FROM hit)) GROUP BY r),
o AS (SELECT r, k, w[k] AS t FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS k FROM d)),
f AS (SELECT t, count(*) AS c FROM o GROUP BY t),
q AS (SELECT g, ws, arg_min(t, (c, t)) AS t FROM (SELECT g, ws, unnest(ws) AS t FROM (SELECT DISTINCT g, list_distinct(string_split(g, ' ')) AS ws FROM x)) LEFT JOIN f USING (t) GROUP BY g, ws HAVING count(c) = count(*)),
z AS (SELECT DISTINCT o.r, q.g FROM q JOIN o USING (t) JOIN d ON d.r = o.r
  WHERE len(list_filter(range(greatest(o.k - {NEAR} + 1, 1), o.k + 1), lambda s: list_has_all(d.w[s : s + {NEAR} - 1], q.ws))) > 0),
y AS (SELECT r, count(DISTINCT item_id) AS n_near FROM z JOIN x USING (g) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::varchar, ',' ORDER BY item_id::varchar) AS s FROM hit GROUP BY r)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items, sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(n_near, 0)::bigint AS n_near
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r) LEFT JOIN y USING (r)
"""
