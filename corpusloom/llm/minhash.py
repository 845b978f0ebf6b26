"""MinHash near-dedup by SuperMinHash, banding, exact verification and union-find.

Every distinct shingle of a document draws one permutation of the registers and
gives the register at rank j a value in [j, j+1); a register keeps its smallest.
The ranks of an element are thus correlated, which lowers the variance of the
estimate, and a document is done as soon as its largest register lies below the
next rank: long texts stop after one or two ranks.

Steps: signatures and band hashes per document (one pass over the texts); one
representative for each distinct shingle set; candidates from buckets of equal
band hashes; comparison of the words of whole shingle sets; connected components.
Buckets of more than HOT sets are compared in blocks whose tasks return a spanning
forest of the links found; a text goes to as many tasks as its bucket has blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import UnionFind, broadcast_if_small, connected_components, hold_cache, join_split, materialize, mix64, text_batches

WORDS = 5
PERCENT = 85
REGISTERS = 125
#: Largest probability that a pair at exactly `percent` shares no band.
UNMET = 1e-6
#: Distinct sets in a bucket from which it is compared in blocks, and about how many sets and
#: shingles a block has.
HOT, BLOCK, BLOCK_SHINGLES = 50, 1000, 1_000_000

_PLACE = np.random.default_rng(20240229).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_EIGHT = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
#: Bytes of text hashed together, and of a word that is hashed by itself.
_CHUNK, _LONG = 1 << 20, 256


@lru_cache
def thresholds(percent: int) -> tuple[int, int]:
    """(bands, rows) for pairs at `percent`: the longest bands that UNMET allows."""
    rows = max((r for r in range(2, REGISTERS + 1) if unmet(percent / 100, r) <= UNMET), default=1)
    return REGISTERS // rows, rows


def unmet(p: float, rows: int) -> float:
    """The probability that a pair of similarity p shares no band of `rows` registers."""
    return (1 - p**rows) ** (REGISTERS // rows)


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word; eight bytes at a time are mixed into the hash."""
    flat = np.frombuffer(raw, dtype=np.uint8)
    edge = np.diff(np.concatenate(([True], _SPACE[flat], [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    size = end - start
    eights = np.ndarray((len(raw) + 1,), "<u8", raw + bytes(8), strides=(1,))
    out = mix64(size.astype(np.uint64) * _GOLD)
    live = np.flatnonzero(size <= _LONG)
    at = 0
    while len(live):
        part = eights[start[live] + at] & _EIGHT[np.minimum(size[live] - at, 8)]
        out[live] = mix64((out[live] ^ part) * _GOLD + part)
        at += 8
        live = live[size[live] > at]
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = int.from_bytes(blake2b(raw[start[i] : end[i]], digest_size=8).digest(), "little")
    return out, start, end


def word_hashes(text: bytes) -> np.ndarray:
    """A hash for each word of the lower-cased UTF-8 text, of any length."""
    out, at = [], 0
    while at < len(text):
        cut = len(text) if len(text) - at <= _CHUNK else next((i for i in range(at + _CHUNK, len(text)) if _SPACE[text[i]]), len(text))
        out.append(_word_hashes(text[at:cut])[0])
        at = cut
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def exact_shingles(text: str | None, k: int = WORDS) -> set[bytes]:
    """The shingles themselves, words joined by a space."""
    words = lowered(text).split()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def _shingles(words: np.ndarray, k: int) -> np.ndarray:
    n = len(words)
    if not n:
        return words
    if n < k:
        return mix64(np.array([np.sum(words * _PLACE[:n]) + np.uint64(n)], dtype=np.uint64))
    total = words[: n - k + 1] * _PLACE[0]
    for j in range(1, k):
        total = total + words[j : n - k + 1 + j] * _PLACE[j]
    return mix64(total)


def hashed(texts: list[bytes], k: int = WORDS) -> Iterator[np.ndarray]:
    """The shingle hashes of each lower-cased text in order; texts are hashed together, about a
    megabyte at a time."""
    wait: list[bytes] = []

    def flush() -> Iterator[np.ndarray]:
        if wait:
            hashes, starts, _ = _word_hashes(b"\n".join(wait))
            at = np.searchsorted(starts, np.cumsum([0] + [len(w) + 1 for w in wait]))
            yield from (_shingles(hashes[a:b], k) for a, b in zip(at[:-1], at[1:], strict=True))
            wait.clear()

    size = 0
    for b in texts:
        if size + len(b) + 1 > _CHUNK:
            yield from flush()
            size = 0
        if len(b) >= _CHUNK // 2:
            yield from flush()
            size = 0
            yield _shingles(word_hashes(b), k)
            continue
        wait.append(b)
        size += len(b) + 1
    yield from flush()


def _distinct(h: np.ndarray) -> np.ndarray:
    """np.unique, which is slower on short arrays."""
    h = np.sort(h)
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h


def shingle_sets(texts: list[str | None], k: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text (null: none)."""
    return [_distinct(h) for h in hashed([lowered(t) for t in texts], k)]


def signed_sets(texts: list[str | None], k: int = WORDS, least: int = 0) -> tuple[list[np.ndarray], list[bytes]]:
    """The sorted distinct shingle hashes of each text, and a cryptographic digest of its words.

    Equal digests stand for equal words in the same order, so for equal sets. A set of under
    `least` shingles has no bands to meet others by, so its digest is of the set itself."""
    sets, digests = shingle_sets(texts, k), []
    for t, s in zip(texts, sets, strict=True):
        words = b"\n".join(sorted(exact_shingles(t, k))) if len(s) < least else b" ".join(lowered(t).split())
        digests.append(blake2b(words, digest_size=16, person=b"set" if len(s) < least else b"text").digest())
    return sets, digests


def _times(n: int) -> np.uint64:
    return np.uint64(int(_GOLD) * n & 2**64 - 1)


def super_minhash(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """The SuperMinHash signatures (len(sets), m) of sets of 64-bit elements.

    All sets advance one rank at a time; a set leaves when its largest register
    is below the rank to come, as no later value could lower any register."""
    n = len(sets)
    regs = np.full(n * m, np.inf)
    if not n:
        return regs.reshape(0, m)
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    perm = None
    for j in range(m):
        if not len(element):
            break
        x = mix64(element + _times(2 * j + 1))
        value = j + (x >> np.uint64(11)).astype(np.float64) * 2.0**-53
        k = j + (mix64(element ^ _times(2 * j + 2)) % np.uint64(m - j)).astype(np.int64)
        if perm is None:
            register = k
        else:
            at = np.arange(len(element))
            register = perm[at, k].astype(np.int64)
            perm[at, k] = perm[:, j]
        np.minimum.at(regs, owner * m + register, value)
        live = (regs.reshape(n, m).max(axis=1) >= j + 1)[owner]
        element, owner = element[live], owner[live]
        if perm is None:
            perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 255 else np.int32), (len(element), 1))
            perm[np.arange(len(element)), k[live]] = 0
        else:
            perm = perm[live]
    return regs.reshape(n, m)


def _groups(sets: list[np.ndarray], most: int = 150_000) -> Iterator[tuple[int, int]]:
    """Ranges of sets with about `most` elements: a bound for the permutations kept."""
    start = size = 0
    for i, s in enumerate(sets):
        if size and size + len(s) > most:
            yield start, i
            start, size = i, 0
        size += len(s)
    if start < len(sets):
        yield start, len(sets)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


_SIGN = "doc_id long, n long, digest binary, bands array<long>"


def _sign(k: int, least: int, bands_of: int, rows_of: int):
    def run(batches):
        hold_cache(None)  # a worker may come from another stage
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for lo in range(0, len(ids), 500):
                sets, digests = signed_sets(texts.slice(lo, 500).to_pylist(), k, least)
                bands = []
                for a, b in _groups(sets):
                    big = [s if len(s) >= least else s[:0] for s in sets[a:b]]
                    sig = mix64(super_minhash(big).view(np.uint64) + np.uint64(1))
                    h = np.repeat((np.arange(bands_of, dtype=np.uint64) + np.uint64(1))[None, :] * _GOLD, b - a, axis=0)
                    for r in range(rows_of):
                        h = mix64(h ^ sig[:, r : bands_of * rows_of : rows_of]) + _GOLD
                    bands += [x if len(s) >= least else None for x, s in zip(signed(h), sets[a:b], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, 500).cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n", "digest", "bands"],
                )

    return run


def _rows(batches, names):
    """(key, rows) for each run of equal keys in sorted batches; keys: all but the last two columns."""
    key, have = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if row[:-2] != key:
                if have:
                    yield key, have
                key, have = row[:-2], []
            have.append(row[-2:])
    if have:
        yield key, have


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["u", "v"])


def reaches(a: int, b: int, both: int, percent: int) -> bool:
    return bool(both) and 100 * both >= percent * (a + b - both)


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets of hashes reach `percent`."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    return reaches(len(a), len(b), int((large[np.minimum(at, len(large) - 1)] == small).sum()), percent)


def linked(a: set[bytes], b: set[bytes], percent: int) -> bool:
    """Whether two sets of shingles, compared word for word, reach `percent`."""
    return reaches(len(a), len(b), len(a & b), percent)


def _verify(k: int, percent: int):
    """Rows (c, salt, other, doc, text) sorted: the centre's text comes first, and each
    further text is compared with it in full: by the hashes of all shingles, and what these
    link, by the words. Few texts are in memory."""

    def run(batches):
        hold_cache(None)
        key, centres = None, []
        for batch in batches:
            for lo in range(0, len(batch), 200):  # few texts at a time are unpacked
                part, found = batch.slice(lo, 200), []
                c, salt, other, doc, texts = (part.column(x).to_pylist() for x in ("c", "salt", "other", "doc", "text"))
                for i, s in enumerate(shingle_sets(texts, k)):
                    if (c[i], salt[i]) != key:
                        key, centres = (c[i], salt[i]), []
                    if not other[i]:
                        centres.append((s, texts[i]))  # more than one only if the id is repeated
                    elif any(alike(x, s, percent) and linked(exact_shingles(t, k), exact_shingles(texts[i], k), percent) for x, t in centres):
                        found.append((c[i], doc[i]))
                if found:
                    yield _edges(found)

    return run


def block_forest(ids: list[int], texts: list[str | None], percent: int, k: int = WORDS) -> list[tuple[int, int]]:
    """A spanning forest of all links among the texts, by counting shared shingles. Its links
    are confirmed word for word; should hashes have misled it, all pairs are compared so."""
    sets = shingle_sets(texts, k)
    out = _forest(range(len(ids)), sets, percent)
    if not all(linked(exact_shingles(texts[a], k), exact_shingles(texts[b], k), percent) for a, b in out):
        groups = UnionFind()
        whole = [exact_shingles(t, k) for t in texts]
        out = [(a, b) for b in range(len(ids)) for a in range(b) if linked(whole[a], whole[b], percent) and groups.union(a, b)]
    return [(ids[a], ids[b]) for a, b in out]


def _forest(ids, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    n = len(sets)
    size = np.array([len(s) for s in sets])
    _, col, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), size)
    keep = df[col] > 1
    row, col = row[keep], col[keep]
    both = np.zeros((n, n), dtype=np.float32)
    dense = df > 1
    name = np.cumsum(dense) - 1
    col, width = name[col], int(dense.sum())
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    step = max(256, 8_000_000 // max(n, 1))
    for lo in range(0, width, step):
        a, b = np.searchsorted(col, (lo, lo + step))
        part = np.zeros((n, min(step, width - lo)), dtype=np.float32)
        part[row[a:b], col[a:b] - lo] = 1
        both += part @ part.T
    both = both.astype(np.float64)
    i, j = np.nonzero(np.triu(100 * both >= percent * (size[:, None] + size[None, :] - both), 1))
    sets_of, out = UnionFind(), []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        if sets_of.union(a, b):
            out.append((ids[a], ids[b]))
    return out


def _blocks(k: int, percent: int):
    def run(batches):
        for _, rows in _rows(batches, ("h", "i", "j", "doc", "text")):
            yield _edges(block_forest([d for d, _ in rows], [t for _, t in rows], percent, k))

    return run


def minhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Near-duplicate groups: (doc_id, n_shingles, component_id, kept), a row for each row of `docs`.

    Words are runs of other bytes than space and \\x09-\\x0D, A-Z lower-cased. A null or
    empty text has no shingles and links with nothing; a text of fewer than `k` words
    is one shingle. Every row is returned; rows that repeat an id count as one document
    with the links of each. A row with a null id is kept, with a null component. Texts of
    any length count whole; further columns, whatever their names, are ignored; an empty
    table gives no rows. Links are confirmed on the words of whole texts; a link is missed
    only if its texts share no band (see thresholds).
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # Sets of this size or less reach `percent` only when equal, and equal sets need no bands.
    least = next(n for n in range(1, 1000) if 100 * n >= percent * (n + 1)) if percent < 100 else 1000
    bands, rows_of = thresholds(percent)
    with text_batches(docs.sparkSession):
        signs = materialize(base.mapInArrow(_sign(k, least, bands, rows_of), _SIGN), "signatures")
    real = signs.where("n > 0 and doc_id is not null")
    reps = materialize(real.groupBy("n", "digest").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.count("*").alias("size")), "sets")
    buckets = reps.where("bands is not null").select("rep", "n", F.explode("bands").alias("h"))
    sizes = buckets.groupBy("h").agg(F.count("*").alias("size"), F.sum("n").alias("all")).where("size > 1")
    shared = materialize(buckets.join(sizes, "h"), "buckets")

    pair = F.expr("""flatten(transform(sequence(1, size(m) - 1), i -> transform(
        filter(slice(m, i + 1, size(m)), b -> 100 * least(b.n, m[i - 1].n) >= {p} * greatest(b.n, m[i - 1].n)),
        b -> struct(least(m[i - 1].rep, b.rep) as x, greatest(m[i - 1].rep, b.rep) as y))))""".replace("{p}", str(percent)))
    small = shared.where(F.col("size") <= HOT).groupBy("h").agg(F.collect_list(F.struct("n", "rep")).alias("m"))
    pairs = small.select(F.explode(pair).alias("p")).select("p.x", "p.y").where("x <> y").distinct()
    pairs = materialize(pairs, "pairs")

    hot = shared.where(F.col("size") > HOT)
    ids = materialize(pairs.select("x").union(pairs.select("y")).union(hot.select("rep")).distinct().toDF("doc_id"), "ids")
    found = ids.count()
    texts = base.join(broadcast_if_small(ids, found), "doc_id", "left_semi").withColumnRenamed("doc_id", "doc")
    count = pairs.groupBy("x").agg(F.count("*").alias("c"))
    salted = pairs.join(count, "x").select(F.col("x").alias("c"), F.pmod(F.xxhash64("y"), F.ceil(F.col("c") / 200).cast("long")).alias("salt"), F.col("y").alias("doc"))
    ask = salted.withColumn("other", F.lit(1)).union(salted.select("c", "salt", F.col("c").alias("doc")).distinct().withColumn("other", F.lit(0)))
    rows = ask.join(texts, "doc").select("c", "salt", "other", "doc", "text")
    rows = rows.repartition("c", "salt").sortWithinPartitions("c", "salt", "other")
    edges = rows.mapInArrow(_verify(k, percent), "u long, v long")
    if hot.limit(1).count():
        cut = hot.withColumn("nb", F.ceil(F.greatest(F.col("size") / BLOCK, F.col("all") / BLOCK_SHINGLES)).cast("int")).withColumn("b", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
        # Buckets with the same members (a group met in several bands) are compared once.
        same = cut.groupBy("h", "size").agg(F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("of")).groupBy("size", "of").agg(F.min("h").alias("h"))
        cut = cut.join(same.select("h"), "h", "left_semi")
        mates = F.explode(F.expr("transform(sequence(0, nb - 1), o -> struct(least(b, o) as i, greatest(b, o) as j))"))
        cut = cut.select("h", F.col("rep").alias("doc"), mates.alias("t")).select("h", "t.i", "t.j", "doc")
        blocks = cut.join(texts, "doc").select("h", "i", "j", "doc", "text")
        blocks = blocks.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")
        edges = edges.union(blocks.mapInArrow(_blocks(k, percent), "u long, v long"))
    with text_batches(docs.sparkSession):  # written before links are joined, or each task would have a second worker for that
        edges = materialize(edges, "edges")
    # Equal sets are linked through their representative.
    groups = materialize(connected_components(edges), "groups")
    rep_group = reps.where("size > 1").join(groups, F.col("rep") == F.col("node"), "left").select("n", "digest", "size", F.coalesce("component_id", "rep").alias("g1"))
    out = join_split(signs.select("doc_id", "n", "digest"), materialize(rep_group, "copies"), ["n", "digest"], "size", "left")
    out = out.join(groups.select("node", F.col("component_id").alias("g2")), F.col("doc_id") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.col("g1"), F.col("g2"), F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
