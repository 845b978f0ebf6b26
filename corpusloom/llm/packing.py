"""Packing of tokenized documents by shortest-pack-first over the length histogram.

One pass tokenizes, cuts and digests the documents. The histogram of piece
lengths, at most as long as a sequence, goes to the driver, where lengths are
placed longest first into the packs with the most room; packs of one pattern are
counted, not listed. Patterns then meet the pieces again by their rank among the
pieces of their length, computed in two levels so that no length is one task's.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import broadcast_if_small, hold_cache, materialize, text_batches

LENGTH, END = 4096, 2
#: What is left of a document after whole sequences is cut into powers of two down to this.
GRAIN = 256
#: Pieces of one length that are ranked in one group.
RANKED = 1000
#: Words whose ids a worker keeps (about 200 bytes each); beyond it the cache starts anew.
CACHE = 400_000

_LETTERS, _MARKS = r"A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
_OTHER = re.compile(rf"[^{_LETTERS}{_MARKS} \n\t\r]|<\|")
_RUNS = re.compile(rf"[{_LETTERS}]+|[{_MARKS}]+")
_SPACES = " \n\t\r"
_SPACE = re.compile(f"[{_SPACES}]")


class Words:
    """Ids of a text by a tokenizer that ends words at white space, from a cache of words.

    The tokenizer drops white space, lower-cases and never joins a letter with ASCII
    punctuation other than the apostrophe, so texts of Latin letters and such marks are
    cut into runs of either kind. Chunks with other characters, apostrophes or special
    tokens go to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.seen: dict[str, bytes] = {}
        #: The chunks of the texts at hand that are no runs.
        self.odd: set[str] = set()
        pieces = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(pieces.values(), default=0) + 1, dtype=bool)
        self.last[[i for p, i in pieces.items() if p.endswith("</w>")]] = True

    def empty_cache(self) -> None:
        self.seen.clear()

    def cut(self, text: str) -> list[str]:
        out: list[str] = []
        at = 0
        while m := _OTHER.search(text, at):  # the chunk around it goes whole
            start = max(at, *(text.rfind(c, at, m.start()) + 1 for c in _SPACES))
            end = _SPACE.search(text, m.end())
            out += _RUNS.findall(text[at:start].lower())
            at = end.start() if end else len(text)
            out.append(text[start:at])
            self.odd.add(out[-1])
        out += _RUNS.findall((text[at:] if at else text).lower())
        return out

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        each, seen = [self.cut(t) for t in texts], self.seen
        new = [w for w in set().union(*each) if w not in seen]
        if len(seen) + len(new) > CACHE:
            seen.clear()
            new = list(set().union(*each))
        for lo in range(0, len(new), 50_000):
            self._learn(new[lo : lo + 50_000])
        self.odd.clear()
        return [b"".join(map(seen.__getitem__, words)) for words in each]

    def _learn(self, new: list[str]) -> None:
        """Encode new words: runs in one text, as each ends with the one id that ends a word."""
        runs, odd = [w for w in new if w not in self.odd], [w for w in new if w in self.odd]
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(runs)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.last[np.minimum(ids, len(self.last) - 1)]) + 1
        if len(ends) == len(runs):
            raw, start = ids.tobytes(), 0
            for w, end in zip(runs, (4 * ends).tolist(), strict=True):
                self.seen[w] = raw[start:end]
                start = end
        else:  # a tokenizer of another kind
            odd = new
        for w, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            self.seen[w] = array("I", e.ids).tobytes()


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


def cuts(n: int, length: int = LENGTH, grain: int = GRAIN) -> list[int]:
    """The lengths of the pieces of a document of n ids."""
    out = [length] * (n // length)
    rest, size = n % length, length // 2
    while size >= grain and rest:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return [*out, rest] if rest else out


def _pieces(path: str, length: int, end: int, keep: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches):
        of = words(path)
        hold_cache(of)
        tail = np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            for lo in range(0, len(batch), 200):
                part = batch.slice(lo, 200)
                out = [[] for _ in names]
                packed = of.packed([t or "" for t in part.column("text").to_pylist()])
                for doc, raw in zip(part.column("doc_id").to_pylist(), packed, strict=True):
                    raw += tail
                    start, total = 0, len(raw) // 4
                    view = memoryview(raw)
                    for n in cuts(total, length):
                        for column, v in zip(out, (doc, start, n, zlib.crc32(view[4 * start : 4 * (start + n)]), total), strict=True):
                            column.append(v)
                        start += n
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)
            part = batch = packed = None
        if not keep:
            hold_cache(None)

    return run


def shortest_pack_first(histogram: dict[int, int], length: int = LENGTH) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Place `histogram` (piece length: number) into packs of `length`.

    Returns intervals (piece length, first rank, ranks, first pack, offset): the pieces
    of a length with ranks from the first on lie in as many consecutive packs, all at the
    same offset; and the number of packs. Each length adds at most two groups of packs of
    one pattern and splits one, so the groups stay within thrice the number of lengths.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # space left: groups (first pack, packs)
    spaces: list[int] = []  # a heap of the spaces that occur, largest first
    out, packs = [], 0

    def put(space: int, first: int, n: int) -> None:
        if n and space:
            if not room.get(space):
                heappush(spaces, -space)
            room.setdefault(space, []).append((first, n))

    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left:
            while spaces and not room.get(-spaces[0]):
                heappop(spaces)
            if not spaces or -spaces[0] < size:
                break
            space = -spaces[0]
            first, n = room[space].pop()
            use = min(n, left)
            out.append((size, rank, use, first, length - space))
            put(space, first + use, n - use)
            put(space - size, first, use)
            rank, left = rank + use, left - use
        fit = length // size
        for n, copies in ((left // fit, fit), (1 if left % fit else 0, left % fit)):
            for c in range(copies if n else 0):
                out.append((size, rank, n, packs, c * size))
                rank += n
            put(length - copies * size, packs, n)
            packs += n
    return out, packs


def _placed(starts: np.ndarray, sizes: np.ndarray, first: np.ndarray, offset: np.ndarray):
    """Join ranks to packs: intervals sorted by (length, rank), found by binary search."""

    def run(batches):
        for batch in batches:
            n, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(starts, n * (1 << 48) + rank, side="right") - 1
            pack = first[at] + rank - (starts[at] & ((1 << 48) - 1))
            keep = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(pack), pa.array(offset[at])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, id_col: str = "doc_id", text_col: str = "text", keep_words: bool = True) -> DataFrame:
    """Pieces of all documents in sequences of at most `length` tokens.

    (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each
    piece. A null or empty text is the end id alone; a text of any length is cut whole; every
    row counts, rows that repeat an id or have none too. An empty table gives no rows; further
    columns, whatever their names, are ignored. keep_words: whether a worker's
    words stay for its next task; a pipeline, whose workers have other stages to serve, says no.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with text_batches(docs.sparkSession):
        pieces = materialize(base.mapInArrow(_pieces(tokenizer, length, end, keep_words), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `length` rows
    intervals, _ = shortest_pack_first(histogram, length)
    intervals.sort()
    columns = [np.array([x[i] for x in intervals], dtype=np.int64) for i in range(5)]
    # The pieces of a length are ranked in groups of about RANKED, however many there are.
    groups = docs.sparkSession.createDataFrame([(size, -(-n // RANKED)) for size, n in histogram.items()], "length long, salts long")
    salted = pieces.join(F.broadcast(groups), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), "salts")).drop("salts")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    offsets = materialize(counts.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before")), "lengths")
    offsets = broadcast_if_small(offsets, sum(-(-n // RANKED) for n in histogram.values()))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = salted.withColumn("own", own).join(offsets, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("before"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    place = _placed(columns[0] * (1 << 48) + columns[1], columns[2], columns[3], columns[4])
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(place, schema)
