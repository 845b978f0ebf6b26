"""SentencePiece encoding with source offsets, decoding, and unigram token counts.

The model file is read with a small protobuf reader. Normalisation walks the
text with the longest prefixes of the compiled character map (a double array
trie and its replacement strings) and keeps, for each byte it puts out, the
source byte it came from, so every piece is projected onto original bytes.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import hold_cache

MARK = "▁"
#: Piece kinds of the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words whose encodings a worker keeps (about 200 bytes each); beyond it the cache starts anew.
CACHE = 1_000_000


def _fields(raw: bytes):
    """(field number, value) of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = out = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        elif kind == 1:
            value, at = raw[at : at + 8], at + 8
        elif kind == 5:
            value, at = raw[at : at + 4], at + 4
        else:
            n = varint()
            value, at = raw[at : at + n], at + n
        yield tag >> 3, value


class CharMap:
    """The compiled character map: longest-prefix replacement of byte strings."""

    def __init__(self, blob: bytes) -> None:
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.unit = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.text = blob[4 + size :]
        else:
            self.unit, self.text = (), b""

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) of the longest entry that starts at `at`."""
        unit = self.unit
        if not unit:
            return None

        def offset(u: int) -> int:
            return (u >> 10) << ((u & 512) >> 6)

        node, found = offset(unit[0]), None
        for i in range(at, len(raw)):
            node ^= raw[i]
            if node >= len(unit) or (unit[node] & (1 << 31 | 255)) != raw[i]:
                break
            u = unit[node]
            node ^= offset(u)
            if u >> 8 & 1:
                value = unit[node] & 0x7FFFFFFF
                found = i + 1 - at, self.text[value : self.text.index(b"\0", value)]
        return found


class Model:
    """A SentencePiece BPE model: pieces, scores, kinds and the normaliser's settings."""

    def __init__(self, raw: bytes) -> None:
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.byte_fallback = False
        self.dummy_prefix = self.squeeze = self.escape = True
        self.unk_surface = " ⁇ "
        charsmap = b""
        for f, v in _fields(raw):
            if f == 1:
                piece, score, kind = "", 0.0, NORMAL
                for g, w in _fields(v):
                    if g == 1:
                        piece = w.decode()
                    elif g == 2:
                        score = struct.unpack("<f", w)[0]
                    elif g == 3:
                        kind = w
                self.pieces.append(piece)
                self.scores.append(score)
                self.kinds.append(kind)
            elif f == 2:
                for g, w in _fields(v):
                    if g == 35:
                        self.byte_fallback = bool(w)
                    elif g == 44:
                        self.unk_surface = w.decode()
            elif f == 3:
                for g, w in _fields(v):
                    if g == 2:
                        charsmap = w
                    elif g == 3:
                        self.dummy_prefix = bool(w)
                    elif g == 4:
                        self.squeeze = bool(w)
                    elif g == 5:
                        self.escape = bool(w)
        self.map = CharMap(charsmap)
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] in (NORMAL, USER, UNUSED)}
        self.unk = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        # Lower is merged first: the score falls, equal scores go from left to right.
        self.rank = {p: -self.scores[i] for p, i in self.ids.items()}
        if any(k in (USER, UNUSED) for k in self.kinds):
            raise ValueError("models with user-defined or unused pieces are not supported")
        #: Normalised text can be cut where no piece holds both neighbours: before a mark,
        #: and between letters (with whatever pieces join to letters) and other characters.
        self.cuts = self.escape and not any(MARK in p.lstrip(MARK) for p in self.ids)
        beside = {c for p in self.ids for x, y in zip(p, p[1:], strict=False) if x.isalpha() != y.isalpha() for c in (x, y) if not c.isalpha()} - {MARK}
        while grown := {c for p in self.ids for x, y in zip(p, p[1:], strict=False) if (x in beside) != (y in beside) for c in (x, y) if not c.isalpha()} - beside - {MARK}:
            beside |= grown
        odd = "".join(re.escape(c) for c in sorted({c for p in self.ids for c in p}) if not c.isalpha() and re.match(r"[^\W\d_]", c))
        word = rf"[^\W\d_{odd}]" + (f"|[{re.escape(''.join(sorted(beside)))}]" if beside else "")
        other = f"(?!{word})[^{MARK}]" if beside else rf"(?!{MARK})[\W\d_{odd}]"
        self._cut = re.compile(f"{MARK}*(?:(?:{word})+|(?:{other})+)|{MARK}+" if beside else f"{MARK}*(?:{word}+|(?:{other})+)|{MARK}+")
        self._word = re.compile(self._cut.pattern.replace(MARK, " "))
        if any(len(self._cut.findall(p)) > 1 for p in self.ids):  # some piece would be cut
            self.cuts = False
        #: Words of the plain path (a space for the mark) to their packed ids.
        self.seen: dict[str, bytes] = {}
        self.code = "H" if len(self.pieces) <= 65536 else "I"
        self.plain_text = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.plain_size = np.array([len(x) for x in self.plain_text], dtype=np.int64)
        digits = np.zeros((len(self.pieces), len(str(len(self.pieces))) + 1), dtype=np.uint8)
        for i in range(len(self.pieces)):
            x = f"{i},".encode()
            digits[i, : len(x)] = list(x)
        self.digits = digits

    def empty_cache(self) -> None:
        self.seen.clear()

    # -- normalisation -------------------------------------------------------

    def normalise(self, text: str) -> tuple[str, list[int] | None]:
        """The normalised text and, for each of its bytes and the end, the source byte it
        starts from; None stands for the plain case, in which only the dummy prefix and
        the escaped spaces differ from the source."""
        if not self.map.unit and not self.squeeze:
            out = text.replace(" ", MARK) if self.escape else text
            return ((MARK if self.escape else " ") + out if self.dummy_prefix and text else out), None
        raw, at, out, align = text.encode("utf-8", "surrogatepass"), 0, [], []
        space = MARK.encode() if self.escape else b" "
        while at < len(raw):
            hit = self.map.longest(raw, at)
            if hit:
                n, piece = hit
            else:
                n = 1
                while at + n < len(raw) and raw[at + n] & 0xC0 == 0x80:
                    n += 1
                piece = raw[at : at + n]
            for b in piece:
                out.append(bytes([b]))
                align.append(at)
            at += n
        flat = b"".join(out)
        keep, where, prev = [], [], self.squeeze
        if self.dummy_prefix and flat.strip(b" " if self.squeeze else b""):
            first = next((a for b, a in zip(flat, align, strict=True) if b != 32 or not self.squeeze), 0)
            keep.append(space)
            where += [first] * len(space)
            prev = self.squeeze
        for b, a in zip(flat, align, strict=True):
            if b == 32:
                if prev and self.squeeze:
                    continue
                keep.append(space)
                where += [a] * len(space)
                prev = True
            else:
                keep.append(bytes([b]))
                where.append(a)
                prev = False
        if self.squeeze and keep and keep[-1] == space and flat.endswith(b" "):
            while keep and keep[-1] == space:
                keep.pop()
                del where[-len(space) :]
        return b"".join(keep).decode("utf-8", "replace"), [*where, len(raw)]

    # -- byte-pair merges ----------------------------------------------------

    def merge(self, word: str) -> list[str]:
        """The pieces of a string: the best-scored adjacent pair merges first, leftmost of equals."""
        rank, parts = self.rank, list(word)
        if len(parts) > 40:
            return self._merge_long(parts)
        while len(parts) > 1:
            best, at, prev = None, -1, parts[0]
            for i, p in enumerate(parts[1:]):
                r = rank.get(prev + p)
                if r is not None and (best is None or r < best):
                    best, at = r, i
                prev = p
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same by a heap, for strings of any length."""
        rank, n = self.rank, len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []

        def offer(i: int, j: int) -> None:
            r = rank.get(parts[i] + parts[j])
            if r is not None:
                heappush(heap, (r, i, len(parts[i]) + len(parts[j]), j))

        for i in range(n - 1):
            r = rank.get(parts[i] + parts[i + 1])
            if r is not None:
                heap.append((r, i, len(parts[i]) + len(parts[i + 1]), i + 1))
        heapify(heap)
        while heap:
            _, i, size, j = heappop(heap)
            if not parts[i] or not parts[j] or right[i] != j or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i] += parts[j]
            parts[j] = ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
                offer(i, right[j])
            if left[i] >= 0:
                offer(left[i], i)
        return [p for p in parts if p]

    def to_ids(self, parts: list[str]) -> list[tuple[int, int]]:
        """(id, bytes covered) of each piece; unknown characters fall back to their bytes,
        or to one id for a run of them."""
        out: list[tuple[int, int]] = []
        run = False
        for p in parts:
            i = self.ids.get(p)
            n = len(p.encode("utf-8", "surrogatepass"))
            if i is not None:
                out.append((i, n))
            elif self.byte_fallback:
                raw = p.encode("utf-8", "surrogatepass")
                out += [(self.bytes[b], 1) for b in raw]
            elif run:
                out[-1] = (self.unk, out[-1][1] + n)
            else:
                out.append((self.unk, n))
            run = i is None and not self.byte_fallback
        return out

    def pieces_of(self, text: str) -> list[tuple[int, int]]:
        """(id, bytes covered) of all pieces of normalised text."""
        if not self.cuts:
            return self.to_ids(self.merge(text))
        return self.to_ids([p for word in self._cut.findall(text) for p in self.merge(word)])

    def encode(self, text: str) -> list[int]:
        return [i for i, _ in self.pieces_of(self.normalise(text)[0])]

    def encode_spans(self, text: str) -> list[tuple[int, int, int]]:
        """(id, start, end) of each piece, in bytes of the original text."""
        flat, align = self.normalise(text)
        if align is None:  # each mark of three bytes stands for one space, the first for nothing
            align, at = [], 0
            for n, c in enumerate(flat):
                raw = c.encode("utf-8", "surrogatepass")
                if c == MARK and not (n == 0 and self.dummy_prefix):
                    source = text[n - (1 if self.dummy_prefix else 0)]
                    align += [at] * len(raw)
                    at += len(source.encode())
                elif n == 0 and self.dummy_prefix:
                    align += [0] * len(raw)
                else:
                    align += range(at, at + len(raw))
                    at += len(raw)
            align.append(at)
        out, at = [], 0
        for i, n in self.pieces_of(flat):
            out.append((i, align[at], align[at + n]))
            at += n
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: marks become spaces, byte runs characters (bad bytes U+FFFD),
        the space of the dummy prefix goes."""
        out, raw, first = [], bytearray(), True
        for i in [*ids, -1]:
            b = self.byte_of.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()
                first = False
            if i < 0 or self.kinds[i] == CONTROL:
                continue
            if i == self.unk:
                out.append(self.unk_surface)
                first = False
                continue
            p = self.pieces[i]
            if first and (self.dummy_prefix or self.squeeze) and p.startswith(MARK):
                p = p[1:] if not self.squeeze else p.lstrip(MARK)
            first = False
            out.append(p.replace(MARK, " "))
        return "".join(out)

    def digest(self, text: str) -> tuple[int, str, str, int]:
        """(number of ids, SHA-256 of the joined ids, SHA-256 of the decoded text, CRC-32 of
        the source byte at which each piece ends, as 64-bit integers)."""
        if not self.cuts or self.map.unit or self.squeeze or not self.dummy_prefix or not self.byte_fallback or not text or MARK in text:
            spans = self.encode_spans(text)
            ids = [i for i, _, _ in spans]
            ends = np.array([e for _, _, e in spans], dtype=np.int64)
            return len(ids), _sha(",".join(map(str, ids)).encode()), _sha(self.decode(ids).encode("utf-8", "surrogatepass")), zlib.crc32(ends.tobytes())
        # Plain normalisation: a space stands for each mark, so words are cut, looked up and
        # projected as they stand; each piece covers its own bytes, the first mark none.
        words, seen = self._word.findall(" " + text), self.seen
        try:
            packed = b"".join([seen[w] for w in words])
        except KeyError:
            new = {w for w in words if w not in seen}
            if len(seen) + len(new) > CACHE:
                seen.clear()
                new = set(words)
            for w in new:
                seen[w] = array(self.code, [i for i, _ in self.to_ids(self.merge(w.replace(" ", MARK)))]).tobytes()
            packed = b"".join([seen[w] for w in words])
        ids = np.frombuffer(packed, dtype=self.code)
        joined = self.digits[ids]
        joined = joined[joined > 0][:-1].tobytes()
        ends = np.cumsum(self.plain_size[ids]) - 1
        raw = b"".join(map(self.plain_text.__getitem__, ids.tolist()))[1:]
        try:
            raw.decode()
        except UnicodeDecodeError:
            raw = self.decode(ids.tolist()).encode("utf-8", "surrogatepass")
        return len(ids), _sha(joined), _sha(raw), zlib.crc32(ends.tobytes())


def _utf8(raw: bytes) -> str:
    """Bytes as text; each byte that is no part of a character becomes U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode("utf-8"))
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def _sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


def _digest(path: str):
    def run(batches):
        model = load(path)
        hold_cache(model)
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                rows = [model.digest(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64())))],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ends_crc32"],
                )

    return run


def sentencepiece_digest(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each text: (doc_id, n_tokens, ids_sha256, decoded_sha256, ends_crc32).

    A row for each row of `docs`, nulls and empty texts giving no ids; repeated and null
    ids stay. Texts of any length are encoded whole; further columns, whatever their names,
    are ignored, and an empty table gives no rows. ends_crc32 digests the source byte at
    which each piece ends.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(_digest(model_path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ends_crc32 long")


def _spans(path: str):
    def run(batches):
        model = load(path)
        kind = pa.list_(pa.struct([("id", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows = [[{"id": i, "start": a, "end": b} for i, a, b in model.encode_spans(t or "")] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "pieces"])

    return run


def sentencepiece_spans(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pieces): each piece's id and its span in bytes of the original text."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(_spans(model_path), "doc_id long, pieces array<struct<id:int,start:long,end:long>>")


# -- token counts by a shared trie ------------------------------------------


class TrieCounter:
    """Token counts of pre-tokens under a unigram model.

    The pieces of the vocabulary score log(1 / (id + 2)), falling with their rank; a
    pre-token's segmentation has the highest sum, of equal sums the one whose last piece
    is longest, and so on from the end. A character that no piece has counts as its UTF-8
    bytes, each with the score UNSEEN. A space stands for the mark. Distinct pre-tokens form a trie; it is walked in
    sorted order, so the forward scores of a shared prefix are computed once, and only the
    current path is held. The counts at the terminals are kept for the texts to come.
    """

    UNSEEN = -20.0

    def __init__(self, pieces: list[str], cut: re.Pattern) -> None:
        self.score = {p.replace(MARK, " "): -log(i + 2.0) for i, p in reversed(list(enumerate(pieces)))}
        self.cut = cut
        sizes: dict[str, set[int]] = {}
        for p in self.score:
            sizes.setdefault(p[-1], set()).add(len(p))
        self.sizes = {c: sorted(s, reverse=True) for c, s in sizes.items()}
        self.count: dict[str, int] = {}

    def empty_cache(self) -> None:
        self.count.clear()

    def add(self, words: list[str]) -> None:
        """Insert pre-tokens and store their terminal counts."""
        best, tokens, path = [0.0], [0], ""
        score, sizes, count = self.score, self.sizes, self.count
        for word in sorted(words):
            same = 0
            for a, b in zip(path, word, strict=False):
                if a != b:
                    break
                same += 1
            del best[same + 1 :], tokens[same + 1 :]
            for i in range(same + 1, len(word) + 1):
                top, n = -1e300, 0
                for k in sizes.get(word[i - 1], ()):
                    if k <= i:
                        s = score.get(word[i - k : i])
                        if s is not None and best[i - k] + s > top:
                            top, n = best[i - k] + s, tokens[i - k] + 1
                if 1 not in sizes.get(word[i - 1], ()) or word[i - 1] not in score:
                    raw = len(word[i - 1].encode("utf-8", "surrogatepass"))
                    s = best[i - 1] + raw * self.UNSEEN
                    if s > top:
                        top, n = s, tokens[i - 1] + raw
                best.append(top)
                tokens.append(n)
            path = word
            count[word] = tokens[len(word)]

    def totals(self, texts: list[str | None]) -> list[int]:
        """The number of tokens of each text. Pre-tokens are cut where no piece crosses."""
        cut = self.cut.findall
        split = [cut(" " + t) if t else [] for t in texts]
        new = {w for words in split for w in words if w not in self.count}
        if len(self.count) + len(new) > CACHE:
            self.count.clear()
            new = {w for words in split for w in words}
        self.add(list(new))
        count = self.count
        return [sum([count[w] for w in words]) for words in split]


@lru_cache(maxsize=2)
def trie_counter(path: str) -> TrieCounter:
    model = load(path)
    return TrieCounter([p for p, k in zip(model.pieces, model.kinds, strict=True) if k == NORMAL], model._word)


def _totals(path: str):
    def run(batches):
        counter = trie_counter(path)
        hold_cache(counter)
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                n = counter.totals(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens): tokens of each whole text under the unigram model of TrieCounter.

    Null and empty texts have none; every row is returned, repeated and null ids too. Of
    equal scores the longer last piece wins. Texts of any length are counted whole; further
    columns, whatever their names, are ignored, and an empty table gives no rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(_totals(model_path), "doc_id long, n_tokens long")
