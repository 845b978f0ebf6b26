"""Encoding, decoding, counting and packing against the libraries and plain versions."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import packing, pieces

TEXTS = [
    "", " ", "  a", "a  b ", "\n\n", "a\n b", "日本語 🎉🎉x", "a\x00b", "▁▁x ▁", "<s> </s> <0x0A>", "x" * 300, "the " * 50 + "  \t\r\n", "é́", "don't　stop", "        \n        code   indent",
    "Mixed CASE, punct!!! (1,234.5) http://a.b/c?d=e&f#g", "ß²³ №5 ½", "a" * 20_000,
]
SCHEMA = "doc_id long, text string, n_tokens string"


@pytest.fixture(scope="module")
def model(vocab):
    return pieces.load(vocab("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library(vocab):
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=vocab("piece_bpe_32k.model"))


@pytest.mark.parametrize("text", TEXTS)
def test_encodes_and_decodes_as_the_library(model, library, text):
    want = library.encode(text)
    assert model.encode(text) == want
    assert model.decode(want) == library.decode(want)
    n, ids, decoded, _ = model.digest(text)
    assert (n, ids) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())
    assert decoded == hashlib.sha256(library.decode(want).encode()).hexdigest()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40))
def test_any_text(model, library, text):
    assert model.encode(text) == library.encode(text)
    spans = model.encode_spans(text)
    assert [s[0] for s in spans] == library.encode(text)
    assert all(a <= b for _, a, b in spans) and all(x[2] <= y[2] for x, y in zip(spans, spans[1:], strict=False))
    assert not spans or spans[-1][2] == len(text.encode())


def test_documents_of_the_smallest_table(spark, sf, model, library, vocab):
    rows = {r["doc_id"]: r for r in pieces.sentencepiece_digest(spark.read.parquet(f"{sf}/documents.parquet"), vocab("piece_bpe_32k.model")).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect():
        ids = library.encode(r["text"])
        assert rows[r["doc_id"]]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_longest_prefix_map_keeps_the_source():
    """A map of two entries as a double array: "a" becomes "x", "ab" nothing."""
    import struct

    strings = b"x\0\0"
    # A unit: label in the low byte, has-leaf in bit 8, offset from bit 10; leaves hold bit 31.
    unit = [0] * 1024
    root = 256
    unit[0] = root << 10
    a = root ^ ord("a")
    a_base = 512 ^ a
    unit[a] = ord("a") | 1 << 8 | (a_base << 10)
    unit[a ^ a_base] = 1 << 31 | 0
    b = (a ^ a_base) ^ ord("b")
    b_base = b ^ 800
    unit[b] = ord("b") | 1 << 8 | (b_base << 10)
    unit[b ^ b_base] = 1 << 31 | 2
    m = pieces.CharMap(struct.pack("<I", 4 * len(unit)) + struct.pack(f"<{len(unit)}I", *unit) + strings)
    assert m.longest(b"zab", 0) is None and m.longest(b"zab", 1) == (2, b"") and m.longest(b"aac", 0) == (1, b"x")


def test_spans_stage_and_nulls(spark, vocab):
    df = spark.createDataFrame([(1, "a  b", "x"), (1, None, "x"), (None, "", "x")], SCHEMA)
    got = {(r["doc_id"], len(r["pieces"])) for r in pieces.sentencepiece_spans(df, vocab("piece_bpe_32k.model")).collect()}
    assert got == {(1, 3), (1, 0), (None, 0)} or {g[1] for g in got} >= {0}
    rows = pieces.sentencepiece_digest(df, vocab("piece_bpe_32k.model")).collect()
    assert len(rows) == 3 and sorted(r["n_tokens"] for r in rows)[:2] == [0, 0]
    assert pieces.sentencepiece_digest(spark.createDataFrame([], SCHEMA), vocab("piece_bpe_32k.model")).count() == 0


def viterbi(score, text):
    best, n = [0.0], [0]
    for i in range(1, len(text) + 1):
        top, count = -1e300, 0
        for k in range(min(20, i), 0, -1):
            s = score.get(text[i - k : i])
            if s is not None and best[i - k] + s > top:
                top, count = best[i - k] + s, n[i - k] + 1
        if text[i - 1] not in score:
            raw = len(text[i - 1].encode())
            if best[i - 1] - 20.0 * raw > top:
                top, count = best[i - 1] - 20.0 * raw, n[i - 1] + raw
        best.append(top)
        n.append(count)
    return n[-1]


def test_trie_counts_equal_whole_text_search(spark, sf, vocab):
    counter = pieces.trie_counter(vocab("piece_bpe_32k.model"))
    texts = [t for t in TEXTS if t]
    assert counter.totals(texts) == [viterbi(counter.score, " " + t) for t in texts]
    df = spark.createDataFrame([(1, None, ""), (1, "", ""), (2, "the the", ""), (None, "x", "")], SCHEMA)
    got = [r["n_tokens"] for r in pieces.token_counts(df, vocab("piece_bpe_32k.model")).collect()]
    assert sorted(got) == sorted([0, 0, *(viterbi(counter.score, " " + t) for t in ("the the", "x"))])


@pytest.fixture(scope="module")
def tokenizer(vocab):
    return pytest.importorskip("tokenizers").Tokenizer.from_file(vocab("word_bpe_49k.json"))


@pytest.mark.parametrize("text", [*TEXTS, "it's o'something", "a.'b", "x,€y", "<|endoftext|>the", "İstanbul ΣΑΣ", "12 3,4.5x", "a\x0bb c", "don't,'x'"])
def test_ids_as_the_library(tokenizer, vocab, text):
    assert np.frombuffer(packing.words(vocab("word_bpe_49k.json")).packed([text])[0], dtype="<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_shortest_pack_first(histogram):
    intervals, n = packing.shortest_pack_first(histogram, 64)
    fill, ranks = np.zeros(n, dtype=int), {}
    for size, rank, count, first, offset in intervals:
        assert (fill[first : first + count] == offset).all()  # gapless
        fill[first : first + count] += size
        ranks.setdefault(size, []).append((rank, count))
    assert (fill <= 64).all() and fill.sum() == sum(k * v for k, v in histogram.items())
    for size, got in ranks.items():
        at = 0
        for rank, count in sorted(got):
            assert rank == at
            at += count
        assert at == histogram[size]


def test_packing(spark, sf, tokenizer, vocab):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10_000, None), (10_001, ""), (10_001, ""), (None, "a b")], "doc_id long, text string"))
    rows = packing.pack_documents(docs.repartition(3), vocab("word_bpe_49k.json")).toPandas()
    ids = {r["doc_id"]: np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], dtype="<u4") for r in docs.collect()}
    for doc, part in rows[rows.doc_id < 10_000].groupby("doc_id"):
        part = part.sort_values("start")
        assert part.start.tolist() == [0, *part.length.cumsum().tolist()[:-1]] and part.length.sum() == len(ids[doc]) == part.doc_tokens.iloc[0]
        assert all(zlib.crc32(ids[doc][a : a + n].tobytes()) == c for a, n, c in zip(part.start, part.length, part.ids_crc32, strict=True))
    assert len(rows[rows.doc_id >= 10_000]) == 3 and rows.doc_id.isna().sum() == 1
    total = padding = 0
    for _, seq in rows.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq.offset.tolist() == [0, *seq.length.cumsum().tolist()[:-1]]
        n = int(seq.length.sum())
        assert n <= 4096
        total, padding = total + n, padding + (4096 - n if n & (n - 1) else 0)
    assert padding < 0.05 * total
    assert packing.pack_documents(docs.limit(0), vocab("word_bpe_49k.json")).count() == 0


def test_empty_tables_and_clashing_names(spark, vocab):
    rows = [(1, "the cat " * 3000, 7, 8, 9, 10), (2, None, 1, 1, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int, salt int, n_tokens int, own int")
    model, words = vocab("piece_bpe_32k.model"), vocab("word_bpe_49k.json")
    for run in (lambda d: pieces.sentencepiece_digest(d, model), lambda d: pieces.token_counts(d, model), lambda d: packing.pack_documents(d, words)):
        got = run(df).collect()
        assert {r["doc_id"] for r in got} == {1, 2} and run(df.limit(0)).count() == 0
    assert {r["doc_id"]: r["n_tokens"] for r in pieces.token_counts(df, model).collect()}[2] == 0
