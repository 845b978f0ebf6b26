"""Near duplicates against all pairs of whole shingle sets."""

from __future__ import annotations

import random

import numpy as np
import pytest

from corpusloom.llm import minhash
from corpusloom.llm.common import connected_components

SCHEMA = "doc_id long, text string, n_shingles string"


def brute(rows, percent=85):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    flat = [(i, s) for i, ss in sets.items() for s in ss]
    comp = {i: i for i in sets}
    moved = True
    links = {(a, b) for a, x in flat for b, y in flat if a != b and x and y and 100 * len(x & y) >= percent * len(x | y)}
    while moved:
        moved = False
        for a, b in links:
            low = min(comp[a], comp[b])
            if comp[a] != low or comp[b] != low:
                comp[a] = comp[b] = low
                moved = True
    return comp


def words(rng, n):
    return [f"w{rng.randrange(500)}" for _ in range(n)]


def corpus():
    rng = random.Random(3)
    rows, base = [], words(rng, 140)
    for i in range(90):  # one large group of near copies: compared in blocks
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(w)))
    for i in range(40):
        w = words(rng, rng.randrange(1, 60))
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:-1], "end"] if i % 2 else w))]
    rows += [(500, None), (501, ""), (502, " \t\n "), (503, "one two"), (504, "ONE  two"), (505, "One two three"), (506, "a " * 30_000), (507, "a " * 29_000), (508, "é É"), (509, "é é")]
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    got = minhash.minhash_dedup(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA).repartition(5)).collect()
    want = brute(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got) and len(got) == len(rows)
    assert {r["doc_id"]: r["n_shingles"] for r in got if 500 <= r["doc_id"] <= 505} == {500: 0, 501: 0, 502: 0, 503: 1, 504: 1, 505: 1}


def test_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(7, text, ""), (7, text, ""), (7, text + " more", ""), (9, text + " more more", ""), (None, text, ""), (None, None, "")]
    got = sorted((str(r["doc_id"]), r["component_id"]) for r in minhash.minhash_dedup(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("7", 7), ("7", 7), ("7", 7), ("9", 7), ("None", None), ("None", None)]


def test_empty_table(spark):
    assert minhash.minhash_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_signature_estimates_and_is_order_free():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(40):
        both, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (160, 20, 20))
        x, y = np.concatenate([both, a]), np.concatenate([b, both])
        s, t, u = minhash.super_minhash([x, y, x[::-1]])
        assert (s == u).all()
        errors.append((s == t).mean() - 0.8)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
    # every register of a small set is filled, and ranks bound the values
    small = minhash.super_minhash([np.array([5], dtype=np.uint64)])[0]
    assert sorted(np.floor(small)) == list(range(minhash.REGISTERS))


def test_words_longer_than_a_chunk(monkeypatch):
    monkeypatch.setattr(minhash, "_CHUNK", 64)
    text = ("ab " * 50 + "z" * 200 + " " + "cd ef " * 30).encode()
    h = minhash.word_hashes(text)
    assert len(h) == len(text.split()) and len(set(h.tolist())) == len(set(text.split()))


@pytest.mark.parametrize("links", [[(1, 2), (2, 3), (5, 4), (4, 6), (6, 5)], [(i, i + 1) for i in range(40)], []])
def test_components(spark, links):
    got = {r["node"]: r["component_id"] for r in connected_components(spark.createDataFrame(links, "u long, v long").repartition(3)).collect()}
    up: dict[int, int] = {}
    for a, b in sorted(tuple(sorted(x)) for x in links):
        up[b] = min(up.get(b, b), up.get(a, a))
        up.setdefault(a, a)
    want = {n: next(x for x in [n] if True) for n in up}
    for _ in range(50):
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want


def near(percents, n=100):
    """Pairs of texts at about each percent of similarity: (ids of a pair, its exact similarity)."""
    rng, rows, at = random.Random(5), [], {}
    for i, percent in enumerate(percents * n):
        a = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        cut = round(196 * 2 * percent / (100 + percent))  # shingles shared of 196 on each side
        b = a[: cut + 4] + [f"v{rng.randrange(10**6)}" for _ in range(196 - cut)]
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
        x, y = ({tuple(w[k : k + 5]) for k in range(196)} for w in (a, b))
        at[2 * i] = len(x & y) / len(x | y)
    return rows, at


@pytest.mark.parametrize("percent", [80, 65])
def test_every_pair_at_a_lower_threshold(spark, percent):
    rows, at = near([percent + 1, percent + 3, percent - 2])
    got = minhash.minhash_dedup(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA), percent=percent)
    assert {r["doc_id"] - 1 for r in got.where("not kept").collect()} == {i for i, s in at.items() if 100 * s >= percent}


def test_pipeline_drops_near_copies_from_080(spark):
    from corpusloom.llm import pipeline as corpus_pipeline

    rows, at = near([82, 84, 78], 20)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == {i for i, _ in rows} - {i + 1 for i, s in at.items() if s >= 0.8}


def test_thresholds():
    assert minhash.thresholds(85) == (25, 5)
    for percent in (50, 65, 80, 85, 95):
        assert minhash.unmet(percent / 100, minhash.thresholds(percent)[1]) <= 1e-6


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_are_compared_not_hashes(spark, monkeypatch):
    """Words that polynomial hashes confuse have hashes of their own; and if hashes did
    confuse two words, links would still be those of the words."""
    a = thue_morse(4096)
    b = a.translate({97: "b", 98: "a"})
    for n in (64, 1024, 4096):
        assert len({int(minhash.word_hashes(x[:n].encode())[0]) for x in (a, b)}) == 2
    rows = [(1, a, ""), (2, b, ""), (3, a.upper(), "")]
    assert {r["doc_id"]: r["component_id"] for r in minhash.minhash_dedup(spark.createDataFrame(rows, SCHEMA)).collect()} == {1: 1, 2: 2, 3: 1}
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "xxy"]
    real = minhash.shingle_sets
    monkeypatch.setattr(minhash, "shingle_sets", lambda t, k: real([texts[0]] * len(t), k))  # all alike
    assert minhash.block_forest([1, 2, 3], texts, 85) == [(1, 2)]


def test_hub_keys_are_broadcast(spark, monkeypatch):
    from corpusloom.llm import common

    monkeypatch.setattr(common, "HEAVY", 3)
    links = [(0, i) for i in range(1, 30)] + [(100 + i, 101 + i) for i in range(20)]
    got = {r["node"]: r["component_id"] for r in connected_components(spark.createDataFrame(links, "u long, v long").repartition(7)).collect()}
    assert got == {**{i: 0 for i in range(30)}, **{100 + i: 100 for i in range(21)}}
    rows = spark.createDataFrame([(k, i) for k in range(4) for i in range(2 * k)], "k long, i long")
    keyed = spark.createDataFrame([(k, 2 * k, f"v{k}") for k in range(5) if k != 1], "k long, n long, v string")
    out = sorted((r["k"], r["i"], r["v"]) for r in common.join_split(rows, keyed, ["k"], "n", "left").collect())
    assert out == sorted((k, i, None if k == 1 else f"v{k}") for k in range(4) for i in range(2 * k))


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from corpusloom.llm import common

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="yarn"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(session)
