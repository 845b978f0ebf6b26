"""Extraction, toxicity, line dedup, personal data and the pipeline."""

from __future__ import annotations

import re
import time
import uuid
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import common, html, linededup, pii, toxicity

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>
<header><p>Site name and slogan</p></header><div class="sidebar"><p>Popular posts of the week</p></div><article><h1>A &amp; B</h1><p><b>First   line<br>
more.<p>Second &lt;p&gt;.</p><div class="ad-box"><p>Buy now</p></div><p>Is.</p><aside>note</aside><ul><li>x</li><li>y</li></ul></article>
<section id="comments"><p>I disagree</p></section><form><p>Name</p></form><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE) == "A & B\nFirst line more.\nSecond <p>.\nIs.\nx\ny"
    assert html.main_text(None) == html.main_text("") == html.main_text("<p") == ""
    assert html.main_text("<article><p>a &am") == "a &am" and html.main_text("<article>1 < 2</article>") == "1 < 2"
    long = " ".join(["Plain prose of a page without an article element."] * 4)
    assert html.main_text(f"<div><a href=x>Home</a></div><div><a href=y>News</a></div><p>{long}</p><p>Short end.</p>") == f"{long}\nShort end."
    assert html.main_text("<article>" + "<p>x</p>" * 5000 + "</article>").count("\n") == 4999


def test_text_around_an_article_is_kept():
    a, b = (" ".join([f"Plain prose {x} of the main text."] * 4) for x in "ab")
    assert html.main_text(f"<main><h1>Title</h1><p>{a}</p><article class=card><p>Teaser</p></article><p>{b}</p></main>") == f"Title\n{a}\nTeaser\n{b}"
    assert html.main_text(f"<p>{a}</p><nav>x</nav><article><p>Teaser</p></article><nav>x</nav><p>{b}</p>") == f"{a}\nTeaser\n{b}"
    assert html.main_text("<p>Posted today</p><nav>x</nav><article><p>Text</p></article>") == "Text"


def test_short_stretches_between_surges_are_joined():
    long = " ".join(["Plain prose of a page without an article element."] * 4)
    gap = "<aside>note</aside>"
    assert html.main_text(f"<p>Top</p>{gap}<p>{long}</p>{gap}<p>Short.</p>{gap}<p>{long}</p>{gap}<p>End</p>") == f"{long}\nShort.\n{long}"


def test_no_words_of_the_article_are_lost():
    page = """<article><h2 id="search">Search</h2><p>First para.</p><section id="related-work"><p>Kept?</p></section><p id="notices-of-the-act">Body</p>
    <p>See <span class="share">the share</span> price</p><div class="related-posts"><p>More</p></div><div class="ad-box">Buy</div><p class="notice">Cookies!</p>
    <section id="comments"><p>I disagree</p></section><div class="advert-design">Of adverts</div><p>Press <button>OK</button> now</p></article>"""
    assert html.main_text(page) == "Search\nFirst para.\nKept?\nBody\nSee the share price\nOf adverts\nPress now"


class Plain(HTMLParser):
    """The same contract on well-formed pages by the standard library's parser: the blocks
    of the article, without elements that hold no main text."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.skip, self.inside, self.line, self.lines = 0, 0, [], []
        self.feed(page)
        self.close()

    def flush(self):
        if text := " ".join("".join(self.line).split()):
            self.lines.append(text)
        self.line = []

    def handle_starttag(self, tag, attrs):
        if tag in ("nav", "footer", "aside", "form", "script", "style", "title") or ("class", "ad") in attrs:
            self.skip += 1
        self.inside += tag == "article"
        if tag in html.BLOCK:
            self.flush()
        elif tag == "br":
            self.line.append(" ")

    def handle_endtag(self, tag):
        if tag in html.BLOCK:
            self.flush()
        self.inside -= tag == "article"
        if self.skip and tag in ("nav", "footer", "aside", "form", "script", "style", "title", "div"):
            self.skip -= 1

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.line.append(data)


def test_whole_table_agrees_with_another_parser(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html.extract_main_text(pages).collect()}
    assert got == {r["page_id"]: "\n".join(Plain(r["html"] or "").lines) for r in pages.collect()} and any(got.values())


def test_windows_choose_between_lines():
    """No element marks anything here: only the distribution of text tells the article."""
    rng = np.random.default_rng(2)
    for n in (3, 12):
        body = [" ".join(["Sentences of the body, one after the other."] * int(rng.integers(2, 6))) for _ in range(n)]
        body[1] = "Short one."
        rows = [f"<div><a href=/{i}>Link {i}</a></div>" for i in range(20)] + [f"<div>{b}</div>" for b in body] + [f"<div><a href=/{i}>Go {i}</a></div>" for i in range(20)]
        assert html.main_text("<html><body>" + "".join(rows) + "</body></html>") == "\n".join(body)


def test_deep_and_stray_tags_take_linear_time():
    start = time.process_time()
    assert html.main_text("<article>" + "<div>" * 40_000 + "</p>" * 40_000 + "x</article>") == "x"
    assert time.process_time() - start < 5


def test_surge_and_dive():
    assert html.surges([0, 0, 50, 40, 1, 0, 0, 0, 5, 0], 80) == [(2, 5)]
    assert html.surges([], 1) == [] and html.surges([0, 0], 1) == []


def test_extract_rows(spark):
    df = spark.createDataFrame([(1, None, "<article>a</article>", 3), (1, "u", None, 3), (None, "u", "", 3)], "page_id long, url string, html string, n_chars int")
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in html.extract_main_text(df).collect()) == [("1", "", 0), ("1", "a", 1), ("None", "", 0)]
    assert html.extract_main_text(df.limit(0)).count() == 0


def test_line_dedup(spark):
    rows = [(i, f"menu\nbody {i}\n\nbody {i}", "h", 1, "k") for i in range(20)] + [(100 + i, "menu\nown", "g", 1, "k") for i in range(2)]
    rows += [(200, None, None, 1, "k"), (201, "", "h", 1, "k"), (202, "menu", "h", 1, "k"), (203, "menu", None, 1, "k"), (203, "menu", None, 1, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines int, bad string")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in linededup.line_dedup(df, ratio=0.5).collect()}
    assert got[3] == ("body 3\n\nbody 3", 4, 1) and got[100] == ("menu\nown", 2, 0)
    assert got[200] == (None, 0, 0) and got[201] == ("", 0, 0) and got[202] == ("", 1, 1) and got[203] == ("menu", 1, 0)
    assert linededup.line_dedup(df).count() == len(rows) and linededup.line_dedup(df.limit(0)).count() == 0
    assert linededup.line_dedup(df).columns[:3] == ["doc_id", "text", "source"]


def test_line_dedup_with_clashing_names(spark, monkeypatch):
    names = ["__bad", "__h", "__lines", "__stay", "h", "bad", "host_0", "lines_0", "stay_0", "salt_0", "n_dropped", "l", "pages"]
    rows = [(i, f"menu\nown {i}", "g", *(f"{n}{i}" for n in names)) for i in range(12)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    want = sorted((i, f"own {i}", *(f"{n}{i}" for n in names if n != "n_dropped")) for i in range(12))
    for most in (10, 0):
        monkeypatch.setattr(linededup, "BROADCAST_LINES", most)
        out = linededup.line_dedup(df)
        assert sorted(tuple(r) for r in out.select("doc_id", "text", *(n for n in names if n != "n_dropped")).collect()) == want
        assert {(r["n_lines"], r["n_dropped"]) for r in out.collect()} == {(2, 1)}


def test_line_dedup_is_native(spark, sf):
    plan = linededup.line_dedup(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def labelled(n=600, seed=1):
    rng = np.random.default_rng(seed)
    plain = ["".join(rng.choice(list("abcdefghilmnoprstu"), rng.integers(2, 8))) for _ in range(300)]
    bad = ["idiot", "worthless", "scum", "loweian", "loweischaft", "loweitum"]
    texts, ys = [], []
    for i in range(n):
        w = list(rng.choice(plain, rng.integers(5, 60)))
        if i % 4 == 0:
            for _ in range(rng.integers(1, 3)):
                w[rng.integers(0, len(w))] = str(rng.choice(bad))
        texts.append(" ".join(w))
        ys.append(int(i % 4 == 0))
    return texts, ys


def test_toxicity_held_out():
    texts, ys = labelled()
    model = toxicity.train(texts[:400], ys[:400])
    got = model.scores(texts[400:]) >= 0.5
    assert (got == np.array(ys[400:], dtype=bool)).mean() > 0.97
    s = model.scores(["an idiot here", "an idioot here", "loweinen", "", None, "nice weather " * 20_000])
    assert (s[:3] >= 0.5).all() and (s[3:] < 0.5).all()


def phi(w):
    out = {}
    for i in range(len(w)):
        for j in range(i + 1, len(w)):
            for k in range(j + 1, min(len(w), i + toxicity.P + toxicity.GAPS)):
                out[w[i] + w[j] + w[k]] = out.get(w[i] + w[j] + w[k], 0) + toxicity.DECAY ** (k - i + 1)
    return out


def cosine(v, w):
    a, b = phi(f"\x02{v}\x03"), phi(f"\x02{w}\x03")
    return sum(x * b.get(c, 0) for c, x in a.items()) / np.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))


def test_kernel_by_hand(monkeypatch):
    words = ["bandana", "banana", "a", "", "xyz", "ban" * 9]
    m = toxicity.Landmarks(["banana", "ana"])
    got = m.kernel(words)
    for i, w in enumerate(words):
        assert got[i] == pytest.approx([cosine(w, z) ** toxicity.POWER for z in ("banana", "ana")] if w else [0, 0], abs=1e-6)
    assert m.gram[0, 1] == pytest.approx(cosine("banana", "ana") ** toxicity.POWER, abs=1e-6)
    want = m.kernel(["bananab" * 400])
    monkeypatch.setattr(toxicity, "STEP", 50)  # a long word is counted in parts, to the same values
    assert np.allclose(m.kernel(["bananab" * 400]), want, atol=1e-6)


def test_sum_kernel_and_its_map_are_one():
    """The Nystroem features of two texts made of landmarks have the texts' kernel as product."""
    marks = ["idiot", "banana", "bandana", "scum"]
    m = toxicity.Landmarks(marks)
    value, vector = np.linalg.eigh(m.gram)
    root = (vector / np.sqrt(value)) @ vector.T
    a, b = m.kernel(["idiot", "banana"]).sum(axis=0) @ root, m.kernel(["bandana", "idiot", "scum"]).sum(axis=0) @ root
    assert a @ b == pytest.approx(sum(cosine(v, w) ** toxicity.POWER for v in ("idiot", "banana") for w in ("bandana", "idiot", "scum")), abs=1e-4)


def test_gapped_and_inserted_insults():
    texts, ys = labelled(800, seed=4)
    model = toxicity.train(texts, ys)
    rng = np.random.default_rng(6)
    clean = [t for t, y in zip(*labelled(1200, seed=9), strict=True) if not y]
    assert (model.scores(clean) >= 0.5).mean() <= 0.02

    def put(w, form):
        if form == "dotted":
            return ".".join(w)
        if form == "spelt":
            return " ".join(w)
        at = rng.integers(1, len(w), 1)[0]
        return w[:at] + str(rng.choice(list("abcdefghijklmnopqrstuvwxyz*"))) + w[at:]

    for form in ("dotted", "spelt", "inserted"):
        hit = []
        for i, t in enumerate(clean[:120]):
            words = t.split()
            words.insert(int(rng.integers(0, len(words) + 1)), put(["idiot", "worthless", "scum"][i % 3], form))
            hit.append(model.scores([" ".join(words)])[0] >= 0.5)
        assert np.mean(hit) >= 0.8, form


def test_held_out_accuracy_on_the_table(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.score_toxicity(docs, toxicity.train_on(docs, labels)).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    toxic = [r["predicted"] for r in got if r["toxic"] == 1]
    clean = [r["predicted"] for r in got if r["toxic"] == 0]
    assert sum(toxic) >= 0.6 * len(toxic) and sum(clean) <= 0.06 * len(clean)


def test_long_texts_train_whole(spark):
    texts, ys = labelled(200)
    texts[0] = "idiot " + "word " * 30_000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(ys)), "doc_id long, toxic int")
    seen = []
    old, toxicity.train = toxicity.train, lambda t, y: seen.append((t, y)) or old(t, y)
    try:
        toxicity.train_on(docs, labels)
        toxicity.train_on(docs, labels, chars=2000)
    finally:
        toxicity.train = old
    kept = {i for i in range(200) if zlib.crc32(str(i).encode()) % 5}
    assert sorted(map(len, seen[0][0])) == sorted(len(texts[i]) for i in kept)
    assert 0 < len(seen[1][0]) < len(seen[0][0])


def test_toxicity_rows(spark):
    texts, ys = labelled(200)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(7, None, "x"), (None, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(ys)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train_on(docs, labels)
    out = toxicity.score_toxicity(docs, model).collect()
    assert len(out) == 202 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out if r["doc_id"] is not None)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    assert toxicity.drop_toxic(docs, model).count() == sum(1 - r["predicted"] for r in out)
    none = toxicity.train_on(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score_toxicity(docs, none).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


BASE = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain_base(text):
    email, ip, card, phone = ([m.span() for m in re.finditer(p, text)] for p in BASE)
    digits = lambda s: re.sub("[^0-9]", "", text[s[0] : s[1]])
    ip = [s for s in ip if all(int(p) <= 255 for p in text[s[0] : s[1]].split("."))]
    card = [s for s in card if 13 <= len(digits(s)) <= 19 and pii.luhn(digits(s))]
    return [email, ip, card, [s for s in phone if 9 <= len(digits(s)) <= 15]]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB1290.@+-() %_\n", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_base(text)


def test_base_spans_are_linear():
    assert pii.base_spans("a" * 300_000 + " " + "1" * 300_000 + " @" * 1000)[0] == []


def test_skip_chain_carries_labels():
    base, spans = pii.all_spans("call +1 (988) 555-2485 now or later 555-2485 or (988) 555-2485, see 4.0 and 1999")
    assert [len(b) for b in base] == [0, 0, 0, 1] and len(spans[3]) == 3
    assert set(base[3]) <= set(spans[3])
    assert pii.redact("card 4111 1111 1111 1111 and x@y.org") == "card <CARD> and <EMAIL>"
    assert pii.redact("Version 4.0, 3. of 1999") == "Version 4.0, 3. of 1999" and pii.redact(None) is None


FIELD = [
    (1, "call +1 (988) 555-2485 now, or later 9885552485 and 988.555.2485", "phone:5:22,phone:37:47,phone:52:64"),
    (2, "order 9885552485 and again 9885552485, part 988.555.2485", ""),  # the same numbers without evidence
    (3, "write to j.smith@corp.example.com or jsmith@corp, react@17", "email:9:33,email:37:48"),
    (4, "+1 (212) 555-1234, not 6465551234 but 2125551234", "phone:0:17,phone:38:48"),  # the last seven digits are not the number
    (5, "cards 4111111111111111 5500005555555559 here", "card:6:22,card:23:39"),  # swallowed by one match
    (6, "Version 4.0, 3. of 1999 at 12:30", ""),
]


def test_skip_links_decide_on_a_table(spark):
    """The field finds what no pattern takes; without skip links the same table has fewer spans."""
    df = spark.createDataFrame([r[:2] for r in FIELD], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(df).collect()}
    assert got == {i: s for i, _, s in FIELD}
    node, chain, skip = pii.weights()
    old, pii.weights = pii.weights, lambda: (node, chain, np.zeros_like(skip))
    try:
        without = {r["doc_id"]: r["spans"] for r in pii.find_pii(df).collect()}
    finally:
        pii.weights = old
    assert [i for i in got if without[i] != got[i]] == [1, 3, 4]


def test_potentials_are_trained_together():
    node, chain, skip = pii.weights()
    assert (np.diag(skip) > 1.5).all() and (skip[~np.eye(5, dtype=bool)] < 0).all()
    assert chain[3, 3] > 1 and chain[4, 4] > 1


def test_entities():
    got = pii.entities(["#19885552485", "#9885552485", "#5552485", "#6465552485", "@jo", "ab1"])
    assert got["#9885552485"] == got["#19885552485"] == ["#19885552485"] and got["@jo"] == ["@jo"]
    assert got["#5552485"] == ["#19885552485", "#6465552485"] and got["#6465552485"] == ["#6465552485"]


def test_beliefs_on_a_loop():
    """Messages settle on a loop and stay near the exact marginals when links are weak."""
    rng = np.random.default_rng(3)
    node, psi = rng.normal(size=(4, 5)), 0.4 * rng.normal(size=(5, 5))
    pairs = np.array([(0, 1), (1, 2), (2, 3), (0, 3)])
    p = np.zeros((5,) * 4)
    for y in np.ndindex(p.shape):
        p[y] = sum(node[i, y[i]] for i in range(4)) + sum(psi[y[a], y[b]] for a, b in pairs)
    p = np.exp(p - p.max())
    p /= p.sum()
    want = [p.sum(tuple(j for j in range(4) if j != i)) for i in range(4)]
    assert np.allclose(pii.beliefs(node, [(pairs, psi)]), want, atol=0.02)


def test_very_long_texts_keep_their_entities():
    text = "call +19885552485 for " + " ".join(str(10**9 + 7919 * i) for i in range(4000)) + " or 9885552485"
    spans = pii.all_spans(text)[1][3]
    assert len(spans) == 2 and text[slice(*spans[1])] == "9885552485"


def test_evidence_reaches_every_mention():
    text = "call +19885552485 first" + " and then we call 19885552485 again" * 60
    spans = pii.all_spans(text)[1][3]
    assert len(spans) == 61 and pii.redact(text).count("<PHONE>") == 61
    apart = "call +19885552485 first" + " 4.0" * 3000 + " we call 19885552485 again"
    assert len(pii.all_spans(apart)[1][3]) == 2


def test_beliefs_converge_on_long_chains():
    node, psi = np.zeros((100, 5)), np.where(np.eye(5) > 0, 4.0, -4.0)
    node[0] = [-30, 30, -30, -30, -30]
    got, p = pii.beliefs(node, [(np.array([(i, i + 1) for i in range(99)]), psi)]), np.exp(psi)
    want, row = np.eye(5)[1], p / p.sum(1, keepdims=True)
    for i in range(100):
        assert np.allclose(got[i], want, atol=1e-2)
        want = want @ row


def test_beliefs_agree_with_enumeration():
    rng = np.random.default_rng(0)
    node, psi = rng.normal(size=(3, 5)), rng.normal(size=(2, 5, 5))
    p = np.exp(node[0][:, None, None] + node[1][None, :, None] + node[2][None, None, :] + psi[0][:, :, None] + psi[1][None, :, :])
    p /= p.sum()
    got = pii.beliefs(node, [(np.array([(0, 1)]), psi[0]), (np.array([(1, 2)]), psi[1])])
    assert np.allclose(got, [p.sum((1, 2)), p.sum((0, 2)), p.sum((0, 1))], atol=1e-3)


def test_pii_rows(spark):
    df = spark.createDataFrame([(1, "a@b.org", "x"), (1, None, "x"), (None, "", "x")], "doc_id long, text string, spans string")
    got = sorted((str(r["doc_id"]), r["n_email"], r["spans"]) for r in pii.find_pii(df).collect())
    assert got == [("1", 0, ""), ("1", 1, "email:0:7"), ("None", 0, "")]
    assert pii.find_pii(df.limit(0)).count() == 0


def test_pipeline(spark, sf):
    from corpusloom.llm import pipeline as corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
        assert docs.count() <= kept
        kept = docs.count()
    assert not docs.where("text rlike '[a-z]@[a-z0-9]+[.]example[.]com'").count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert pieces.select("doc_id").distinct().count() == kept
    assert corpus_pipeline.run(spark, sf).count() == pieces.count()


def test_pipeline_on_odd_rows(spark, sf, vocab, monkeypatch):
    """Null ids, texts and sources, repeated ids, copies, a column of a clashing name, no rows."""
    from corpusloom.llm import pipeline

    monkeypatch.setattr(pipeline, "tokenizer_path", vocab)
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(7, long, "en", "s", 1, "a"), (7, long, "en", "s", 1, "b"), (9, long + " end", "en", "s", 1, "c"), (None, "alone", None, None, None, None)]
    rows += [(11, None, "en", None, None, "d"), (12, "", "en", "s", 0, "e"), (13, "mail a@b.example.com " + long[:150], "en", "s", 9, "f"), (13, "other text of id thirteen", "en", "s", 9, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, component_id string")
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "component_id"], name
    got = sorted((str(r["doc_id"]), str(r["text"])[:9], r["n_chars"]) for r in docs.collect())
    assert [(i, t) for i, t, _ in got] == [("11", "None"), ("12", ""), ("13", "mail <EMA"), ("7", "w0 w1 w2 "), ("None", "alone")]
    assert pipeline.STAGES[-1][1](spark, docs, sf).count() == 5
    none = docs.limit(0)
    for _, stage in pipeline.STAGES[:-1]:
        none = stage(spark, none, sf)
        assert none.count() == 0


def test_main_text_of_short_pages_and_names():
    assert html.main_text("<body><h1>Title</h1><p>Short text here.</p></body>") == "Title\nShort text here."
    assert html.main_text('<div id="content"><h1>Fire at the mill</h1><p>Nobody was hurt.</p></div><footer>x</footer>') == "Fire at the mill\nNobody was hurt."
    long = "<p>" + "Words of the article go on. " * 9 + "</p>"
    for name in ("cookie-banner__text", "site-nav-main", "topbar"):
        assert "noise" not in html.main_text(f"<body>{long}<div class='{name}'>noise</div></body>")
    assert "noise" not in html.main_text(f'<body><article>{long}</article><div id="responses"><article>noise of readers</article></div></body>')
    assert html.main_text("<nav>a</nav>") == "" and html.main_text("<p></p>") == ""


def test_texts_reach_python_in_batches_by_bytes(spark, monkeypatch, tmp_path):
    """A batch is held whole by the JVM and by the worker, so its bound can't be a number of rows."""
    monkeypatch.setattr(common, "BATCH_BYTES", 200_000)
    run_of = toxicity._score

    def watched(model):
        run = run_of(model)

        def seen(batches):
            for batch in batches:
                (tmp_path / uuid.uuid4().hex).write_text(str(batch.nbytes))
                yield batch

        return lambda batches: run(seen(batches))

    monkeypatch.setattr(toxicity, "_score", watched)
    docs = spark.range(400).coalesce(1).selectExpr("id as doc_id", "repeat('fine day ', 600) as text")
    model = toxicity.train(["you idiot"] * 9 + ["a fine day"] * 9, [1] * 9 + [0] * 9)
    assert toxicity.drop_toxic(docs, model).count() == 400
    sizes = [int(p.read_text()) for p in tmp_path.iterdir()]
    assert sum(sizes) >= 2_000_000 and max(sizes) <= 250_000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) != "200000"
