"""Pages, crawls, parsing with failures, assembled documents, lineage, runs and sketches against plain versions."""

from __future__ import annotations

import re
from collections import deque
from html.parser import HTMLParser
from urllib.parse import urljoin

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import ids, markdown
from corpusloom.operators import assemble, chunking, dedup, ingest, lineage, runs, sketches
from corpusloom.plans import catalogue_sources
from corpusloom.sources import crawl, dom, lakehouse, layout

TABLES = "embeddings documents pages events lineitem conversations".split()


@pytest.mark.parametrize("name", ["crawl_frontier", "conditional_state", "ingest_counts", "document_status", "document_status_stream", "lineage_closure", "sketches_merged", "sql_grouping_sets", "sitemap_listing", "layout_counts", "dense_variants", "result_locators", "cache_after_a_batch", "vocabulary", "front_matter_fields", "chunk_run", "chunk_run_counts"])
def test_query_equals_its_sql(spark, sf, name):
    got = catalogue_sources.QUERIES[name](spark, sf).collect()
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(catalogue_sources.SQL[name])
    names = sorted(want.columns)
    plain = lambda x: None if x is None or x == "" and name == "ingest_counts" else float(x) if isinstance(x, (int, float)) else x
    rows = sorted((tuple(plain(r[want.columns.index(n)]) for n in names) for r in want.fetchall()), key=repr)
    assert sorted((tuple(plain(r[n]) for n in names) for r in got), key=repr) == rows and rows


# -- the tree of a page ------------------------------------------------------------


class Tree(HTMLParser):
    """A tree of nested lists, made the plain way: [tag, attrs, children]; a text is a string."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.root = ["", {}, []]
        self.stack = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, {k: v or "" for k, v in attrs}, []]
        self.stack[-1][2].append(node)
        if tag not in dom.VOID:
            self.stack.append(node)

    def handle_endtag(self, tag):
        if any(n[0] == tag for n in self.stack[1:]):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.stack[-1][2].append(data)


def texts(node):
    for c in node[2]:
        if isinstance(c, str):
            if c.strip():
                yield " ".join(c.split())
        elif not dom.is_chrome(c[0], c[1]):
            yield from texts(c)


def walk(node):
    for c in node[2]:
        if not isinstance(c, str) and not dom.is_chrome(c[0], c[1]):
            yield c
            yield from walk(c)


def plain_main(html):
    root = Tree(html).root
    nodes = list(walk(root))
    size = lambda n: len(" ".join(texts(n)))
    for s in dom.MAIN:
        first = next((n for n in nodes if dom.matches(s, n[0], n[1])), None)
        if first is not None and size(first) >= dom.LEAST:
            return first, size(first)
    body = next((n for n in nodes if n[0] == "body"), None)
    return body, None if body is None else size(body)


PIECES = ["<div>", "</div>", "<p>", "</p>", "<main>", "</main>", '<section class="ads x">', "</section>", '<article id="content">', "</article>", '<a href="/x">', "</a>", "<br>", "<nav>", "</nav>", "words of text here " * 6, "short", "&amp; more", "<body>", "</body>"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40))
def test_sums_of_any_tree(pieces):
    html = "".join(pieces)
    d = dom.build(html)
    s = dom.sums(d)
    for i in range(len(d.tag)):  # every subtree, summed one node after the other
        inside = range(i, d.end[i])
        hidden = {j for k in range(len(d.tag)) if d.tag[k] and dom.is_chrome(d.tag[k], d.attrs[k]) for j in range(k, d.end[k])}
        mine = [dom.clean(d.text[j]) for j in inside if j not in hidden and d.text[j].strip()]
        assert s.text[i] == len(" ".join(mine)) and bool(s.shown[i]) == (i not in hidden)
        linked = [j for j in inside if d.tag[j] == "a" and j not in hidden]
        assert s.links[i] == sum(len(" ".join(dom.clean(d.text[k]) for k in range(j, d.end[j]) if k not in hidden and d.text[k].strip())) for j in linked)
        assert i < d.end[i] <= len(d.tag) and d.span[i][0] <= d.span[i][1] <= len(html)
    assert dom.main_node(d, s) < len(d.tag)


def test_main_of_whole_pages(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in catalogue_sources.html_main_subtree(spark, sf).collect()}
    assert set(got) == set(pages)
    for i, html in pages.items():
        node, size = plain_main(html or "")
        assert got[i]["main_tag"] == (node[0] if node else None)
        kept = re.sub(r"\s", "", "".join(b["text"] for b in got[i]["blocks"]))
        if "<p><" not in (html or "") and size:  # paragraphs that end by themselves are the parser's own rule
            assert len(kept) > 0.9 * len(re.sub(r"\s", "", "".join(texts(node))))


def test_densest_container_and_odd_pages(spark):
    long, link = "plain words " * 40, '<a href="/x">link words here</a> ' * 30
    page = f"<html lang='de'><head><title> A  b </title><link rel='canonical' href='https://H.example/c'><meta name='description' content='d  d'></head><body><div class='x'>{link}</div><div class='y'><p>{long}</p><pre>a\n  b</pre><ul><li>one<li>two</ul></div></body></html>"
    rows = [(1, "https://h.example/p", page), (2, None, None), (3, "u", ""), (4, "u", "<p>no body"), (5, "u", "<div>" * 3000 + "deep" + "</div>" * 3000), (6, "u", "<body>" + "</b>" * 50 + "<i>stray</body>"), (7, "u", f"<body><main>short</main><article>{long}</article></body>")]
    got = {r["page_id"]: r for r in dom.main_subtree(spark.createDataFrame(rows, "page_id int, url string, html string").withColumn("title", F.lit("own"))).collect()}
    a = got[1]
    assert a["main_tag"] == "div" and a["title"] == "A b" and a["canonical"] == "https://H.example/c" and a["lang"] == "de" and a["meta"] == {"description": "d d"}
    assert [(b["kind"], b["text"]) for b in a["blocks"]][1:] == [("code", "a\n  b"), ("list", "one"), ("list", "two")]
    assert got[2]["main_tag"] is None and got[2]["blocks"] == [] and got[3]["n_nodes"] == 0
    assert [b["text"] for b in got[4]["blocks"]] == ["no body"] and [b["text"] for b in got[5]["blocks"]] == ["deep"]
    assert got[6]["main_tag"] == "body" and got[7]["main_tag"] == "article"


# -- crawls ------------------------------------------------------------------------


def test_references_are_resolved_as_everywhere(spark):
    base = ["https://h.example/a/b?q=1#f", "http://h.example", "https://h.example/a/b/", "https://u:p@h.example:8080/x"]
    refs = ["c", "./c", "../c", "/c", "//o.example/c", "?x=2", "", "#top", "https://z.example/", "mailto:a@b", "c/d?e#f", "../../../c"]
    df = spark.createDataFrame([(b, r) for b in base for r in refs], "base string, ref string")
    for r in df.select("*", crawl.resolve(F.col("base"), F.col("ref")).alias("got"), ids.canonical_uri(crawl.resolve(F.col("base"), F.col("ref"))).alias("canonical")).collect():
        want = re.sub(r"^(\w+://[^/?]+)\?", r"\1/?", urljoin(r["base"], r["ref"].split("#")[0]).split("#")[0])
        norm = lambda u: re.sub(r"/(\./)+", "/", u)
        if ".." in r["ref"] or "./" in r["ref"]:  # dot segments are resolved by the canonical form
            want = re.sub(r"/(\.\./)+", "/", want)
            assert r["canonical"].rstrip("/") == re.sub(r"^(\w+://)[^/@]*@", r"\1", want).split("?")[0].rstrip("/").lower()
        else:
            assert norm(r["got"]).rstrip("/") == want.rstrip("/")


def plain_frontier(pages, seeds, depth, most, banned):
    out = {u.lower(): u.lower().rstrip("/") for u in pages}
    del out
    host = lambda u: u.split("/")[2]
    level = {s: None for s in seeds if not banned(s)}
    seen, used = {}, {}
    for d in range(depth + 1):
        for u in sorted(level):
            if used.get(host(u), 0) < most:
                used[host(u)] = used.get(host(u), 0) + 1
                seen[u] = (d, level[u])
        nxt = {}
        for u in sorted(x for x, (k, _) in seen.items() if k == d):
            for t in pages.get(u, ()):
                if t not in seen and host(t) == host(u) and not banned(t) and t not in nxt:
                    nxt[t] = u
        level = nxt
    return {(u, d, p, u in pages) for u, (d, p) in seen.items()}


@pytest.mark.parametrize("most", [3, 7, 1000])
def test_frontier_by_plain_queue(spark, monkeypatch, most):
    rng = np.random.default_rng(most)
    monkeypatch.setattr(crawl, "SPREAD", 2)
    url = lambda i: f"https://h{i % 3}.example/p{i:03d}"
    links = {url(i): [url(int(j)) for j in rng.integers(0, 90, 4)] for i in range(60)}
    rows = [(u, "".join(f"<a href='{t}'>x</a><a href=\"{t}?again#z\">" for t in ts)) for u, ts in links.items()] + [("https://h0.example/none", None), (None, "<a href='/p1'>")]
    robots = spark.createDataFrame([("h1.example", "/p01", False), ("h1.example", "/p013", True), ("h2.example", "/", True)], "host string, path string, allow boolean")
    banned = lambda u: "h1." in u and "/p01" in u and "/p013" not in u
    pages, seeds = spark.createDataFrame(rows, "url string, html string"), spark.createDataFrame([(url(i),) for i in (0, 1, 2, 10)] + [(None,), ("https://h0.example/a.pdf",)], "url string")
    got = {tuple(r) for r in crawl.frontier(pages, seeds, 4, most, robots=robots).select("url", "depth", "parent", "fetched").collect()}
    assert got == plain_frontier(links, [url(i) for i in (0, 1, 2, 10)], 4, most, banned)
    deep = deque(got)
    assert len(deep) > 4 and crawl.frontier(pages.limit(0), seeds.limit(0)).count() == 0


def test_sitemaps_and_conditional_state(spark):
    maps = [("m", "<sitemapindex><sitemap><loc>a</loc></sitemap><x:sitemap xmlns:x='q'><x:loc> b </x:loc></x:sitemap></sitemapindex>"), ("a", "<urlset><url><loc>u1</loc><lastmod>1</lastmod></url><url><loc>u2?x=1&amp;y</loc></url></urlset>"), ("b", "<sitemapindex><sitemap><loc>m</loc></sitemap></sitemapindex><url><loc>u1</loc></url>"), ("c", None), (None, "<url><loc>z</loc></url>")]
    got = crawl.sitemap_urls(spark.createDataFrame(maps, "url string, xml string"), spark.createDataFrame([("m",)], "url string"))
    assert {tuple(r) for r in got.collect()} == {("u1", 1), ("u2?x=1&y", 1)}
    known = spark.createDataFrame([("k", "e", None), ("g", "e", None), ("m", None, "t"), ("l", "e", None), ("x", "e", None)], "url string, etag string, last_modified string")
    said = spark.createDataFrame([("k", 304, None, None), ("g", 410, None, None), ("m", 200, None, "t"), ("x", 500, None, None), ("n", 200, "f", None), ("o", 404, None, None)], "url string, status int, etag string, last_modified string")
    got = {r["url"]: (r["action"], r["reason"], r["etag"]) for r in crawl.conditional_actions(known, said).collect()}
    assert got == {"k": ("keep", "unchanged", "e"), "g": ("delete", "http_410", "e"), "m": ("keep", "unchanged", None), "l": ("delete", "not_in_source_listing", "e"), "x": ("keep", "http_500", "e"), "n": ("fetch", "new", "f")}


# -- failures stay where they are -----------------------------------------------------


def test_one_poisoned_object_a_stage(spark, tmp_path):
    good = "A sentence with enough words to be kept as a document of this corpus. " * 4
    rows = [("a.md", good), ("b.md", None), ("c.bin", good), ("d.html", "no markup at all"), ("e.boom", good), ("f.md", "short"), ("g.md", "x" * 5000), ("h.html", f"<title>T</title><body><p>{good}</p>"), (None, good), ("i.md", "")]
    df = spark.createDataFrame(rows, "uri string, content string").withColumn("title", F.lit("own"))

    def boom(content, uri):
        raise RuntimeError("bug")

    tagged = ingest.parse_objects(df, 4000, parsers={**ingest.PARSERS, "boom": boom})
    parsed, rejected = ingest.split(tagged)
    assert {r["uri"]: r["title"] for r in parsed.collect()} == {"a.md": None, "h.html": "T"}
    codes = {r["uri"]: (r["stage"], r["code"]) for r in rejected.collect()}
    assert codes == {"b.md": ("fetch", "E2003"), "c.bin": ("select_parser", "E3002"), "d.html": ("parse", "E3003"), "e.boom": ("parse", "E3030"), "f.md": ("validate", "E3005"), "g.md": ("validate", "E3001"), None: ("select_parser", "E3002"), "i.md": ("validate", "E3005")}
    lake = lakehouse.Lakehouse(spark, str(tmp_path))
    for _ in range(2):  # a repeated run adds nothing
        ingest.quarantine(lake, rejected, "r1", F.lit("2024-01-01").cast("timestamp"))
    reasons = lake.read("quarantine/reasons")
    objects = lake.log("quarantine/objects").read()
    assert reasons.count() == 8 and objects.where(F.sha2("content", 256) == F.col("content_sha256")).count() == objects.count() == 5
    assert reasons.where("raw_key is null").count() == 2
    assert {(r["stage"], r["n"]) for r in ingest.counts(tagged).groupBy("stage").agg(F.sum("n").alias("n")).collect()} == {(None, 2), ("fetch", 1), ("select_parser", 2), ("parse", 2), ("validate", 3)}


# -- assembled documents ---------------------------------------------------------------

KINDS = st.fixed_dictionaries({"kind": st.sampled_from(["heading", "paragraph", "list", "code", "quote"]), "level": st.integers(1, 6), "text": st.sampled_from(["", "one", "two lines\nhere", "täxt 漢"]), "page": st.sampled_from([None, 1, 2, 3])})


def plain_places(blocks, a, b):
    text, spans = "", []
    for x in blocks:
        text += "\n\n" if spans else ""
        part = assemble.render(x["kind"], x["level"], x["text"])
        spans.append((len(text), len(text) + len(part)))
        text += part
    at = lambda p: max(i for i, (s, _) in enumerate(spans) if s <= p)
    page = lambda p: next((blocks[i]["page"] for i in range(at(p), -1, -1) if blocks[i]["page"] is not None), None)
    last = max(a, b - 1)
    path, level = [], 7
    for i in range(at(a), -1, -1):
        if blocks[i]["kind"] == "heading" and blocks[i]["level"] < level:
            path.insert(0, blocks[i]["text"])
            level = blocks[i]["level"]
    return text, (page(a), page(last), text.count("\n", 0, a) + 1, text.count("\n", 0, last) + 1, at(a), at(last), path)


def test_places_by_plain_loop(spark):
    docs, places = [], []

    @settings(max_examples=60, deadline=None)
    @given(st.lists(KINDS, min_size=1, max_size=12), st.integers(0, 10**6), st.integers(0, 10**6))
    def collect(blocks, x, y):
        n = len(plain_places(blocks, 0, 1)[0])
        a, b = sorted((x % (n + 1), y % (n + 1)))
        docs.append((str(len(docs)), blocks))
        places.append((a, b))

    collect()
    made = assemble.assemble(spark.createDataFrame([*docs, ("null", None)], f"document_id string, blocks {assemble.BLOCKS}"))
    chunks = spark.createDataFrame([(d[0], a, b) for d, (a, b) in zip(docs, places, strict=True)], "document_id string, start_char int, end_char int")
    names = ["page_start", "page_end", "line_start", "line_end", "block_start", "block_end", "heading_path"]
    got = {r["document_id"]: tuple(r[n] for n in names) for r in assemble.locate_chunks(chunks, made).collect()}
    whole = {r["document_id"]: r["text"] for r in made.collect()}
    for (doc, blocks), (a, b) in zip(docs, places, strict=True):
        text, want = plain_places(blocks, a, b)
        assert whole[doc] == text and got[doc] == want
    assert whole["null"] == ""


def test_chunks_of_pages_have_their_places(spark, sf):
    rows = catalogue_sources.chunk_places(spark, sf).collect()
    made = {r["page_id"]: r["blocks"] for r in catalogue_sources.html_main_subtree(spark, sf).collect()}
    assert len({r["document_id"] for r in rows}) == sum(bool(b) for b in made.values())
    for r in rows:
        blocks = [{"kind": b["kind"], "level": b["level"], "text": b["text"], "page": None} for b in made[int(r["document_id"])]]
        want = plain_places(blocks, r["start_char"], r["end_char"])[1]
        assert (None, None, r["line_start"], r["line_end"], r["block_start"], r["block_end"], r["heading_path"]) == want
    assert chunking.link_chunks(catalogue_sources.QUERIES["chunk_links"](spark, sf)).count() > 0


# -- the ledger over batches -----------------------------------------------------------


def plain_ledger(docs, distance=3, margin=0.1):
    standing, out = [], []
    for i, fp, q in sorted(docs):
        if not fp:
            continue
        near = [s for s in standing if bin((s[1] ^ fp) & (2**64 - 1)).count("1") <= distance and s[0] != i]
        if not near:
            standing.append((i, fp, q))
        elif q >= near[0][2] + margin:
            out.append((near[0][0], i))
            standing = sorted([s for s in standing if s != near[0]] + [(i, fp, q)])
        else:
            out.append((i, near[0][0]))
    return sorted(out)


def some_docs(n, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.integers(1, 2**62, 6)
    return [(i, int(centres[rng.integers(6)]) ^ sum({1 << int(b) for b in rng.integers(0, 60, rng.integers(0, 4))} if rng.random() < 0.7 else ()), round(float(rng.random()), 3)) for i in range(n)] + [(n, 0, 0.9), (n + 1, 0, 0.9)]


def test_ledger_of_batches_is_that_of_one_run(spark, tmp_path):
    docs = some_docs(150)
    schema = "doc_id long, simhash long, quality double"
    pairs = lambda df: sorted((r["duplicate_id"], r["canonical_id"]) for r in df.collect())
    want = plain_ledger(docs)
    assert pairs(dedup.dedup_ledger(spark.createDataFrame(docs, schema))) == want and len(want) > 80
    index = dedup.FingerprintIndex(spark, f"pool_{tmp_path.name.replace('-', '_')}", buckets=4)
    got = []
    for k in range(0, 152, 40):
        batch = spark.createDataFrame(docs[k : k + 40], schema)
        first = pairs(index.add(batch, f"run{k}"))
        got += first
    assert sorted(got) == want
    again = pairs(index.add(spark.createDataFrame(docs[120:], schema), "run120"))  # it died after its tables and is run anew
    assert again == first
    plan = index.candidates(spark.createDataFrame([(1, 7, 0.5)], "id long, fp long, q double"), "x")._jdf.queryExecution().toString()
    assert "Bucketed: true" in plan


def test_many_copies_are_decided_in_linear_work():
    n = 30_000
    found = dedup.decide(np.arange(n), np.full(n, 9, np.uint64), np.linspace(0, 1, n))
    assert len(found) == n - 1 and set(found["canonical_id"]) and found["duplicate_id"].is_unique


# -- lineage, runs, sketches ----------------------------------------------------------


def test_lineage_with_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), (None, "a"), ("d", None), ("x", "x")], "input string, output string")
    roots = spark.createDataFrame([("a",), ("x",), (None,), ("zz",)], "root string")
    got = {tuple(r) for r in lineage.reachable(edges, roots).collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("a", "a", 3), ("a", "d", 3), ("x", "x", 1)}
    up = {tuple(r) for r in lineage.reachable(edges, spark.createDataFrame([("d",)], "root string"), "up").collect()}
    assert up == {("d", "c", 1), ("d", "b", 2), ("d", "a", 3)}
    assert lineage.reachable(edges.limit(0), roots).count() == 0


def test_trace_of_documents(spark):
    docs = spark.createDataFrame([("d", "silver"), ("e", "bronze")], "document_id string, status string")
    versions = spark.createDataFrame([("d", "v2", "s2", 2), ("d", "v1", "s1", 1)], "document_id string, document_version_id string, content_sha256 string, fetched_at int")
    chunks = spark.createDataFrame([("d", True, "1.0", "done"), ("d", True, "1.0", "missing"), ("d", True, "1.1", "done"), ("d", False, "0.9", "done")], "document_id string, is_current boolean, chunker_version string, embedding_status string")
    got = {r["document_id"]: r for r in lineage.trace(docs, versions, chunks).collect()}
    assert [v["document_version_id"] for v in got["d"]["versions"]] == ["v1", "v2"] and got["d"]["embedding"] == {"done": 2, "missing": 1}
    assert got["d"]["chunkers"] == ["1.0", "1.1"] and got["e"]["n_chunks"] == 0


def test_a_run_is_observed_while_it_runs(spark, tmp_path):
    lake = lakehouse.Lakehouse(spark, str(tmp_path))
    rows = spark.range(10).select(F.lit("2024-01-01").cast("date").alias("snapshot_date"), F.concat(F.lit("m"), "id").alias("metric"), F.col("id").cast("double").alias("value"))
    with runs.Run(lake, "r1", "stats", "silver/documents", "gold/stats") as run:
        kept = run.reads(rows).where("value < 7")
        lake.write("gold/stats", run.writes(kept, rejected=F.col("value") > 5, mean=F.avg("value")), run_id="r1")
    with pytest.raises(ZeroDivisionError), runs.Run(lake, "r2", "stats", "a", "b"):
        1 / 0
    got = {r["run_id"]: r for r in lake.log("ops/runs").read().collect()}
    assert (got["r1"]["rows_in"], got["r1"]["rows_out"], got["r1"]["rows_rejected"], got["r1"]["metrics"]) == (10, 6, 1, {"mean": 3.0})
    assert got["r2"]["status"] == "failed" and "division" in got["r2"]["error"] and got["r1"]["finished_at"] >= got["r1"]["started_at"]
    edge = lake.log("ops/lineage").read().collect()
    assert [(e["input"], e["output"], e["rows_in"], e["rows_out"]) for e in edge] == [("silver/documents", "gold/stats", 10, 6)]
    assert lineage.for_run(lake.log("ops/lineage").read(), "r1").count() == lineage.latest_for(lake.log("ops/lineage").read(), "gold/stats").count() == 1


def test_progress_of_streams(spark, tmp_path):
    import time

    spark.range(20).repartition(2).write.parquet(str(tmp_path / "in"))
    seen = runs.Progress()
    spark.streams.addListener(seen)
    try:
        spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).writeStream.queryName("q").format("parquet").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        end = time.time() + 20
        while not seen.ended and time.time() < end:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(seen)
    assert seen.rows(spark).where("query = 'q'").agg(F.sum("rows_in")).first()[0] == 20 and seen.ended[0][1] is None


def test_merged_sketches_answer_as_one(spark):
    df = spark.range(60_000).select((F.col("id") % 7).alias("part"), (F.col("id") % 20_000).alias("key"), F.rand(1).alias("x"))
    parts = sketches.build(df, ["part"], "key", "x").checkpoint()
    one = sketches.estimates(sketches.merge(parts)).first()
    assert abs(one["distinct_hll"] - 20_000) <= sketches.HLL_ERROR * 20_000 and abs(one["distinct_theta"] - 20_000) <= sketches.THETA_ERROR * 20_000
    assert abs(one["p50"] - 0.5) < 0.01 and abs(one["p90"] - 0.9) < 0.01 and one["n"] == 60_000
    a = sketches.build(spark.range(15_000).select(F.lit(1).alias("g"), "id", F.lit(0.0).alias("x")), ["g"], "id", "x").select("g", F.col("theta").alias("a"))
    b = sketches.build(spark.range(10_000, 30_000).select(F.lit(1).alias("g"), "id", F.lit(0.0).alias("x")), ["g"], "id", "x").select("g", F.col("theta").alias("b"))
    got = a.join(b, "g").select(*(c.alias(k) for k, c in sketches.overlap(F.col("a"), F.col("b")).items())).first()
    for k, exact in {"both": 5_000, "first": 10_000, "either": 30_000}.items():
        assert abs(got[k] - exact) <= 2 * sketches.THETA_ERROR * 30_000


# -- layout --------------------------------------------------------------------------


def test_blocks_of_a_laid_out_document(spark):
    rows = []
    for page in (1, 2, 3):
        rows += [("d", page, 800.0, 50.0, 200.0, 20.0, 8.0, "Serif", f"Head {page}"), ("d", page, 800.0, 50.0, 90.0, 780.0, 10.0, "Serif", f"{page} / 3")]
    put = lambda page, y, text, size=10.0, font="Serif", x=50.0, x1=300.0: rows.append(("d", page, 800.0, x, x1, float(y), size, font, text))
    put(1, 100, "Title", 20.0)
    put(1, 120, "Part", 14.0)
    put(1, 140, "A line that is hyphen-")
    put(1, 155.5, "world", x=105.0)
    put(1, 155, "ated", x1=100.0)
    put(1, 170, "Strong", font="Serif-Bold")
    put(1, 190, "x = 1", font="Courier")
    put(1, 205, "  y = 2", font="Courier")
    for k, cells in enumerate((("a", "b"), ("1", "2"), ("3",))):
        for i, c in enumerate(cells):
            put(2, 300 + 15 * k, c, x=50.0 + 100 * i, x1=60.0 + 100 * i)
    put(2, 360, "Head 7")
    put(3, 100, "Last one.", 14.0)
    rows += [("e", 1, 800.0, 0.0, 1.0, 1.0, 9.0, None, "only"), ("f", 1, 800.0, 0.0, 1.0, 1.0, 9.0, "x", "  "), ("g", 1, 800.0, 0.0, 1.0, 1.0, 9.0, "x", None)]
    spans = spark.createDataFrame(rows, "document_id string, page int, height double, x double, x1 double, y double, size double, font string, text string").repartition(3)
    got = [tuple(r) for r in layout.blocks(spans).orderBy("document_id", "ordinal").collect()]
    assert [g[2:] for g in got if g[0] == "d"] == [
        (1, "heading", 1, "Title"), (1, "heading", 2, "Part"), (1, "paragraph", 0, "A line that is hyphenated world"), (1, "heading", 3, "Strong"), (1, "code", 0, "x = 1\ny = 2"),
        (2, "table", 0, "| a | b |\n|---|---|\n| 1 | 2 |"), (2, "paragraph", 0, "3"), (3, "paragraph", 0, "Last one."),
    ]
    assert [g[1:] for g in got if g[0] == "e"] == [(0, 1, "paragraph", 0, "only")] and len({g[0] for g in got}) == 2
    made = assemble.assemble(layout.documents(spans)).where("document_id = 'd'")
    where = made.withColumns(assemble.locate(F.instr("text", "Last").cast("int") - 1, F.instr("text", "Last").cast("int"))).first()
    assert where["page_start"] == 3 and where["heading_path"] == ["Title", "Part", "Strong"] and layout.blocks(spans.limit(0)).count() == 0


def test_components_of_long_chains(spark, monkeypatch):
    links = [(i, i + 1) for i in range(1, 200)] + [(i, i + 1) for i in range(300, 310)] + [(310, 300), (500, 501)]
    rounds, plain = [], type(spark.range(1)).isEmpty
    monkeypatch.setattr(type(spark.range(1)), "isEmpty", lambda df: rounds.append(1) or plain(df))
    got = {r["node"]: r["component"] for r in dedup.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 1 for i in range(1, 201)}, **{i: 300 for i in range(300, 311)}, 500: 500, 501: 500} and len(rounds) < 15


def test_front_matter_and_mdx(spark):
    files = ["---\ntitle: A 'b'\nempty:\n---\n# H", "no front", "---\n---\nx", "---\ntitle: x\nnever closed", None, "---\na: [1, 'two', ]\nb: \"q # r\"\n---", "text\n---\na: 1\n---\n"]
    df = spark.createDataFrame([(f,) for f in files], "f string")
    got = [(r["m"], r["b"]) for r in df.select(markdown.front_matter(F.col("f")).alias("m"), markdown.body(F.col("f")).alias("b")).collect()]
    assert got[0] == ({"title": "A 'b'", "empty": ""}, "# H") and got[1] == ({}, "no front") and got[2] == ({}, "x")
    assert got[3] == ({}, files[3]) and got[4] == (None, None) and got[5][0]["a"] == "1, two" and got[6] == ({}, files[6])
    mdx = 'import Tabs from "@theme/Tabs"\n\n# Title\n\n<Tabs>\n<TabItem value="a">Body text here.</TabItem>\n</Tabs>\nexport const x = 1'
    out = spark.createDataFrame([(mdx,)], "f string").select(markdown.strip_mdx(F.col("f"))).first()[0]
    assert "import" not in out and "export" not in out and "Body text here." in out and "<" not in out
    levels = spark.createDataFrame([("internal", "restricted"), ("restricted", "public"), ("public", "odd"), ("public", None)], "l string, r string")
    assert [r[0] for r in levels.select(markdown.raise_only(F.col("l"), F.col("r"))).collect()] == ["restricted", "restricted", "public", "public"]
