"""Queries of the sources, the runs and the streams of documents, each with SQL to check it by."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import markdown
from corpusloom.functions.text import let
from corpusloom.operators import answers, assemble, chunking, ingest, lineage, retrieval, sketches
from corpusloom.plans.catalogue import _SECRET, QUERIES, SQL, query, table
from corpusloom.session import checkpointed, shared_folder, spread
from corpusloom.sources import crawl, dom, layout
from corpusloom.streaming import documents as streams

__all__ = ["QUERIES", "SQL"]


# -- web pages -----------------------------------------------------------------


@query()
def html_main_subtree(spark, d):
    return dom.main_subtree(table(spark, d, "pages")).withColumn("meta", F.to_json("meta"))


def _linked_pages(spark, d):
    """The table's pages lead to no page of the table; here their references are led to pages of
    five hosts, by the page's number and each reference's place and length."""
    refs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    to = lambda x, i: (F.col("page_id") * 7 + (i + 1) * 13 + F.length(x)) % 48 * 5 + F.col("page_id") % 5
    ref = lambda x, i: F.concat(F.lit('<a class="x" href="'), F.when(i % 2 == 0, F.lit("/d/../p")).otherwise(F.lit("p")), to(x, i).cast("string"), F.when(i % 4 == 3, F.lit("x")).otherwise(F.lit("#top")), F.lit('">l</a>'))
    url = F.concat(F.lit("https://Site"), F.col("page_id") % 5, F.lit(".example/p"), F.col("page_id"))
    return table(spark, d, "pages").where("html is not null").select("page_id", url.alias("url"), F.concat(F.lit("<body><!-- <a href='/no'> -->"), F.array_join(F.transform(refs, ref), " "), F.lit("</body>")).alias("html"))


_LINKS = """l AS (SELECT DISTINCT u AS url, t AS target FROM (
  SELECT 'https://site' || (page_id % 5) || '.example/p' || page_id AS u, 'https://site' || (page_id % 5) || '.example/p' || ((page_id * 7 + i * 13 + length(r[i])) % 48 * 5 + page_id % 5) || CASE WHEN i % 4 = 0 THEN 'x' ELSE '' END AS t
  FROM (SELECT page_id, r, unnest(range(1, len(r) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS r FROM pages WHERE html IS NOT NULL))) WHERE u <> t)"""


@query(f"""WITH RECURSIVE h AS (SELECT page_id, 'https://site' || (page_id % 5) || '.example/p' || page_id AS url FROM pages WHERE html IS NOT NULL), {_LINKS},
r(url, depth) AS (SELECT min(url), 0 FROM h GROUP BY page_id % 5 UNION SELECT l.target, r.depth + 1 FROM r JOIN l USING (url) WHERE r.depth < 3),
b AS (SELECT url, min(depth) AS depth FROM r GROUP BY url)
SELECT b.url, b.depth, (SELECT min(p.url) FROM b p JOIN l ON l.url = p.url WHERE l.target = b.url AND p.depth = b.depth - 1) AS parent, b.url IN (SELECT url FROM h) AS fetched FROM b""")
def crawl_frontier(spark, d):
    found = _linked_pages(spark, d)
    seeds = found.groupBy(F.col("page_id") % 5).agg(F.min("url").alias("url"))
    return crawl.frontier(found, seeds, max_depth=3, max_pages=100_000)


_MARK = "'e' || length(html)"


@query(f"""WITH k AS (SELECT url, min({_MARK}) AS etag FROM pages WHERE page_id % 5 <> 0 AND html IS NOT NULL GROUP BY url),
r AS (SELECT url, min(CASE page_id % 11 WHEN 0 THEN 404 WHEN 1 THEN 304 WHEN 2 THEN 500 ELSE 200 END) AS status, min(CASE WHEN page_id % 4 = 0 THEN 'new' ELSE {_MARK} END) AS etag FROM pages WHERE page_id % 7 <> 3 AND html IS NOT NULL GROUP BY url),
j AS (SELECT url, k.etag AS ke, r.etag AS re, status, k.url IS NOT NULL AS known, r.url IS NOT NULL AS answered FROM k FULL JOIN r USING (url))
SELECT url, CASE WHEN known AND (NOT answered OR status = 404) THEN 'delete' WHEN status = 200 AND (NOT known OR ke <> re) THEN 'fetch' ELSE 'keep' END AS action,
CASE WHEN known AND NOT answered THEN 'not_in_source_listing' WHEN known AND status = 404 THEN 'http_404' WHEN status = 200 AND NOT known THEN 'new' WHEN status = 200 AND ke <> re THEN 'changed' WHEN status IN (200, 304) THEN 'unchanged' ELSE 'http_' || status END AS reason
FROM j WHERE known OR status = 200""")
def conditional_state(spark, d):
    p = table(spark, d, "pages").where("html is not null")
    mark = F.concat(F.lit("e"), F.length("html"))
    known = p.where("page_id % 5 <> 0").groupBy("url").agg(F.min(mark).alias("etag")).withColumn("last_modified", F.lit(None).cast("string"))
    status = F.expr("CASE page_id % 11 WHEN 0 THEN 404 WHEN 1 THEN 304 WHEN 2 THEN 500 ELSE 200 END")
    answers = p.where("page_id % 7 <> 3").groupBy("url").agg(F.min(status).alias("status"), F.min(F.when(F.col("page_id") % 4 == 0, "new").otherwise(mark)).alias("etag")).withColumn("last_modified", F.lit(None).cast("string"))
    return crawl.conditional_actions(known, answers).select("url", "action", "reason")


# -- parsing with isolated failures -----------------------------------------------


@query(f"""WITH o AS (SELECT CASE WHEN doc_id % 13 = 0 THEN NULL ELSE text END AS text, doc_id % 17 = 0 AS odd FROM documents),
a AS (SELECT CASE WHEN text IS NULL THEN 'fetch E2003' WHEN octet_length(encode(text)) > 20000 THEN 'validate E3001' WHEN odd THEN 'select_parser E3002'
  WHEN contains(text, chr(0)) OR length(regexp_replace(text, '[^�]', '', 'g')) > 0.01 * greatest(1, length(text)) THEN 'validate E3004' WHEN length(trim(text, ' ')) < 100 THEN 'validate E3005' WHEN {_SECRET} THEN 'validate E3008' WHEN octet_length(encode(text)) < 64 THEN 'validate E3001' END AS f, 'document' AS kind FROM o
  UNION ALL SELECT CASE WHEN html IS NULL THEN 'fetch E2003' WHEN octet_length(encode(html)) > 20000 THEN 'validate E3001' WHEN NOT regexp_matches(html, '<[a-zA-Z]') THEN 'parse E3003' END, 'page' FROM pages)
SELECT kind, split_part(f, ' ', 1) AS stage, split_part(f, ' ', 2) AS code, count(*) AS n FROM a GROUP BY kind, f""")
def ingest_counts(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc://x/"), "doc_id", F.when(F.col("doc_id") % 17 == 0, ".bin").otherwise(".md")).alias("uri"), F.when(F.col("doc_id") % 13 != 0, F.col("text")).alias("content"), F.lit("document").alias("kind"))
    html = table(spark, d, "pages").select(F.concat("url", F.lit("/page.html")).alias("uri"), F.col("html").alias("content"), F.lit("page").alias("kind"))
    tagged = ingest.parse_objects(docs, max_bytes=20_000).select("kind", "stage", "code").union(ingest.parse_objects(html, max_bytes=20_000, validate=False).select("kind", "stage", "code"))
    return tagged.groupBy("kind", "stage", "code").agg(F.count("*").alias("n"))


@query()
def chunk_places(spark, d):
    """Chunks of the pages' main subtrees with the lines, blocks and heading paths of the assembled documents."""
    blocks = dom.main_subtree(table(spark, d, "pages")).select(F.col("page_id").cast("string").alias("document_id"), F.transform("blocks", lambda b: F.struct(b["kind"].alias("kind"), b["level"].alias("level"), b["text"].alias("text"), F.lit(None).cast("int").alias("page"))).alias("blocks"))
    made = checkpointed(assemble.assemble(blocks))
    chunks = chunking.chunk_documents(made)
    return assemble.locate_chunks(chunks, made).select("document_id", "chunk_index", "chunk_id", "start_char", "end_char", "page_start", "line_start", "line_end", "block_start", "block_end", "heading_path")


# -- the status of documents -------------------------------------------------------

_HOURS = 48


def _status_events(spark, d):
    kind = F.when(F.col("event_type").isin("signup", "view"), "fetch").when(F.col("event_type") == "purchase", "parsed").when(F.col("event_type") == "error", "delete").otherwise("other")
    return table(spark, d, "events").select(F.col("user_id").alias("document_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), F.concat("event_type", F.col("event_id") % 3).alias("content"))


_MOVE = "CASE WHEN kind IN ('fetch', 'delete') THEN {'kind': kind, 'ts': ts} END"
_STATUS = f"""WITH e AS (SELECT user_id AS document_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'fetch' WHEN 'view' THEN 'fetch' WHEN 'purchase' THEN 'parsed' WHEN 'error' THEN 'delete' ELSE 'other' END AS kind, event_type || (event_id % 3) AS content FROM events),
m AS (SELECT *, last_value({_MOVE} IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was, first_value({_MOVE} IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM e),
l AS (SELECT *, sum(CASE WHEN kind IN ('fetch', 'delete') AND was.kind = 'delete' AND ts > was.ts + INTERVAL {_HOURS} HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS life FROM m),
f AS (SELECT *, row_number() OVER (PARTITION BY document_id, life, kind, content ORDER BY ts, event_id) = 1 AS fresh FROM l),
s AS (SELECT *, CASE WHEN kind = 'delete' THEN 'deleted' WHEN kind = 'fetch' AND (fresh OR was.kind = 'delete') THEN 'bronze' WHEN kind = 'parsed' AND was.kind = 'fetch' THEN 'silver' END AS status FROM f)
SELECT document_id, event_id, ts, status FROM s WHERE status IS NOT NULL
UNION ALL SELECT document_id, NULL, ts + INTERVAL {_HOURS} HOUR, 'purged' FROM s WHERE kind = 'delete' AND (nxt IS NULL OR nxt.ts > ts + INTERVAL {_HOURS} HOUR)"""


@query(_STATUS)
def document_status(spark, d):
    out = streams.status_changes_batch(_status_events(spark, d), F.lit("2090-01-01").cast("timestamp"), _HOURS)
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(_STATUS)
def document_status_stream(spark, d):
    """The same by the stateful stream over files of events in any order. A last event far in the
    future, of no document, brings the watermark past all others."""
    home, e = shared_folder(spark, "status"), _status_events(spark, d)
    e.repartition(3).write.parquet(f"{home}/in")
    last = spark.createDataFrame([(-1, -1, "other", "")], "document_id long, event_id long, kind string, content string").withColumn("ts", F.lit("2099-01-01").cast("timestamp"))
    last.select(*e.columns).coalesce(1).write.mode("append").parquet(f"{home}/in")
    streams.run_status(spark, spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(f"{home}/in"), f"{home}/out", f"{home}/mark", retention_hours=_HOURS, late="3650 days")
    return spark.read.parquet(f"{home}/out").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# -- lineage and sketches -----------------------------------------------------------

_EDGES = "e AS (SELECT DISTINCT 'n' || (event_id % 211) AS input, 'n' || ((event_id * event_id + user_id) % 211) AS output FROM events WHERE event_type = 'purchase' AND event_id % 211 <> (event_id * event_id + user_id) % 211)"


@query(f"""WITH RECURSIVE {_EDGES},
dn(root, node, distance) AS (SELECT DISTINCT input, input, 0 FROM e WHERE input IN ('n0', 'n1', 'n2') UNION SELECT d.root, e.output, d.distance + 1 FROM dn d JOIN e ON e.input = d.node WHERE d.distance < 12),
up(root, node, distance) AS (SELECT DISTINCT input, input, 0 FROM e WHERE input IN ('n0', 'n1', 'n2') UNION SELECT d.root, e.input, d.distance + 1 FROM up d JOIN e ON e.output = d.node WHERE d.distance < 12)
SELECT 'down' AS direction, root, node, min(distance) AS distance FROM dn WHERE distance > 0 GROUP BY root, node
UNION ALL SELECT 'up', root, node, min(distance) FROM up WHERE distance > 0 GROUP BY root, node""")
def lineage_closure(spark, d):
    """What three datasets lead to and come from, over edges that the events stand for."""
    e = table(spark, d, "events").where("event_type = 'purchase'").select(F.concat(F.lit("n"), F.col("event_id") % 211).alias("input"), F.concat(F.lit("n"), (F.col("event_id") * F.col("event_id") + F.col("user_id")) % 211).alias("output")).where("input <> output").distinct()
    roots = e.where(F.col("input").isin("n0", "n1", "n2")).select(F.col("input").alias("root")).distinct()
    ways = [lineage.reachable(e, roots, way, 12).select(F.lit(way).alias("direction"), "root", "node", "distance") for way in ("down", "up")]
    return ways[0].union(ways[1])


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS exact, TRUE AS hll_ok, TRUE AS theta_ok, TRUE AS p50_ok, TRUE AS p90_ok FROM events GROUP BY event_type""")
def sketches_merged(spark, d):
    """Sketches of each day and type, merged over the days: are they within their stated errors of the exact numbers?"""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    kept = checkpointed(sketches.build(e, ["day", "event_type"], "user_id", "value"))
    got = sketches.estimates(sketches.merge(kept, ["event_type"]))
    exact = e.groupBy("event_type").agg(F.count_distinct("user_id").alias("exact"))
    both = got.join(exact, "event_type").join(e.select("event_type", "value"), "event_type")
    near = lambda est, err: F.abs(F.col(est) - F.col("exact")) <= err * F.col("exact") + 0.5
    rank = lambda p: F.abs(F.avg((F.col("value") <= F.col(f"p{p}")).cast("double")) - p / 100) <= sketches.KLL_ERROR + 1 / F.greatest(F.count("value"), F.lit(1))
    keys = ["event_type", "n", "exact", near("distinct_hll", sketches.HLL_ERROR).alias("hll_ok"), near("distinct_theta", sketches.THETA_ERROR).alias("theta_ok")]
    return both.groupBy(*keys).agg(rank(50).alias("p50_ok"), rank(90).alias("p90_ok"))


@query("""SELECT l_returnflag, l_linestatus, grouping(l_returnflag) * 2 + grouping(l_linestatus) AS level, count(*) AS n, CAST(round(sum(l_quantity), 2) AS DOUBLE) AS quantity FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""")
def sql_grouping_sets(spark, d):
    df = table(spark, d, "lineitem")
    out = df.groupingSets([["l_returnflag", "l_linestatus"], ["l_returnflag"], []], "l_returnflag", "l_linestatus")
    return out.agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")).select("l_returnflag", "l_linestatus", "level", "n", "quantity")


@query()
def sitemap_listing(spark, d):
    """Addresses that sitemaps name: one for each host of the pages, under an index of all."""
    p = table(spark, d, "pages").where("url is not null").withColumn("host", crawl.host(F.col("url")))
    entry = F.concat(F.lit("<url><loc>"), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    maps = p.groupBy("host").agg(F.concat(F.lit("<urlset>"), F.array_join(F.sort_array(F.collect_list(entry)), ""), F.lit("</urlset>")).alias("xml")).select(F.concat(F.lit("map://"), "host").alias("url"), "xml")
    index = maps.agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("<sitemap><loc>"), "url", F.lit("</loc></sitemap>")))), ""), F.lit("</sitemapindex>")).alias("xml")).select(F.lit("map://all").alias("url"), "xml")
    return crawl.sitemap_urls(maps.union(index), index.select("url"))


SQL["sitemap_listing"] = "SELECT DISTINCT url, 1 AS depth FROM pages WHERE url IS NOT NULL"


# -- pages by layout ------------------------------------------------------------------


def _laid_out(spark, d):
    """Every document as spans: eight words a line, forty lines a page, a running head, a heading each
    fifteenth line, a row of three cells each tenth and eleventh, code each thirteenth."""
    w = F.filter(F.split(F.regexp_replace("text", r"[^\p{L}\p{N} ]+", " "), " +"), lambda x: x != "")
    w = F.transform(w, lambda x: F.substring(x, 1, 12))
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    cut = lambda w: F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), F.ceil(F.size(w) / 8).cast("int") - 1), lambda n: F.struct(n.alias("n"), F.slice(w, n * 8 + 1, F.lit(8)).alias("w"))))
    df = spread(docs).select("document_id", F.explode(let(w, cut)).alias("l")).select("document_id", "l.n", "l.w")  # a line takes its own words along, not the document's
    page, at = (F.floor(F.col("n") / 40) + 1).cast("int"), F.col("n") % 40
    y = 100.0 + 15.0 * at
    span = lambda x, x1, size, font, text: F.struct(F.lit(x).alias("x"), F.lit(x1).alias("x1"), y.alias("y"), F.lit(size).alias("size"), F.lit(font).alias("font"), text.alias("text"))
    joined = F.array_join("w", " ")
    cell = lambda i: F.coalesce(F.get("w", F.lit(i)), F.lit("none"))
    here = F.when(at % 15 == 0, F.array(span(50.0, 300.0, 16.0, "Serif", joined)))
    here = here.when((at % 10 == 8) | (at % 10 == 9), F.array(span(50.0, 90.0, 10.0, "Serif", cell(0)), span(200.0, 240.0, 10.0, "Serif", cell(1)), span(350.0, 390.0, 10.0, "Serif", cell(2))))
    here = here.when(at % 13 == 5, F.array(span(50.0, 300.0, 10.0, "Courier", joined))).otherwise(F.array(span(50.0, 120.0, 10.0, "Serif", cell(0)), span(124.0, 300.0, 10.0, "Serif", F.array_join(F.slice("w", 2, 7), " "))))
    body = df.select("document_id", page.alias("page"), F.lit(800.0).alias("height"), F.explode(here).alias("s")).select("document_id", "page", "height", "s.*")
    head = df.where("n % 40 = 0").select("document_id", page.alias("page"), F.lit(800.0).alias("height")).distinct().select("*", F.lit(50.0).alias("x"), F.lit(300.0).alias("x1"), F.lit(20.0).alias("y"), F.lit(10.0).alias("size"), F.lit("Serif").alias("font"), F.concat(F.lit("Report page "), "page").alias("text"))
    return body.unionByName(head)


@query("""WITH w AS (SELECT doc_id::VARCHAR AS document_id, list_filter(regexp_split_to_array(regexp_replace(text, '[^\\p{L}\\p{N} ]+', ' ', 'g'), ' +'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
n AS (SELECT document_id, unnest(range((len(w) + 7) // 8)) AS n FROM w WHERE len(w) > 0),
r AS (SELECT document_id, n // 40 + 1 AS page, n % 40 AS k, k % 15 = 0 AS head, k % 10 IN (8, 9) AND k % 15 <> 0 AS cells, k % 13 = 5 AND NOT head AND NOT cells AS mono FROM n),
c AS (SELECT *, cells AND (coalesce(lag(cells) OVER o, false) OR coalesce(lead(cells) OVER o, false)) AS part FROM r WINDOW o AS (PARTITION BY document_id, page ORDER BY k))
SELECT document_id, count(*) FILTER (head) AS headings, count(*) FILTER (part) AS table_rows, count(*) FILTER (mono) AS code_lines, CASE WHEN max(page) < 3 THEN max(page) ELSE 0 END AS heads_kept FROM c GROUP BY document_id""")
def layout_counts(spark, d):
    """How many lines of each kind the layout of a document gives; its running head goes from three pages on."""
    b = layout.blocks(_laid_out(spark, d))
    rows = F.size(F.split("text", "\n"))
    return b.groupBy("document_id").agg(
        F.count_if(F.col("kind") == "heading").alias("headings"),
        F.coalesce(F.sum(F.when(F.col("kind") == "table", rows - 1)), F.lit(0)).cast("long").alias("table_rows"),
        F.coalesce(F.sum(F.when(F.col("kind") == "code", rows)), F.lit(0)).cast("long").alias("code_lines"),
        F.count_if((F.col("kind") == "paragraph") & F.col("text").rlike(r"^Report page \d+")).alias("heads_kept"),
    )


@query()
def layout_blocks(spark, d):
    return layout.blocks(_laid_out(spark, d))


# -- several variants a query, places of passages, the embedding cache ----------------------


@query("""WITH v AS (SELECT vec_id // 50 AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 < 3),
s AS (SELECT query_id, vec_id, max(round(list_cosine_similarity(q, embedding::DOUBLE[]), 6) + 0.0) AS score FROM v, embeddings GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 10""")
def dense_variants(spark, d):
    """Questions of three vectors each against all vectors."""
    v = table(spark, d, "embeddings")
    asked = v.where("vec_id % 50 < 3").select(F.floor(F.col("vec_id") / 50).alias("query_id"), "embedding")
    return retrieval.dense_variants(v, asked, k=10)


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'T' || (doc_id % 7) || ', p. ' || (doc_id % 5) || CASE WHEN doc_id % 3 > 0 THEN '–' || (doc_id % 5 + doc_id % 3) ELSE '' END
WHEN 1 THEN 'repo/' || 'src/f' || doc_id || '.md#L' || (doc_id % 9) || '-L' || (doc_id % 9 + 3) || ' @ main'
WHEN 2 THEN 'https://h/' || doc_id || CASE WHEN len(w) > 0 THEN '#:~:text=' || array_to_string(w[1:8], ' ') ELSE '' END ELSE 'https://h/' || doc_id END AS locator
FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM documents)""")
def result_locators(spark, d):
    """Where a passage stands, for each kind of source."""
    docs = table(spark, d, "documents")
    kind = F.element_at(F.array(*map(F.lit, ("pdf", "github", "html", "upload"))), (F.col("doc_id") % 4 + 1).cast("int"))
    row = {
        "title": F.concat(F.lit("T"), F.col("doc_id") % 7), "uri": F.concat(F.lit("https://h/"), "doc_id"), "page_start": F.col("doc_id") % 5, "page_end": F.col("doc_id") % 5 + F.col("doc_id") % 3, "line_start": F.col("doc_id") % 9,
        "line_end": F.col("doc_id") % 9 + 3, "repo": F.lit("repo"), "path": F.concat(F.lit("src/f"), "doc_id", F.lit(".md")), "branch": F.lit("main"), "text": F.coalesce("text", F.lit("")),
    }
    return docs.select("doc_id", answers.locator(kind, row).alias("locator"))


@query("""WITH c AS (SELECT user_id AS digest, max(ts) AS last_used, count(*) AS hits FROM events WHERE event_type = 'view' GROUP BY user_id),
a AS (SELECT user_id AS digest, count(*) AS n FROM events WHERE event_type = 'purchase' AND user_id % 9 = 0 GROUP BY user_id),
h AS (SELECT c.digest, CASE WHEN a.n IS NULL THEN last_used ELSE TIMESTAMP '2024-02-01 00:00:00' END AS last_used, hits + coalesce(n, 0) AS hits FROM c LEFT JOIN a USING (digest))
SELECT digest, last_used, hits FROM h WHERE last_used > TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 5 DAY ORDER BY last_used DESC, hits DESC, digest LIMIT 60""")
def cache_after_a_batch(spark, d):
    """The embedding cache after lookups were counted and old entries have gone."""
    e = table(spark, d, "events")
    cache = e.where("event_type = 'view'").groupBy(F.col("user_id").alias("digest")).agg(F.max("ts").alias("last_used"), F.count("*").alias("hits"))
    asked = e.where("event_type = 'purchase' and user_id % 9 = 0").select(F.col("user_id").alias("digest"))
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    return answers.cache_evict(answers.cache_hits(cache, asked, now), 60, now, 5)


@query("SELECT word, count(*) AS n FROM (SELECT unnest(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]{3,}'))) AS word FROM documents) GROUP BY word HAVING count(*) >= 2")
def vocabulary(spark, d):
    return answers.vocabulary(table(spark, d, "documents"))


# -- front matter -----------------------------------------------------------------------


@query("""SELECT doc_id, 'Doc: ' || doc_id AS title, 'a, ' || lang AS tags, 'x, y z' AS owners, CASE WHEN doc_id % 3 = 0 THEN 'restricted' ELSE 'internal' END AS level, 5::INT AS n_fields, length(text)::INT AS n_body
FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL""")
def front_matter_fields(spark, d):
    """Every document as a file with front matter, its fields read back."""
    head = F.concat(F.lit('---\ntitle: "Doc: '), "doc_id", F.lit('" # shown\ntags: [a, \''), "lang", F.lit("']\nowners:\n  - x\n  - y z\nsecurity_level: public\nsecurity_level: "), F.when(F.col("doc_id") % 3 == 0, "restricted").otherwise("public"), F.lit("\nother:\n  nested: 1\n---\n"))
    df = table(spark, d, "documents").where("text is not null and lang is not null").select("doc_id", F.concat(head, "text").alias("file"))
    df = df.withColumn("f", markdown.front_matter(F.col("file")))
    return df.select("doc_id", F.col("f")["title"].alias("title"), F.col("f")["tags"].alias("tags"), F.col("f")["owners"].alias("owners"), markdown.raise_only(F.lit("internal"), F.col("f")["security_level"]).alias("level"), F.size("f").alias("n_fields"), F.length(markdown.body(F.col("file"))).alias("n_body"))
