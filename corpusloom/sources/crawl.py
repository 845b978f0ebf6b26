"""The frontier of a crawl over a table of pages: links, robots rules, sitemaps, conditional state.

Fetching lies outside Spark. What a crawl has brought is a table pages(url, html), and these
operators tell which addresses are reached, how deep, and which are to be fetched next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import ids
from corpusloom.session import checkpointed
from corpusloom.sources.pages import allowed, decode

# Fixed value: files that a crawl leaves alone by default.
DENY = r"\.(png|jpe?g|gif|svg|css|js|zip|pdf)(\?|$)"

_HREF = r"""(?is)<a\s(?:[^>"']|"[^"]*"|'[^']*')*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
_BASE = _HREF.replace("<a", "<base")
#: Over how many parts the addresses of a host are dealt where the first of them are looked for.
SPREAD = 64


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def resolve(base: Column, href: Column) -> Column:
    """The absolute address of a reference found on `base`, without fragment; dot segments stay."""
    ref = F.regexp_extract(F.trim(href), r"^([^#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(path, r"^/?(.*/)?[^/]*$", 1))
    return (
        F.when(ref == "", F.regexp_extract(base, r"^([^#]*)", 1))
        .when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(scheme, ref))
        .when(ref.startswith("/"), F.concat(root, ref))
        .when(ref.startswith("?"), F.concat(root, F.when(path == "", "/").otherwise(path), ref))
        .otherwise(F.concat(root, folder, ref))
    )


def hrefs(html: Column) -> Column:
    """The references of a page's anchors, in order; comments and scripts are left out."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|template)\b.*?</\1\s*>", " ")
    return F.transform(F.regexp_extract_all(bare, F.lit(_HREF), F.lit(1)), lambda x: decode(F.regexp_replace(x, r"""^["']|["']$""", "")))


def links(pages: DataFrame) -> DataFrame:
    """(url, target) for each anchor of a page, both canonical; other schemes are left out."""
    base = F.regexp_extract("html", _BASE, 1)
    own = F.when(base != "", resolve(F.col("url"), decode(F.regexp_replace(base, r"""^["']|["']$""", "")))).otherwise(F.col("url"))
    each = pages.where("url is not null and html is not null").select("url", own.alias("base"), F.explode(hrefs(F.col("html"))).alias("href"))
    each = each.withColumn("target", resolve(F.col("base"), F.col("href"))).where(F.col("target").rlike(r"^(?i)https?://[^/?#]+"))
    return each.select(ids.canonical_uri(F.col("url")).alias("url"), F.col("target").alias("raw"), ids.canonical_uri(F.col("target")).alias("target"))


def robots_allow(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows of `urls` that no rule(host, path, allow) forbids: of a host's rules whose path begins
    the address's the longest holds, an allowance before a ban of the same length."""
    of = rules.where("path <> ''").groupBy(F.lower("host").alias("_host")).agg(F.collect_set(F.struct("path", "allow")).alias("_rules"))
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    joined = urls.withColumn("_host", host(F.col("url"))).withColumn("_path", F.when(path == "", "/").otherwise(path)).join(of, "_host", "left")
    fit = F.filter("_rules", lambda r: F.startswith(F.col("_path"), r["path"]))
    verdict = F.array_max(F.transform(fit, lambda r: F.struct(F.length(r["path"]).alias("n"), r["allow"].alias("allow"))))["allow"]
    return joined.where(F.coalesce(verdict, F.lit(True))).select(*urls.columns)


def _first_of_hosts(urls: DataFrame, used: DataFrame | None, most: int) -> DataFrame:
    """Up to `most` addresses of each host, less those it has used, the first by address. Parts
    of a host are cut before they meet, so no task sorts all of a host's addresses."""
    part = F.pmod(F.xxhash64("url"), F.lit(SPREAD))
    cut = urls.withColumn("_host", host(F.col("url"))).withColumn("_part", part)
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("url"))
    cut = cut.withColumn("_n", rank("_host", "_part")).where(F.col("_n") <= most)
    left = F.lit(most)
    if used is not None:
        cut = cut.join(used, "_host", "left")
        left = most - F.coalesce("_used", F.lit(0))
    return cut.withColumn("_n", rank("_host")).where(F.col("_n") <= left).select(*urls.columns)


def frontier(pages: DataFrame, seeds: DataFrame, max_depth: int = 2, max_pages: int = 500, same_host: bool = True, allow: list[str] = (), deny: list[str] = (DENY,), robots: DataFrame | None = None) -> DataFrame:
    """(url, depth, parent, fetched) of every address reached from `seeds`(url), breadth first.

    A level is the links of the level before, less what was visited, by an anti join; an address
    belongs to its first level, its parent is the smallest of the pages there that link to it.
    Addresses are canonical. `max_pages` bounds the addresses of a host over all levels. Only
    pages in the table are expanded; the others are what is to be fetched next (fetched = false).
    Needs a checkpoint folder: a level is written once and read by the levels after it."""
    graph = links(pages)
    if same_host:
        graph = graph.where(host(F.col("url")) == host(F.col("target")))
    graph = checkpointed(graph.where(allowed(F.col("raw"), allow, deny)).select("url", "target").where("url <> target").distinct())
    have = checkpointed(pages.where("url is not null").select(ids.canonical_uri(F.col("url")).alias("url")).distinct())
    permitted = (lambda df: robots_allow(df, robots)) if robots is not None else (lambda df: df)
    start = seeds.where("url is not null").where(allowed(F.col("url"), allow, deny)).select(ids.canonical_uri(F.col("url")).alias("url")).distinct()
    level = checkpointed(_first_of_hosts(permitted(start), None, max_pages).select("url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")))
    visited = level
    for depth in range(1, max_depth + 1):
        found = graph.join(level.select("url"), "url").groupBy(F.col("target").alias("url")).agg(F.min("url").alias("parent"))
        fresh = found.join(visited.select("url"), "url", "left_anti")
        used = visited.groupBy(host(F.col("url")).alias("_host")).agg(F.count("*").alias("_used"))
        level = checkpointed(_first_of_hosts(permitted(fresh), used, max_pages).select("url", F.lit(depth).alias("depth"), "parent"))
        if level.isEmpty():
            break
        visited = visited.union(level)
    return visited.join(have.withColumn("fetched", F.lit(True)), "url", "left").withColumn("fetched", F.coalesce("fetched", F.lit(False)))


def sitemap_urls(sitemaps: DataFrame, roots: DataFrame, max_depth: int = 2) -> DataFrame:
    """(url, depth) of the pages that sitemaps(url, xml) name from `roots`(url) on: index files
    lead to further ones, up to `max_depth` below a root. An address comes with its least depth."""
    loc = lambda tag: F.transform(F.regexp_extract_all("xml", F.lit(rf"(?is)<(?:\w+:)?{tag}\b[^>]*>.*?<(?:\w+:)?loc\b[^>]*>\s*(.*?)\s*</(?:\w+:)?loc>"), F.lit(1)), decode)
    maps = checkpointed(sitemaps.where("url is not null and xml is not null").select("url", loc("sitemap").alias("maps"), loc("url").alias("pages")))
    level = roots.select("url").distinct()
    out = None
    for depth in range(max_depth + 1):
        here = checkpointed(maps.join(level, "url"))
        pages_ = here.select(F.explode("pages").alias("url"), F.lit(depth).alias("depth"))
        out = pages_ if out is None else out.union(pages_)
        level = here.select(F.explode("maps").alias("url")).distinct()
    return out.where("url <> ''").groupBy("url").agg(F.min("depth").alias("depth"))


def conditional_actions(known: DataFrame, responses: DataFrame) -> DataFrame:
    """(url, action, reason, etag, last_modified) of a listing by known(url, etag, last_modified)
    and responses(url, status, etag, last_modified).

    fetch: status 200, new or with other marks. keep: 304, the same marks, or any other status
    of a known page (an error is no deletion). delete: 404 or 410 of a known page, or a known
    page that the listing lacks. What is not known and didn't answer 200 has no row."""
    k = known.select("url", F.struct("etag", "last_modified").alias("k"))
    r = responses.select("url", "status", F.struct("etag", "last_modified").alias("r"))
    same = (F.col("k.etag") == F.col("r.etag")) | ((F.col("k.etag").isNull() | F.col("r.etag").isNull()) & (F.col("k.last_modified") == F.col("r.last_modified")))
    gone = F.col("k").isNotNull() & F.col("status").isin(404, 410)
    ok = F.col("status") == 200
    missing = F.col("k").isNotNull() & F.col("status").isNull() & F.col("r").isNull()
    action = F.when(missing | gone, "delete").when(ok & F.col("k").isNull(), "fetch").when(ok & ~F.coalesce(same, F.lit(False)), "fetch").when(F.col("k").isNotNull(), "keep")
    reason = F.when(missing, "not_in_source_listing").when(gone, F.concat(F.lit("http_"), "status")).when(ok & F.col("k").isNull(), "new").when(ok & (action == "fetch"), "changed").when(F.col("status").isin(200, 304), "unchanged").otherwise(F.concat(F.lit("http_"), F.coalesce(F.col("status").cast("string"), F.lit("none"))))
    marks = F.when(ok & (action == "fetch"), F.col("r")).otherwise(F.col("k"))
    out = k.join(r, "url", "full").withColumn("action", action).withColumn("reason", reason).withColumn("marks", marks)
    return out.where("action is not null").select("url", "action", "reason", "marks.etag", "marks.last_modified")
