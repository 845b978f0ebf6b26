"""Line dedup by site-relative frequency, in DataFrame functions only.

The pages of a host that contain a line, divided by the pages of the host, give
the line's ratio; lines above the ratio are boilerplate of that host and go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize

#: A line goes if more than RATIO of its host's pages have it, and at least PAGES pages do.
RATIO, PAGES = 0.1, 5
#: Boilerplate hashes up to which the list for each host is broadcast (8 bytes each).
BROADCAST_LINES = 200_000
#: Tasks that the pages of a host are dealt over when the lists are no broadcast.
SALTS = 64


def line_dedup(docs: DataFrame, ratio: float = RATIO, pages: int = PAGES, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """`docs` without the boilerplate lines of each host.

    Adds n_lines and n_dropped (longs), in place of columns of these names; every other
    column, whatever its name, stays as it is. Lines of any length are
    split at \\n and compared whole. Blank lines are never counted or dropped. A page
    has a line once however often it repeats; all its occurrences go. Null hosts are
    one host. A null text stays null, an empty text has no lines; a text that loses
    all its lines becomes empty. Repeated and null ids count as pages of their own; a share
    equal to the ratio stays. Lines are counted by a 64-bit hash within their host. An
    empty table gives no rows.
    """
    host, text = F.col(host_col), F.col(text_col)
    lines = F.filter(F.split(text, "\n"), lambda s: F.trim(s) != "")
    hashes = F.array_distinct(F.transform(lines, lambda s: F.xxhash64(s)))
    keyed = docs.select(host.alias("h"), hashes.alias("ls"))
    totals = keyed.groupBy("h").agg(F.count("*").alias("pages"))
    counts = keyed.select("h", F.explode("ls").alias("l")).groupBy("h", "l").agg(F.count("*").alias("n")).where(F.col("n") >= pages)
    # A host's share of its pages is at most 1, so it has at most (lines per page) / ratio such lines.
    bad = counts.alias("c").join(totals.alias("t"), F.expr("c.h <=> t.h")).where(F.col("n") > ratio * F.col("pages")).select(F.col("c.h").alias("h"), "l")
    bad = materialize(bad.groupBy("h").agg(F.collect_list("l").alias("bad")), "boilerplate")
    rows = bad.agg(F.sum(F.size("bad"))).first()[0] or 0
    taken = {c.lower() for c in docs.columns} | {"n_lines", "n_dropped"}
    h, salt, own, stay = (next(n for i in range(len(taken) + 1) if (n := f"{name}_{i}") not in taken) for name in ("host", "salt", "lines", "stay"))
    if rows <= BROADCAST_LINES:
        near = F.broadcast(bad.select(F.col("h").alias(h), F.col("bad").alias(own)))
        kept = docs.join(near, F.expr(f"`{host_col}` <=> `{h}`"), "left")
    else:  # a host's pages are dealt over SALTS tasks, its list goes to each
        near = bad.select(F.col("h").alias(h), F.col("bad").alias(own), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))
        kept = docs.join(near, F.expr(f"`{host_col}` <=> `{h}`") & (F.pmod(F.xxhash64(text), F.lit(SALTS)) == F.col(salt)), "left").drop(salt)
    split = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n"))
    listed = F.coalesce(F.col(own), F.array().cast("array<bigint>"))
    left = F.filter(split, lambda s: (F.trim(s) == "") | ~F.array_contains(listed, F.xxhash64(s)))
    kept = kept.withColumn(stay, left)
    n = F.when(text.isNull(), 0).otherwise(F.size(split)).cast("long")
    return kept.select(
        *(F.array_join(stay, "\n").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")),
        n.alias("n_lines"),
        F.when(text.isNull(), 0).otherwise(n - F.size(stay)).cast("long").alias("n_dropped"),
    )


SQL = """
WITH d AS (SELECT doc_id, source, text, CASE WHEN text = '' THEN []::VARCHAR[] ELSE string_split(text, chr(10)) END AS lines FROM documents),
totals AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
seen AS (SELECT DISTINCT doc_id, source, l FROM (SELECT doc_id, source, unnest(lines) AS l FROM d) WHERE trim(l, ' ') <> ''),
bad AS (
  SELECT s.source, s.l FROM (SELECT source, l, count(*) AS n FROM seen GROUP BY source, l) s
  JOIN totals t ON s.source IS NOT DISTINCT FROM t.source WHERE s.n >= {pages} AND s.n > {ratio} * t.pages),
lists AS (SELECT source, list(l) AS bad FROM bad GROUP BY source),
kept AS (
  SELECT d.doc_id, d.text, d.lines, list_filter(d.lines, lambda l: trim(l, ' ') = '' OR b.bad IS NULL OR NOT list_contains(b.bad, l)) AS stay
  FROM d LEFT JOIN lists b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(stay, chr(10)), '') END AS text,
  coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(lines) - len(stay), 0)::BIGINT AS n_dropped
FROM kept
""".replace("{pages}", str(PAGES)).replace("{ratio}", f"{RATIO}::DOUBLE")
