"""Parsing of raw objects with isolated failures.

Every object goes through the stages fetch, validate (its size), select_parser, parse and
validate (its text). One pass gives a row for each object, tagged with the stage and code that
rejected it; the tagged rows are written once and split, so neither the parsed nor the
rejected ones are worked out twice. An object that breaks a parser costs its own row only.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import quality
from corpusloom.functions.batches import slices
from corpusloom.functions.text import let
from corpusloom.session import checkpointed
from corpusloom.sources import dom, lakehouse, pages

# Codes of the stages before the text is judged, and the largest object.
NOT_FETCHED, TOO_LARGE, NO_PARSER, UNPARSABLE, PARSER_BUG = "E2003", "E3001", "E3002", "E3003", "E3030"
MAX_BYTES = 50 * 1024 * 1024


class ParseError(ValueError):
    """An object that can't be read as what it claims to be."""


def _html(content: bytes, uri: str) -> tuple[str | None, str]:
    d = dom.build(content.decode("utf-8", "replace"))
    if not any(d.tag):
        raise ParseError("no element")
    s = dom.sums(d)
    return dom.metadata(d, uri)[0], pages.to_markdown(dom.blocks(d, s, dom.main_node(d, s)))


def _text(content: bytes, uri: str) -> tuple[str | None, str]:
    return None, content.decode("utf-8", "replace").replace("\r\n", "\n")


#: Parsers by extension: (content, address) to (title, text).
PARSERS: dict[str, Callable[[bytes, str], tuple[str | None, str]]] = {**dict.fromkeys(("html", "htm", "xhtml"), _html), **dict.fromkeys(("md", "markdown", "txt", "rst", "text"), _text)}


def _parse(parsers):
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "content")):
            out = []
            for uri, ext, code, content in zip(*(batch.column(c).to_pylist() for c in ("uri", "extension", "code", "content")), strict=True):
                row = (None, None, None, None)
                if code is None:
                    try:
                        row = (*parsers[ext](content, uri), None, None)
                    except ParseError as e:
                        row = (None, None, UNPARSABLE, str(e))
                    except Exception as e:  # a parser's bug must not end the run: it is this object's code
                        row = (None, None, PARSER_BUG, f"{type(e).__name__}: {e}")
                out.append(row)
            found = [pa.array([r[i] for r in out], pa.string()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, "title", "text", "parse_code", "parse_detail"])

    return run


def _failure(stage: str, code: Column, detail: Column) -> Column:
    return F.struct(F.lit(stage).alias("stage"), code.alias("code"), detail.alias("detail"))


def parse_objects(objects: DataFrame, max_bytes: int = MAX_BYTES, validate: bool = True, parsers: dict | None = None, extension: Column | None = None) -> DataFrame:
    """objects(uri, content, any other columns) with ok, stage, code, detail, title and text.

    `content` is text or binary; its columns title, text, stage, code, detail, ok and
    extension are replaced. The text of a rejected object is null unless it was judged."""
    parsers = PARSERS if parsers is None else parsers
    ours = ("extension", "stage", "code", "detail", "title", "text", "ok")
    df = objects.drop(*ours).withColumn("content", F.col("content").cast("binary"))
    df = df.withColumn("extension", lakehouse.extension(F.col("uri")) if extension is None else F.lower(extension))
    size = F.octet_length("content")
    early = F.when(F.col("content").isNull(), _failure("fetch", F.lit(NOT_FETCHED), F.lit("no content")))
    early = early.when(size > max_bytes, _failure("validate", F.lit(TOO_LARGE), F.concat(size.cast("string"), F.lit(" bytes"))))
    early = early.when(~F.coalesce(F.col("extension").isin(*parsers), F.lit(False)), _failure("select_parser", F.lit(NO_PARSER), F.concat(F.lit("no parser for ."), F.coalesce("extension", F.lit("")))))
    df = df.withColumn("early", early).withColumn("code", F.col("early.code"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    df = df.mapInArrow(_parse(parsers), f"{schema}, title string, text string, parse_code string, parse_detail string")
    late = F.when(F.col("parse_code").isNotNull(), _failure("parse", F.col("parse_code"), F.col("parse_detail")))
    if validate:
        broken = let(quality.violations(F.col("text"), F.octet_length("content").cast("long")), lambda v: F.struct(quality.reject_code(v).alias("code"), F.array_join(v, ",").alias("detail")))
        df = df.withColumn("judged", F.when(F.col("text").isNotNull(), broken))
        late = late.when(F.col("judged.code").isNotNull(), _failure("validate", F.col("judged.code"), F.col("judged.detail")))
    df = df.withColumn("failure", F.coalesce("early", late))
    kept = [c for c in objects.columns if c not in ours]
    return df.select(*kept, F.col("failure").isNull().alias("ok"), "failure.stage", "failure.code", "failure.detail", "title", "text")


def split(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parsed, rejected) of tagged rows, which are written once into the checkpoint folder."""
    whole = checkpointed(tagged)
    return whole.where("ok").drop("ok", "stage", "code", "detail"), whole.where("not ok").drop("ok", "title", "text")


def quarantine(lake: lakehouse.Lakehouse, rejected: DataFrame, run_id: str, now: Column) -> int:
    """Append reason rows, and the rejects' content under their digest, so they can be tried again
    when the raw object has gone. Returns the version of the reasons."""
    r = rejected.withColumn("content_sha256", F.sha2(F.coalesce("content", F.lit(b"")), 256)).withColumn("document_id", F.coalesce(F.col("document_id") if "document_id" in rejected.columns else F.lit(None).cast("string"), F.sha1(F.coalesce("uri", F.lit("")))))
    reasons = lakehouse.quarantine(r.withColumn("source_uri", F.col("uri")), run_id, now)
    key = F.concat(F.lit("quarantine/objects/"), F.col("content_sha256"))
    lake.log("quarantine/objects").write(r.where("content is not null").select("content_sha256", "content").dropDuplicates(["content_sha256"]), run=lakehouse.run_token(run_id))
    return lake.write("quarantine/reasons", reasons.withColumn("raw_key", F.when(F.col("content_sha256") != F.sha2(F.lit(""), 256), key)), run_id=run_id)


def counts(tagged: DataFrame) -> DataFrame:
    """(stage, code, n): the parsed ones have neither."""
    return tagged.groupBy("stage", "code").agg(F.count("*").alias("n"))
