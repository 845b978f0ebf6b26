"""Deterministic identities as Column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

ROOT = uuid.uuid5(uuid.NAMESPACE_DNS, "corpusloom.invalid")
NS_DOCUMENT, NS_CHUNK, NS_MANIFEST, NS_QA = (uuid.uuid5(ROOT, n) for n in ("document", "chunk", "manifest", "qa"))


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """RFC 4122 version 5, equal to uuid.uuid5(namespace, name)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 19, 2), F.lit("-"), F.substring(h, 21, 12))


def canonical_uri(uri: Column) -> Column:
    """Scheme and host in lower case, no default port, query or fragment, dot segments
    resolved, no slash at the end (the root keeps its)."""
    t = F.trim(uri)
    scheme = F.lower(F.regexp_extract(t, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract(t, r"^[^:]+://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    port = F.regexp_extract(t, r"^[^:]+://[^/?#]*:(\d+)", 1)
    own = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    path = F.regexp_extract(t, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    segments = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    resolved = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s != "..", F.array_append(acc, s)).when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc),
    )
    return F.concat(scheme, F.lit("://"), host, F.when(own, "").otherwise(F.concat(F.lit(":"), port)), F.lit("/"), F.array_join(resolved, "/"))


def document_id(uri: Column) -> Column:
    return uuid5(NS_DOCUMENT, canonical_uri(uri))


def document_version_id(document: Column, sha256: Column, parser: str) -> Column:
    return uuid5(NS_DOCUMENT, F.concat_ws(":", document, sha256, F.lit(parser)))


def manifest_id(document: Column, sha256: Column, run: str) -> Column:
    return uuid5(NS_MANIFEST, F.concat_ws(":", document, sha256, F.lit(run)))


def chunk_key(document: Column, path: Column, ordinal: Column) -> Column:
    return F.sha1(F.concat_ws("\x1f", document.cast("string"), F.array_join(path, "/"), ordinal.cast("string")))


def chunk_checksum(text: Column) -> Column:
    """SHA-256 of the text with white space collapsed (texts are NFC on entry)."""
    return F.sha2(F.trim(F.regexp_replace(text, r"\s+", " ")), 256)


def chunk_id(document: Column, key: Column, checksum: Column) -> Column:
    return uuid5(NS_CHUNK, F.concat_ws(":", document.cast("string"), key, checksum))


def embedded_text_sha256(prefix: Column, text: Column) -> Column:
    return F.sha2(F.when(F.coalesce(prefix, F.lit("")) == "", text).otherwise(F.concat(prefix, F.lit("\n"), text)), 256)
