"""Patterns over texts and queries: secrets, personal data, intents, entities, filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Secret-like content.
SECRETS = {
    "aws_access_key": r"\b(AKIA|ASIA)[0-9A-Z]{16}\b",
    "private_key": r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9]{36,}\b",
    "slack_token": r"\bxox[abprs]-[A-Za-z0-9-]{10,}\b",
    "jwt": r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b",
    "generic_api_key": r"""(?i)\b(?:api[_-]?key|secret[_-]?key|access[_-]?token)\b\s*[:=]\s*['"]?[A-Za-z0-9_\-]{20,}""",
}

# Personal data. The lookarounds keep longer digit runs out.
PII = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "phone": r"(?<!\d)(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}(?!\d)",
    "ssn": r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)",
    "credit_card": r"(?<!\d)(?:\d[ -]?){13,16}(?!\d)",
    "ip_address": r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b",
}

# Intents, the first that matches wins.
INTENTS = {
    "chitchat": r"(?i)^(hi|hello|hey|thanks|thank you|ok|okay|bye|good (morning|evening))[.!]*$",
    "troubleshooting": r"(?i)\b(error|fails?|failing|failed|exception|traceback|crash|broken|not working|timeout|[A-Z]{3}-E\d{4})\b",
    "comparison": r"(?i)\b(difference between|differences between|vs\.?|versus|compare|compared to|better than)\b",
    "summarization": r"(?i)\b(summari[sz]e|summary of|overview of|tl;?dr|explain (the )?(chapter|section|document))\b",
    "code_search": r"(?i)\b(function|class|method|module|snippet|implementation|code|script|def |regex)\b|`[^`]+`",
    "how_to": r"(?i)^(how (do|can|should|to)|steps? to|configure|set ?up|install|enable|disable)\b|\bhow to\b",
}

# Retrieval settings of each intent (top k, weight of the sparse leg, favoured kinds).
PROFILES = {
    "factual_lookup": (8, 1.0, ()),
    "how_to": (10, 1.0, ("prose", "code", "list")),
    "code_search": (8, 1.3, ("code",)),
    "troubleshooting": (8, 1.3, ("prose", "list")),
    "comparison": (10, 1.0, ()),
    "summarization": (12, 0.8, ()),
    "chitchat": (0, 0.0, ()),
}

# Entities in queries.
ENTITIES = {
    "error_codes": r"\b[A-Z]{3}-[EW]\d{4}\b",
    "env_vars": r"\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b",
    "urls": r"https?://\S+",
    "paths": r"\b[\w.-]+(?:/[\w.-]+)+\.[a-z0-9]{1,6}\b",
    "versions": r"\bv?\d+\.\d+(?:\.\d+)?\b",
    "identifiers": r"\b[a-z]+(?:_[a-z0-9]+)+\b|\b[a-z]+(?:[A-Z][a-z0-9]+)+\b",
    "quoted": r"""(?<=")[^"]{3,80}(?=")|(?<=')[^']{3,80}(?=')|(?<=`)[^`]+(?=`)""",
}

# Words that refer back, and hints at time, language, source and repository.
ANAPHORA = r"(?i)\b(it|its|that|this|those|these|the (?:second|first|third|last|other) (?:one|option)|them|he|she|they)\b"
TEMPORAL = r"(?i)\b(latest|recent(ly)?|newest|current|as of|this (month|quarter|year))\b"
LANGUAGE_HINT = r"(?i)\bin (python|typescript|javascript|go|java|rust|sql|yaml|bash|shell)\b"
SOURCE_HINT = r"(?i)\b(pdf|whitepaper|handbook|spec(ification)?)\b"
REPO_HINT = r"(?i)\b(?:in|from|inside) (?:repo|repository) ([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)"
#: Security levels from open to closed.
LEVELS = ("public", "internal", "restricted")


def secrets(text: Column) -> Column:
    """Names of the secret patterns found."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), name) for name, p in SECRETS.items())))


def find_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def pii_values(text: Column, kind: str) -> Column:
    """Distinct values of a kind; cards as digits, by length and checksum."""
    found = find_all(text, PII[kind])
    if kind == "credit_card":
        digits = F.transform(found, lambda v: F.regexp_replace(v, "[ -]", ""))
        found = F.filter(digits, lambda v: F.length(v).between(13, 19) & F.call_function("luhn_check", v))
    return F.array_distinct(found)


def pii_mentions(text: Column) -> Column:
    """(kind, SHA-256 of the value) of each distinct mention; raw values never leave."""

    def hashed(kind: str):
        return lambda v: F.struct(F.lit(kind).alias("kind"), F.sha2(v, 256).alias("value_sha256"))

    return F.flatten(F.array(*(F.transform(pii_values(text, k), hashed(k)) for k in PII)))


def intent(text: Column) -> Column:
    out = F
    for name, p in INTENTS.items():
        out = out.when(text.rlike(p), name)
    return out.otherwise("factual_lookup")


def profile(name: Column, field: int) -> Column:
    """A setting of the intent's profile: 0 top k, 1 sparse weight, 2 favoured kinds."""
    out = F
    for key, values in PROFILES.items():
        value = F.lit(values[field]) if field < 2 else F.array(*map(F.lit, values[2])).cast("array<string>")
        out = out.when(name == key, value)
    return out


def entities(text: Column, kind: str) -> Column:
    found = F.array_distinct(find_all(text, ENTITIES[kind]))
    if kind == "paths":
        found = F.filter(found, lambda p: ~p.rlike("^https?:"))
    return found


def exact_terms(text: Column) -> Column:
    """Terms that must match as they stand."""
    return F.array_distinct(F.flatten(F.array(*(entities(text, k) for k in ("error_codes", "env_vars", "identifiers", "paths", "quoted")))))


def soft_filters(text: Column, now: Column) -> Column:
    """Hints that are tried first and then relaxed."""
    language = F.lower(F.regexp_extract(text, LANGUAGE_HINT, 1))
    language = F.when(language == "shell", "bash").when(language != "", language)
    repo = F.regexp_extract(text, REPO_HINT, 1)
    return F.struct(
        F.when(repo != "", repo).alias("repo"),
        F.when(text.rlike(SOURCE_HINT), "pdf").alias("source_type"),
        language.alias("code_language"),
        F.when(text.rlike(TEMPORAL), now - F.expr("INTERVAL 90 DAYS")).alias("updated_after"),
    )


def may_read(level: Column, groups: Column, levels: list[str], own: list[str]) -> Column:
    """The security predicate: the level is allowed, and the groups are none or shared."""
    shared = F.arrays_overlap(groups, F.array(*map(F.lit, own))) if own else F.lit(False)
    return level.isin(*levels) & ((F.coalesce(F.size(groups), F.lit(0)) <= 0) | F.coalesce(shared, F.lit(False)))


def raise_level(path: Column, level: Column, rules: list[tuple[str, str]]) -> Column:
    """The level after path rules (pattern, level): the first that matches may raise it only."""
    rank = lambda c: F.array_position(F.array(*map(F.lit, LEVELS)), c)
    chosen = F
    for pattern, to in rules:
        chosen = chosen.when(path.rlike(pattern), F.lit(to))
    chosen = chosen.otherwise(level) if rules else level
    return F.when(rank(chosen) > rank(level), chosen).otherwise(level)


def metadata_filter(*, source_types=(), repos=(), chunk_types=(), code_languages=(), document_ids=(), updated_after: Column | None = None) -> Column:
    """One conjunction for the dense and the sparse leg; what is not given is not tested."""
    out = F.lit(True)
    for name, values in (("source_type", source_types), ("repo", repos), ("chunk_type", chunk_types), ("code_language", code_languages), ("document_id", document_ids)):
        if values:
            out = out & F.coalesce(F.col(name).isin(*values), F.lit(False))
    if updated_after is not None:
        out = out & (F.coalesce(F.col("document_updated_at"), F.lit("1970-01-01").cast("timestamp")) >= updated_after)
    return out
