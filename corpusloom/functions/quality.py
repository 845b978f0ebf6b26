"""Quality scores and validation rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import patterns, text


def _unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def length_fit(tokens: Column, target: int = 320, minimum: int = 64, maximum: int = 448) -> Column:
    """0 at none, rising to 1 at the minimum's ramp, 1 up to the target, down to 0 at 1.5 maximum."""
    upper = 1.5 * maximum
    ramp = _unit((tokens - minimum) / float(max(1, target - minimum)))
    return (
        F.when(tokens <= 0, F.lit(0.0))
        .when(tokens < minimum, ramp)
        .when(tokens <= target, F.lit(1.0))
        .when(tokens >= upper, F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), 1.0 - (tokens - target) / (upper - target)))
    )


def sentence_completeness(c: Column, kind: Column) -> Column:
    """Half for a proper start, half for a proper end; code and tables are complete."""
    t = F.trim(c)
    start = F.when(t.rlike(r"^[\p{Lu}\p{N}\-*`\[#]"), 0.5).otherwise(0.0)
    end = F.when(t.rlike(r"""[.!?:`)"']$"""), 0.5).otherwise(0.0)
    return F.when(kind.isin("code", "table"), F.lit(1.0)).when(F.length(t) == 0, F.lit(0.0)).otherwise(start + end)


def chunk_quality(c: Column, kind: Column, tokens: Column, has_heading: Column, boilerplate: Column | None = None, target: int = 320, minimum: int = 64, maximum: int = 448) -> Column:
    boiler = F.lit(0.0) if boilerplate is None else _unit(boilerplate)
    score = (
        0.30 * length_fit(tokens, target, minimum, maximum)
        + 0.20 * text.text_density(c)
        + 0.15 * sentence_completeness(c, kind)
        + 0.15 * (1.0 - boiler)
        + 0.10 * has_heading.cast("double")
        + 0.10 * (1.0 - text.repetition_ratio(c))
    )
    return F.round(_unit(score), 4)


def chunk_flags(c: Column, tokens: Column, score: Column, minimum: int = 64, low: float = 0.30) -> Column:
    """short, repetitive, then low_quality or marginal."""
    level = F.when(score < low, "low_quality").when(score < 0.5, "marginal")
    return F.array_compact(F.array(F.when(tokens < minimum, "short"), F.when(text.repetition_ratio(c) > 0.3, "repetitive"), level))


def document_quality(c: Column, headings: Column, language_confidence: Column, boilerplate: Column | None = None) -> Column:
    n = text.word_count(c)
    boiler = F.lit(0.0) if boilerplate is None else _unit(boilerplate)
    score = (
        0.35 * text.text_density(c)
        + 0.20 * F.least(F.lit(1.0), headings / F.greatest(F.lit(1.0), n / 400))
        + 0.15 * _unit(language_confidence)
        + 0.15 * (1.0 - boiler)
        + 0.15 * F.least(F.lit(1.0), n / 300)
    )
    return F.round(_unit(score), 4)


# Codes of the validation rules.
BAD_ENCODING, TOO_SHORT, LOW_DENSITY, SECRET, SECRET_WARNING, SIZE, TOO_DEEP = "E3004", "E3005", "W3006", "E3008", "W3008", "E3001", "W3014"


def violations(c: Column, size: Column | None = None, depth: Column | None = None, allow_secrets: bool = False, min_chars: int = 100, min_density: float = 0.4, min_bytes: int = 64) -> Column:
    """Codes of the broken rules in order of precedence; those that begin with E reject."""
    bad = F.instr(c, "\x00") > 0
    bad = bad | (F.length(F.regexp_replace(c, "[^�]", "")) > 0.01 * F.greatest(F.lit(1), F.length(c)))
    secret = F.size(patterns.secrets(c)) > 0
    rules = [
        F.when(bad, BAD_ENCODING),
        F.when(F.length(F.trim(c)) < min_chars, TOO_SHORT),
        F.when(text.text_density(c) < min_density, LOW_DENSITY),
        F.when(secret, SECRET_WARNING if allow_secrets else SECRET),
    ]
    if depth is not None:
        rules.append(F.when(depth > 8, TOO_DEEP))
    if size is not None:
        rules.append(F.when(size < min_bytes, SIZE))
    return F.array_compact(F.array(*rules))


def reject_code(codes: Column) -> Column:
    return F.get(F.filter(codes, lambda x: x.startswith("E")), F.lit(0))


def warning_flags(codes: Column) -> Column:
    return F.transform(F.filter(codes, lambda x: x.startswith("W")), F.lower)
