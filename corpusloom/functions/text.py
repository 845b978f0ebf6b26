"""Text scalars as Column expressions: they stay in whole-stage code generation."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode word; Java's \w is ASCII only.
WORD = r"[\p{L}\p{N}_]+"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: inside lambdas an expression is otherwise
    evaluated again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Lower-cased words in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def word_count(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))


def text_density(text: Column) -> Column:
    """Share of letters, digits and white space; 0 for an empty text."""
    kept = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}\s]", ""))
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(kept / F.length(text))


def normalise_text(text: Column) -> Column:
    """Line ends to \\n, no trailing blanks, at most one empty line in a row."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[ \t]+(?=\n|$)", "")
    return F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def normalise_query(text: Column, limit: int = 2000) -> Column:
    """Control characters and runs of white space to one space, trimmed, cut to `limit`."""
    t = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")
    return F.trim(F.substring(F.trim(F.regexp_replace(t, r"\s+", " ")), 1, limit))


def ngrams(items: Column, n: int) -> Column:
    """Runs of n items joined by spaces; one run of all items if there are fewer."""


    def runs(a: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(a) - (n - 1)), lambda i: F.array_join(F.slice(a, i, n), " "))
        return F.when(F.size(a) >= n, many).otherwise(F.array(F.array_join(a, " ")))

    return let(items, runs)


def shingles(text: Column, n: int = 4) -> Column:
    return ngrams(words(text), n)


def trigram_set(text: Column) -> Column:
    """Distinct word trigrams; the distinct words of a text of fewer than three."""
    return F.array_distinct(let(words(text), lambda w: F.when(F.size(w) >= 3, ngrams(w, 3)).otherwise(w)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def token_estimate(text: Column) -> Column:
    """Sub-word count by rule: a word of letters is 1 up to six, else 1 + (n - 1) div 5; of
    digits 1 + (n - 1) div 3; mixed words and every other character 1."""

    def cost(tok: Column) -> Column:
        n = F.length(tok)
        letters = F.when(n <= 6, 1).otherwise((1 + F.floor((n - 1) / 5)).cast("int"))
        digits = (1 + F.floor((n - 1) / 3)).cast("int")
        return F.when(tok.rlike(r"^\p{L}+$"), letters).when(tok.rlike(r"^\p{Nd}+$"), digits).otherwise(1)

    toks = F.regexp_extract_all(text, F.lit(rf"({WORD}|[^\p{{L}}\p{{N}}_\s])"), F.lit(1))
    return F.aggregate(toks, F.lit(0), lambda acc, t: acc + cost(t))


def repetition_ratio(text: Column) -> Column:
    """Repeated word trigrams among all; 0 for fewer than six words."""

    def share(w: Column) -> Column:
        repeated = let(ngrams(w, 3), lambda g: (F.size(g) - F.size(F.array_distinct(g))) / F.size(g))
        return F.when(F.size(w) < 6, F.lit(0.0)).otherwise(repeated)

    return let(words(text), share)


def breadcrumb(parts: Column) -> Column:
    return F.array_join(parts, " › ")


def context_prefix(title: Column, path: Column, limit: int = 40, levels: int = 4) -> Column:
    """Title and the last headings, cut from the left until `limit` tokens remain."""
    tail = F.slice(path, F.greatest(F.size(path) - (levels - 1), F.lit(1)), levels)
    parts = F.filter(F.concat(F.array(title), tail), lambda p: p.isNotNull() & (p != ""))
    same = (F.size(parts) >= 2) & (F.lower(F.trim(F.get(parts, F.lit(0)))) == F.lower(F.trim(F.get(parts, F.lit(1)))))
    parts = F.when(same, F.slice(parts, 2, levels + 1)).otherwise(parts)
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: breadcrumb(F.slice(parts, i, levels + 1)))
    return F.coalesce(F.get(F.filter(suffixes, lambda s: token_estimate(s) <= limit), F.lit(0)), F.lit(""))


# Words that carry no search meaning.
STOPWORDS = (
    "a an the and or but if then else of to in on at by for with from as is are was were be been being it its this that these those there here "
    "do does did doing have has had having i you he she we they me him her us them my your our their what which who whom how when where why "
    "not no yes can could should would will shall may might must about into over under again further once all any both each few more most "
    "other some such than too very s t just also"
).split()

# What a search token is, and where identifiers come apart.
SEARCH_WORD = r"[A-Za-z0-9_][A-Za-z0-9_.\-/]*[A-Za-z0-9]|[A-Za-z0-9]"
_JOINT = r"[_./\-]+"
_HUMP = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"


def search_tokens(text: Column, keep_stopwords: bool | None = None) -> Column:
    """Tokens for sparse retrieval: identifiers whole and in parts of two characters or
    more, stop words only in texts of up to three tokens (or as told). Nothing is stemmed."""
    raw = F.regexp_extract_all(text, F.lit(f"({SEARCH_WORD})"), F.lit(1))
    stop = F.array(*map(F.lit, STOPWORDS))

    def all_of(toks: Column) -> Column:
        keep = F.lit(keep_stopwords) if keep_stopwords is not None else F.size(toks) <= 3

        def one(tok: Column) -> Column:
            low = F.lower(tok)
            parts = F.filter(F.split(tok, f"{_JOINT}|{_HUMP}"), lambda p: F.length(p) > 1)
            whole = F.concat(F.array(low), F.transform(parts, F.lower))
            plain = F.when(~keep & F.array_contains(stop, low), F.array().cast("array<string>")).otherwise(F.array(low))
            return F.when(tok.rlike(f"{_JOINT}|{_HUMP}"), whole).otherwise(plain)

        return F.flatten(F.transform(toks, one))

    return let(raw, all_of)


def content_terms(text: Column) -> Column:
    """Search tokens without stop words, those that are parts of identifiers too."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(search_tokens(text, False), lambda t: ~F.array_contains(stop, t))


_SEARCH_WORD, _APART, _STOP = re.compile(SEARCH_WORD), re.compile(f"{_JOINT}|{_HUMP}"), frozenset(STOPWORDS)


@lru_cache(maxsize=200_000)
def _token_terms(tok: str) -> tuple[str, ...]:
    low = tok.lower()
    if _APART.search(tok):
        return (low, *(p.lower() for p in _APART.split(tok) if len(p) > 1))
    return (low,)


def search_terms(text: str | None, keep_stopwords: bool | None = None) -> list[str]:
    """search_tokens of one text, for code that holds whole Arrow batches: tokens are taken
    apart once, not at each of their places."""
    raw = _SEARCH_WORD.findall(text or "")
    keep = keep_stopwords if keep_stopwords is not None else len(raw) <= 3
    out: list[str] = []
    for terms in map(_token_terms, raw):
        if keep or len(terms) > 1 or terms[0] not in _STOP:
            out += terms
    return out


# Frequent words by which languages are told apart.
PROFILES = {
    "de": "der die das und ist nicht ein eine den dem von mit zu auf für im des sich als auch",
    "en": "the of and to in is that it for was on are as with be by at this from or",
    "es": "el la los las de y que en un una por con para del se no es al lo como",
    "fr": "le la les des et est un une du dans pour que qui sur au pas par avec ce il",
}


def language_scores(text: Column, sample: int | None = None) -> Column:
    """(language, words of its profile) over a text, or over its first `sample` characters, best
    first; of equal counts the first name."""

    def among(profile: str):
        known = F.array(*map(F.lit, profile.split()))
        return lambda w: F.array_contains(known, w)

    def count(toks: Column) -> Column:
        return F.array_sort(F.array(*(F.struct((-F.size(F.filter(toks, among(p)))).alias("n"), F.lit(name).alias("lang")) for name, p in PROFILES.items())))

    return let(words(text if sample is None else F.substring(text, 1, sample)), count)


def language(text: Column, least: float = 0.7, shortest: int = 20) -> Column:
    """The language whose profile holds at least `least` of the hits; else, and for short
    texts, "und"."""

    def pick(scores: Column) -> Column:
        total = F.aggregate(scores, F.lit(0), lambda a, s: a - s["n"])
        best = F.get(scores, F.lit(0))
        return F.when((total > 0) & (-best["n"] >= least * total), best["lang"]).otherwise("und")

    return F.when(F.length(text) < shortest, "und").otherwise(let(language_scores(text), pick))
