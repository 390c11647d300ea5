"""Text expressions: normal forms, fingerprints, factual tokens and the guard that compares them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where an ASCII word begins or ends, whatever letters stand beside it.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: Patterns of numerals, acronyms, quoted spans, proper nouns and words that give a direction.
NUMERAL = r"(?i)\$?\d[\d,]*(?:\.\d+)?(?:%|[kmbt](?![a-z]))?"
ACRONYM = rf"{EDGE}[A-Z][A-Z0-9]+{EDGE}"
QUOTED = r'"([^"]{1,120})"|“([^”]{1,120})”'
PROPER = rf"{EDGE}[A-Z][a-z]{{2,}}(?:['’]s)?{EDGE}"
DIRECTION = rf"(?i){EDGE}(compared to|compared with|versus|vs\.?|than|relative to|per|out of|by){EDGE}"
#: Capitalised words that name nothing.
NOT_AN_ENTITY = (
    "what which when where who whom whose why how the this that these those there their they does did was were are can "
    "could should would for and but not with from into about after before during please tell give list name explain "
    "january february march april may june july august september october november december "
    "monday tuesday wednesday thursday friday saturday sunday"
).split()
#: Phrases of an answer that declines.
REFUSALS = (
    "i don't know based on the provided documents",
    "i don't know based on the provided context",
    "the context does not contain",
    "not contain enough information",
    "no relevant information",
)


def normal_question(text: Column) -> Column:
    """Trimmed, lower-cased, with single spaces."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+", " "))


def preview(text: Column, n: int = 160) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^ | $", ""), 1, n)


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / F.lit(4.0)).cast("long")


def fingerprint(*parts: Column) -> Column:
    """sha-256 of parts that tells null from any text."""
    marked = [F.coalesce(F.concat(F.lit("v:"), p.cast("string")), F.lit("n")) for p in parts]
    return F.sha2(F.concat_ws("\u001f", *marked), 256)


def set_key(ids: Column) -> Column:
    """Twelve hexadecimal digits that name a set of ids in any order."""
    return F.substring(F.sha2(F.array_join(F.array_sort(ids), "\n"), 256), 1, 12)


def factual_tokens(text: Column) -> Column:
    """Distinct numerals (n:), quoted spans (q:) and, where the text has lower case, acronyms (a:), sorted."""
    numerals = F.transform(
        F.regexp_extract_all(text, F.lit(NUMERAL), F.lit(0)), lambda x: F.concat(F.lit("n:"), F.lower(F.regexp_replace(x, "[$,]", "")))
    )
    spans = F.transform(F.regexp_extract_all(text, F.lit(QUOTED), F.lit(0)), lambda x: normal_question(F.regexp_replace(x, '^["“]|["”]$', "")))
    quoted = F.transform(F.filter(spans, lambda x: x != ""), lambda x: F.concat(F.lit("q:"), x))
    acronyms = F.transform(F.regexp_extract_all(text, F.lit(ACRONYM), F.lit(0)), lambda x: F.concat(F.lit("a:"), F.lower(x)))
    acronyms = F.when(F.rlike(text, F.lit("[a-z]")), acronyms).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(numerals, quoted, acronyms)))


def _missing(of: Column, other: Column, text: Column) -> Column:
    """Whether a token of one text is not in the other; an acronym may appear there in any case."""
    spoken = F.split(F.lower(F.regexp_replace(text, r"[^A-Za-z0-9_]+", " ")), " ")
    return F.exists(
        F.array_except(of, other),
        lambda t: ~(F.startswith(t, F.lit("a:")) & F.array_contains(spoken, F.substring(t, 3, 1000))),
    )


def same_facts(a: Column, b: Column) -> Column:
    ta, tb = factual_tokens(a), factual_tokens(b)
    return ~_missing(ta, tb, b) & ~_missing(tb, ta, a)


def entity_sequence(text: Column) -> Column:
    """Proper nouns, then acronyms, in order of first mention, in lower case and without possessives."""
    names = F.regexp_extract_all(text, F.lit(PROPER), F.lit(0))
    acronyms = F.when(F.rlike(text, F.lit("[a-z]")), F.regexp_extract_all(text, F.lit(ACRONYM), F.lit(0))).otherwise(F.array().cast("array<string>"))
    low = F.transform(F.concat(names, acronyms), lambda x: F.regexp_replace(F.lower(x), "['’]s$", ""))
    return F.array_distinct(F.array_except(low, F.array(*map(F.lit, NOT_AN_ENTITY))))


def same_order(a: Column, b: Column) -> Column:
    """False where both texts give a direction and put the entities they share (two or more) in different orders."""
    sa, sb = entity_sequence(a), entity_sequence(b)
    shared_a = F.filter(sa, lambda t: F.array_contains(sb, t))
    shared_b = F.filter(sb, lambda t: F.array_contains(sa, t))
    directed = F.rlike(a, F.lit(DIRECTION)) & F.rlike(b, F.lit(DIRECTION))
    return ~directed | (F.size(shared_a) < 2) | (shared_a == shared_b)


def guard(a: Column, b: Column) -> Column:
    """Whether nothing lexical says that two questions are about different facts."""
    return same_facts(a, b) & same_order(a, b)


def is_refusal(answer: Column) -> Column:
    return F.exists(F.array(*map(F.lit, REFUSALS)), lambda m: F.contains(F.lower(answer), m))


def efficacy(groundedness: Column, answer: Column) -> Column:
    """0 for refusals, else groundedness / 0.75 within 0 and 1, times 0.6 for answers below 40 characters."""
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), groundedness / 0.75))
    short = F.when(F.length(answer) < 40, 0.6).otherwise(1.0)
    return F.when(is_refusal(answer), 0.0).otherwise(score * short)
