"""Normalisers of the inventory, the matcher and the repeat study (each differs from the others on purpose)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without content, terms whose slash or "and" is no hedge, classes with a synonym.
MATCHER_STOPWORDS = [
    "of", "the", "in", "a", "an", "and", "or", "to", "for", "without", "used", "improper",
    "by", "with", "into", "on", "elements", "special", "function", "critical",
]
COMPOUND_TERMS = ["csv/formula injection", "read/write", "request/response", "concurrency/locking defect", "input/output"]
VECTOR_SYNONYMS = {
    "network": "NETWORK", "adjacent network": "ADJACENT_NETWORK", "adjacent": "ADJACENT_NETWORK",
    "local": "LOCAL", "physical": "PHYSICAL",
}
IMPACT_WORDS = {"none": "NONE", "low": "LOW", "high": "HIGH"}


def stripped(x: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def _single_spaced(x: Column) -> Column:
    return stripped(F.regexp_replace(x, r"(?U)\s+", " "))


def inventory_label(x: Column) -> Column:
    """Lower, & to and, dashes, slashes and most punctuation to spaces, other signs kept; null is empty."""
    own = F.lower(stripped(F.coalesce(x, F.lit(""))))
    own = F.regexp_replace(F.regexp_replace(F.regexp_replace(own, "’", "'"), "[–—]", "-"), "&", " and ")
    return _single_spaced(F.regexp_replace(own, r"[-_/\"'`(),.:;{}\[\]]", " "))


def matcher_text(x: Column) -> Column:
    """Lower, hyphens and ()'",;: to spaces, single spaces; null is empty."""
    return _single_spaced(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[-()'\",;:]", " "))


def content_tokens(x: Column, stopwords: list[str] | None = None) -> Column:
    """Distinct words of matcher_text without the stop list."""
    stop = F.array(*map(F.lit, [*(stopwords or MATCHER_STOPWORDS), ""]))
    return F.array_distinct(F.array_except(F.split(matcher_text(x), " "), stop))


def hedge_fragments(x: Column, compounds: list[str] | None = None) -> Column:
    """Parts of an answer between / ; and "and"; a compound term is one part; null has none."""
    known = compounds or COMPOUND_TERMS
    squeezed = [c.replace(" ", "").replace("/", "") for c in known]
    whole = F.lower(stripped(x)).isin(known) | F.replace(matcher_text(x), F.lit(" "), F.lit("")).isin(squeezed)
    parts = F.filter(F.transform(F.split(x, r"(?Ui)\s*/\s*|\s*;\s*|\s+and\s+"), stripped), lambda p: p != "")
    return F.when(x.isNull(), F.array().cast("array<string>")).when(whole, F.array(stripped(x))).otherwise(parts)


def by_synonym(x: Column, synonyms: dict[str, str]) -> Column:
    """The class whose word or synonym the text is, else null."""
    own = F.lower(stripped(x))
    out = F.lit(None).cast("string")
    for word, name in synonyms.items():
        out = F.when(own == word, name).otherwise(out)
    return out


def repeat_label(x: Column) -> Column:
    """Lower; signs but _ / - to spaces; single spaces; empty is null."""
    own = _single_spaced(F.regexp_replace(F.lower(stripped(x)), r"[^a-z0-9 _/-]", " "))
    return F.when(own != "", own)
