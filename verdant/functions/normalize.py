"""Scalar normalisers as column expressions; the one helper in Python is Unicode folding of labels."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdant.functions.matching import inventory_label, stripped

# Words that say nothing about which component is meant.
COMPONENT_STOPWORDS = [
    "firmware", "software", "the", "a", "an", "for", "and", "of",
    "in", "on", "with", "plugin", "extension", "library", "package",
    "application", "app", "tool", "service", "system", "platform",
    "module", "component", "api",
]


@F.pandas_udf(T.StringType())
def nfkc(x: pd.Series) -> pd.Series:
    """Compatibility composition; call it on distinct values."""
    return x.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def class_label(x: Column, classes: list[str]) -> Column:
    """Trim, drop .,;: at the ends, lower, white space and - to _, then an exact class or null."""
    own = F.regexp_replace(stripped(F.btrim(stripped(x), F.lit(".,;:"))), r"(?U)\s+", "_")
    own = F.upper(F.replace(own, F.lit("-"), F.lit("_")))
    return F.when(own.isin(classes), own)


def impact_label(x: Column, classes: list[str]) -> Column:
    """Trim and upper; an exact class, else a class's single first letter, else null."""
    own = F.upper(stripped(x))
    out = F.when(own.isin(classes), own)
    for c in classes:
        out = out.when(own == c[0], F.lit(c))
    return out


def weakness_label(x: Column, fold: bool = True) -> Column:
    """NFKC, lower, & to and, hyphens to spaces, quotes dropped, other signs to spaces; empty is null.

    fold: by a helper in Python; without it, for labels known to be ASCII, the same in generated code only.
    """
    own = F.lower(nfkc(x) if fold else x)
    own = F.regexp_replace(F.regexp_replace(F.regexp_replace(own, "&", " and "), "[-–—]", " "), "[“”‘’'\"`]", "")
    own = F.trim(F.regexp_replace(own, "[^a-z0-9]+", " "))
    return F.when(own != "", own)


def component_tokens(x: Column, stopwords: list[str] | None = None) -> Column:
    """Distinct tokens without stopwords and single characters, in order."""
    stop = F.array(*map(F.lit, stopwords or COMPONENT_STOPWORDS))
    parts = F.split(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", " "), " ")
    return F.array_distinct(F.filter(parts, lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t)))


def vendor_token(x: Column, stopwords: list[str] | None = None) -> Column:
    """First token that survives."""
    return F.try_element_at(component_tokens(x, stopwords), F.lit(1))


def parenthetical_aliases(x: Column) -> Column:
    """Short names in parentheses."""
    return F.filter(F.transform(F.regexp_extract_all(x, F.lit(r"\(([^()]*)\)"), F.lit(1)), inventory_label), lambda t: t != "")


def direct_id(label: Column) -> Column:
    """CWE-n where a whole weakness label is an id."""
    digits = F.regexp_extract(label, r"^(?:cwe\s*)?(\d{1,4})$", 1)
    return F.when(digits != "", F.concat(F.lit("CWE-"), digits.cast("int").cast("string")))


def without_fences(x: Column) -> Column:
    """The text inside a code fence without a tag or with the tag json, if it is in one."""
    return stripped(F.regexp_replace(F.regexp_replace(stripped(x), r"(?U)^```(?:json)?\s*", ""), r"(?U)\s*```$", ""))


def natural_key(x: Column) -> Column:
    """Sorts ids by their first number, then as text; ids without a number last."""
    return F.struct(F.coalesce(F.regexp_extract(x, r"(\d+)", 1).try_cast("long"), F.lit(1_000_000_000)), x)
