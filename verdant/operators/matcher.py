"""Four-way match of free-text answers against named truths, and its agreement with people.

The work is done once per distinct (answer, names, ids), all in column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdant.functions.matching import content_tokens, hedge_fragments, matcher_text

# Short names of ids, broader terms of ids, words that make a truth narrower.
CANONICAL_ALIASES = {
    "CWE-77": ["command injection"],
    "CWE-78": ["os command injection", "command injection"],
    "CWE-120": ["classic buffer overflow", "buffer overflow"],
    "CWE-918": ["server-side request forgery", "ssrf"],
    "CWE-1236": ["csv injection", "formula injection"],
    "CWE-416": ["use after free"],
}
FAMILY_TERMS = {
    "CWE-121": ["buffer overflow", "memory corruption"],
    "CWE-122": ["buffer overflow", "memory corruption"],
    "CWE-120": ["buffer overflow", "memory corruption"],
    "CWE-787": ["buffer overflow", "memory corruption"],
    "CWE-125": ["buffer overflow", "memory corruption", "out of bounds"],
    "CWE-680": ["buffer overflow", "memory corruption"],
    "CWE-119": ["buffer overflow", "memory corruption"],
    "CWE-77": ["injection"],
    "CWE-78": ["injection", "command injection"],
    "CWE-89": ["injection"],
    "CWE-79": ["injection"],
    "CWE-94": ["injection"],
    "CWE-1236": ["injection"],
    "CWE-798": ["hardcoded credentials", "hard coded credentials", "hardcoded key", "hard coded key", "hardcoded cryptographic key", "credential"],
}
SPECIFICITY_WORDS = ["stack", "heap", "classic", "integer", "unbounded"]

EXACT, FAMILY, MISS = 3, 2, 0


def _terms(table: dict[str, list[str]], id_: Column) -> Column:
    """The table's terms of an id, none for an unknown one; the table is a parameter, not data."""
    pairs = [F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))] if table else []
    none = F.array().cast("array<string>")
    return F.coalesce(F.try_element_at(pairs[0], id_), none) if pairs else none


def _rank(f: Column, t: Column, specific: list[str]) -> Column:
    """One fragment against one truth: alias, then token subsets, then broader terms."""
    own, other = f["tokens"], t["tokens"]
    lacking, more = F.array_except(other, own), F.array_except(own, other)
    narrower = F.size(F.array_intersect(lacking, F.array(*map(F.lit, specific)))) > 0
    some = (F.size(own) > 0) & (F.size(other) > 0)
    return (
        F.when(F.exists(t["aliases"], lambda a: F.contains(f["text"], a) | F.contains(a, f["text"])), EXACT)
        .when(some & (F.size(more) == 0) & (F.size(lacking) > 0), F.when(narrower, FAMILY).otherwise(EXACT))
        .when(some & (F.size(lacking) == 0), EXACT)
        .when(F.exists(t["family"], lambda x: F.contains(f["text"], x)), FAMILY).otherwise(MISS)
    )


def four_way_match(
    rows: DataFrame, answer: str, names: str, ids: str, aliases: dict[str, list[str]] | None = None,
    family: dict[str, list[str]] | None = None, specific: list[str] | None = None,
) -> DataFrame:
    """Adds match: exact, family, partial or miss (V9), and strict, lenient: exact; exact or family.

    names and ids are parallel arrays, the longer one cut. The best of all fragments and truths counts;
    an answer of several fragments against one id is at most partial. A null or empty answer, or no
    truth, is a miss.
    """
    aliases, family = CANONICAL_ALIASES if aliases is None else aliases, FAMILY_TERMS if family is None else family
    specific = SPECIFICITY_WORDS if specific is None else specific
    key = [answer, names, ids]
    own = rows.select(*key).distinct()
    pairs = F.filter(F.arrays_zip(F.col(names).alias("name"), F.col(ids).alias("id")), lambda _, i: i < F.least(F.size(names), F.size(ids)))
    truth = F.transform(pairs, lambda p: F.struct(
        content_tokens(p["name"]).alias("tokens"), F.transform(_terms(aliases, p["id"]), matcher_text).alias("aliases"), _terms(family, p["id"]).alias("family"),
    ))
    parts = F.transform(hedge_fragments(F.col(answer)), lambda f: F.struct(matcher_text(f).alias("text"), content_tokens(f).alias("tokens")))
    own = own.withColumns({"_truth": F.coalesce(truth, F.array()), "_parts": parts})
    best = F.array_max(F.flatten(F.transform("_parts", lambda f: F.transform("_truth", lambda t: _rank(f, t, specific)))))
    own = own.withColumn("_best", F.coalesce(best, F.lit(MISS)))
    hedged = (F.size("_parts") > 1) & (F.coalesce(F.size(ids), F.lit(0)) <= 1)
    match = F.when(hedged & (F.col("_best") >= FAMILY), "partial").when(hedged, "miss").when(F.col("_best") == EXACT, "exact").when(F.col("_best") == FAMILY, "family").otherwise("miss")
    own = own.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(key)), match.alias("match"))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(key)]
    out = rows.join(own, same[0] & same[1] & same[2], "left").drop("_k0", "_k1", "_k2")
    return out.withColumns({"strict": F.col("match") == "exact", "lenient": F.col("match").isin("exact", "family")})


def hit_rates(matched: DataFrame, cell: list[str]) -> DataFrame:
    """Strict and lenient hit rates and the four counts per cell."""
    counts = [F.count_if(F.col("match") == m).alias(f"n_{m}") for m in ("exact", "family", "partial", "miss")]
    return matched.groupBy(*cell).agg(F.count("*").alias("n"), *counts, F.avg(F.col("strict").cast("double")).alias("strict_rate"), F.avg(F.col("lenient").cast("double")).alias("lenient_rate"))


def label_agreement(one: DataFrame, two: DataFrame, item: str, left: str, right: str) -> DataFrame:
    """left, right, n, agree, share: two annotators' labels on the items of both."""
    both = one.select(item, left).join(two.select(item, right), item)
    counts = both.groupBy(left, right).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).select(left, right, "n", F.col(left).eqNullSafe(F.col(right)).alias("agree"), (F.col("n") / F.col("_all")).alias("share"))


def disagreements(one: DataFrame, two: DataFrame, item: str, left: str, right: str) -> DataFrame:
    """The items of both whose labels differ."""
    return one.join(two.select(item, right), item).filter(~F.col(left).eqNullSafe(F.col(right)))
