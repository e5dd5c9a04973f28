"""Fuzzy component match: matching-block ratios as column expressions, behind an index of rare characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.8


def _once(value: Column, body) -> Column:
    """body(value), with the value worked out once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def characters(text: Column) -> Column:
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1))))


def longest_block(a: Column, b: Column) -> Column:
    """size, i, j (from 0) of the longest common block of two non-empty arrays; of equal ones the first in a, then in b.

    Row by row, each cell has the length of the common run that ends there.
    """
    def row(state: Column, i: Column) -> Column:
        here = F.element_at(a, i)
        lengths = F.zip_with(b, F.concat(F.array(F.lit(0)), state["row"]), lambda c, before: F.when(c == here, before + 1).otherwise(0))

        def taken(own: Column) -> Column:
            most = F.array_max(own)
            found = F.struct(most.alias("size"), (i - most).alias("i"), (F.array_position(own, most).cast("int") - most).alias("j"))
            return F.struct(own.alias("row"), F.when(most > state["best"]["size"], found).otherwise(state["best"]).alias("best"))

        return _once(F.slice(lengths, 1, F.size(b)), taken)

    none = F.struct(F.lit(0).alias("size"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    start = F.struct(F.array_repeat(F.lit(0), F.size(b)).alias("row"), none.alias("best"))
    return F.aggregate(F.sequence(F.lit(1), F.size(a)), start, row, lambda s: s["best"])


def matched(a: Column, b: Column) -> Column:
    """Characters in matching blocks: the longest one, then those on its left and on its right, and so on."""
    pair = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    rest = lambda x, n: F.slice(x, n + 1, F.greatest(F.size(x) - n, F.lit(0)))

    def step(state: Column, _: Column) -> Column:
        def split(own: Column) -> Column:
            def with_block(best: Column) -> Column:
                left = pair(F.slice(own["a"], F.lit(1), best["i"]), F.slice(own["b"], F.lit(1), best["j"]))
                right = pair(rest(own["a"], best["i"] + best["size"]), rest(own["b"], best["j"] + best["size"]))
                more = F.filter(F.array(left, right), lambda p: (best["size"] > 0) & (F.size(p["a"]) > 0) & (F.size(p["b"]) > 0))
                todo = F.concat(more, F.slice(state["todo"], F.lit(2), F.size(state["todo"])))
                return F.struct(todo.alias("todo"), (state["n"] + best["size"]).alias("n"))

            return _once(longest_block(own["a"], own["b"]), with_block)

        return F.when(F.size(state["todo"]) == 0, state).otherwise(_once(F.element_at(state["todo"], 1), split))

    first = F.filter(F.array(pair(a, b)), lambda p: (F.size(p["a"]) > 0) & (F.size(p["b"]) > 0))
    turns = F.sequence(F.lit(0), 2 * F.least(F.size(a), F.size(b)))  # a block has one character at least, and leaves two ends
    return F.aggregate(turns, F.struct(first.alias("todo"), F.lit(0).alias("n")), step, lambda s: s["n"])


def ratio(a: Column, b: Column) -> Column:
    """2 * matched / both lengths, 1 for two empty texts (N14). In one direction, as published: a's first longest block counts."""
    return _once(F.struct(characters(a).alias("a"), characters(b).alias("b")), lambda x: F.when(F.size(x["a"]) + F.size(x["b"]) == 0, F.lit(1.0)).otherwise(2.0 * matched(x["a"], x["b"]) / (F.size(x["a"]) + F.size(x["b"]))))


def numbered(text: Column) -> Column:
    """A text's characters, equal ones numbered, so that sets of them overlap as the multisets do."""
    return _once(characters(text), lambda own: F.transform(own, lambda c, i: F.concat(c, F.lit(":"), F.size(F.filter(F.slice(own, F.lit(1), i), lambda d: d == c)).cast("string"))))


def _needed(both: Column, least: float) -> Column:
    """How many characters two texts of so many in all must share."""
    return F.ceil(least * both / 2 - 1e-9).cast("int")


def token_pairs(left: DataFrame, right: DataFrame, least: float = LEAST) -> DataFrame:
    """a, b: alike tokens of two one-column tables (N14), equal ones among them.

    Two alike tokens share so many characters that one of the rarest few of either is common to both (as many as
    it may lack, and one). Tokens meet by such a character and by length, then their common characters bound the
    ratio from above; the ratio itself is for the few pairs left. Nothing alike is missed.
    """
    a, b = left.toDF("token").dropna().distinct(), right.toDF("token").dropna().distinct()
    marked = a.union(b).distinct().withColumn("marks", numbered(F.col("token")))
    seen = marked.select("token", F.explode("marks").alias("mark"))
    order = seen.groupBy("mark").agg(F.count("*").alias("n"))
    ranked = seen.join(order, "mark").groupBy("token").agg(F.sort_array(F.collect_list(F.struct("n", "mark"))).alias("r")).select("token", F.transform("r", lambda x: x["mark"]).alias("marks"))
    size = F.size("marks")
    shortest, longest = F.ceil(size * least / (2 - least) - 1e-9).cast("int"), F.floor(size * (2 - least) / least + 1e-9).cast("int")
    rare = ranked.withColumn("rare", F.slice("marks", F.lit(1), size - _needed(size + shortest, least) + 1)).withColumn("size", size)
    x = rare.join(a, "token", "left_semi").select(F.col("token").alias("a"), F.col("marks").alias("x"), F.explode("rare").alias("mark"), F.sequence(shortest, longest).alias("sizes")).withColumn("size", F.explode("sizes")).drop("sizes")
    y = rare.join(b, "token", "left_semi").select(F.col("token").alias("b"), F.col("marks").alias("y"), F.explode("rare").alias("mark"), "size")
    both = F.size("x") + F.size("y")
    near = x.join(y, ["mark", "size"]).filter((F.col("a") != F.col("b")) & (2.0 * F.size(F.array_intersect("x", "y")) / both >= least)).select("a", "b").distinct()
    alike = near.filter(ratio(F.col("a"), F.col("b")) >= least)
    return alike.union(a.join(b, "token", "left_semi").select(F.col("token").alias("a"), F.col("token").alias("b")))


def component_match(rows: DataFrame, key: str, truth_tokens: str, answer_tokens: str, product: str, least: float = LEAST, score_from: float = 0.5) -> DataFrame:
    """key, score, matched: share of truth tokens found, and the product's first token among them (V3)."""
    pairs = token_pairs(rows.select(F.explode(truth_tokens)), rows.select(F.explode(answer_tokens)), least)
    alike = pairs.groupBy(F.col("a").alias("_a")).agg(F.collect_set("b").alias("_alike"))
    each = rows.select(key, F.col(product).alias("_product"), F.explode(truth_tokens).alias("_a"), F.coalesce(answer_tokens, F.array().cast("array<string>")).alias("_answer")).join(alike, "_a", "left")
    hit = F.coalesce(F.arrays_overlap("_answer", "_alike"), F.lit(False)).cast("int")
    found = each.groupBy(key, "_product", "_a").agg(F.max(hit).alias("hit"))
    out = found.groupBy(key).agg(F.avg("hit").alias("score"), F.max(F.when(F.col("_a") == F.col("_product"), F.col("hit"))).alias("first"))
    return out.select(key, "score", ((F.col("score") >= score_from) & (F.coalesce("first", F.lit(0)) == 1)).alias("matched"))
