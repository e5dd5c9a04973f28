"""Layered resolution of free-text labels against an alias table and a grouped vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdant.functions.matching import inventory_label
from verdant.functions.normalize import direct_id, parenthetical_aliases, weakness_label
from verdant.functions.weakness_terms import CONSEQUENCE_TERMS, EXTRA_BROAD_TERMS, SAFE_EQUIVALENT_ALIASES

# The verdicts, in the order of the rules.
VERDICTS = ["correct", "consequence_not_mechanism", "same_pillar_wrong_cwe", "different_pillar", "unmapped_or_absent"]


def alias_index(aliases: DataFrame) -> DataFrame:
    """alias, ids, ambiguous: the reverse index of (alias, id)."""
    own = aliases.select("alias", "id").distinct().select(weakness_label(F.col("alias")).alias("alias"), "id").dropna().distinct()
    return own.groupBy("alias").agg(F.array_sort(F.collect_set("id")).alias("ids")).withColumn("ambiguous", F.size("ids") > 1)


def reject_ambiguous(index: DataFrame) -> DataFrame:
    """The index, or an error if an alias names several ids (V7)."""
    wrong = [(r["alias"], r["ids"]) for r in index.filter("ambiguous").orderBy("alias").limit(10).collect()]
    if wrong:
        raise ValueError(f"aliases of several ids: {wrong}")
    return index


def alias_draft(names: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """alias, id: official names (id, name), the short names in their parentheses, and a list made by hand."""
    label = inventory_label(F.col("name"))
    own = names.select(label.alias("alias"), "id").union(names.select(F.explode(parenthetical_aliases(F.col("name"))).alias("alias"), "id"))
    own = own if manual is None else own.union(manual.select(inventory_label(F.col("alias")).alias("alias"), "id"))
    return own.filter("alias <> ''").distinct()


def broad_terms(rows: DataFrame | None, spark, extra: dict[str, list[str]] | None = None) -> DataFrame:
    """term, ids: broad labels and what they may mean, from rows (term, id) and a fixed table that has precedence (V5)."""
    extra = EXTRA_BROAD_TERMS if extra is None else extra
    fixed = spark.createDataFrame(sorted(extra.items()), "term string, ids array<string>")
    if rows is None:
        return fixed
    own = rows.select("term", "id").distinct().select(weakness_label(F.col("term")).alias("term"), "id").dropna().groupBy("term").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return own.join(fixed.select("term"), "term", "left_anti").unionByName(fixed)


def resolve(answers: DataFrame, answer: str, index: DataFrame, vocabulary: DataFrame, safe: dict[str, str] | None = None) -> DataFrame:
    """answer, norm, resolved, method of the distinct answers: direct id, safe equivalent, alias or unresolved (V4).

    safe: labels that name an id whatever the index says.
    """
    safe = SAFE_EQUIVALENT_ALIASES if safe is None else safe
    own = answers.select(answer).distinct().withColumn("norm", weakness_label(F.col(answer)))
    own = own.withColumn("direct", direct_id(F.col("norm")))
    plain = index.filter("not ambiguous").select(F.col("alias").alias("norm"), F.col("ids")[0].alias("by_alias"))
    known = vocabulary.select(F.col("id").alias("direct"), F.lit(True).alias("known"))
    out = own.join(known, "direct", "left").join(plain, "norm", "left")
    sure = F.try_element_at(F.create_map(*(F.lit(x) for pair in safe.items() for x in pair)), F.col("norm")) if safe else F.lit(None).cast("string")
    out = out.withColumn("_safe", sure)
    found = F.when(F.col("known"), F.col("direct")).otherwise(F.coalesce("_safe", "by_alias"))
    method = (
        F.when(F.col("norm").isNull(), "NULL_OR_EMPTY").when(F.col("known"), "DIRECT_CWE_ID").when(F.col("_safe").isNotNull(), "SAFE_EQUIVALENT_ALIAS")
        .when(F.col("by_alias").isNotNull(), "STRICT_ALIAS").otherwise("UNRESOLVED")
    )
    return out.select(answer, "norm", found.alias("resolved"), method.alias("method"))


def layered_verdict(
    rows: DataFrame, answer: str, truths: str, resolved: DataFrame, vocabulary: DataFrame, broad: DataFrame | None = None,
    consequences: list[str] | None = None, group: str = "pillar", verdicts: list[str] | None = None,
) -> DataFrame:
    """Adds norm, resolved, method and verdict, by the rules in order: correct, consequence, same or other group, broad term, unmapped (V5, V6).

    broad: term, ids; such a label is in the group of a truth if one of its ids is a truth or shares a
    truth's group, and counts as the other group if not. verdicts: names for VERDICTS.
    """
    names, consequences = verdicts or VERDICTS, CONSEQUENCE_TERMS if consequences is None else consequences
    broad = broad_terms(None, rows.sparkSession) if broad is None else broad
    groups = vocabulary.select("id", group)
    mine = resolved.join(groups.withColumnRenamed("id", "resolved").withColumnRenamed(group, "_group"), "resolved", "left")
    wide = broad.select(F.col("term").alias("norm"), F.col("ids").alias("_ids"), F.explode_outer("ids").alias("id")).join(groups, "id", "left")
    mine = mine.join(wide.groupBy("norm").agg(F.first("_ids").alias("_ids"), F.collect_set(group).alias("_wide")), "norm", "left")
    # each item's truth groups once, not per answer
    keyed = rows.select(truths).distinct()
    theirs = keyed.select(truths, F.explode(truths).alias("id")).join(groups, "id").groupBy(truths).agg(F.collect_set(group).alias("_groups"))
    out = rows.join(mine, rows[answer].eqNullSafe(mine[answer]), "left").drop(mine[answer]).join(theirs, truths, "left")
    no, known = F.lit(False), F.filter(truths, lambda t: t.isNotNull())
    near = F.coalesce(F.arrays_overlap("_ids", known), no) | F.coalesce(F.arrays_overlap("_wide", "_groups"), no)
    verdict = (
        F.when(F.coalesce(F.array_contains(known, F.col("resolved")), no), names[0])
        .when(F.coalesce(F.col("norm").isin(consequences), no), names[1])
        .when(F.col("resolved").isNotNull() & F.coalesce(F.array_contains("_groups", F.col("_group")), no), names[2])
        .when(F.col("resolved").isNotNull(), names[3])
        .when(F.col("_ids").isNotNull(), F.when(near, names[2]).otherwise(names[3])).otherwise(names[4])
    )
    wide_only = F.col("resolved").isNull() & F.col("_ids").isNotNull() & ~F.coalesce(F.col("norm").isin(consequences), no)
    out = out.withColumn("verdict", verdict).withColumn("method", F.when(wide_only, "BROAD_OR_AMBIGUOUS").otherwise(F.col("method")))
    return out.drop("_group", "_groups", "_ids", "_wide")


def verdict_summary(rows: DataFrame, cell: list[str], verdicts: list[str] | None = None) -> DataFrame:
    """Totals, strict accuracy and error categories per cell."""
    kinds = verdicts or VERDICTS
    counts = [F.count_if(F.col("verdict") == k).alias(f"n_{k}") for k in kinds]
    return rows.groupBy(*cell).agg(F.count("*").alias("n"), (F.count_if(F.col("verdict") == kinds[0]) / F.count("*")).alias("strict_accuracy"), *counts)


def layer_totals(rows: DataFrame, cell: list[str], verdicts: list[str] | None = None) -> DataFrame:
    """Per cell: rows, correct and incorrect ones, rows in the error categories, and whether both layers add up."""
    kinds = verdicts or VERDICTS
    right = F.col("verdict") == kinds[0]
    out = rows.groupBy(*cell).agg(F.count("*").alias("n"), F.count_if(right).alias("correct"), F.count_if(F.coalesce(~right, F.lit(True))).alias("incorrect"), F.count_if(F.col("verdict").isin(kinds[1:])).alias("categorised"))
    return out.withColumn("balanced", (F.col("correct") + F.col("incorrect") == F.col("n")) & (F.col("categorised") == F.col("incorrect")))


def prediction_inventory(rows: DataFrame, answer: str, system: str, condition: str, item: str, truths: str, sequence: str, index: DataFrame, examples: int = 5) -> DataFrame:
    """Per normalised answer: first raw form, frequency, systems, conditions, first items, truths seen, status."""
    forms = rows.select(answer).distinct().select(F.col(answer).alias("_form"), F.coalesce(weakness_label(F.col(answer)), F.lit("__ABSENT__")).alias("norm"))
    own = rows.join(forms, rows[answer].eqNullSafe(forms["_form"]))
    turn = F.row_number().over(W.partitionBy("norm").orderBy(sequence, item))
    first = own.withColumn("_turn", turn).filter(F.col("_turn") <= examples).groupBy("norm").agg(F.transform(F.array_sort(F.collect_list(F.struct("_turn", item))), lambda x: x[item]).alias("first_items"))
    sets = {"systems": system, "conditions": condition}
    counts = own.groupBy("norm").agg(F.min_by(answer, sequence).alias("first_form"), F.count("*").alias("n"), *(F.array_sort(F.collect_set(c)).alias(k) for k, c in sets.items()))
    seen = own.select("norm", F.explode(truths).alias("truth")).distinct().groupBy("norm").agg(F.array_sort(F.collect_set("truth")).alias("truths_seen"))
    status = F.when(F.col("norm") == "__ABSENT__", "absent").when(F.col("ambiguous"), "ambiguous").when(F.col("ids").isNotNull(), "automatic").otherwise("unresolved")
    out = counts.join(first, "norm").join(seen, "norm", "left").join(index.withColumnRenamed("alias", "norm"), "norm", "left")
    return out.withColumn("status", status).drop("ids", "ambiguous")


def in_review_order(inventory: DataFrame) -> DataFrame:
    """Unresolved first, then by frequency, then by label."""
    return inventory.orderBy(F.col("status") != "unresolved", F.desc("n"), "norm")
