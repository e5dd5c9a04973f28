"""Profiles and consistency checks of consolidated rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def rows_per_item(rows: DataFrame, item: str) -> DataFrame:
    """Histogram: how many items have how many rows (A10)."""
    return rows.groupBy(item).agg(F.count("*").alias("rows")).groupBy("rows").agg(F.count("*").alias("n_items"))


def marginals(rows: DataFrame, system: str, condition: str) -> DataFrame:
    """Row counts per system and condition with totals."""
    return rows.cube(system, condition).agg(F.count("*").alias("n"))


def consolidation_check(rows: DataFrame, items: DataFrame, item: str, truth: str, systems: int, conditions: int) -> DataFrame:
    """One row: rows, the rows that a full grid of the items would have, and rows without a truth."""
    own = rows.agg(F.count("*").alias("rows"), F.count_if(F.col(truth).isNull()).alias("without_truth"))
    full = items.agg((F.count_distinct(item) * systems * conditions).alias("expected"))
    return own.crossJoin(full).withColumn("complete", F.col("rows") == F.col("expected"))


def wrong_row_counts(rows: DataFrame, item: str, expected: int) -> DataFrame:
    """Items that do not have so many rows (A10)."""
    return rows.groupBy(item).agg(F.count("*").alias("rows")).filter(F.col("rows") != expected)


def odd_truths(rows: DataFrame, truth: str, labels: list[str]) -> DataFrame:
    """Truths outside the label set, null among them, and their rows."""
    return rows.filter(F.col(truth).isNull() | ~F.col(truth).isin(labels)).groupBy(truth).agg(F.count("*").alias("n"))


def inconsistent_truth(rows: DataFrame, item: str, truth: str) -> DataFrame:
    """Items with several truths; null counts as a value."""
    several = (F.min(truth) != F.max(truth)) | ((F.count(truth) > 0) & (F.count(truth) < F.count("*")))
    return rows.groupBy(item).agg(F.coalesce(several, F.lit(False)).alias("several")).filter("several").select(item)


def label_distribution(rows: DataFrame, item: str, truth: str, thin_below: int = 20) -> DataFrame:
    """Truth labels over distinct items, their share, and whether they are thin."""
    own = rows.groupBy(item).agg(F.min(truth).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    total = own.agg(F.sum("n").alias("total"))
    return own.crossJoin(F.broadcast(total)).select("label", "n", (100 * F.col("n") / F.col("total")).alias("percent"), (F.col("n") < thin_below).alias("thin"))


def value_harvest(rows: DataFrame, value: str) -> DataFrame:
    """Distinct raw values with counts, null included."""
    return rows.groupBy(value).agg(F.count("*").alias("n"))


def null_breakdown(rows: DataFrame, system: str, condition: str, value: str, valid: str) -> DataFrame:
    """Nulls per system and condition with totals, and nulls in valid rows."""
    return rows.cube(system, condition).agg(F.count_if(F.col(value).isNull()).alias("n_null"), F.count_if(F.col(value).isNull() & F.col(valid)).alias("n_null_valid"))


def coverage(rows: DataFrame, cell: list[str], valid: str) -> DataFrame:
    """Valid and invalid rows, failure rate and verdict per cell."""
    out = rows.groupBy(*cell).agg(F.count_if(F.col(valid)).alias("n_valid"), F.count_if(~F.col(valid)).alias("n_invalid"))
    rate = F.col("n_invalid") / (F.col("n_valid") + F.col("n_invalid"))
    return out.withColumn("failure_rate", rate).withColumn("verdict", F.when(rate <= 0.05, "PROCEED").otherwise("STOP"))


class Watched:
    """Checks of rows in the pass that uses them: rows are to be used in place of the given ones, then raise_broken() asked.

    checks: conditions that every row must meet; null counts as broken.
    """

    def __init__(self, rows: DataFrame, checks: dict[str, Column]):
        self._seen = Observation(f"checks-{uuid.uuid4().hex}")
        counts = [F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()]
        self.rows = rows.observe(self._seen, F.count("*").alias("_rows"), *counts)

    def broken(self) -> dict[str, int]:
        """How many rows break each condition, once the rows have been used by an action."""
        return {k: n for k, n in self._seen.get.items() if k != "_rows" and n}

    def raise_broken(self) -> None:
        if broken := self.broken():
            raise ValueError("; ".join(f"{n} rows break: {k}" for k, n in sorted(broken.items())))
