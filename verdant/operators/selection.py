"""Choosing rows: windows of dates, exclusions, leaks, top values and seeded samples."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdant.operators.dataset import seeded_draw


def date_window(rows: DataFrame, time: str, first: Column, last: Column) -> DataFrame:
    """Rows of whole days, both ends included."""
    return rows.filter((F.col(time) >= first) & (F.col(time) < F.date_add(last, 1)))


def without(rows: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the used ones; null keys stay."""
    return rows.join(used.select(key), key, "left_anti")


def leaked(rows: DataFrame, exemplars: DataFrame, key: str) -> DataFrame:
    """Keys that are also exemplars, with their rows' count."""
    return rows.join(exemplars.select(key), key, "left_semi").groupBy(key).agg(F.count("*").alias("n"))


def in_all(rows: DataFrame, item: str, group: str, groups: int) -> DataFrame:
    """Items with rows in every one of so many groups."""
    return rows.groupBy(item).agg(F.count_distinct(group).alias("_k")).filter(F.col("_k") == groups).select(item)


def top_values(rows: DataFrame, array: str, name: str, k: int) -> DataFrame:
    """The k most frequent elements; ties by value."""
    return rows.select(F.explode(array).alias(name)).groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(k)


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in random order by a hash of the key."""
    return rows.orderBy(seeded_draw(key, seed), key).limit(n)


def day_counts(rows: DataFrame, time: str) -> DataFrame:
    """day, n: of a table partitioned by day this reads no row, else one column."""
    return rows.groupBy(F.to_date(time).alias("day")).agg(F.count("*").alias("n"))


def cut_off(counts: DataFrame, number: Column, target: int) -> tuple[date, date] | None:
    """First and last day of the slices that are needed for so many rows.

    counts: day, n; number: a day's slice, from the newest back, null outside; slices are opened in order until
    their rows reach the target. None where no day has a slice.
    """
    slices = counts.withColumn("_slice", number).filter("_slice is not null").groupBy("_slice").agg(F.sum("n").alias("_n"), F.min("day").alias("_first"), F.max("day").alias("_last"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each slice
    found = slices.withColumn("_before", before).filter(F.col("_before") < target).agg(F.min("_first").alias("a"), F.max("_last").alias("b")).first()
    return (found["a"], found["b"]) if found["a"] else None


def latest(rows: DataFrame, time: str, anchor: date, number: Callable[[Column], Column], order: list[str], target: int) -> DataFrame:
    """The first `target` rows by slice and, within it, by order (W2, W3), with the slice; only days that can matter are read.

    number: the slice of a column of days back from the anchor. The bounds are literals, so partitions and row groups
    outside them are not read.
    """
    back = lambda day: number(F.date_diff(F.lit(anchor), day))
    ends = cut_off(day_counts(rows, time), back(F.col("day")), target)
    if ends is None:
        return rows.limit(0).withColumn("slice", F.lit(None).cast("int"))
    kind = rows.schema[time].dataType.typeName()
    first, after = (F.lit(d).cast(kind) for d in (ends[0], ends[1] + timedelta(days=1)))
    own = rows.filter((F.col(time) >= first) & (F.col(time) < after)).withColumn("slice", back(F.to_date(time))).filter("slice is not null")
    return own.orderBy("slice", *order).limit(target)
