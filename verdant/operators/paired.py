"""Paired comparisons of cells on shared items, with one shuffle by item."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EXACT_BELOW = 25


def paired_counts(rows: DataFrame, item: str, system: str, condition: str, correct: str) -> DataFrame:
    """b, c, both, neither of every pair of conditions within a system, and of systems in a condition."""
    cells = F.sort_array(F.collect_list(F.struct(F.col(system).alias("s"), F.col(condition).alias("c"), F.col(correct).alias("ok"))))
    wide = rows.groupBy(item).agg(cells.alias("cells"))
    pairs = F.expr("flatten(transform(cells, (x, i) -> transform(slice(cells, i + 2, greatest(size(cells) - i - 1, 0)), y -> struct(x, y))))")
    each = wide.select(F.explode(pairs).alias("p")).select("p.x", "p.y").filter("(x.s = y.s and x.c <> y.c) or (x.s <> y.s and x.c = y.c)")
    a, b = F.col("x.ok"), F.col("y.ok")
    return each.groupBy(F.col("x.s").alias("system_a"), F.col("x.c").alias("condition_a"), F.col("y.s").alias("system_b"), F.col("y.c").alias("condition_b")).agg(
        F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("b"), F.count_if(~a & b).alias("c"), F.count_if(~a & ~b).alias("neither"), F.count("*").alias("n"),
    ).withColumn("favours", F.when(F.col("b") > F.col("c"), "a").when(F.col("b") < F.col("c"), "b").otherwise("neither"))


def dropped_items(rows: DataFrame, item: str, system: str, condition: str, cell_a: tuple, cell_b: tuple) -> DataFrame:
    """One row: items that one of two cells has alone, and items of any cell that lack one of the two."""
    def of(cell: tuple) -> Column:
        return F.coalesce(F.bool_or((F.col(system) == cell[0]) & (F.col(condition) == cell[1])), F.lit(False))

    per_item = rows.groupBy(item).agg(of(cell_a).alias("a"), of(cell_b).alias("b"))
    return per_item.agg(F.count_if(F.col("a") != F.col("b")).alias("unmatched"), F.count_if(~(F.col("a") & F.col("b"))).alias("lacking"))


def mean_change(rates: DataFrame, system: str, condition: str, field: str, rate: str, before, after) -> DataFrame:
    """Per system: the mean rate over the fields under either condition, and the change."""
    mean = [F.avg(F.when(F.col(condition) == c, F.col(rate))).alias(k) for k, c in (("before", before), ("after", after))]
    return rates.groupBy(system).agg(F.count_distinct(field).alias("n_fields"), *mean).withColumn("change", F.col("after") - F.col("before"))


DEPTH, SERIES_BELOW = 60, 4.0  # of the recurrences; where the first one ends


def chi_tail(x: Column) -> Column:
    """P(chi-squared with one degree of freedom >= x), by expressions alone.

    Below SERIES_BELOW 1 minus the series of the normal distribution, all of whose terms are positive; from there on
    the continued fraction of its tail. Both from the inside out.
    """
    steps = F.sequence(F.lit(DEPTH), F.lit(1), F.lit(-1))
    series = F.aggregate(steps, F.lit(1.0), lambda t, k: 1 + x / (2 * k + 1) * t)
    fraction = F.aggregate(steps, F.lit(1.0), lambda t, k: 1 + k / x / t)
    small = 1 - F.sqrt(2 * x / math.pi) * F.exp(-x / 2) * series
    large = F.exp(-x / 2) / F.sqrt(math.pi * x / 2) / fraction
    return F.when(x < SERIES_BELOW, small).when(x.isNotNull(), large)


def chi_tail_sql(x: str) -> str:
    """The same recurrences written out as one SQL expression."""
    series, fraction = "1.0::DOUBLE", "1.0::DOUBLE"
    for k in range(DEPTH, 0, -1):
        series, fraction = f"(1 + {x} / {2 * k + 1} * {series})", f"(1 + {k} / {x} / {fraction})"
    return f"CASE WHEN {x} < {SERIES_BELOW} THEN 1 - sqrt(2 * {x} / pi()) * exp(-{x} / 2) * {series} ELSE exp(-{x} / 2) / sqrt(pi() * {x} / 2) / {fraction} END"


def exact_p(b: Column, c: Column) -> Column:
    """Two-sided binomial p of the smaller count, for few discordant pairs."""
    return F.expr("least(1.0d, 2 * aggregate(sequence(0L, least(b, c)), struct(0.0d as total, pow(0.5d, b + c) as term), (s, k) -> struct(s.total + s.term as total, s.term * (b + c - k) / (k + 1) as term), s -> s.total))")


def mcnemar(counts: DataFrame, exact_below: int = EXACT_BELOW) -> DataFrame:
    """statistic (corrected, where not exact) and p."""
    n = F.col("b") + F.col("c")
    stat = F.when(n >= exact_below, F.pow(F.abs(F.col("b") - F.col("c")) - 1, 2) / n)
    out = counts.withColumn("statistic", stat)
    return out.withColumn("p", F.when(n == 0, 1.0).when(n < exact_below, exact_p(F.col("b"), F.col("c"))).otherwise(chi_tail(F.col("statistic"))))


def holm(tests: DataFrame, family: list[str], order: list[str], p: str = "p", alpha: float = 0.05) -> DataFrame:
    """Step-down adjusted p, running maximum, clamped at 1, and the verdict."""
    ranked = W.partitionBy(*family).orderBy(p, *order)
    raw = F.least(F.lit(1.0), F.col(p) * (F.count("*").over(W.partitionBy(*family)) - F.row_number().over(ranked) + 1))
    out = tests.withColumn("_raw", raw).withColumn("p_holm", F.max("_raw").over(ranked.rowsBetween(W.unboundedPreceding, 0)))
    return out.drop("_raw").withColumn("significant", F.col("p_holm") < alpha)
