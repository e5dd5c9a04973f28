"""Agreement of annotators and of repeated runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Least kappa of each band; below the last, and below 0, it is Slight.
BANDS = [(0.8, "Almost perfect"), (0.6, "Substantial"), (0.4, "Moderate"), (0.2, "Fair")]


def kappa(pairs: DataFrame, one: str, two: str, labels: list) -> DataFrame:
    """n, observed and expected agreement over the label list, kappa and its band."""
    counts = pairs.groupBy(one, two).agg(F.count("*").alias("n"))
    sums = [F.sum(F.when(F.col(c) == label, F.col("n"))).alias(f"{k}{i}") for k, c in (("a", one), ("b", two)) for i, label in enumerate(labels)]
    own = counts.agg(F.sum("n").alias("n"), F.sum(F.when(F.col(one) == F.col(two), F.col("n"))).alias("same"), *sums)
    po = F.coalesce("same", F.lit(0)) / F.col("n")
    pe = sum((F.coalesce(f"a{i}", F.lit(0)) / F.col("n") * (F.coalesce(f"b{i}", F.lit(0)) / F.col("n")) for i in range(len(labels))), F.lit(0.0))
    out = own.select("n", po.alias("po"), pe.alias("pe")).withColumn("kappa", F.when(F.col("pe") != 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))))
    band = F.when(F.col("kappa") >= BANDS[0][0], BANDS[0][1])
    for least, name in BANDS[1:]:
        band = band.when(F.col("kappa") >= least, name)
    return out.withColumn("band", F.when(F.col("kappa").isNotNull(), band.otherwise("Slight")))


def joint_table(pairs: DataFrame, one: str, two: str) -> DataFrame:
    """How often each pair of labels was given: the confusion table of two annotators."""
    return pairs.groupBy(one, two).agg(F.count("*").alias("n"))


def verdict_agreement(rows: DataFrame, group: list[str], cell: list[str], verdicts: list[str]) -> DataFrame:
    """Per cell and field: groups with a verdict, those whose verdicts all agree, and the share (A28); null verdicts are left out."""
    own = rows.groupBy(*group).agg(*(F.struct(F.min(v).alias("lo"), F.max(v).alias("hi")).alias(v) for v in verdicts))
    each = own.select(*cell, F.explode(F.array(*(F.struct(F.lit(v).alias("field"), F.col(f"{v}.lo").alias("lo"), F.col(f"{v}.hi").alias("hi")) for v in verdicts))).alias("x")).filter("x.lo is not null")
    out = each.groupBy(*cell, "x.field").agg(F.count("*").alias("n_groups"), F.count_if(F.col("x.lo") == F.col("x.hi")).alias("n_agree"))
    return out.withColumn("rate", F.col("n_agree") / F.col("n_groups"))


def nullable_verdict(predicted: Column, truth: Column) -> Column:
    """Right or wrong; null where either is missing or has no class, so that it is left out."""
    return F.when(predicted.isNotNull() & truth.isNotNull(), predicted == truth)


def member_verdict(predicted: Column, truths: Column) -> Column:
    """Whether an answer is among the truths; null where it, or every truth, is missing."""
    known = F.filter(truths, lambda t: t.isNotNull())
    return F.when(predicted.isNotNull() & (F.size(known) > 0), F.array_contains(known, predicted))


def stability(rows: DataFrame, group: list[str], cell: list[str], answer: str, valid: str, reps: int) -> DataFrame:
    """Share of groups whose repeats are all valid and all alike."""
    own = rows.groupBy(*group).agg((F.count_if(F.col(valid)) == reps).alias("whole"), (F.min(answer).eqNullSafe(F.max(answer)) & F.count(answer).isin(0, reps)).alias("alike"))
    return own.groupBy(*cell).agg(F.count("*").alias("n_groups"), F.count_if(F.col("whole") & F.col("alike")).alias("n_stable"), F.count_if(F.col("whole")).alias("n_whole"))


def repeat_accuracy(rows: DataFrame, item: str, cell: list[str], verdict: str) -> DataFrame:
    """Mean and population deviation of the items' mean accuracies; null verdicts are left out."""
    own = rows.groupBy(item, *cell).agg(F.avg(F.col(verdict).cast("double")).alias("mean"))
    return own.groupBy(*cell).agg(F.avg("mean").alias("accuracy"), F.stddev_pop("mean").alias("deviation"))
