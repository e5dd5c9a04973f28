"""Which items which systems declined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def declined_by(rows: DataFrame, item: str, system: str) -> DataFrame:
    """item, n_systems, systems: items that a system declined in any condition."""
    own = rows.filter(F.col("outcome") == "Declined").select(item, system).distinct()
    return own.groupBy(item).agg(F.count("*").alias("n_systems"), F.array_sort(F.collect_list(system)).alias("systems"))


def overlap_histogram(declined: DataFrame) -> DataFrame:
    """How many items were declined by how many systems."""
    return declined.groupBy("n_systems").agg(F.count("*").alias("n_items"))


def system_sets(declined: DataFrame) -> DataFrame:
    """Per system: items declined, and those that only it declined."""
    return declined.select("n_systems", F.explode("systems").alias("system")).groupBy("system").agg(F.count("*").alias("n_declined"), F.count_if(F.col("n_systems") == 1).alias("n_unique"))


def cross_reference(rows: DataFrame, declined: DataFrame, item: str, system: str) -> DataFrame:
    """How the other systems did on the items of the top decliner (ties: the first by name).

    A system is wrong on an item if it is right under no condition; without any row on it, it is wrong too.
    """
    top = system_sets(declined).orderBy(F.desc("n_declined"), "system").limit(1).select(F.col("system").alias("top"))
    others = rows.select(F.col(system).alias("other")).distinct().join(F.broadcast(top), F.expr("other <> top"))
    n_others = others.groupBy("top").agg(F.count("*").alias("n_others"))
    items = declined.join(F.broadcast(top), F.expr("array_contains(systems, top)")).select(item, "top").join(F.broadcast(n_others), "top", "left")
    right = rows.filter(F.col("outcome") == "Correct").select(item, F.col(system).alias("other")).distinct()
    n_right = items.join(right, item).filter("other <> top").groupBy(item).agg(F.count("*").alias("n_right"))
    joined = items.join(n_right, item, "left").withColumn("n_right", F.coalesce("n_right", F.lit(0))).withColumn("n_others", F.coalesce("n_others", F.lit(0)))
    verdict = F.when(F.col("n_right") == 0, "all wrong").when(F.col("n_right") == F.col("n_others"), "none wrong").otherwise("mixed")
    return joined.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n_items"))
