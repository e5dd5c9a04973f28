"""Tasks by the number of rows, so that what one task sorts is bounded whatever the input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_TASK = 1_000_000


def usual_tasks(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def tasks_for(rows: DataFrame, each: int | None = None) -> int:
    """As many tasks as shuffle partitions, or more where these would hold over so many rows; costs one count."""
    return max(usual_tasks(rows.sparkSession), -(-rows.count() // (each or ROWS_PER_TASK)))
