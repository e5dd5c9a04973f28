"""Responses as a stream of landing files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdant.operators.responses import validated


def landed(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """Rows of response files as they land; bad lines come with `_bad` set."""
    whole = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    return spark.readStream.schema(whole).option("columnNameOfCorruptRecord", "_bad").option("maxFilesPerTrigger", files_per_trigger).json(path)


def valid_once(rows: DataFrame, keys: list[str], time: str, delay: str, required: list[str], allowed: dict[str, list[str]]) -> DataFrame:
    """Valid responses, the first per key within the watermark."""
    own = validated(rows.filter("_bad is null").drop("_bad"), "raw_response", required, allowed).filter("valid").drop("parsed")
    return own.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def running_coverage(rows: DataFrame, cell: list[str], required: list[str], allowed: dict[str, list[str]]) -> DataFrame:
    """Valid and invalid rows per cell, updated as files land (R2)."""
    own = validated(rows.filter("_bad is null").drop("_bad"), "raw_response", required, allowed)
    return own.groupBy(*cell).agg(F.count_if(F.col("valid")).alias("n_valid"), F.count_if(~F.col("valid")).alias("n_invalid"))
