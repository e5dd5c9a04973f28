"""Sources and sinks of the evaluation jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdant.sources.arrays import read_feed_pages, read_json_array  # noqa: F401


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Good rows and the bad lines; strict: fail on the first bad line."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path), None
    whole = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path).filter(F.trim("value") != "")  # by text, as Spark refuses to read bad lines alone from JSON
    rows = lines.select(F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    return rows.filter("_bad is null").drop("_bad"), rows.filter("_bad is not null").select("_bad")


def read_keyed_arrays(spark: SparkSession, path: str, row: T.StructType, keys: list[str] | None = None, key_name: str = "model") -> DataFrame:
    """{key: [rows], scalars}: one row per element, the key as a column.

    The keys are those that the files have; keys: take these alone. Values that are no arrays are left out.
    """
    files = spark.read.option("wholetext", True).text(path).select(F.parse_json("value").alias("v"))
    each = files.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("key", "value").filter(F.schema_of_variant("value").startswith("ARRAY"))
    if keys is not None:
        each = each.filter(F.col("key").isin(keys))
    return each.select(F.col("key").alias(key_name), F.explode(F.try_variant_get("value", "$", "array<variant>")).alias("x")).select(key_name, F.from_json(F.to_json("x"), row).alias("r")).select(key_name, "r.*")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, booleans: list[str] = (), null: str = "<NULL>") -> DataFrame:
    """Header CSV; True/False texts to booleans, the sentinel to null."""
    df = spark.read.option("header", True).option("nullValue", null).schema(schema).csv(path)
    return df.withColumns({c: F.lower(F.trim(c)) == "true" for c in booleans})


def write_csv(df: DataFrame, path: str, null: str = "<NULL>") -> None:
    """Arrays joined by '; ', nulls as the sentinel."""
    arrays = {f.name: F.array_join(F.col(f.name).cast("array<string>"), "; ") for f in df.schema if isinstance(f.dataType, T.ArrayType)}
    df.withColumns(arrays).write.mode("overwrite").option("header", True).option("nullValue", null).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One object a line, nulls written, nested columns kept: results and details."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append(df: DataFrame, path: str) -> None:
    """Add rows to a table."""
    df.write.mode("append").parquet(path)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace whole partitions of a table, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
