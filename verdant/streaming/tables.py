"""Streams into tables: each batch takes effect once, whatever is repeated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdant.operators.responses import validated
from verdant.sources.tables import Table


def landed_lines(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """line and file of response files as they land."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))


def sorted_out(lines: DataFrame, schema: T.StructType, raw: str, required: list[str], allowed: dict[str, list[str]]) -> DataFrame:
    """The fields of each line, what its response holds, valid, and the reason if it is not. Blank lines are nothing."""
    whole = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = lines.filter(F.trim("line") != "").withColumn("_r", F.from_json("line", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    rows = validated(parsed.select("line", "file", "_r.*"), raw, required, allowed).drop("parsed")
    broken = F.col("_bad").isNotNull()
    reason = F.when(broken, F.lit("not a JSON object")).when(~F.col("valid"), F.concat_ws("; ", "notes"))
    return rows.withColumn("valid", ~broken & F.col("valid")).withColumn("reason", reason).drop("_bad", "notes")


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each combination of keys, null keys equal: the first in order, then by line."""
    turn = F.row_number().over(W.partitionBy(*keys).orderBy(*order, "line", "file"))
    return rows.withColumn("_turn", turn).filter("_turn = 1").drop("_turn")


def not_stored(rows: DataFrame, stored: DataFrame | None, keys: list[str]) -> DataFrame:
    """Rows whose keys the table does not have yet; of the table only the keys are read."""
    if stored is None:
        return rows
    known = stored.select(*(F.col(k).alias(f"_stored_{k}") for k in keys)).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & rows[k].eqNullSafe(known[f"_stored_{k}"])
    return rows.join(known, same, "left_anti")


def keep_once(good: Table, bad: Table, stream: str, schema: T.StructType, raw: str, keys: list[str], order: list[str], required: list[str], allowed: dict[str, list[str]]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: valid responses to one table, once for each key for good, all other lines to another.

    stream names the query, whose batch numbers are the commit marks: a batch that a table has taken already
    changes nothing there, so a stream may die anywhere and be started again from its checkpoint.
    """
    def take(lines: DataFrame, batch: int) -> None:
        rows = sorted_out(lines, schema, raw, required, allowed)
        for table, of in ((good, lambda: not_stored(first_per_key(rows.filter("valid"), keys, order), good.read(), keys).drop("line", "file", "valid", "reason")), (bad, lambda: rows.filter("not valid").select("file", "line", "reason"))):
            done = table.mark(stream)
            if done is None or done < batch:
                table.append(of(), marks={stream: batch})

    return take


def upsert_into(table: Table, stream: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for update mode: the rows that changed replace those with their keys (R2)."""
    def take(rows: DataFrame, batch: int) -> None:
        done = table.mark(stream)
        if done is None or done < batch:
            table.upsert(rows, keys, marks={stream: batch})

    return take


def coverage_counts(lines: DataFrame, schema: T.StructType, raw: str, cell: list[str], required: list[str], allowed: dict[str, list[str]]) -> DataFrame:
    """Valid and invalid lines of each cell so far, for update mode; broken lines have no cell and count under nulls."""
    rows = sorted_out(lines, schema, raw, required, allowed)
    return rows.groupBy(*cell).agg(F.count_if(F.col("valid")).alias("n_valid"), F.count_if(~F.col("valid")).alias("n_invalid"))
