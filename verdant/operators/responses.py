"""Raw model responses: parsing, validation, cost and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdant.functions.normalize import without_fences
from verdant.operators.tasks import tasks_for, usual_tasks

_END = '"~end~"'


def parse_object(raw: Column) -> Column:
    """The response as a VARIANT object, or null; text after the object is an error."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), without_fences(raw), F.lit(f",{_END}]")))
    strict = (F.try_variant_get(wrapped, "$[1]", "string") == "~end~") & F.try_variant_get(wrapped, "$[2]", "variant").isNull()
    own = F.try_variant_get(wrapped, "$[0]", "variant")
    return F.when(strict & F.schema_of_variant(own).startswith("OBJECT"), own)


def validated(rows: DataFrame, raw: str, required: list[str], allowed: dict[str, list[str]], check_extra: bool = True) -> DataFrame:
    """Adds valid, notes and the required fields as strings; null is an allowed value."""
    out = rows.withColumn("parsed", parse_object(F.col(raw)))
    keys = F.coalesce(F.json_object_keys(F.to_json("parsed")), F.array().cast("array<string>"))
    out = out.withColumn("_keys", keys)
    need = F.array(*map(F.lit, required))
    notes = [F.when(F.col("parsed").isNull(), F.lit("not a JSON object"))]
    here = F.col("parsed").isNotNull()
    notes.append(F.when(here & (F.size(F.array_except(need, "_keys")) > 0), F.concat(F.lit("missing: "), F.array_join(F.array_sort(F.array_except(need, "_keys")), ","))))
    if check_extra:
        notes.append(F.when(here & (F.size(F.array_except("_keys", need)) > 0), F.concat(F.lit("extra: "), F.array_join(F.array_sort(F.array_except("_keys", need)), ","))))
    for field, values in allowed.items():
        notes.append(F.when(F.coalesce(~field_of(field).isin(values), F.lit(False)), F.lit(f"bad value: {field}")))
    return out.withColumn("notes", F.array_compact(F.array(*notes))).withColumn("valid", F.size("notes") == 0).withColumns({k: field_of(k) for k in required}).drop("_keys")


def field_of(name: str) -> Column:
    return F.try_variant_get("parsed", f"$.{name}", "string")


def consolidate(responses: list[DataFrame], truth: DataFrame, item: str, fields: list[str]) -> DataFrame:
    """All conditions' rows beside their ground truth, as two structs.

    Where the rows are many, both sides are dealt to so many tasks that what one sorts stays bounded.
    """
    both = responses[0]
    for more in responses[1:]:
        both = both.unionByName(more, allowMissingColumns=True)
    own = truth.select(item, F.struct(*(c for c in truth.columns if c != item)).alias("ground_truth"))
    both = both.withColumn("extracted", F.struct(*(F.col(f) for f in fields))).drop(*fields)
    if (n := tasks_for(both)) > usual_tasks(truth.sparkSession):
        both, own = both.repartition(n, item), own.repartition(n, item)
    return both.join(own, item, "left")


def latency_and_cost(rows: DataFrame, prices: DataFrame, system: str = "model", items: int = 1_000_000) -> DataFrame:
    """Mean and total time, tokens, cost and its projection, per system.

    A system without a price costs nothing; the projection to so many items goes by the rows whose tokens are known
    and is null where there are none.
    """
    used = F.count_if(F.col("tokens_in").isNotNull() | F.col("tokens_out").isNotNull())
    own = rows.groupBy(system).agg(F.count("*").alias("n"), used.alias("_used"), F.avg("latency").alias("mean_latency"), F.sum("latency").alias("total_latency"), F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"))
    none = F.lit(0.0)
    cost = (F.col("tokens_in") * F.coalesce("price_in", none) + F.col("tokens_out") * F.coalesce("price_out", none)) / 1e6
    projected = F.when(F.col("_used") > 0, cost / F.col("_used") * items)
    return own.join(prices, system, "left").withColumn("cost", cost).withColumn("projected", projected).drop("price_in", "price_out", "_used")


def time_totals(rows: DataFrame, system: str, seconds: str) -> DataFrame:
    """Time per system and in all."""
    return rows.rollup(system).agg(F.sum(seconds).alias("seconds"), F.count("*").alias("n"))


def prompt(template: str, text: Column, placeholder: str = "{description}") -> Column:
    """The template with the item's text; a template without the placeholder is refused."""
    if placeholder not in template:
        raise ValueError(f"the template has no {placeholder}")
    return F.replace(F.lit(template), F.lit(placeholder), text)
