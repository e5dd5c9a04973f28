"""Building the labelled dataset: flattening nested records, de-duplication, caps and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def english_description(descriptions: str = "descriptions") -> Column:
    """The first English description."""
    return F.expr(f"try_element_at(filter({descriptions}, x -> x.lang = 'en'), 1).value")


def first_metric(path: str, old_path: str | None = None) -> Column:
    """A field of the first entry of the first non-empty metric list: V31, V30, V2."""
    def of(version: str, field: str) -> str:
        return f"when size(metrics.cvssMetric{version}) > 0 then get(metrics.cvssMetric{version}, 0).cvssData.{field}"

    return F.expr(f"case {of('V31', path)} {of('V30', path)} {of('V2', old_path or path)} end")


# The feed's own source name, and values that name no weakness.
FEED_SOURCE, NO_WEAKNESS = "nvd@nist.gov", ["NVD-CWE-Other", "NVD-CWE-noinfo"]


def weakness_ids(weaknesses: str = "weaknesses", feed: str = FEED_SOURCE, lang: str = "en") -> Column:
    """All ids of the first non-empty tier, order and repeats kept (P6): the feed's primary and secondary, then any other source's."""

    def tier(own: bool, kind: str) -> Column:
        fits = F.filter(weaknesses, lambda w: (w["source"].eqNullSafe(F.lit(feed)) == F.lit(own)) & w["type"].eqNullSafe(F.lit(kind)))
        values = F.flatten(F.transform(fits, lambda w: F.filter(F.coalesce(w["description"], F.array()), lambda d: d["lang"].eqNullSafe(F.lit(lang)) & ~d["value"].isin(NO_WEAKNESS))))
        return F.transform(values, lambda d: d["value"])

    out = F.array().cast("array<string>")
    for own, kind in ((False, "Secondary"), (False, "Primary"), (True, "Secondary"), (True, "Primary")):
        ids = tier(own, kind)
        out = F.when(F.size(ids) > 0, ids).otherwise(out)
    return out


def affected_components(configurations: Column | str = "configurations", affected: Column | str = "affected") -> Column:
    """source, components, raw_cpes (P7): distinct vendor and product of vulnerable CPEs, else of the affected list.

    CPE strings are split at every colon here; cpe_component respects escapes and is for correcting them. Absent
    lists count as empty, at every level, and do not hide what stands beside them.
    """
    def inner(lists: Column | str, field: str) -> Column:
        return F.flatten(F.transform(F.coalesce(F.col(lists) if isinstance(lists, str) else lists, F.array()), lambda x: F.coalesce(x[field], F.array())))

    matches = inner(inner(configurations, "nodes"), "cpeMatch")
    good = F.filter(F.transform(F.filter(matches, lambda m: m["vulnerable"]), lambda m: m["criteria"]), lambda c: F.size(F.split(c, ":")) >= 5)

    def pair(c: Column) -> Column:
        return F.concat_ws(" ", *(F.replace(F.split(c, ":")[i], F.lit("_"), F.lit(" ")) for i in (3, 4)))

    named = F.transform(inner(affected, "affectedData"), lambda d: F.trim(F.concat(F.coalesce(d["vendor"], F.lit("")), F.lit(" "), F.coalesce(d["product"], F.lit("")))))
    none = F.array().cast("array<string>")
    fallback = F.struct(F.lit("affected").alias("source"), F.coalesce(F.array_distinct(F.filter(named, lambda p: p != "")), none).alias("components"), none.alias("raw_cpes"))
    own = F.struct(F.lit("cpe").alias("source"), F.array_distinct(F.transform(good, pair)).alias("components"), F.array_distinct(good).alias("raw_cpes"))
    return F.when(F.size(good) > 0, own).otherwise(fallback)


def flat_record(records: DataFrame, key: str = "id", *keep: Column) -> DataFrame:
    """The twelve fields of a labelled record from a nested one (P10), and other columns to keep."""
    own = records.withColumn("_affected", affected_components())
    return own.select(
        *keep,
        F.col(key).alias("cve_id"), "published", english_description().alias("description"), first_metric("vectorString").alias("cvss_vector"), weakness_ids().alias("cwe_ids"),
        first_metric("attackVector", "accessVector").alias("attack_vector"), *(first_metric(f"{k}Impact").alias(f"{k}_impact") for k in ("confidentiality", "integrity", "availability")),
        F.col("_affected.source").alias("affected_component_source"), F.col("_affected.components").alias("affected_components"), F.col("_affected.raw_cpes").alias("affected_cpes_raw"),
    )


def not_rejected(records: DataFrame, status: str = "vulnStatus") -> DataFrame:
    """Records that were not withdrawn; a null status stays."""
    return records.filter(~F.col(status).eqNullSafe(F.lit("Rejected")))


def missing_parts() -> Column:
    """Which of description, cvss_vector, cwe_ids and cpe a flat record lacks."""
    no_cpe = ~F.col("affected_component_source").eqNullSafe(F.lit("cpe")) | (F.coalesce(F.size("affected_cpes_raw"), F.lit(0)) <= 0)
    return F.array_compact(F.concat(missing_fields({"description": "string", "cvss_vector": "string", "cwe_ids": "array"}), F.array(F.when(no_cpe, F.lit("cpe")))))


def is_complete() -> Column:
    """Whether a flat record has all of them."""
    return F.size(missing_parts()) == 0


def only_fallback() -> Column:
    """Whether its components come from the affected list alone (C4)."""
    return (F.col("affected_component_source") == "affected") & (F.size("affected_components") > 0)


def build_funnel(records: DataFrame, cap: int, key: str = "id", status: str = "vulnStatus") -> DataFrame:
    """One row (A32): seen, rejected, examined, complete, fallback_only, missing by part (these overlap), over_quota, multi_cwe, days, most a day.

    Over the whole input, not up to a target; cap: complete records kept of a publication day. The records are read
    once.
    """
    rejected = F.col(status).eqNullSafe(F.lit("Rejected")).alias("_rejected")
    flat = flat_record(records, key, rejected).withColumns({"_missing": missing_parts(), "_day": publication_day(F.col("published"))})
    kept, complete = ~F.col("_rejected"), ~F.col("_rejected") & (F.size("_missing") == 0)
    per_day = flat.groupBy("_day").agg(
        F.count("*").alias("seen"), F.count_if("_rejected").alias("rejected"), F.count_if(kept).alias("examined"), F.count_if(complete).alias("complete"), F.count_if(kept & ~complete & only_fallback()).alias("fallback_only"),
        *(F.count_if(kept & F.array_contains("_missing", m)).alias(f"missing_{m}") for m in ("description", "cvss_vector", "cwe_ids", "cpe")), F.count_if(complete & (F.size("cwe_ids") > 1)).alias("multi_cwe"),
    )
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in per_day.columns if c != "_day"]
    days = [F.coalesce(F.sum(F.greatest(F.col("complete") - cap, F.lit(0))), F.lit(0)).alias("over_quota"), F.count_if(F.col("complete") > 0).alias("days"), F.coalesce(F.max(F.least(F.col("complete"), F.lit(cap))), F.lit(0)).alias("most_a_day")]
    return per_day.agg(*sums, *days).withColumn("completion_rate", F.when(F.col("examined") > 0, F.col("complete") / F.col("examined")))


def first_vendor(cpes: Column) -> Column:
    """The vendor field of the first raw CPE."""
    return F.try_element_at(F.split(F.try_element_at(cpes, F.lit(1)), ":"), F.lit(4))


def cpe_component(criteria: Column) -> Column:
    """vendor product of a CPE string: escapes respected, underscores to spaces."""
    parts = F.split(criteria, r"(?<!\\):")

    def part(i: int) -> Column:
        return F.replace(F.regexp_replace(F.try_element_at(parts, F.lit(i)), r"\\(.)", "$1"), F.lit("_"), F.lit(" "))

    return F.when(F.size(parts) >= 5, F.concat(part(4), F.lit(" "), part(5)))


def vector_classes(vector: Column) -> Column:
    """The parts of a score vector by name."""
    return F.str_to_map(vector, F.lit("/"), F.lit(":"))


def publication_day(published: Column) -> Column:
    """The day, or unknown."""
    return F.coalesce(F.substring(published, 1, 10), F.lit("unknown"))


def missing_fields(required: dict[str, str]) -> Column:
    """Names of empty strings, empty arrays and nulls among the required columns."""
    empty = {"string": lambda c: F.coalesce(F.length(c) == 0, F.lit(True)), "array": lambda c: F.coalesce(F.size(c) <= 0, F.lit(True))}
    return F.array_compact(F.array(*(F.when(empty[kind](F.col(c)), F.lit(c)) for c, kind in required.items())))


def first_seen(df: DataFrame, key: str, arrival: list[str]) -> DataFrame:
    """One row per key, the first to arrive."""
    own = df.withColumn("_turn", F.row_number().over(W.partitionBy(key).orderBy(*arrival)))
    return own.filter("_turn = 1").drop("_turn")


def last_wins(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """One row per key, the last by its sequence; rows with a null key go."""
    rest = [c for c in df.columns if c not in keys]
    known = df.dropna(subset=keys)
    return known.groupBy(*keys).agg(F.max_by(F.struct(*rest), sequence).alias("_row")).select(*keys, "_row.*")


def capped(df: DataFrame, group: list[str], order: list[str], most: int) -> DataFrame:
    """At most so many rows of a group, in order."""
    own = df.withColumn("_turn", F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    return own.filter(F.col("_turn") <= most).drop("_turn")


def slice_number(days_back: Column) -> Column:
    """Two-day slices back from an anchor that share their boundary day; the first slice wins."""
    return F.when(days_back <= 2, 0).otherwise(F.ceil(days_back / 2) - 1).cast("int")


def seeded_draw(key: str, seed: int) -> Column:
    """A random order of keys that any engine can repeat: md5 of key and seed."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def stratified_sample(df: DataFrame, cells: list[str], key: str, n: int, seed: int) -> DataFrame:
    """n rows spread evenly over the cells, the remainder to the first cells; random by hash."""
    sizes = df.select(*cells).distinct()
    quota = sizes.withColumn("_rank", F.row_number().over(W.orderBy(*cells))).withColumn("_k", F.count("*").over(W.partitionBy()))
    quota = quota.withColumn("_quota", F.floor(F.lit(n) / F.col("_k")) + F.when(F.col("_rank") <= n % F.col("_k"), 1).otherwise(0))
    quota = quota.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(cells)), "_quota")
    same = F.lit(True)
    for i, c in enumerate(cells):  # a null is a cell like any other
        same = same & df[c].eqNullSafe(quota[f"_{i}"])
    own = df.join(quota, same).drop(*(f"_{i}" for i in range(len(cells)))).withColumn("_turn", F.row_number().over(W.partitionBy(*cells).orderBy(seeded_draw(key, seed), key)))
    return own.filter("_turn <= _quota").drop("_turn", "_quota")


def pending_work(items: DataFrame, done: DataFrame, systems: list, conditions: list, reps: int, item: str) -> DataFrame:
    """The grid of items, systems, conditions and repeats without rows that succeeded."""
    grid = items.select(item, F.explode(F.array(*map(F.lit, systems))).alias("model"))
    grid = grid.select("*", F.explode(F.array(*map(F.lit, conditions))).alias("cond")).select("*", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    return grid.join(done.filter("valid").select(item, "model", "cond", "rep"), [item, "model", "cond", "rep"], "left_anti")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys in one snapshot only, and keys with changed fields."""
    o, n = old.select(key, F.struct(*fields).alias("o")), new.select(key, F.struct(*fields).alias("n"))
    both = o.join(n, key, "full")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), F.lit(f)) for f in fields)))
    return both.withColumn("status", F.when(F.col("n").isNull(), "removed").when(F.col("o").isNull(), "added").otherwise("kept")).withColumn("changed", F.when(F.col("status") == "kept", changed)).select(key, "status", "changed").filter("status <> 'kept' or size(changed) > 0")
