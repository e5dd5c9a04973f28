"""Names for ids, truth inventories, label sheets, fixed selections and look-back windows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdant.functions.matching import stripped
from verdant.functions.normalize import natural_key
from verdant.operators.dataset import cpe_component

SAMPLE_A_RANGE = 64  # keys, from which borders are taken
PLACEHOLDERS = ["NVD-CWE-Other", "NVD-CWE-noinfo"]


def first_weakness(weaknesses: str = "weaknesses", placeholders: list[str] | None = None, lang: str = "en") -> Column:
    """The first description in the language that is no placeholder, in order of the lists (P5)."""
    no = F.array(*map(F.lit, PLACEHOLDERS if placeholders is None else placeholders))
    each = F.transform(weaknesses, lambda w: F.filter(F.coalesce(w["description"], F.array()), lambda d: (d["lang"] == lang) & ~F.coalesce(F.array_contains(no, d["value"]), F.lit(False))))
    return F.try_element_at(F.flatten(each), F.lit(1))["value"]


def recomputed_components(rows: DataFrame, key: str, cpes: str, old: str, source: str) -> DataFrame:
    """key, old, new of the records with cpe-sourced components that parsing anew would change."""
    new = F.array_distinct(F.filter(F.transform(cpes, cpe_component), lambda c: c.isNotNull()))
    return rows.filter(F.col(source) == "cpe").select(key, F.col(old).alias("old"), new.alias("new")).filter(~F.col("old").eqNullSafe(F.col("new")))


def blind_sheet(rows: DataFrame, order: list[str], keep: list[str], n: int, prefix: str = "VT", label: str = "your_label") -> DataFrame:
    """item_id, the kept columns and an empty label, for the first n rows in order, however many."""
    own = numbered(rows, order, "_turn", lambda _: (F.lit(1), F.lit(n)))
    return own.select(F.format_string(f"{prefix}-%03d", "_turn").alias("item_id"), *keep, F.lit("").alias(label))


def eligible(rows: DataFrame, answer: str, names: str) -> DataFrame:
    """Rows with an answer and with truth names, none of them null."""
    named = (F.size(names) > 0) & F.forall(names, lambda x: x.isNotNull())
    return rows.filter(F.coalesce((F.col(answer) != "") & named, F.lit(False)))


def select_listed(rows: DataFrame, listed: DataFrame, key: str, position: str = "pos") -> DataFrame:
    """The listed rows in list order; a listed key that is missing or comes twice is an error."""
    out = listed.select(key, position).join(rows, key, "left" if key in rows.columns else "inner")
    counts = listed.select(key).join(rows.select(key, F.lit(1).alias("_here")), key, "left").groupBy(key).agg(F.count("_here").alias("_n")).filter("_n <> 1")
    wrong = [tuple(r) for r in counts.orderBy(key).limit(10).collect()]
    if wrong:
        raise ValueError(f"listed keys with other than one row (key, rows): {wrong}")
    return out.orderBy(position)


def attach_names(rows: DataFrame, key: str, ids: str, names: DataFrame, prefix: str = "CWE-") -> DataFrame:
    """Adds names, parallel to ids, null where unknown, and n_unresolved.

    names: id, name; an id of digits alone gets the prefix, blank ones go, the last name by sort order
    stays where an id has several. Empty and null arrays stay as they are. The join goes by the exploded
    ids, so that the vocabulary may have any size; Spark broadcasts it where it is small.
    """
    own = names.select(stripped(F.col("id")).alias("_id"), stripped(F.col("name")).alias("_name")).filter("_id <> '' and _name <> ''")
    own = own.withColumn("_id", F.when(F.startswith("_id", F.lit(prefix)), F.col("_id")).otherwise(F.concat(F.lit(prefix), "_id"))).groupBy("_id").agg(F.max("_name").alias("_name"))
    each = rows.select(key, F.posexplode(ids).alias("_pos", "_id")).join(own, "_id", "left")
    found = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_name"))), lambda x: x["_name"]).alias("names"))
    out = rows.join(found, key, "left").withColumn("names", F.coalesce("names", F.when(F.col(ids).isNotNull(), F.array().cast("array<string>"))))
    return out.withColumn("n_unresolved", F.coalesce(F.size(F.filter("names", lambda x: x.isNull())), F.lit(0)))


def truth_inventory(rows: DataFrame, item: str, ids: str, names: str, examples: int = 5) -> DataFrame:
    """Per id: names seen, their number, items, rows, the first items and needs_review.

    Ids and names pair where there are as many, or where one id has all names; else ids stand alone.
    """
    clean = F.filter(F.transform(F.coalesce(ids, F.array()), lambda x: F.upper(stripped(x))), lambda x: F.coalesce(x != "", F.lit(False)))
    said = F.filter(F.transform(F.coalesce(names, F.array()), stripped), lambda x: F.coalesce(x != "", F.lit(False)))
    own = rows.select(F.monotonically_increasing_id().alias("_row"), F.col(item).alias("_item"), clean.alias("_ids"), said.alias("_names"))
    none = F.lit(None).cast("string")
    alike, single = F.size("_ids") == F.size("_names"), (F.size("_ids") == 1) & (F.size("_names") > 0)
    pairs = (
        F.when(alike, F.zip_with("_ids", "_names", lambda i, n: F.struct(i.alias("id"), n.alias("name"))))
        .when(single, F.transform("_names", lambda n: F.struct(F.col("_ids")[0].alias("id"), n.alias("name"))))
        .otherwise(F.transform("_ids", lambda i: F.struct(i.alias("id"), none.alias("name"))))
    )
    each = own.select("_row", "_item", F.explode(pairs).alias("p")).select("_row", "_item", "p.id", "p.name")
    # two steps: the ids' items are counted before, not gathered
    per_row = each.select("_row", "id").distinct().groupBy("id").agg(F.count("*").alias("n_rows"))
    items = each.select("_item", "id").distinct()
    turn = F.row_number().over(W.partitionBy("id").orderBy("_item"))
    first = items.withColumn("_turn", turn).filter(F.col("_turn") <= examples).groupBy("id").agg(F.array_sort(F.collect_list("_item")).alias("first_items"))
    n_items = items.groupBy("id").agg(F.count("*").alias("n_items"))
    seen = each.groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    out = n_items.join(per_row, "id").join(first, "id").join(seen, "id")
    return out.select("id", "names", F.size("names").alias("n_names"), "n_items", "n_rows", "first_items", (F.size("names") != 1).alias("needs_review"))


def in_inventory_order(inventory: DataFrame) -> DataFrame:
    """By the ids' numbers."""
    return inventory.orderBy(natural_key(F.col("id")))


def look_back_slice(days_back: Column, first: int = 90, step: int = 90, most: int = 1080) -> Column:
    """1 for the first window, one more for each extension, null beyond the last."""
    own = F.greatest(F.ceil((days_back - first) / step) + 1, F.lit(1)).cast("int")
    return F.when((days_back >= 0) & (days_back <= most), own)


def growing_window(rows: DataFrame, days_back: Column, order: list[str], target: int, first: int = 90, step: int = 90, most: int = 1080) -> DataFrame:
    """The first `target` rows by window and, within it, by order; no window is opened once it is reached."""
    own = rows.withColumn("slice", look_back_slice(days_back, first, step, most)).filter("slice is not null")
    return own.orderBy("slice", *order).limit(target)


def first_items(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows."""
    return rows.orderBy(*order).limit(n)


def numbered(rows: DataFrame, order: list[str], turn: str = "turn", span: Callable[[Column], tuple[Column, Column]] | None = None) -> DataFrame:
    """Adds each row's number in order, from 1, without one task for all; null keys first.

    A sample by hash gives the borders of as many ranges as there are shuffle partitions; rows are numbered in their
    range, and the counts of the ranges before, a row each, are added. The same rows give the same borders in every
    run, so a repeated task numbers alike. Rows of equal keys share a range and have any order.

    span: from the number of all rows, the first and last number wanted; ranges outside it are not sorted.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*order)
    thin = max(1, rows.count() // (ranges * SAMPLE_A_RANGE))
    sample = rows.select(key.alias("k")).filter(F.pmod(F.xxhash64("k"), F.lit(thin)) == 0).agg(F.sort_array(F.collect_list("k")).alias("s"))
    cut = F.transform(F.sequence(F.lit(1), F.lit(max(ranges - 1, 1))), lambda i: F.get("s", F.floor(i * F.size("s") / ranges).cast("int")))
    borders = sample.select(F.when(F.size("s") > 0, cut).otherwise(F.slice("s", 1, 0)).alias("_borders"))  # one row

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["a"] + s["b"]) / 2).cast("int")
        right = F.get("_borders", middle) <= key
        return F.when(s["a"] >= s["b"], s).otherwise(F.struct(F.when(right, middle + 1).otherwise(s["a"]).alias("a"), F.when(right, s["b"]).otherwise(middle).alias("b")))

    steps = F.sequence(F.lit(0), F.lit(ranges.bit_length()))
    place = F.aggregate(steps, F.struct(F.lit(0).alias("a"), F.size("_borders").alias("b")), halve, lambda s: s["a"])
    own = rows.crossJoin(F.broadcast(borders)).withColumn("_range", place).drop("_borders")
    counts = own.groupBy("_range").agg(F.count("*").alias("_k"))
    before = counts.select("_range", "_k", (F.sum("_k").over(W.orderBy("_range")) - F.col("_k")).alias("_before"), F.sum("_k").over(W.partitionBy()).alias("_all"))
    own = own.join(F.broadcast(before), "_range")  # a row for each range
    if span:
        first, last = span(F.col("_all"))
        own = own.filter((F.col("_before") < last) & (F.col("_before") + F.col("_k") >= first))
    own = own.withColumn(turn, F.col("_before") + F.row_number().over(W.partitionBy("_range").orderBy(*order)))
    if span:
        own = own.filter((F.col(turn) >= first) & (F.col(turn) <= last))
    return own.drop("_range", "_k", "_before", "_all")


def random_page(rows: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """k rows that follow each other by key, from a seeded offset; all rows where there are fewer."""
    drawn = F.lit(int(hashlib.md5(f"page:{seed}".encode()).hexdigest()[:13], 16))

    def span(n: Column) -> tuple[Column, Column]:
        offset = drawn % (F.greatest(n - k, F.lit(0)) + 1)
        return offset + 1, offset + k

    return numbered(rows, [key], "_turn", span).drop("_turn")


def field_agreement(rows: DataFrame, group: list[str], cell: list[str], fields: list[str], valid: str, reps: int) -> DataFrame:
    """Per cell and field: groups with all repeats valid, those alike, and the share (A26); null equals "None" (T3)."""
    own = rows.filter(F.col(valid)).groupBy(*group).agg(
        F.count("*").alias("_n"), *(F.count_distinct(F.coalesce(F.col(f).cast("string"), F.lit("None"))).alias(f"_{f}") for f in fields)
    ).filter(F.col("_n") == reps)
    each = own.select(*cell, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), (F.col(f"_{f}") == 1).alias("same")) for f in fields))).alias("x"))
    out = each.groupBy(*cell, "x.field").agg(F.count("*").alias("eligible"), F.count_if(F.col("x.same")).alias("n_agree"))
    return out.withColumn("rate", F.col("n_agree") / F.col("eligible"))


def without_provenance(rows: DataFrame, dropped: str, provenance: str = "provenance") -> DataFrame:
    """Aliases but those of one provenance (V8)."""
    return rows.filter(~F.col(provenance).eqNullSafe(F.lit(dropped)))


def sensitivity(whole: DataFrame, less: DataFrame, cell: list[str], measure: str = "strict_accuracy") -> DataFrame:
    """Two summaries of the same cells side by side, and the change (V8)."""
    own, other = whole.select(*cell, F.col(measure).alias("with_all")), less.select(*cell, F.col(measure).alias("without"))
    return own.join(other, cell).withColumn("change", F.col("without") - F.col("with_all"))
