"""Benchmark decontamination with DataFrame functions only.

Normalised windows of WINDOW words of the benchmark items (shorter items: the whole item) form a
broadcast hash set after a count of its windows; a larger set is broadcast in blocks of at most
MOST_BROADCAST_WINDOWS, one scan a block. Every window of every document is hashed (no text is copied
per window), looked up, and a hit is verified word by word against the item's window before anything
counts as contaminated. Texts are not shuffled: a scan gives hits, and one row per document that
carries its number of words.

Null and empty texts and items have no words and no windows. Equal windows of several items count for
each. Repeated rows of a document are each reported. Rows that share a doc_id
and differ in text are documents of their own. An empty benchmark leaves all documents clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdant.llm._shared import KEY, keyed

WINDOW = 10
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Windows of the benchmark that may be broadcast (about 250 bytes each).
MOST_BROADCAST_WINDOWS = 200_000
#: The hash of the row that every document matches.
EVERY = -(1 << 62) - 11


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWERED), SEPARATORS), "")


def window_hashes(column: str, length: int) -> Column:
    """The hashes of all windows of that length, in order; none where there are fewer words."""
    return F.expr(f"if(size({column}) < {length}, cast(array() as array<bigint>), transform(sequence(0, greatest(size({column}) - {length}, 0)), i -> xxhash64(slice({column}, i + 1, {length}))))")


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """hash, len, gram (the window's words, one space between), items."""
    own = benchmark.select("item_id", words(F.col("text")).alias("w")).filter("size(w) > 0").withColumn("len", F.least(F.size("w"), F.lit(window)))
    each = own.select("item_id", "len", F.explode(F.expr("transform(sequence(0, size(w) - len), i -> slice(w, i + 1, len))")).alias("g"))
    return each.groupBy(F.xxhash64("g").alias("hash"), "len", F.array_join("g", " ").alias("gram")).agg(F.collect_set("item_id").alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """KEY, n_words, hit_at (sorted positions of hit words), items (sorted as strings): a row per key."""
    spark = docs.sparkSession
    grams = item_windows(benchmark, window)
    lengths = {r["len"]: r["n"] for r in grams.groupBy("len").agg(F.count("*").alias("n")).collect()}  # at most `window` rows
    # each document matches this row once, so that it is in the result whether it has hits or not
    every = spark.range(1).select(F.lit(EVERY).alias("hash"), F.lit(0).alias("len"), F.lit("").alias("gram"), F.array().cast(grams.schema["items"].dataType).alias("items"))
    split = keyed(docs, words(F.col("text")).alias("w"))
    found = []
    for length in sorted(lengths) or [window]:
        blocks = max(1, -(-lengths.get(length, 0) // MOST_BROADCAST_WINDOWS))
        for block in range(blocks):
            own = grams.filter((F.col("len") == length) & (F.expr(f"pmod(hash, {blocks})") == block))
            array = window_hashes("w", length)
            if not found:
                own, array = own.unionByName(every), F.concat(F.array(F.lit(EVERY)), array)
            shift = 0 if found else 1
            # the hashes are a column before they are exploded: so the explosion and the look-up share
            # generated code, and the words of a document are not copied for each of its windows (outer:
            # else Spark infers a filter on the array and computes the words again within it)
            hashed = split.select(*KEY, "w", F.size("w").alias("n_words"), array.alias("hashes"))
            scan = hashed.select(*KEY, "w", "n_words", F.posexplode_outer("hashes").alias("at", "hash")).withColumn("at", F.col("at") - shift)
            hits = scan.join(F.broadcast(own), "hash").filter(F.expr("array_join(slice(w, greatest(at, 0) + 1, len), ' ') = gram"))
            found.append(hits.select(*KEY, "n_words", "at", "len", "items"))
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    ranges = F.array_distinct(F.flatten(F.collect_set(F.when(F.col("len") > 0, F.expr("sequence(at, at + len - 1)")))))
    items = F.array_distinct(F.flatten(F.collect_set(F.when(F.col("len") > 0, F.expr("transform(items, i -> cast(i as string))")))))
    return hits.groupBy(*KEY).agg(F.max("n_words").cast("long").alias("n_words"), F.array_sort(ranges).alias("hit_at"), F.array_sort(items).alias("items"))


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return keyed(docs, "doc_id").join(found, KEY).select(
        "doc_id", "n_words", F.size("hit_at").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit_at") > 0).alias("contaminated"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a benchmark window go."""
    dirty = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter(F.size("hit_at") > 0).select(*KEY)
    return keyed(docs, *docs.columns).join(dirty, KEY, "left_anti").select(docs.columns)


OP4_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM grams),
scan AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, lengths WHERE len(w) >= n)),
hits AS (SELECT s.doc_id, s.i, s.n, g.item_id FROM scan s JOIN grams g ON s.n = g.n AND s.g = g.g),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hits) GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(p.n_hit, 0)::BIGINT AS n_hit, coalesce(m.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN places p USING (doc_id) LEFT JOIN named m USING (doc_id)
"""
