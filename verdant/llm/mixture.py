"""Mixing sources to target weights.

Sources in code-point order, null last, weigh 1, 2, 3, 1, ... and share 100 % of all words; a target
stops at MOST_EPOCHS times its source's size and the excess is shared again by weight. With sources
in order of size / weight, the sources that stop are a prefix, so one running sum solves the sharing.

Documents get hash-random keys (md5 of the doc_id). Each source's key range is cut into equal buckets
(as many as its document count asks for); bucket totals are summed along the buckets, and within a
bucket along the keys, so a source that holds a third of all rows is spread over many tasks. Whole
epochs take every document; the rest of the budget is cut in key order at the exact word, so one
document of a source may be taken in part.

Sizes are counted once and written with the source and key of each document; all sums read that table.

Null texts have size 0. A null source is a source. Rows that share a doc_id get the same key and are
ordered by size. Without any word all targets are 0. Empty tables give an empty result. The stage adds
size, source_size, target and taken to the columns of documents; columns of these names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdant.llm._shared import Scratch

WEIGHTS, MOST_EPOCHS, SEED, DOCS_PER_BUCKET = 3, 3, "mix-1", 5_000
KEY_BITS = 52
MOST_BROADCAST_SOURCES = 200_000  # rows of some 50 bytes; more sources are joined by shuffles
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE_SPACE), "")).cast("long")


def hash_key(doc_id: Column, seed: str = SEED) -> Column:
    """The first 52 bits of an md5: the same in every engine."""
    digits = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, KEY_BITS // 4)
    return F.conv(digits, 16, 10).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, n_docs, source_size, target from source, n_docs, source_size (a row per source)."""
    by_name = W.orderBy(F.col("source").isNull(), "source")
    ratio = W.orderBy("ratio", "rank")
    upto = ratio.rowsBetween(W.unboundedPreceding, W.currentRow)
    after = ratio.rowsBetween(1, W.unboundedFollowing)
    own = (
        sizes.withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", ((F.col("rank") - 1) % WEIGHTS + 1).cast("double"))
        .withColumn("most", (F.col("source_size") * MOST_EPOCHS).cast("double"))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(W.partitionBy()).cast("double"))
        .withColumn("share", (F.col("total") - (F.sum("most").over(upto) - F.col("most"))) / (F.sum("weight").over(after.rowsBetween(0, W.unboundedFollowing))))
    )
    # the level at which the remaining sources share: the first source in order that does not stop
    level = F.min(F.when(F.col("ratio") >= F.col("share"), F.struct("ratio", "rank", "share"))).over(W.partitionBy())
    return own.withColumn("level", level["share"]).select(
        "source", "n_docs", "source_size",
        F.when(F.col("level").isNull() | (F.col("ratio") < F.col("level")), F.col("most")).otherwise(F.col("weight") * F.col("level")).alias("target"),
    )


def mix_sources(docs: DataFrame, docs_per_bucket: int = DOCS_PER_BUCKET, scratch: Scratch | None = None, whole: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document row; whole: all its other columns too."""
    scratch = scratch or Scratch(docs.sparkSession, "mix-sources")
    own = {"__size": word_count(F.col("text")), "__key": hash_key(F.col("doc_id"))}
    narrow = scratch.write(docs.select("doc_id", F.col("source").alias("__source"), *(v.alias(k) for k, v in own.items())), "sizes")
    sizes = narrow.groupBy(F.col("__source").alias("source")).agg(F.count("*").alias("n_docs"), F.sum("__size").alias("source_size"))
    targets = scratch.write(source_targets(sizes), "targets").withColumnsRenamed({c: f"__{c}" for c in ("n_docs", "source_size", "target")})
    few = targets.count() <= MOST_BROADCAST_SOURCES
    buckets = F.ceil(F.col("__n_docs") / docs_per_bucket)
    bucket = (F.col("__key") * buckets.cast("decimal(20,0)") / F.lit(1 << KEY_BITS).cast("decimal(20,0)")).cast("long")

    def placed(rows: DataFrame) -> DataFrame:
        s, t = rows.alias("s"), (F.broadcast(targets) if few else targets).alias("t")
        return s.join(t, F.expr("s.__source <=> t.source")).select("s.*", "t.__n_docs", "t.__source_size", "t.__target").withColumn("__bucket", bucket)

    totals = placed(narrow).groupBy("__source", "__bucket").agg(F.sum("__size").alias("bucket_size"))
    along = W.partitionBy("__source").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    before = scratch.write(totals.select("__source", "__bucket", F.coalesce(F.sum("bucket_size").over(along), F.lit(0)).alias("__earlier")), "buckets")
    rows = docs.withColumn("__source", F.col("source")).withColumns(own) if whole else narrow
    p, b = placed(rows).alias("p"), before.alias("b")
    both = p.join(b, F.expr("p.__source <=> b.__source and p.__bucket = b.__bucket")).select("p.*", "__earlier")
    within = W.partitionBy("__source", "__bucket").orderBy("__key", "doc_id", "__size").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("__earlier") + F.coalesce(F.sum("__size").over(within), F.lit(0))
    budget = F.floor(F.col("__target")).cast("long")
    epochs = F.when(F.col("__source_size") > 0, F.floor(budget / F.col("__source_size"))).otherwise(0).cast("long")
    taken = F.col("__epochs") * F.col("__size") + F.greatest(F.lit(0), F.least(F.col("__size"), budget - F.col("__epochs") * F.col("__source_size") - F.col("__start")))
    out = both.withColumn("__start", start).withColumn("__epochs", epochs).withColumn("__taken", taken.cast("long"))
    made = [F.col(f"__{c}").alias(c) for c in MADE]
    if whole:
        return out.select(*(f"`{c}`" for c in docs.columns if c not in MADE), *made)
    return out.select("doc_id", F.col("__source").alias("source"), *made)


MADE = ["size", "source_size", "target", "taken"]


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", *MADE)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the documents that the mix takes, whole or in part, and how many words of each."""
    return mix_sources(docs, whole=True).filter("taken > 0")


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix-1'), 1, 13))::BIGINT AS k
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
own AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM sizes),
rated AS (
  SELECT *, ((rank - 1) % 3 + 1)::DOUBLE AS weight, (source_size * 3)::DOUBLE AS most,
         (source_size * 3)::DOUBLE / ((rank - 1) % 3 + 1)::DOUBLE AS ratio,
         (sum(source_size) OVER ())::DOUBLE AS total FROM own),
shared AS (
  SELECT *, (total - (sum(most) OVER (ORDER BY ratio, rank ROWS UNBOUNDED PRECEDING) - most))
         / (sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS share FROM rated),
level AS (SELECT share AS level FROM shared WHERE ratio >= share ORDER BY ratio, rank LIMIT 1),
targets AS (
  SELECT source, source_size,
         CASE WHEN level IS NULL OR ratio < level THEN most ELSE weight * level END AS target
  FROM shared LEFT JOIN level ON true),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
cut AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM placed)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - start)))::BIGINT AS taken
FROM cut
"""
