"""Ranked lexical search by NRA: impact-sorted lists are read in order, never looked up.

One pass over the documents makes the index: shards of documents, each with the postings of all terms that
any item asks for, and the counts that weights need (documents, their terms, documents of each term). A second
pass over the shards, now that all counts are known, sorts each list by impact and ranks the shard's documents
for every item. All lists of an item are read from the top, down to one impact level after the other. A
document's score is then at least what has been read of it, and at most that and the weights of the lists where
it hasn't been met, times the level. Documents whose most is below the 50th least are left out; reading goes on
until the rest have met all lists or these have ended, so scores and ties are exact. A shard's best 50 hold all
of its documents among the best 50 of all, which a window over the shards' rows picks.

A shard ends at a bound of documents or postings, so memory doesn't grow with the input. Items are broadcast
in blocks of at most BLOCK_TERMS terms; more items take more passes. Levels decide speed only. Terms are told
apart by 64-bit hashes (odds of any false match of 10^4 asked terms with 10^9 others: below 10^-6).

A null text has no terms; an item without terms, or whose terms no document has, has no rows. Repeated document
rows each count and are ranked each. Equal scores go by ascending doc_id, null last. Repeated item rows are one
item each. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdant.llm import _text as tx
from verdant.llm._shared import Scratch

TOP, SHARD_DOCS, SHARD_POSTINGS, BLOCK_TERMS = 50, 1 << 17, 1 << 21, 500_000
#: Of a shard's postings, how many are at or above each level.
LEVELS = (1 / 64, 1 / 16, 1 / 4)
TERM = np.zeros(256, bool)
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_INDEX = "doc_ids array<long>, doc_terms binary, doc binary, term binary, tf binary, with_df binary, df binary, n_docs long, n_terms long"


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms, and the first term of each text (and the end)."""
    data, offsets = tx.buffers(texts)
    data = tx.LOWER[data]
    start, end = tx.runs(TERM[data], offsets)
    return tx.range_hashes(data, start, end), np.searchsorted(start, offsets)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h, first = terms(batch["text"])
        own = [np.unique(h[a:b]).view(np.int64) for a, b in zip(first, first[1:])]
        yield pa.RecordBatch.from_arrays([batch["item_id"], pa.array(own, pa.list_(pa.int64()))], ["item_id", "terms"])


def _index(asked) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """asked: a broadcast sorted array of hashes; a term is known by its place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = asked.value
        ids, sizes, parts, n_docs, n_terms = [], [], [], 0, 0

        def shard() -> pa.RecordBatch:
            doc, term, tf = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int32) for i in range(3))
            with_df, df = np.unique(term, return_counts=True)
            plain = [x.tobytes() for x in (np.concatenate(sizes) if sizes else np.empty(0, np.int64), doc, term, tf, with_df, df.astype(np.int64))]
            values = [pa.array([[x for own in ids for x in own]], pa.list_(pa.int64())), *(tx.binary([x]) for x in plain), pa.array([n_docs]), pa.array([n_terms])]
            return pa.RecordBatch.from_arrays(values, [x.split()[0] for x in _INDEX.split(", ")])

        have = held = 0
        for chunk in tx.chunks(batches):
            h, first = terms(chunk["text"])
            size = np.diff(first)
            n_docs, n_terms = n_docs + int((size > 0).sum()), n_terms + len(h)
            place = np.minimum(np.searchsorted(wanted, h), max(len(wanted) - 1, 0))
            hit = np.flatnonzero(wanted[place] == h) if len(wanted) else np.empty(0, np.int64)
            doc = np.searchsorted(first, hit, "right") - 1
            pair, tf = np.unique(doc * len(wanted) + place[hit], return_counts=True)
            docs, own = np.unique(pair // max(len(wanted), 1), return_inverse=True)
            parts.append(((own + have).astype(np.int32), (pair % max(len(wanted), 1)).astype(np.int32), tf.astype(np.int32)))
            ids.append(chunk["doc_id"].take(pa.array(docs)).to_pylist())
            sizes.append(size[docs].astype(np.int64))
            have, held = have + len(docs), held + len(pair)
            if have >= SHARD_DOCS or held >= SHARD_POSTINGS:
                yield shard()
                ids, sizes, parts, n_docs, n_terms, have, held = [], [], [], 0, 0, 0, 0
        if n_docs:
            yield shard()

    return run


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, all_terms: int) -> np.ndarray:
    """(1000000000*tf) div (1000*tf+20*m) of postings in documents of n terms."""
    if 50 * int(n.max(initial=0)) * docs < 1 << 63:
        m = 50 + 50 * n * docs // all_terms
    else:
        m = np.array([50 + 50 * int(x) * docs // all_terms for x in n], np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def best(lists: list[tuple[int, np.ndarray, np.ndarray]], levels: list[int], n: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """NRA over lists of (weight, documents, impacts), impacts falling. Documents 0..n-1 that may be among the top, with exact scores above 0.

    levels fall, and end with 0. All documents that tie with the last are returned.
    """
    least, met = np.zeros(n, np.int64), np.zeros(n, np.int64)
    whole, at, alive = sum(w for w, _, _ in lists), [0] * len(lists), None
    for level in levels:
        for i, (w, docs, impact) in enumerate(lists):
            to = len(docs) if not level else int(np.searchsorted(-impact, -level, "right"))
            read, gain = docs[at[i] : to], impact[at[i] : to]
            if alive is not None:  # nothing else can enter any more
                own = alive[read]
                read, gain = read[own], gain[own]
            least[read] += w * gain
            met[read] += w
            at[i] = to
        most = least + (whole - met) * max(level - 1, 0)
        if top < n:
            bar = max(int(np.partition(least, n - top)[n - top]), 1)
            keep = most >= bar
            alive = keep if alive is None else alive & keep
        open_ = most != least if alive is None else alive & (most != least)
        if not open_.any():
            break
    found = np.flatnonzero(least > 0 if alive is None else alive & (least > 0))
    return found, least[found]


def _rank(block, top: int, item_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """block: a broadcast of (item_ids, numbers, terms of each item, weights of terms, documents, all terms)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_ids, numbers, asked, weights, n_docs, n_terms = block.value
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch["doc_ids"][row].values
                size = np.frombuffer(batch["doc_terms"][row].as_py(), np.int64)
                doc, term, tf = (np.frombuffer(batch[c][row].as_py(), np.int32) for c in ("doc", "term", "tf"))
                if not len(doc):
                    continue
                impact = impacts(tf.astype(np.int64), size[doc], n_docs, n_terms)
                order = np.lexsort((-impact, term))
                doc, term, impact = doc[order], term[order], impact[order]
                first = np.searchsorted(term, np.arange(len(weights) + 1))
                falling = np.sort(impact)[::-1]
                levels = [*dict.fromkeys(int(falling[int(len(falling) * x)]) for x in LEVELS), 0]
                by_id = np.array(ids.fill_null(0)), np.array(ids.is_null())
                for item_id, number, own in zip(item_ids, numbers, asked):
                    lists = [(int(weights[t]), doc[a:b], impact[a:b]) for t in own if (a := first[t]) < (b := first[t + 1])]
                    found, score = best(lists, levels, len(size), top) if lists else ((), ())
                    if not len(found):
                        continue
                    keep = np.lexsort((by_id[0][found], by_id[1][found], -score))[:top]
                    out = [pa.array([number] * len(keep), pa.int64()), pa.array([item_id] * len(keep), item_type), ids.take(pa.array(found[keep])), pa.array(score[keep])]
                    yield pa.RecordBatch.from_arrays(out, ["number", "item_id", "doc_id", "score"])

    return run


def weights_of(df: np.ndarray, docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def lexical_search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the top documents (doc_id, text) of each item (item_id, text)."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "lexical_search")
    kind = items.schema["item_id"].dataType
    asked = items.select("item_id", "text").mapInArrow(_asked, f"item_id {kind.simpleString()}, terms array<long>")
    asked = scratch.write(asked.withColumn("number", F.monotonically_increasing_id()), "asked")
    item_type = asked.select("item_id").limit(0).toArrow().schema.field("item_id").type
    blocks = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms)
    texts, ranked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), []
    for b in range(blocks):
        own = asked.filter((F.size("terms") > 0) & (F.pmod(F.xxhash64("number"), F.lit(blocks)) == b)).collect()
        known = np.unique(np.concatenate([np.array(r["terms"], np.int64).view(np.uint64) for r in own] or [np.empty(0, np.uint64)]))
        index = scratch.write(texts.mapInArrow(_index(spark.sparkContext.broadcast(known)), _INDEX), f"index_{b}")
        n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        df = np.zeros(len(known), np.int64)
        for r in _df(index).collect():  # a row for each asked term of the block at most
            df[r["term"]] = r["df"]
        places = [np.searchsorted(known, np.array(r["terms"], np.int64).view(np.uint64)) for r in own]
        block = ([r["item_id"] for r in own], [r["number"] for r in own], places, weights_of(df, n_docs or 0), n_docs or 0, n_terms or 0)
        ranked.append(index.mapInArrow(_rank(spark.sparkContext.broadcast(block), top, item_type), f"number long, item_id {kind.simpleString()}, doc_id long, score long"))
    if not ranked:
        return items.select("item_id").limit(0).selectExpr("item_id", "cast(null as int) as rank", "cast(null as long) as doc_id", "cast(null as long) as score")
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return reduce(DataFrame.unionAll, ranked).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in zip(batch["with_df"].to_pylist(), batch["df"].to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(a, np.int32)), pa.array(np.frombuffer(b, np.int64))], ["term", "n"])


def _df(index: DataFrame) -> DataFrame:
    return index.select("with_df", "df").mapInArrow(_counts, "term int, n long").groupBy("term").agg(F.sum("n").alias("df"))


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    return lexical_search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_FOUND = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_FOUND} AS words FROM documents),
sized AS (SELECT r, doc_id, CAST(len(words) AS BIGINT) AS n, words FROM d WHERE len(words) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sized),
asked AS (SELECT DISTINCT item, item_id, term FROM (SELECT row_number() OVER () AS item, item_id, unnest({_FOUND}) AS term FROM benchmark)),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM sized) WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term),
m AS (SELECT r, doc_id, 100 - 50 + ((50 * n * docs) // terms) AS m FROM sized, total),
scores AS (
  SELECT item, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY item, item_id, r, doc_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
