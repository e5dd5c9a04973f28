"""Quality rules by weak supervision.

Each rule votes 1 (good), 0 (bad) or -1 (abstains) on a document. Expectation-maximisation over the
table of vote patterns (at most 3 ** rules rows, whatever the corpus size) estimates how often each
rule is right on good and on bad documents, and the posterior probability of good quality replaces an
all-must-pass filter. Counts come from all documents.

Null and empty texts have no words: every count is 0, base_failed is true. Repeated rows are scored
alike. Without any document the result is empty. Extra columns are ignored by quality_scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdant.llm import _text as tx
from verdant.llm._shared import Scratch

MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT, KEEP_FROM = 20, 8, 30, 0.5
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_bangs", "n_stutters"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def repeated(doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which items occur twice or more within their document."""
    key = tx.mix(hashes ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def text_features(texts: pa.Array) -> dict[str, np.ndarray]:
    data, offsets = tx.buffers(texts)
    words = tx.Words(data, offsets)
    inside = tx.WORD[data]
    at, grams = words.grams(REPEAT_WINDOW)
    doc, hashes = words.doc, words.hashes()
    same = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    twice = at[repeated(doc[at], grams)]
    hit = tx.covered(len(words), twice, twice + REPEAT_WINDOW)
    start, end = tx.runs(data != 0x0A, offsets)
    with_word = np.concatenate([[0], np.cumsum(inside)])
    keep = with_word[end] > with_word[start]
    start, end = start[keep], end[keep]
    line_doc = np.searchsorted(offsets, start, "right") - 1
    lines = tx.range_hashes(data, start, end)
    key = tx.mix(lines ^ (line_doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    n_docs = len(offsets) - 1
    n_lines = np.bincount(line_doc, minlength=n_docs)
    _, first = np.unique(key, return_index=True)
    return {
        "n_words": words.counts,
        "word_chars": tx.per_doc(inside & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": tx.per_doc(_SYMBOL[data], offsets),
        "n_dup_lines": n_lines - np.bincount(line_doc[first], minlength=n_docs),
        "n_repeat_words": np.bincount(doc[hit], minlength=n_docs),
        "n_lines": n_lines,
        "n_upper": tx.per_doc(_UPPER[data], offsets),
        "n_letters": tx.per_doc(_LETTER[data], offsets),
        "n_bangs": tx.per_doc(data == 0x21, offsets),
        "n_stutters": np.bincount(doc[1:][same], minlength=n_docs),
    }


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in tx.chunks(batches):
        made = text_features(chunk["text"])
        yield pa.RecordBatch.from_arrays([chunk["doc_id"], *(pa.array(made[c].astype(np.int64)) for c in FEATURES)], ["doc_id", *FEATURES])


def document_features(docs: DataFrame) -> DataFrame:
    """doc_id and FEATURES of each document; no shuffle."""
    return docs.select("doc_id", "text").mapInArrow(_features, "doc_id long, " + ", ".join(f"{c} long" for c in FEATURES))


def rule_votes(prefix: str = "") -> dict[str, Column]:
    """Rules as columns over FEATURES (whose names may have a prefix): 1 good, 0 bad, -1 abstains."""

    def col(name: str) -> Column:
        return F.col(prefix + name)

    words, letters = F.greatest(col("n_words"), F.lit(1)), F.greatest(col("n_letters"), F.lit(1))

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, 0).when(good, 1).otherwise(-1)

    mean, symbols, upper = col("word_chars") / words, col("n_symbols") / words, col("n_upper") / letters
    again, bangs = col("n_repeat_words") / words, col("n_bangs") / words
    dup = col("n_dup_lines") / F.greatest(col("n_lines"), F.lit(1))
    return {
        "length": vote(col("n_words") < MIN_WORDS, col("n_words") >= 50),
        "mean_word": vote((mean < 2.5) | (mean > 12), (mean >= 3.5) & (mean <= 8)),
        "symbols": vote(symbols > 0.1, symbols < 0.02),
        "upper": vote(upper > 0.4, upper < 0.15),
        "repeats": vote(again > 0.28, again < 0.05),
        "dup_lines": vote(dup > 0.5, dup < 0.05),
        "bangs": vote(bangs > 0.1, bangs < 0.02),
        "stutters": vote(col("n_stutters") / words > 0.2, col("n_stutters") / words < 0.05),
    }


#: A lone flag of a rule may be a false alarm or a defect that only this rule sees; votes alone cannot tell
#: which. So one belief is set by hand: no rule flags more than MOST_FALSE_ALARMS of the good documents. The
#: starting values weigh as much as PRIOR_DOCS documents, whatever the size of the corpus.
MOST_FALSE_ALARMS, START_GOOD, PRIOR_DOCS, ROUNDS = 0.02, 0.8, 10.0, 200


def fit_votes(votes: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS, prior: float = PRIOR_DOCS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM over distinct vote patterns.

    The hidden class of a document is good, or the one defect among as many as there are rules that
    spoils it most: a bad document breaks one rule or two, so the other rules' silence is no evidence
    for it. Returns the posterior of good per pattern, each class's share of bad votes per rule (row
    0: good; abstentions count as no vote) and the classes' shares.
    """
    n_rules, counts = votes.shape[1], counts.astype(float)
    bad, cast = (votes == 0).astype(float), (votes != -1).astype(float)
    start = np.vstack([np.full(n_rules, 0.005), np.full((n_rules, n_rules), 0.05) + np.eye(n_rules) * 0.85])
    flags, share = start, np.r_[START_GOOD, np.full(n_rules, (1 - START_GOOD) / max(n_rules, 1))]
    first = share
    each = np.tile(share, (len(counts), 1))
    for _ in range(rounds):
        log = bad @ np.log(flags).T + (cast - bad) @ np.log(1 - flags).T + np.log(share)
        each = np.exp(log - log.max(axis=1, keepdims=True))
        each /= each.sum(axis=1, keepdims=True)
        w = each * counts[:, None]
        flags = (w.T @ bad + prior * start) / (w.T @ cast + prior)
        flags[0] = np.minimum(flags[0], MOST_FALSE_ALARMS)
        share = (w.sum(axis=0) + prior * first) / (counts.sum() + prior)
    return each[:, 0], flags, share


def base_failed(prefix: str = "") -> Column:
    words = F.col(f"{prefix}n_words")
    return (words < MIN_WORDS) | (F.col(f"{prefix}n_repeat_words") * 100 > words * MAX_REPEAT_PERCENT)


def _posteriors(table: DataFrame) -> DataFrame:
    """The votes' patterns, at most 3 ** rules of them, and the posterior probability of good quality of each."""
    names = [f"vote_{k}" for k in rule_votes()]
    patterns = table.groupBy(*names).count().orderBy(*names).collect()
    votes = np.array([[r[n] for n in names] for r in patterns], int).reshape(-1, len(names))
    posterior, _, _ = fit_votes(votes, np.array([r["count"] for r in patterns], float))
    rows = [(*map(int, v), float(p)) for v, p in zip(votes, posterior)]
    return table.sparkSession.createDataFrame(rows, ", ".join(f"{n} int" for n in names) + ", posterior double")


def _with_votes(docs: DataFrame, scratch: Scratch) -> DataFrame:
    return scratch.write(document_features(docs), "features").withColumns({f"vote_{k}": v for k, v in rule_votes().items()})


def vote_posteriors(docs: DataFrame, scratch: Scratch) -> DataFrame:
    return _posteriors(_with_votes(docs, scratch))


def quality_scores(docs: DataFrame, scratch: Scratch | None = None, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, the counts, the rules' votes, posterior, base_failed and kept, for every document.

    The one written table has a row of numbers per document; texts are read once and never shuffled.
    """
    table = _with_votes(docs, scratch or Scratch(docs.sparkSession, "quality-rules"))
    names = [f"vote_{k}" for k in rule_votes()]
    out = table.join(F.broadcast(_posteriors(table)), names, "left").withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_from))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_scores(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go.

    A row's votes name its posterior, so each row is judged where it is, and no text is shuffled.
    """
    known = F.broadcast(vote_posteriors(docs, Scratch(spark, "quality-stage")).withColumnsRenamed({"posterior": "__posterior", **{f"vote_{k}": f"__vote_{k}" for k in rule_votes()}}))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches):
            made = text_features(chunk["text"])
            yield pa.RecordBatch.from_arrays([*chunk.columns, *(pa.array(made[c].astype(np.int64)) for c in FEATURES)], [*chunk.schema.names, *(f"__{c}" for c in FEATURES)])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(f"__{c}", T.LongType()) for c in FEATURES)])
    rows = docs.mapInArrow(features, schema).withColumns({f"__vote_{k}": v for k, v in rule_votes("__").items()})
    return rows.join(known, [f"__vote_{k}" for k in rule_votes()]).filter(~base_failed("__") & (F.col("__posterior") >= KEEP_FROM)).select(*(f"`{c}`" for c in docs.columns))
