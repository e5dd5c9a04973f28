"""Quality classifier: a generalised additive model with pairwise interactions.

Features are counts and ratios of the whole text. Cyclic boosting goes round the features; each step
fits a shallow tree to the residuals of one binned feature and adds it to that feature's table. Then
pairs of features with the largest gain get two-way tables in the same way. A document's score is a
sum of table entries, looked up for whole batches at once.

The model is fitted on at most MOST_ROWS labelled training rows (those of the least hash, a documented
bound); every document is scored. Null and empty texts have all features 0 and are scored like any
text. Without labelled rows of both classes every score is 0.5. A doc_id labelled twice counts once, with its
least label; of repeated rows of a doc_id one is used.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdant.llm import _text as tx
from verdant.llm._shared import Scratch
from verdant.llm.quality_rules import FEATURES as COUNTS
from verdant.llm.quality_rules import text_features

FOLDS, HELD_OUT, CUT, MOST_ROWS = 5, 0, 0.3, 50_000
BINS, ROUNDS, RATE, PAIRS, PAIR_BINS, RIDGE = 32, 150, 0.15, 6, 8, 1.0
FEATURES = ["words", "mean_word", "symbols", "dup_lines", "repeats", "line_words", "upper", "bangs", "stutters", "digits", "non_ascii", "punctuation", "distinct"]
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b".,;:?'\"()-")] = True


def matrix(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES per text."""
    c = text_features(texts)
    data, offsets = tx.buffers(texts)
    words = tx.Words(data, offsets, lower=True)
    size = np.maximum(np.diff(offsets), 1)
    n, lines, letters = np.maximum(c["n_words"], 1), np.maximum(c["n_lines"], 1), np.maximum(c["n_letters"], 1)
    key = np.unique(tx.mix(words.hashes() ^ (words.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_index=True)[1]
    distinct = np.bincount(words.doc[key], minlength=len(size))
    made = [c["n_words"], c["word_chars"] / n, c["n_symbols"] / n, c["n_dup_lines"] / lines, c["n_repeat_words"] / n, c["n_words"] / lines, c["n_upper"] / letters, c["n_bangs"] / n, c["n_stutters"] / n, tx.per_doc(_DIGIT[data], offsets) / size, tx.per_doc(data >= 0x80, offsets) / size, tx.per_doc(_PUNCTUATION[data], offsets) / n, distinct / n]
    return np.stack([np.asarray(x, np.float64) for x in made], axis=1)


class Additive:
    """Tables of bins per feature and per pair of features."""

    def __init__(self, n_features: int):
        self.edges = [np.empty(0)] * n_features
        self.base, self.main, self.pairs = 0.0, [np.zeros(BINS)] * n_features, []

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], "right") for i, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros(x.shape, int)

    def score(self, x: np.ndarray) -> np.ndarray:
        codes = self.codes(x)
        total = np.full(len(x), self.base)
        for i, table in enumerate(self.main):
            total += table[codes[:, i]]
        for i, j, table in self.pairs:
            total += table[codes[:, i] * PAIR_BINS // BINS, codes[:, j] * PAIR_BINS // BINS]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Additive:
        if len(np.unique(y)) < 2:
            return self
        n, k = x.shape
        self.edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS - 3)[1:-1])) for i in range(k)]
        # a defect of a few rows must not vanish between quantiles: ends of the range get bins too
        self.edges = [np.unique(np.r_[e, np.quantile(x[:, i], [0.002, 0.01, 0.99, 0.998])]) for i, e in enumerate(self.edges)]
        codes = self.codes(x)
        self.main = [np.zeros(BINS) for _ in range(k)]
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        total = np.full(n, self.base)
        for _ in range(ROUNDS):
            for i in range(k):
                g, h = self._sums(total, y, codes[:, i], BINS)
                step = RATE * _tree(g, h, 3)
                self.main[i] += step
                total += step[codes[:, i]]
        coarse = codes * PAIR_BINS // BINS
        gains = []
        for i, j in itertools.combinations(range(k), 2):
            g, h = self._sums(total, y, coarse[:, i] * PAIR_BINS + coarse[:, j], PAIR_BINS**2)
            gains.append((float((g * g / (h + RIDGE)).sum()), i, j))
        self.pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
        for _ in range(ROUNDS // 5):
            for i, j, table in self.pairs:
                cell = coarse[:, i] * PAIR_BINS + coarse[:, j]
                g, h = (s.reshape(PAIR_BINS, PAIR_BINS) for s in self._sums(total, y, cell, PAIR_BINS**2))
                step = RATE * _quadrants(g, h)
                table += step
                total += step.reshape(-1)[cell]
        return self

    @staticmethod
    def _sums(total: np.ndarray, y: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return np.bincount(at, y - p, n), np.bincount(at, p * (1 - p), n)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """The values of a tree with so many leaves over ordered bins, grown by the largest gain."""
    cuts = [0, len(g)]
    cg, ch = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + RIDGE)
    while len(cuts) - 1 < leaves:
        options = [(worth(a, m) + worth(m, b) - worth(a, b), m) for a, b in zip(cuts[:-1], cuts[1:]) for m in range(a + 1, b)]
        if not options or max(options)[0] <= 1e-9:
            break
        cuts = sorted([*cuts, max(options)[1]])
    out = np.empty(len(g))
    for a, b in zip(cuts[:-1], cuts[1:]):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + RIDGE)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The best cut on either axis: four leaves."""
    best, out = -1.0, np.zeros(g.shape)
    cg, ch = (np.pad(s.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for s in (g, h))
    n = len(g)
    for a in range(1, n):
        for b in range(1, n):
            boxes = [(0, a, 0, b), (0, a, b, n), (a, n, 0, b), (a, n, b, n)]
            own = [(c[x1, y1] - c[x0, y1] - c[x1, y0] + c[x0, y0]) for c in (cg, ch) for x0, x1, y0, y1 in boxes]
            gain = sum(p * p / (q + RIDGE) for p, q in zip(own[:4], own[4:]))
            if gain > best:
                best = gain
                for (x0, x1, y0, y1), p, q in zip(boxes, own[:4], own[4:]):
                    out[x0:x1, y0:y1] = p / (q + RIDGE)
    return out


def fold(doc_id: Column, folds: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))


def training_rows(labels: DataFrame, label: str, folds: int, held_out: int, most: int = MOST_ROWS) -> DataFrame:
    """doc_id, y of at most that many labelled training rows: small enough to broadcast."""
    own = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter((fold(F.col("doc_id"), folds) != held_out) & F.col("y").isNotNull() & F.col("doc_id").isNotNull())
    return own.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in tx.chunks(batches):
        x = matrix(chunk["text"])
        yield pa.RecordBatch.from_arrays([chunk["doc_id"], *(pa.array(x[:, i]) for i in range(x.shape[1]))], ["doc_id", *FEATURES])


def _score(model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch[c].to_numpy() for c in FEATURES], axis=1)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(model.value.score(x))], ["doc_id", "score"])

    return run


def quality_classifier(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, score of every document row. The written table has numbers only; no text is shuffled."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "quality-gam")
    table = scratch.write(docs.select("doc_id", "text").mapInArrow(_features, "doc_id long, " + ", ".join(f"{c} double" for c in FEATURES)), "features")
    rows = table.join(F.broadcast(training_rows(labels, "quality", folds, held_out)), "doc_id")
    # of several texts of one doc_id the one with the least features
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(*FEATURES, "y")).alias("r")).select("r.*").toArrow()  # of at most MOST_ROWS training rows
    x = np.stack([rows[c].to_numpy() for c in FEATURES], axis=1)
    order = np.lexsort(x.T)  # the same model whatever order the rows came in
    model = Additive(len(FEATURES)).fit(x[order], rows["y"].to_numpy()[order].astype(float))
    return table.mapInArrow(_score(spark.sparkContext.broadcast(model)), "doc_id long, score double")


def op7_quality_gam(spark, sf_dir: str) -> DataFrame:
    scored = quality_classifier(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
