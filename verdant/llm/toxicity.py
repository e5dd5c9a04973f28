"""Toxicity: misspelled lexicon terms by automaton, and their contexts.

The lexicon is learned from training rows: words that mark toxic documents, chosen one after another
by how many toxic documents they explain, and in the same way stems (the first letters of words, which
inflected languages continue in many ways; written with a star). Its trie is intersected with Levenshtein automata (distance
0 below 5 letters, 1 below 8, else 2): an automaton state is a set of (trie node, edits), made when
first met, so a word costs a look-up per letter and most words end in the dead state at once. Each hit
is weighed by its context window: a hit between two quotation marks of its line, or with a word of
reporting within CONTEXT words, is a quotation and not abuse. A logistic model over the weighed hits gives
the score; quoted hits add nothing to density and rate.

Labels are used of at most MOST_ROWS training rows (those of the least hash; of repeated rows of a doc_id
one; a documented bound). At most MOST_CANDIDATES marks are looked at (the most frequent in toxic rows)
and at most MOST_TERMS make the lexicon; both are bounds of the fit. Every document is scored. Null and empty texts have no hit. Without labelled rows of both classes
every score is 0.5 or less. Repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.llm import _text as tx
from verdant.llm._shared import Scratch
from verdant.llm.quality_gam import MOST_ROWS, fold, training_rows

FOLDS, HELD_OUT, CUT, CONTEXT, WINDOW = 3, 1, 0.7, 6, 25
MOST_CANDIDATES, MOST_TERMS, PRECISION, STEM_PRECISION, STEMS = 4000, 200, 0.85, 0.97, (4, 5, 6)
#: Signs at the ends of words.
STRIP = ".,;:!?()[]{}\"'*_-<>|/\\“”„‟‘’‚‛«»‹›…–—¡¿·•、。，！？：；「」『』（）#$%&~^+=`"
#: Signs and words that mark reported speech, by language; a parameter, as is CONTEXT.
QUOTES = frozenset("\"“”„‟«»‹›「」『』")
REPORTING = {
    "en": "said says wrote writes called calls quote quoted quotes term word words slur quoting",
    "de": "sagte sagt schrieb schreibt nannte nennt zitat zitiert zitierte wort wörter begriff schimpfwort",
    "fr": "dit disait écrit écrivait appelle appelait citation cite cité mot mots terme insulte",
    "es": "dijo dice escribió escribe llamó llama cita citado palabra palabras término insulto",
}
FEATURES = ["exact", "quoted", "near", "near_quoted", "dense", "rate"]


def word_of(raw: str) -> str:
    return raw.strip(STRIP).lower()


def reporting_words(by_language: dict[str, str] = REPORTING) -> frozenset[str]:
    return frozenset(w for words in by_language.values() for w in words.split())


class Automaton:
    """The trie of a lexicon, intersected with the Levenshtein automaton of whatever word is read."""

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.end: list[int] = [-1]  # allowed edits of the term that ends here
        self.most: list[int] = [0]  # and of any term below
        self.stem: list[bool] = [False]
        for term in terms:
            stem, term = term.endswith("*"), term.rstrip("*")
            allowed = 0 if stem or len(term) < 5 else 1 if len(term) < 8 else 2
            node = 0
            self.most[0] = max(self.most[0], allowed)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.end.append(-1)
                    self.most.append(0)
                    self.stem.append(False)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], allowed)
            self.end[node] = max(self.end[node], allowed)
            self.stem[node] |= stem
        self.letters = {c for kids in self.children for c in kids}
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.verdict: list[int] = []
        self.over: list[bool] = []  # a stem has been read: the rest may be anything
        self.dead = self._state(frozenset())
        self.start = self._state(self._closure({(0, 0)}))

    def _closure(self, items: set[tuple[int, int]]) -> frozenset:
        """With the trie letters that a word may leave out."""
        best: dict[int, int] = {}
        todo = list(items)
        while todo:
            node, edits = todo.pop()
            if edits <= self.most[node] and edits < best.get(node, 99):
                best[node] = edits
                todo += [(kid, edits + 1) for kid in self.children[node].values()]
        return frozenset(best.items())

    def _state(self, items: frozenset) -> int:
        if items not in self.states:
            self.states[items] = len(self.sets)
            self.sets.append(items)
            self.next.append({})
            self.over.append(any(self.stem[n] and e == 0 for n, e in items))
            self.verdict.append(min((e for n, e in items if e <= self.end[n]), default=-1))
        return self.states[items]

    def _step(self, state: int, letter: str) -> int:
        out: set[tuple[int, int]] = set()
        for node, edits in self.sets[state]:
            out.add((node, edits + 1))
            out |= {(kid, edits + (c != letter)) for c, kid in self.children[node].items()}
        return self._state(self._closure(out))

    def distance(self, word: str) -> int:
        """Edits to the nearest term that the word may stand for, or -1."""
        state = self.start
        for c in word:
            letter = c if c in self.letters else ""
            known = self.next[state]
            if (to := known.get(letter)) is None:
                to = known[letter] = self._step(state, letter)
            if (state := to) == self.dead:
                return -1
            if self.over[state]:
                return 0
        return self.verdict[state]


def quoted_words(raw: list[str], at: list[int], reporting: frozenset[str]) -> list[bool]:
    """Whether the words at some places of a line are quoted.

    So they are where an odd number of quotation marks stands before the word in its line and another after it
    (marks at its own ends count as outside), or where a reporting word is within CONTEXT words.
    """
    near = np.concatenate([[0], np.cumsum([word_of(w) in reporting for w in raw])])
    marks = np.concatenate([[0], np.cumsum([sum(c in QUOTES for c in w) for w in raw])])
    out = []
    for i in at:
        w = raw[i]
        core = w.strip(STRIP)
        left = sum(c in QUOTES for c in w[: len(w) - len(w.lstrip(STRIP))])
        inner = sum(c in QUOTES for c in core)
        before = int(marks[i]) + left
        said = near[min(len(raw), i + CONTEXT + 1)] > near[max(0, i - CONTEXT)]
        out.append(bool(said or before % 2 == 1 and marks[-1] > before + inner))
    return out


def hit_features(text: str, seen: dict[str, int], automaton: Automaton, reporting: frozenset[str]) -> list[float]:
    out, n_words, hits = dict.fromkeys(FEATURES, 0.0), 0, []
    for line in text.split("\n"):
        raw, own_hits = line.split(), []
        for i, w in enumerate(raw):
            d = seen.get(w)
            if d is None:
                own = word_of(w)
                d = seen[w] = automaton.distance(own) if own else -1
            if d >= 0:
                own_hits.append((i, d))
        if own_hits:
            hits += [(n_words + i, d, q) for (i, d), q in zip(own_hits, quoted_words(raw, [i for i, _ in own_hits], reporting))]
        n_words += len(raw)
    plain = []
    for at, d, quoted in hits:
        out[("exact" if d == 0 else "near") if not quoted else ("quoted" if d == 0 else "near_quoted")] += 1.0
        if d == 0 and not quoted:
            plain.append(at)
    if not hits:
        return [0.0] * len(FEATURES)
    dense = int((np.searchsorted(plain, np.array(plain) + WINDOW) - np.arange(len(plain))).max(initial=0))
    out = {k: float(np.log1p(v)) for k, v in out.items()}
    out["dense"], out["rate"] = float(np.log1p(dense)), len(plain) / n_words
    return [out[k] for k in FEATURES]


def _features(lexicon: list[str], reporting: frozenset[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, seen = Automaton(lexicon), {}
        for chunk in tx.chunks(batches):
            x = np.array([hit_features(t or "", seen, automaton, reporting) for t in chunk["text"].to_pylist()]).reshape(-1, len(FEATURES))
            if len(seen) > 400_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([chunk["doc_id"], *(pa.array(x[:, i]) for i in range(len(FEATURES)))], ["doc_id", *FEATURES])

    return run


def marks_of(text: str | None) -> set[str]:
    """The words of a text and their stems."""
    words = {o for w in (text or "").split() if 3 <= len(o := word_of(w)) <= 40}
    return words | {f"{w[:k]}*" for w in words for k in STEMS if len(w) >= k}


def _mark_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, toxic, clean: summed within a batch of labelled texts."""
    for chunk in tx.chunks(batches):
        seen: dict[str, list[int]] = {}
        for text, y in zip(chunk["text"].to_pylist(), chunk["y"].to_pylist()):
            for word in marks_of(text):
                seen.setdefault(word, [0, 0])[0 if y else 1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array([v[i] for v in seen.values()], pa.int64()) for i in (0, 1))], ["word", "toxic", "clean"])


def _found(marks: frozenset[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([sorted(marks & marks_of(t)) for t in chunk["text"].to_pylist()], pa.list_(pa.string()))], ["marks"])

    return run


def learn_lexicon(labelled: DataFrame, scratch: Scratch | None = None) -> list[str]:
    """Words and stems of labelled texts (text, y) that mark toxic documents; at most MOST_TERMS.

    A mark needs its precision, and so large a log-likelihood ratio that among all marks less than one is
    expected to reach it by chance. Marks are taken by the toxic documents they explain; one that is
    explained already counts half for each mark it has.
    """
    scratch = scratch or Scratch(labelled.sparkSession, "toxicity")
    # near copies count once, else words of one text that was copied look like marks: texts with the same four least word hashes
    words = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[\x09-\x0D\x20-\x2F\x3A-\x40]+"))
    sketch = F.slice(F.array_sort(F.transform(words, lambda w: F.xxhash64(w))), 1, 4)
    distinct = labelled.groupBy(sketch).agg(F.min("text").alias("text"), F.max("y").alias("y")).select("text", "y")
    distinct = scratch.write(distinct, "distinct")
    sizes = distinct.agg(F.count("*").alias("n"), F.sum("y").alias("toxic")).first()
    if not sizes["toxic"] or sizes["toxic"] == sizes["n"]:
        return []
    share = sizes["toxic"] / sizes["n"]
    counts = distinct.mapInArrow(_mark_counts, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = scratch.write(counts, "marks")
    evidence = 2 * float(np.log(max(counts.count(), 2)))
    both, part = F.col("toxic") + F.col("clean"), F.col("toxic") / (F.col("toxic") + F.col("clean"))
    ratio = 2 * (F.col("toxic") * F.log(part / share) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - part) / (1 - share))).otherwise(0.0))
    least = F.when(F.col("word").endswith("*"), STEM_PRECISION).otherwise(PRECISION)
    marks = counts.filter((F.col("toxic") > 0) & (F.col("toxic") >= least * both)).filter(ratio >= evidence).orderBy(F.desc("toxic"), "word").limit(MOST_CANDIDATES)
    known = frozenset(r["word"] for r in marks.select("word").collect())
    # of the bounded training sample only
    docs = [(1.0, r["marks"]) for r in distinct.filter("y = 1").select("text").mapInArrow(_found(known), "marks array<string>").collect()]
    chosen: list[str] = []
    while len(chosen) < MOST_TERMS:
        gain: dict[str, float] = {}
        for weight, own in docs:
            for w in own:
                gain[w] = gain.get(w, 0.0) + weight
        # of equal gain the longer mark, which says more
        best = max((w for w in gain if w not in chosen), key=lambda w: (round(gain[w], 6), len(w.rstrip("*")), w), default=None)
        if best is None or gain[best] < max(1.0, 0.002 * len(docs)):
            break
        chosen.append(best)
        docs = [(weight / 2 if best in own else weight, own) for weight, own in docs]
    return sorted(chosen)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, the last one for the constant, by Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    if not len(x):
        return w
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        keep = np.r_[np.full(len(w) - 1, ridge), 1e-3]
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, lexicon: list[str] | None = None, reporting: dict[str, str] = REPORTING) -> DataFrame:
    """doc_id, score of every document row; texts are not shuffled, but for the bounded training rows."""
    train = F.broadcast(training_rows(labels, "toxic", folds, held_out))
    labelled = docs.join(train, "doc_id").groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.min("y").alias("y"))  # of several texts of one doc_id, that of the least hash
    lexicon = learn_lexicon(labelled.select("text", "y")) if lexicon is None else lexicon
    schema = "doc_id long, " + ", ".join(f"{c} double" for c in FEATURES)
    features = _features(lexicon, reporting_words(reporting))
    rows = labelled.select("doc_id", "text").mapInArrow(features, schema).join(train, "doc_id").select(*FEATURES, "y").toArrow()  # of at most MOST_ROWS training rows
    x, y = np.stack([rows[c].to_numpy() for c in FEATURES], axis=1), rows["y"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y))
    w = [float(v) for v in np.round(fit_logistic(x[order], y[order]), 9)]
    z = sum((F.lit(v) * F.col(c) for v, c in zip(w, FEATURES)), F.lit(w[-1]))
    return docs.select("doc_id", "text").mapInArrow(features, schema).select("doc_id", (1 / (1 + F.exp(-z))).alias("score"))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    scored = toxicity_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
