"""Hard negatives by exact inner products in a residue number system.

Components become whole numbers floor(scale * x). Blocks of anchors meet blocks of all rows in the cells of a
grid, a cell holding at most CELL_ANCHORS and CELL_ROWS blocks, so that a task's memory and work stay bounded
however many rows there are; rows and anchors reach their cells by a shuffle, nothing by the driver. In a cell
the component matrices are multiplied modulo several small primes in float32: residues of at most 510 over 64
components keep every partial sum below 2^24, so each product is exact, and longer vectors go by 64 components
and are reduced in between. Chinese remaindering (Garner's digits, balanced around 0) gives back the signed
score; there are as many primes as the greatest squared norm asks for (by Cauchy and Schwarz it bounds every
score). Two rounds: the first keeps each anchor's best rows of its label, the second, with their scores known,
each positive's best rows of other labels within its score band. A cell keeps the best of its rows only, and
windows over what cells have kept pick the best of all.

Rows with a null vec_id, label, vector or component, or a component that isn't finite, take no part. Vectors
shorter than the longest count as 0 beyond their end. "Other" rows are those of another vec_id; repeated rows
are rows of their own, and repeated anchors are answered each. Equal scores go by smaller vec_id. An anchor
without positives, and a positive without negatives in its band (as any of a score below 0), has no rows. Scores that might reach
2^62 are refused with an error. Other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdant.llm import _text as tx
from verdant.llm._shared import Scratch, partitions

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
ANCHOR_BLOCK, ROW_BLOCK, CELL_ANCHORS, CELL_ROWS, DEPTH = 256, 2048, 64, 32, 64
_LEAST = np.iinfo(np.int64).min


def primes(bound: int) -> list[int]:
    """Primes from 1021 down whose product leaves room beyond any score up to the bound, of either sign."""
    out, product, p = [], 1, 1021
    while product <= 8 * (bound + 1024):
        if all(p % q for q in range(2, int(p**0.5) + 1)):
            out.append(p)
            product *= p
        p -= 1
    return out


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """What is left of whole numbers modulo p, near 0."""
    return x - p * np.rint(x * np.float32(1 / p))


def residues(x: np.ndarray, moduli: list[int]) -> list[np.ndarray]:
    return [((x + p // 2) % p - p // 2).astype(np.float32) for p in moduli]


def products(a: list[np.ndarray], b: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """Exact scores (int64) of all rows of a with all rows of b, from their residues."""
    digits: list[np.ndarray] = []
    for i, p in enumerate(moduli):
        x = np.zeros((len(a[i]), len(b[i])), np.float32)
        for k in range(0, a[i].shape[1], DEPTH):
            x += centred(a[i][:, k : k + DEPTH] @ b[i][:, k : k + DEPTH].T, p)
        x = centred(x, p)
        for q, d in zip(moduli, digits):
            x = centred((x - d) * np.float32((pow(q, -1, p) + p // 2) % p - p // 2), p)
        digits.append(x)
    out = digits[-1].astype(np.int64)
    for p, d in zip(moduli[-2::-1], digits[-2::-1]):
        out *= p
        out += d.astype(np.int64)
    return out


class Best:
    """The best k (score, id) of each of n places: score falling, then id rising."""

    def __init__(self, n: int, k: int):
        self.k, self.at, self.score, self.id = k, *(np.empty(0, np.int64) for _ in range(3))
        self.least = np.full(n, _LEAST)  # a lower score can't enter

    def add(self, places: np.ndarray, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """scores, allowed: by place (row) and id (column)."""
        allowed &= scores >= self.least[places][:, None]
        if allowed.sum() > 16 * self.k * len(places) and scores.shape[1] > self.k:
            bar = np.partition(np.where(allowed, scores, _LEAST), -self.k, axis=1)[:, -self.k]
            allowed &= scores >= bar[:, None]
        row, col = np.nonzero(allowed)
        if not len(row):
            return
        at, score, own = np.r_[self.at, places[row]], np.r_[self.score, scores[row, col]], np.r_[self.id, ids[col]]
        order = np.lexsort((own, -score, at))
        at = at[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        keep = rank < self.k
        self.at, self.score, self.id = at[keep], score[order][keep], own[order][keep]
        full = rank[keep] == self.k - 1
        self.least[self.at[full]] = self.score[full]


_BLOCK = "part int, block long, ids binary, labels binary, numbers binary, vectors binary, wanted binary, wanted_scores binary"
_BLOCK_NAMES = [x.split()[0] for x in _BLOCK.split(", ")]


def _blocks(part: int, most: int, width: int, scale: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows into blocks. part: 0 for anchors, which come with numbers, and with the ids and scores of up to k positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                rows = batch.slice(at, most)
                vectors = np.zeros((rows.num_rows, width), np.int64)
                lengths = rows["vec"].value_lengths().to_numpy()
                vectors[np.arange(width) < lengths[:, None]] = np.floor(scale * rows["vec"].flatten().to_numpy())
                kind = next(t for t in (np.int16, np.int32, np.int64) if np.abs(vectors).max(initial=0) <= np.iinfo(t).max)
                numbers, wanted = (), np.full((2, 0 if part else rows.num_rows, k), -1)
                if not part:
                    numbers = rows["number"].to_numpy()
                    for i, own in enumerate(rows["positives"].to_pylist()):
                        for j, x in enumerate(own or ()):
                            wanted[:, i, j] = x["id"], x["score"]
                plain = (rows["vec_id"].to_numpy(), rows["label"].to_numpy(), np.array(numbers, np.int64))
                values = [pa.array([part], pa.int32()), pa.array([block]), *(tx.binary([x.tobytes()]) for x in plain), tx.binary([np.dtype(kind).char.encode() + vectors.astype(kind).tobytes()]), *(tx.binary([x.tobytes()]) for x in wanted)]
                yield pa.RecordBatch.from_arrays(values, _BLOCK_NAMES)
                block += 1

    return run


def _pick(width: int, moduli: list[int], k: int, top: int, low: tuple[int, int], high: tuple[int, int], second: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Reads cells: the anchor blocks of a cell come first, then its row blocks."""

    def matrix(x: bytes) -> list[np.ndarray]:
        return residues(np.frombuffer(x[1:], x[:1].decode()).astype(np.int64).reshape(-1, width), moduli)

    def wants(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the band: low * score rounded up, high * score rounded down, without leaving 64 bits."""
        down = lambda s, part: s // part[1] * part[0] + s % part[1] * part[0] // part[1]
        return -down(-scores, low), down(scores, high)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, anchors = None, []

        def kept() -> Iterator[pa.RecordBatch]:
            for own in anchors:
                best: Best = own["best"]
                i, slot = best.at // own["slots"], best.at % own["slots"]
                out = [own["numbers"][i], own["ids"][i], slot.astype(np.int32), own["wanted"][i, slot], own["scores"][i, slot], best.id, best.score]
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], [x.split()[0] for x in _KEPT.split(", ")])

        for batch in batches:
            for r in batch.to_pylist():
                if r["cell"] != cell:
                    yield from kept()
                    cell, anchors = r["cell"], []
                ids, labels = (np.frombuffer(r[c], np.int64) for c in ("ids", "labels"))
                if not r["part"]:
                    wanted, scores = (np.frombuffer(r[c], np.int64).reshape(-1, k) for c in ("wanted", "wanted_scores"))
                    slots = k if second else 1
                    anchors.append({"ids": ids, "labels": labels, "numbers": np.frombuffer(r["numbers"], np.int64), "vectors": matrix(r["vectors"]), "wanted": wanted, "scores": scores, "slots": slots, "best": Best(len(ids) * slots, top)})
                    continue
                theirs = matrix(r["vectors"]) if anchors else None
                for own in anchors:
                    score, same = products(own["vectors"], theirs, moduli), own["labels"][:, None] == labels
                    if not second:
                        own["best"].add(np.arange(len(own["ids"])), score, same & (own["ids"][:, None] != ids), ids)
                        continue
                    other, (least, most) = ~same, wants(own["scores"])
                    for j in range(k):
                        live = np.flatnonzero(least[:, j] <= most[:, j])
                        s = score[live]
                        own["best"].add(live * k + j, s, (s >= least[live, j, None]) & (s <= most[live, j, None]) & other[live], ids)
        yield from kept()

    return run


_KEPT = "number long, anchor_id long, slot int, positive_id long, positive_score long, id long, score long"


def _spread(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int) -> DataFrame:
    """Both kinds of blocks, copied to the cells of the grid where they meet; a cell's anchors come first."""
    across = -(-n_anchors // CELL_ANCHORS)
    down = max(-(-n_rows // CELL_ROWS), min(n_rows, partitions(rows.sparkSession)))
    place = lambda n: F.pmod(F.xxhash64("block"), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = anchors.withColumn("x", place(across)).withColumn("y", each(down))
    b = rows.withColumn("x", each(across)).withColumn("y", place(down))
    both = a.withColumn("cell", F.col("x") * down + F.col("y")).unionByName(b.withColumn("cell", F.col("x") * down + F.col("y"))).drop("x", "y")
    return both.repartition(across * down, "cell").sortWithinPartitions("cell", "part", "block")


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: tuple[int, int] = (1, 2), high: tuple[int, int] = (19, 20), scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, from rows of (vec_id, embedding, label).

    anchor: which rows are anchors, a condition over vec_id and label. A negative's score is at least low times its
    positive's score, and at most high times (fractions: numerator, denominator).
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "hard_negatives")
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vec"))
    # an expression, not functions of Python: NaN and infinities differ from themselves when taken from themselves
    good = good.filter("vec_id is not null and label is not null and vec is not null and forall(vec, x -> x is not null and not isnan(x - x))")
    norm = F.aggregate("vec", F.lit(0.0), lambda t, x: t + F.floor(scale * x).cast("double") * F.floor(scale * x).cast("double"))
    width, bound = good.agg(F.max(F.size("vec")), F.max(norm)).first()
    width, bound = width or 1, bound or 0
    if bound * 1.001 >= 2**62:
        raise ValueError("scores of these vectors may not fit 64 bits; use a smaller scale")
    moduli = primes(int(bound * 1.001) + 1)
    blocks = scratch.write(good.mapInArrow(_blocks(1, ROW_BLOCK, width, scale, positives), _BLOCK), "rows")
    kind = "array<struct<rank:int,id:bigint,score:bigint>>"
    asked = scratch.write(good.filter(anchor).withColumn("number", F.monotonically_increasing_id()), "anchors")
    first = scratch.write(asked.withColumn("positives", F.lit(None).cast(kind)).mapInArrow(_blocks(0, ANCHOR_BLOCK, width, scale, positives), _BLOCK), "first")
    n_rows, n_anchors = blocks.count(), first.count()
    if not n_anchors:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")

    def picked(anchors: DataFrame, n: int, top: int, second: bool, *by: str) -> DataFrame:
        found = _spread(anchors, blocks, n, n_rows).mapInArrow(_pick(width, moduli, positives, top, low, high, second), _KEPT)
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    own = picked(first, n_anchors, positives, False, "number").groupBy("number").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))
    second = scratch.write(asked.join(own, "number").mapInArrow(_blocks(0, ANCHOR_BLOCK, width, scale, positives), _BLOCK), "second")
    out = picked(second, max(second.count(), 1), negatives, True, "number", "slot")
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


OP12_SQL = """
WITH good AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.r AS number, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CAST(coalesce(list_sum([coalesce(z[1], 0) * coalesce(z[2], 0) FOR z IN list_zip(a.v, b.v)]), 0) AS BIGINT) AS score
  FROM good a JOIN good b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY number ORDER BY score DESC, id) AS slot FROM scored WHERE same) WHERE slot <= 5),
negatives AS (
  SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.number, p.slot ORDER BY n.score DESC, n.id) AS INTEGER) AS rank
  FROM positives p JOIN scored n ON n.number = p.number AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3
"""
