"""The n-gram join where many classes share a shingle: tiles of blocks, and counts summed as a tree."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from verdant.llm import ngram_join

SCHEMA = "doc_id long, text string"


def alike(n, words, seed):
    """Texts that share their opening words; each copies a part of the one before it, now and then nearly all."""
    rnd = random.Random(seed)
    out, last = [], [f"w{rnd.randint(0, 400)}" for _ in range(words)]
    for _ in range(n):
        keep = rnd.choice([0, words // 2, words - 2])
        last = last[:keep] + [f"w{rnd.randint(0, 400)}" for _ in range(words - keep)]
        out.append("the same opening words here " + " ".join(last))
    return out


def by_hand(texts):
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    least = list(range(len(texts)))

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if 100 * len(x & sets[j]) >= 75 * len(x | sets[j]):
                a, b = sorted((root(i), root(j)))
                least[b] = a
    return {i: (len(sets[i]), root(i)) for i in range(len(texts))}


@pytest.mark.parametrize("tile", [3, 20, 2_048])
def test_components_in_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(ngram_join, "TILE_ROWS", tile)
    texts = alike(150, 30, 5)
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == by_hand(texts)


def test_tiles_pair_all_classes_once(spark, monkeypatch):
    """The pairs that tiles make are those of whole shingles, each as often as shingles have it."""
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 4)
    rnd = random.Random(3)
    tokens = {t: sorted(rnd.sample(range(100), size)) for t, size in enumerate([2, 4, 5, 9, 40, 63])}
    bits = bytes(ngram_join.PARITY_BITS // 8)
    rows = spark.createDataFrame([(t, c[0], x % 7, x, 20) for t, c in tokens.items() for x in c], "token long, lead long, comp long, cls long, n long")
    classes = spark.createDataFrame([(x, bits) for x in range(100)], "cls long, bits binary")
    want = Counter((a, b) for c in tokens.values() for a in c for b in c if a < b and a % 7 != b % 7)
    got = {(r["a"], r["b"]): r["shared"] for r in ngram_join._second_product(rows, classes).collect()}
    assert got == want
    sizes = Counter((r["token"], r["tile"]) for r in ngram_join._tiled(rows).collect())
    assert max(n for (t, _), n in sizes.items() if t == 5) < 63 / 2  # no tile holds most of a hot shingle


def test_counts_as_a_tree(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FAN_IN", 2)
    texts = alike(60, 30, 8)
    grams, _ = ngram_join.shingle_sets(pa.array(texts))
    want = np.bincount((grams >> np.uint64(64 - ngram_join.SKETCH_BITS)).astype(np.int64), minlength=1 << ngram_join.SKETCH_BITS)
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(9)
    assert np.array_equal(ngram_join.shingle_counts(docs), want)
    assert not ngram_join.shingle_counts(docs.limit(0)).any()
