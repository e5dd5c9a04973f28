"""Lexical search, hard negatives and packing against brute force; nulls, ties, repeated rows, clashing names, long texts."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verdant.llm import hard_negatives, lexical_search, packing

CLASH = {"key": 1, "row": "x", "number": 2.5, "rank": 1, "score": "s", "term": "t", "n": 3, "cell": 1, "part": "p", "block": 1, "start": "a", "ids": 5, "sequence_id": "q"}


def clashing(df):
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()})


# lexical search


def searched(docs, items, top=50):
    """By the definition, one document at a time. docs, items: (id, text); yields (item_id, rank, doc_id, score)."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = [(i, Counter(words(t))) for i, t in docs]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    n_docs, n_terms = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in df}
    out = []
    for item, text in items:
        terms = set(words(text)) & set(df)
        scores = [(sum(w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * (50 + 50 * n * n_docs // n_terms))) for t in terms if t in c), i) for i, c, n in own]
        best = sorted((-s, i is None, i or 0) for s, i in scores if s > 0)[:top]
        out += [(item, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(best)]
    return out


def some_docs(rnd, n=300):
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "Straße", "日本", "x9"]
    texts = [" ".join(rnd.choices(vocabulary, weights=[1 / (k + 1) for k in range(len(vocabulary))], k=rnd.randint(1, 80))) for _ in range(n)]
    rows = [*enumerate(texts), (5, texts[5]), (5, texts[6]), (7, texts[0]), (None, texts[1]), (None, texts[1]), (900, None), (901, ""), (902, "... --"), (903, "W1,w1;W2\tw3")]
    rnd.shuffle(rows)
    return rows


ITEMS = [(1, "w1 w2 W3"), (2, "w50 w51; w52 w1"), (2, "w4"), (3, None), (4, ""), (5, "nowhere"), (6, "É straße 日本"), (None, "w7 w7 w0"), (8, " ".join(f"w{i}" for i in range(60)))]


@pytest.mark.parametrize("bounds", [(1 << 17, 500_000), (40, 500_000), (1 << 17, 12)])
def test_search(spark, monkeypatch, bounds):
    """Whole, in many shards, and with items in blocks."""
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", bounds[0])
    rows = some_docs(random.Random(4))
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    items = clashing(spark.createDataFrame(ITEMS, "item_id long, text string"))
    got = [tuple(r) for r in lexical_search.lexical_search(docs, items, block_terms=bounds[1]).select("item_id", "rank", "doc_id", "score").collect()]
    assert Counter(got) == Counter(searched(rows, ITEMS))


def test_search_in_shards_of_a_worker():
    """The index function itself ends shards at its bound and ranks alike whatever the bound."""
    rows = some_docs(random.Random(9), 500)
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows])], ["doc_id", "text"])
    asked = np.unique(lexical_search.terms(pa.array(["w1 w2 w3"]))[0])
    shared = type("Shared", (), {"value": asked})
    whole = list(lexical_search._index(shared)(iter([batch])))
    assert len(whole) == 1 and sum(b["n_docs"][0].as_py() for b in whole) == sum(1 for _, t in rows if re.search(r"\w", t or ""))


def test_nra_equals_sums():
    rnd = np.random.default_rng(2)
    for _ in range(200):
        n, lists, total = int(rnd.integers(1, 60)), [], None
        total = np.zeros(n, np.int64)
        for _ in range(int(rnd.integers(1, 9))):
            docs = rnd.permutation(n)[: rnd.integers(1, n + 1)].astype(np.int32)
            impact = np.sort(rnd.integers(0, 20, len(docs)))[::-1].astype(np.int64)
            w = int(rnd.integers(0, 6))
            lists.append((w, docs, impact))
            total[docs] += w * impact
        found, score = lexical_search.best(lists, [15, 9, 4, 0], n, 5)
        assert (total[found] == score).all() and (score > 0).all()
        bar = max(np.sort(total)[-5] if n >= 5 else 1, 1)
        assert set(np.flatnonzero(total >= bar)) <= set(found.tolist())


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_search.lexical_search(none, items).count() == 0
    assert lexical_search.lexical_search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    one = lexical_search.lexical_search(spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string"), spark.createDataFrame([("i", "A")], "item_id string, text string"))
    assert [(r["item_id"], r["doc_id"]) for r in one.collect()] == [("i", 1)]


def test_search_long_text(spark):
    long = " ".join(f"t{i % 5000}" for i in range(700_000))
    rows = [(1, long), (2, "t1 t2 t3"), (3, "t1")]
    got = lexical_search.lexical_search(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, "t1 t2"), (2, long)], "item_id long, text string")).collect()
    assert Counter(tuple(r) for r in got) == Counter(searched(rows, [(1, "t1 t2"), (2, long)]))


# hard negatives


def test_products_are_exact():
    rnd = np.random.default_rng(0)
    for width, most in ((64, 160), (7, 3), (200, 1 << 15), (1, 1 << 28), (300, 1 << 26)):
        a, b = rnd.integers(-most, most + 1, (20, width)), rnd.integers(-most, most + 1, (30, width))
        a[0] = b[0] = most
        b[1] = -most
        moduli = hard_negatives.primes(width * most * most)
        got = hard_negatives.products(hard_negatives.residues(a, moduli), hard_negatives.residues(b, moduli), moduli)
        assert (got == a.astype(object) @ b.T.astype(object)).all()


def mined(rows, positives=5, negatives=3):
    good = [(i, c, [math.floor(256 * x) for x in v]) for i, v, c in rows if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, c, v in good:
        if i % 50:
            continue
        score = [(sum(a * b for a, b in zip(v, w)), j, d) for j, d, w in good if j != i]
        first = sorted((-s, j) for s, j, d in score if d == c)[:positives]
        for s, j in first:
            band = sorted((-t, k) for t, k, d in score if d != c and 50 * -s <= 100 * t <= 95 * -s)[:negatives]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(band)]
    return out


def vectors(rnd, n, width=9):
    centres = rnd.normal(size=(4, width))
    rows = []
    for i in range(n):
        label = int(rnd.integers(0, 4)) if i % 3 else 1
        v = (centres[label] + rnd.normal(size=width) + 0.7).astype(np.float32)
        rows.append((int(i), [float(x) for x in v], label))
    rows += [(rows[k][0], rows[k][1], rows[k][2]) for k in (3, 50, 77)]  # repeated rows, one an anchor
    rows += [(10_000 + k, rows[0][1], k % 4) for k in range(40)]  # ties
    rows += [(20_000, None, 1), (20_050, [float("nan")] * width, 1), (20_100, [float("inf")] + [0.0] * (width - 1), 2), (20_150, [None] + [0.5] * (width - 1), 2)]
    rows += [(None, rows[1][1], 1), (20_200, rows[1][1], None), (20_250, [], 3), (20_300, [1.0], 1), (-50, rows[2][1], 2), (20_350, [0.0] * width, 0), (20_400, rows[2][1], 77)]
    return rows


@pytest.mark.parametrize("blocks", [(256, 2048, 64, 32), (3, 20, 2, 4)])
def test_hard_negatives(spark, blocks):
    rows = vectors(np.random.default_rng(1), 260)
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).repartition(3)
    before = [getattr(hard_negatives, k) for k in ("ANCHOR_BLOCK", "ROW_BLOCK", "CELL_ANCHORS", "CELL_ROWS")]
    try:
        hard_negatives.ANCHOR_BLOCK, hard_negatives.ROW_BLOCK, hard_negatives.CELL_ANCHORS, hard_negatives.CELL_ROWS = blocks
        got = Counter(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 50 == 0).collect())
    finally:
        hard_negatives.ANCHOR_BLOCK, hard_negatives.ROW_BLOCK, hard_negatives.CELL_ANCHORS, hard_negatives.CELL_ROWS = before
    floats = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c) for i, v, c in rows]
    assert got == Counter(mined(floats)) and len(got) > 30


def test_hard_negatives_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.hard_negatives(none, F.col("vec_id") % 50 == 0).count() == 0
    alone = spark.createDataFrame([(0, [1.0], 1), (1, [0.6], 2)], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.hard_negatives(alone, F.col("vec_id") % 50 == 0).count() == 0
    with pytest.raises(ValueError):
        hard_negatives.hard_negatives(spark.createDataFrame([(0, [1e20], 1)], "vec_id long, embedding array<float>, label int"), F.col("vec_id") == 0)


# packing


def library_ids(texts):
    coder = packing.tokens("byte_bpe_50k.json")
    return [[*e.ids, 1] for e in coder.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_ids_are_the_librarys():
    rnd = random.Random(5)
    alphabet = [*"abcDE'st  \n\n\t 12.,-éñßŁ", "don't", " ", " ", "​", "“", "日本", "😀", "<|endoftext|>", "\x1c", "\r\n", "  ", "́", "　", "\xa0", "İ", "\x85", "\x0b", "\x0c", "﻿"]
    texts = ["".join(rnd.choice(alphabet[: 24 if k % 3 else None]) for _ in range(rnd.randint(0, 60))) for k in range(3000)] + [None, "", " ", "\n", " a", "a ", "ab" * 40_000]
    coder = packing.Tokens("byte_bpe_50k.json")
    for own in (texts, texts[::-1]):  # the second time out of the cache
        ids, first = coder.encode(pa.array(own))
        assert [[*ids[a:b].tolist(), 1] for a, b in zip(first, first[1:])] == library_ids(own)


def pieces_fit(rows, texts, window):
    """Each id in exactly one piece, sequences gapless, hashes right; all but powers of two are full. texts: by row."""
    ids = dict(zip(texts, library_ids(texts.values())))
    places, spans = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r["row"]]
        assert r["doc_tokens"] == len(own) and r["length"] > 0
        assert r["ids"] == np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        places[r["row"]].append((r["start"], r["length"]))
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    for row, own in ids.items():
        at = 0
        for start, length in sorted(places[row]):
            assert start == at
            at += length
        assert at == len(own)
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at == window or at < window and at & (at - 1) == 0
    return spans


def numbered(df):
    """Texts by the row numbers that packing gives them: tasks in order, rows in order."""
    out = {}
    for r in df.select(F.spark_partition_id().alias("p"), "text").collect():
        out[r["p"]] = [*out.get(r["p"], ()), r["text"]]
    return {(p << 33) + i: t for p, own in out.items() for i, t in enumerate(own)}


@pytest.mark.parametrize("shard", [1 << 22, 500])
def test_packing(spark, shard):
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice("river stone cloud meadow lantern copper velvet orchard".split()) + str(rnd.randint(0, 9)) for _ in range(rnd.randint(0, 90))) for _ in range(150)]
    rows = [*enumerate(texts), *[(500 + i, texts[0]) for i in range(60)], (7, texts[7]), (7, texts[8]), (None, texts[3]), (None, texts[3]), (900, None), (901, ""), (902, "<|endoftext|> a\xa0b"), (903, "word " * 3000)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).cache()
    got = packing.pack(df, window=128, shard_tokens=shard).collect()
    by_row = numbered(df)
    spans = pieces_fit(got, by_row, 128)
    total = sum(r["length"] for r in got)
    assert sum(1 for s in spans.values() if sum(x[1] for x in s) < 128) <= 7 * 4 and total == sum(map(len, library_ids(by_row.values())))
    again = packing.pack(df, window=128, shard_tokens=shard).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)
    op = packing.pack(df, window=128).select(F.crc32("ids").alias("c"), "ids").collect()
    assert all(r["c"] == zlib.crc32(r["ids"]) for r in op)


def test_neighbours_are_alike(spark):
    """Documents of one of six vocabularies meet in sequences far more often than by chance."""
    rnd = random.Random(3)
    subjects = [[f"{a}{b}" for b in ("lor", "man", "tek", "sun", "dap", "ril", "vos", "gin")] for a in ("Xa", "Yo", "Zi", "Qu", "Wre", "Kle")]
    rows = [(i, " ".join(rnd.choice(subjects[i % 6]) for _ in range(40))) for i in range(240)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), window=512).collect()
    by = defaultdict(Counter)
    for r in got:
        by[r["sequence_id"]][r["doc_id"] % 6] += r["length"]
    assert sum(max(c.values()) for c in by.values()) > 0.75 * sum(sum(c.values()) for c in by.values())


def test_best_unused_neighbour_fills():
    """The index against BM25 by its formula, for every seed in turn."""
    rnd = np.random.default_rng(6)
    rests = [[i, i, 0, rnd.integers(0, 30, rnd.integers(1, 40)).astype(np.uint16), 0] for i in range(50)]
    weight = rnd.random(31).astype(np.float32)
    shard = packing.Shard([list(r) for r in rests], weight, 20.0)
    for i in range(50):
        query = set(rests[i][3].tolist())
        want = [sum(weight[t] * (tf := (r[3] == t).sum()) * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(r[3]) / 20)) for t in query) for r in rests]
        assert np.allclose(shard.scores(i, 100), want, rtol=1e-4)
    first = shard.fill(64, 100)
    assert first[0][0] == 0 and sum(len(p[3]) for p in first) == 64
    order = np.argsort(-np.array(shard.scores(0, 100)))
    assert [p[0] for p in first[1:]] == [j for j in order.tolist() if j][: len(first) - 1]


def test_packing_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = packing.pack(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["start"], r["length"], r["doc_tokens"], r["offset"]) for r in one] == [(1, 0, 1, 1, 0)]
