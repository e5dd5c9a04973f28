"""Ranges of op5 where one passage stands in very many documents."""

import random

import numpy as np
from pyspark.sql import functions as F

from verdant.llm import substring_dedup


def places(ids, ths, begin, end):
    return {(i, t, p) for i, t, b, e in zip(ids, ths, begin, end) for p in range(b, e)}


def test_joined_ranges():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 40, 200):
        ids, ths, begin = rnd.integers(-3, 3, n), rnd.integers(-2, 2, n).astype(np.int32), rnd.integers(0, 60, n).astype(np.int32)
        end = begin + rnd.integers(1, 9, n).astype(np.int32)
        got = [x.tolist() for x in substring_dedup.joined_ranges(ids, ths, begin, end)]
        assert places(*got) == places(ids.tolist(), ths.tolist(), begin.tolist(), end.tolist())
        for a, b in zip(list(zip(*got)), list(zip(*got))[1:]):  # in order, and none touches the next
            assert a[:2] < b[:2] or a[:2] == b[:2] and a[3] < b[2]


def test_a_common_passage_makes_few_ranges(spark):
    """A row for each document and place, not for each window or super-k-mer of the passage."""
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(300)]
    rows = [(i, " ".join([word() for _ in range(20)] + passage + [word() for _ in range(20)])) for i in range(400)]
    ranges = substring_dedup.repeated_ranges(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = ranges.groupBy("__id").agg(F.count("*").alias("n"), F.min("begin").alias("begin"), F.max("end").alias("end")).collect()
    assert {(r["__id"], r["begin"], r["end"]) for r in got} == {(i, 20, 320) for i in range(400)}
    assert sum(r["n"] for r in got) <= 800
