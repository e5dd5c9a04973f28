"""What grows with the number of rows: draws of the bootstrap, and rows that one task sorts."""

import time

import numpy as np
from pyspark.sql import functions as F

from test_inference import plain_weight
from verdant.operators import bootstrap, responses, tasks


def test_weights_next_to_the_steps():
    """Draws whose upper bits do not decide, for numbers of items and replicates that fill no block."""
    rnd = np.random.default_rng(3)
    items, factors = rnd.integers(1, bootstrap.PRIME, 1003), rnd.integers(1, bootstrap.PRIME, 997)
    items[:2], factors[:2] = (1, bootstrap.PRIME - 1), (1, bootstrap.PRIME - 1)
    m = items[:, None] * factors % bootstrap.PRIME
    want = np.searchsorted(bootstrap.poisson_steps(), (m * m + 12345) % bootstrap.PRIME, "right")
    assert (bootstrap.weights(items, factors) == want).all()


def test_a_draw_is_one_multiplication():
    """Against bare multiplications of as many numbers on the same machine."""
    rnd = np.random.default_rng(4)
    items, factors, out = rnd.integers(1, bootstrap.PRIME, 512), bootstrap.replicate_factors(5000, 42), np.empty((512, 5000), np.uint8)
    some = np.empty((16, 5000), np.int64)

    def bare():
        for a in range(0, 512, 16):
            np.multiply(items[a : a + 16, None], factors, out=some)

    def best(f):
        took = []
        for _ in range(7):
            start = time.perf_counter()
            f()
            took.append(time.perf_counter() - start)
        return min(took)

    assert best(lambda: bootstrap.weights(items, factors, out)) < 16 * best(bare)


def test_rows_of_an_item_in_many_batches(spark):
    """Sums by the definition where batches cut items, with large, fractional and absent values."""
    rows = [(i, c, v) for i in range(9) for c in ("a", None, "b") for v in (1.0, 3e8, 0.25, None) for _ in range(1 + i % 2)]
    want = {}
    for i, c, v in rows:
        for r in range(11):
            w = plain_weight(i, r)
            n, s = want.get((c, r), (0, 0))
            want[c, r] = (n + w, s + w * (v or 0))
    df, size = spark.createDataFrame(rows, "item long, cell string, v double"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = bootstrap.replicate_sums(df, "item", ["cell"], {"n": F.lit(1), "s": F.col("v")}, 11).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert {(r["cell"], r["replicate"]): (r["n"], r["s"]) for r in got} == want


def test_no_item_is_gathered_in_one_row(spark):
    df = spark.range(100).select(F.col("id").alias("item"), F.lit("x").alias("cell"))
    plan = bootstrap.replicate_sums(df, "item", ["cell"], {"n": F.lit(1)}, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    """A task sorts no more rows of a larger table; the rows are the same."""
    monkeypatch.setattr(tasks, "ROWS_PER_TASK", 50)
    rows = spark.range(1200).select((F.col("id") % 400).alias("item"), F.col("id").alias("answer"))
    truth = spark.range(300).select(F.col("id").alias("item"), (F.col("id") * 2).alias("t"))
    out = responses.consolidate([rows.filter("answer < 600"), rows.filter("answer >= 600")], truth, "item", ["answer"])
    got = out.select("item", "extracted.answer", "ground_truth.t", F.spark_partition_id().alias("p")).collect()
    assert sorted((r["answer"], r["item"], r["t"]) for r in got) == [(a, a % 400, 2 * (a % 400) if a % 400 < 300 else None) for a in range(1200)]
    assert len({r["p"] for r in got}) > 12
    few = responses.consolidate([rows.filter("answer < 30")], truth, "item", ["answer"])
    assert few.count() == 30
