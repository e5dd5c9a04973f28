"""Poisson weights, tails and matching-block ratios against plain Python."""

import bisect
import difflib
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdant.operators import bootstrap, fuzzy, paired


def plain_weight(item, replicate, seed=42):
    """By the definition: md5 factors, one multiplication, one square, inverse distribution."""
    factor = lambda text: 1 + int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % (bootstrap.PRIME - 1)
    m = factor(f"{item}:{seed}") * factor(f"replicate {replicate}:{seed}") % bootstrap.PRIME
    return bisect.bisect_right(bootstrap.poisson_steps(), (m * m + 12345) % bootstrap.PRIME)


def test_weights_are_as_defined(spark):
    items = spark.createDataFrame([(i,) for i in range(60)], "item long")
    factors = [r["f"] for r in items.orderBy("item").select(bootstrap.item_factor(F.col("item"), 42).alias("f")).collect()]
    got = bootstrap.weights(np.array(factors), bootstrap.replicate_factors(50, 42))
    assert got.tolist() == [[plain_weight(i, r) for r in range(50)] for i in range(60)]


def test_weights_are_poisson():
    rnd = np.random.default_rng(0)
    w = bootstrap.weights(rnd.integers(1, bootstrap.PRIME, 4000), bootstrap.replicate_factors(500, 42)).astype(float)
    assert abs(w.mean() - 1) < 0.003 and abs(w.var() - 1) < 0.01
    share = np.bincount(w.astype(int).ravel(), minlength=4)[:4] / w.size
    assert np.allclose(share, [math.exp(-1) / math.factorial(k) for k in range(4)], atol=0.002)
    sums = (w * rnd.normal(size=(4000, 1))).sum(axis=0)  # items are independent: the sums vary as they should
    assert 0.8 < sums.var() / 4000 < 1.25


def test_intervals_are_those_of_resampling(spark):
    rnd = np.random.default_rng(5)
    ok = rnd.random(900) < 0.7
    rows = spark.createDataFrame([(i, bool(x)) for i, x in enumerate(ok)], "item long, ok boolean")
    got = bootstrap.accuracy_intervals(rows, "item", [], F.col("ok"), 2000).filter("metric = 'accuracy'").first()
    drawn = np.sort(rnd.multinomial(900, np.full(900, 1 / 900), 2000) @ ok / 900)
    assert abs(got["lo"] - drawn[50]) < 0.006 and abs(got["hi"] - drawn[1949]) < 0.006


def test_sums_by_hand(spark):
    """Cells, items without rows, null values and null items; any partitioning."""
    rows = [(i, c, None if i == 3 else float(i)) for i in range(30) for c in ("a", None) if (i + len(c or "")) % 5] + [(None, "a", 9.0)]
    df = spark.createDataFrame(rows, "item long, cell string, v double")
    want = {}
    for i, c, v in rows:
        for r in range(20):
            if i is not None:
                w = plain_weight(i, r)
                n, s = want.get((c, r), (0, 0))
                want[c, r] = (n + w, s + w * (v or 0))
    for parts in (1, 7):
        sums = bootstrap.replicate_sums(df.repartition(parts), "item", ["cell"], {"n": F.lit(1), "s": F.col("v")}, 20)
        assert {(r["cell"], r["replicate"]): (r["n"], r["s"]) for r in sums.collect()} == want


def test_classes_are_fixed(spark):
    """A class that is only predicted counts with 0, as does an absent one, and an absent category has a share of 0."""
    rows = spark.createDataFrame([(i, "x", "LOCAL", "LOCAL" if i % 2 else "PHYSICAL") for i in range(200)], "item long, cell string, truth string, seen string")
    classes = ["LOCAL", "PHYSICAL", "ADJACENT"]
    got = {r["metric"]: r for r in bootstrap.f1_intervals(rows, "item", ["cell"], F.col("truth"), F.col("seen"), classes, ["LOCAL", "PHYSICAL"], 400).collect()}
    assert set(got) == {"f1_LOCAL", "f1_PHYSICAL", "f1_ADJACENT", "macro_f1", "macro_f1_supported"}
    assert got["f1_PHYSICAL"]["hi"] == got["f1_ADJACENT"]["hi"] == 0
    assert math.isclose(got["macro_f1"]["lo"], got["f1_LOCAL"]["lo"] / 3) and math.isclose(got["macro_f1_supported"]["hi"], got["f1_LOCAL"]["hi"] / 2)
    shares = bootstrap.share_intervals(rows.withColumn("o", F.when(F.col("truth") == F.col("seen"), "Correct").otherwise("Incorrect")), "item", ["cell"], F.col("o"), ["Incorrect", "Declined"], replicates=200)
    by = {r["metric"]: (r["lo"], r["hi"]) for r in shares.collect()}
    assert by["share_Declined"] == (0, 0) and by["share_Incorrect"] == (1, 1)
    right = bootstrap.share_intervals(rows.withColumn("o", F.lit("Correct")), "item", ["cell"], F.col("o"), ["Incorrect"], replicates=200)
    assert {r["metric"]: (r["lo"], r["hi"]) for r in right.collect()} == {"accuracy": (1, 1), "share_Incorrect": (0, 0)}


def test_upper_index():
    """B1 and B5 take the value at int(0.975 R), the others the one before."""
    from pyspark.sql import SparkSession

    sums = SparkSession.getActiveSession().range(1000).select(F.col("id").alias("replicate"), F.col("id").cast("double").alias("v"))
    for exclusive, top in ((True, 974), (False, 975)):
        r = bootstrap.intervals(sums, [], {"v": F.col("v")}, 1000, upper_exclusive=exclusive).first()
        assert (r["lo"], r["hi"]) == (25, top)


def test_any_number_of_outcomes(spark):
    """120,000 items, all different: nothing is refused."""
    items = spark.range(120_000).select(F.col("id").alias("item"), (F.col("id") / 120_000).alias("m"))
    got = bootstrap.mean_intervals(items, "item", F.col("m"), 60).first()
    assert 0.495 < got["lo"] < got["hi"] < 0.505
    assert bootstrap.mean_intervals(items.limit(0), "item", F.col("m"), 60).count() == 0


@pytest.mark.parametrize("sql", [False, True])
def test_chi_tail(spark, sql):
    xs = [0.0, 1e-12, 0.001, 0.5, 1.0, 3.841, 3.9999999, 4.0, 4.0000001, 6.63, 10.0, 25.0, 50.0, 200.0, 1000.0]
    if sql:
        import duckdb

        got = [duckdb.sql(f"SELECT {paired.chi_tail_sql('x')} FROM (SELECT {x!r}::DOUBLE AS x)").fetchall()[0][0] for x in xs]
    else:
        got = [r["p"] for r in spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1).select(paired.chi_tail(F.col("x")).alias("p")).collect()]
    for x, p in zip(xs, got):
        assert math.isclose(p, math.erfc(math.sqrt(x / 2)), rel_tol=1e-9), x
    assert spark.sql("select cast(null as double) as x").select(paired.chi_tail(F.col("x"))).first()[0] is None


def test_published_p(spark):
    rows = spark.createDataFrame([(12, 42), (7, 18), (26, 26), (5, 1), (0, 0)], "b long, c long")
    got = [r["p"] for r in paired.mcnemar(rows).collect()]
    assert [round(p, 4) for p in got] == [0.0001, 0.0455, 0.8897, 0.2188, 1.0]


def altered(rnd, text, alphabet):
    own = list(text)
    for _ in range(rnd.randint(0, 5)):
        at = rnd.randint(0, len(own))
        kind = rnd.randint(0, 2)
        if kind == 0:
            own.insert(at, rnd.choice(alphabet))
        elif own and kind == 1:
            own.pop(at % len(own))
        elif own:
            own[at % len(own)] = rnd.choice(alphabet)
    return "".join(own)


def test_ratio_is_the_published_one(spark):
    rnd, pairs = random.Random(1), []
    for k in range(100_000):
        alphabet = "abcdeé日😀"[: rnd.randint(1, 8)]
        a = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 9)))
        pairs.append((a, altered(rnd, a, alphabet) if k % 2 else "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 9)))))
    pairs += [("kubernetes-dashboard", "kubernete_dashboards"), ("a" * 60, "a" * 59 + "b"), ("", ""), ("x", "")]
    pairs = sorted(set(pairs))
    df = spark.createDataFrame(pairs, "a string, b string").repartition(8)
    got = {(r["a"], r["b"]): r["r"] for r in df.select("a", "b", fuzzy.ratio(F.col("a"), F.col("b")).alias("r")).collect()}
    assert got == {p: difflib.SequenceMatcher(None, *p).ratio() for p in pairs}


def test_nothing_alike_is_missed(spark):
    rnd = random.Random(2)
    base = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(1, 12))) for _ in range(150)] + ["", "aa", "aaaaaaaaaa"]
    left = sorted({*base, *(altered(rnd, t, "abcxyz") for t in base)})
    right = sorted({*(altered(rnd, t, "abcxyz") for t in base), *base[:40], "", "aaaaaaaaab"})
    got = fuzzy.token_pairs(spark.createDataFrame([(t,) for t in [*left, None]], "t string"), spark.createDataFrame([(t,) for t in right], "t string"))
    want = {(a, b) for a in left for b in right if a == b or difflib.SequenceMatcher(None, a, b).ratio() >= 0.8}
    assert {(r["a"], r["b"]) for r in got.collect()} == want and len(want) > 100
