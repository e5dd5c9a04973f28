"""Numbering without one task, and inputs with gaps, by hand."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from verdant.operators import dataset, inventory, labels, responses, selection, verify


@pytest.mark.parametrize("case", ["mixed", "one key", "empty", "few"])
def test_numbered(spark, case):
    rnd = random.Random(7)
    rows = {"mixed": [(rnd.choice([None, 1, 2, rnd.randint(0, 10**6)]), i) for i in range(3000)], "one key": [(5, i) for i in range(1000)], "empty": [], "few": [(2, 1), (None, 0), (1, 2)]}[case]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "a long, b long").repartition(5)
    want = {r: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])))}
    for _ in range(2):
        got = inventory.numbered(df, ["a", "b"])
        assert {(r["a"], r["b"]): r["turn"] for r in got.collect()} == want
    part = inventory.numbered(df, ["a", "b"], span=lambda n: (n - 4, n))
    assert sorted(r["turn"] for r in part.collect()) == sorted(want.values())[-5:]
    sheet = inventory.blind_sheet(df, ["a", "b"], ["b"], 7).collect()
    assert sorted(r["item_id"] for r in sheet) == [f"VT-{k + 1:03d}" for k in range(min(7, len(rows)))]


def test_numbering_sorts_no_single_partition(spark):
    df = spark.range(2000).select(F.col("id").alias("a"))
    plan = inventory.numbered(df, ["a"])._jdf.queryExecution().executedPlan().toString()
    assert "Window [row_number()" in plan and "_range" in plan.split("Window [row_number()")[1].split("\n")[0]


def test_absent_lists(spark):
    schema = "id int, weaknesses array<struct<description:array<struct<lang:string,value:string>>>>, configurations array<struct<nodes:array<struct<cpeMatch:array<struct<vulnerable:boolean,criteria:string>>>>>>, affected array<struct<affectedData:array<struct<vendor:string,product:string>>>>"
    cpe = "cpe:2.3:a:acme:my_app:1"
    match = {"cpeMatch": [{"vulnerable": True, "criteria": cpe}, {"vulnerable": True, "criteria": None}]}
    rows = [
        (1, [{"description": None}, {"description": [{"lang": "en", "value": "CWE-79"}]}], [{"nodes": None}, {"nodes": [{"cpeMatch": None}, match]}], None),
        (2, None, None, [{"affectedData": None}, {"affectedData": [{"vendor": "v", "product": None}]}]),
        (3, [], [{"nodes": []}], None),
    ]
    df = spark.createDataFrame(rows, schema).select("id", inventory.first_weakness().alias("w"), dataset.affected_components().alias("a"))
    got = {r["id"]: (r["w"], r["a"].asDict()) for r in df.collect()}
    assert got[1] == ("CWE-79", {"source": "cpe", "components": ["acme my app"], "raw_cpes": [cpe]})
    assert got[2] == (None, {"source": "affected", "components": ["v"], "raw_cpes": []})
    assert got[3] == (None, {"source": "affected", "components": [], "raw_cpes": []})


def test_unpriced_systems(spark):
    rows = spark.createDataFrame([("a", 1.0, 10, 1), ("a", None, None, None), ("b", 2.0, 5, 5), ("c", 1.0, None, None)], "model string, latency double, tokens_in long, tokens_out long")
    prices = spark.createDataFrame([("a", 2.0, 4.0), ("c", 1.0, 1.0)], "model string, price_in double, price_out double")
    got = {r["model"]: r for r in responses.latency_and_cost(rows, prices, items=500).collect()}
    assert set(got) == {"a", "b", "c"} and got["b"]["cost"] == 0 and got["b"]["projected"] == 0
    assert got["a"]["n"] == 2 and got["a"]["mean_latency"] == 1.0 and abs(got["a"]["projected"] - 24e-6 * 500) < 1e-12
    assert got["c"]["cost"] == 0 and got["c"]["projected"] is None


def test_null_stratum(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else "x" if i % 3 == 1 else "y") for i in range(90)], "id long, s string")
    got = dataset.stratified_sample(rows, ["s"], "id", 30, 1).groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in got} == {None: 10, "x": 10, "y": 10}


@pytest.mark.parametrize("target", [1, 9, 10, 11, 60, 500])
def test_latest_days_only(spark, tmp_path, target):
    """Of a table in day partitions only the days of the needed slices are read."""
    anchor = date(2024, 3, 1)
    rows = [(i, anchor - timedelta(days=i % 40)) for i in range(200)]
    spark.createDataFrame(rows, "id long, day date").write.partitionBy("day").parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    got = selection.latest(table, "day", anchor, dataset.slice_number, ["id"], target)
    number = lambda back: 0 if back <= 2 else -(-back // 2) - 1
    want = sorted((number((anchor - d).days), i) for i, d in rows)[:target]
    assert sorted((r["slice"], r["id"]) for r in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and ">=" in plan
    last = want[-1][0]
    oldest = max(b for b in range(40) if number(b) <= last)
    assert len(got.inputFiles()) == len(table.inputFiles())  # as planned; what is read follows the filter
    read = table.filter(f"day >= date'{anchor - timedelta(days=oldest)}'")
    ends = selection.cut_off(selection.day_counts(table, "day"), dataset.slice_number(F.date_diff(F.lit(anchor), "day")), target)
    assert ends == (anchor - timedelta(days=oldest), anchor) and read.count() >= len(want)


def test_latest_of_nothing(spark):
    none = spark.createDataFrame([], "id long, day date")
    assert selection.latest(none, "day", date(2024, 1, 1), dataset.slice_number, ["id"], 5).count() == 0


def test_watched_rows(spark):
    rows = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "id int, v string")
    own = verify.Watched(rows, {"v is given": F.col("v").isNotNull(), "v is x or z": F.col("v").isin("x", "z"), "ids": F.col("id") > 0})
    assert own.rows.count() == 3 and own.broken() == {"v is given": 1, "v is x or z": 1}
    with pytest.raises(ValueError, match="1 rows break: v is given"):
        own.raise_broken()
    fine = verify.Watched(rows, {"ids": F.col("id") > 0})
    fine.rows.collect()
    fine.raise_broken()


def test_layer_totals(spark):
    rows = spark.createDataFrame([("a", "correct"), ("a", "different_pillar"), ("b", "correct"), ("b", "something else"), ("c", None)], "cell string, verdict string")
    got = {r["cell"]: (r["n"], r["correct"], r["incorrect"], r["categorised"], r["balanced"]) for r in labels.layer_totals(rows, ["cell"]).collect()}
    assert got == {"a": (2, 1, 1, 1, True), "b": (2, 1, 1, 0, False), "c": (1, 0, 1, 0, False)}
