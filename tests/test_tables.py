"""Versioned tables, and streams that are killed and started again."""

import json
import shutil

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdant.sources.tables import Conflict, Table
from verdant.streaming import tables as streams


def rows(spark, ids, value="x"):
    return spark.createDataFrame([(i, value) for i in ids], "id long, v string")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_versions(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"))
    assert table.version() == 0 and table.read() is None and table.vacuum() == []
    table.replace(rows(spark, range(3)))
    table.append(rows(spark, [7]))
    old = table.read()
    table.replace(rows(spark, [9]), marks={"made by": "test"})
    assert ids(table.read()) == [9] and ids(old) == [0, 1, 2, 7] and ids(table.read(1)) == [0, 1, 2]
    assert table.mark("made by") == "test" and table.versions() == [1, 2, 3]
    table.replace(table.read().union(rows(spark, [10])))  # made from what it replaces
    assert ids(table.read()) == [9, 10] and table.mark("made by") == "test"
    assert table.vacuum(keep=2) == []  # within the grace
    gone = table.vacuum(keep=1, grace_seconds=-60)
    assert len(gone) == 3 and ids(table.read()) == [9, 10] and table.versions() == [4]
    table.replace(rows(spark, []))
    assert ids(table.read()) == []
    with pytest.raises(ValueError):
        table.append(spark.createDataFrame([(1,)], "other int"))


def test_two_writers(spark, tmp_path):
    """Both start from one version; the second to finish changes nothing and can repeat."""
    one, two = Table(spark, str(tmp_path / "t")), Table(spark, str(tmp_path / "t"))
    one.replace(rows(spark, [1]))
    base = two.version()
    one.append(rows(spark, [2]), base)
    with pytest.raises(Conflict):
        two.append(rows(spark, [3]), base)
    assert ids(two.read()) == [1, 2] and two.version() == 2
    two.append(rows(spark, [3]))
    assert ids(one.read()) == [1, 2, 3]


@pytest.mark.parametrize("step", ["_stage", "_commit"])
def test_killed_writer(spark, tmp_path, monkeypatch, step):
    table = Table(spark, str(tmp_path / "t"))
    table.replace(rows(spark, [1]))
    whole = getattr(Table, step)

    def dies(self, *args):
        if step == "_stage":
            whole(self, *args)  # the data is there, the entry is not
        raise KeyboardInterrupt

    monkeypatch.setattr(Table, step, dies)
    with pytest.raises(KeyboardInterrupt):
        table.replace(rows(spark, [2, 3]))
    monkeypatch.undo()
    assert ids(Table(spark, str(tmp_path / "t")).read()) == [1]
    table.replace(rows(spark, [4]))
    assert ids(table.read()) == [4] and len(table.vacuum(grace_seconds=-60)) == 2


def test_upsert(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"))
    make = lambda data: spark.createDataFrame(data, "a string, b int, n long")
    table.upsert(make([("x", 1, 1), (None, 2, 2)]), ["a", "b"])
    table.upsert(make([(None, 2, 5), ("y", None, 6)]), ["a", "b"])
    assert {(r["a"], r["b"]): r["n"] for r in table.read().collect()} == {("x", 1): 1, (None, 2): 5, ("y", None): 6}


SCHEMA = T.StructType([T.StructField("item", T.LongType()), T.StructField("model", T.StringType()), T.StructField("at", T.TimestampType()), T.StructField("raw_response", T.StringType())])


def land(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(dict(zip(SCHEMA.names, x))) for x in lines) + "\n")


def batches():
    ok, t = '{"k": "a"}', "2024-01-01T00:00:0"
    return [
        [(1, "m", t + "1Z", ok), (1, "m", t + "0Z", ok), (2, "m", t + "0Z", "sorry"), "broken", ""],
        [(1, "m", t + "0Z", ok), (3, "m", t + "2Z", ok), (None, "m", t + "0Z", ok), (4, "m", t + "0Z", '{"k": "z"}'), "[1]"],
        [(2, "m", t + "9Z", ok), (None, "m", t + "1Z", ok), (5, None, t + "1Z", ok), (5, None, t + "1Z", ok)],
    ]


def started(spark, tmp_path, take, files=1):
    lines = streams.landed_lines(spark, str(tmp_path / "in"), files)
    return lines.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()


@pytest.mark.parametrize("dies", ["before", "between", "after", "never"])
def test_stream_is_killed_and_started_again(spark, tmp_path, dies):
    """Whatever died, both tables hold what one batch over the files gives."""
    good, bad = Table(spark, str(tmp_path / "good")), Table(spark, str(tmp_path / "bad"))
    make = lambda g, b: streams.keep_once(g, b, "responses", SCHEMA, "raw_response", ["item", "model"], ["at"], ["k"], {"k": ["a", "b"]})
    take = make(good, bad)

    class Dying(Table):
        def append(self, *args, **kw):
            if self.version() == 1:
                raise RuntimeError("killed between the tables")
            return super().append(*args, **kw)

    half = make(good, Dying(spark, str(tmp_path / "bad")))

    def killed(lines, batch):
        if batch == 1 and dies == "before":
            raise RuntimeError("killed before")
        (half if dies == "between" else take)(lines, batch)
        if batch == 1 and dies == "after":
            raise RuntimeError("killed after both tables, before the stream's own commit")

    for k, lines in enumerate(batches()[:2]):
        land(tmp_path / "in", f"{k}.json", lines)
    query = started(spark, tmp_path, killed)
    if dies == "never":
        query.awaitTermination(120)
    else:
        with pytest.raises(Exception, match="killed"):
            query.awaitTermination(120)
    land(tmp_path / "in", "2.json", batches()[2])
    started(spark, tmp_path, take).awaitTermination(120)
    started(spark, tmp_path, take).awaitTermination(120)  # nothing new
    assert good.mark("responses") == bad.mark("responses") == 2
    got = [(r["item"], r["model"], r["at"].second, r["k"]) for r in good.read().collect()]
    assert sorted(got, key=str) == sorted([(1, "m", 0, "a"), (3, "m", 2, "a"), (None, "m", 0, "a"), (2, "m", 9, "a"), (5, None, 1, "a")], key=str)
    lost = [(r["file"].rsplit("/", 1)[1], r["reason"]) for r in bad.read().collect()]
    assert sorted(lost) == [("0.json", "not a JSON object"), ("0.json", "not a JSON object"), ("1.json", "bad value: k"), ("1.json", "not a JSON object")]
    assert {r["line"] for r in bad.read().collect()} >= {"broken", "[1]"}


def test_coverage_in_update_mode(spark, tmp_path):
    table = Table(spark, str(tmp_path / "coverage"))
    take, sizes = streams.upsert_into(table, "coverage", ["model"]), []

    def seen(df, batch):
        take(df, batch)
        sizes.append(df.count())
        if batch == 1 and len(sizes) == 2:
            raise RuntimeError("killed")

    for k, lines in enumerate(batches()):
        land(tmp_path / "in", f"{k}.json", lines)
    for tries in range(2):
        lines = streams.landed_lines(spark, str(tmp_path / "in"), 1)
        counts = streams.coverage_counts(lines, SCHEMA, "raw_response", ["model"], ["k"], {"k": ["a", "b"]})
        query = counts.writeStream.outputMode("update").foreachBatch(seen).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        if tries:
            query.awaitTermination(120)
        else:
            with pytest.raises(Exception, match="killed"):
                query.awaitTermination(120)
    want = spark.read.text(str(tmp_path / "in")).select(F.col("value").alias("line"), F.lit("f").alias("file"))
    whole = streams.coverage_counts(want, SCHEMA, "raw_response", ["model"], ["k"], {"k": ["a", "b"]})
    as_dict = lambda df: {r["model"]: (r["n_valid"], r["n_invalid"]) for r in df.collect()}
    assert as_dict(table.read()) == as_dict(whole) == {"m": (7, 2), None: (2, 2)}
    assert table.mark("coverage") == 2
    shutil.rmtree(tmp_path / "in")
