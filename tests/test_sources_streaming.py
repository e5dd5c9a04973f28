import json
import random

import pytest
from pyspark.sql import types as T

from verdant.sources import files
from verdant.sources.arrays import read_elements
from verdant.streaming import responses

ROW = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])


def test_json_sources(spark, tmp_path):
    (tmp_path / "array.json").write_text(json.dumps([{"id": 1, "name": "a"}, {"id": 2, "name": None}]))
    assert files.read_json_array(spark, str(tmp_path / "array.json"), ROW, ["id"]).count() == 2
    with pytest.raises(Exception, match="other"):  # with the one pass that reads the rows
        files.read_json_array(spark, str(tmp_path / "array.json"), ROW, ["other"]).count()
    (tmp_path / "lacks.json").write_text(json.dumps([{"id": 1, "name": "a"}, {"id": 2}]))
    with pytest.raises(Exception, match="objects without name"):  # the field is in the schema, but not in the data
        files.read_json_array(spark, str(tmp_path / "lacks.json"), ROW, ["id", "name"]).count()
    for k, text in enumerate(["{\"id\": 1}", "[1, 2]", "not json"]):
        (tmp_path / f"bad{k}.json").write_text(text)
        with pytest.raises(ValueError, match="list of objects"):
            files.read_json_array(spark, str(tmp_path / f"bad{k}.json"), ROW, ["id"])
    (tmp_path / "none.json").write_text(" [] ")
    assert files.read_json_array(spark, str(tmp_path / "none.json"), ROW, ["id"]).count() == 0
    (tmp_path / "page.json").write_text(json.dumps({"totalResults": 2, "vulnerabilities": [{"cve": {"id": 3, "name": "c"}}, {"cve": {"id": 4, "name": "d"}}]}))
    assert sorted(r["id"] for r in files.read_feed_pages(spark, str(tmp_path / "page.json"), ROW).collect()) == [3, 4]
    (tmp_path / "keyed.json").write_text(json.dumps({"one": [{"id": 5, "name": "e"}], "two": [{"id": 6, "name": "f"}], "total_time": 1.5}))
    rows = files.read_keyed_arrays(spark, str(tmp_path / "keyed.json"), ROW)  # nobody lists the keys
    assert sorted((r["model"], r["id"], r["name"]) for r in rows.collect()) == [("one", 5, "e"), ("two", 6, "f")]
    assert [r["id"] for r in files.read_keyed_arrays(spark, str(tmp_path / "keyed.json"), ROW, ["two"]).collect()] == [6]


def test_json_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"id": 1, "name": "a"}\n\nnot json\n{"id": 2, "name": "b"}\n')
    good, bad = files.read_json_lines(spark, str(tmp_path / "log.jsonl"), ROW)
    assert sorted(r["id"] for r in good.collect()) == [1, 2] and [r["_bad"] for r in bad.collect()] == ["not json"]
    with pytest.raises(Exception):
        files.read_json_lines(spark, str(tmp_path / "log.jsonl"), ROW, strict=True)[0].collect()


def test_csv_and_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["a", "b"], None), (2, [], "True")], "id long, tags array<string>, ok string")
    files.write_csv(rows, str(tmp_path / "csv"))
    back = {r["id"]: r for r in files.read_csv(spark, str(tmp_path / "csv"), "id long, tags string, ok string", ["ok"]).collect()}
    assert back[1]["tags"] == "a; b" and back[1]["ok"] is None and back[2]["ok"] is True
    files.write_json(rows, str(tmp_path / "json"))
    lines = sorted(x for p in (tmp_path / "json").glob("part-*.json") for x in p.read_text().split("\n") if x)
    assert [json.loads(x) for x in lines] == [{"id": 1, "tags": ["a", "b"], "ok": None}, {"id": 2, "tags": [], "ok": "True"}]
    part = spark.createDataFrame([(1, "x"), (2, "y")], "id long, day string")
    files.replace_partitions(part, str(tmp_path / "table"), ["day"])
    files.replace_partitions(spark.createDataFrame([(3, "y")], "id long, day string"), str(tmp_path / "table"), ["day"])
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "table")).collect()) == [1, 3]
    files.append(part, str(tmp_path / "log"))
    files.append(part, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


def test_landing_responses(spark, tmp_path):
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("model", T.StringType()), T.StructField("at", T.TimestampType()), T.StructField("raw_response", T.StringType())])
    (tmp_path / "in").mkdir()
    lines = [{"item": i, "model": "m", "at": "2024-01-01T00:00:00Z", "raw_response": r} for i, r in [(1, "sorry"), (1, '{"k": 1}'), (1, '{"k": 1}'), (2, '{"k": 1}')]]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, lines)) + "\nbroken\n")
    rows = responses.landed(spark, str(tmp_path / "in"), schema)
    once = responses.valid_once(rows, ["item", "model"], "at", "1 day", ["k"], {})
    counts = responses.running_coverage(rows, ["model"], ["k"], {})
    for name, df, mode in (("once", once, "append"), ("counts", counts, "complete")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r["item"] for r in spark.table("once").collect()) == [1, 2]
    assert [(r["n_valid"], r["n_invalid"]) for r in spark.table("counts").collect()] == [(3, 1)]


AWKWARD = ["", "}", "{", "],[{", 'say "x"', "back\\slash", 'ends with "', "\\", '\\"}', "é日😀", "line\nfeed }, {", "[", "]"]


@pytest.mark.parametrize("style", [{"indent": 2}, {"separators": (",", ":")}])
@pytest.mark.parametrize("split", ["134217728b", "400b"])
def test_arrays_in_splits(spark, tmp_path, style, split):
    """Elements come out whole whatever the splits: braces in strings, escapes, nested values, several files, none at all."""
    rnd = random.Random(len(split) + len(style))
    rows = [{"id": i, "name": rnd.choice(AWKWARD) + rnd.choice(AWKWARD), "more": {"a": [rnd.choice(AWKWARD), {"b": {}}], rnd.choice(AWKWARD): []}} for i in range(60)]
    (tmp_path / "in").mkdir()
    for k, part in enumerate((rows[:40], rows[40:41], rows[41:], [])):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps(part, ensure_ascii=k % 2 > 0, **style) + "\n" * k)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        got = read_elements(spark, str(tmp_path / "in")).collect()
        assert sorted((json.loads(r["element"]) for r in got), key=lambda x: x["id"]) == rows
        again = files.read_json_array(spark, str(tmp_path / "in"), ROW, ["id", "more"])
        assert sorted((r["id"], r["name"]) for r in again.collect()) == [(x["id"], x["name"]) for x in rows]
        if split == "400b":
            assert again.rdd.getNumPartitions() > 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("text", ['[{"id": 1}, 3, {"id": 2}]', '[{"id": 1}', '[{"id": 1}]]', '[{"id": "x}]', '{"id": 1}', "[[]]", '[{"id": 1}] {"id": 2}', "[3]"])
def test_no_arrays_of_objects(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="list of objects"):
        files.read_json_array(spark, str(tmp_path / "x.json"), ROW, ["id"]).collect()


@pytest.mark.parametrize("split", ["134217728b", "300b"])
def test_pages_in_splits(spark, tmp_path, split):
    """Heads with nested values, braces in strings, pages without records, whatever ends the file."""
    rnd = random.Random(5)
    (tmp_path / "in").mkdir()
    want = []
    for k in range(4):
        rows = [] if k == 2 else [{"cve": {"id": 100 * k + i, "name": rnd.choice(AWKWARD), "deep": [{"vulnerabilities": [{"cve": 1}]}]}, "x": rnd.choice(AWKWARD)} for i in range(25)]
        page = {"totalResults": len(rows), "note": '}, "vulnerabilities": [{', "meta": {"a": {"b": [1, 2]}, "c": {}}, "vulnerabilities": rows, "format": "f}"}
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps(page, indent=k if k % 2 else None) + "\n" * (k % 3))
        want += [(r["cve"]["id"], r["cve"]["name"]) for r in rows]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        got = files.read_feed_pages(spark, str(tmp_path / "in"), ROW).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r["id"], r["name"]) for r in got) == sorted(want)


@pytest.mark.parametrize("text", ['[{"cve": {}}]', '{"other": [{"cve": {"id": 1}}]}', '{"vulnerabilities": [{"cve": {"id": 1}}], "other": [{"cve": {"id": 2}}]}', '{"vulnerabilities": [{"cve": {"id": 1}}'])
def test_no_pages(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="list of objects"):
        files.read_feed_pages(spark, str(tmp_path / "x.json"), ROW).collect()
