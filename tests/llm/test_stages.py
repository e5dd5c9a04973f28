"""The pipeline and its stages on nulls, repeated rows, ties, empty tables and clashing names; long texts."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from verdant.llm import decontaminate, line_dedup, mixture, ngram_join, quality_rules, sanitise, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["key", "cls", "n", "bucket", "lines", "n_lines", "kept_text", "comp", "token", "hash", "w", "size", "taken", "posterior", "kept", "line"]


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with null ids and sources, repeated rows, one id for two texts; a benchmark."""
    rnd = random.Random(1)
    a, b, c, leak = (prose(rnd, 120) for _ in range(4))
    near = a.split()
    near[60] = "zzzz"
    rows = [(1, a), (1, a), (5, a), (None, a), (None, b), (None, b), (7, c), (7, prose(rnd, 90)), (8, " ".join(near)), (9, leak + " tail"), (10, None), (None, None), (11, ""), (12, "#$% " * 60)]
    rows += [(100 + i, prose(rnd, 60) + "\nAll rights reserved.\n" + prose(rnd, 30)) for i in range(15)]
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(i, t, "en", None if k % 5 == 0 else f"s{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(rows)], SCHEMA)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(leak.split()[20:45])), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_stages_keep_rows_and_columns(spark, folder):
    plain = spark.read.parquet(f"{folder}/documents.parquet")
    docs = plain.withColumns({c: F.lit(c) for c in CLASHES})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes], name
        assert rows_of(out) == rows_of(stage(spark, plain, folder)), name
        assert set(rows_of(out.select("doc_id", *CLASHES, F.concat_ws(",", *CLASHES).alias("text")))) <= {(r["doc_id"], ",".join(CLASHES)) for r in plain.collect()}, name
    last = mixture.stage(spark, docs, folder)
    assert set(last.columns) == {*docs.columns, *mixture.MADE}


def test_quality_rules_keep_null_ids(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = rows_of(quality_rules.stage(spark, docs, folder))
    assert kept == rows_of(docs.filter("text is not null and text <> '' and (doc_id is null or doc_id <> 12)"))


def test_one_row_of_each_group_stays(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.filter("doc_id <> 7").collect()}
    kept = rows_of(ngram_join.stage(spark, docs, folder))
    assert kept.count((1, texts[1])) == 1 and not {(5, texts[1]), (None, texts[1]), (8, texts[8])} & set(kept)
    assert len([r for r in kept if r[0] is None and r[1]]) == 1 and len([r for r in kept if r[0] == 7]) == 2
    assert len([r for r in kept if not r[1]]) == 3
    ids = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect()}
    assert {(5, 116, 1), (None, 116, 1), (None, 116, None), (10, 0, 10), (None, 0, None), (7, 116, 7), (7, 86, 7)} <= ids


def test_lines_and_benchmark(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = line_dedup.stage(spark, docs, folder)
    assert out.count() == docs.count() and not any("All rights" in (r["text"] or "") for r in out.collect())
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect() if r["text"] is not None)
    clean = decontaminate.stage(spark, docs, folder)
    assert rows_of(clean) == rows_of(docs.filter("doc_id is null or doc_id <> 9"))


def test_whole_pipeline(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    rows = out.collect()
    assert {r["doc_id"] for r in rows} <= {1, 7, None, *range(100, 115)} and len(rows) >= 15
    assert all(r["text"] and 0 < r["taken"] <= 3 * r["size"] and "All rights" not in r["text"] for r in rows)
    assert len({r["text"] for r in rows}) == len(rows)


def test_empty_pipeline(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_of_one_id_and_null_ids(spark):
    rnd = random.Random(2)
    a, b = prose(rnd, 80), prose(rnd, 40)
    docs = spark.createDataFrame([(42, a), (None, None), (3, a + " " + b), (3, b), (3, "x"), (None, a), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeated(docs).collect()))
    assert got == [(0, 0, 0), (0, 0, 0), (0, 80, 80), (3, 1, 0), (3, 40, 40), (3, 120, 120), (42, 80, 80)]
    mail = spark.createDataFrame([(1, "write to zorba@mail.example.org now"), (1, "a"), (None, "call +1 (555) 010-9999"), (None, None)], "doc_id long, text string")
    for r in sanitise.sanitise(mail).collect():
        assert (r["n_spans"] == 0) == (r["spans"] == "")
    assert {"a", None} <= {r["text"] for r in sanitise.sanitised_texts(mail).collect()}


def test_long_texts(spark):
    """Five MB of words, and one word of three MB: whole, in bounded memory."""
    rnd = random.Random(3)
    base = [prose(rnd, 50) for _ in range(40)]
    long = " ".join(rnd.choice(base) + f" {i}" for i in range(18_000))
    docs = spark.createDataFrame([(1, long), (2, base[0] + " 99999999"), (3, "w" * 3_000_000)], "doc_id long, text string").withColumns({"source": F.lit("s"), "lang": F.lit("en"), "n_chars": F.length("text").cast("long")})
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeated(docs, keep_text=False).collect()}
    assert got[1]["n_words"] == len(long.split()) and got[1]["n_removed"] > 800_000 and got[2]["n_removed"] == 50 and got[3]["n_words"] == 1
    sizes = {r["doc_id"]: r["n_shingles"] for r in ngram_join.near_duplicates(docs).collect()}
    words = long.split()
    assert sizes[1] == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)}) and sizes[3] == 1
    assert quality_rules.quality_scores(docs).filter("doc_id = 1").first()["n_words"] == len(words)
