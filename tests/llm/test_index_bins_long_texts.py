"""Line index changes that fail, grow or find nothing; bins at the ends; long texts in linear time."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from verdant.llm import line_dedup, quality_gam, sanitise, token_counts, toxicity


def lines(spark, ids, text):
    return spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string")


def state(index):
    return {bytes(r["line"]): r["refs"] for r in index.refs.collect()}, index.members.count(), index.version


def test_failed_change_leaves_the_index(spark, monkeypatch):
    index = line_dedup.LineIndex(spark, min_docs=10)
    index.insert(lines(spark, range(6), "one\ntwo"))
    before, make = state(index), line_dedup.LineIndex._new_filters
    monkeypatch.setattr(line_dedup.LineIndex, "_new_filters", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.insert(lines(spark, range(6, 9), "one\nthree"))
    assert state(index) == before
    monkeypatch.setattr(line_dedup.LineIndex, "_new_filters", make)
    index.insert(lines(spark, range(6, 9), "one\nthree"))
    key = line_dedup.line_key
    assert state(index)[0] == {key(b"one"): 9, key(b"two"): 6, key(b"three"): 3} and index.frequent().count() == 0
    index.insert(lines(spark, [9], "ONE "))
    assert [bytes(r["line"]) for r in index.frequent().collect()] == [key(b"one")]
    index.delete(lines(spark, [0], "one\ntwo"))
    assert index.frequent().count() == 0 and index.dropped(lines(spark, [1], "one\ntwo")).count() == 0


def test_empty_index(spark):
    index = line_dedup.LineIndex(spark)
    docs = lines(spark, range(3), "a\nb")
    assert index.frequent().count() == 0 and index.dropped(docs).count() == 0
    index.delete(docs)
    out = line_dedup.dedup_lines(docs, ["doc_id"], False, index=index).collect()
    assert [r["__n_dropped"] for r in out] == [0, 0, 0]


def test_shards_grow(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "KEYS_A_SHARD", 4)
    monkeypatch.setattr(line_dedup, "LEAST_SHARDS", 1)
    index = line_dedup.LineIndex(spark, min_docs=2)
    index.insert(lines(spark, range(3), "a\nb"))
    assert index.shards == 1
    many = "\n".join(f"line {i}" for i in range(60))
    index.insert(lines(spark, range(10, 13), many))
    assert index.shards == 16
    lost = {r["__id"]: len(r["lines"]) for r in index.dropped(lines(spark, [0, 20], "a\nline 7\nline 59\nnew")).collect()}
    assert lost == {0: 3, 20: 3}


def test_repeated_keys_need_no_single_task(spark):
    """The filter of repeated rows is made from a written table, not in the task that follows the counts of all."""
    docs = lines(spark, [1, 1, 2, 2, 3], "x\ny")
    counts = {bytes(r["line"]): r["refs"] for r in line_dedup.reference_counts(docs).collect()}
    assert set(counts.values()) == {3}


def test_addresses_with_many_zeros():
    zeros = "1.2.3." + "0" * 5000 + "7"
    assert sanitise.base_spans(zeros)[1] == [(0, len(zeros))]
    assert sanitise.base_spans("1.2.3." + "0" * 5000 + "256")[1] == []
    assert sanitise.base_spans("00.0.000.0")[1] == [(0, 10)] and sanitise.base_spans("1.2.3." + "9" * 5000)[1] == []


def found(text):
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array([1], pa.int32()), pa.array([text])], ["doc_id", "__id", "__th", "text"])
    return next(iter(sanitise._find(4)(iter([batch])))).to_pylist()[0]


def test_neighbours_in_texts_with_many_spans(monkeypatch):
    rnd = random.Random(3)
    parts = ["a@b.cd", "10.0.0.1", "word", "x,y", " ", "  ", "\n", "token=abcdefgh", ",", "+12 345 678 901", "zebra"]
    for _ in range(300):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 40)))
        near = found(text)
        monkeypatch.setattr(sanitise, "MANY", -1)
        assert found(text) == near
        monkeypatch.undo()


@pytest.mark.parametrize("text", ["me@example.org " * 70_000, "me@example.org," * 70_000, "token=abcdefgh12345 " * 50_000, "aB3" * 350_000])
def test_sanitise_long(text):
    began = time.process_time()
    found(text)
    assert time.process_time() - began < 60


def test_token_pieces_of_long_runs():
    odd = "͸"
    assert odd in token_counts.uncertain()[1]
    for text in (odd + " " + "a" * 1_000_000, "a" * 500_000 + odd + "b" * 500_000, (odd + " ") * 200_000):
        began = time.process_time()
        assert "".join(token_counts.pieces(text)) == text
        assert time.process_time() - began < 30
    rnd = random.Random(4)
    for _ in range(500):
        text = "".join(rnd.choice(["a", " ", "\n", odd, "é", "12", ".", "  "]) for _ in range(rnd.randint(0, 20)))
        want = len(token_counts.library("byte_bpe_50k.json")[0].encode(text, add_special_tokens=False).ids)
        assert sum(token_counts.lengths("byte_bpe_50k.json", token_counts.pieces(text))) == want, repr(text)


def plainly_quoted(raw, i, reporting):
    line = " ".join(raw)
    begin = len(" ".join(raw[:i])) + (i > 0) + len(raw[i]) - len(raw[i].lstrip(toxicity.STRIP))
    end = begin + len(raw[i].strip(toxicity.STRIP))
    before = sum(c in toxicity.QUOTES for c in line[:begin])
    inside = before % 2 == 1 and any(c in toxicity.QUOTES for c in line[end:])
    return inside or any(toxicity.word_of(w) in reporting for w in raw[max(0, i - toxicity.CONTEXT) : i + toxicity.CONTEXT + 1])


def test_quotes_of_a_line():
    rnd = random.Random(5)
    words = ["said", "bad", '"bad"', '"bad', 'bad"', "“worse”", "x", 'a"b', ",", '"']
    for _ in range(1000):
        raw = [rnd.choice(words) for _ in range(rnd.randint(1, 25))]
        at = sorted(rnd.sample(range(len(raw)), rnd.randint(1, len(raw))))
        assert toxicity.quoted_words(raw, at, frozenset({"said"})) == [plainly_quoted(raw, i, {"said"}) for i in at]


def test_toxicity_long_line_and_no_cap():
    automaton = toxicity.Automaton(["horrid"])
    began = time.process_time()
    one = toxicity.hit_features('horrid " ' * 100_000, {}, automaton, frozenset())
    assert time.process_time() - began < 30 and one
    dense = [toxicity.hit_features("horrid " * n, {}, automaton, frozenset())[toxicity.FEATURES.index("dense")] for n in (10, 20, 30)]
    assert dense[0] < dense[1] and np.isclose(dense[2], np.log1p(min(30, toxicity.WINDOW)))


def test_bins_at_both_ends():
    rnd = np.random.default_rng(0)
    x = rnd.random((5000, 1))
    model = quality_gam.Additive(1).fit(x, (x[:, 0] > 0.97).astype(float))
    low, high, top = model.score(np.array([[0.92], [0.975], [0.995]]))
    assert low < 0.1 and high > 0.5 and top > 0.9
    assert len(model.edges[0]) <= quality_gam.BINS - 1 and model.edges[0][-1] > 0.99


def test_scores_are_sums_of_tables():
    """The vectorised score against additions row by row."""
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(800, 4))
    model = quality_gam.Additive(4).fit(x, (x[:, 0] * x[:, 1] + x[:, 2] > 0.3).astype(float))
    for row, score in zip(x[:100], model.score(x[:100])):
        codes = [int(np.searchsorted(e, v, "right")) for e, v in zip(model.edges, row)]
        total = model.base + sum(t[c] for t, c in zip(model.main, codes))
        total += sum(t[codes[i] * quality_gam.PAIR_BINS // quality_gam.BINS, codes[j] * quality_gam.PAIR_BINS // quality_gam.BINS] for i, j, t in model.pairs)
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-9
