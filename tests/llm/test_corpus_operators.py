"""Every operator on small tables with nulls, empty texts, repeated rows, ties and extra columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verdant.llm import _text as tx
from verdant.llm import decontaminate, line_dedup, mixture, ngram_join, quality_gam, quality_rules, sanitise, substring_dedup, token_counts, toxicity


def corpus(n=120, seed=3):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 160))) for _ in range(n)]
    texts[5:9] = [texts[0]] * 4
    for i in range(10, 40):  # near copies of one text, each with few words changed
        own = texts[1].split()
        own[rnd.randrange(len(own))] = f"x{i}"
        texts[i] = "\n".join([" ".join(own), "All rights reserved.", str(i)])
    texts[41] = "Again " * 90
    return [*((i, t) for i, t in enumerate(texts)), (900, None), (901, ""), (902, " \t\n "), (903, "é" * 5000), (904, "one two")]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("s"), F.col("doc_id") % 5))).withColumn("n_chars", F.length("text").cast("long"))
    clash = {"key": F.lit(1), "cls": F.lit("x"), "n": F.lit(2.5), "bucket": F.lit(1), "lines": F.lit("l"), "n_lines": F.lit(1), "kept_text": F.lit("k"), "comp": F.lit(1), "n_words": F.lit(1), "size": F.lit(1), "posterior": F.lit(0.5)}
    return df.withColumns(clash) if extra else df


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).cache()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert quality_rules.quality_scores(none).count() == 0
    assert substring_dedup.remove_repeated(none).count() == 0
    assert line_dedup.dedup_lines(none, ["doc_id"], False).count() == 0
    assert mixture.mix_sources(none).count() == 0
    assert decontaminate.contamination(none, bench).count() == 0
    assert ngram_join.near_duplicates(none).count() == 0
    assert token_counts.token_counts(none).count() == 0
    assert sanitise.sanitise(none).count() == 0
    assert quality_gam.quality_classifier(none, labels).count() == 0
    assert toxicity.toxicity_scores(none, labels).count() == 0


def test_near_duplicates(docs):
    sets = {}
    for i, t in corpus():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = [(i, j) for i in sets for j in sets if i < j and (both := len(sets[i] & sets[j])) and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both)]
    best, before = {i: i for i in sets}, None
    while best != before:
        before = dict(best)
        for i, j in links:
            best[i] = best[j] = min(best[i], best[j])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == {i: (len(sets[i]), best[i]) for i in sets}


def test_substrings(docs):
    words = {i: (t or "").encode().split() for i, t in corpus()}
    counts = Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    got = by_id(substring_dedup.remove_repeated(docs))
    for i, w in words.items():
        hit = {k + j for k in range(len(w) - 34) if counts[tuple(w[k : k + 35])] > 1 for j in range(35)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in hit)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), len(hit), hashlib.sha256(kept).hexdigest())


def index_state(index):
    return sorted(map(tuple, index.refs.collect())), sorted(map(tuple, index.members.collect())), {bytes(r["line"]) for r in index.frequent().collect()}


def test_lines_and_their_undoing(spark, docs):
    got = by_id(line_dedup.dedup_lines(docs, ["doc_id"], True))
    assert got[12]["__n_dropped"] == 1 and "All rights reserved." not in got[12]["__kept_text"]
    assert (got[900]["__n_lines"], got[901]["__n_lines"], got[900]["__n_dropped"]) == (1, 1, 0) and got[900]["__kept_text"] is None
    index = line_dedup.LineIndex(spark)
    index.insert(docs.filter("doc_id < 15"))
    first = index_state(index)
    assert first[2] == set()
    index.insert(docs)  # those under 15 are members already
    whole = index_state(index)
    assert len(whole[2]) == 1 and sum(len(r["filter"]) for r in index.filters.collect()) > 0
    sharded = index.dropped(docs, most_filter_bytes=0, salts=3)
    assert sorted(map(str, sharded.collect())) == sorted(map(str, index.dropped(docs).collect())) and sharded.count() == 30
    index.delete(docs.filter("doc_id >= 15"))
    assert index_state(index) == first and index.dropped(docs).count() == 0
    index.delete(docs.filter("doc_id >= 15"))  # no members any more
    index.insert(docs.filter("doc_id >= 15"))
    assert index_state(index) == whole


def test_cuckoo_filter():
    keys = line_dedup.digests([hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(6000)])
    own = line_dedup.build_filter(keys[:3000])
    assert own.has(keys[:3000]).all() and own.has(keys[3000:]).mean() < 0.01
    own.delete(keys[:1500])
    assert own.has(keys[:1500]).mean() < 0.01 and own.has(keys[1500:3000]).all()
    own.insert(keys[:1500])
    back = line_dedup.CuckooFilter.from_bytes(own.to_bytes())
    assert back.has(keys[:3000]).all()
    parts = line_dedup.shard_of(keys, 3)
    three = line_dedup.Filters({s: line_dedup.build_filter(keys[parts == s]).to_bytes() for s in range(2)}, 3)
    assert three.has(keys[parts < 2]).all() and not three.has(keys[parts == 2]).any()


def test_decontamination(spark, docs):
    texts = dict(corpus())
    bench = spark.createDataFrame([(1, " ".join(texts[3].split()[:30])), (2, "ONE, two"), (3, None), (4, "!!!"), (10, " ".join(texts[3].split()[:12]))], "item_id long, text string")
    got = {r["__id"]: r for r in decontaminate.contamination(docs, bench).filter("__id < 905").collect()}
    assert len(texts[3].split()) >= 30 and got[3]["items"] == ["1", "10"] and len(got[3]["hit_at"]) == 30
    assert got[904]["hit_at"] == [0, 1] and got[900]["n_words"] == 0 and got[50]["hit_at"] == []


def test_mixture(docs):
    rows = mixture.mix_sources(docs, docs_per_bucket=7).collect()
    whole = mixture.mix_sources(docs).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in whole)
    sums, target = Counter(), {}
    for r in rows:
        sums[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert all(abs(sums[s] - target[s]) <= 1 for s in target)
    assert abs(sum(target.values()) - sum(r["size"] for r in rows)) < 1e-6


def test_quality_rules(docs):
    got = by_id(quality_rules.quality_scores(docs))
    assert got[900]["base_failed"] and not got[900]["kept"] and got[41]["n_repeat_words"] == 90 and got[41]["base_failed"]
    assert got[903]["n_words"] == 1 and got[903]["word_chars"] == 5000


def test_token_counts(spark, docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(token_counts.vocabulary())
    got = by_id(token_counts.token_counts(docs))
    for i, t in corpus():
        assert got[i]["n_tokens"] == len(own.encode(t or "", add_special_tokens=False).ids) and got[i]["n_bytes"] == len((t or "").encode())


def test_sanitise(spark):
    rows = [(i, f"contact Zorba the keeper at zorba@mail.example.org today {i}") for i in range(6)] + [(i, f"plain text the {i}") for i in range(10, 60)] + [(90, "card 4111 1111 1111 1111 ip 10.0.0.300 and 10.0.0.3 tel +1 (555) 010-9999"), (91, None), (91, "")]
    got = by_id(sanitise.sanitise(frame(spark, rows)))
    assert got[0]["n_email"] == 1 and ",term:" in got[0]["spans"] and got[91]["spans"] == ""
    assert (got[90]["n_card"], got[90]["n_ip"], got[90]["n_phone"]) == (1, 1, 1)
    texts = {r["doc_id"]: r["text"] for r in sanitise.sanitised_texts(frame(spark, rows)).collect()}
    assert "[email]" in texts[0] and "Zorba" not in texts[0]


def test_quality_classifier(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(["tree", "river", "of", "and"]) + ("%%%" if i % 3 == 0 else "") for _ in range(40))) for i in range(300)] + [(900, None), (901, "")]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = by_id(quality_gam.quality_classifier(frame(spark, rows), labels))
    assert sum((got[i]["score"] >= 0.3) == (i % 3 != 0) for i in range(300)) >= 297 and 0 <= got[900]["score"] <= 1


def test_toxicity(spark):
    rnd = random.Random(6)
    words = [f"word{i}" for i in range(300)]
    rows = [(i, " ".join([*(rnd.choice(words) for _ in range(20)), *(["blockhead", "you"] if i % 4 == 0 else [])])) for i in range(400)] + [(900, None), (901, "you blockhaed")]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    got = by_id(toxicity.toxicity_scores(frame(spark, rows), labels))
    assert all((got[i]["score"] >= 0.7) == (i % 4 == 0) for i in range(400)) and got[900]["score"] < 0.5
    own = toxicity.Automaton(["blockhead", "clown", "lowei*"])
    assert [own.distance(w) for w in ("blockhead", "blockhaed", "clwn", "clown", "clean", "loweiheit")] == [0, 2, 1, 0, -1, 0]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_against_plain_distances():
    rnd = random.Random(8)
    terms = ["".join(rnd.choice("abc") for _ in range(rnd.randint(3, 10))) for _ in range(25)]
    own = toxicity.Automaton(terms)
    for _ in range(3000):
        word = "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 12)))
        fits = [d for t in terms if (d := levenshtein(word, t)) <= (0 if len(t) < 5 else 1 if len(t) < 8 else 2)]
        assert own.distance(word) == min(fits, default=-1), word


@pytest.mark.parametrize(
    "text,plain,quoted",
    [("you idiot go", 1, 0), ('he wrote "idiot" there', 0, 1), ('the "idiot" there', 0, 1), ("le «idiot» là", 0, 1), ('"a" idiot "b" c', 1, 0), ("er sagte du Idiot", 0, 1), ('an open " mark, idiot', 1, 0), ("IDIOT!!!", 1, 0)],
)
def test_quotation_and_abuse(text, plain, quoted):
    own = toxicity.hit_features(text, {}, toxicity.Automaton(["idiot"]), toxicity.reporting_words())
    got = dict(zip(toxicity.FEATURES, own))
    assert (round(np.expm1(got["exact"])), round(np.expm1(got["quoted"]))) == (plain, quoted)
    assert (got["dense"] > 0) == (got["rate"] > 0) == bool(plain)


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def valid(kind, found):
    digits = [int(c) for c in found if c.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def test_base_spans_against_plain_patterns():
    rnd = random.Random(9)
    alphabets = ["a.@-1 ", "12.5@ ", "0123456789 -", "+1(2) .-9", "é@b.c1", "4111 -"]
    for _ in range(20_000):
        text = "".join(rnd.choice(rnd.choice(alphabets)) for _ in range(rnd.randint(0, 60)))
        assert sanitise.base_spans(text) == [[m.span() for m in p.finditer(text) if valid(k, m[0])] for k, p in BASE.items()], text


def plain_terms(texts, context=4, disclosure=0.8):
    """Spans of disclosing terms by text, from counts of pairs of a term and an address."""
    words = [[(m[0], *m.span()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)] for t in texts]
    plain = [{sanitise.term(w) for w, _, _ in own} for own in words]
    near = [{(own[at][0], sanitise.term(w), a, b) for at in range(len(own)) if "@" in own[at][0] for w, a, b in own[max(0, at - context) : at + context + 1] if "@" not in w} for own in words]
    n, entities, together = len(texts), Counter(), Counter()
    for own in near:
        entities.update({e for e, *_ in own})
        together.update({(e, t) for e, t, _, _ in own})
    terms = Counter(t for own in plain for t in own)
    reveals = {(e, t) for (e, t), k in together.items() if np.log2(n * k / (terms[t] * entities[e])) >= disclosure * np.log2(n / entities[e])}
    return [[f"term:{a}:{b}" for a, b in sorted({(a, b) for e, t, a, b in own if (e, t) in reveals})] for own in near]


def test_terms_against_plain_counts(spark):
    rnd = random.Random(17)
    vocabulary = [f"w{i}\xa0x" if i % 9 == 4 else f"w{i}" for i in range(9000)]
    texts = []
    for i in range(487):
        own = [vocabulary[int(9000 * rnd.random() ** 2)] for _ in range(rnd.randint(12, 60))]
        if i % 3 == 0:
            own.insert(rnd.randrange(len(own)), f"p{rnd.randrange(90)}@mail.org")
        texts.append(" ".join(own))
    got = {r["doc_id"]: [x for x in r["spans"].split(",") if x.startswith("term:")] for r in sanitise.sanitise(frame(spark, list(enumerate(texts)))).collect()}
    want = plain_terms(texts)
    assert sum(map(len, want)) > 100 and any("\xa0" in texts[i][int(a) : int(b)] for i, own in enumerate(want) for _, a, b in (x.split(":") for x in own))
    assert got == dict(enumerate(want))


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_quality_counts_against_plain_ones():
    rnd = random.Random(10)
    texts = ["".join(rnd.choice(("a", "b", "é", " ", " ", "\n", "#", "\x0b")) for _ in range(rnd.randint(0, 200))) for _ in range(500)] + ["", "x " * 40, "long" * 300 + "\n" + "long" * 300]
    made = quality_rules.text_features(pa.array(texts))
    for i, text in enumerate(texts):
        assert tuple(int(made[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == plain_counts(text), text


def test_hashes_of_texts_that_sums_of_powers_confuse():
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, two = (bytes(97 + (b ^ x) for b in bits) for x in (0, 1))
    h = tx.range_hashes(np.frombuffer(one + two, np.uint8), np.array([0, 1024]), np.array([1024, 2048]))
    assert h[0] != h[1]
    grams, first = ngram_join.shingle_sets(pa.array([" ".join("ab"[b ^ x] + "cd"[b] for b in bits) for x in (0, 1)]))
    assert len(set(tx.set_hashes(grams, first).tolist())) == 2


def test_parity_bitmaps_never_exceed_the_difference():
    rnd = np.random.default_rng(11)
    for _ in range(200):
        both, a, b = (np.unique(rnd.integers(0, 2**63, rnd.integers(0, 300)).astype(np.uint64)) for _ in range(3))
        sets = [np.union1d(both, a), np.union1d(both, b)]
        x, y = ngram_join.parity_bitmaps(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
        assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(*sets))


def test_tokens_of_other_scripts():
    lib, special = token_counts.library("byte_bpe_50k.json")
    rnd = random.Random(12)
    pools = [list("abcXYZ 0189.,;'\"-  \n\t"), list("“”‘’—…€«» абвгЖ 中文字 日本テ한국 ñéü ٠١ अआ"), list("😀🎉👍🏽‍🤖🫠  \n ᲀᲅ 𞤀 ꙮ 　 "), ["it's", " DON'T", "\n\n", "  ", "\u200b", "\x85", "<|endoftext|>"]]
    texts = ["".join(rnd.choice(rnd.choice(pools)) for _ in range(rnd.randint(1, 40))) for _ in range(3000)]
    split = {t: parts for t in texts if (parts := token_counts.looked_up(t, special)) is not None}
    assert len(split) > 500 and any("中" in t for t in split)
    for text, parts in split.items():
        assert sum(token_counts.lengths("byte_bpe_50k.json", parts)) == len(lib.encode(text, add_special_tokens=False).ids), text


SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(r["predicted"], labels[r["doc_id"]]["quality"]) for r in quality_gam.op7_quality_gam(spark, SF).filter("held_out").collect() if r["doc_id"] in labels]
    assert sum(p == y for p, y in held) >= 0.95 * len(held) > 0
    held = [(r["predicted"], labels[r["doc_id"]]["toxic"]) for r in toxicity.op8_toxicity(spark, SF).filter("held_out").collect() if r["doc_id"] in labels]
    assert sum(p == y for p, y in held) >= 0.93 * len(held) and sum(p > y for p, y in held) == 0
    rules = {r["doc_id"]: r for r in quality_rules.op3_quality_rules(spark, SF).collect()}
    good = [rules[i]["kept"] for i, r in labels.items() if r["quality"] == 1 and not rules[i]["base_failed"]]
    bad = [rules[i]["kept"] for i, r in labels.items() if r["quality"] == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.03 * len(bad)
