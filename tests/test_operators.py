import math

import pytest
from pyspark.sql import functions as F

from verdant.functions import normalize as N
from verdant.operators import agreement, bootstrap, dataset, declines, fuzzy, labels, outcomes, paired, responses


def values(spark, texts, f):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


def test_normalisers(spark):
    classes = ["NETWORK", "ADJACENT_NETWORK", "LOCAL", "PHYSICAL"]
    assert values(spark, [" Adjacent Network. ", "adjacent-network", "LAN", None], lambda c: N.class_label(c, classes)) == ["ADJACENT_NETWORK", "ADJACENT_NETWORK", None, None]
    assert values(spark, ["h", " low", "none", "x"], lambda c: N.impact_label(c, ["NONE", "LOW", "HIGH"])) == ["HIGH", "LOW", "NONE", None]
    assert values(spark, ["Use-After-Free", "XSS & more", "???", ""], N.weakness_label) == ["use after free", "xss and more", None, None]
    assert values(spark, ["CWE-79", "cwe 079", "79", "79 x", "CWE_79", "(CWE-79)", "CWE–79", "CWE-79."], lambda c: N.direct_id(N.weakness_label(c))) == [*["CWE-79"] * 3, None, *["CWE-79"] * 4]
    assert values(spark, ["The GIMP in a box", None], N.component_tokens) == [["gimp", "box"], None]
    # white space of any kind at the ends, full-width letters, backticks
    assert values(spark, ["NETWORK\n", "\tlocal", "Network .", "adjacent  network"], lambda c: N.class_label(c, classes)) == ["NETWORK", "LOCAL", "NETWORK", "ADJACENT_NETWORK"]
    assert values(spark, ["HIGH\n", "\u00a0l"], lambda c: N.impact_label(c, ["NONE", "LOW", "HIGH"])) == ["HIGH", "LOW"]
    assert values(spark, ["ＸＳＳ", "`use` after—free"], N.weakness_label) == ["xss", "use after free"]
    assert values(spark, ["```json\n{}\n```", "```\n{}```", "```python\n{}```"], N.without_fences) == ["{}", "{}", "python\n{}"]
    assert values(spark, ["Cross-site Scripting (XSS) and (Stored-XSS) ()"], N.parenthetical_aliases) == [["xss", "stored xss"]]


def test_closed_class_outcomes_and_scores(spark):
    rows = spark.createDataFrame([(True, "High", "HIGH"), (True, None, "LOW"), (False, None, "LOW"), (True, "zzz", "LOW"), (True, "low", "HIGH"), (True, "low", None)], "has_block boolean, raw string, truth string")
    rows = rows.withColumn("predicted", N.impact_label(F.col("raw"), ["NONE", "LOW", "HIGH"])).withColumn("outcome", outcomes.closed_class_outcome(F.col("has_block"), F.col("raw"), F.col("predicted"), F.col("truth"))).withColumn("cell", F.lit(1))
    assert [r["outcome"] for r in rows.collect()] == ["Correct", "Declined", "Malformed", "Unmapped", "Incorrect", "Incorrect"]
    table = {r["class"]: r for r in outcomes.per_class(outcomes.confusion(rows, ["cell"]), ["cell"], ["NONE", "LOW", "HIGH"]).collect()}
    assert (table["HIGH"]["tp"], table["HIGH"]["fn"], table["LOW"]["fp"], table["LOW"]["fn"], table["NONE"]["f1"]) == (1, 1, 2, 3, 0.0)


def test_component_outcomes(spark):
    rows = spark.createDataFrame([("GIMP JP2 file parsing", ["gimp gimp"]), ("Apache thing", ["apache http server"]), ("nothing", ["x1 y1"]), (" ", ["a b"])], "a string, t array<string>")
    assert [r[0] for r in rows.select(outcomes.component_outcome(F.col("a"), F.col("t"))).collect()] == ["Match", "Partial", "No Match", "Declined"]
    rows = spark.createDataFrame([("plugin", ["service plugin"]), ("WordPress bar system", ["bar plugin"]), ("\n", ["a b"]), ("x1", ["x1 or y1"])], "a string, t array<string>")
    assert [r[0] for r in rows.select(outcomes.component_outcome(F.col("a"), F.col("t"))).collect()] == ["No Match", "Match", "Declined", "Match"]
    assert rows.select(outcomes.component_outcome(F.col("a"), F.col("t"), F.lit(False))).first()[0] == "Malformed"


def test_closed_class_checks(spark):
    rows = spark.createDataFrame([(1, "LOW", "LOW", "Correct"), (1, None, "HIGH", "Incorrect"), (2, "LOW", "HIGH", "Incorrect")], "cell int, truth string, predicted string, outcome string")
    assert [r["cell"] for r in outcomes.unbalanced_cells(rows, ["cell"], ["LOW", "HIGH"]).collect()] == [1]


def test_cross_reference_of_systems_without_rows(spark):
    rows = spark.createDataFrame([(1, "A", "Declined"), (1, "B", "Correct"), (2, "A", "Declined"), (2, "B", "Correct"), (2, "C", "Correct"), (3, "A", "Declined"), (3, "B", "Incorrect"), (3, "C", "Incorrect"), (3, "C", "Unmapped")], "item int, system string, outcome string")
    got = declines.cross_reference(rows, declines.declined_by(rows, "item", "system"), "item", "system")
    assert {r["verdict"]: r["n_items"] for r in got.collect()} == {"mixed": 1, "none wrong": 1, "all wrong": 1}


def test_verdicts_that_may_be_null(spark):
    rows = spark.createDataFrame([("LOW", "LOW"), ("LOW", "HIGH"), (None, "LOW"), ("LOW", None)], "p string, t string")
    assert [r[0] for r in rows.select(agreement.nullable_verdict(F.col("p"), F.col("t"))).collect()] == [True, False, None, None]
    rows = spark.createDataFrame([("a", ["a", None]), ("b", ["a"]), ("a", [None]), (None, ["a"])], "p string, t array<string>")
    assert [r[0] for r in rows.select(agreement.member_verdict(F.col("p"), F.col("t"))).collect()] == [True, False, None, None]


@pytest.mark.parametrize("table,band", [([(1, 1, 50), (0, 0, 50)], "Almost perfect"), ([(1, 1, 42), (0, 0, 42), (1, 0, 8), (0, 1, 8)], "Substantial"), ([(1, 0, 10), (0, 1, 10)], "Slight"), ([(1, 1, 13), (0, 0, 13), (1, 0, 7), (0, 1, 7)], "Fair")])
def test_kappa_bands(spark, table, band):
    rows = spark.createDataFrame([(a, b) for a, b, n in table for _ in range(n)], "a int, b int")
    got = agreement.kappa(rows, "a", "b", [0, 1]).first()
    assert got["band"] == band
    assert sum(r["n"] for r in agreement.joint_table(rows, "a", "b").collect()) == got["n"]


@pytest.mark.parametrize("b,c,p", [(0, 0, 1.0), (12, 42, 0.0001), (7, 18, 0.0455), (26, 26, 0.8897), (5, 1, 0.2188)])
def test_mcnemar_published_values(spark, b, c, p):
    got = paired.mcnemar(spark.createDataFrame([(b, c)], "b long, c long")).first()["p"]
    assert math.isclose(got, p, abs_tol=6e-5)


def test_holm_is_monotone(spark):
    tests = spark.createDataFrame([("f", i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.9])], "family string, i int, p double")
    got = {r["i"]: r["p_holm"] for r in paired.holm(tests, ["family"], ["i"]).collect()}
    assert [round(got[i], 4) for i in range(4)] == [0.04, 0.09, 0.09, 0.9]


def test_kappa(spark):
    rows = spark.createDataFrame([(a, b) for a, b, n in [(1, 1, 20), (0, 0, 15), (1, 0, 5), (0, 1, 10)] for _ in range(n)], "a int, b int")
    got = agreement.kappa(rows, "a", "b", [0, 1]).first()
    assert (round(got["po"], 2), round(got["kappa"], 2), got["band"]) == (0.7, 0.4, "Fair")


def test_responses_strictness(spark):
    raw = ['{"k": 1}', '```json\n{"k": null}\n```', '{"k": 1} tail', '[1]', None, '{"j": 2}', '{"k": 1, "z": 0}']
    df = spark.createDataFrame(list(enumerate(raw)), "i int, raw string")
    out = {r["i"]: r for r in responses.validated(df, "raw", ["k"], {"k": ["1"]}).drop("parsed").collect()}
    assert [out[i]["valid"] for i in range(7)] == [True, True, False, False, False, False, False]
    assert out[5]["notes"] == ["missing: k", "extra: j"] and out[6]["notes"] == ["extra: z"]


def test_flattening(spark):
    metric = "array<struct<cvssData:struct<vectorString:string,attackVector:string,accessVector:string>>>"
    rows = spark.sql(f"""select named_struct('cvssMetricV31', cast(array() as {metric}), 'cvssMetricV30', cast(null as {metric}), 'cvssMetricV2', array(named_struct('cvssData', named_struct('vectorString', 'AV:N', 'attackVector', cast(null as string), 'accessVector', 'NETWORK')))) as metrics,
      array(named_struct('source', 'nvd@nist.gov', 'type', 'Primary', 'description', array(named_struct('lang', 'en', 'value', 'NVD-CWE-Other'))), named_struct('source', 'security@apache.org', 'type', 'Secondary', 'description', array(named_struct('lang', 'en', 'value', 'CWE-59'), named_struct('lang', 'en', 'value', 'CWE-732')))) as weaknesses,
      array(named_struct('lang', 'fr', 'value', 'non'), named_struct('lang', 'en', 'value', 'yes')) as descriptions""")
    got = rows.select(dataset.first_metric("attackVector", "accessVector"), dataset.weakness_ids(), dataset.english_description()).first()
    assert tuple(got) == ("NETWORK", ["CWE-59", "CWE-732"], "yes")
    assert values(spark, [r"cpe:2.3:a:archive\:\:tar_project:archive\:\:tar:*", "cpe:x"], dataset.cpe_component) == ["archive::tar project archive::tar", None]


def test_slices_samples_and_snapshots(spark):
    days = spark.createDataFrame([(d,) for d in range(7)], "d int")
    assert [r[0] for r in days.select(dataset.slice_number(F.col("d"))).collect()] == [0, 0, 0, 1, 1, 2, 2]
    rows = spark.range(100).withColumn("cell", F.col("id") % 3)
    sample = dataset.stratified_sample(rows, ["cell"], "id", 10, 42).groupBy("cell").count().collect()
    assert {r["cell"]: r["count"] for r in sample} == {0: 4, 1: 3, 2: 3}
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "k int, v string")
    assert {(r["k"], r["status"]) for r in dataset.snapshot_diff(old, new, "k", ["v"]).collect()} == {(1, "removed"), (2, "kept"), (4, "added")}


def test_layered_labels(spark):
    vocabulary = spark.createDataFrame([("CWE-79", "p1"), ("CWE-416", "p2"), ("CWE-415", "p2")], "id string, pillar string")
    index = labels.alias_index(spark.createDataFrame([("use after free", "CWE-416"), ("bug", "CWE-79"), ("bug", "CWE-415")], "alias string, id string"))
    rows = spark.createDataFrame([("CWE-79", ["CWE-79"]), ("Use-After-Free", ["CWE-415"]), ("Use-After-Free", ["CWE-79"]), ("Denial of Service", ["CWE-79"]), ("bug", ["CWE-79"]), (None, ["CWE-79"])], "answer string, truths array<string>")
    out = labels.layered_verdict(rows, "answer", "truths", labels.resolve(rows, "answer", index, vocabulary), vocabulary)
    got = {(r["answer"], r["truths"][0]): r["verdict"] for r in out.collect()}
    assert got == {("CWE-79", "CWE-79"): "correct", ("Use-After-Free", "CWE-415"): "same_pillar_wrong_cwe", ("Use-After-Free", "CWE-79"): "different_pillar", ("Denial of Service", "CWE-79"): "consequence_not_mechanism", ("bug", "CWE-79"): "unmapped_or_absent", (None, "CWE-79"): "unmapped_or_absent"}


def test_broad_terms_and_methods(spark):
    vocabulary = spark.createDataFrame([("CWE-22", "p1"), ("CWE-23", "p1"), ("CWE-73", "p1"), ("CWE-416", "p2"), ("CWE-367", "p3")], "id string, pillar string")
    index = labels.reject_ambiguous(labels.alias_index(spark.createDataFrame([("use after free", "CWE-22"), ("uaf", "CWE-416")], "alias string, id string")))
    answers = [("Path Traversal", ["CWE-23"]), ("Path Traversal", ["CWE-73"]), ("path  traversal", ["CWE-416"]), ("use after free", ["CWE-416"]), ("UAF", ["CWE-416"]), ("Race Condition", ["CWE-367", None]), ("", ["CWE-22"]), ("memory corruption", ["CWE-416"])]
    rows = spark.createDataFrame(answers, "answer string, truths array<string>")
    out = labels.layered_verdict(rows, "answer", "truths", labels.resolve(rows, "answer", index, vocabulary), vocabulary)
    got = {(r["answer"], r["truths"][0]): (r["verdict"], r["method"]) for r in out.collect()}
    assert got == {
        ("Path Traversal", "CWE-23"): ("same_pillar_wrong_cwe", "BROAD_OR_AMBIGUOUS"), ("Path Traversal", "CWE-73"): ("same_pillar_wrong_cwe", "BROAD_OR_AMBIGUOUS"),
        ("path  traversal", "CWE-416"): ("different_pillar", "BROAD_OR_AMBIGUOUS"), ("use after free", "CWE-416"): ("correct", "SAFE_EQUIVALENT_ALIAS"),
        ("UAF", "CWE-416"): ("correct", "STRICT_ALIAS"), ("Race Condition", "CWE-367"): ("same_pillar_wrong_cwe", "BROAD_OR_AMBIGUOUS"),
        ("", "CWE-22"): ("unmapped_or_absent", "NULL_OR_EMPTY"), ("memory corruption", "CWE-416"): ("consequence_not_mechanism", "UNRESOLVED"),
    }
    with pytest.raises(ValueError):
        labels.reject_ambiguous(labels.alias_index(spark.createDataFrame([("bug", "CWE-22"), ("Bug", "CWE-416")], "alias string, id string")))


def test_bootstrap_of_all_cells(spark):
    rows = spark.createDataFrame([(i, c, (i + c) % 4 > 0) for i in range(400) for c in range(2)], "item long, cell int, ok boolean")
    got = {(r["cell"], r["metric"]): r for r in bootstrap.accuracy_intervals(rows, "item", ["cell"], F.col("ok"), 1000).collect()}
    assert set(got) == {(0, "accuracy"), (0, "f1"), (1, "accuracy"), (1, "f1")} and 0.69 < got[0, "accuracy"]["lo"] < 0.75 < got[0, "accuracy"]["hi"] < 0.81
    pairs = [("a", "a")] * 40 + [("a", "b")] * 10 + [("b", "b")] * 5 + [("b", None)] * 5
    cells = spark.createDataFrame([(i, 0, t, s) for i, (t, s) in enumerate(pairs)], "item long, cell int, truth string, seen string")
    own = {r["metric"]: r for r in bootstrap.cell_intervals(cells, "item", ["cell"], F.col("truth"), F.col("seen"), ["a", "b"], 1000).collect()}
    assert own["f1_b"]["low_support"] and not own["f1_a"]["low_support"] and own["f1_a"]["lo"] < 2 * 40 / 90 < own["f1_a"]["hi"]
    both = {r["metric"]: r for r in bootstrap.f1_intervals(cells, "item", ["cell"], F.col("truth"), F.col("seen"), ["a", "b"], ["a"], 1000).collect()}
    assert both["macro_f1_supported"]["lo"] == both["f1_a"]["lo"]
    places = bootstrap.dense_positions(spark.createDataFrame([(i * 7,) for i in range(500)], "item long"), "item", 100)
    assert all(r["pos"] * 7 == r["item"] for r in places.collect())


def test_records_by_hand(spark):
    match = "named_struct('vulnerable', {}, 'criteria', '{}')"
    row = f"""select array(named_struct('nodes', array(named_struct('cpeMatch', array({match.format('false', 'cpe:2.3:a:no:no:1')}, {match.format('true', 'cpe:2.3:a:acme:my_app:1')}, {match.format('true', 'cpe:2.3:a:acme:my_app:2')}, {match.format('true', 'short:cpe')}))))) as configurations,
      array(named_struct('affectedData', array(named_struct('vendor', 'v', 'product', cast(null as string))))) as affected"""
    got = spark.sql(row).select(dataset.affected_components().alias("a"), dataset.affected_components(F.expr("filter(configurations, x -> false)")).alias("b")).first()
    assert got["a"]["components"] == ["acme my app"] and len(got["a"]["raw_cpes"]) == 2 and got["a"]["source"] == "cpe"
    assert got["b"].asDict() == {"source": "affected", "components": ["v"], "raw_cpes": []}


def test_fuzzy_components(spark):
    rows = spark.createDataFrame([(1, ["nginx", "server"], ["nginnx", "web", "server"], "nginx"), (2, ["apache", "http"], ["tomcat"], "http")], "k int, t array<string>, a array<string>, p string")
    assert {r["k"]: r["matched"] for r in fuzzy.component_match(rows, "k", "t", "a", "p").collect()} == {1: True, 2: False}
