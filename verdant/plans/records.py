"""Queries that build the dataset from nested records, and bootstraps over all cells.

Orders stand for records, their lines for weaknesses and CPE matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.operators import bootstrap, dataset, outcomes, selection
from verdant.plans.registry import CELL, CLASSES, VERDICTS, P, V, _rounded, _table, eval_rows, query

# one expression for both engines each
_KIND = "CASE WHEN l_linenumber % 2 = 1 THEN 'Primary' ELSE 'Secondary' END"
_SOURCE = "CASE WHEN l_suppkey % 4 = 0 THEN 'nvd@nist.gov' ELSE 'security@example.org' END"
_LANG = "CASE WHEN l_partkey % 5 = 0 THEN 'es' ELSE 'en' END"
_VALUE = "CASE WHEN l_partkey % 7 = 0 THEN 'NVD-CWE-Other' WHEN l_partkey % 7 = 1 THEN 'NVD-CWE-noinfo' ELSE 'CWE-' || l_partkey END"
_CRITERIA = "CASE WHEN l_partkey % 6 = 0 THEN 'cpe:2.3:a' ELSE 'cpe:2.3:a:' || lower(replace(p_brand, '#', '_')) || ':' || replace(p_name, ' ', '_') || ':*:*' END"
_VULNERABLE = "l_suppkey % 3 = 0"
_STATUS = "CASE WHEN o_orderkey % 10 = 3 THEN 'Rejected' ELSE 'Analyzed' END"
_DESCRIPTION = "CASE WHEN o_orderkey % 6 > 0 THEN o_orderpriority ELSE '' END"
_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def nested_records(spark, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    weakness = f"named_struct('source', {_SOURCE}, 'type', {_KIND}, 'description', array(named_struct('lang', {_LANG}, 'value', {_VALUE})))"
    each = F.struct(*_ORDER, F.expr(weakness).alias("weakness"), F.expr(f"named_struct('vulnerable', {_VULNERABLE}, 'criteria', {_CRITERIA})").alias("match"), F.expr("named_struct('vendor', p_brand, 'product', p_name)").alias("named"))
    own = lines.select("l_orderkey", each.alias("x")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("x"))
    metric = "array(named_struct('cvssData', named_struct('vectorString', CASE WHEN o_orderkey % 8 > 0 THEN 'V' || o_orderstatus END, 'attackVector', 'NETWORK', 'accessVector', 'LOCAL', 'confidentialityImpact', 'HIGH', 'integrityImpact', 'LOW', 'availabilityImpact', o_orderstatus)))"
    none = f"filter({metric}, m -> false)"
    out = _table(spark, sf_dir, "orders").join(own, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return out.select(
        F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("published"), F.expr(_STATUS).alias("vulnStatus"),
        F.expr(f"array(named_struct('lang', 'fr', 'value', 'non'), named_struct('lang', 'en', 'value', {_DESCRIPTION}))").alias("descriptions"),
        F.expr(f"named_struct('cvssMetricV31', CASE WHEN o_orderkey % 3 = 0 THEN {metric} ELSE {none} END, 'cvssMetricV30', CASE WHEN o_orderkey % 3 = 1 THEN {metric} ELSE {none} END, 'cvssMetricV2', {metric})").alias("metrics"),
        F.transform("x", lambda x: x["weakness"]).alias("weaknesses"), F.expr("array(named_struct('nodes', array(named_struct('cpeMatch', transform(x, y -> y.match)))))").alias("configurations"),
        F.expr("array(named_struct('affectedData', transform(x, y -> y.named)))").alias("affected"),
    )


_FLAT = f"""WITH l AS (SELECT l.*, p_brand, p_name, {_SOURCE} AS src, {_KIND} AS kind, {_LANG} AS lang, {_VALUE} AS val, {_CRITERIA} AS criteria, {_VULNERABLE} AS vulnerable,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos FROM lineitem l JOIN part ON l_partkey = p_partkey),
t AS (SELECT l_orderkey, pos, val, CASE WHEN src = 'nvd@nist.gov' THEN 0 ELSE 2 END + CASE WHEN kind = 'Primary' THEN 0 ELSE 1 END AS tier FROM l WHERE lang = 'en' AND val NOT IN ('NVD-CWE-Other', 'NVD-CWE-noinfo')),
w AS (SELECT l_orderkey, string_agg(val, ';' ORDER BY pos) AS ids, count(*) AS n FROM t WHERE tier = (SELECT min(tier) FROM t u WHERE u.l_orderkey = t.l_orderkey) GROUP BY ALL),
g AS (SELECT l_orderkey, criteria, min(pos) AS pos FROM l WHERE vulnerable AND len(string_split(criteria, ':')) >= 5 GROUP BY ALL),
c AS (SELECT l_orderkey, string_agg(replace(split_part(criteria, ':', 4), '_', ' ') || ' ' || replace(split_part(criteria, ':', 5), '_', ' '), ';' ORDER BY pos) AS components, string_agg(criteria, ';' ORDER BY pos) AS raw FROM g GROUP BY ALL),
h AS (SELECT l_orderkey, string_agg(pair, ';' ORDER BY pos) AS components FROM (SELECT l_orderkey, p_brand || ' ' || p_name AS pair, min(pos) AS pos FROM l GROUP BY ALL) GROUP BY ALL),
f AS (SELECT o_orderkey AS cve_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS published, {_STATUS} AS status, {_DESCRIPTION} AS description, CASE WHEN o_orderkey % 8 > 0 THEN 'V' || o_orderstatus END AS cvss_vector, coalesce(w.ids, '') AS cwe_ids, coalesce(w.n, 0) AS n_ids,
  CASE WHEN o_orderkey % 3 = 2 THEN 'LOCAL' ELSE 'NETWORK' END AS attack_vector, 'HIGH' AS confidentiality_impact, 'LOW' AS integrity_impact, o_orderstatus AS availability_impact,
  CASE WHEN c.raw IS NOT NULL THEN 'cpe' ELSE 'affected' END AS affected_component_source, coalesce(c.components, h.components, '') AS affected_components, coalesce(c.raw, '') AS affected_cpes_raw
  FROM orders LEFT JOIN w ON o_orderkey = w.l_orderkey LEFT JOIN c ON o_orderkey = c.l_orderkey LEFT JOIN h ON o_orderkey = h.l_orderkey),
r AS (SELECT *, concat_ws(';', CASE WHEN description = '' THEN 'description' END, CASE WHEN cvss_vector IS NULL THEN 'cvss_vector' END, CASE WHEN cwe_ids = '' THEN 'cwe_ids' END, CASE WHEN affected_component_source <> 'cpe' THEN 'cpe' END) AS missing FROM f WHERE status <> 'Rejected')"""


@query(_FLAT + " SELECT * EXCLUDE (status, n_ids, missing) FROM r")
def flat_records(spark, sf_dir):
    out = dataset.flat_record(dataset.not_rejected(nested_records(spark, sf_dir)))
    return out.withColumns({c: F.array_join(c, ";") for c in ("cwe_ids", "affected_components", "affected_cpes_raw")})


@query(_FLAT + " SELECT cve_id, missing, missing = '' AS complete, affected_component_source = 'affected' AND affected_components <> '' AS fallback_only FROM r")
def completeness(spark, sf_dir):
    rows = dataset.flat_record(dataset.not_rejected(nested_records(spark, sf_dir)))
    return rows.select("cve_id", F.array_join(dataset.missing_parts(), ";").alias("missing"), dataset.is_complete().alias("complete"), dataset.only_fallback().alias("fallback_only"))


@query(_FLAT + """, d AS (SELECT published[1:10] AS day, count(*) AS n FROM r WHERE missing = '' GROUP BY ALL)
SELECT (SELECT count(*) FROM f) AS seen, (SELECT count(*) FROM f WHERE status = 'Rejected') AS rejected, count(*) AS examined, count(*) FILTER (missing = '') AS complete,
count(*) FILTER (missing <> '' AND affected_component_source = 'affected' AND affected_components <> '') AS fallback_only, """ + ", ".join(f"count(*) FILTER (list_contains(string_split(missing, ';'), '{m}')) AS missing_{m}" for m in ("description", "cvss_vector", "cwe_ids", "cpe")) + """,
count(*) FILTER (missing = '' AND n_ids > 1) AS multi_cwe, (SELECT coalesce(sum(greatest(n - 2, 0)), 0)::BIGINT FROM d) AS over_quota, (SELECT count(*) FROM d) AS days, (SELECT coalesce(max(least(n, 2)), 0)::BIGINT FROM d) AS most_a_day, round(count(*) FILTER (missing = '') / count(*), 6) AS completion_rate FROM r""")
def build_funnel(spark, sf_dir):
    return _rounded(dataset.build_funnel(nested_records(spark, sf_dir), 2))


@query(_FLAT + " SELECT vendor, count(*) AS n FROM (SELECT split_part(split_part(affected_cpes_raw, ';', 1), ':', 4) AS vendor FROM r WHERE affected_cpes_raw <> '') GROUP BY ALL ORDER BY n DESC, vendor LIMIT 5")
def top_vendors(spark, sf_dir):
    rows = dataset.flat_record(dataset.not_rejected(nested_records(spark, sf_dir))).filter("size(affected_cpes_raw) > 0")
    return selection.top_values(rows.select(F.array(dataset.first_vendor(F.col("affected_cpes_raw"))).alias("vendors")), "vendors", "vendor", 5)


@query(V + " SELECT model, cond, 0::BIGINT AS n, 0::BIGINT AS supported, 0::BIGINT AS counted FROM v WHERE truth IS NULL OR outcome NOT IN ('Correct', 'Incorrect', 'Unmapped', 'Declined', 'Malformed')")
def unbalanced_cells(spark, sf_dir):
    """No cell is: every truth has a class (A6). A unit test has one that is."""
    return outcomes.unbalanced_cells(eval_rows(spark, sf_dir), CELL, ["NONE", "LOW", "HIGH"])


_DRAWS = 20


def _mixes(x: str) -> str:
    step = f"(m * m + 12345) % {P} AS m"
    return f"SELECT r, {step} FROM (SELECT r, {step} FROM (SELECT r, {step} FROM (SELECT r, ({x}) % {P} AS m FROM d)))"


@query(V + f""", i AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT item FROM v)),
d AS (SELECT r, j FROM range({_DRAWS}) t(r), range((SELECT max(n) FROM i)) u(j)),
s AS (SELECT r, m % (SELECT max(n) FROM i) AS pos, count(*) AS times FROM ({_mixes("r * 1000003 + j * 7919 + 17")}) GROUP BY ALL),
a AS (SELECT r, model, cond, sum(times * (outcome = 'Correct')::INT) / sum(times) AS accuracy FROM s JOIN i ON s.pos = i.pos JOIN v ON v.item = i.item GROUP BY ALL),
o AS (SELECT model, cond, list_sort(list(accuracy)) AS v FROM a GROUP BY ALL)
SELECT model, cond, round(v[1], 6) AS lo, round(v[19], 6) AS hi FROM o""")
def resampled_accuracy(spark, sf_dir):
    """Twenty resamples of the items by integer mixing, the same draw for all cells: what SQL can repeat."""
    rows = eval_rows(spark, sf_dir).withColumn("ok", F.col("outcome") == "Correct")
    return _rounded(bootstrap.resampled(rows, "item", CELL, "ok", _DRAWS))


R = bootstrap.REPLICATES
_CELLS = [(m, c) for m in range(3) for c in range(2)]
_SHARED = [*CLASSES, "CRITICAL"]  # the last is neither a truth nor an answer
_WRONG = ["Incorrect", "Unmapped", "Declined", "Malformed", "Skipped"]


def _boot(values: dict[str, str], metrics: dict[str, str], upper_exclusive: bool) -> str:
    """SQL: values are expressions over v, metrics over their weighted sums, for each cell."""
    of = lambda m, c: {k: f"{k}_{m}{c}" for k in values}
    wide = ", ".join(f"coalesce(sum({e}) FILTER (model = {m} AND cond = {c}), 0)::DOUBLE AS {of(m, c)[k]}" for m, c in _CELLS for k, e in values.items())
    sums = ", ".join(f"sum(w * {k}) AS {k}" for m, c in _CELLS for k in of(m, c).values())
    parts = " UNION ALL ".join(f"SELECT {m} AS model, {c} AS cond, '{name}' AS metric, list_sort(list({e.format(**of(m, c))})) AS v FROM s" for m, c in _CELLS for name, e in metrics.items())
    return V + f""", x AS (SELECT item, {wide} FROM v GROUP BY item), w AS ({bootstrap.weights_sql("SELECT DISTINCT item FROM v", "item")}),
s AS MATERIALIZED (SELECT r, {sums} FROM w JOIN x USING (item) GROUP BY r), o AS ({parts})
SELECT model, cond, metric, round(v[{R * 25 // 1000 + 1}], 6) AS lo, round(v[{R * 975 // 1000 + (0 if upper_exclusive else 1)}], 6) AS hi FROM o"""


def _share(a: str, b: str) -> str:
    return f"CASE WHEN {b} <> 0 THEN {a} / ({b}) ELSE 0.0 END"


def _f1(classes: list[str]) -> tuple[dict[str, str], dict[str, str]]:
    """Values of a class: twice the agreeing rows, and the rows of truths and of answers."""
    seen = "CASE WHEN outcome IN ('Correct', 'Incorrect') THEN predicted END"
    values = {}
    for i, c in enumerate(classes):
        t, s = f"(truth = '{c}')::INT", f"coalesce(({seen}) = '{c}', false)::INT"
        values |= {f"b{i}": f"2 * {t} * {s}", f"a{i}": f"{t} + {s}"}
    return values, {c: _share(f"{{b{i}}}", f"{{a{i}}}") for i, c in enumerate(classes)}


_F1_VALUES, _F1 = _f1(_SHARED)
_F1_METRICS = {f"f1_{c}": e for c, e in _F1.items()} | {"macro_f1": "(0.0::DOUBLE + " + " + ".join(_F1[c] for c in _SHARED) + f") / {len(_SHARED)}"}
_ACCURACY = {"ok": "(outcome = 'Correct')::INT", "n": "1"}
_A = "(" + _share("{ok}", "{n}") + ")"


@query(_boot(_ACCURACY, {"accuracy": _A, "f1": f"2 * {_A} / (1 + {_A})"}, True))
def accuracy_bootstrap(spark, sf_dir):
    """Accuracy and F1 of all six cells from one draw of items."""
    return _rounded(bootstrap.accuracy_intervals(eval_rows(spark, sf_dir), "item", CELL, F.col("outcome") == "Correct"))


def _seen():
    return F.when(F.col("outcome").isin("Correct", "Incorrect"), F.col("predicted"))


@query(_boot(_F1_VALUES, _F1_METRICS | {"macro_f1_supported": "(0.0::DOUBLE + " + " + ".join(_F1[c] for c in ("NONE", "LOW")) + ") / 2"}, False))
def macro_f1_bootstrap(spark, sf_dir):
    """F1 of a fixed list of classes, one of them absent, and macro-F1 over all and over a fixed list of supported ones, from one draw (B1)."""
    return _rounded(bootstrap.f1_intervals(eval_rows(spark, sf_dir), "item", CELL, F.col("truth"), _seen(), _SHARED, ["NONE", "LOW"]))


@query(f"""SELECT b.model, b.cond, b.metric, lo, hi, support, support < 20 AS low_support FROM ({_boot(_F1_VALUES, _F1_METRICS, True)}) b
JOIN (SELECT model, cond, metric, count(*) FILTER (metric = 'macro_f1' OR metric = 'f1_' || truth) AS support FROM ({VERDICTS}), (SELECT unnest({["macro_f1", *(f"f1_{c}" for c in _SHARED)]}) AS metric) GROUP BY ALL) n
ON b.model = n.model AND b.cond = n.cond AND b.metric = n.metric""")
def cell_bootstrap(spark, sf_dir):
    """F1 with the support of each class (B2)."""
    return _rounded(bootstrap.cell_intervals(eval_rows(spark, sf_dir), "item", CELL, F.col("truth"), _seen(), _SHARED))


@query(_boot(_ACCURACY | {f"k{i}": f"(outcome = '{k}')::INT" for i, k in enumerate(_WRONG)}, {"accuracy": _A} | {f"share_{k}": _share(f"{{k{i}}}", "{n} - {ok}") for i, k in enumerate(_WRONG)}, True))
def error_share_bootstrap(spark, sf_dir):
    """Accuracy and the shares of a fixed list of categories, one of them absent, among the wrong answers."""
    return _rounded(bootstrap.share_intervals(eval_rows(spark, sf_dir), "item", CELL, F.col("outcome"), _WRONG))


@query(V + f""", i AS (SELECT item, avg((outcome = 'Correct')::INT::DOUBLE) AS mean FROM v WHERE has_block GROUP BY item), w AS ({bootstrap.weights_sql("SELECT item FROM i", "item")}),
o AS (SELECT list_sort(list(m)) AS v FROM (SELECT r, sum(w * mean) / sum(w) AS m FROM w JOIN i USING (item) GROUP BY r))
SELECT 'mean' AS metric, round(v[{R * 25 // 1000 + 1}], 6) AS lo, round(v[{R * 975 // 1000 + 1}], 6) AS hi FROM o""")
def mean_of_means_bootstrap(spark, sf_dir):
    per_item = eval_rows(spark, sf_dir).filter("has_block").groupBy("item").agg(F.avg((F.col("outcome") == "Correct").cast("double")).alias("mean"))
    return _rounded(bootstrap.mean_intervals(per_item, "item", F.col("mean")))
