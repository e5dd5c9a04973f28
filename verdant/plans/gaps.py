"""Queries over inputs with gaps: absent lists, null strata, unpriced systems; and single functions by themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdant.functions import normalize as N
from verdant.operators import dataset, inventory, labels, outcomes, responses, selection
from verdant.plans.labelled import _WEAK, label_rows, region_terms, verdict_rows
from verdant.plans.matched import _BACK
from verdant.plans.records import _CRITERIA, _LANG, _ORDER, _VALUE, _VULNERABLE
from verdant.plans.registry import _CLASS, _DAYS, CELL, V, _rounded, _table, eval_rows, query

_LINES = f"""SELECT l.*, p_brand, p_name, {_LANG} AS lang, {_VALUE} AS val, {_CRITERIA} AS criteria, {_VULNERABLE} AS vulnerable,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_ORDER)}) AS pos FROM lineitem l JOIN part ON l_partkey = p_partkey"""


def records_with_gaps(spark, sf_dir: str):
    """An order's lines as weaknesses, configurations and affected entries, many of them without their lists."""
    lines = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    parts = {
        "weakness": f"named_struct('description', CASE WHEN l_linenumber % 3 > 0 THEN array(named_struct('lang', {_LANG}, 'value', {_VALUE})) END)",
        "config": f"named_struct('nodes', CASE WHEN l_linenumber % 4 <> 1 THEN array(named_struct('cpeMatch', CASE WHEN l_linenumber % 4 <> 2 THEN array(named_struct('vulnerable', {_VULNERABLE}, 'criteria', {_CRITERIA})) END)) END)",
        "entry": "named_struct('affectedData', CASE WHEN l_linenumber % 2 = 0 THEN array(named_struct('vendor', p_brand, 'product', p_name)) END)",
    }
    each = F.struct(*_ORDER, *(F.expr(e).alias(k) for k, e in parts.items()))
    own = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(each)).alias("x"))
    absent = F.col("l_orderkey") % 5 == 0  # these have no list of configurations at all
    return own.select("l_orderkey", F.transform("x", lambda x: x["weakness"]).alias("weaknesses"), F.when(~absent, F.transform("x", lambda x: x["config"])).alias("configurations"), F.transform("x", lambda x: x["entry"]).alias("affected"))


@query(f"""SELECT l_orderkey, arg_min(val, pos) FILTER (l_linenumber % 3 > 0 AND lang = 'en' AND val NOT IN ('NVD-CWE-Other', 'NVD-CWE-noinfo')) AS first_id FROM ({_LINES}) GROUP BY l_orderkey""")
def first_weakness_with_gaps(spark, sf_dir):
    """P5: weaknesses without a description do not hide the others."""
    return records_with_gaps(spark, sf_dir).select("l_orderkey", inventory.first_weakness().alias("first_id"))


@query(f"""WITH l AS ({_LINES}), g AS (SELECT l_orderkey, criteria, min(pos) AS pos FROM l WHERE vulnerable AND len(string_split(criteria, ':')) >= 5 AND l_linenumber % 4 NOT IN (1, 2) AND l_orderkey % 5 > 0 GROUP BY ALL),
c AS (SELECT l_orderkey, string_agg(criteria, ';' ORDER BY pos) AS raw_cpes FROM g GROUP BY ALL),
p AS (SELECT l_orderkey, string_agg(pair, ';' ORDER BY pos) AS components FROM (SELECT l_orderkey, replace(split_part(criteria, ':', 4), '_', ' ') || ' ' || replace(split_part(criteria, ':', 5), '_', ' ') AS pair, min(pos) AS pos FROM g GROUP BY ALL) GROUP BY ALL),
h AS (SELECT l_orderkey, string_agg(pair, ';' ORDER BY pos) AS components FROM (SELECT l_orderkey, p_brand || ' ' || p_name AS pair, min(pos) AS pos FROM l WHERE l_linenumber % 2 = 0 GROUP BY ALL) GROUP BY ALL)
SELECT k.l_orderkey, CASE WHEN raw_cpes IS NULL THEN 'affected' ELSE 'cpe' END AS source, coalesce(p.components, h.components, '') AS components, coalesce(raw_cpes, '') AS raw_cpes
FROM (SELECT DISTINCT l_orderkey FROM l) k LEFT JOIN c USING (l_orderkey) LEFT JOIN p USING (l_orderkey) LEFT JOIN h USING (l_orderkey)""")
def components_with_gaps(spark, sf_dir):
    """Configurations without nodes, nodes without matches, entries without data, records without configurations."""
    out = records_with_gaps(spark, sf_dir).select("l_orderkey", dataset.affected_components().alias("a")).select("l_orderkey", "a.*")
    return out.withColumns({c: F.array_join(c, ";") for c in ("components", "raw_cpes")})


@query("""WITH r AS (SELECT user_id % 4 AS model, CASE WHEN event_id % 11 > 0 THEN value END AS latency, CASE WHEN event_id % 5 > 0 AND user_id % 4 <> 1 THEN length(props) END AS tokens_in, CASE WHEN event_id % 5 > 0 AND user_id % 4 <> 1 THEN user_id END AS tokens_out FROM events),
a AS (SELECT model, count(*) AS n, count(*) FILTER (tokens_in IS NOT NULL OR tokens_out IS NOT NULL) AS used, avg(latency) AS mean_latency, sum(latency) AS total_latency, coalesce(sum(tokens_in), 0)::BIGINT AS tokens_in, coalesce(sum(tokens_out), 0)::BIGINT AS tokens_out FROM r GROUP BY ALL),
c AS (SELECT *, CASE WHEN model < 3 THEN (tokens_in * (model + 1.0::DOUBLE) + tokens_out * (10.0::DOUBLE * (model + 1))) / 1e6 ELSE 0.0::DOUBLE END AS cost FROM a)
SELECT model, n, round(mean_latency, 6) AS mean_latency, round(total_latency, 6) AS total_latency, tokens_in, tokens_out, round(cost, 6) AS cost, round(CASE WHEN used > 0 THEN cost / used * 1000000 END, 6) AS projected FROM c""")
def latency_and_cost_with_gaps(spark, sf_dir):
    """A system without a price, one without any usage, rows without times or tokens."""
    known = (F.col("event_id") % 5 > 0) & (F.col("user_id") % 4 != 1)
    rows = _table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("model"), F.when(F.col("event_id") % 11 > 0, F.col("value")).alias("latency"), F.when(known, F.length("props")).alias("tokens_in"), F.when(known, F.col("user_id")).alias("tokens_out"))
    prices = spark.range(3).select(F.col("id").alias("model"), (F.col("id") + 1.0).alias("price_in"), (10.0 * (F.col("id") + 1)).alias("price_out"))
    return _rounded(responses.latency_and_cost(rows, prices))


_CUT = "CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END"


@query(f"""WITH r AS (SELECT o_orderkey, {_CUT} AS o_orderpriority, o_orderstatus, md5(o_orderkey::VARCHAR || ':42') AS draw FROM orders),
c AS (SELECT *, row_number() OVER (ORDER BY o_orderpriority NULLS FIRST, o_orderstatus NULLS FIRST) AS place, count(*) OVER () AS k FROM (SELECT DISTINCT o_orderpriority, o_orderstatus FROM r)),
t AS (SELECT r.*, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY draw, o_orderkey) AS turn FROM r)
SELECT o_orderkey, t.o_orderpriority, t.o_orderstatus FROM t JOIN c ON t.o_orderpriority IS NOT DISTINCT FROM c.o_orderpriority AND t.o_orderstatus = c.o_orderstatus WHERE turn <= 200 // k + CASE WHEN place <= 200 % k THEN 1 ELSE 0 END""")
def stratified_sample_with_nulls(spark, sf_dir):
    """A null stratum has its share like any other."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_CUT).alias("o_orderpriority"), "o_orderstatus")
    return dataset.stratified_sample(rows, ["o_orderpriority", "o_orderstatus"], "o_orderkey", 200, 42)


@query("SELECT user_id % 3 AS model, round(sum(value), 4) AS seconds, count(*) AS n FROM events GROUP BY ROLLUP (user_id % 3)")
def time_totals(spark, sf_dir):
    """A18."""
    out = responses.time_totals(_table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("model"), "value"), "model", "value")
    return out.withColumn("seconds", F.round("seconds", 4))


_VECTOR = "'CVSS:3.1/AV:' || substr(o_orderpriority, 3, 1) || CASE WHEN o_orderkey % 3 > 0 THEN '/C:' || o_orderstatus ELSE '' END || '/A:H'"


@query("SELECT o_orderkey, substr(o_orderpriority, 3, 1) AS av, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS c, 'H' AS a FROM orders")
def vector_classes(spark, sf_dir):
    """P11."""
    parts = dataset.vector_classes(F.expr(_VECTOR))
    return _table(spark, sf_dir, "orders").select("o_orderkey", parts).toDF("o_orderkey", "m").select("o_orderkey", *(F.try_element_at("m", F.lit(k)).alias(k.lower()) for k in ("AV", "C", "A")))


@query("SELECT p_partkey, 'Classify: ' || p_name || chr(10) || 'Answer for {other} about ' || p_name AS prompt FROM part")
def prompts(spark, sf_dir):
    """Every place is filled, other braces stay."""
    template = "Classify: {description}\nAnswer for {other} about {description}"
    return _table(spark, sf_dir, "part").select("p_partkey", responses.prompt(template, F.col("p_name")).alias("prompt"))


_IDS = "CASE p_partkey % 3 WHEN 0 THEN 'CWE-' || p_partkey WHEN 1 THEN p_brand ELSE split_part(p_name, ' ', 1) END"


@query(f"SELECT id, row_number() OVER (ORDER BY coalesce(try_cast(regexp_extract(id, '([0-9]+)', 1) AS BIGINT), 1000000000), id) AS turn FROM (SELECT DISTINCT {_IDS} AS id FROM part)")
def natural_order(spark, sf_dir):
    """Ids numbered by their first number, then as text; those without a number last."""
    ids = _table(spark, sf_dir, "part").select(F.expr(_IDS).alias("id")).distinct().withColumn("key", N.natural_key(F.col("id")))
    return inventory.numbered(ids, ["key"]).select("id", "turn")


@query(_WEAK.replace("n_regionkey AS pillar", "n_regionkey % 2 AS pillar") + " SELECT c_custkey, verdict, resolved FROM w")
def layered_verdicts_by_category(spark, sf_dir):
    """V6: the same rules over a coarser group."""
    rows, vocabulary, index = label_rows(spark, sf_dir)
    own = vocabulary.select("id", (F.col("pillar") % 2).alias("category"))
    out = labels.layered_verdict(rows, "answer", "truths", labels.resolve(rows, "answer", index, vocabulary), own, region_terms(spark, sf_dir), group="category")
    return out.select("c_custkey", "verdict", "resolved")


_SPOKEN = "CASE o_orderkey % 7 WHEN 0 THEN ' Network.;' WHEN 1 THEN 'adjacent  network' WHEN 2 THEN 'Adjacent-Network:' WHEN 3 THEN 'LOCAL' WHEN 4 THEN 'lo cal' WHEN 5 THEN '' END"
_VECTORS = ["NETWORK", "ADJACENT_NETWORK", "LOCAL", "PHYSICAL"]


@query(f"""SELECT o_orderkey, CASE WHEN label IN ('NETWORK', 'ADJACENT_NETWORK', 'LOCAL', 'PHYSICAL') THEN label END AS label FROM (
SELECT o_orderkey, upper(replace(regexp_replace(trim(trim(trim({_SPOKEN}), '.,;:')), '\\s+', '_', 'g'), '-', '_')) AS label FROM orders)""")
def attack_vector_labels(spark, sf_dir):
    """N1."""
    return _table(spark, sf_dir, "orders").select("o_orderkey", N.class_label(F.expr(_SPOKEN), _VECTORS).alias("label"))


@query(V + " SELECT item, model, cond, has_block, raw FROM (SELECT *, row_number() OVER (PARTITION BY model, cond ORDER BY has_block, item) AS turn FROM v) WHERE turn <= 25")
def inspection_sample(spark, sf_dir):
    """Of each cell 25 rows, invalid ones first."""
    return dataset.capped(eval_rows(spark, sf_dir), CELL, ["has_block", "item"], 25).select("item", "model", "cond", "has_block", "raw")


@query(_CLASS + """ SELECT model, cond, n, supported, counted FROM (SELECT model, cond, sum(support)::BIGINT AS supported FROM c WHERE class <> 'HIGH' GROUP BY ALL)
JOIN (SELECT model, cond, count(*) AS n, count(*) FILTER (outcome IN ('Correct', 'Incorrect', 'Unmapped', 'Declined', 'Malformed')) AS counted FROM v GROUP BY ALL) USING (model, cond) WHERE supported <> n OR counted <> n""")
def unbalanced_cells_of_two_classes(spark, sf_dir):
    """With a class left out, every cell's support falls short."""
    return outcomes.unbalanced_cells(eval_rows(spark, sf_dir), CELL, ["NONE", "LOW"])


@query("SELECT printf('VT-%03d', row_number() OVER (ORDER BY o_orderkey)) AS item_id, o_orderpriority, '' AS your_label FROM orders")
def label_sheet(spark, sf_dir):
    """A sheet of all rows."""
    return inventory.blind_sheet(_table(spark, sf_dir, "orders"), ["o_orderkey"], ["o_orderpriority"], 1 << 40)


@query(_WEAK + """ SELECT c_mktsegment, n, correct, n - correct AS incorrect, categorised, categorised = n - correct AS balanced FROM (SELECT c_mktsegment, count(*) AS n, count(*) FILTER (verdict = 'correct') AS correct,
count(*) FILTER (verdict IN ('consequence_not_mechanism', 'same_pillar_wrong_cwe', 'different_pillar', 'unmapped_or_absent')) AS categorised FROM w GROUP BY ALL)""")
def layer_totals(spark, sf_dir):
    """Both layers of each cell add up."""
    return labels.layer_totals(verdict_rows(spark, sf_dir), ["c_mktsegment"])


def _anchor(rows):
    return rows.agg(F.to_date(F.max("o_orderdate")).alias("d")).first()["d"]


@query(f"SELECT o_orderkey, greatest(ceil((d - 90) / 90) + 1, 1)::INTEGER AS slice FROM ({_BACK}) WHERE d <= 1080 ORDER BY slice, o_orderkey LIMIT 1200")
def latest_windows(spark, sf_dir):
    """Only the windows that 1,200 rows need are read."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return selection.latest(rows, "o_orderdate", _anchor(rows), inventory.look_back_slice, ["o_orderkey"], 1200).select("o_orderkey", "slice")


@query(f"SELECT o_orderkey, slice FROM (SELECT o_orderkey, o_orderdate, CASE WHEN d <= 2 THEN 0 ELSE ceil(d / 2) - 1 END::INTEGER AS slice FROM ({_DAYS})) ORDER BY slice, o_orderdate, o_orderkey LIMIT 700")
def latest_slices(spark, sf_dir):
    """The same for slices of two days."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return selection.latest(rows, "o_orderdate", _anchor(rows), dataset.slice_number, ["o_orderdate", "o_orderkey"], 700).select("o_orderkey", "slice")
