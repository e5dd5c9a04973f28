"""Queries over component answers, free-text labels, repeats, snapshots and samples.

Nations stand for a vocabulary of ids, their regions for its groups and their names for aliases;
customers answer with an id, a name, a consequence or something unknown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdant.functions.normalize import COMPONENT_STOPWORDS
from verdant.operators import agreement, dataset, fuzzy, labels, outcomes, paired, responses, selection, verify
from verdant.plans.registry import _CLASS, CELL, CLASSES, V, _rounded, _table, eval_rows, query

_TRUTH = "lower(replace(p_brand, '#', ' ')) || ' ' || p_name"
_ANSWER = f"CASE p_partkey % 8 WHEN 0 THEN upper(p_name) WHEN 1 THEN {_TRUTH} || ' (the server)' WHEN 2 THEN 'brand of things' WHEN 3 THEN 'a zzz' WHEN 4 THEN ' ' WHEN 6 THEN p_name || ' plugin' WHEN 7 THEN 'the firmware module' END"


def _tokens(x: str) -> str:
    """As published: signs to spaces, words of more than one character that are not on the stop list."""
    stop = ", ".join(f"'{w}'" for w in COMPONENT_STOPWORDS)
    return f"list_distinct([t for t in string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' ') if length(t) > 1 and t not in ({stop})])"


_COMPONENTS = f"""WITH p AS (SELECT p_partkey, p_brand, {_ANSWER} AS answer, {_TRUTH} AS truth FROM part),
t AS (SELECT *, {_tokens("answer")} AS a, {_tokens("truth")} AS g FROM p),
o AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 11 = 0 THEN 'Malformed' WHEN answer IS NULL OR trim(answer) = '' THEN 'Declined' WHEN len(a) > 0 AND len(g) > 0 AND (list_has_all(a, g) OR list_has_all(g, a)) THEN 'Match'
  WHEN list_contains(a, 'brand') THEN 'Partial' ELSE 'No Match' END AS outcome FROM t)"""


def component_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.expr(_ANSWER).alias("answer"), F.array(F.expr(_TRUTH)).alias("truths"))
    return rows.withColumn("outcome", outcomes.component_outcome(F.col("answer"), F.col("truths"), F.col("p_partkey") % 11 != 0))


@query(_COMPONENTS + " SELECT p_partkey, outcome FROM o")
def component_outcomes(spark, sf_dir):
    return component_rows(spark, sf_dir).select("p_partkey", "outcome")


@query(_COMPONENTS + """, c AS (SELECT p_brand, count(*) AS n, count(*) FILTER (outcome = 'Match') AS matched, count(*) FILTER (outcome = 'Partial') AS "partial", count(*) FILTER (outcome = 'No Match') AS no_match,
count(*) FILTER (outcome = 'Declined') AS declined, count(*) FILTER (outcome = 'Malformed') AS malformed FROM o GROUP BY ALL)
SELECT *, CASE WHEN matched > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "precision", round(matched / n, 6) AS recall, round(matched / n, 6) AS accuracy, round(2 * (matched / n) / (1 + matched / n), 6) AS f1,
round("partial" / n, 6) AS partial_rate, round(no_match / n, 6) AS no_match_rate, round((declined + malformed) / n, 6) AS no_prediction_rate FROM c""")
def component_scores(spark, sf_dir):
    return _rounded(outcomes.binary_scores(component_rows(spark, sf_dir), ["p_brand"]))


_BLOCK = "list_max(flatten([[CASE WHEN instr(y, substr(x, (i + 1)::BIGINT, l::BIGINT)) > 0 THEN l * 1000 + 999 - i ELSE 0 END FOR l IN range(1, length(x) - i + 1)] FOR i IN range(length(x))]))"


@query(f"""WITH RECURSIVE p AS (SELECT p_partkey, string_split(p_name, ' ') AS truth, [CASE p_partkey % 3 WHEN 0 THEN w || 's' WHEN 1 THEN reverse(w) ELSE w END FOR w IN string_split(p_name, ' ')] AS answer FROM part),
e AS (SELECT p_partkey, truth[1] AS product, unnest(truth) AS a, answer FROM p), c AS (SELECT DISTINCT a, b FROM (SELECT a, unnest(answer) AS b FROM e)),
k(a, b, x, y, m) AS (SELECT a, b, a, b, 0::BIGINT FROM c UNION ALL
  SELECT a, b, u.x, u.y, u.m FROM (SELECT a, b, unnest([{{'x': substr(x, 1, i), 'y': substr(y, 1, j), 'm': size}}, {{'x': substr(x, i + size + 1), 'y': substr(y, j + size + 1), 'm': 0::BIGINT}}]) AS u
    FROM (SELECT *, instr(y, substr(x, i + 1, size)) - 1 AS j FROM (SELECT *, v // 1000 AS size, 999 - v % 1000 AS i FROM (SELECT a, b, x, y, {_BLOCK} AS v FROM k WHERE x <> '' AND y <> '') WHERE v > 0)))),
r AS (SELECT a, b FROM k GROUP BY a, b HAVING 2.0 * sum(m) / (length(a) + length(b)) >= 0.8),
f AS (SELECT p_partkey, product, a, max((EXISTS (SELECT 1 FROM r WHERE r.a = e.a AND list_contains(e.answer, r.b)))::INT) AS hit FROM e GROUP BY ALL)
SELECT p_partkey, round(avg(hit), 6) AS score, avg(hit) >= 0.5 AND coalesce(max(CASE WHEN a = product THEN hit END), 0) = 1 AS matched FROM f GROUP BY p_partkey""")
def fuzzy_component_match(spark, sf_dir):
    """Truth tokens: the words of the name; answers have them with an s, reversed or unchanged."""
    words = F.split("p_name", " ")
    rows = _table(spark, sf_dir, "part").select("p_partkey", words.alias("truth"), words[0].alias("product"), F.transform(words, lambda w: F.when(F.col("p_partkey") % 3 == 0, F.concat(w, F.lit("s"))).when(F.col("p_partkey") % 3 == 1, F.reverse(w)).otherwise(w)).alias("answer"))
    return _rounded(fuzzy.component_match(rows, "p_partkey", "truth", "answer", "product"))


_NAME = "trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g'))"
_WEAK = f"""WITH v AS (SELECT 'CWE-' || n_nationkey AS id, n_regionkey AS pillar, {_NAME} AS alias, n_name, n_nationkey FROM nation),
r AS (SELECT c_custkey, c_mktsegment, 'CWE-' || c_nationkey AS truth, CASE c_custkey % 7 WHEN 0 THEN 'CWE-' || c_nationkey WHEN 1 THEN a.n_name WHEN 2 THEN b.n_name WHEN 3 THEN 'Denial of Service' WHEN 4 THEN 'an unknown thing' WHEN 5 THEN CASE WHEN c_custkey % 2 = 0 THEN 'Region-' || (c_nationkey % 5) END WHEN 6 THEN 'cwe ' || ((c_nationkey + 1) % 25) END AS answer
  FROM customer JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON (c_nationkey + 5) % 25 = b.n_nationkey),
n AS (SELECT *, trim(regexp_replace(lower(answer), '[^a-z0-9]+', ' ', 'g')) AS norm FROM r),
b AS (SELECT 'region ' || n_regionkey AS term, 'CWE-' || n_nationkey AS id FROM nation WHERE n_nationkey % 2 = 0),
d AS (SELECT n.*, coalesce(x.id, y.id) AS resolved, coalesce(x.pillar, y.pillar) AS mine, t.pillar AS theirs FROM n LEFT JOIN v x ON n.norm = 'cwe ' || x.n_nationkey LEFT JOIN v y ON n.norm = y.alias LEFT JOIN v t ON n.truth = t.id),
w AS (SELECT *, CASE WHEN resolved = truth THEN 'correct' WHEN norm = 'denial of service' THEN 'consequence_not_mechanism' WHEN resolved IS NOT NULL AND mine = theirs THEN 'same_pillar_wrong_cwe' WHEN resolved IS NOT NULL THEN 'different_pillar'
  WHEN norm IN (SELECT term FROM b) THEN CASE WHEN EXISTS (SELECT 1 FROM b JOIN v ON b.id = v.id WHERE b.term = d.norm AND (b.id = d.truth OR v.pillar = d.theirs)) THEN 'same_pillar_wrong_cwe' ELSE 'different_pillar' END ELSE 'unmapped_or_absent' END AS verdict FROM d)"""


def label_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answers with their truths, the vocabulary and its alias index."""
    nation = _table(spark, sf_dir, "nation")
    vocabulary = nation.select(F.concat(F.lit("CWE-"), "n_nationkey").alias("id"), F.col("n_regionkey").alias("pillar"))
    index = labels.alias_index(nation.select(F.col("n_name").alias("alias"), F.concat(F.lit("CWE-"), "n_nationkey").alias("id")))
    own, next_ = (nation.select(F.col("n_nationkey").alias(k), F.col("n_name").alias(v)) for k, v in (("k0", "own"), ("k5", "other")))
    rows = _table(spark, sf_dir, "customer").withColumn("k0", F.col("c_nationkey")).withColumn("k5", (F.col("c_nationkey") + 5) % 25).join(own, "k0").join(next_, "k5")
    answer = F.expr("CASE c_custkey % 7 WHEN 0 THEN 'CWE-' || c_nationkey WHEN 1 THEN own WHEN 2 THEN other WHEN 3 THEN 'Denial of Service' WHEN 4 THEN 'an unknown thing' WHEN 5 THEN CASE WHEN c_custkey % 2 = 0 THEN 'Region-' || (c_nationkey % 5) END WHEN 6 THEN 'cwe ' || ((c_nationkey + 1) % 25) END")
    return rows.select("c_custkey", "c_mktsegment", answer.alias("answer"), F.array(F.concat(F.lit("CWE-"), "c_nationkey")).alias("truths")), vocabulary, index


def verdict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, vocabulary, index = label_rows(spark, sf_dir)
    return labels.layered_verdict(rows, "answer", "truths", labels.resolve(rows, "answer", index, vocabulary), vocabulary, region_terms(spark, sf_dir))


def region_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broad labels: a region's name for its even nations."""
    own = _table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0")
    return labels.broad_terms(own.select(F.concat(F.lit("REGION "), "n_regionkey").alias("term"), F.concat(F.lit("CWE-"), "n_nationkey").alias("id")), spark)


@query(_WEAK + " SELECT c_custkey, verdict, resolved FROM w")
def layered_verdicts(spark, sf_dir):
    return verdict_rows(spark, sf_dir).select("c_custkey", "verdict", "resolved")


@query(_WEAK + " SELECT c_mktsegment, count(*) AS n, round(count(*) FILTER (verdict = 'correct') / count(*), 6) AS strict_accuracy, " + ", ".join(f"count(*) FILTER (verdict = '{k}') AS n_{k}" for k in ("correct", "consequence_not_mechanism", "same_pillar_wrong_cwe", "different_pillar", "unmapped_or_absent")) + " FROM w GROUP BY ALL")
def layered_summary(spark, sf_dir):
    return _rounded(labels.verdict_summary(verdict_rows(spark, sf_dir), ["c_mktsegment"]))


@query(_WEAK + """, q AS (SELECT coalesce(norm, '__ABSENT__') AS norm, answer, c_mktsegment, c_custkey, truth, row_number() OVER (PARTITION BY coalesce(norm, '__ABSENT__') ORDER BY c_custkey) AS turn FROM n)
SELECT q.norm, arg_min(q.answer, c_custkey) AS first_form, count(*) AS n, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ';') AS systems, string_agg(c_custkey::VARCHAR, ';' ORDER BY turn) FILTER (turn <= 5) AS first_items,
array_to_string(list_sort(list(DISTINCT c_custkey % 2)), ';') AS conditions, array_to_string(list_sort(list(DISTINCT truth)), ';') AS truths_seen,
CASE WHEN q.norm = '__ABSENT__' THEN 'absent' WHEN any_value(v.id) IS NOT NULL THEN 'automatic' ELSE 'unresolved' END AS status FROM q LEFT JOIN v ON q.norm = v.alias GROUP BY q.norm""")
def prediction_inventory(spark, sf_dir):
    rows, _, index = label_rows(spark, sf_dir)
    out = labels.prediction_inventory(rows.withColumn("cond", F.col("c_custkey") % 2), "answer", "c_mktsegment", "cond", "c_custkey", "truths", "c_custkey", index)
    return out.withColumns({"systems": F.array_join("systems", ";"), "conditions": F.array_join(F.col("conditions").cast("array<string>"), ";"), "truths_seen": F.array_join("truths_seen", ";"), "first_items": F.array_join(F.col("first_items").cast("array<string>"), ";")})


@query("SELECT p_name || ' ' || p_size AS alias, array_to_string(list_sort(list(DISTINCT p_brand)), ';') AS ids, count(DISTINCT p_brand) > 1 AS ambiguous FROM part GROUP BY ALL")
def alias_index(spark, sf_dir):
    out = labels.alias_index(_table(spark, sf_dir, "part").select(F.concat_ws("-", "p_name", "p_size").alias("alias"), F.col("p_brand").alias("id")))
    return out.withColumn("ids", F.array_join("ids", ";"))


@query(V + """, g AS (SELECT item, model, count(*) FILTER (has_block) = 2 AS whole, min(predicted) IS NOT DISTINCT FROM max(predicted) AND count(predicted) IN (0, 2) AS alike FROM v GROUP BY ALL)
SELECT model, count(*) AS n_groups, count(*) FILTER (whole AND alike) AS n_stable, count(*) FILTER (whole) AS n_whole FROM g GROUP BY ALL""")
def repeat_stability(spark, sf_dir):
    return agreement.stability(eval_rows(spark, sf_dir), ["item", "model"], ["model"], "predicted", "has_block", 2)


@query(V + ", g AS (SELECT item, model, avg(CASE WHEN predicted = truth THEN 1.0::DOUBLE WHEN predicted IS NOT NULL THEN 0.0::DOUBLE END) FILTER (has_block) AS mean FROM v GROUP BY ALL) SELECT model, round(avg(mean), 6) AS accuracy, round(stddev_pop(mean), 6) AS deviation FROM g GROUP BY ALL")
def repeat_accuracy(spark, sf_dir):
    rows = eval_rows(spark, sf_dir).withColumn("verdict", F.when(F.col("has_block"), F.col("predicted") == F.col("truth")))
    return _rounded(agreement.repeat_accuracy(rows, "item", ["model"], "verdict"))


@query(_CLASS + " SELECT class, " + ", ".join(f"round(max(f1) FILTER (model = {m} AND cond = {c}), 6) AS f1_{m}_{c}" for m in range(3) for c in range(2)) + " FROM c GROUP BY ALL")
def f1_by_cell(spark, sf_dir):
    table = outcomes.per_class(outcomes.confusion(eval_rows(spark, sf_dir), CELL), CELL, CLASSES)
    return _rounded(outcomes.across_cells(table, CELL, [(m, c) for m in range(3) for c in range(2)]))


@query(V + " SELECT item FROM v WHERE outcome = 'Declined' GROUP BY item HAVING count(DISTINCT model) = 3")
def hard_core(spark, sf_dir):
    return selection.in_all(eval_rows(spark, sf_dir).filter("outcome = 'Declined'"), "item", "model", 3)


@query(V + " SELECT v.item, model, cond, CASE WHEN has_block THEN predicted END AS predicted, o_orderstatus AS status, o_orderpriority AS priority FROM v LEFT JOIN orders ON item = o_orderkey")
def consolidated(spark, sf_dir):
    rows = eval_rows(spark, sf_dir).select("item", "model", "cond", F.when(F.col("has_block"), F.col("predicted")).alias("predicted"))
    truth = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    out = responses.consolidate([rows.filter("cond = 0"), rows.filter("cond = 1")], truth, "item", ["predicted"])
    return out.select("item", "model", "cond", "extracted.predicted", "ground_truth.status", "ground_truth.priority")


_OLD = "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 10 <> 0"
_NEW = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 13 <> 0"


@query(f"""SELECT * FROM (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'removed' WHEN a.o_orderkey IS NULL THEN 'added' ELSE 'kept' END AS status,
CASE WHEN a.o_orderkey IS NULL OR b.o_orderkey IS NULL THEN NULL ELSE concat_ws(';', CASE WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN a.o_orderpriority IS DISTINCT FROM b.o_orderpriority THEN 'o_orderpriority' END) END AS changed
FROM ({_OLD}) a FULL JOIN ({_NEW}) b ON a.o_orderkey = b.o_orderkey) WHERE status <> 'kept' OR changed <> ''""")
def snapshot_diff(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    old, new = (spark.sql(q.replace("FROM orders", "FROM {orders}"), orders=orders) for q in (_OLD, _NEW))
    return dataset.snapshot_diff(old, new, "o_orderkey", ["o_orderstatus", "o_orderpriority"]).withColumn("changed", F.array_join("changed", ";"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate::DATE BETWEEN (SELECT min(o_orderdate)::DATE FROM orders) + 10 AND (SELECT min(o_orderdate)::DATE FROM orders) + 400")
def date_window(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders")
    first = rows.agg(F.to_date(F.min("o_orderdate")).alias("first")).first()["first"]
    return selection.date_window(rows, "o_orderdate", F.date_add(F.lit(first), 10), F.date_add(F.lit(first), 400)).select("o_orderkey")


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word ORDER BY n DESC, word LIMIT 5")
def top_values(spark, sf_dir):
    return selection.top_values(_table(spark, sf_dir, "part").select(F.split("p_name", " ").alias("words")), "words", "word", 5)


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def excluded_ids(spark, sf_dir):
    used = _table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return selection.without(_table(spark, sf_dir, "customer").select("c_custkey"), used, "c_custkey")


@query("SELECT o_custkey, count(*) AS n FROM orders SEMI JOIN customer ON o_custkey = c_custkey AND c_mktsegment = 'BUILDING' GROUP BY ALL")
def leaked_ids(spark, sf_dir):
    own = _table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return selection.leaked(_table(spark, sf_dir, "orders"), own, "o_custkey")


@query("""WITH r AS (SELECT *, md5(o_orderkey::VARCHAR || ':42') AS draw FROM orders), c AS (SELECT *, row_number() OVER (ORDER BY o_orderpriority, o_orderstatus) AS place, count(*) OVER () AS k FROM (SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders)),
t AS (SELECT r.*, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY draw, o_orderkey) AS turn FROM r)
SELECT o_orderkey, t.o_orderpriority, t.o_orderstatus FROM t JOIN c ON t.o_orderpriority = c.o_orderpriority AND t.o_orderstatus = c.o_orderstatus WHERE turn <= 200 // k + CASE WHEN place <= 200 % k THEN 1 ELSE 0 END""")
def stratified_sample(spark, sf_dir):
    return dataset.stratified_sample(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), ["o_orderpriority", "o_orderstatus"], "o_orderkey", 200, 42)


@query("SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey::VARCHAR || ':42'), o_orderkey LIMIT 100")
def seeded_sample(spark, sf_dir):
    return selection.seeded_sample(_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100, 42)


@query(V + ", g AS (SELECT item, model, min(ok) AS lo, max(ok) AS hi FROM (SELECT item, model, CASE WHEN predicted IS NOT NULL THEN predicted = truth END AS ok FROM v) GROUP BY ALL) SELECT model, 'ok' AS field, count(*) AS n_groups, count(*) FILTER (lo = hi) AS n_agree, round(count(*) FILTER (lo = hi) / count(*), 6) AS rate FROM g WHERE lo IS NOT NULL GROUP BY ALL")
def verdict_agreement(spark, sf_dir):
    rows = eval_rows(spark, sf_dir).withColumn("ok", agreement.nullable_verdict(F.col("predicted"), F.col("truth")))
    return _rounded(agreement.verdict_agreement(rows, ["item", "model"], ["model"], ["ok"]))


@query(V + """, f AS (SELECT model, cond, truth AS field, avg((outcome = 'Correct')::INT) AS rate FROM v GROUP BY ALL)
SELECT model, count(DISTINCT field) AS n_fields, round(avg(rate) FILTER (cond = 0), 6) AS "before", round(avg(rate) FILTER (cond = 1), 6) AS "after", round(avg(rate) FILTER (cond = 1) - avg(rate) FILTER (cond = 0), 6) AS change FROM f GROUP BY ALL""")
def mean_change(spark, sf_dir):
    """Fields: the truths' classes stand for them."""
    rates = eval_rows(spark, sf_dir).groupBy("model", "cond", F.col("truth").alias("field")).agg(F.avg((F.col("outcome") == "Correct").cast("double")).alias("rate"))
    return _rounded(paired.mean_change(rates, "model", "cond", "field", "rate", 0, 1))


@query(V + ", u AS (SELECT * FROM v WHERE (item + model * 3 + cond) % 5 <> 0), i AS (SELECT item, bool_or(model = 0 AND cond = 0) AS a, bool_or(model = 0 AND cond = 1) AS b FROM u GROUP BY ALL) SELECT count(*) FILTER (a <> b) AS unmatched, count(*) FILTER (NOT (a AND b)) AS lacking FROM i")
def dropped_items(spark, sf_dir):
    return paired.dropped_items(eval_rows(spark, sf_dir).filter("(item + model * 3 + cond) % 5 <> 0"), "item", "model", "cond", (0, 0), (0, 1))


@query(V + ", u AS (SELECT item, model, cond, CASE WHEN item % 9 > 0 THEN truth END AS truth FROM v WHERE (item + model * 3 + cond) % 5 <> 0) SELECT (SELECT count(*) FROM u) AS rows, (SELECT count(*) FROM u WHERE truth IS NULL) AS without_truth, (SELECT count(*) * 6 FROM orders) AS expected, (SELECT count(*) FROM u) = (SELECT count(*) * 6 FROM orders) AS complete")
def consolidation_check(spark, sf_dir):
    rows = eval_rows(spark, sf_dir).filter("(item + model * 3 + cond) % 5 <> 0").withColumn("truth", F.expr("CASE WHEN item % 9 > 0 THEN truth END"))
    return verify.consolidation_check(rows, _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item")), "item", "truth", 3, 2)


@query(V + " SELECT item, count(*) AS rows FROM v WHERE (item + model * 3 + cond) % 5 <> 0 GROUP BY item HAVING count(*) <> 5")
def wrong_row_counts(spark, sf_dir):
    return verify.wrong_row_counts(eval_rows(spark, sf_dir).filter("(item + model * 3 + cond) % 5 <> 0"), "item", 5)


@query("SELECT o_orderpriority, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS o_orderpriority FROM orders) WHERE o_orderpriority IS NULL OR o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY ALL")
def odd_truths(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select(F.expr("CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END").alias("o_orderpriority"))
    return verify.odd_truths(rows, "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query("""WITH n AS (SELECT 'CWE-' || p_size AS id, p_name || ' (' || p_brand || ')' AS name, p_brand, p_name FROM part), a AS (
SELECT trim(regexp_replace(regexp_replace(lower(name), '[-_/().]', ' ', 'g'), ' +', ' ', 'g')) AS alias, id FROM n UNION SELECT lower(p_brand), id FROM n) SELECT alias, count(*) AS n_ids FROM a GROUP BY alias""")
def alias_draft(spark, sf_dir):
    names = _table(spark, sf_dir, "part").select(F.concat(F.lit("CWE-"), "p_size").alias("id"), F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")).alias("name"))
    return labels.alias_draft(names).groupBy("alias").agg(F.count("*").alias("n_ids"))
