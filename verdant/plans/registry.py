"""All queries of the evaluation library, by name, and the SQL that repeats them.

Inputs are derived from the given tables with integer arithmetic only, so that both engines make the
same rows; the derivation is one SQL text, the work on it is the library's operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdant.functions import normalize as N
from verdant.operators import agreement, bootstrap, dataset, declines, outcomes, paired, responses, verify

CLASSES = ["NONE", "LOW", "HIGH"]
CELL = ["model", "cond"]


P = 2147483647


def _mixed(x: str, source: str, keep: str) -> str:
    """h: 0 to 99, well mixed, from an integer expression: three rounds of m = (m * m + 12345) % P."""
    step = f"(m * m + 12345) % {P} AS m"
    return f"SELECT {keep}, m % 100 AS h FROM (SELECT {keep}, {step} FROM (SELECT {keep}, {step} FROM (SELECT {keep}, {step} FROM (SELECT {keep}, ({x}) % {P} AS m FROM {source}))))"


def _mixed_once(x: str, source: str, keep: str) -> str:
    """The same for Spark, which would write nested squares out in full when it merges projections."""
    return f"SELECT {keep}, aggregate(array(1, 2, 3), cast(({x}) % {P} AS bigint), (m, i) -> (m * m + 12345) % {P}) % 100 AS h FROM {source}"


_GRID = "(SELECT o_orderkey, o_orderstatus, model, cond FROM {orders} CROSS JOIN (SELECT 0 AS model UNION ALL SELECT 1 AS model UNION ALL SELECT 2 AS model) CROSS JOIN (SELECT 0 AS cond UNION ALL SELECT 1 AS cond))"


def _eval(mixed) -> str:
    return f"""
SELECT o_orderkey AS item, model, cond, truth, h < 96 AS has_block,
  CASE WHEN h < 40 THEN ' ' || lower(truth) || ' ' WHEN h < 55 THEN truth WHEN h < 62 THEN substr(truth, 1, 1)
       WHEN h < 75 THEN CASE truth WHEN 'NONE' THEN 'Low' WHEN 'LOW' THEN 'High' ELSE 'None' END
       WHEN h < 80 THEN 'maybe' END AS raw
FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'NONE' WHEN 'O' THEN 'LOW' ELSE 'HIGH' END AS truth
      FROM ({mixed("o_orderkey * 6 + model * 2 + cond + 101", _GRID, "o_orderkey, o_orderstatus, model, cond")}))
"""


VERDICTS = """
SELECT *, CASE WHEN NOT has_block THEN 'Malformed' WHEN raw IS NULL THEN 'Declined' WHEN predicted IS NULL THEN 'Unmapped'
               WHEN predicted = truth THEN 'Correct' ELSE 'Incorrect' END AS outcome
FROM (SELECT *, CASE WHEN upper(trim(raw)) IN ('NONE', 'LOW', 'HIGH') THEN upper(trim(raw)) WHEN upper(trim(raw)) = 'N' THEN 'NONE'
                     WHEN upper(trim(raw)) = 'L' THEN 'LOW' WHEN upper(trim(raw)) = 'H' THEN 'HIGH' END AS predicted FROM (EVAL_SQL))
""".replace("EVAL_SQL", _eval(_mixed).replace("{orders}", "orders"))
V = f"WITH v AS ({VERDICTS})"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_eval(_mixed_once), orders=_table(spark, sf_dir, "orders"))
    rows = rows.withColumn("predicted", N.impact_label(F.col("raw"), CLASSES))
    return rows.withColumn("outcome", outcomes.closed_class_outcome(F.col("has_block"), F.col("raw"), F.col("predicted"), F.col("truth")))


QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})


_CONF = V + ", m AS (SELECT model, cond, truth, CASE WHEN outcome IN ('Correct', 'Incorrect') THEN predicted ELSE outcome END AS seen, count(*) AS n FROM v GROUP BY ALL)"
_CLASS = _CONF + """, k AS (SELECT unnest(['NONE', 'LOW', 'HIGH']) AS class),
s AS (SELECT model, cond, class, coalesce(sum(n) FILTER (truth = class AND seen = class), 0)::BIGINT AS tp,
  coalesce(sum(n) FILTER (truth <> class AND seen = class), 0)::BIGINT AS fp, coalesce(sum(n) FILTER (truth = class AND seen <> class), 0)::BIGINT AS fn FROM m, k GROUP BY ALL),
pr AS (SELECT *, tp + fn AS support, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall FROM s),
c AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pr)"""


@query(_CLASS + """ SELECT a.model, a.cond, n, round(accuracy, 6) AS accuracy, round(commit_rate, 6) AS commit_rate, round(1 - commit_rate, 6) AS no_prediction_rate, round(macro_f1, 6) AS macro_f1, round(macro_f1_supported, 6) AS macro_f1_supported
FROM (SELECT model, cond, count(*) AS n, count(*) FILTER (outcome = 'Correct') / count(*) AS accuracy, count(*) FILTER (outcome IN ('Correct', 'Incorrect')) / count(*) AS commit_rate FROM v GROUP BY ALL) a
JOIN (SELECT model, cond, avg(f1) AS macro_f1, avg(f1) FILTER (support >= 20) AS macro_f1_supported FROM c GROUP BY ALL) b ON a.model = b.model AND a.cond = b.cond""")
def score_table(spark, sf_dir):
    return _rounded(outcomes.scores(eval_rows(spark, sf_dir), CELL, CLASSES))


@query(V + " SELECT model, cond, " + ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o.lower()}" for o in outcomes.OUTCOMES) + ", count(*) AS n FROM v GROUP BY ALL")
def outcome_counts(spark, sf_dir):
    return outcomes.outcome_counts(eval_rows(spark, sf_dir), CELL)


@query(_CONF + " SELECT * FROM m")
def confusion_matrix(spark, sf_dir):
    return outcomes.confusion(eval_rows(spark, sf_dir), CELL)


@query(_CLASS + " SELECT model, cond, class, tp, fp, fn, support, round(precision, 6) AS precision, round(recall, 6) AS recall, tp + fp = 0 AS precision_undefined, round(f1, 6) AS f1 FROM c")
def per_class_metrics(spark, sf_dir):
    return _rounded(outcomes.per_class(outcomes.confusion(eval_rows(spark, sf_dir), CELL), CELL, CLASSES))


_D = V + ", d AS (SELECT item, count(DISTINCT model) AS n_systems, list_sort(list(DISTINCT model)) AS systems FROM v WHERE outcome = 'Declined' GROUP BY item)"


@query(_D + " SELECT n_systems, count(*) AS n_items FROM d GROUP BY ALL")
def decline_overlap(spark, sf_dir):
    return declines.overlap_histogram(declines.declined_by(eval_rows(spark, sf_dir), "item", "model"))


@query(_D + " SELECT system, count(*) AS n_declined, count(*) FILTER (n_systems = 1) AS n_unique FROM (SELECT n_systems, unnest(systems) AS system FROM d) GROUP BY ALL")
def decline_sets(spark, sf_dir):
    return declines.system_sets(declines.declined_by(eval_rows(spark, sf_dir), "item", "model"))


@query(_D.replace("FROM v WHERE", "FROM u WHERE").replace(", d AS", ", u AS (SELECT * FROM v WHERE (item + model) % 7 <> 0), d AS") + """, top AS (SELECT system AS top FROM (SELECT unnest(systems) AS system FROM d) GROUP BY system ORDER BY count(*) DESC, system LIMIT 1),
i AS (SELECT item, top FROM d, top WHERE list_contains(systems, top)),
o AS (SELECT i.item, m.model, coalesce((SELECT bool_and(outcome <> 'Correct') FROM u WHERE u.item = i.item AND u.model = m.model), true) AS w FROM i, (SELECT DISTINCT model FROM u) m WHERE m.model <> i.top),
e AS (SELECT item, bool_and(w) AS a, bool_or(w) AS s FROM o GROUP BY ALL)
SELECT CASE WHEN a THEN 'all wrong' WHEN NOT s THEN 'none wrong' ELSE 'mixed' END AS verdict, count(*) AS n_items FROM e GROUP BY ALL""")
def decline_cross_reference(spark, sf_dir):
    """A seventh of the (item, system) pairs has no rows: such a system counts as wrong on the item."""
    rows = eval_rows(spark, sf_dir).filter("(item + model) % 7 <> 0")
    return declines.cross_reference(rows, declines.declined_by(rows, "item", "model"), "item", "model")


_PAIRS = V + """, w AS (SELECT item, model, cond, outcome = 'Correct' AS ok FROM v),
q AS (SELECT x.model AS system_a, x.cond AS condition_a, y.model AS system_b, y.cond AS condition_b, count(*) FILTER (x.ok AND y.ok) AS "both", count(*) FILTER (x.ok AND NOT y.ok) AS b,
  count(*) FILTER (NOT x.ok AND y.ok) AS c, count(*) FILTER (NOT x.ok AND NOT y.ok) AS neither, count(*) AS n
FROM w x JOIN w y ON x.item = y.item AND (x.model, x.cond) < (y.model, y.cond) AND ((x.model = y.model) <> (x.cond = y.cond)) GROUP BY ALL)"""


@query(_PAIRS + """ SELECT *, CASE WHEN b > c THEN 'a' WHEN b < c THEN 'b' ELSE 'neither' END AS favours,
round(CASE WHEN b + c >= 25 THEN pow(abs(b - c) - 1, 2) / (b + c) END, 6) AS statistic FROM q""")
def paired_mcnemar_counts(spark, sf_dir):
    rows = eval_rows(spark, sf_dir).withColumn("ok", F.col("outcome") == "Correct")
    return _rounded(paired.mcnemar(paired.paired_counts(rows, "item", "model", "cond", "ok")).drop("p"))


@query(_PAIRS + f""", t AS (SELECT *, CASE WHEN b > c THEN 'a' WHEN b < c THEN 'b' ELSE 'neither' END AS favours, CASE WHEN b + c >= 25 THEN pow(abs(b - c) - 1, 2) / (b + c) END AS statistic FROM q),
z AS (SELECT *, CASE WHEN b + c = 0 THEN 1.0 WHEN b + c < 25 THEN least(1.0, 2 * pow(0.5, b + c) * list_sum([factorial((b + c)::INT) / (factorial(k::INT) * factorial((b + c - k)::INT)) FOR k IN range(least(b, c) + 1)])) ELSE {paired.chi_tail_sql("statistic")} END AS p FROM t),
h AS (SELECT *, least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY p, system_a, condition_a, system_b, condition_b) + 1)) AS raw FROM z)
SELECT system_a, condition_a, system_b, condition_b, "both", b, c, neither, n, favours, round(statistic, 6) AS statistic, round(p, 6) AS p, 'all' AS family,
round(max(raw) OVER w, 6) AS p_holm, max(raw) OVER w < 0.05 AS significant FROM h WINDOW w AS (ORDER BY p, system_a, condition_a, system_b, condition_b)""")
def paired_mcnemar_holm(spark, sf_dir):
    rows = eval_rows(spark, sf_dir).withColumn("ok", F.col("outcome") == "Correct")
    tests = paired.mcnemar(paired.paired_counts(rows, "item", "model", "cond", "ok")).withColumn("family", F.lit("all"))
    return _rounded(paired.holm(tests, ["family"], ["system_a", "condition_a", "system_b", "condition_b"]))


@query(V + " SELECT rows, count(*) AS n_items FROM (SELECT item, count(*) AS rows FROM v GROUP BY item) GROUP BY ALL")
def rows_per_item(spark, sf_dir):
    return verify.rows_per_item(eval_rows(spark, sf_dir), "item")


@query(V + " SELECT model, cond, count(*) AS n FROM v GROUP BY CUBE (model, cond)")
def structure_marginals(spark, sf_dir):
    return verify.marginals(eval_rows(spark, sf_dir), "model", "cond")


@query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING min(l_returnflag) <> max(l_returnflag)")
def inconsistent_truth(spark, sf_dir):
    return verify.inconsistent_truth(_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")


@query("SELECT o_orderpriority AS label, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM orders), 6) AS percent, count(*) < 20 AS thin FROM orders GROUP BY ALL")
def label_distribution(spark, sf_dir):
    return _rounded(verify.label_distribution(_table(spark, sf_dir, "orders"), "o_orderkey", "o_orderpriority"))


@query(V + " SELECT raw, count(*) AS n FROM v GROUP BY ALL")
def value_harvest(spark, sf_dir):
    return verify.value_harvest(eval_rows(spark, sf_dir), "raw")


@query(V + " SELECT model, cond, count(*) FILTER (raw IS NULL) AS n_null, count(*) FILTER (raw IS NULL AND has_block) AS n_null_valid FROM v GROUP BY CUBE (model, cond)")
def null_breakdown(spark, sf_dir):
    return verify.null_breakdown(eval_rows(spark, sf_dir), "model", "cond", "raw", "has_block")


@query(V + """ SELECT model, cond, count(*) FILTER (has_block) AS n_valid, count(*) FILTER (NOT has_block) AS n_invalid, round(count(*) FILTER (NOT has_block) / count(*), 6) AS failure_rate,
CASE WHEN count(*) FILTER (NOT has_block) / count(*) <= 0.05 THEN 'PROCEED' ELSE 'STOP' END AS verdict FROM v GROUP BY ALL""")
def coverage(spark, sf_dir):
    return _rounded(verify.coverage(eval_rows(spark, sf_dir), CELL, "has_block"))


@query("""WITH p AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY ALL), t AS (SELECT sum(n) AS n, sum(n) FILTER (a = b) / sum(n) AS po,
(sum(n) FILTER (a = 0)) / sum(n) * ((sum(n) FILTER (b = 0)) / sum(n)) + (sum(n) FILTER (a = 1)) / sum(n) * ((sum(n) FILTER (b = 1)) / sum(n)) AS pe FROM p)
SELECT n::BIGINT AS n, round(po, 6) AS po, round(pe, 6) AS pe, round((po - pe) / (1 - pe), 6) AS kappa, CASE WHEN (po - pe) / (1 - pe) >= 0.8 THEN 'Almost perfect' WHEN (po - pe) / (1 - pe) >= 0.6 THEN 'Substantial'
WHEN (po - pe) / (1 - pe) >= 0.4 THEN 'Moderate' WHEN (po - pe) / (1 - pe) >= 0.2 THEN 'Fair' ELSE 'Slight' END AS band FROM t""")
def annotator_kappa(spark, sf_dir):
    return _rounded(agreement.kappa(_table(spark, sf_dir, "labels"), "quality", "toxic", [0, 1]))


@query("SELECT event_id, ts, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def first_seen(spark, sf_dir):
    return dataset.first_seen(_table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("event_id", "ts", "user_id", "event_type", "value")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def last_wins(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return dataset.last_wins(rows.withColumn("seq", F.col("event_id")), ["user_id", "event_type"], "seq").select("user_id", "event_type", "event_id", "value")


@query("SELECT o_orderkey, day FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m-%d') ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r <= 5")
def cap_per_day(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").withColumn("day", dataset.publication_day(F.date_format("o_orderdate", "yyyy-MM-dd")))
    return dataset.capped(rows, ["day"], ["o_orderdate", "o_orderkey"], 5).select("o_orderkey", "day")


_DAYS = "SELECT o_orderkey, o_orderdate, date_diff('day', o_orderdate::DATE, (SELECT max(o_orderdate)::DATE FROM orders)) AS d FROM orders"


@query(f"SELECT o_orderkey, slice FROM (SELECT o_orderkey, o_orderdate, CASE WHEN d <= 2 THEN 0 ELSE ceil(d / 2) - 1 END::INTEGER AS slice FROM ({_DAYS})) ORDER BY slice, o_orderdate, o_orderkey LIMIT 500")
def walk_back_slices(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders")
    anchor = rows.agg(F.max("o_orderdate").alias("anchor"))
    days = F.date_diff(F.to_date("anchor"), F.to_date("o_orderdate"))
    own = rows.crossJoin(F.broadcast(anchor)).withColumn("slice", dataset.slice_number(days))
    return own.orderBy("slice", "o_orderdate", "o_orderkey").limit(500).select("o_orderkey", "slice")


_CPE = "'cpe:2.3:a:' || lower(replace(p_brand, '#', '_')) || ':' || replace(p_name, ' ', '_') || ':*:*'"


@query("SELECT p_partkey, lower(replace(p_brand, '#', ' ')) || ' ' || p_name AS component FROM part")
def cpe_components(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").withColumn("cpe", F.expr(_CPE))
    return rows.select("p_partkey", dataset.cpe_component(F.col("cpe")).alias("component"))


@query("""WITH g AS (SELECT o_orderkey AS item, model, cond FROM orders, (SELECT unnest([0, 1, 2]) AS model), (SELECT unnest([0, 1]) AS cond))
SELECT g.item, g.model, g.cond, 1 AS rep FROM g LEFT JOIN (""" + V.removeprefix("WITH v AS (")[:-1] + """) v ON g.item = v.item AND g.model = v.model AND g.cond = v.cond AND v.has_block WHERE v.item IS NULL""")
def pending_work(spark, sf_dir):
    done = eval_rows(spark, sf_dir).withColumn("valid", F.col("has_block")).withColumn("rep", F.lit(1))
    items = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"))
    return dataset.pending_work(items, done, [0, 1, 2], [0, 1], 1, "item")


_RAW = "CASE WHEN event_id % 7 = 0 THEN 'sorry' WHEN event_id % 7 = 1 THEN '```json {{\"k\": 1, \"v\": \"' || event_type || '\"}} ```' WHEN event_id % 7 = 2 THEN '{{\"k\": 1}}' WHEN event_id % 7 = 3 THEN '{{\"k\": 1, \"v\": \"x\", \"z\": 2}}' WHEN event_id % 7 = 4 THEN '{{\"k\": 1, \"v\": null}}' WHEN event_id % 7 = 5 THEN '{{\"k\": 1, \"v\": \"click\"}} tail' ELSE '{{\"k\": 1, \"v\": \"' || event_type || '\"}}' END".replace("{{", "{").replace("}}", "}")


@query("""SELECT event_id, event_id % 7 IN (1, 4, 6) AS valid, CASE WHEN event_id % 7 IN (1, 6) THEN event_type WHEN event_id % 7 = 3 THEN 'x' END AS v,
CASE event_id % 7 WHEN 0 THEN 'not a JSON object' WHEN 5 THEN 'not a JSON object' WHEN 2 THEN 'missing: v' WHEN 3 THEN 'extra: z; bad value: v' ELSE '' END AS notes FROM events""")
def validate_responses(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    kinds = ["click", "view", "purchase", "signup", "scroll", "search", "login", "logout", "error", "cart", "add_to_cart", "refund"]
    out = responses.validated(events.withColumn("raw", F.expr(_RAW)), "raw", ["k", "v"], {"v": kinds})
    return out.select("event_id", "valid", "v", F.array_join("notes", "; ").alias("notes"))


@query("""WITH r AS (SELECT user_id % 3 AS model, value AS latency, length(props) AS tokens_in, user_id AS tokens_out FROM events), a AS (SELECT model, count(*) AS n, avg(latency) AS mean_latency, sum(latency) AS total_latency,
sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out FROM r GROUP BY ALL)
SELECT model, n, round(mean_latency, 6) AS mean_latency, round(total_latency, 6) AS total_latency, tokens_in, tokens_out, round((tokens_in * (model + 1.0::DOUBLE) + tokens_out * (10.0::DOUBLE * (model + 1))) / 1e6, 6) AS cost,
round((tokens_in * (model + 1.0::DOUBLE) + tokens_out * (10.0::DOUBLE * (model + 1))) / 1e6 / n * 1000000, 6) AS projected FROM a""")
def latency_and_cost(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("model"), F.col("value").alias("latency"), F.length("props").alias("tokens_in"), F.col("user_id").alias("tokens_out"))
    prices = spark.range(3).select(F.col("id").alias("model"), (F.col("id") + 1.0).alias("price_in"), (10.0 * (F.col("id") + 1)).alias("price_out"))
    return _rounded(responses.latency_and_cost(rows, prices))


