"""Queries over matched answers, truth inventories, label sheets, look-back windows and repeats.

Parts stand for items with named truths; their brands and names give components and answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.functions import matching as M
from verdant.operators import inventory, labels, matcher, responses, selection
from verdant.plans.labelled import _WEAK, label_rows
from verdant.plans.registry import _CPE, _RAW, V, _rounded, _table, eval_rows, query


def _listed(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_ANSWERS = """CASE p_partkey % 8 WHEN 0 THEN 'Buffer Overflow' WHEN 1 THEN upper(p_name) WHEN 2 THEN 'Improper use' WHEN 3 THEN p_name || ' / Injection'
 WHEN 4 THEN 'SQL injection and use-after-free' WHEN 5 THEN 'CSV/Formula Injection' WHEN 7 THEN 'Unbounded ' || p_name END"""
_IDS = "CASE p_partkey % 3 WHEN 0 THEN {0}'CWE-121'{1} WHEN 1 THEN {0}'CWE-' || p_size{1} ELSE {0}'CWE-79', 'CWE-416'{1} END"
_NAMES = "CASE p_partkey % 3 WHEN 0 THEN {0}'Stack-based Buffer Overflow'{1} WHEN 1 THEN {0}p_name{1} ELSE {0}p_name, 'Use After Free'{1} END"
_HUMAN = "CASE p_size % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'family' WHEN 2 THEN 'partial' ELSE 'miss' END"


def _norm(x: str) -> str:
    return f"""trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[-()''",;:]', ' ', 'g'), '\\s+', ' ', 'g'))"""


def _content(x: str) -> str:
    return f"[t for t in list_distinct(string_split({_norm(x)}, ' ')) if t not in ('', {_listed(M.MATCHER_STOPWORDS)})]"


def _pairs(table: dict[str, list[str]]) -> str:
    return ", ".join(f"('{k}', '{v}')" for k, terms in table.items() for v in terms)


_MATCH = f"""WITH al(id, term) AS (VALUES {_pairs(matcher.CANONICAL_ALIASES)}), fa(id, term) AS (VALUES {_pairs(matcher.FAMILY_TERMS)}),
p AS (SELECT p_partkey, p_brand, {_ANSWERS} AS answer, {_NAMES.format("[", "]")} AS names, {_IDS.format("[", "]")} AS ids, {_HUMAN} AS human FROM part),
f AS (SELECT p_partkey, CASE WHEN lower(trim(answer)) IN ({_listed(M.COMPOUND_TERMS)}) THEN [trim(answer)] ELSE [trim(q) for q in string_split_regex(answer, '(?i)\\s*/\\s*|\\s*;\\s*|\\s+and\\s+') if trim(q) <> ''] END AS parts FROM p WHERE answer IS NOT NULL),
g AS (SELECT p_partkey, unnest(parts) AS part FROM f), h AS (SELECT p_partkey, unnest(names) AS name, unnest(ids) AS id FROM p),
x AS (SELECT DISTINCT g.p_partkey, id, {_norm("part")} AS t, {_content("part")} AS a, {_content("name")} AS b FROM g JOIN h ON g.p_partkey = h.p_partkey),
r AS (SELECT p_partkey, max(CASE WHEN EXISTS (SELECT 1 FROM al WHERE al.id = x.id AND (contains(t, {_norm("term")}) OR contains({_norm("term")}, t))) THEN 3
  WHEN len(a) > 0 AND len(b) > 0 AND list_has_all(b, a) AND NOT list_has_all(a, b) THEN CASE WHEN list_has_any([w for w in b if NOT list_contains(a, w)], [{_listed(matcher.SPECIFICITY_WORDS)}]) THEN 2 ELSE 3 END
  WHEN len(a) > 0 AND len(b) > 0 AND list_has_all(a, b) THEN 3 WHEN EXISTS (SELECT 1 FROM fa WHERE fa.id = x.id AND contains(t, term)) THEN 2 ELSE 0 END) AS best FROM x GROUP BY ALL),
m AS (SELECT p.*, CASE WHEN len(parts) > 1 AND len(ids) <= 1 THEN CASE WHEN best >= 2 THEN 'partial' ELSE 'miss' END WHEN best = 3 THEN 'exact' WHEN best = 2 THEN 'family' ELSE 'miss' END AS "match"
  FROM p LEFT JOIN f ON p.p_partkey = f.p_partkey LEFT JOIN r ON p.p_partkey = r.p_partkey)"""


def matched_rows(spark, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", F.expr(_ANSWERS).alias("answer"), F.expr(_NAMES.format("array(", ")")).alias("names"), F.expr(_IDS.format("array(", ")")).alias("ids"), F.expr(_HUMAN).alias("human"))
    return matcher.four_way_match(rows, "answer", "names", "ids")


@query(_MATCH + """ SELECT p_partkey, "match", "match" = 'exact' AS strict, "match" IN ('exact', 'family') AS lenient FROM m""")
def four_way_match(spark, sf_dir):
    return matched_rows(spark, sf_dir).select("p_partkey", "match", "strict", "lenient")


@query(_MATCH + " SELECT p_brand, count(*) AS n, " + ", ".join(f"""count(*) FILTER ("match" = '{k}') AS n_{k}""" for k in ("exact", "family", "partial", "miss")) + """,
round(count(*) FILTER ("match" = 'exact') / count(*), 6) AS strict_rate, round(count(*) FILTER ("match" IN ('exact', 'family')) / count(*), 6) AS lenient_rate FROM m GROUP BY ALL""")
def match_hit_rates(spark, sf_dir):
    return _rounded(matcher.hit_rates(matched_rows(spark, sf_dir), ["p_brand"]))


@query(_MATCH + """ SELECT "match", human, count(*) AS n, "match" = human AS agree, round(count(*) / (SELECT count(*) FROM m), 6) AS share FROM m GROUP BY ALL""")
def matcher_agreement(spark, sf_dir):
    rows = matched_rows(spark, sf_dir)
    return _rounded(matcher.label_agreement(rows, rows.select("p_partkey", "human"), "p_partkey", "match", "human"))


@query(_MATCH + """ SELECT p_partkey, "match", human FROM m WHERE "match" <> human""")
def matcher_disagreements(spark, sf_dir):
    rows = matched_rows(spark, sf_dir)
    return matcher.disagreements(rows.select("p_partkey", "match"), rows.select("p_partkey", "human"), "p_partkey", "match", "human")


_TEXT = "CASE WHEN p_partkey % 9 > 0 THEN ' ' || p_brand || ' & (' || p_name || ')/[x_y]; \"it''s\" + -' END"


@query(f"""WITH p AS (SELECT p_partkey, {_TEXT} AS t, CASE p_partkey % 4 WHEN 0 THEN ' Adjacent ' WHEN 1 THEN 'LOCAL' WHEN 2 THEN p_name END AS v FROM part)
SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(trim(lower(coalesce(t, ''))), '&', ' and ', 'g'), '[-_/"''`(),.:;{{}}\\[\\]]', ' ', 'g'), '\\s+', ' ', 'g')) AS inventory,
{_norm("t")} AS matcher, nullif(trim(regexp_replace(regexp_replace(trim(lower(t)), '[^a-z0-9 _/-]', ' ', 'g'), '\\s+', ' ', 'g')), '') AS repeated,
CASE lower(trim(v)) WHEN 'adjacent' THEN 'ADJACENT_NETWORK' WHEN 'local' THEN 'LOCAL' END AS vector FROM p""")
def label_normalisers(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").withColumn("t", F.expr(_TEXT)).withColumn("v", F.expr("CASE p_partkey % 4 WHEN 0 THEN ' Adjacent ' WHEN 1 THEN 'LOCAL' WHEN 2 THEN p_name END"))
    return rows.select("p_partkey", M.inventory_label(F.col("t")).alias("inventory"), M.matcher_text(F.col("t")).alias("matcher"), M.repeat_label(F.col("t")).alias("repeated"), M.by_synonym(F.col("v"), M.VECTOR_SYNONYMS).alias("vector"))


_VALUE = "CASE l_partkey % 3 WHEN 0 THEN 'NVD-CWE-Other' WHEN 1 THEN 'NVD-CWE-noinfo' ELSE 'CWE-' || l_partkey END"


@query(f"""SELECT o.l_orderkey, f.value AS weakness FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN (SELECT l_orderkey, value FROM (SELECT l_orderkey, {_VALUE} AS value,
row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem WHERE l_suppkey % 3 <> 0 AND l_partkey % 3 = 2) WHERE r = 1) f ON o.l_orderkey = f.l_orderkey""")
def first_weakness(spark, sf_dir):
    each = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", F.expr(f"array(named_struct('lang', CASE WHEN l_suppkey % 3 = 0 THEN 'es' ELSE 'en' END, 'value', {_VALUE}))").alias("description")).alias("w"))
    rows = each.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("w")).alias("weaknesses"))
    return rows.select("l_orderkey", inventory.first_weakness().alias("weakness"))


_ONE, _TWO = (f"lower(replace(p_brand, '#', ' ')) || ' ' || {x}" for x in ("p_name", "split_part(p_name, ' ', 1)"))


@query(f"""SELECT p_partkey, {_ONE} AS old, {_ONE} || '; ' || {_TWO} AS "new" FROM part WHERE p_partkey % 4 > 0 AND p_partkey % 3 = 0""")
def recomputed_components(spark, sf_dir):
    second = _CPE.replace("p_name", "split_part(p_name, ' ', 1)")
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.expr(f"array({_CPE}, {second}, {_CPE}, 'cpe:2.3:a')").alias("cpes"), F.expr(f"CASE WHEN p_partkey % 3 = 0 THEN array({_ONE}) ELSE array({_ONE}, {_TWO}) END").alias("old"), F.expr("CASE WHEN p_partkey % 4 = 0 THEN 'affected' ELSE 'cpe' END").alias("source"))
    out = inventory.recomputed_components(rows, "p_partkey", "cpes", "old", "source")
    return out.withColumns({c: F.array_join(c, "; ") for c in ("old", "new")})


@query("SELECT printf('VT-%03d', row_number() OVER (ORDER BY o_orderkey)) AS item_id, o_orderpriority, '' AS your_label FROM orders ORDER BY o_orderkey LIMIT 60")
def blind_sheet(spark, sf_dir):
    return inventory.blind_sheet(_table(spark, sf_dir, "orders"), ["o_orderkey"], ["o_orderpriority"], 60)


@query("SELECT p_partkey FROM part WHERE p_partkey % 5 > 1 AND p_partkey % 7 > 1")
def eligible_items(spark, sf_dir):
    answer = "CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE p_name END"
    names = "CASE p_partkey % 7 WHEN 0 THEN array() WHEN 1 THEN array(p_name, NULL) ELSE array(p_name) END"
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.expr(answer).alias("answer"), F.expr(names).alias("names"))
    return inventory.eligible(rows, "answer", "names").select("p_partkey")


@query("SELECT c_custkey, -c_custkey AS pos, c_name FROM customer WHERE c_custkey % 10 = 7")
def listed_customers(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer")
    listed = rows.filter("c_custkey % 10 = 7").select("c_custkey", (-F.col("c_custkey")).alias("pos"))
    return inventory.select_listed(rows.select("c_custkey", "c_name"), listed, "c_custkey")


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN coalesce(a.n_name, '?') ELSE coalesce(a.n_name, '?') || ';' || coalesce(b.n_name, '?') END AS names,
CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN (a.n_name IS NULL)::INT ELSE (a.n_name IS NULL)::INT + (b.n_name IS NULL)::INT END AS n_unresolved
FROM customer LEFT JOIN nation a ON a.n_nationkey = c_custkey % 40 LEFT JOIN nation b ON b.n_nationkey = c_nationkey""")
def attached_names(spark, sf_dir):
    ids = "CASE c_custkey % 4 WHEN 0 THEN array() WHEN 1 THEN array('CWE-' || (c_custkey % 40)) ELSE array('CWE-' || (c_custkey % 40), 'CWE-' || c_nationkey) END"
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.expr(ids).alias("ids"))
    dim = _table(spark, sf_dir, "nation").select(F.expr("CASE WHEN n_nationkey % 2 = 0 THEN 'CWE-' || n_nationkey ELSE '' || n_nationkey END").alias("id"), F.col("n_name").alias("name"))
    return inventory.attach_names(rows, "c_custkey", "ids", dim).select("c_custkey", F.array_join("names", ";", "?").alias("names"), "n_unresolved")


@query("""WITH e AS (SELECT c_custkey, 'CWE-' || c_nationkey AS id, CASE WHEN c_custkey % 3 < 2 THEN c_mktsegment END AS name FROM customer UNION ALL
SELECT c_custkey, 'CWE-' || c_nationkey, 'other' FROM customer WHERE c_custkey % 3 = 1 UNION ALL SELECT c_custkey, 'CWE-900', NULL FROM customer WHERE c_custkey % 3 = 2),
i AS (SELECT DISTINCT id, c_custkey FROM e), t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c_custkey) AS r FROM i),
n AS (SELECT id, count(*) AS n_items, string_agg(c_custkey::VARCHAR, ';' ORDER BY c_custkey) FILTER (r <= 5) AS first_items FROM t GROUP BY id)
SELECT n.id, coalesce(array_to_string(list_sort(list(DISTINCT name) FILTER (name IS NOT NULL)), ';'), '') AS names, count(DISTINCT name) AS n_names, n_items, n_items AS n_rows, first_items, count(DISTINCT name) <> 1 AS needs_review FROM n JOIN e ON n.id = e.id GROUP BY ALL""")
def truth_inventory(spark, sf_dir):
    ids = "CASE c_custkey % 3 WHEN 2 THEN array(' cwe-' || c_nationkey, 'CWE-900', '') ELSE array('CWE-' || c_nationkey) END"
    names = "CASE c_custkey % 3 WHEN 0 THEN array(c_mktsegment) WHEN 1 THEN array(c_mktsegment, 'other', ' ') ELSE array(c_mktsegment) END"
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.expr(ids).alias("ids"), F.expr(names).alias("names"))
    out = inventory.truth_inventory(rows, "c_custkey", "ids", "names")
    return out.withColumns({"names": F.array_join("names", ";"), "first_items": F.array_join(F.col("first_items").cast("array<string>"), ";")})


_BACK = "SELECT o_orderkey, date_diff('day', o_orderdate::DATE, (SELECT max(o_orderdate)::DATE FROM orders)) AS d FROM orders"


@query(f"SELECT o_orderkey, greatest(ceil((d - 90) / 90) + 1, 1)::INTEGER AS slice FROM ({_BACK}) WHERE d <= 1080 ORDER BY slice, o_orderkey LIMIT 400")
def growing_window(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    own = rows.crossJoin(F.broadcast(rows.agg(F.max("o_orderdate").alias("anchor"))))
    return inventory.growing_window(own, F.date_diff(F.to_date("anchor"), F.to_date("o_orderdate")), ["o_orderkey"], 400).select("o_orderkey", "slice")


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50")
def first_items(spark, sf_dir):
    return inventory.first_items(_table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], 50).select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET (SELECT ('0x' || substr(md5('page:42'), 1, 13))::BIGINT % (greatest(count(*) - 50, 0) + 1) FROM orders)")
def random_page(spark, sf_dir):
    return inventory.random_page(_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 50)


@query(V + """, w AS (SELECT item, model, cond, coalesce(predicted, 'None') AS predicted, coalesce(raw, 'None') AS raw FROM v WHERE has_block),
g AS (SELECT item, model, count(DISTINCT predicted) = 1 AS p, count(DISTINCT raw) = 1 AS r FROM w GROUP BY ALL HAVING count(*) = 2)
SELECT model, 'predicted' AS field, count(*) AS eligible, count(*) FILTER (p) AS n_agree, round(count(*) FILTER (p) / count(*), 6) AS rate FROM g GROUP BY ALL UNION ALL
SELECT model, 'raw', count(*), count(*) FILTER (r), round(count(*) FILTER (r) / count(*), 6) FROM g GROUP BY ALL""")
def field_agreement(spark, sf_dir):
    return _rounded(inventory.field_agreement(eval_rows(spark, sf_dir), ["item", "model"], ["model"], ["predicted", "raw"], "has_block", 2))


@query(_WEAK + """, s AS (SELECT c_mktsegment, verdict = 'correct' AS ok, verdict = 'correct' AND (norm LIKE 'cwe %' OR split_part(resolved, '-', 2)::INT % 4 <> 0) AS less FROM w)
SELECT c_mktsegment, round(avg(ok::INT), 6) AS with_all, round(avg(less::INT), 6) AS without, round(avg(less::INT) - avg(ok::INT), 6) AS change FROM s GROUP BY ALL""")
def alias_sensitivity(spark, sf_dir):
    rows, vocabulary, index = label_rows(spark, sf_dir)
    known = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("alias"), F.concat(F.lit("CWE-"), "n_nationkey").alias("id"), F.expr("CASE WHEN n_nationkey % 4 = 0 THEN 'author' ELSE 'official' END").alias("provenance"))
    official = labels.alias_index(inventory.without_provenance(known, "author"))

    def summary(aliases: DataFrame) -> DataFrame:
        verdicts = labels.layered_verdict(rows, "answer", "truths", labels.resolve(rows, "answer", aliases, vocabulary), vocabulary)
        return labels.verdict_summary(verdicts, ["c_mktsegment"])

    return _rounded(inventory.sensitivity(summary(index), summary(official), ["c_mktsegment"]))


@query(V + " SELECT item FROM v WHERE outcome = 'Declined' GROUP BY item HAVING count(DISTINCT cond) = 2")
def hard_core_everywhere(spark, sf_dir):
    """Items declined under both conditions, which stand for components."""
    declined = eval_rows(spark, sf_dir).filter("outcome = 'Declined'")
    return selection.in_all(declined, "item", "cond", 2)


@query("""SELECT event_id, event_id % 7 IN (1, 3, 4, 6) AS valid, CASE event_id % 7 WHEN 0 THEN 'not a JSON object' WHEN 5 THEN 'not a JSON object' WHEN 2 THEN 'missing: v' END AS error FROM events""")
def first_error(spark, sf_dir):
    out = responses.validated(_table(spark, sf_dir, "events").withColumn("raw", F.expr(_RAW)), "raw", ["k", "v"], {}, check_extra=False)
    return out.select("event_id", "valid", F.try_element_at("notes", F.lit(1)).alias("error"))
