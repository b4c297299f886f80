"""All queries of the sequence engine over the driver's tables, and their SQL.

A query's name starts with its operator's id in the inventory. Counts are BIGINT and doubles are rounded to 6 places
on both sides; arrays come as comma-separated text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelode.functions import text as T
from tracelode.operators import aggregates as A
from tracelode.operators import agreement as K
from tracelode.operators import cleaning as C
from tracelode.operators import graph as G
from tracelode.operators import rank_tests as R
from tracelode.operators import sequence as Q
from tracelode.operators import vectors as V
from tracelode.plans.facts import LABELS, NUMBERED, SQL, sentences, table
from tracelode.sources import traces as S
from tracelode.streaming import sessions as ST

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
DEPS = f"""{SQL},
w AS (SELECT *, coalesce(list({{'sid': sid, 'label': label, 'j': judgement}}) OVER w20, []) AS l20, coalesce(list({{'sid': sid, 'label': label, 'j': judgement}}) OVER w35, []) AS l35,
  coalesce(list({{'sid': sid, 'label': label, 'j': judgement}}) OVER w50, []) AS l50, lag(label) OVER t AS pl, lag(sid) OVER t AS ps FROM s
  WINDOW t AS (PARTITION BY trace ORDER BY sid), w20 AS (PARTITION BY trace ORDER BY sid ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
  w35 AS (PARTITION BY trace ORDER BY sid ROWS BETWEEN 35 PRECEDING AND 1 PRECEDING), w50 AS (PARTITION BY trace ORDER BY sid ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)),
w2 AS (SELECT *, list_max([x.sid FOR x IN l20 IF x.label = 'HYPO']) AS h20, list_max([x.sid FOR x IN l35 IF x.label = 'JUDGE']) AS j35,
  coalesce(list_max([x.sid FOR x IN l20 IF x.label NOT IN ('DESCRIBE', 'SYNTHESIZE', 'TEST')]), -1) AS b3, coalesce(list_max([x.sid FOR x IN l20 IF x.label NOT IN ('DESCRIBE', 'TEST')]), -1) AS b2 FROM w),
d0 AS (SELECT *, CASE label
  WHEN 'ORIENT' THEN CASE WHEN pl = 'ORIENT' THEN [ps] ELSE [] END
  WHEN 'PLAN' THEN [list_max([x.sid FOR x IN l20 IF x.label IN ('ORIENT', 'MONITOR', 'JUDGE', 'SYNTHESIZE')])]
  WHEN 'DESCRIBE' THEN CASE WHEN pl = 'DESCRIBE' THEN [ps] ELSE [list_max([x.sid FOR x IN l20 IF x.label = 'PLAN'])] END
  WHEN 'SYNTHESIZE' THEN ([x.sid FOR x IN l20 IF x.sid > b3])[-5:]
  WHEN 'HYPO' THEN CASE WHEN antecedent IS NOT NULL THEN [antecedent, j35] ELSE [coalesce(j35, list_max([x.sid FOR x IN l35 IF x.label IN ('SYNTHESIZE', 'MONITOR')]))] END
  WHEN 'TEST' THEN [h20] || ([x.sid FOR x IN l20 IF x.sid > b2])[-3:]
  WHEN 'JUDGE' THEN [h20] || ([x.sid FOR x IN l20 IF x.label = 'TEST' AND x.sid > coalesce(h20, -1)])[-3:]
  WHEN 'MONITOR' THEN [ps]
  WHEN 'RULE' THEN [coalesce(list_max([x.sid FOR x IN l50 IF x.label = 'JUDGE' AND x.j = 'accept']), list_max([x.sid FOR x IN l50 IF x.label = 'JUDGE'])), list_max([x.sid FOR x IN l50 IF x.label = 'HYPO'])]
  ELSE [] END AS raw FROM w2),
d AS (SELECT * EXCLUDE (raw, l20, l35, l50), list_sort(list_distinct([x FOR x IN raw IF x IS NOT NULL])) AS depends_on FROM d0),
e AS (SELECT DISTINCT d.trace, x.src, d.sid AS dst FROM d, unnest(d.depends_on) AS x(src)),
deg AS (SELECT d.trace, d.sid, d.label, (SELECT count(*) FROM e WHERE e.trace = d.trace AND e.dst = d.sid) AS n_declared, (SELECT count(*) FROM e WHERE e.trace = d.trace AND e.src = d.sid) AS n_referenced_by FROM d)
"""


def _round(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`").cast("bigint").alias(c) if t == "int" else F.col(f"`{c}`") for c, t in df.dtypes])


def _add(name: str, sql: str | None, fact: str | None = "s") -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _QUERIES[name] = lambda spark, sf_dir: _round(f(spark, sf_dir))
        if sql:
            _SQL[name] = ("WITH " + {"s": SQL, "d": DEPS}[fact] + (", " if sql.lstrip().startswith("+") else "") + sql.lstrip().removeprefix("+")) if fact else sql
        return f

    return put


def _on(name: str, sql: str | None, of: Callable[[DataFrame], DataFrame], fact: str = "s") -> None:
    """A query over the sentence table, with dependencies if fact is d."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = sentences(spark, sf_dir)
        return of(Q.dependencies(rows) if fact == "d" else rows)

    _add(name, sql, fact)(run)


def _text(array: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(array), lambda x: x.cast("string")), ",")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


LIST = ", ".join(f"('{x}', {k})" for k, x in enumerate(LABELS))
PAIRS = "p AS (SELECT *, lead(label) OVER (PARTITION BY trace ORDER BY sid) AS nx FROM s)"
B = "CAST(count(*) AS BIGINT)"

# --- sequences

_on("wn01_transitions", f"+{PAIRS} SELECT label AS from_label, nx AS to_label, count(*) AS n FROM p WHERE nx IS NOT NULL GROUP BY ALL", Q.transitions)
_on("wn02_transition_matrix", f"""+{PAIRS}, dim AS (SELECT * FROM (VALUES {LIST}) v(l, o)), c AS (SELECT label, nx, count(*) AS n FROM p WHERE nx IS NOT NULL GROUP BY ALL)
SELECT a.l AS from_label, b.l AS to_label, coalesce(n, 0) AS n, round(coalesce(n / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY a.l), 0), 0), 6)::DOUBLE AS p FROM dim a CROSS JOIN dim b LEFT JOIN c ON c.label = a.l AND c.nx = b.l""", lambda s: Q.transition_matrix(s, LABELS))
_on("wn03_top_bigrams", f"+{PAIRS} SELECT label AS from_label, nx AS to_label, count(*) AS n FROM p WHERE nx IS NOT NULL GROUP BY ALL ORDER BY n DESC, from_label, to_label LIMIT 20", lambda s: Q.top_transitions(s, 20))
_on("wn04_self_transitions", f"+{PAIRS} SELECT label, CAST(sum(CASE WHEN label = nx THEN 1 ELSE 0 END) AS BIGINT) AS n_self, count(*) AS n_from, round(avg(CASE WHEN label = nx THEN 1.0 ELSE 0 END), 6)::DOUBLE AS rate FROM p WHERE nx IS NOT NULL GROUP BY label", Q.self_transitions)
_on("wn05_transition_entropy", f"+{PAIRS}, c AS (SELECT trace, count(*) AS n FROM p WHERE nx IS NOT NULL GROUP BY trace, label, nx), t AS (SELECT *, n / sum(n) OVER (PARTITION BY trace) AS q FROM c) SELECT trace, round(-sum(q * log2(q)), 6) AS bits FROM t GROUP BY trace", Q.transition_entropy)
_on("wn06_label_entropy", "+c AS (SELECT trace, count(*) AS n FROM s GROUP BY trace, label), t AS (SELECT *, n / sum(n) OVER (PARTITION BY trace) AS q FROM c) SELECT trace, round(-sum(q * log2(q)) / log2(9), 6) AS bits FROM t GROUP BY trace", lambda s: Q.entropy(s, "trace", "label").withColumn("bits", F.col("bits") / F.log2(F.lit(9.0))))
_on("wn07_ends", "SELECT trace, arg_min(label, sid) AS opening, arg_max(label, sid) AS closing, count(DISTINCT label) AS n_labels FROM s GROUP BY trace", Q.ends)
PHASES = """+h AS (SELECT *, min(CASE WHEN label = 'HYPO' THEN sid END) OVER (PARTITION BY trace) AS h FROM s), g AS (SELECT trace, count(*) AS n, any_value(h) AS h, max(CASE WHEN label = 'JUDGE' AND sid > h THEN sid END) AS j FROM h GROUP BY trace),
f AS (SELECT trace, h, CASE WHEN h IS NULL THEN 1.0::DOUBLE ELSE h / n END AS a, CASE WHEN h IS NULL THEN 0.0::DOUBLE WHEN j IS NULL THEN (n - h) / n ELSE (j - h + 1) / n END AS b, CASE WHEN h IS NULL THEN 'direct' WHEN j IS NULL THEN 'scan_test' ELSE 'full' END AS strategy FROM g) """
_on("wn10_phases", PHASES + "SELECT trace, h AS first_hypo, round(a, 6) AS scanning, round(b, 6) AS cycling, round(1 - a - b, 6) AS convergence, strategy FROM f", Q.phases)
_on("wn11_strategies", PHASES + "SELECT strategy, count(*) AS n, round(avg(a), 6) AS scanning FROM f GROUP BY strategy", lambda s: Q.phases(s).groupBy("strategy").agg(F.count("*").alias("n"), F.avg("scanning").alias("scanning")))
RUNS = "+i AS (SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY trace ORDER BY sid) THEN 0 ELSE 1 END AS t FROM s), j AS (SELECT *, sum(t) OVER (PARTITION BY trace ORDER BY sid) AS k FROM i), r AS (SELECT trace, any_value(label) AS label, min(sid) AS first_sid, count(*) AS length FROM j GROUP BY trace, k) "
_on("wn12_runs", RUNS + "SELECT * FROM r WHERE length >= 2", lambda s: Q.runs(s, 2))
_on("wn13_longest_run", RUNS + "SELECT trace, label, length FROM (SELECT *, row_number() OVER (PARTITION BY trace ORDER BY length DESC, first_sid) AS k FROM r) WHERE k = 1", Q.longest_run)
_on("wn15_ngram_repetition", "+g AS (SELECT trace, CASE WHEN lead(label, 3) OVER o IS NOT NULL THEN concat_ws('>', label, lead(label, 1) OVER o, lead(label, 2) OVER o, lead(label, 3) OVER o) END AS g FROM s WINDOW o AS (PARTITION BY trace ORDER BY sid)) SELECT trace, round(coalesce((count(g) - count(DISTINCT g)) / nullif(count(g), 0), 0), 6)::DOUBLE AS ratio FROM g GROUP BY trace", Q.repetition_ratio)
_on("wn16_hypo_test_adjacency", f"+{PAIRS} SELECT trace, round(avg(CASE WHEN (label = 'HYPO' AND nx = 'TEST') OR (label = 'TEST' AND nx = 'HYPO') THEN 1.0 ELSE 0 END), 6)::DOUBLE AS share FROM p WHERE nx IS NOT NULL GROUP BY trace", lambda s: Q.adjacency_share(s, "HYPO", "TEST"))
_on("wn17_latest_match", "SELECT trace, sid, last_value(CASE WHEN label IN ('HYPO', 'JUDGE') THEN sid END IGNORE NULLS) OVER (PARTITION BY trace ORDER BY sid ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS found FROM s", lambda s: s.select("trace", "sid", Q.latest(("HYPO", "JUDGE"), 20).alias("found")))
_on("wn19_preceding_run", "SELECT trace, sid, array_to_string(([x.sid FOR x IN l20 IF x.sid > b2])[-3:], ',') AS run FROM w2", lambda s: s.select("trace", "sid", _text(Q.preceding_run(("DESCRIBE", "TEST"), 20, 3)).alias("run")), "d")
_on("wn20_dependencies", "SELECT trace, sid, label, array_to_string(depends_on, ',') AS depends_on FROM d", lambda s: s.select("trace", "sid", "label", _text(F.col("depends_on")).alias("depends_on")), "d")
_on("wn24_folds", "+g AS (SELECT DISTINCT task, trace FROM s) SELECT task, trace, (row_number() OVER (PARTITION BY task ORDER BY md5(CAST(trace AS VARCHAR)), trace) - 1) % 5 AS fold FROM g", lambda s: V.group_folds(s, "task", "trace"))
_on("ag19_presence", "SELECT trace, bool_or(label = 'ORIENT' AND sid < 5) AS orient_early, bool_or(label = 'RULE') AS has_rule FROM s GROUP BY trace", Q.presence)

# --- distributions

_on("ag01_label_distribution", "SELECT l AS label, o::BIGINT AS ord, n, round(100 * n / sum(n) OVER (), 6) AS pct FROM (VALUES ('ORIENT', 0), ('DESCRIBE', 1), ('SYNTHESIZE', 2), ('HYPO', 3), ('TEST', 4), ('JUDGE', 5), ('PLAN', 6), ('MONITOR', 7), ('RULE', 8)) v(l, o) LEFT JOIN (SELECT label, count(*) AS n FROM s GROUP BY label) c ON c.label = l", lambda s: A.label_distribution(s, NUMBERED))
_cols = ", ".join(f"count(*) FILTER (label = '{x}') AS \"{x}\"" for x in LABELS)
_pcts = ", ".join(f"round(100 * (count(*) FILTER (label = '{x}')) / count(*), 6) AS \"{x}\"" for x in LABELS)
_on("ag02_label_by_task", f"SELECT task, {_cols} FROM s GROUP BY task", lambda s: A.contingency(s, "task", LABELS))
_on("ag03_label_pct_by_task", f"SELECT task, {_pcts} FROM s GROUP BY task", lambda s: A.contingency(s, "task", LABELS, percent=True))
_on("ag04_label_pct_by_completion", f"SELECT CASE WHEN completed THEN 'Completed' ELSE 'Truncated' END AS completion, {_pcts} FROM s GROUP BY 1", lambda s: A.contingency(s.withColumn("completion", F.when(F.col("completed"), "Completed").otherwise("Truncated")), "completion", LABELS, percent=True))
_on("ag05_flags", """+f AS (SELECT 'judgement' AS flag, judgement AS value FROM s UNION ALL SELECT 'status', status FROM s UNION ALL SELECT 'confidence', confidence FROM s), c AS (SELECT flag, value, count(*) AS n FROM f WHERE value IS NOT NULL GROUP BY ALL)
SELECT *, round(100 * n / sum(n) OVER (PARTITION BY flag), 6) AS pct FROM c""", lambda s: A.long_flags(s, ["judgement", "status", "confidence"]))
_on("ag06_confidence", "SELECT label, count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence = 'medium') AS medium, round(100 * (count(*) FILTER (confidence = 'medium')) / count(*), 6) AS pct_medium FROM s GROUP BY label", lambda s: A.contingency(s, "label", ["high", "medium"], label="confidence").withColumn("pct_medium", 100 * F.col("medium") / (F.col("high") + F.col("medium"))))
_on("ag07_traces_by_set_task", 'SELECT "set", count(DISTINCT trace) FILTER (task = 1) AS "1", count(DISTINCT trace) FILTER (task = 2) AS "2", count(DISTINCT trace) FILTER (task = 3) AS "3", count(DISTINCT trace) FILTER (task = 4) AS "4" FROM s GROUP BY "set"', lambda s: s.groupBy("set").pivot("task", [1, 2, 3, 4]).agg(F.countDistinct("trace")).na.fill(0))
_DESC = "count({0}) AS n, round(avg({0}), 6) AS mean, round(median({0}), 6)::DOUBLE AS median, round(stddev_samp({0}), 6) AS sd, min({0}) AS least, max({0}) AS most"
_on("ag08_corpus_summary", "+t AS (SELECT trace, any_value(completed) AS c, count(*) AS k FROM s GROUP BY trace) SELECT count(*) FILTER (c) AS n_completed, " + _DESC.format("k") + " FROM t", lambda s: s.groupBy("trace").agg(F.first("completed").alias("c"), F.count("*").alias("k")).agg(F.count_if("c").alias("n_completed"), *A.describe("k")))
_on("ag10_rollup", 'SELECT "set", task, ' + _DESC.format("tokens") + ' FROM s GROUP BY ROLLUP ("set", task)', lambda s: A.subtotals(s, ["set", "task"], "tokens"))
_on("ag11_grouping_sets", "+u AS (SELECT 'tokens' AS metric, task, completed, tokens::DOUBLE AS v FROM s UNION ALL SELECT 'value', task, completed, value FROM s) SELECT metric, task, completed, count(v) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_samp(v), 6) AS sd, round(min(v), 6) AS least, round(max(v), 6) AS most FROM u GROUP BY GROUPING SETS ((metric), (metric, task), (metric, completed))", lambda s: A.grouped(s, [[], ["task"], ["completed"]], ["tokens", "value"]))
_on("ag13_completion_rates", "+t AS (SELECT trace, any_value(task) AS task, any_value(completed) AS c FROM s GROUP BY trace) SELECT task, count(*) AS n, round(avg(c::INT), 6) AS rate FROM t GROUP BY task", lambda s: s.groupBy("trace").agg(F.first("task").alias("task"), F.first("completed").alias("c")).groupBy("task").agg(F.count("*").alias("n"), F.avg(F.col("c").cast("int")).alias("rate")))
#: The first token of each of ten bins.
_BINS = [1, 6, 11, 21, 31, 51, 76, 101, 151, 201]
_add("ag14_token_bins", """WITH p AS (SELECT unnest(list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \\t\\n\\r\\f\\v]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '')) AS p FROM documents), t AS (SELECT len(regexp_extract_all(p, '[^ \\t\\n\\r\\f\\v]+')) AS n FROM p)
SELECT CASE WHEN n <= 5 THEN '1-5' WHEN n <= 10 THEN '6-10' WHEN n <= 20 THEN '11-20' WHEN n <= 30 THEN '21-30' WHEN n <= 50 THEN '31-50' WHEN n <= 75 THEN '51-75' WHEN n <= 100 THEN '76-100' WHEN n <= 150 THEN '101-150' WHEN n <= 200 THEN '151-200' ELSE '201+' END AS bin, count(*) AS n FROM t GROUP BY 1""", None)(lambda spark, d: A.binned(_docs(spark, d).select(F.explode(T.sentences(F.col("text"))).alias("p")).select(T.word_count(F.col("p")).alias("n")), "n", _BINS))
_on("ag15_histogram", "+b AS (SELECT min(value) AS lo, max(value) AS hi FROM s) SELECT CAST(least(floor((value - lo) / (hi - lo) * 10) + 1, 10) AS BIGINT) AS bin, count(*) AS n FROM s, b GROUP BY 1", lambda s: A.histogram(s, "value", 10))
_on("ag18_checks", """SELECT 'no_judgement' AS "check", count(*) FILTER (label = 'JUDGE' AND judgement IS NULL) AS n_issues FROM s UNION ALL SELECT 'stray_status', count(*) FILTER (status IS NOT NULL AND label <> 'HYPO') FROM s UNION ALL SELECT 'no_antecedent', count(*) FILTER (status = 'revised' AND antecedent IS NULL) FROM s""", lambda s: A.checks(s, {"no_judgement": (F.col("label") == "JUDGE") & F.col("judgement").isNull(), "stray_status": F.col("status").isNotNull() & (F.col("label") != "HYPO"), "no_antecedent": (F.col("status") == "revised") & F.col("antecedent").isNull()}))
_on("ag21_dominance", "+c AS (SELECT trace, label, count(*) AS k FROM s GROUP BY ALL), t AS (SELECT trace, label, k / sum(k) OVER (PARTITION BY trace) AS share, row_number() OVER (PARTITION BY trace ORDER BY k DESC, label DESC) AS r FROM c) SELECT trace, label, round(share, 6) AS share, share > 0.7 AS dominant FROM t WHERE r = 1", lambda s: A.dominance(s, -1.0).withColumn("dominant", F.col("share") > 0.7))
_on("ag28_status_shares", "+h AS (SELECT task, status, count(*) AS n FROM s WHERE label = 'HYPO' GROUP BY ALL) SELECT task, status, n, round(n / sum(n) OVER (PARTITION BY task), 6) AS share FROM h", lambda s: s.where("label = 'HYPO'").groupBy("task", "status").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("task"))))
_on("ag31_macro_average", "+t AS (SELECT trace, count(*) AS k FROM s GROUP BY trace), c AS (SELECT trace, label, count(*) AS n FROM s GROUP BY ALL) SELECT l AS label, round(avg(100 * coalesce(n, 0) / k), 6) AS mean_pct FROM t CROSS JOIN (VALUES " + LIST + ") v(l, o) LEFT JOIN c ON c.trace = t.trace AND c.label = l GROUP BY l", lambda s: A.macro_average(s, LABELS))
_on("ag32_robust", "+q AS (SELECT task, count(value) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS q3 FROM s GROUP BY task) SELECT task, n, round(q1, 6) AS q1, round(m, 6) AS median, round(q3, 6) AS q3, round(q1 - 1.5 * (q3 - q1), 6)::DOUBLE AS low, round(q3 + 1.5 * (q3 - q1), 6)::DOUBLE AS high FROM q", lambda s: A.robust(s, "task", "value"))
_on("ag33_class_weights", f"+c AS (SELECT label, count(*) AS n FROM s GROUP BY label) SELECT l AS label, coalesce(round((SELECT sum(n) FROM c) / (9 * n)::DOUBLE, 3), 1) AS weight FROM (VALUES {LIST}) v(l, o) LEFT JOIN c ON c.label = l", lambda s: A.class_weights(s, LABELS))
_on("ag34_fold_by_label", "+f AS (SELECT task, trace, (row_number() OVER (PARTITION BY task ORDER BY md5(CAST(trace AS VARCHAR)), trace) - 1) % 5 AS fold FROM (SELECT DISTINCT task, trace FROM s)) SELECT fold, " + _cols + " FROM s JOIN f USING (task, trace) GROUP BY fold", lambda s: A.contingency(s.join(V.group_folds(s, "task", "trace"), ["task", "trace"]), "fold", LABELS))
_add("ag35_cost", "WITH t AS (SELECT conv_id, sum(CASE WHEN role <> 'assistant' THEN len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f\\v]+')) ELSE 0 END)::BIGINT AS tokens_in, sum(CASE WHEN role = 'assistant' THEN len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f\\v]+')) ELSE 0 END)::BIGINT AS tokens_out FROM conversations GROUP BY conv_id) SELECT *, round((tokens_in * 1.5::DOUBLE + tokens_out * 7.5::DOUBLE) / 1000, 6) AS cost, round((tokens_in * 3.0::DOUBLE + tokens_out * 15.0::DOUBLE) / 1000, 6) AS full_cost FROM t", None)(lambda spark, d: _costs(table(spark, d, "conversations")))
#: Published shares of eight domains, in the table's order; the two that are told apart there and not here come together.
DOMAINS = {"problem_setup": 0.024, "plan_generation": 0.155, "fact_retrieval": 0.201, "active_computation": 0.327, "uncertainty_management": 0.140, "result_consolidation": 0.101, "self_checking": 0.045, "final_answer_emission": 0.007}
_on("ag36_macro_domains", """+m AS (SELECT CASE WHEN label = 'ORIENT' THEN 'problem_setup' WHEN label IN ('HYPO', 'PLAN') THEN 'plan_generation' WHEN label = 'DESCRIBE' THEN 'fact_retrieval' WHEN label = 'TEST' THEN 'active_computation' WHEN label = 'MONITOR' OR judgement IN ('reject', 'uncertain') THEN 'uncertainty_management+self_checking' WHEN label = 'SYNTHESIZE' OR judgement = 'accept' THEN 'result_consolidation' WHEN label = 'RULE' THEN 'final_answer_emission' END AS domain, 1.0 / count(*) OVER () AS w FROM s),
b AS (SELECT * FROM (VALUES ('problem_setup', 0.024), ('plan_generation', 0.155), ('fact_retrieval', 0.201), ('active_computation', 0.327), ('uncertainty_management+self_checking', 0.185), ('result_consolidation', 0.101), ('final_answer_emission', 0.007)) v(domain, published)), c AS (SELECT domain, sum(w) AS share FROM m GROUP BY domain)
SELECT b.domain, round(coalesce(share, 0), 4)::DOUBLE AS share, published::DOUBLE AS published, round(round(coalesce(share, 0), 4) - published, 4)::DOUBLE AS difference FROM b LEFT JOIN c ON c.domain = b.domain""", lambda s: A.domain_shares(s, DOMAINS))
_on("ag44_modes", "+e AS (SELECT trace, arg_min(label, sid) AS o, arg_max(label, sid) AS c FROM s GROUP BY trace) SELECT mode(o) AS opening, mode(c) AS closing FROM e", lambda s: Q.ends(s).agg(F.mode("opening").alias("opening"), F.mode("closing").alias("closing")))
_on("pj03_position_thirds", "+p AS (SELECT *, sid / greatest(n - 1, 1) AS x FROM s) SELECT CASE WHEN x <= 1/3 THEN 'early' WHEN x <= 2/3 THEN 'middle' ELSE 'late' END AS third, count(*) AS n, round(avg(x), 6) AS mean FROM p GROUP BY 1", lambda s: s.withColumn("x", F.col("sid") / F.greatest(F.col("n") - 1, F.lit(1))).groupBy(F.when(F.col("x") <= 1 / 3, "early").when(F.col("x") <= 2 / 3, "middle").otherwise("late").alias("third")).agg(F.count("*").alias("n"), F.avg("x").alias("mean")))
_on("sx08_chi_squared", "+c AS (SELECT completed, label, count(*)::DOUBLE AS o FROM s GROUP BY ALL), x AS (SELECT *, sum(o) OVER (PARTITION BY completed) * sum(o) OVER (PARTITION BY label) / sum(o) OVER () AS e FROM c) SELECT round(sum(o * o / e) - sum(o), 4) AS chi2 FROM x", lambda s: R.chi_squared(s, "completed", "label", len(LABELS) - 1).select(F.round("chi2", 4).alias("chi2")))
_RANK = "k AS (SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS r, count(*) OVER (PARTITION BY v) AS t FROM x), c AS (SELECT sum(t * t - 1)::DOUBLE AS tie FROM k), n AS (SELECT count(*)::DOUBLE AS n FROM k)"
_on("sx09_kruskal", f"+x AS (SELECT task AS g, tokens AS v FROM s), {_RANK}, q AS (SELECT sum(r)::DOUBLE AS r, count(*)::DOUBLE AS m FROM k GROUP BY g) SELECT round((12 / (n * (n + 1)) * (SELECT sum(r * r / m) FROM q) - 3 * (n + 1)) / (1 - tie / (n * n * n - n)), 5) AS h, 3::BIGINT AS df FROM n, c", lambda s: R.kruskal(s, "tokens", "task", 4).select(F.round("h", 5).alias("h"), "df"))
_on("sx11_mann_whitney", f"+x AS (SELECT completed AS g, tokens AS v FROM s), {_RANK}, q AS (SELECT sum(r) FILTER (g)::DOUBLE AS r, count(*) FILTER (g)::DOUBLE AS a, count(*) FILTER (NOT g)::DOUBLE AS b FROM k), u AS (SELECT *, r - a * (a + 1) / 2 AS u FROM q) SELECT round(u, 3) AS u, round((greatest(u, a * b - u) - a * b / 2 - 0.5) / sqrt(a * b / 12 * (n + 1 - tie / (n * (n - 1)))), 5) AS z FROM u, n, c", lambda s: R.mann_whitney(s, "tokens", "completed").select(F.round("u", 3).alias("u"), F.round("z", 5).alias("z")))
_PAIRED = "+t AS (SELECT trace, any_value(task) AS task, count(*) FILTER (label = 'TEST') AS x, count(*) FILTER (label = 'HYPO') AS y FROM s GROUP BY trace)"
_paired = lambda s: s.groupBy("trace").agg(F.first("task").alias("task"), F.count_if(F.col("label") == "TEST").alias("x"), F.count_if(F.col("label") == "HYPO").alias("y"))
_on("sx13_cohens_d", _PAIRED + " SELECT task, count(*) AS n, round(coalesce(avg(x - y) / nullif(stddev_pop(x - y), 0), 0), 6) AS d FROM t GROUP BY task", lambda s: R.cohens_d(_paired(s), "task", "x", "y"))
_on("sx12_wilcoxon", _PAIRED + ", z AS (SELECT x - y AS d FROM t WHERE x <> y), k AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r FROM z), w AS (SELECT count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0)::DOUBLE AS p FROM k) SELECT n, round(least(p, n * (n + 1) / 2 - p), 3) AS w FROM w", lambda s: R.wilcoxon(_paired(s), "x", "y").select("n", F.round("w", 3).alias("w")))
_on("sx15_outliers", "+t AS (SELECT trace, any_value(task) AS task, count(*)::DOUBLE AS v FROM s GROUP BY trace), q AS (SELECT task, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM t GROUP BY task) SELECT trace, task, v::BIGINT AS v, v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) AS outlier FROM t JOIN q USING (task)", lambda s: _outliers(s))


def _outliers(s: DataFrame) -> DataFrame:
    lengths = s.groupBy("trace").agg(F.first("task").alias("task"), F.count("*").alias("v"))
    fences = A.robust(lengths, "task", "v").select("task", "low", "high")
    return lengths.join(F.broadcast(fences), "task").select("trace", "task", "v", ((F.col("v") < F.col("low")) | (F.col("v") > F.col("high"))).alias("outlier"))  # one row a task


_on("sx16_trace_status", "+t AS (SELECT trace, count(*) AS n, count(*) FILTER (label = 'HYPO') AS h, bool_or(label = 'RULE') AS r FROM s GROUP BY trace) SELECT trace, n, CASE WHEN NOT r OR h = 0 THEN 'FAIL' WHEN h < 3 THEN 'WARN' ELSE 'PASS' END AS status FROM t", lambda s: s.groupBy("trace").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "HYPO").alias("h"), F.bool_or(F.col("label") == "RULE").alias("r")).select("trace", "n", F.when(~F.col("r") | (F.col("h") == 0), "FAIL").when(F.col("h") < 3, "WARN").otherwise("PASS").alias("status")))
_on("st07_closest", '+t AS (SELECT trace, any_value("set") AS "set", any_value(task) AS task, count(*) AS k FROM s GROUP BY trace) SELECT trace, "set", task, k FROM (SELECT *, row_number() OVER (PARTITION BY "set", task ORDER BY abs(k - 65), trace) AS r FROM t) WHERE r = 1', lambda s: A.closest(s.groupBy("trace").agg(F.first("set").alias("set"), F.first("task").alias("task"), F.count("*").alias("k")), ["set", "task"], "k", 65, "trace"))
_on("st08_sample", "SELECT trace, sid, label FROM s ORDER BY md5('7:' || trace || ':' || sid), trace, sid LIMIT 50", lambda s: A.sample(s, 50, 7, "trace", "sid").select("trace", "sid", "label"))
_on("st09_first_last", "SELECT trace, sid, label FROM s WHERE sid < 3 OR sid >= n - 3", lambda s: s.where((F.col("sid") < 3) | (F.col("sid") >= F.col("n") - 3)).select("trace", "sid", "label"))
_on("so04_set_operations", "SELECT trace FROM s WHERE label = 'SYNTHESIZE' INTERSECT SELECT trace FROM s WHERE label = 'PLAN' EXCEPT SELECT trace FROM s WHERE task = 2", lambda s: s.where("label = 'SYNTHESIZE'").select("trace").intersect(s.where("label = 'PLAN'").select("trace")).exceptAll(s.where("task = 2").select("trace").distinct()))
_on("sk04_upsert_keep_last", 'SELECT trace, "set", CAST(max(CASE WHEN task > 2 THEN 1 ELSE 0 END) AS BIGINT) AS v FROM s GROUP BY ALL', lambda s: S.upserted(s.select("trace", "set").distinct().withColumn("v", F.lit(0)), s.where("task > 2").select("trace", "set").distinct().withColumn("v", F.lit(1)), ["trace", "set"]))
_on("sc12_trace_keys", """SELECT DISTINCT trace, 'set_' || "set" || '/task' || task || '/trace_' || lpad(trace::VARCHAR, 3, '0') AS key, 'set_' || "set" || '__task' || task || '__trace_' || lpad(trace::VARCHAR, 3, '0') AS code FROM s""", lambda s: _keys(s).select("trace", "key", S.encode_key(F.col("key")).alias("code")))
_on("sc14_selector", """SELECT DISTINCT trace FROM s WHERE ("set" = 'a' AND task = 1) OR task = 3""", lambda s: _keys(s).where(S.selector("SET_A/task1, task3, set_a/task1", "key")).select("trace"))
_on("sc05_missing_keys", "SELECT i AS trace FROM range(0, 400) r(i) WHERE i NOT IN (SELECT trace FROM s)", lambda s: S.missing(s.sparkSession.range(400).select(F.col("id").alias("trace")), s.select("trace").distinct(), ["trace"]))
_on("jn01_merge_last_coding", "+c AS (SELECT trace, sid // 2 * 2 AS sid, label AS code FROM s QUALIFY row_number() OVER (PARTITION BY trace, sid // 2 * 2 ORDER BY sid DESC) = 1) SELECT s.trace, s.sid, c.code FROM s LEFT JOIN c ON c.trace = s.trace AND c.sid = s.sid", lambda s: s.select("trace", "sid").join(A.keep_last(s.select("trace", (F.floor(F.col("sid") / 2) * 2).alias("sid"), F.col("label").alias("code"), F.col("sid").alias("o")), ["trace", "sid"], ["o"]).drop("o"), ["trace", "sid"], "left"))
_on("jn20_duplicate_values", "SELECT tokens, count(DISTINCT trace) AS n FROM s WHERE label = 'HYPO' GROUP BY tokens HAVING count(DISTINCT trace) > 1", lambda s: s.where("label = 'HYPO'").groupBy("tokens").agg(F.countDistinct("trace").alias("n")).where("n > 1"))
_on("ex03_condition_grid", "SELECT 'baseline' AS condition, NULL::VARCHAR AS category, 0::BIGINT AS direction, NULL::DOUBLE AS alpha UNION ALL SELECT lower(c) || '_' || CASE WHEN d = 1 THEN 'pos' ELSE 'neg' END || '_' || a, c, d, a::DOUBLE FROM (VALUES ('HYPO'), ('TEST'), ('JUDGE'), ('MONITOR'), ('PLAN')) x(c), (VALUES (1::BIGINT), (-1)) y(d), (VALUES ('0.5'), ('1.0'), ('1.5')) z(a)", lambda s: _grid(s.sparkSession))


def _costs(turns: DataFrame) -> DataFrame:
    """Words sent and answered, and what they cost in thousandths of a dollar: a million are $1.50 in and $7.50 out in a batch, twice that outside; fixed values."""
    words = T.word_count(F.coalesce("text", F.lit("")))
    said = lambda own: F.sum(F.when(own, words).otherwise(0)).cast("bigint")
    out = turns.groupBy("conv_id").agg(said(F.col("role") != "assistant").alias("tokens_in"), said(F.col("role") == "assistant").alias("tokens_out"))
    price = lambda a, b: (F.col("tokens_in") * a + F.col("tokens_out") * b) / 1e3
    return out.withColumn("cost", price(1.5, 7.5)).withColumn("full_cost", price(3.0, 15.0))


def _keys(s: DataFrame) -> DataFrame:
    return s.select("trace", "set", "task").distinct().withColumn("key", S.short_key(S.trace_key(F.col("set"), F.col("task"), F.col("trace"))))


def _grid(spark: SparkSession) -> DataFrame:
    rows = spark.range(1).select(F.explode(F.array(*map(F.lit, ("HYPO", "TEST", "JUDGE", "MONITOR", "PLAN")))).alias("category"))
    rows = rows.withColumn("sign", F.explode(F.array(F.lit("pos"), F.lit("neg")))).withColumn("alpha", F.explode(F.array(*map(F.lit, ("0.5", "1.0", "1.5")))))
    named = rows.select(F.concat_ws("_", F.lower("category"), "sign", "alpha").alias("condition"))
    parts = T.condition_parts(F.col("condition"))
    all_ = named.union(spark.range(1).select(F.lit("baseline")))
    return all_.select("condition", parts["category"].alias("category"), F.coalesce(parts["direction"], F.lit(0)).alias("direction"), parts["alpha"].alias("alpha"))


# --- dependencies and graphs

_on("gr01_edges", "SELECT trace, src, dst FROM e", G.edges, "d")
_on("gr04_degrees", "SELECT label, count(*) AS n, round(avg(n_declared), 6) AS mean_declared, round(stddev_pop(n_declared), 6) AS sd_declared, round(avg(n_referenced_by), 6) AS mean_referenced_by, round(stddev_pop(n_referenced_by), 6) AS sd_referenced_by, round(stddev_pop(n_declared) / sqrt(count(*)), 6) AS se_declared FROM deg GROUP BY label", G.degree_by_label, "d")
_on("gr06_density", "SELECT trace, count(*) AS n_nodes, CAST(sum(n_declared) AS BIGINT) AS n_edges, round(coalesce(sum(n_declared) / nullif(count(*) * (count(*) - 1), 0), 0), 6)::DOUBLE AS density FROM deg GROUP BY trace", G.density, "d")
_on("gr10_hypothesis_cycles", "+h AS (SELECT e.trace, e.src AS hypo_sid, e.dst AS judge_sid, j.judgement FROM e JOIN d j ON j.trace = e.trace AND j.sid = e.dst AND j.label = 'JUDGE' JOIN d h ON h.trace = e.trace AND h.sid = e.src AND h.label = 'HYPO' WHERE e.dst > e.src) SELECT trace, hypo_sid, min(judge_sid) AS judge_sid, min(judge_sid) - hypo_sid + 1 AS length, arg_min(judgement, judge_sid) AS outcome FROM h GROUP BY trace, hypo_sid", G.hypothesis_cycles, "d")
_on("gr12_chains", "+h AS (SELECT trace, sid, antecedent FROM s WHERE label = 'HYPO'), c AS (SELECT trace, antecedent AS sid, min(sid) AS nx FROM h WHERE antecedent IS NOT NULL GROUP BY ALL), g AS (WITH RECURSIVE g AS (SELECT trace, sid AS root, sid AS at, 1::BIGINT AS length FROM h WHERE antecedent IS NULL UNION ALL SELECT g.trace, root, nx, length + 1 FROM g JOIN c ON c.trace = g.trace AND c.sid = g.at) SELECT * FROM g) SELECT trace, root, max(length) AS length FROM g GROUP BY ALL", G.chains)
_on("gr13_longest_chain", "+h AS (SELECT trace, sid, antecedent FROM s WHERE label = 'HYPO'), c AS (SELECT trace, antecedent AS sid, min(sid) AS nx FROM h WHERE antecedent IS NOT NULL GROUP BY ALL), g AS (WITH RECURSIVE g AS (SELECT trace, sid AS root, sid AS at, 1::BIGINT AS length FROM h WHERE antecedent IS NULL UNION ALL SELECT g.trace, root, nx, length + 1 FROM g JOIN c ON c.trace = g.trace AND c.sid = g.at) SELECT * FROM g) SELECT trace, max(length) AS most FROM g GROUP BY trace", lambda s: G.chains(s).groupBy("trace").agg(F.max("length").alias("most")))
_on("gr14_provenance", """+ru AS (SELECT trace, max(sid) AS rule_sid, arg_max(depends_on, sid) AS deps FROM d WHERE label = 'RULE' GROUP BY trace),
ju AS (SELECT ru.trace, min(j.sid) AS judge_sid, arg_min(j.depends_on, j.sid) AS deps FROM ru JOIN d j ON j.trace = ru.trace AND j.label = 'JUDGE' AND list_contains(ru.deps, j.sid) GROUP BY ru.trace),
hy AS (SELECT ju.trace, min(h.sid) AS hypo_sid, arg_min(h.status, h.sid) AS status FROM ju JOIN d h ON h.trace = ju.trace AND h.label = 'HYPO' AND list_contains(ju.deps, h.sid) GROUP BY ju.trace)
SELECT ru.trace, rule_sid, judge_sid, hypo_sid, coalesce(status, 'unknown') AS status FROM ru LEFT JOIN ju USING (trace) LEFT JOIN hy USING (trace)""", G.provenance, "d")
_on("ag22_coverage", "SELECT label, count(*) AS n, count(*) FILTER (len(depends_on) > 0) AS n_with, CAST(sum(len(depends_on)) AS BIGINT) AS n_deps, round(100 * (count(*) FILTER (len(depends_on) > 0)) / count(*), 6) AS pct FROM d GROUP BY label", G.coverage, "d")
_on("ag23_low_coverage", "SELECT trace, round(100 * (count(*) FILTER (len(depends_on) > 0)) / count(*), 6) AS pct FROM d WHERE label <> 'ORIENT' GROUP BY trace HAVING (count(*) FILTER (len(depends_on) > 0)) < 0.9 * count(*)", G.low_coverage, "d")
_on("ag24_distances", "+f AS (SELECT d.label, e.dst - e.src AS x FROM e JOIN d ON d.trace = e.trace AND d.sid = e.dst) SELECT label, count(*) AS n, round(avg(x), 6) AS mean, round(median(x), 6)::DOUBLE AS median, round(quantile_cont(x, 0.95), 6)::DOUBLE AS p95 FROM f GROUP BY label", G.distances, "d")
_on("ag25_cycles_by_task", "+h AS (SELECT e.trace, e.src, min(e.dst) AS dst FROM e JOIN d j ON j.trace = e.trace AND j.sid = e.dst AND j.label = 'JUDGE' JOIN d h ON h.trace = e.trace AND h.sid = e.src AND h.label = 'HYPO' WHERE e.dst > e.src GROUP BY ALL), l AS (SELECT h.trace % 4 + 1 AS task, dst - src + 1 AS length FROM h) SELECT task, count(*) AS n, round(avg(length), 6) AS mean, count(*) FILTER (length <= 3) AS short, count(*) FILTER (length >= 10) AS long FROM l GROUP BY task", lambda s: G.hypothesis_cycles(s).withColumn("task", F.col("trace") % 4 + 1).groupBy("task").agg(F.count("*").alias("n"), F.avg("length").alias("mean"), F.count_if(F.col("length") <= 3).alias("short"), F.count_if(F.col("length") >= 10).alias("long")), "d")


# --- agreement and scores

_LABELS_SQL = "SELECT {} AS a, {} AS b FROM labels"
_CELLS = "+c AS (SELECT quality AS a, toxic AS b FROM labels), n AS (SELECT count(*)::DOUBLE AS n, avg((a = b)::INT) AS po, avg(a) AS x, avg(b) AS y FROM c)"


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("quality").alias("a"), F.col("toxic").alias("b"), (F.col("doc_id") % 7).alias("part"))


_add("sx01_kappa", "WITH n AS (SELECT count(*) AS n, avg((quality = toxic)::INT) AS po, avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)) AS pe FROM labels) SELECT n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM n", None)(lambda spark, d: K.kappa(_rated(spark, d), []))
_add("sx03_kappa_by_part", "WITH n AS (SELECT doc_id % 7 AS part, count(*) AS n, avg((quality = toxic)::INT) AS po, avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)) AS pe FROM labels GROUP BY 1) SELECT part, n, round(po, 6) AS agreement, CASE WHEN n >= 2 AND pe < 1 THEN round((po - pe) / (1 - pe), 6) + 0.0::DOUBLE END AS kappa FROM n", None)(lambda spark, d: K.kappa(_rated(spark, d), ["part"]))
_add("sx02_kappa_by_category", "WITH c AS (SELECT k::BIGINT AS category, (quality = k)::INT AS x, (toxic = k)::INT AS y FROM labels, (VALUES (0), (1)) v(k)), n AS (SELECT category, count(*) AS n, avg((x = y)::INT) AS po, avg(x) * avg(y) + (1 - avg(x)) * (1 - avg(y)) AS pe FROM c GROUP BY category) SELECT category, n, round(po, 6) AS agreement, CASE WHEN n >= 2 AND pe < 1 THEN round((po - pe) / (1 - pe), 6) + 0.0::DOUBLE END AS kappa FROM n", None)(lambda spark, d: K.kappa_by_category(_rated(spark, d), [0, 1]))
_add("sx05_gate", "WITH n AS (SELECT doc_id % 7 AS part, count(*) AS n, avg((quality = toxic)::INT) AS po, avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)) AS pe FROM labels GROUP BY 1) SELECT part, CASE WHEN n < 2 OR pe >= 1 THEN 'N/A' WHEN round((po - pe) / (1 - pe), 6) >= 0.0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM n", None)(lambda spark, d: K.kappa(_rated(spark, d), ["part"]).select("part", K.gate(F.round("kappa", 6), 0.0).alias("verdict")))
_add("sx06_confusion", 'SELECT quality::BIGINT AS a, count(*) FILTER (toxic = 0) AS "0", count(*) FILTER (toxic = 1) AS "1" FROM labels GROUP BY quality', None)(lambda spark, d: K.confusion(_rated(spark, d), [0, 1]))
_add("sx07_confusion_shares", "WITH c AS (SELECT quality::BIGINT AS a, toxic::BIGINT AS b, count(*) AS n FROM labels GROUP BY quality, toxic) SELECT *, round(n / sum(n) OVER (PARTITION BY a), 6) AS share FROM c", None)(lambda spark, d: K.row_shares(_rated(spark, d)))
_F1 = "WITH v AS (SELECT k, count(*) FILTER (quality = k) AS t, count(*) FILTER (toxic = k) AS p, count(*) FILTER (quality = k AND toxic = k) AS c FROM labels, (VALUES (0), (1)) v(k) GROUP BY k), f AS (SELECT k::BIGINT AS label, t AS support, coalesce(c / nullif(p, 0), 0)::DOUBLE AS precision, coalesce(c / nullif(t, 0), 0)::DOUBLE AS recall, coalesce(2 * c / nullif(t + p, 0), 0)::DOUBLE AS f1 FROM v) "
_add("ml06_class_scores", _F1 + "SELECT label, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f", None)(lambda spark, d: K.class_scores(_rated(spark, d)))
_add("ml06_overall_scores", _F1 + "SELECT round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(sum(recall * support) / sum(support), 6) AS accuracy FROM f", None)(lambda spark, d: K.overall_scores(_rated(spark, d)))

# --- text

_docs = lambda spark, d: table(spark, d, "documents")
_SENT = "list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \\t\\n\\r\\f\\v]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '')"
_add("tx04_sentence_counts", f"SELECT doc_id, len({_SENT})::BIGINT AS n FROM documents", None)(lambda spark, d: _docs(spark, d).select("doc_id", F.size(T.sentences(F.col("text"))).alias("n")))
_add("tx05_text_stats", f"WITH p AS (SELECT doc_id, {_SENT} AS p FROM documents) SELECT doc_id, len(p)::BIGINT AS n, round(coalesce(list_avg(list_transform(p, lambda x: length(x))), 0), 6) AS mean_chars FROM p", None)(lambda spark, d: _docs(spark, d).select("doc_id", T.sentences(F.col("text")).alias("p")).select("doc_id", F.size("p").alias("n"), F.coalesce(F.try_divide(F.aggregate("p", F.lit(0.0), lambda s, x: s + F.length(x)), F.size("p")), F.lit(0.0)).alias("mean_chars")))
_add("tx03_word_counts", "SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f\\v]+'))::BIGINT AS n FROM documents", None)(lambda spark, d: _docs(spark, d).select("doc_id", T.word_count(F.coalesce("text", F.lit(""))).alias("n")))
_add("tx26_foreign_share", "SELECT doc_id, round(coalesce(length(regexp_replace(text, '[\\x20-\\x7e\\t\\n\\r]', '', 'g')) / nullif(length(text), 0), 0), 6)::DOUBLE AS share FROM documents", None)(lambda spark, d: _docs(spark, d).select("doc_id", T.foreign_share(F.col("text")).alias("share")))
_REPEATS = "WITH l AS (SELECT doc_id, text, length(text) AS n FROM documents) SELECT doc_id, coalesce(n >= {0} * {1} AND len(list_filter(range(0, n - {0}, greatest(n // 500, 1)), lambda p: n - length(replace(text, substr(text, p + 1, {0}), '')) >= {0} * {1})) > 0, false) AS found FROM l"
_add("tx24_repetition", _REPEATS.format(80, 5), None)(lambda spark, d: _docs(spark, d).select("doc_id", T.repeats(F.col("text")).alias("found")))
_add("tx25_loose_repetition", _REPEATS.format(50, 3), None)(lambda spark, d: _docs(spark, d).select("doc_id", T.repeats(F.col("text"), 50, 3).alias("found")))
_add("pj17_previews", "WITH t AS (SELECT doc_id, trim(replace(text, chr(10), ' '), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) <= 180 THEN t ELSE substr(t, 1, 177) || '...' END AS preview FROM t", None)(lambda spark, d: _docs(spark, d).select("doc_id", T.preview(F.col("text")).alias("preview")))
_add("jn19_duplicate_texts", "SELECT doc_id, min(doc_id) OVER (PARTITION BY source, text) AS first_id FROM documents QUALIFY doc_id <> min(doc_id) OVER (PARTITION BY source, text)", None)(lambda spark, d: _duplicates(_docs(spark, d)))


def _duplicates(docs: DataFrame) -> DataFrame:
    """Texts meet by hash first, with counts combined before the shuffle: a large group of copies is one row by then."""
    keyed = docs.select("doc_id", "source", F.sha2("text", 256).alias("h"))
    first = keyed.groupBy("source", "h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return keyed.join(first, ["source", "h"]).where("doc_id <> first_id").select("doc_id", "first_id")


_MARKS = "[*(string_split('1.,A.,B,.,7', ','))]"
_S_TEXT = "CASE WHEN event_id % 4 = 0 THEN list_extract(['1.', 'A.', 'B', '.', '7'], event_id % 5 + 1) WHEN event_id % 9 = 1 THEN '--' ELSE 'word ' || event_id || CASE WHEN event_id % 3 = 0 THEN '' ELSE '.' END END"
_TEXTS = f"+x AS (SELECT trace, sid, n, completed, {_S_TEXT} AS text, CASE WHEN event_id % 4 = 0 THEN 1 ELSE 2 + event_id % 9 END AS tokens FROM s)"


def _texts(s: DataFrame) -> DataFrame:
    e = F.col("event_id")
    marks = F.element_at(F.array(*map(F.lit, ("1.", "A.", "B", ".", "7"))), (e % 5 + 1).cast("int"))
    text = F.when(e % 4 == 0, marks).when(e % 9 == 1, "--").otherwise(F.concat(F.lit("word "), e.cast("string"), F.when(e % 3 == 0, "").otherwise(".")))
    return s.select("trace", "sid", "completed", text.alias("text"), F.when(e % 4 == 0, 1).otherwise(2 + e % 9).cast("bigint").alias("tokens"))


def _merged_sql(odd: str) -> str:
    return f"{_TEXTS}, o AS (SELECT *, {odd} AS odd FROM x), t AS (SELECT *, coalesce(first_value(CASE WHEN NOT odd THEN sid END IGNORE NULLS) OVER (PARTITION BY trace ORDER BY sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(CASE WHEN NOT odd THEN sid END IGNORE NULLS) OVER (PARTITION BY trace ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), sid) AS target FROM o) SELECT trace, target AS sid, string_agg(text, ' ' ORDER BY sid) AS text, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS merged FROM t GROUP BY trace, target"


_on("tx09_merge_fragments", _merged_sql("tokens <= 2 AND regexp_matches(trim(text), '^([A-F0-9]\\.?|\\.)$')"), lambda s: C.merge_fragments(_texts(s)))
_on("tx17_merge_without_content", _merged_sql("NOT regexp_matches(text, '[A-Za-z0-9]')"), lambda s: C.merge_without_content(_texts(s)))
_on("tx08_fragment_kinds", _TEXTS + " SELECT CASE WHEN regexp_matches(text, '^[0-9]+\\.$') THEN 'digit_period' WHEN regexp_matches(text, '^[A-F]\\.$') THEN 'letter_period' WHEN regexp_matches(text, '^[0-9]+$') THEN 'digit_alone' WHEN regexp_matches(text, '^[A-F]$') THEN 'letter_alone' WHEN text = '.' THEN 'period_alone' ELSE 'other' END AS kind, count(*) AS n, min(text) AS example FROM x GROUP BY 1", lambda s: _texts(s).groupBy(T.fragment_kind(F.col("text")).alias("kind")).agg(F.count("*").alias("n"), F.min("text").alias("example")))
_CUT = _TEXTS + ", c AS (SELECT *, tokens <= 5 OR NOT regexp_matches(text, '[.!?\")]$') AS cut FROM x), r AS (SELECT *, min(cut::INT) OVER w AS run, row_number() OVER w AS k FROM c WINDOW w AS (PARTITION BY trace ORDER BY sid DESC)) "
_on("tx15_drop_tail", _CUT + "SELECT trace, sid, text, tokens, completed FROM r WHERE NOT (run = 1 AND k <= 10 AND NOT completed)", lambda s: C.drop_cut_off_tail(_texts(s), F.col("completed")))
_on("tx18_renumber", _CUT + "SELECT trace, sid AS old_sid, row_number() OVER (PARTITION BY trace ORDER BY sid) - 1 AS sid FROM r WHERE cut", lambda s: C.renumber(_texts(s).where(T.is_cut_off(F.col("text"), F.col("tokens")))).select("trace", "old_sid", "sid"))
_on("tx13_cut_off_reasons", _TEXTS + """ SELECT concat_ws('+', CASE WHEN tokens <= 5 THEN 'le5_tokens' END, CASE WHEN NOT regexp_matches(text, '[.!?")]$') THEN 'no_terminal_punct' END) AS reason, count(*) AS n FROM x GROUP BY 1""", lambda s: _texts(s).groupBy(T.cut_off_reason(F.col("text"), F.col("tokens")).alias("reason")).agg(F.count("*").alias("n")))
_add("tx16_split_lines", "WITH x AS (SELECT doc_id, unnest(CASE WHEN len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) > 100 THEN CASE WHEN instr(text, chr(10) || chr(10)) > 0 THEN string_split(text, chr(10) || chr(10)) ELSE string_split(text, chr(10)) END ELSE [text] END) AS p FROM documents) SELECT doc_id, count(*) AS n FROM x WHERE regexp_matches(p, '[^ \\t\\n\\r\\f\\v]') GROUP BY doc_id", None)(lambda spark, d: C.split_oversized(_docs(spark, d).select(F.col("doc_id").alias("trace"), F.lit(0).alias("sid"), "text", T.word_count(F.col("text")).alias("tokens"))).groupBy(F.col("trace").alias("doc_id")).agg(F.count("*").alias("n")))

# --- vectors

_vecs = lambda spark, d: table(spark, d, "embeddings")
_V = "CAST(embedding AS DOUBLE[])"
_add("ve03_norms", f"SELECT vec_id, round(sqrt(list_dot_product({_V}, {_V})), 5) AS norm FROM embeddings", None)(lambda spark, d: _vecs(spark, d).select("vec_id", F.round(V.norm(F.col("embedding")), 5).alias("norm")))
_add("ve05_centroid_cosines", "WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY ALL), c AS (SELECT label, list(m ORDER BY i) AS v FROM m GROUP BY label) SELECT p.label::BIGINT AS a, q.label::BIGINT AS b, round(list_cosine_similarity(p.v, q.v), 5) AS cos FROM c p JOIN c q ON p.label < q.label", None)(lambda spark, d: V.pair_cosines(V.centroids(_vecs(spark, d), "label", "embedding"), "label", "centroid").select("a", "b", F.round("cos", 5).alias("cos")))
_add("wn21_status", f"WITH v AS (SELECT vec_id // 50 AS trace, vec_id AS sid, {_V} AS v FROM embeddings), p AS (SELECT a.trace, a.sid, list_cosine_similarity(a.v, b.v) AS c FROM v a JOIN v b ON a.trace = b.trace AND b.sid < a.sid), t AS (SELECT trace, sid, max(c) AS best FROM p GROUP BY ALL) SELECT v.trace, v.sid, round(best, 5) AS best, CASE WHEN best >= 0.9 THEN 'repeated' WHEN best >= 0.7 THEN 'revised' ELSE 'novel' END AS status FROM v LEFT JOIN t ON t.trace = v.trace AND t.sid = v.sid", None)(lambda spark, d: V.status_by_similarity(_vecs(spark, d).withColumn("trace", F.floor(F.col("vec_id") / 50)), "trace", "vec_id", "embedding").select("trace", "sid", F.round("best", 5).alias("best"), "status"))
_add("ve08_vector_checks", "SELECT count(*) AS n, count(*) FILTER (len(embedding) <> 64) AS wrong_size, count(*) FILTER (len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0) AS not_finite, count(*) FILTER (list_dot_product(embedding, embedding) = 0) AS zero FROM embeddings", None)(lambda spark, d: _vecs(spark, d).agg(F.count("*").alias("n"), F.count_if(F.size("embedding") != 64).alias("wrong_size"), F.count_if(F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))).alias("not_finite"), F.count_if(V.norm(F.col("embedding")) == 0).alias("zero")))

# --- keyed pairs of conditions, trees of orders, streams as batches

_SHIFT = "WITH b AS (SELECT o_custkey AS k, avg(o_totalprice) AS x FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), t AS (SELECT o_custkey AS k, o_orderpriority AS condition, avg(o_totalprice) AS y FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL) SELECT condition, count(*) AS n, round(avg(y - x), 4) AS shift FROM t JOIN b USING (k) GROUP BY condition"


def _shift(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    price = F.col("o_totalprice").cast("double")
    base = orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.avg(price).alias("x"))
    treated = orders.where("o_orderstatus = 'O'").groupBy("o_custkey", F.col("o_orderpriority").alias("condition")).agg(F.avg(price).alias("y"))
    return treated.join(base, "o_custkey").groupBy("condition").agg(F.count("*").alias("n"), F.round(F.avg(F.col("y") - F.col("x")), 4).alias("shift"))


_add("ag39_keyed_shifts", _SHIFT, None)(_shift)
_add("st_tumbling_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL", None)(lambda spark, d: ST.tumbling_counts(table(spark, d, "events")).withColumn("total", F.round("total", 4)))
_add("st_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM k GROUP BY user_id, k", None)(lambda spark, d: ST.sessions(table(spark, d, "events")))

from tracelode.plans import more, stages, coding, files, experiments, long  # noqa: E402, F401 - they add their queries to those above
