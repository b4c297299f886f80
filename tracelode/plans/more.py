"""Further queries of the catalogue: lookups, set operations, top lists, summaries of other queries' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelode.functions import text as T
from tracelode.operators import graph as G
from tracelode.operators import sequence as Q
from tracelode.operators import vectors as V
from tracelode.plans.catalog import _CUT, _DESC, _QUERIES, _SQL, _TEXTS, PHASES, A, _add, _docs, _on, _text, _texts, _vecs
from tracelode.plans.facts import NUMBERED, table
from tracelode.sources import traces as S


def _of(name: str, base: str, sql: str, of: Callable[[DataFrame], DataFrame]) -> None:
    """A query over the result of another one, q in SQL."""
    _add(name, f"WITH q AS ({_SQL[base]}) {sql}", None)(lambda spark, d: of(_QUERIES[base](spark, d)))


def _traces(s: DataFrame, *columns: str) -> DataFrame:
    return s.groupBy("trace").agg(*[F.first(c).alias(c) for c in columns])


def _first(rows: DataFrame, k: int, keys: list[str], *order) -> DataFrame:
    """The first k rows of each group."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


# --- sequences

def _hypo():
    return F.min(F.when(F.col("label") == "HYPO", F.col("sid")))


_on("wn08_first_hypo", "SELECT trace, min(CASE WHEN label = 'HYPO' THEN sid END) AS first_hypo, round(min(CASE WHEN label = 'HYPO' THEN sid END) / greatest(any_value(n) - 1, 1), 6)::DOUBLE AS place FROM s GROUP BY trace", lambda s: s.groupBy("trace").agg(_hypo().alias("first_hypo"), (_hypo() / F.greatest(F.first("n") - 1, F.lit(1))).alias("place")))
_on("wn09_last_judge", PHASES + "SELECT trace, j AS last_judge FROM g", lambda s: s.withColumn("h", _hypo().over(Window.partitionBy("trace"))).groupBy("trace").agg(F.max(F.when((F.col("label") == "JUDGE") & (F.col("sid") > F.col("h")), F.col("sid"))).alias("last_judge")))
_on("wn18_latest_few", "SELECT trace, sid, array_to_string(([x.sid FOR x IN l20 IF x.label = 'TEST'])[-3:], ',') AS found FROM w2", lambda s: s.select("trace", "sid", _text(Q.latest_few(("TEST",), 20, 3)).alias("found")), "d")
_on("wn22_write_back", """SELECT trace, sid, CASE WHEN event_id % 2 = 0 THEN 'novel' ELSE status END AS status, CASE WHEN event_id % 2 = 0 THEN NULL ELSE antecedent END AS antecedent FROM s WHERE label = 'HYPO'""", lambda s: _write_back(s.where("label = 'HYPO'")))
_on("wn23_early_labels", "SELECT trace, label, min(sid) AS first_sid FROM s WHERE sid < 5 GROUP BY ALL", lambda s: s.where("sid < 5").groupBy("trace", "label").agg(F.min("sid").alias("first_sid")))
_on("wn25_span_order", "+p AS (SELECT trace, event_id % 50 AS a, lag(event_id % 50 + tokens) OVER (PARTITION BY trace ORDER BY sid) AS before FROM s) SELECT trace, count(*) FILTER (before > a) AS n FROM p GROUP BY trace", lambda s: s.withColumn("a", F.col("event_id") % 50).withColumn("before", F.lag(F.col("a") + F.col("tokens")).over(Q.trace_order())).groupBy("trace").agg(F.count_if(F.col("before") > F.col("a")).alias("n")))
_on("wn26_winners", '+c AS (SELECT "set", label, count(*) AS n FROM s GROUP BY ALL) SELECT "set", label, n FROM c QUALIFY row_number() OVER (PARTITION BY "set" ORDER BY n DESC, label DESC) = 1', lambda s: s.groupBy("set", "label").agg(F.count("*").alias("n")).groupBy("set").agg(F.max_by("label", F.struct("n", "label")).alias("label"), F.max("n").alias("n")))


def _write_back(hypo: DataFrame) -> DataFrame:
    """New statuses over old ones; a novel row keeps no antecedent."""
    new = hypo.where("event_id % 2 = 0").select("trace", "sid", F.lit("novel").alias("_new"))
    joined = hypo.join(new, ["trace", "sid"], "left").withColumn("_old", F.col("antecedent"))
    return joined.select("trace", "sid", F.coalesce("_new", "status").alias("status"), F.when(F.coalesce("_new", "status") != "novel", F.col("_old")).alias("antecedent"))


# --- summaries

_on("ag09_describe", "SELECT task, " + _DESC.format("tokens") + " FROM s GROUP BY task", lambda s: A.described(s, ["task"], "tokens"))
_on("ag12_phase_summaries", PHASES + ", t AS (SELECT trace, any_value(task) AS task, any_value(completed) AS completed FROM s GROUP BY trace) SELECT task, completed, strategy, count(*) AS n, round(avg(f.a), 6) AS mean FROM f JOIN t USING (trace) GROUP BY GROUPING SETS ((task), (completed), (strategy))", lambda s: Q.phases(s).join(_traces(s, "task", "completed"), "trace").groupingSets([[F.col("task")], [F.col("completed")], [F.col("strategy")]], "task", "completed", "strategy").agg(F.count("*").alias("n"), F.avg("scanning").alias("mean")))
_on("ag16_budget_ranges", "SELECT task, count(*) FILTER (tokens <= 4) AS low, count(*) FILTER (tokens BETWEEN 5 AND 8) AS middle, count(*) FILTER (tokens > 8) AS high FROM s GROUP BY task", lambda s: s.groupBy("task").agg(F.count_if(F.col("tokens") <= 4).alias("low"), F.count_if(F.col("tokens").between(5, 8)).alias("middle"), F.count_if(F.col("tokens") > 8).alias("high")))
_on("ag17_extreme_lengths", "SELECT trace, sid, tokens FROM s WHERE tokens <= 2 OR tokens >= 12 ORDER BY tokens DESC, trace, sid LIMIT 20", lambda s: s.where("tokens <= 2 OR tokens >= 12").orderBy(F.desc("tokens"), "trace", "sid").limit(20).select("trace", "sid", "tokens"))
_on("ag20_group_filter", "SELECT trace, count(*) AS n FROM s GROUP BY trace HAVING any_value(completed)", lambda s: s.groupBy("trace").agg(F.count("*").alias("n"), F.first("completed").alias("c")).where("c").drop("c"))
_of("ag29_chain_lengths", "gr12_chains", "SELECT trace % 4 + 1 AS task, count(*) AS n, round(avg(length), 6) AS mean, max(length) AS most FROM q GROUP BY 1", lambda q: q.groupBy((F.col("trace") % 4 + 1).alias("task")).agg(F.count("*").alias("n"), F.avg("length").alias("mean"), F.max("length").alias("most")))
_of("ag30_perseverative", "gr13_longest_chain", "SELECT count(*) FILTER (most >= 5) AS n, round(avg((most >= 5)::INT), 6) AS share FROM q", lambda q: q.agg(F.count_if(F.col("most") >= 5).alias("n"), F.avg((F.col("most") >= 5).cast("int")).alias("share")))
_of("ag27_outcomes", "gr10_hypothesis_cycles", "SELECT outcome, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM q GROUP BY outcome", lambda q: q.groupBy("outcome").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())))
_of("gr11_cycle_lengths", "gr10_hypothesis_cycles", "SELECT trace, length FROM q", lambda q: q.select("trace", "length"))
_on("ag26_cycle_rate", "+h AS (SELECT DISTINCT e.trace, e.src FROM e JOIN d j ON j.trace = e.trace AND j.sid = e.dst AND j.label = 'JUDGE' JOIN d h ON h.trace = e.trace AND h.sid = e.src AND h.label = 'HYPO' WHERE e.dst > e.src) SELECT round((SELECT count(*) FROM h) / (SELECT count(*) FROM s WHERE label = 'HYPO'), 6)::DOUBLE AS rate", lambda s: _cycle_rate(s), "d")
_of("ag38_mean_row", "sx03_kappa_by_part", "SELECT part::VARCHAR AS part, kappa FROM q UNION ALL SELECT 'MEAN', round(avg(kappa), 6) FROM q", lambda q: q.select(F.col("part").cast("string"), "kappa").unionByName(q.agg(F.lit("MEAN").alias("part"), F.avg("kappa").alias("kappa"))))
_of("ag40_mean_norm", "ve03_norms", "SELECT round(avg(norm), 4) AS mean FROM (SELECT norm FROM q ORDER BY md5('3:' || vec_id), vec_id LIMIT 50)", lambda q: A.sample(q, 50, 3, "vec_id").agg(F.round(F.avg("norm"), 4).alias("mean")))
_on("ag41_condition_counters", 'SELECT "set", count(DISTINCT trace) AS traces, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM s GROUP BY "set"', lambda s: s.groupBy("set").agg(F.countDistinct("trace").alias("traces"), F.count("*").alias("n"), F.sum("tokens").alias("tokens")))
_on("ag42_distinct_values", 'SELECT task, "set", count(DISTINCT confidence) AS n FROM s GROUP BY task, "set" HAVING count(DISTINCT confidence) > 1', lambda s: s.groupBy("task", "set").agg(F.countDistinct("confidence").alias("n")).where("n > 1"))
_on("ag43_parameter_mismatches", """SELECT DISTINCT trace, task, "set" FROM s JOIN (VALUES (1, 'a'), (2, 'a'), (3, 'a'), (4, 'b')) v(t, wanted) ON t = task WHERE "set" <> wanted""", lambda s: _mismatches(s))
_on("ag45_pivot", """SELECT task, round(avg(tokens) FILTER ("set" = 'a'), 6) AS a, round(avg(tokens) FILTER ("set" = 'b'), 6) AS b FROM s GROUP BY task""", lambda s: s.groupBy("task").pivot("set", ["a", "b"]).agg(F.avg("tokens")))
_of("ag47_verdict", "ag18_checks", "SELECT CASE max(CASE WHEN n_issues = 0 THEN 0 WHEN n_issues < 10 THEN 1 ELSE 2 END) WHEN 0 THEN 'PASS' WHEN 1 THEN 'WARN' ELSE 'FAIL' END AS verdict FROM q", lambda q: q.agg(F.max(F.when(F.col("n_issues") == 0, 0).when(F.col("n_issues") < 10, 1).otherwise(2)).alias("m")).select(F.when(F.col("m") == 0, "PASS").when(F.col("m") == 1, "WARN").otherwise("FAIL").alias("verdict")))


def _cycle_rate(s: DataFrame) -> DataFrame:
    closed = G.hypothesis_cycles(s).agg(F.count("*").alias("k"))
    return s.where("label = 'HYPO'").agg(F.count("*").alias("h")).join(F.broadcast(closed)).select(F.try_divide("k", "h").alias("rate"))  # one row each


def _mismatches(s: DataFrame) -> DataFrame:
    wanted = s.sparkSession.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b")], "task bigint, wanted string")
    return s.select("trace", "task", "set").distinct().join(F.broadcast(wanted), "task").where(F.col("set") != F.col("wanted")).drop("wanted")  # four rows


# --- joins and lookups

_add("jn02_inner_merge", "SELECT d.doc_id, d.lang AS label_auto, l.quality AS label_manual FROM documents d JOIN labels l ON l.doc_id = d.doc_id", None)(lambda spark, d: _docs(spark, d).select("doc_id", F.col("lang").alias("label_auto")).join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("label_manual")), "doc_id"))
_on("jn03_common_keys", "SELECT trace FROM s WHERE label = 'HYPO' INTERSECT SELECT trace FROM s WHERE label = 'JUDGE'", lambda s: s.where("label = 'HYPO'").select("trace").distinct().join(s.where("label = 'JUDGE'").select("trace"), "trace", "left_semi"))
_on("jn04_listed_traces", "SELECT trace, sid, label FROM s WHERE trace IN (1, 2, 3, 5, 8, 13)", lambda s: s.where(F.col("trace").isin(1, 2, 3, 5, 8, 13)).select("trace", "sid", "label"))
_add("jn05_lookup", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey", None)(lambda spark, d: table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name"))
_on("jn06_sentence_folds", "+g AS (SELECT DISTINCT task, trace FROM s), f AS (SELECT task, trace, (row_number() OVER (PARTITION BY task ORDER BY md5(CAST(trace AS VARCHAR)), trace) - 1) % 5 AS fold FROM g) SELECT trace, sid, fold FROM s JOIN f USING (task, trace)", lambda s: s.join(V.group_folds(s, "task", "trace"), ["task", "trace"]).select("trace", "sid", "fold"))
_on("jn07_default_lookup", "SELECT s.trace, s.sid, coalesce(j.tokens, -1) AS span FROM s LEFT JOIN (SELECT trace, sid, tokens FROM s WHERE label = 'JUDGE') j ON j.trace = s.trace AND j.sid = s.sid", lambda s: s.select("trace", "sid").join(s.where("label = 'JUDGE'").select("trace", "sid", F.col("tokens").alias("span")), ["trace", "sid"], "left").na.fill(-1, ["span"]))
_add("jn12_not_yet_labelled", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)", None)(lambda spark, d: S.missing(_docs(spark, d).select("doc_id"), table(spark, d, "labels").select("doc_id"), ["doc_id"]))
_on("gr02_acyclic", "SELECT n.trace, coalesce(bool_and(src < dst), true) AS acyclic FROM (SELECT DISTINCT trace FROM s) n LEFT JOIN e ON e.trace = n.trace GROUP BY n.trace", lambda s: G.shape(s).select("trace", "acyclic"), "d")

# --- top lists and set operations

_on("st03_most_flagged", "SELECT trace, count(*) FILTER (confidence = 'medium') AS medium, count(*) FILTER (judgement = 'uncertain') AS uncertain FROM s GROUP BY trace ORDER BY medium DESC, uncertain DESC, trace DESC LIMIT 20", lambda s: s.groupBy("trace").agg(F.count_if(F.col("confidence") == "medium").alias("medium"), F.count_if(F.col("judgement") == "uncertain").alias("uncertain")).orderBy(F.desc("medium"), F.desc("uncertain"), F.desc("trace")).limit(20))
_of("st04_reason_histogram", "tx13_cut_off_reasons", "SELECT r AS reason, CAST(sum(n) AS BIGINT) AS n FROM (SELECT unnest(string_split(reason, '+')) AS r, n FROM q) GROUP BY r", lambda q: q.select(F.explode(F.split("reason", r"\+")).alias("reason"), "n").groupBy("reason").agg(F.sum("n").alias("n")))
_of("st05_top_confusions", "wn01_transitions", "SELECT from_label, to_label, n FROM q WHERE from_label <> to_label ORDER BY n DESC, from_label, to_label LIMIT 10", lambda q: q.where("from_label <> to_label").orderBy(F.desc("n"), "from_label", "to_label").limit(10))
_of("st06_top_and_bottom", "ve05_centroid_cosines", "SELECT * FROM (SELECT 'top' AS side, a, b, cos FROM q ORDER BY cos DESC, a, b LIMIT 5) UNION ALL SELECT * FROM (SELECT 'bottom', a, b, cos FROM q ORDER BY cos, a, b LIMIT 3)", lambda q: q.orderBy(F.desc("cos"), "a", "b").limit(5).withColumn("side", F.lit("top")).unionByName(q.orderBy("cos", "a", "b").limit(3).withColumn("side", F.lit("bottom"))))
_on("st10_first_answered", '+t AS (SELECT DISTINCT "set", task, trace FROM s WHERE completed) SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY "set", task ORDER BY trace) <= 5', lambda s: _first(s.where("completed").select("set", "task", "trace").distinct(), 5, ["set", "task"], "trace"))
_on("so01_union_all", "SELECT label, count(*) AS n FROM (SELECT label FROM s WHERE task = 1 UNION ALL SELECT judgement FROM s WHERE judgement IS NOT NULL) GROUP BY label", lambda s: s.where("task = 1").select("label").unionByName(s.where("judgement IS NOT NULL").select(F.col("judgement").alias("label"))).groupBy("label").agg(F.count("*").alias("n")))
_on("so03_union", "SELECT trace FROM s WHERE label = 'PLAN' UNION SELECT trace FROM s WHERE label = 'SYNTHESIZE'", lambda s: s.where("label = 'PLAN'").select("trace").union(s.where("label = 'SYNTHESIZE'").select("trace")).distinct())
_on("so05_difference", "SELECT DISTINCT trace FROM s WHERE trace NOT IN (SELECT trace FROM s WHERE label = 'PLAN')", lambda s: S.missing(s.select("trace").distinct(), s.where("label = 'PLAN'").select("trace"), ["trace"]))
_on("so06_keep_last", "SELECT trace, label, sid FROM s QUALIFY row_number() OVER (PARTITION BY trace, label ORDER BY sid DESC) = 1", lambda s: A.keep_last(s.select("trace", "label", "sid"), ["trace", "label"], ["sid"]))
_on("sk05_schema_evolution", "SELECT trace, CAST(max(CASE WHEN task > 2 THEN 1 ELSE 0 END) AS BIGINT) AS v, max(CASE WHEN task > 2 THEN task END) AS w FROM s GROUP BY trace", lambda s: S.upserted(s.select("trace").distinct().withColumn("v", F.lit(0)), s.where("task > 2").select("trace", F.col("task").alias("w")).distinct().withColumn("v", F.lit(1)), ["trace"]))

# --- scores and gates

_add("sx04_raw_agreement", "SELECT round(100 * avg((quality = toxic)::INT), 1) AS pct FROM labels", None)(lambda spark, d: table(spark, d, "labels").agg(F.round(100 * F.avg((F.col("quality") == F.col("toxic")).cast("int")), 1).alias("pct")))
_of("sx17_hold", "sx16_trace_status", "SELECT count(*) FILTER (status = 'FAIL') AS failed, CASE WHEN count(*) FILTER (status = 'FAIL') > 0 THEN 'HOLD' ELSE 'PROCEED' END AS verdict FROM q", lambda q: q.agg(F.count_if(F.col("status") == "FAIL").alias("failed")).withColumn("verdict", F.when(F.col("failed") > 0, "HOLD").otherwise("PROCEED")))
_of("sx18_thresholds", "wn21_status", "SELECT t::DOUBLE AS threshold, count(*) FILTER (best >= t) AS n FROM q, (VALUES (0.1), (0.3), (0.5), (0.7), (0.9)) v(t) GROUP BY t", lambda q: q.agg(*[F.count_if(F.col("best") >= t).alias(str(t)) for t in (0.1, 0.3, 0.5, 0.7, 0.9)]).unpivot([], [f"`{t}`" for t in (0.1, 0.3, 0.5, 0.7, 0.9)], "t", "n").select(F.col("t").cast("double").alias("threshold"), "n"))
_of("sx19_band_samples", "wn21_status", "SELECT band, sid FROM (SELECT sid, CASE WHEN best >= 0.4 THEN 'high' WHEN best >= 0.3 THEN 'middle' ELSE 'low' END AS band FROM q) QUALIFY row_number() OVER (PARTITION BY band ORDER BY md5('5:' || sid), sid) <= 3", lambda q: _first(q.select("sid", F.when(F.col("best") >= 0.4, "high").when(F.col("best") >= 0.3, "middle").otherwise("low").alias("band")), 3, ["band"], F.md5(F.concat(F.lit("5:"), F.col("sid").cast("string"))), "sid"))
_on("sx21_readiness", "SELECT task, count(DISTINCT trace) AS n, count(DISTINCT trace) >= 10 AS ready FROM s WHERE completed GROUP BY task", lambda s: s.where("completed").groupBy("task").agg(F.countDistinct("trace").alias("n")).withColumn("ready", F.col("n") >= 10))
_of("ml11_tiers", "ml06_class_scores", "SELECT label, CASE WHEN f1 > 0.6 THEN 'strong' WHEN f1 >= 0.4 THEN 'moderate' ELSE 'weak' END AS tier FROM q", lambda q: q.select("label", F.when(F.col("f1") > 0.6, "strong").when(F.col("f1") >= 0.4, "moderate").otherwise("weak").alias("tier")))
_add("ve02_dot", "WITH n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, lead(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY label ORDER BY vec_id) AS w FROM embeddings) SELECT vec_id, round(list_dot_product(v, w), 4) AS dot FROM n WHERE w IS NOT NULL", None)(lambda spark, d: _vecs(spark, d).withColumn("w", F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))).where("w IS NOT NULL").select("vec_id", F.round(V.dot(F.col("embedding"), F.col("w")), 4).alias("dot")))
_add("ve07_span_means", "SELECT vec_id, round(list_avg(CAST(embedding AS DOUBLE[])[3:10]), 5) AS mean FROM embeddings", None)(lambda spark, d: _vecs(spark, d).select("vec_id", F.round(F.aggregate(F.slice("embedding", 3, 8), F.lit(0.0), lambda s, x: s + x.cast("double")) / 8, 5).alias("mean")))

# --- projections and text

_on("pj08_label_index", "SELECT trace, sid, CASE label WHEN 'ORIENT' THEN 0 WHEN 'DESCRIBE' THEN 1 WHEN 'SYNTHESIZE' THEN 2 WHEN 'HYPO' THEN 3 WHEN 'TEST' THEN 4 WHEN 'JUDGE' THEN 5 WHEN 'PLAN' THEN 6 WHEN 'MONITOR' THEN 7 WHEN 'RULE' THEN 8 END::BIGINT AS k FROM s", lambda s: s.select("trace", "sid", F.create_map(*[F.lit(x) for kv in zip(NUMBERED, range(len(NUMBERED))) for x in kv])[F.col("label")].alias("k")))
_GROUP = "CASE WHEN \"set\" = 'a' THEN 'Set A' WHEN \"set\" = 'b' AND budget = 4096 THEN 'Set B (4096)' WHEN \"set\" = 'b' AND budget = 6144 THEN 'Set B (6144)' ELSE 'UNEXPECTED' END"
_on("pj09_groups", f"SELECT {_GROUP} AS grp, count(DISTINCT trace) AS n FROM s GROUP BY 1", lambda s: s.groupBy(S.trace_group(F.col("set"), F.col("budget")).alias("grp")).agg(F.countDistinct("trace").alias("n")))
_on("pj10_groups_and_unexpected", f"SELECT DISTINCT trace, {_GROUP} AS grp, {_GROUP} = 'UNEXPECTED' AS unexpected FROM s", lambda s: s.select("trace", S.trace_group(F.col("set"), F.col("budget")).alias("grp")).distinct().withColumn("unexpected", F.col("grp") == "UNEXPECTED"))
_on("pj13_seeds", "SELECT DISTINCT trace, task * 1000 + CASE WHEN \"set\" = 'b' THEN 500 ELSE 0 END + trace AS seed, task * 1000 + 800 + trace AS steered_seed FROM s", lambda s: s.select("trace", S.seed(F.col("set"), F.col("task"), F.col("trace")).alias("seed"), S.steered_seed(F.col("task"), F.col("trace")).alias("steered_seed")).distinct())
_on("pj18_safe_share", "SELECT trace, round(coalesce(100 * (count(*) FILTER (judgement = 'accept')) / nullif(count(judgement), 0), 0), 6)::DOUBLE AS pct FROM s GROUP BY trace", lambda s: s.groupBy("trace").agg(F.count_if(F.col("judgement") == "accept").alias("a"), F.count("judgement").alias("b")).select("trace", T.share(F.col("a"), F.col("b")).alias("pct")))
_on("sc13_key_from_path", "SELECT DISTINCT trace, 'set_' || \"set\" || '/task' || task || '/trace_' || lpad(trace::VARCHAR, 3, '0') AS key FROM s", lambda s: s.select("trace", "set", "task").distinct().select("trace", S.key_from_path(F.concat(F.lit("file:/in/"), S.short_key(S.trace_key(F.col("set"), F.col("task"), F.col("trace"))), F.lit(".json"))).alias("key")))
_add("tx06_to_budget", "SELECT doc_id, CASE WHEN n_chars > 4096 THEN CAST(floor(length(text) * 4096.0::DOUBLE / n_chars) AS BIGINT) ELSE length(text) END AS n FROM documents", None)(lambda spark, d: _docs(spark, d).select("doc_id", F.length(T.to_budget(F.col("text"), F.col("n_chars"))).alias("n")))
_on("tx14_cut_off_short", _CUT + "SELECT trace, sid FROM r WHERE cut AND tokens <= 8", lambda s: _texts(s).where(T.is_cut_off(F.col("text"), F.col("tokens"), 8)).select("trace", "sid"))
_on("tx07_fragments", _TEXTS + " SELECT trace, sid, text FROM x WHERE tokens <= 2 AND regexp_matches(trim(text), '^([A-F0-9]\\.?|\\.)$')", lambda s: _texts(s).where(T.is_fragment(F.col("text"), F.col("tokens"))).select("trace", "sid", "text"))
_add("tx21_answered", "SELECT conv_id, coalesce(bool_or(role = 'assistant' AND regexp_matches(text, '[^ \\t\\n\\r\\f\\v]')), false) AS answered FROM conversations GROUP BY conv_id", None)(lambda spark, d: table(spark, d, "conversations").groupBy("conv_id").agg(F.coalesce(F.bool_or((F.col("role") == "assistant") & (T.stripped(F.col("text")) != "")), F.lit(False)).alias("answered")))
