"""Queries of the stages around the analyses: work lists, selection, keys, responses, sinks' contents, experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions import text as T
from tracelode.operators import cleaning as C
from tracelode.operators import graph as G
from tracelode.operators import rank_tests as R
from tracelode.operators import sequence as Q
from tracelode.operators import vectors as V
from tracelode.plans.catalog import _PAIRED, _TEXTS, LIST, PHASES, A, _add, _docs, _on, _paired, _texts, _vecs
from tracelode.operators import responses as R_
from tracelode.plans.facts import LABELS, table
from tracelode.plans.more import _of
from tracelode.sources import traces as S

# --- keys, selection and work lists

_KEY = "'set_' || \"set\" || '/task' || task || '/trace_' || lpad(trace::VARCHAR, 3, '0')"
_KEYS = f'+k AS (SELECT DISTINCT trace, "set", task, {_KEY} AS key FROM s)'


def _keys(s: DataFrame) -> DataFrame:
    return s.select("trace", "set", "task", S.short_key(S.trace_key(F.col("set"), F.col("task"), F.col("trace"))).alias("key")).distinct()


def _expected(s: DataFrame, first: int, last: int) -> DataFrame:
    wanted = S.expected_keys(s.sparkSession, ["a", "b"], [1, 2], first, last).select("set", "task", F.col("trace_id").alias("trace"))
    return S.missing(wanted, s, ["set", "task", "trace"])


def _expected_sql(first: int, last: int) -> str:
    return f"SELECT g.\"set\", g.task::BIGINT AS task, i.trace FROM (VALUES ('a', 1), ('a', 2), ('b', 1), ('b', 2)) g(\"set\", task), range({first}, {last + 1}) i(trace) WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.\"set\" = g.\"set\" AND s.task = g.task AND s.trace = i.trace)"


_on("sc06_work_list", _expected_sql(1, 80), lambda s: _expected(s, 1, 80))
_on("sc07_extended_work_list", _expected_sql(81, 400), lambda s: _expected(s, 81, 400))
_on("sc08_trace_range", _KEYS + " SELECT trace, key FROM k WHERE trace BETWEEN 10 AND 60", lambda s: _keys(s).where("trace BETWEEN 10 AND 60").select("trace", "key"))
_on(
    "sc10_without_derived",
    _KEYS + ", p AS (SELECT key || CASE trace % 3 WHEN 0 THEN '_coded' WHEN 1 THEN '_segmented' ELSE '' END || '.json' AS path FROM k) SELECT path FROM p WHERE NOT regexp_matches(path, '_(coded|segmented)\\.json$')",
    lambda s: _keys(s).select(F.concat("key", F.when(F.col("trace") % 3 == 0, "_coded").when(F.col("trace") % 3 == 1, "_segmented").otherwise(""), F.lit(".json")).alias("path")).where(~F.col("path").rlike(r"_(coded|segmented)\.json$")),
)
_on("sc11_key_codec", _KEYS + " SELECT replace(key, '/', '__') AS encoded, key AS decoded FROM k", lambda s: _keys(s).select(S.encode_key(F.col("key")).alias("encoded")).withColumn("decoded", S.decode_key(F.col("encoded"))))
_on("sc15_selected", _KEYS + " SELECT key FROM k WHERE key LIKE 'set_a/task1/%' OR key LIKE '%/task4/%'", lambda s: _keys(s).where(S.selector("set_a/task1, TASK4", "key")).select("key"))
_on("so02_union_of_selectors", _KEYS + " SELECT key FROM k WHERE key LIKE 'set_b/%' OR key LIKE '%/task3/%'", lambda s: _keys(s).where(S.selector("task3,set_b,task3", "key")).select("key"))
_add("sc16_number_in_name", "SELECT doc_id, coalesce(try_cast(regexp_extract(source, '([0-9]+)', 1) AS BIGINT), 0) AS number FROM documents", None)(
    lambda spark, d: _docs(spark, d).select("doc_id", F.coalesce(F.expr("try_cast(regexp_extract(source, '([0-9]+)', 1) AS BIGINT)"), F.lit(0)).alias("number"))
)
_add("ex13_default_id", "SELECT item_id, coalesce(try_cast(regexp_extract(text, '([0-9]{1,9})', 1) AS BIGINT), 0) AS id FROM benchmark", None)(
    lambda spark, d: table(spark, d, "benchmark").select("item_id", F.coalesce(F.expr("try_cast(regexp_extract(text, '([0-9]{1,9})', 1) AS BIGINT)"), F.lit(0)).alias("id"))
)
_on("st01_sorted_work_list", _KEYS + ' SELECT "set", task, trace FROM k ORDER BY "set", task DESC, trace', lambda s: _keys(s).select("set", "task", "trace").orderBy("set", F.desc("task"), "trace"))
_on("jn11_missing_keys", "SELECT DISTINCT trace FROM s WHERE trace NOT IN (SELECT trace FROM s WHERE status = 'revised')", lambda s: S.missing(s.select("trace").distinct(), s.where("status = 'revised'").select("trace"), ["trace"]))

# --- incremental tables and what sinks hold

_on("sk02_skip_done", "SELECT trace, sid FROM s WHERE trace NOT IN (SELECT trace FROM s WHERE label = 'PLAN' AND sid < 20)", lambda s: S.missing(s.select("trace", "sid"), s.where("label = 'PLAN' AND sid < 20").select("trace"), ["trace"]))
_on(
    "sk07_manifest_upsert",
    "SELECT trace AS batch_id, CASE WHEN bool_or(label = 'PLAN') THEN 'ended' ELSE 'sent' END AS state FROM s GROUP BY trace",
    lambda s: S.upserted(s.select(F.col("trace").alias("batch_id"), F.lit("sent").alias("state")).distinct(), s.where("label = 'PLAN'").select(F.col("trace").alias("batch_id"), F.lit("ended").alias("state")).distinct(), ["batch_id"]),
)
_on("sk12_markdown_rows", "SELECT '| ' || label || ' | ' || count(*) || ' |' AS line FROM s GROUP BY label", lambda s: s.groupBy("label").agg(F.count("*").alias("n")).select(F.concat(F.lit("| "), "label", F.lit(" | "), F.col("n").cast("string"), F.lit(" |")).alias("line")))
_on("sk13_metric_rows", "SELECT trace, printf('%05d', count(*)) AS n, printf('%06d', CAST(sum(tokens) AS BIGINT)) AS tokens FROM s GROUP BY trace", lambda s: s.groupBy("trace").agg(F.format_string("%05d", F.count("*")).alias("n"), F.format_string("%06d", F.sum("tokens")).alias("tokens")))
_on("sk14_summary_json", """SELECT '{"n":' || count(*) || ',"traces":' || count(DISTINCT trace) || '}' AS payload FROM s""", lambda s: s.agg(F.count("*").alias("n"), F.countDistinct("trace").alias("traces")).select(F.to_json(F.struct("n", "traces")).alias("payload")))
_on("sk16_output_check", _KEYS + ", h AS (SELECT DISTINCT trace FROM s WHERE label = 'HYPO') SELECT key, h.trace IS NOT NULL AS there FROM k LEFT JOIN h USING (trace)", lambda s: _keys(s).join(s.where("label = 'HYPO'").select("trace", F.lit(True).alias("_t")).distinct(), "trace", "left").select("key", F.coalesce("_t", F.lit(False)).alias("there")))

# --- messages and their parts

_add("pj16_numbered_turns", "SELECT conv_id, string_agg(turn || '. ' || coalesce(text, ''), chr(10) ORDER BY turn, text) AS message FROM conversations GROUP BY conv_id", None)(
    lambda spark, d: table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("t")).select("conv_id", F.array_join(F.transform("t", lambda x: F.concat(x["turn"].cast("string"), F.lit(". "), x["text"])), "\n").alias("message"))
)
_RAW = "CASE doc_id % 4 WHEN 0 THEN coalesce(text, '') WHEN 1 THEN '<think>' || coalesce(text, '') || '</think> so ' || doc_id WHEN 2 THEN coalesce(text, '') || '</think> so </think> ' || doc_id ELSE '<think>' || coalesce(text, '') END"
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_add("pj11_thinking_and_answer", f"WITH r AS (SELECT doc_id, {_RAW} AS raw FROM documents), p AS (SELECT *, instr(raw, '</think>') AS z FROM r) SELECT doc_id, CASE WHEN z > 0 THEN length(trim(replace(substr(raw, 1, z - 1), '<think>', ''), {_WS})) END AS n_thinking, CASE WHEN z > 0 THEN trim(substr(raw, z + 8), {_WS}) END AS answer FROM p", None)(
    lambda spark, d: _raw(spark, d).select("doc_id", F.length(T.thinking(F.col("raw"))).cast("bigint").alias("n_thinking"), T.answer(F.col("raw")).alias("answer"))
)


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Generated text of four forms: without tags, with both, with a closing one alone and a second in the answer, never closed."""
    text, k = F.coalesce("text", F.lit("")), F.col("doc_id").cast("string")
    closed = F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("<think>"), text, F.lit("</think> so "), k)).when(F.col("doc_id") % 4 == 2, F.concat(text, F.lit("</think> so </think> "), k))
    return _docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 4 == 0, text).when(F.col("doc_id") % 4 == 3, F.concat(F.lit("<think>"), text)).otherwise(closed).alias("raw"))


_add("pj12_truncated", "SELECT doc_id, n_chars >= 4096 AS truncated FROM documents", None)(lambda spark, d: _docs(spark, d).select("doc_id", (F.col("n_chars") >= 4096).alias("truncated")))
_add("tx28_length_mismatches", "SELECT conv_id, turn, length(text) - 5 * len(string_split(text, ' ')) AS off, abs(length(text) - 5 * len(string_split(text, ' '))) > 5 AS mismatch FROM conversations", None)(
    lambda spark, d: table(spark, d, "conversations").select("conv_id", "turn", (F.length("text") - 5 * F.size(F.split("text", " "))).cast("bigint").alias("off")).withColumn("mismatch", F.abs("off") > 5)
)
_on(
    "ag46_fragment_examples",
    _TEXTS + " SELECT text, count(*) AS n, min(trace * 1000000 + sid) AS first_at FROM x WHERE tokens <= 2 AND regexp_matches(trim(text), '^([A-F0-9]\\.?|\\.)$') GROUP BY text",
    lambda s: _texts(s).where(T.is_fragment(F.col("text"), F.col("tokens"))).groupBy("text").agg(F.count("*").alias("n"), F.min(F.col("trace") * 1000000 + F.col("sid")).alias("first_at")),
)

# --- projections and filters

_PLACE = "sid / greatest(n - 1, 1)"
_on("pj01_places", f"SELECT trace, sid, n AS trace_length, round({_PLACE}, 6) AS place FROM s", lambda s: s.select("trace", "sid", F.col("n").alias("trace_length"), (F.col("sid") / F.greatest(F.col("n") - 1, F.lit(1))).alias("place")))
_on(
    "pj04_thirds",
    f"SELECT CASE WHEN {_PLACE} <= 1 / 3 THEN 'early' WHEN {_PLACE} <= 2 / 3 THEN 'middle' ELSE 'late' END AS third, label, count(*) AS n FROM s GROUP BY ALL",
    lambda s: s.withColumn("p", F.col("sid") / F.greatest(F.col("n") - 1, F.lit(1))).groupBy(F.when(F.col("p") <= 1 / 3, "early").when(F.col("p") <= 2 / 3, "middle").otherwise("late").alias("third"), "label").agg(F.count("*").alias("n")),
)
_on(
    "pj02_strategy_lookup",
    PHASES + " SELECT s.trace, s.sid, coalesce(f.strategy, 'unknown') AS strategy FROM s LEFT JOIN f ON f.trace = s.trace AND f.trace % 2 = 0",
    lambda s: s.select("trace", "sid").join(Q.phases(s).where("trace % 2 = 0").select("trace", "strategy"), "trace", "left").na.fill("unknown", ["strategy"]),
)
_add("pj05_completed", "SELECT conv_id, turn, coalesce(regexp_matches(text, '[^ \\t\\n\\r\\f\\v]'), false) AS completed FROM conversations", None)(
    lambda spark, d: table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(F.length(T.stripped(F.col("text"))) > 0, F.lit(False)).alias("completed"))
)
_on("pj06_value_fix", "SELECT CASE specificity WHEN 'across_panel' THEN 'across_panels' ELSE specificity END AS specificity, count(*) AS n FROM s WHERE label = 'TEST' GROUP BY 1", lambda s: s.where("label = 'TEST'").groupBy(S.plural_panels(F.col("specificity")).alias("specificity")).agg(F.count("*").alias("n")))
_on(
    "pj07_broad_labels",
    "+m AS (SELECT *, CASE WHEN label = 'RULE' AND event_id % 3 = 0 THEN 'other' ELSE label END AS micro FROM s) SELECT CASE micro WHEN 'ORIENT' THEN 'SETUP' WHEN 'DESCRIBE' THEN 'OBSERVE' WHEN 'SYNTHESIZE' THEN 'OBSERVE' WHEN 'HYPO' THEN 'INVESTIGATE' WHEN 'TEST' THEN 'INVESTIGATE' WHEN 'JUDGE' THEN 'INVESTIGATE' WHEN 'PLAN' THEN 'REGULATE' WHEN 'MONITOR' THEN 'REGULATE' WHEN 'RULE' THEN 'CONCLUDE' ELSE 'UNKNOWN' END AS macro, count(*) AS n FROM m GROUP BY 1",
    lambda s: s.groupBy(R_.macro(F.when((F.col("label") == "RULE") & (F.col("event_id") % 3 == 0), "other").otherwise(F.col("label"))).alias("macro")).agg(F.count("*").alias("n")),
)
_NAME = "CASE trace % 3 WHEN 0 THEN 'baseline' WHEN 1 THEN lower(label) || '_pos_' || tokens ELSE lower(label) || '_neg_' || tokens || '.5' END"


def _conditions(s: DataFrame) -> DataFrame:
    name = F.when(F.col("trace") % 3 == 0, "baseline").when(F.col("trace") % 3 == 1, F.concat(F.lower("label"), F.lit("_pos_"), F.col("tokens").cast("string"))).otherwise(F.concat(F.lower("label"), F.lit("_neg_"), F.col("tokens").cast("string"), F.lit(".5")))
    return s.select("trace", "sid", "value", name.alias("condition"), T.condition_parts(name).alias("c"))


_on(
    "pj14_condition_parts",
    f"SELECT trace, sid, {_NAME} AS condition, CASE WHEN trace % 3 > 0 THEN label END AS category, (CASE trace % 3 WHEN 1 THEN 1 WHEN 2 THEN -1 END)::BIGINT AS direction, (CASE trace % 3 WHEN 1 THEN tokens WHEN 2 THEN tokens + 0.5 END)::DOUBLE AS alpha FROM s",
    lambda s: _conditions(s).select("trace", "sid", "condition", "c.category", "c.direction", "c.alpha"),
)
_on("pj19_durations", "SELECT trace, sid, printf('%dh %02dm', event_id // 60, event_id % 60) AS eta FROM s", lambda s: s.select("trace", "sid", F.format_string("%dh %02dm", F.floor(F.col("event_id") / 60), F.col("event_id") % 60).alias("eta")))
_add("pj20_iso_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events", None)(lambda spark, d: table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at")))
_add("pj21_elapsed_minutes", "SELECT user_id, date_sub('minute', min(ts), max(ts)) AS minutes FROM events GROUP BY user_id", None)(
    lambda spark, d: table(spark, d, "events").groupBy("user_id").agg(F.timestamp_diff("MINUTE", F.min("ts"), F.max("ts")).alias("minutes"))
)
_on(
    "pj22_filters",
    "SELECT label, count(*) AS n FROM s WHERE label IN ('HYPO', 'JUDGE', 'TEST') AND (status IS NULL OR status <> 'novel') AND NOT (label = 'JUDGE' AND judgement IS NULL) GROUP BY label",
    lambda s: s.where(F.col("label").isin("HYPO", "JUDGE", "TEST") & (F.col("status").isNull() | (F.col("status") != "novel")) & ~((F.col("label") == "JUDGE") & F.col("judgement").isNull())).groupBy("label").agg(F.count("*").alias("n")),
)
_on("pj24_known_labels", f"SELECT trace, sid, label FROM s WHERE label IN (SELECT l FROM (VALUES {LIST}) v(l, o)) AND confidence = 'high'", lambda s: s.where(F.col("label").isin(LABELS) & (F.col("confidence") == "high")).select("trace", "sid", "label"))

# --- joins and graphs

_of("jn08_hypothesis_and_judgement", "gr10_hypothesis_cycles", "SELECT trace, hypo_sid, judge_sid FROM q", lambda q: q.select("trace", "hypo_sid", "judge_sid"))
_of("jn09_two_hops", "gr14_provenance", "SELECT trace, rule_sid, judge_sid, hypo_sid FROM q", lambda q: q.select("trace", "rule_sid", "judge_sid", "hypo_sid"))
_on("jn10_edges_between_nodes", "SELECT trace, src, dst FROM e", G.edges, "d")
_HYPO = "+h AS (SELECT trace, sid, tokens FROM s WHERE label = 'HYPO'), p AS (SELECT a.trace, a.sid AS early, b.sid, 12 - abs(a.tokens - b.tokens) AS sim FROM h a JOIN h b ON a.trace = b.trace AND a.sid < b.sid)"


def _hypo_pairs(s: DataFrame) -> DataFrame:
    """Pairs of hypotheses of one trace: their number is bounded by the length of a trace."""
    h = s.where("label = 'HYPO'").select("trace", "sid", "tokens")
    early = h.select("trace", F.col("sid").alias("early"), F.col("tokens").alias("t"))
    return h.join(early, "trace").where("early < sid").select("trace", "early", "sid", (12 - F.abs(F.col("t") - F.col("tokens"))).alias("sim"))


_on("jn13_pairs_in_trace", _HYPO + " SELECT * FROM p", _hypo_pairs)
_on("jn14_best_earlier", _HYPO + " SELECT trace, sid, max(sim) AS sim, -max((sim * 1000000 - early)) + max(sim) * 1000000 AS early FROM p GROUP BY trace, sid", lambda s: _hypo_pairs(s).groupBy("trace", "sid").agg(F.max("sim").alias("sim"), F.max_by("early", F.struct("sim", -F.col("early"))).alias("early")))
_of("jn15_category_pairs", "ve05_centroid_cosines", "SELECT a, b, cos > 0 AS alike FROM q", lambda q: q.select("a", "b", (F.col("cos") > 0).alias("alike")))
_of("st02_pairs_by_similarity", "ve05_centroid_cosines", "SELECT * FROM q ORDER BY cos DESC, a, b", lambda q: q.orderBy(F.desc("cos"), "a", "b"))
_V = "CAST(embedding AS DOUBLE[])"
_HALVES = f"WITH x AS (SELECT label, vec_id % 2 AS layer, unnest({_V}) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, layer, i, avg(x) AS m FROM x GROUP BY ALL), c AS (SELECT label, layer, list(m ORDER BY i) AS v FROM m GROUP BY ALL), "


def _layers(spark: SparkSession, d: str) -> DataFrame:
    """Centroids of each label by layer; odd and even vectors stand in for two layers."""
    two = lambda k: V.centroids(_vecs(spark, d).where(F.col("vec_id") % 2 == k), "label", "embedding").select("label", F.col("centroid").alias(f"v{k}"))
    return two(0).join(two(1), "label")


_add("jn16_layer_pairs", _HALVES + "p AS (SELECT a.label, list_cosine_similarity(a.v, b.v) AS cos FROM c a JOIN c b ON a.label = b.label AND a.layer = 0 AND b.layer = 1) SELECT label::BIGINT AS label, round(cos, 5) AS cos FROM p", None)(
    lambda spark, d: _layers(spark, d).select("label", F.round(V.cosine(F.col("v0"), F.col("v1")), 5).alias("cos"))
)
_on("jn17_keyed_pairs", _PAIRED + " SELECT trace, x, y, x - y AS shift FROM t", lambda s: _paired(s).select("trace", "x", "y", (F.col("x") - F.col("y")).alias("shift")))
_on("gr05_standard_errors", "SELECT label, count(*) AS n, round(stddev_samp(tokens) / sqrt(count(*)), 6) AS se FROM s GROUP BY label", lambda s: s.groupBy("label").agg(F.count("*").alias("n"), (F.stddev_samp("tokens") / F.sqrt(F.count("*"))).alias("se")))
_on("ag37_stage_summary", "SELECT label, count(*) AS n, count(*) FILTER (len(depends_on) > 0) AS n_with, CAST(sum(len(depends_on)) AS BIGINT) AS n_deps FROM d GROUP BY label", lambda s: G.coverage(s).select("label", "n", "n_with", "n_deps"), "d")
_of("wn14_longest_run_label", "wn13_longest_run", "SELECT trace, label FROM q", lambda q: q.select("trace", "label"))

# --- verdicts and experiments


def _stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


_DIMS = f"WITH x AS (SELECT vec_id, label, unnest({_V}) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), z AS (SELECT i, avg(x) AS mean, stddev_pop(x) AS sd FROM x GROUP BY i) "


def _dims(spark: SparkSession, d: str) -> DataFrame:
    rows = _vecs(spark, d).select("vec_id", "label", F.posexplode("embedding").alias("i", "x"))
    return rows.select("vec_id", "label", (F.col("i") + 1).cast("bigint").alias("i"), F.col("x").cast("double").alias("x"))


def _scales(spark: SparkSession, d: str) -> DataFrame:
    return _dims(spark, d).groupBy("i").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))


_add("ml02_scales", _DIMS + "SELECT i, round(mean, 5) AS mean, round(sd, 5) AS sd FROM z", None)(lambda spark, d: _scales(spark, d).select("i", F.round("mean", 5).alias("mean"), F.round("sd", 5).alias("sd")))
_add("ve04_descaled", _DIMS + "SELECT label::BIGINT AS label, i, round(avg(x) / sd, 4) AS w FROM x JOIN z USING (i) GROUP BY label, i, sd", None)(
    lambda spark, d: _dims(spark, d).groupBy("label", "i").agg(F.avg("x").alias("c")).join(F.broadcast(_scales(spark, d)), "i").select("label", "i", F.round(F.try_divide("c", "sd"), 4).alias("w"))  # a row a dimension
)
_MEANS = _DIMS + ", n AS (SELECT avg(sqrt(list_dot_product(" + _V + ", " + _V + "))) AS norm FROM embeddings), a AS (SELECT i, avg(x) FILTER (label = {0}) - avg(x) FILTER (label <> {0}) AS v FROM x GROUP BY i), l AS (SELECT sqrt(sum(v * v)) AS len FROM a) "


def _direction(spark: SparkSession, d: str, label: int) -> DataFrame:
    """Difference of a label's mean and the others', rescaled to the mean norm; one row a dimension."""
    a = _dims(spark, d).groupBy("i").agg((F.avg(F.when(F.col("label") == label, F.col("x"))) - F.avg(F.when(F.col("label") != label, F.col("x")))).alias("v"))
    size = a.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("len"))
    norm = _vecs(spark, d).agg(F.avg(V.norm(F.col("embedding"))).alias("norm"))
    return a.join(F.broadcast(size.join(F.broadcast(norm))))  # one row each


_add("ve06_rescaled_direction", _MEANS.format(0) + "SELECT i, round(v / len * norm, 4) AS v FROM a, l, n", None)(lambda spark, d: _direction(spark, d, 0).select("i", F.round(F.try_divide("v", "len") * F.col("norm"), 4).alias("v")))
_add("ex14_direction_of_category", _MEANS.format(3) + "SELECT i, round(v, 4) AS v FROM a", None)(lambda spark, d: _direction(spark, d, 3).select("i", F.round("v", 4).alias("v")))
_add("ex04_added_direction", f"SELECT vec_id, round(list_sum(list_transform({_V}, lambda x: x + 0.5::DOUBLE * x)), 4) AS total FROM embeddings", None)(
    lambda spark, d: _vecs(spark, d).select("vec_id", F.round(F.aggregate(V.added(F.transform("embedding", lambda x: x.cast("double")), F.transform("embedding", lambda x: x.cast("double")), 0.5), F.lit(0.0), lambda t, x: t + x), 4).alias("total"))
)
_of("ml01_fold_balance", "wn24_folds", "SELECT task, fold, count(*) AS n FROM q GROUP BY ALL", lambda q: q.groupBy("task", "fold").agg(F.count("*").alias("n")))
#: Layers, poolings and penalties of the probe grid.
_GRID = ([0, 10, 20, 31], ["mean_pool", "last_token"], [0.01, 0.1, 1.0, 10.0])
_add("ml07_grid", f"SELECT l AS layer, a AS aggregation, c::DOUBLE AS c FROM (SELECT unnest({_GRID[0]})::BIGINT AS l), (SELECT unnest({_GRID[1]}) AS a), (SELECT unnest({_GRID[2]}) AS c)", None)(lambda spark, d: _grid(spark))


def _grid(spark: SparkSession) -> DataFrame:
    out = spark.range(1)
    for name, values in zip(("layer", "aggregation", "c"), _GRID):
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out.drop("id")


_CHECKS = {"no_label": "label IS NULL", "unknown_label": "label NOT IN ('ORIENT', 'PLAN', 'DESCRIBE', 'SYNTHESIZE', 'HYPO', 'TEST', 'JUDGE', 'MONITOR', 'RULE')", "no_tokens": "tokens <= 0", "bad_place": "sid >= n", "no_task": "task IS NULL", "stray_antecedent": "antecedent IS NOT NULL AND label <> 'HYPO'", "late_antecedent": "antecedent >= sid"}
_on("ml13_preparation_checks", " UNION ALL ".join(f'SELECT \'{k}\' AS "check", count(*) FILTER ({v}) AS n_issues FROM s' for k, v in _CHECKS.items()), lambda s: A.checks(s, {k: F.expr(v) for k, v in _CHECKS.items()}))
_on(
    "ex07_pilot_verdict",
    "SELECT task, CASE WHEN bool_and(tokens <= 12) AND count(DISTINCT label) >= 2 AND bool_and(label <> '') THEN 'GO' ELSE 'NO-GO' END AS verdict FROM s GROUP BY task",
    lambda s: s.groupBy("task").agg(F.when(F.bool_and(F.col("tokens") <= 12) & (F.count_distinct("label") >= 2) & F.bool_and(F.col("label") != ""), "GO").otherwise("NO-GO").alias("verdict")),
)
_on(
    "ex08_requests",
    f"+t AS (SELECT trace, any_value({_KEY}) AS key, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS n FROM s GROUP BY trace) SELECT replace(key, '/', '__') AS custom_id, tokens, round((tokens * 1.5 + n * 7.5) / 1000000, 8)::DOUBLE > 0.001 AS costly FROM t",
    lambda s: s.groupBy("trace").agg(F.first(S.short_key(S.trace_key(F.col("set"), F.col("task"), F.col("trace")))).alias("key"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")).select(S.encode_key(F.col("key")).alias("custom_id"), "tokens", ((F.col("tokens") * 1.5 + F.col("n") * 7.5) / 1e6 > 0.001).alias("costly")),
)
_add("ex09_status_counts", "SELECT user_id, event_type AS status, count(*) AS n, date_sub('minute', min(ts), max(ts)) AS age FROM events GROUP BY ALL", None)(
    lambda spark, d: table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("status")).agg(F.count("*").alias("n"), F.timestamp_diff("MINUTE", F.min("ts"), F.max("ts")).alias("age"))
)
_add("ex11_latest_batch", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS batch_id FROM events GROUP BY user_id", None)(lambda spark, d: table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("batch_id")))
_on("ex15_paths", _KEYS + " SELECT trace, 'out/' || key || '.json' AS path FROM k", lambda s: _keys(s).select("trace", F.concat(F.lit("out/"), "key", F.lit(".json")).alias("path")))

