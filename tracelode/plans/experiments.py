"""Queries of graphs, tests, probes and steering: shapes and cycles of dependency graphs, post-hoc tests, scores by group, shifts by condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions import text as T
from tracelode.operators import agreement as K
from tracelode.operators import exact_tests as X
from tracelode.operators import folds as FO
from tracelode.operators import graph as G
from tracelode.operators import grid as P
from tracelode.operators import quality as Y
from tracelode.operators import rank_tests as R
from tracelode.operators import steering as E
from tracelode.operators import vectors as V
from tracelode.plans.catalog import _RANK, _add, _docs, _on, _vecs
from tracelode.plans.facts import JUDGEMENT, LABELS, MACRO, SPECIFICITY, SQL, TEST_CONTEXT, sentences, table

# --- graphs: depths and components are folded over a trace's nodes in order

_FOLD = """+g AS (SELECT trace, list([x FOR x IN depends_on IF x < n AND x >= 0] ORDER BY sid) AS deps, count(*) AS n_nodes, any_value(task) AS task, any_value("set") AS "set", any_value(completed) AS completed FROM d GROUP BY trace),
z AS (SELECT *, list_reduce(list_prepend([]::BIGINT[], deps), lambda acc, e: list_append(acc, coalesce(list_max(list_transform(e, lambda x: acc[x + 1])) + 1, 0))) AS depth,
  list_reduce(list_prepend([]::BIGINT[], deps), lambda acc, e: list_append(list_transform(acc, lambda y: CASE WHEN list_contains(list_transform(e, lambda x: acc[x + 1]), y) THEN len(acc) ELSE y END), len(acc))) AS part FROM g) """
_on("gr07_components", _FOLD + "SELECT trace, len(list_distinct(part))::BIGINT AS n_components FROM z", lambda s: G.shape(s).select("trace", "n_components"), "d")
_on("gr08_longest_path", _FOLD + "SELECT trace, list_max(depth) AS longest_path FROM z", lambda s: G.shape(s).select("trace", "longest_path"), "d")
_on(
    "gr09_metric_row",
    _FOLD + ", q AS (SELECT trace, round(avg(n_declared), 3) AS mean_declared, max(n_declared) AS most_declared, max(n_referenced_by) AS most_referenced_by, sum(n_declared)::BIGINT AS n_edges FROM deg GROUP BY trace) SELECT z.trace, task, \"set\", completed, n_nodes, n_edges, round(n_edges / (n_nodes * (n_nodes - 1)), 6) AS density, len(list_distinct(part))::BIGINT AS n_components, list_max(depth) AS longest_path, mean_declared, most_declared, most_referenced_by FROM z JOIN q USING (trace)",
    G.metric_row, "d",
)


def _tangled(d: DataFrame) -> DataFrame:
    """Dependencies with one that points forward in every fourth trace: from sentence 2 on sentence 6."""
    forward = (F.col("sid") == 2) & (F.col("trace") % 4 == 0) & (F.col("n") > 8)
    return d.withColumn("depends_on", F.when(forward, F.array_union("depends_on", F.array(F.lit(6).cast("bigint")))).otherwise(F.col("depends_on")))


_on(
    "gr03_simple_cycles",
    "+p AS (WITH RECURSIVE p AS (SELECT trace, 6::BIGINT AS pos, [2, 6]::BIGINT[] AS path FROM d WHERE sid = 2 AND trace % 4 = 0 AND n > 8 UNION ALL SELECT p.trace, e.src, list_append(path, e.src) FROM p JOIN e ON e.trace = p.trace AND e.dst = p.pos WHERE e.src >= 2 AND p.pos <> 2) SELECT * FROM p) SELECT trace, array_to_string(path[:-2], ',') AS cycle FROM p WHERE pos = 2",
    lambda s: G.simple_cycles(_tangled(s)).select("trace", F.array_join(F.transform("cycle", lambda x: x.cast("string")), ",").alias("cycle")), "d",
)

# --- tests: the published erfc fit, once more

_T = "(1 / (1 + ({0}) / sqrt(2) / 2))"
_COEF = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def _tail(z: str) -> str:
    t = _T.format(z)
    poly = " + ".join(f"({c})::DOUBLE * {t} ** {k}" for k, c in enumerate(_COEF))
    return f"({t} * exp(-({z}) * ({z}) / 2 + {poly}) / 2)"


_on(
    "sx10_dunn",
    f"+x AS (SELECT task AS g, tokens AS v FROM s), {_RANK}, q AS (SELECT g, avg(r)::DOUBLE AS m, count(*)::DOUBLE AS c FROM k GROUP BY g), w AS (SELECT a.g AS a, b.g AS b, abs(a.m - b.m) / sqrt((n * (n + 1) / 12 - tie / (12 * (n - 1))) * (1 / a.c + 1 / b.c)) AS z, (SELECT count(*) * (count(*) - 1) / 2 FROM q) AS tests FROM q a JOIN q b ON a.g < b.g, n, c) SELECT a, b, round(z, 5) AS z, round(least(2 * {_tail('z')} * tests, 1), 5)::DOUBLE AS p FROM w",
    lambda s: R.dunn(s, "tokens", "task").select("a", "b", F.round("z", 5).alias("z"), F.round("p", 5).alias("p")),
)


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


_on(
    "sx14_stars",
    f"+x AS (SELECT task AS g, tokens AS v FROM s), {_RANK}, q AS (SELECT sum(r)::DOUBLE AS r, count(*)::DOUBLE AS m FROM k GROUP BY g), h AS (SELECT (12 / (n * (n + 1)) * (SELECT sum(r * r / m) FROM q) - 3 * (n + 1)) / (1 - tie / (n * n * n - n)) AS h FROM n, c), p AS (SELECT h, 2 * {_tail('sqrt(h)')} + exp(-h / 2) * sqrt(h / 2) / (sqrt(pi()) / 2) AS p FROM h) SELECT round(h, 5) AS h, round(p, 5) AS p, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars FROM p",
    lambda s: R.kruskal(s, "tokens", "task", 4).select(F.round("h", 5).alias("h"), F.round("p", 5).alias("p"), stars(F.col("p")).alias("stars")),
)

# --- whether two groups of texts are alike

_PARTS = "list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \\t\\n\\r\\f\\v]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '')"
_add(
    "sx20_confound_verdict",
    f"""WITH p AS (SELECT doc_id, lang, text, {_PARTS} AS p FROM documents), t AS (SELECT lang, doc_id % 2 AS half, list_avg(list_transform(p, lambda x: length(x))) AS chars, list_avg(list_transform(p, lambda x: len(regexp_extract_all(x, '[^ \t\n\r\f\v]+')))) AS words, 100 * (length(text) > 2000)::INT AS long FROM p WHERE len(p) > 0),
    g AS (SELECT lang, abs(avg(words) FILTER (half = 0) - avg(words) FILTER (half = 1)) AS words, abs(avg(chars) FILTER (half = 0) - avg(chars) FILTER (half = 1)) AS chars, abs(avg(long) FILTER (half = 0) - avg(long) FILTER (half = 1)) AS points FROM t GROUP BY lang)
    SELECT lang, (coalesce(words > 5, false)::INT + coalesce(chars > 30, false)::INT + coalesce(points > 30, false)::INT)::BIGINT AS flags, CASE coalesce(words > 5, false)::INT + coalesce(chars > 30, false)::INT + coalesce(points > 30, false)::INT WHEN 0 THEN 'COMPARABLE' WHEN 1 THEN 'MINOR DIFFERENCES' ELSE 'CONFOUNDED' END AS verdict FROM g""",
    None,
)(lambda spark, d: _confounds(spark, d))


def _confounds(spark: SparkSession, d: str) -> DataFrame:
    parts = _docs(spark, d).select("lang", (F.col("doc_id") % 2).alias("half"), "text", T.sentences(F.col("text")).alias("p")).where(F.size("p") > 0)
    mean = lambda of: F.aggregate("p", F.lit(0.0), lambda s, x: s + of(x)) / F.size("p")
    rows = parts.select("lang", "half", mean(T.word_count).alias("words"), mean(F.length).alias("chars"), (100 * (F.length("text") > 2000).cast("int")).alias("points"))
    return E.confound_verdict(rows, "lang", "half", 0, 1)


# --- scores by group

_LABELLED = "WITH c AS (SELECT d.source AS source, d.lang AS lang, d.doc_id % 2 AS half, quality AS a, toxic AS b FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"
_MACRO = "k AS (SELECT {0}, a, b, count(*) AS k FROM c GROUP BY ALL), u AS (SELECT {0}, a AS label, k AS t, 0 AS p, CASE WHEN a = b THEN k ELSE 0 END AS c FROM k UNION ALL SELECT {0}, b, 0, k, 0 FROM k), f AS (SELECT {0}, label, sum(t) AS t, sum(c) AS c, coalesce(2 * sum(c) / nullif(sum(t) + sum(p), 0), 0) AS f1 FROM u GROUP BY {0}, label), g AS (SELECT {0}, sum(t)::BIGINT AS n, avg(f1) AS macro_f1, sum(f1 * t) / sum(t) AS weighted_f1, sum(c) / sum(t) AS accuracy FROM f GROUP BY {0})"


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).select("doc_id", "source", "lang", (F.col("doc_id") % 2).alias("half"))
    return table(spark, d, "labels").join(docs, "doc_id").select("source", "lang", "half", F.col("quality").alias("a"), F.col("toxic").alias("b"))


_add("ml10_scores_by_group", _LABELLED + ", " + _MACRO.format("lang, half") + " SELECT lang, half, n, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1, round(accuracy, 6) AS accuracy FROM g", None)(lambda spark, d: K.grouped_scores(_labelled(spark, d), ["lang", "half"]))
_add("ml08_best_configuration", _LABELLED + ", " + _MACRO.format("lang, source") + " SELECT lang, source, round(macro_f1, 6) AS macro_f1 FROM g QUALIFY row_number() OVER (PARTITION BY lang ORDER BY round(macro_f1, 9) DESC, source DESC) = 1", None)(
    lambda spark, d: K.grouped_scores(_labelled(spark, d), ["lang", "source"]).groupBy("lang").agg(F.max_by("source", F.struct(F.round("macro_f1", 9), "source")).alias("source"), F.max("macro_f1").alias("macro_f1"))
)
_add("ml09_old_and_new", _LABELLED + ", " + _MACRO.format("lang, half") + " SELECT o.lang, round(o.macro_f1, 6) AS old, round(w.macro_f1, 6) AS new, round(w.macro_f1 - o.macro_f1, 6) + 0.0 AS change FROM g o JOIN g w ON o.lang = w.lang AND o.half = 0 AND w.half = 1", None)(lambda spark, d: _old_and_new(K.grouped_scores(_labelled(spark, d), ["lang", "half"])))


def _old_and_new(scores: DataFrame) -> DataFrame:
    of = lambda half: F.max(F.when(F.col("half") == half, F.col("macro_f1")))
    return scores.groupBy("lang").agg(of(0).alias("old"), of(1).alias("new")).where("old IS NOT NULL AND new IS NOT NULL").withColumn("change", F.col("new") - F.col("old"))


# --- probes over the vectors: folds by groups of ten


def _folded(spark: SparkSession, d: str) -> DataFrame:
    rows = _vecs(spark, d).withColumn("g", F.floor(F.col("vec_id") / 10)).withColumn("all", F.lit(1))
    return rows.join(V.group_folds(rows, "all", "g"), ["all", "g"])


_add("ml04_probe", None)(lambda spark, d: V.cross_validated(_folded(spark, d), "embedding", "label", "fold"))


def _sweep(spark: SparkSession, d: str) -> DataFrame:
    """Train and test only, a row for each penalty with its own bound on iterations."""
    rows, found = _folded(spark, d).cache(), []
    train, test = rows.where("fold <> 0"), rows.where("fold = 0")
    for c, most in ((0.01, 100), (1.0, 20)):
        probe = V.Probe(train, "embedding", "label", c, most)
        r = K.overall_scores(probe.said(test)).first()
        found.append((c, most, int(probe.rounds), probe.converged, r.macro_f1, r.weighted_f1, r.accuracy))
    return spark.createDataFrame(found, "c double, most bigint, rounds bigint, converged boolean, macro_f1 double, weighted_f1 double, accuracy double")


_add("ml05_sweep", None)(_sweep)

# --- folds with level labels, and the grid of probes over four layers of a vector, each two tokens long

_on(
    "ml01_level_folds",
    """+c AS (SELECT trace, count(*) AS size, [count(*) FILTER (label = 'DESCRIBE'), count(*) FILTER (label = 'HYPO'), count(*) FILTER (label = 'JUDGE'), count(*) FILTER (label = 'MONITOR'), count(*) FILTER (label = 'ORIENT'),
  count(*) FILTER (label = 'PLAN'), count(*) FILTER (label = 'RULE'), count(*) FILTER (label = 'SYNTHESIZE'), count(*) FILTER (label = 'TEST')]::DOUBLE[] AS n FROM s GROUP BY trace),
t AS (SELECT list(x ORDER BY i) AS total FROM (SELECT i, sum(x) AS x FROM (SELECT unnest(n) AS x, generate_subscripts(n, 1) AS i FROM c) GROUP BY i)),
o AS (SELECT trace, size, [n[i] / greatest(total[i], 1) FOR i IN range(1, 10)] AS x, row_number() OVER (ORDER BY round(sqrt(list_avg([(y - list_avg(n)) ** 2 FOR y IN n])), 9) DESC, md5(trace::VARCHAR)) AS place FROM c, t),
r AS (WITH RECURSIVE r AS (SELECT 0::BIGINT AS place, NULL::BIGINT AS trace, NULL::BIGINT AS fold, [[0.0::DOUBLE FOR i IN range(9)] FOR f IN range(5)] AS held, [0::BIGINT FOR f IN range(5)] AS sizes
  UNION ALL SELECT place, trace, fold, [CASE WHEN f = fold THEN [held[f + 1][i] + x[i] FOR i IN range(1, 10)] ELSE held[f + 1] END FOR f IN range(5)], [CASE WHEN f = fold THEN sizes[f + 1] + size ELSE sizes[f + 1] END FOR f IN range(5)]
  FROM (SELECT o.place, o.trace, o.x, o.size, held, sizes, list_sort([{'a': round(list_avg([sqrt(greatest((list_sum([h[i] * h[i] FOR h IN held]) + 2 * held[f + 1][i] * x[i] + x[i] * x[i]) / 5 - ((list_sum([h[i] FOR h IN held]) + x[i]) / 5) ** 2, 0)) FOR i IN range(1, 10)]), 9), 'b': sizes[f + 1], 'f': f} FOR f IN range(5)])[1].f AS fold
    FROM r JOIN o ON o.place = r.place + 1)) SELECT trace, fold FROM r WHERE trace IS NOT NULL)
SELECT trace, fold FROM r""",
    lambda s: FO.balanced_folds(s, "trace", "label"),
)
_LAYERS = {f"layer {k} | {name}": sql.format(a=16 * k + 1, b=16 * k + 9) for k in range(4) for name, sql in (("mean_pool", "zip_with(slice(embedding, {a}, 8), slice(embedding, {b}, 8), (x, y) -> (double(x) + double(y)) / 2)"), ("last_token", "slice(embedding, {b}, 8)"))}
#: Penalties, and the rounds each may take: weaker ones move further.
_ROUNDS = [(0.01, 100), (0.1, 200), (1.0, 300), (10.0, 500)]


def _fitted(spark: SparkSession, d: str) -> tuple[P.Grid, DataFrame]:
    rows = _vecs(spark, d).withColumn("g", F.floor(F.col("vec_id") / 10))
    rows = rows.join(FO.balanced_folds(rows, "g", "label"), "g")
    return P.fit(rows.where("fold <> 0"), _LAYERS, "label", _ROUNDS), rows


def _probe_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every probe of the grid with its rounds and scores on training and test folds."""
    grid, rows = _fitted(spark, d)
    scores = grid.scores(rows, F.when(F.col("fold") == 0, "test").otherwise("train")).withColumnRenamed("by", "split")
    layer = F.split("view", r" \| ")
    return grid.table(spark).join(scores, ["view", "c"]).select(layer[0].alias("layer"), layer[1].alias("pooling"), "c", "most", "rounds", "converged", "split", "n", "macro_f1", "weighted_f1", "accuracy")


def _best_penalties(spark: SparkSession, d: str) -> DataFrame:
    """The penalty of each layer and pooling with the best score on the test fold, the strongest of equals."""
    found = _probe_grid(spark, d).where("split = 'test'")
    best = F.max_by("c", F.struct(F.round("macro_f1", 9), -F.col("c")))
    return found.groupBy("layer", "pooling").agg(best.alias("c"), F.max("macro_f1").alias("macro_f1"), F.count_if("converged").alias("n_converged"))


_add("ml07_fitted_grid", None)(_probe_grid)
_add("ml08_best_penalty", None)(_best_penalties)


def _by_strategy(spark: SparkSession, d: str) -> DataFrame:
    """Scores of each strategy on the test fold and on all folds, from one probe."""
    rows = _folded(spark, d).withColumn("strategy", F.element_at(F.array(*map(F.lit, ("full", "scan_test", "direct"))), (F.col("g") % 3 + 1).cast("int")))
    said = V.Probe(rows.where("fold <> 0"), "embedding", "label", 0.01, 50).said(rows)
    split = F.explode(F.when(F.col("fold") == 0, F.array(F.lit("test"), F.lit("all_folds"))).otherwise(F.array(F.lit("all_folds"))))
    return K.grouped_scores(said.withColumn("split", split), ["strategy", "split"])


_add("ml10_probe_by_strategy", None)(_by_strategy)
_add(
    "ve09_strategy_distances",
    "WITH x AS (SELECT label, vec_id % 3 AS s, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i, vec_id FROM embeddings), m AS (SELECT label, s, i, avg(x) AS m, count(*) AS n FROM x GROUP BY ALL), c AS (SELECT label, s, list(m ORDER BY i) AS v, max(n) AS n FROM m GROUP BY label, s) SELECT p.label::BIGINT AS label, p.s AS one, q.s AS two, round(list_cosine_similarity(p.v, q.v), 5) AS cos, round(list_distance(p.v, q.v), 5) AS distance FROM c p JOIN c q ON p.label = q.label AND p.s < q.s WHERE p.n >= 5 AND q.n >= 5",
    None,
)(lambda spark, d: V.strategy_distances(_vecs(spark, d).withColumn("strategy", F.col("vec_id") % 3), "label", "strategy", "embedding").select("label", "one", "two", F.round("cos", 5).alias("cos"), F.round("distance", 5).alias("distance")))

# --- steering: a trace has a condition, which sets its labels' shares against those of the baseline

_STEERED = "CASE WHEN trace % 3 = 0 THEN 'baseline' ELSE lower(list_extract(['HYPO', 'TEST', 'JUDGE', 'MONITOR', 'PLAN'], trace % 5 + 1)) || CASE WHEN trace % 3 = 1 THEN '_pos_' ELSE '_neg_' END || list_extract(['0.5', '1.0', '1.5'], trace % 4 % 3 + 1) END"
_SHIFTS = f"""+w AS (SELECT trace, {_STEERED} AS condition, count(*) AS n FROM s GROUP BY trace), l AS (SELECT w.trace, condition, v.l AS label, (SELECT count(*) FROM s WHERE s.trace = w.trace AND s.label = v.l) / n AS share FROM w, (SELECT unnest({LABELS}) AS l) v),
e AS (SELECT condition, label, count(*) AS n, avg(share) AS mean, avg(share) - (SELECT avg(share) FROM l b WHERE b.condition = 'baseline' AND b.label = l.label) AS shift FROM l WHERE condition <> 'baseline' GROUP BY condition, label),
c AS (SELECT *, upper(string_split(condition, '_')[1]) AS category, CASE string_split(condition, '_')[2] WHEN 'pos' THEN 1 ELSE -1 END AS direction, string_split(condition, '_')[3]::DOUBLE AS alpha FROM e) """


def _effects(s: DataFrame) -> DataFrame:
    t = F.col("trace")
    category = F.element_at(F.array(*map(F.lit, ("HYPO", "TEST", "JUDGE", "MONITOR", "PLAN"))), (t % 5 + 1).cast("int"))
    alpha = F.element_at(F.array(*map(F.lit, ("0.5", "1.0", "1.5"))), (t % 4 % 3 + 1).cast("int"))
    name = F.when(t % 3 == 0, "baseline").otherwise(F.concat(F.lower(category), F.when(t % 3 == 1, "_pos_").otherwise("_neg_"), alpha))
    return E.effects(s.withColumn("condition", name), LABELS)


_on("ag39_condition_shifts", _SHIFTS + "SELECT condition, label, n, round(mean, 6) AS mean, round(shift, 6) AS shift FROM c", lambda s: _effects(s).select("condition", "label", "n", "mean", "shift"))
_on("ml14_dose_response", _SHIFTS + "SELECT category, direction * alpha AS dose, n, round(mean, 6) AS mean, round(shift, 6) AS shift FROM c WHERE label = category", lambda s: E.dose_response(_effects(s)))
_on("ml14_shift_matrix", _SHIFTS + "SELECT category || CASE direction WHEN 1 THEN '+' ELSE '-' END AS steered, " + ", ".join(f"round(max(shift) FILTER (label = '{x}'), 6) AS \"{x}\"" for x in LABELS) + " FROM c WHERE alpha = 1.0 GROUP BY ALL", lambda s: E.shift_matrix(_effects(s), LABELS, 1.0))
_on("ml14_diagonal_dominance", _SHIFTS + "SELECT category, arg_max(label, (round(shift, 9), label)) AS most_shifted, arg_max(label, (round(shift, 9), label)) = category AS dominant FROM c WHERE alpha = 1.0 AND direction = 1 GROUP BY category", lambda s: E.diagonal_dominance(_effects(s), 1.0))
_on(
    "jn18_probe_and_steering",
    _SHIFTS + ", f AS (SELECT label, avg((confidence = 'high')::INT) * CASE WHEN label IN ('HYPO', 'TEST') THEN 0.5 ELSE 1 END AS f1 FROM s GROUP BY label) SELECT f.label AS category, round(f1, 6)::DOUBLE AS f1, round(shift, 6) AS shift FROM f LEFT JOIN c ON c.category = f.label AND c.label = f.label AND direction = 1 AND alpha = 1.0",
    lambda s: E.with_steering(_probe_scores(s), _effects(s)).select("category", "f1", "shift"),
)
_on(
    "ml12_grounding",
    _SHIFTS + ", f AS (SELECT label, avg((confidence = 'high')::INT) * CASE WHEN label IN ('HYPO', 'TEST') THEN 0.5 ELSE 1 END AS f1 FROM s GROUP BY label), j AS (SELECT f.label AS category, f1, shift FROM f LEFT JOIN c ON c.category = f.label AND c.label = f.label AND direction = 1 AND alpha = 1.0) SELECT category, CASE WHEN f1 < 0.5 THEN 'Performative' WHEN shift IS NULL THEN 'Not tested' WHEN shift > 0.02 AND category <> 'JUDGE' THEN 'Mechanistically grounded' WHEN shift > 0 THEN 'Partially grounded' ELSE 'Performative' END AS status FROM j",
    lambda s: E.with_steering(_probe_scores(s), _effects(s)).select("category", E.grounding(F.col("f1"), F.col("shift"), F.when(F.col("category") == "JUDGE", 0.2).when(F.col("category") == "MONITOR", 0.01)).alias("status")),
)


def _probe_scores(s: DataFrame) -> DataFrame:
    """A score for each label: its share of sure codings, halved for two labels so that every class comes up."""
    return s.groupBy(F.col("label").alias("category")).agg((F.avg((F.col("confidence") == "high").cast("int")) * F.when(F.col("label").isin("HYPO", "TEST"), 0.5).otherwise(1.0)).alias("f1"))


# --- exact small-sample tests, a group each

_SIGNED = """WITH RECURSIVE f AS (SELECT 0 AS k, list_transform(range(0, 1276), lambda i: CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS c
  UNION ALL SELECT k + 1, list_transform(range(0, 1276), lambda i: c[i + 1] + CASE WHEN i >= k + 1 THEN c[i - k] ELSE 0 END) FROM f WHERE k < 50),
"""
_SIZED = """WITH RECURSIVE f AS (SELECT 0 AS k, list_transform(range(0, 3609), lambda i: CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS c
  UNION ALL SELECT k + 1, list_transform(range(0, 3609), lambda i: c[i + 1] + CASE WHEN i // 401 > 0 AND k + 1 >= i // 401 AND i % 401 >= k + 1 - i // 401 THEN c[i - 400 - (k + 1 - i // 401)] ELSE 0 END) FROM f WHERE k < 58),
"""
_MEANS = "t AS (SELECT trace, any_value(task) AS task, any_value(budget) AS budget, avg(value) FILTER (label = 'TEST') AS x, avg(value) FILTER (label = 'HYPO') AS y FROM s GROUP BY trace)"
_KR = "k AS (SELECT *, rank() OVER (PARTITION BY {p} ORDER BY {v}) + (count(*) OVER (PARTITION BY {p}, {v}) - 1) / 2 AS r, count(*) OVER (PARTITION BY {p}, {v}) AS t FROM {f})"


def _means(s: DataFrame) -> DataFrame:
    value = lambda x: F.avg(F.when(F.col("label") == x, F.col("value")))
    return s.groupBy("trace").agg(F.first("task").alias("task"), F.first("budget").alias("budget"), value("TEST").alias("x"), value("HYPO").alias("y"))


def _exact(name: str, sql: str, of) -> None:
    """A query over the sentence table whose SQL begins with a recursion of its own."""
    _add(name, sql, None)(lambda spark, sf_dir: of(sentences(spark, sf_dir)))


_exact(
    "sx12_exact_signed_ranks",
    f"{_SIGNED}{SQL}, {_MEANS}, z AS (SELECT task, budget, abs(x - y) AS v, x > y AS up FROM t WHERE x <> y), {_KR.format(p='task, budget', v='v', f='z')}, "
    "zz AS (SELECT task, budget, count(*) FILTER (x = y) AS zeros FROM t WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL), "
    "w AS (SELECT task, budget, count(*) AS n, sum(CASE WHEN up THEN r ELSE 0 END)::DOUBLE AS plus, max(t) AS ties FROM k GROUP BY ALL), "
    "q AS (SELECT task, budget, coalesce(n, 0) AS n, coalesce(least(plus, n * (n + 1) / 2 - plus), 0)::DOUBLE AS w, coalesce(n > 0 AND n <= 50 AND ties = 1 AND zeros = 0, false) AS exact FROM zz LEFT JOIN w USING (task, budget)) "
    "SELECT task, budget, n, round(w, 3) AS w, exact, round(CASE WHEN exact THEN least(2 * list_sum(list_slice(c, 1, w::BIGINT + 1)) / 2.0 ** n, 1) END, 6)::DOUBLE AS p FROM q LEFT JOIN f ON f.k = q.n",
    lambda s: X.signed_ranks(_means(s), ["task", "budget"], "x", "y").select("task", "budget", "n", F.round("w", 3).alias("w"), "exact", F.when(F.col("exact"), F.round("p", 6)).alias("p")),
)
_exact(
    "sx11_exact_two_samples",
    f"{_SIZED}{SQL}, z AS (SELECT trace, value AS v, label = 'JUDGE' AS first FROM s WHERE label IN ('JUDGE', 'HYPO') AND value IS NOT NULL), {_KR.format(p='trace', v='v', f='z')}, "
    "w AS (SELECT trace, count(*) FILTER (first) AS n1, count(*) FILTER (NOT first) AS n2, sum(CASE WHEN first THEN r ELSE 0 END)::DOUBLE AS r, max(t) AS ties FROM k GROUP BY trace), "
    "q AS (SELECT *, r - n1 * (n1 + 1) / 2 AS u, least(n1, n2) AS a, greatest(n1, n2) AS b FROM w), e AS (SELECT *, a > 0 AND a <= 8 AND b <= 50 AND ties = 1 AS exact FROM q) "
    "SELECT trace, n1, n2, round(u, 3) AS u, exact, round(CASE WHEN exact THEN least(2 * list_sum(list_slice(c, a * 401 + 1, a * 401 + 1 + least(u, n1 * n2 - u)::BIGINT)) / list_sum(list_slice(c, a * 401 + 1, a * 401 + 401)), 1) END, 6)::DOUBLE AS p FROM e LEFT JOIN f ON f.k = n1 + n2",
    lambda s: X.two_samples(s.where(F.col("label").isin("JUDGE", "HYPO")).withColumn("first", F.col("label") == "JUDGE"), ["trace"], "value", "first").select("trace", "n1", "n2", F.round("u", 3).alias("u"), "exact", F.when(F.col("exact"), F.round("p", 6)).alias("p")),
)


# --- quality rules: codings with faults at remainders of ids, traces that can't be read at remainders of theirs


def _quality(s: DataFrame) -> DataFrame:
    e = F.col("event_id")
    faulty = s.where(F.col("trace") % 47 != 0).select(
        "trace", "sid", (e % 997 != 0).alias("coded"), F.when(e % 991 == 0, "OTHER").when(e % 983 != 0, F.col("label")).alias("label"),
        F.when(e % 977 == 0, "SETUP").otherwise(F.create_map(*[F.lit(x) for kv in MACRO.items() for x in kv])[F.col("label")]).alias("macro"),
        F.when(e % 61 != 0, F.element_at(F.array(*map(F.lit, TEST_CONTEXT)), (e % 3 + 1).cast("int"))).alias("test_context"),
        F.when(e % 59 == 0, "elsewhere").otherwise(F.replace("specificity", F.lit("across_panel"), F.lit("across_panels"))).alias("specificity"),
        F.when(e % 53 != 0, F.col("judgement")).alias("judgement"),
    )
    faulty = faulty.withColumn("specificity", F.replace("specificity", F.lit("panelss"), F.lit("panels")))
    t = F.col("trace")
    read = s.select("trace").distinct().select("trace", F.when(t % 41 == 0, "missing").when(t % 43 == 0, "corrupt").otherwise("ok").alias("state"), F.lit("line 1").alias("error"), F.when(t % 5 == 0, " ").when(t % 7 != 0, "so").alias("answer"))
    found = Y.trace_quality(read, faulty, MACRO, {"test_context": TEST_CONTEXT, "specificity": SPECIFICITY, "judgement": JUDGEMENT})
    shares = ("test_context_pct", "specificity_pct", "judgement_pct", "hypo_test_share", "repetition_ratio", "entropy_norm")
    return found.select(*[F.round(c, 6).alias(c) if c in shares else F.array_join(c, "|").alias(c) if c == "issues" else F.col(c).cast("bigint").alias(c) if c in ("longest_run_len", "unique_label_count") else F.col(c) for c in found.columns])


_on(
    "sx16_quality_rows",
    """+c AS (SELECT trace, sid, event_id % 997 <> 0 AS coded, CASE WHEN event_id % 991 = 0 THEN 'OTHER' WHEN event_id % 983 <> 0 THEN label END AS label, label AS true_label,
  CASE WHEN event_id % 61 <> 0 THEN ['post_hypothesis', 'pre_hypothesis', 'post_rule'][event_id % 3 + 1] END AS ctx, CASE WHEN event_id % 59 = 0 THEN 'elsewhere' WHEN specificity = 'across_panel' THEN 'across_panels' ELSE specificity END AS spec,
  CASE WHEN event_id % 53 <> 0 THEN judgement END AS judgement, event_id % 977 = 0 AS wrong FROM s WHERE trace % 47 <> 0),
macro AS (SELECT * FROM (VALUES ('ORIENT', 'SETUP'), ('DESCRIBE', 'OBSERVE'), ('SYNTHESIZE', 'OBSERVE'), ('HYPO', 'INVESTIGATE'), ('TEST', 'INVESTIGATE'), ('JUDGE', 'INVESTIGATE'), ('PLAN', 'REGULATE'), ('MONITOR', 'REGULATE'), ('RULE', 'CONCLUDE')) m(l, g)),
h AS (SELECT c.*, coalesce(coded AND m.l IS NOT NULL, false) AS valid, m.g AS wanted, CASE WHEN wrong THEN 'SETUP' ELSE tm.g END AS macro FROM c LEFT JOIN macro m ON m.l = c.label JOIN macro tm ON tm.l = c.true_label),
i AS (SELECT *, CASE WHEN NOT coded THEN 'missing_coding_block_s' || sid WHEN NOT valid THEN 'invalid_micro_label_s' || sid || ':' || coalesce('''' || label || '''', 'None') WHEN macro <> wanted THEN 'macro_mismatch_s' || sid || ':''' || macro || '''!=''' || wanted || '''' END AS issue FROM h),
v AS (SELECT *, row_number() OVER o AS k, lag(label) OVER o AS b1, lag(label, 2) OVER o AS b2, lag(label, 3) OVER o AS b3 FROM i WHERE valid WINDOW o AS (PARTITION BY trace ORDER BY sid)),
r AS (SELECT *, sum(CASE WHEN b1 IS NULL OR b1 <> label THEN 1 ELSE 0 END) OVER (PARTITION BY trace ORDER BY sid) AS run FROM v),
long AS (SELECT trace, count(*) FILTER (n >= 10) AS n_long, arg_max(label, n * 1000000 - run) FILTER (n >= 10) AS lab, max(n) FILTER (n >= 10) AS len FROM (SELECT trace, run, any_value(label) AS label, count(*) AS n FROM r GROUP BY trace, run) GROUP BY trace),
ent AS (SELECT trace, -sum(q * log2(q)) / log2(9) AS e, count(*) AS kinds FROM (SELECT trace, count(*) / sum(count(*)) OVER (PARTITION BY trace) AS q FROM v GROUP BY trace, label) GROUP BY trace),
seq AS (SELECT trace, bool_or(k <= 5 AND label = 'ORIENT') AS early, count(*) FILTER (k > 1) AS pairs, count(*) FILTER ((b1 = 'HYPO' AND label = 'TEST') OR (b1 = 'TEST' AND label = 'HYPO')) AS flips,
  count(*) FILTER (k >= 4) AS grams, count(DISTINCT CASE WHEN k >= 4 THEN label || '>' || b1 || '>' || b2 || '>' || b3 END) AS kinds4 FROM v GROUP BY trace),
a AS (SELECT trace, count(*) AS n_sentences, count(*) FILTER (NOT coded) AS n_missing_coding, count(*) FILTER (coded AND NOT valid) AS n_invalid_micro, count(*) FILTER (issue LIKE 'macro%') AS n_macro_mismatch, count(*) FILTER (valid) AS n_valid_labels,
  count(*) FILTER (valid AND label = 'ORIENT') AS n_orient, count(*) FILTER (valid AND label = 'DESCRIBE') AS n_describe, count(*) FILTER (valid AND label = 'SYNTHESIZE') AS n_synthesize, count(*) FILTER (valid AND label = 'HYPO') AS n_hypo, count(*) FILTER (valid AND label = 'TEST') AS n_test,
  count(*) FILTER (valid AND label = 'JUDGE') AS n_judge, count(*) FILTER (valid AND label = 'PLAN') AS n_plan, count(*) FILTER (valid AND label = 'MONITOR') AS n_monitor, count(*) FILTER (valid AND label = 'RULE') AS n_rule,
  count(*) FILTER (valid AND label = 'TEST' AND ctx IS NOT NULL) AS ok_ctx, count(*) FILTER (valid AND label = 'TEST' AND spec IN ('within_panel', 'across_panels')) AS ok_spec, count(*) FILTER (valid AND label = 'JUDGE' AND judgement IS NOT NULL) AS ok_judge,
  list(issue ORDER BY sid) FILTER (issue IS NOT NULL) AS told FROM i GROUP BY trace),
t AS (SELECT DISTINCT trace, CASE WHEN trace % 41 = 0 THEN 'missing' WHEN trace % 43 = 0 THEN 'corrupt' ELSE 'ok' END AS state FROM s),
j AS (SELECT t.trace AS trace, t.state, t.state = 'ok' AND a.trace IS NOT NULL AND t.trace % 5 <> 0 AND t.trace % 7 <> 0 AS has_answer, a.* EXCLUDE (trace), early, pairs, flips, grams, kinds4, n_long, lab, len, e, kinds,
  coalesce(100.0 * ok_ctx / nullif(n_test, 0), 0) AS p1, coalesce(100.0 * ok_spec / nullif(n_test, 0), 0) AS p2, coalesce(100.0 * ok_judge / nullif(n_judge, 0), 0) AS p3
  FROM t LEFT JOIN a ON a.trace = t.trace AND t.state = 'ok' LEFT JOIN seq ON seq.trace = a.trace LEFT JOIN long ON long.trace = a.trace LEFT JOIN ent ON ent.trace = a.trace),
z AS (SELECT *, list_concat(coalesce(told, []), list_filter([CASE WHEN state = 'missing' THEN 'missing_trace_file' END, CASE WHEN state = 'corrupt' THEN 'corrupt_json: line 1' END, CASE WHEN state = 'ok' AND n_sentences IS NULL THEN 'missing_or_empty_sentences' END,
  CASE WHEN n_test > 0 AND p1 < 95 THEN 'coverage_test_context_below_95' END, CASE WHEN n_test > 0 AND p2 < 95 THEN 'coverage_specificity_below_95' END, CASE WHEN n_judge > 0 AND p3 < 95 THEN 'coverage_judgement_below_95' END], lambda x: x IS NOT NULL)) AS issues FROM j)
SELECT trace, state, has_answer, """
    + ", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in "n_sentences n_missing_coding n_invalid_micro n_macro_mismatch n_valid_labels n_orient n_describe n_synthesize n_hypo n_test n_judge n_plan n_monitor n_rule".split())
    + """, coalesce(n_long, 0)::BIGINT AS n_long_runs, coalesce(early, false) AS orient_in_first5, round(p1, 6)::DOUBLE AS test_context_pct, round(p2, 6)::DOUBLE AS specificity_pct, round(p3, 6)::DOUBLE AS judgement_pct, coalesce(n_rule > 0, false) AS rule_present,
  coalesce(len, 0)::BIGINT AS longest_run_len, lab AS longest_run_label, round(coalesce(flips / nullif(pairs, 0), 0), 6)::DOUBLE AS hypo_test_share, round(coalesce((grams - kinds4) / nullif(grams, 0), 0), 6)::DOUBLE AS repetition_ratio, round(coalesce(e, 0), 6)::DOUBLE AS entropy_norm, coalesce(kinds, 0)::BIGINT AS unique_label_count,
  array_to_string(issues, '|') AS issues, CASE WHEN len(issues) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM z""",
    _quality,
)
