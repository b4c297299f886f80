"""Every query with SQL against DuckDB on the small tables, and operators on hand-written sequences."""

from __future__ import annotations

import json
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tracelode.functions import text as T
from tracelode.operators import aggregates, agreement, cleaning, graph, rank_tests, sequence, vectors
from tracelode.plans import catalog
from tracelode.sources import traces
from tracelode.streaming import sessions

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, bool):
        return value
    return float(value) if isinstance(value, (int, float)) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    wanted = duck.sql(catalog.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(wanted.columns)
    at = [wanted.columns.index(c) for c in columns]
    left = sorted(repr([plain(r[c]) for c in columns]) for r in got.collect())
    right = sorted(repr([plain(r[k]) for k in at]) for r in wanted.fetchall())
    assert left == right


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def coded(spark, labels, **more):
    rows = [(1, k, x, (more.get("status") or {}).get(k), (more.get("antecedent") or {}).get(k), (more.get("judgement") or {}).get(k)) for k, x in enumerate(labels)]
    return spark.createDataFrame(rows, "trace bigint, sid bigint, label string, status string, antecedent bigint, judgement string")


@pytest.mark.parametrize(
    ("labels", "more", "last"),
    [
        (["ORIENT", "ORIENT"], {}, [0]),
        (["DESCRIBE", "ORIENT"], {}, []),
        (["ORIENT", "DESCRIBE", "PLAN"], {}, [0]),
        (["PLAN", "DESCRIBE", "DESCRIBE"], {}, [1]),
        (["PLAN", "TEST", "DESCRIBE"], {}, [0]),
        (["PLAN", "DESCRIBE", "TEST", "TEST", "TEST", "TEST", "TEST", "SYNTHESIZE"], {}, [2, 3, 4, 5, 6]),
        (["HYPO", "JUDGE", "HYPO"], {"status": {2: "revised"}, "antecedent": {2: 0}}, [0, 1]),
        (["SYNTHESIZE", "HYPO"], {}, [0]),
        (["HYPO", "DESCRIBE", "TEST", "DESCRIBE", "DESCRIBE", "TEST"], {}, [0, 2, 3, 4]),
        (["TEST", "HYPO", "TEST", "TEST", "TEST", "TEST", "JUDGE"], {}, [1, 3, 4, 5]),
        (["TEST", "MONITOR"], {}, [0]),
        (["HYPO", "JUDGE", "JUDGE", "RULE"], {"judgement": {1: "accept", 2: "reject"}}, [0, 1]),
        (["HYPO"] + ["MONITOR"] * 25 + ["TEST"], {}, []),
        (["HYPO", None], {}, None),
        (["HYPO", "other"], {}, []),
    ],
)
def test_dependency_rules(spark, labels, more, last):
    got = sequence.dependencies(coded(spark, labels, **more)).orderBy("sid").collect()[-1].depends_on
    assert (None if got is None else sorted(got)) == last


def test_graph_shape_against_plain_python(spark):
    dice = random.Random(4)
    rows = []
    for t in range(6):
        n = dice.randint(1, 14)
        for s in range(n):
            rows.append((t, s, [d for d in range(s) if dice.random() < 0.2] + ([n - 1] if t == 5 and s == 0 and n > 1 else [])))
    table = spark.createDataFrame(rows, "trace bigint, sid bigint, depends_on array<bigint>")
    for r in graph.shape(table).collect():
        mine = {s: d for t, s, d in rows if t == r.trace}

        def reach(s, seen=()):
            return max((reach(d, (*seen, s)) + 1 for d in mine[s] if d not in seen and d != s), default=0)

        if r.acyclic:
            assert r.longest_path == max(map(reach, mine))
        left, parts = set(mine), 0
        while left:
            todo, parts = [left.pop()], parts + 1
            while todo:
                s = todo.pop()
                near = {x for x in left if x in mine[s] or s in mine[x]}
                left -= near
                todo += near
        assert r.n_components == parts


def test_published_identities(spark):
    """Figures of the published tables that follow from others: weights, pooled kappa, density."""
    counts = {"RULE": 725, "OTHER": 73383 - 725}
    rows = spark.createDataFrame([(k, n) for k, n in counts.items()], "label string, n bigint").withColumn("x", F.explode(F.sequence(F.lit(1), "n")))
    got = {r.label: r.weight for r in aggregates.class_weights(rows.drop("n", "x"), ["RULE", *(f"L{k}" for k in range(8))]).collect()}
    assert got["RULE"] == pytest.approx(725 / (9 * 725), abs=1e-3) and got["L0"] == 1.0
    pairs = spark.createDataFrame([("a", "a")] * 20 + [("a", "b")] * 5 + [("b", "a")] * 10 + [("b", "b")] * 15, "a string, b string")
    assert agreement.kappa(pairs, []).first().kappa == pytest.approx(0.4)
    assert agreement.kappa(pairs.where("a = b AND a = 'a'"), []).first().kappa is None


def test_rank_tests_known_values(spark):
    rows = spark.createDataFrame([(g, float(v)) for g, vs in enumerate(([6.4, 6.8, 7.2, 8.3, 8.4], [2.5, 3.7, 4.9, 5.4, 5.9], [1.3, 4.1, 4.9, 5.2, 5.5])) for v in vs], "g int, v double")
    r = rank_tests.kruskal(rows, "v", "g", 3).first()
    ranks = sorted(x.v for x in rows.collect())
    mean = {v: sum(k + 1 for k, x in enumerate(ranks) if x == v) / ranks.count(v) for v in ranks}
    sums = [sum(mean[x.v] for x in rows.collect() if x.g == g) for g in range(3)]
    h = (12 / (15 * 16) * sum(s * s / 5 for s in sums) - 48) / (1 - (2**3 - 2) / (15**3 - 15))
    assert r.h == pytest.approx(h) and r.p == pytest.approx(math.exp(-h / 2))
    tails = spark.range(1).select(rank_tests.chi2_tail(F.lit(3.841459), 1).alias("a"), rank_tests.chi2_tail(F.lit(7.814728), 3).alias("b"), rank_tests.chi2_tail(F.lit(15.50731), 8).alias("c"), rank_tests.normal_tail(F.lit(1.959964)).alias("d")).first()
    assert [tails.a, tails.b, tails.c] == pytest.approx([0.05] * 3, abs=1e-6) and tails.d == pytest.approx(0.025, abs=1e-6)
    same = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], "x double, y double")
    assert rank_tests.wilcoxon(same, "x", "y").first().p == 1.0


def test_cleaning_edges(spark):
    rows = spark.createDataFrame([(1, 0, "1.", 1), (1, 1, "Red cone.", 2), (1, 2, "A.", 1), (2, 0, "B", 1), (2, 1, ".", 1)], "trace bigint, sid bigint, text string, tokens bigint")
    got = {(r.trace, r.sid): r.text for r in cleaning.merge_fragments(rows).collect()}
    assert got == {(1, 1): "1. Red cone. A.", (2, 0): "B", (2, 1): "."}
    tail = spark.createDataFrame([(1, k, "cut off", 9) for k in range(14)], "trace bigint, sid bigint, text string, tokens bigint")
    assert cleaning.drop_cut_off_tail(tail, F.lit(False)).count() == 4 and cleaning.drop_cut_off_tail(tail, F.lit(True)).count() == 14
    kept = cleaning.renumber(rows.where("sid <> 1"))
    assert cleaning.id_map(rows, kept).where("trace = 1").first().id_mapping == {"0": 0, "1": -1, "2": 1}
    spec = spark.createDataFrame([(1, 0, 1)], "trace bigint, source bigint, target bigint")
    assert cleaning.manual_merges(rows, spec).where("trace = 1 AND sid = 1").first().text == "1. Red cone."
    long = spark.createDataFrame([(1, 0, "a b\n\nc d", 200), (1, 1, "e\nf", 200), (1, 2, "g\nh", 2)], "trace bigint, sid bigint, text string, tokens bigint")
    assert [r.text for r in cleaning.split_oversized(long).orderBy("sid", "part").collect()] == ["a b", "c d", "e", "f", "g\nh"]


def test_text_functions(spark):
    def value(column):
        return spark.range(1).select(column.alias("x")).first().x

    assert value(T.thinking(F.lit("<think>a b</think> c"))) == "a b" and value(T.answer(F.lit("<think>a</think> c "))) == "c" and value(T.answer(F.lit("none"))) is None
    found = value(T.segments(F.lit("One two. Three?  Four")))
    assert [(s.sentence_id, s.text, s.token_count) for s in found] == [(0, "One two.", 2), (1, "Three?", 1), (2, "Four", 1)]
    assert all("One two. Three?  Four"[s.start_char : s.end_char].strip() == s.text for s in found)
    schema = "array<struct<sentence_id:int,micro_label:string>>"
    for response in ('[{"sentence_id": 1, "micro_label": "TEST"}]', '```json\n[{"sentence_id": 1, "micro_label": "TEST"}]\n```', 'Here: [{"sentence_id": 1, "micro_label": "TEST"}] done'):
        assert value(T.json_array(F.lit(response), schema))[0].micro_label == "TEST"
    assert value(T.json_array(F.lit("no array"), schema)) is None
    assert value(T.condition_parts(F.lit("venhoff_hypo_neg_1.5"))).asDict() == {"category": "HYPO", "direction": -1, "alpha": 1.5} and value(T.condition_parts(F.lit("baseline"))) is None
    assert value(T.repeats(F.lit("x" * 400))) and not value(T.repeats(F.lit("x" * 399 + "y"), times=6)) and not value(T.repeats(F.lit(None).cast("string")))
    assert value(T.to_budget(F.lit("a" * 100), F.lit(8192))) == "a" * 50


def test_trace_files(spark, tmp_path):
    good = {"task_id": 2, "trace_id": 7, "set": "A", "answer_text": " x ", "sentences": [{"sentence_id": 0, "text": "Hm.", "token_count": 2, "coding": {"micro_label": "TEST", "specificity": "across_panel", "depends_on": []}}, {"sentence_id": 1, "text": "So.", "coding": None}]}
    folder = tmp_path / "set_a" / "task2"
    folder.mkdir(parents=True)
    (folder / "trace_007.json").write_bytes(b"\xef\xbb\xbf" + json.dumps(good, indent=1).encode())
    (folder / "trace_008.json").write_text("")
    (folder / "trace_009.json").write_text("{broken")
    (folder / "trace_010.json").write_text('{"task_id": 2}')
    states = {r.path[-8:-5]: r.state for r in traces.file_state(spark, str(tmp_path)).collect()}
    assert states == {"007": "ok", "008": "empty", "009": "corrupt", "010": "incomplete"}
    rows = traces.flatten(traces.read_traces(spark, str(folder / "trace_007.json"))).orderBy("position_idx").collect()
    assert [r.trace_key for r in rows] == ["set_a/task2/trace_007"] * 2 and rows[0].specificity == "across_panels" and rows[0].completed and rows[1].micro_label is None
    target = str(tmp_path / "out")
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k int, part string")
    assert traces.write_missing(table, target, ["k"], ["part"]) == 2 and traces.write_missing(table.union(spark.createDataFrame([(3, "b")], "k int, part string")), target, ["k"], ["part"]) == 1
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "hypo_pos_1.0.csv").write_text("k,v\n1,2.5\n")
    assert traces.read_conditions(spark, str(tmp_path / "csv"), "k int, v double").first().condition == "hypo_pos_1.0"
    with pytest.raises(ValueError):
        traces.selector("nonsense!")


def test_codings_merge_and_upsert(spark):
    sentences = spark.createDataFrame([("t", 0), ("t", 1)], "trace_key string, sentence_id int")
    codings = spark.createDataFrame([("t", 0, "HYPO", 1), ("t", 0, "TEST", 2), ("t", 9, "PLAN", 3)], "trace_key string, sentence_id int, label string, at int")
    assert [tuple(r) for r in traces.merge_codings(sentences, codings, "at").orderBy("sentence_id").collect()] == [("t", 0, "TEST"), ("t", 1, None)]
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string"), spark.createDataFrame([(2, "c", 5)], "k int, x string, y int")
    assert sorted(map(tuple, traces.upserted(old, new, ["k"]).collect())) == [(1, "a", None), (2, "c", 5)]


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    for k in range(3):
        events.where(F.col("event_id") % 3 == k).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = sessions.tumbling_counts(stream, late="3650 days").writeStream.outputMode("complete").format("memory").queryName("tumbling").option("checkpointLocation", str(tmp_path / "check")).start()
    query.processAllAvailable()
    query.stop()
    key = lambda r: (r.start, r.event_type, r.n, round(r.total, 6))
    assert sorted(map(key, spark.table("tumbling").collect())) == sorted(map(key, sessions.tumbling_counts(events).collect()))


def test_vector_status_ties_and_steering(spark):
    rows = spark.createDataFrame([("g", 0, [1.0, 0.0]), ("g", 1, [2.0, 0.0]), ("g", 2, [1.0, 0.0]), ("g", 3, [0.0, 1.0]), ("g", 4, [1.0, 1.0])], "g string, k int, v array<double>")
    got = [(r.sid, r.antecedent, r.status) for r in vectors.status_by_similarity(rows, "g", "k", "v").orderBy("sid").collect()]
    assert got == [(0, None, "novel"), (1, 0, "repeated"), (2, 0, "repeated"), (3, None, "novel"), (4, 0, "revised")]
    assert rows.select(vectors.added(F.col("v"), F.col("v"), 0.5).alias("x")).first().x == [1.5, 0.0]


def test_plan_of_dependencies_has_one_shuffle(spark):
    plan = sequence.dependencies(coded(spark, ["HYPO", "TEST"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
