"""Responses, lineage, spans, cycles, probes and files on hand-written rows."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelode.functions import text as T
from tracelode.operators import aggregates, cleaning, graph, rank_tests, responses, steering, vectors
from tracelode.sources import files, traces


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ('[{"sentence_id": 1}, 5, "x"]', 3), ('```json\n[{"a": 1}]\n```', 1), ('```\n[]\n``` and more', 0), ('Here: [{"a": [1, 2]}] done', 1), ('{"a": [1]}', None), ('"[1]"', None), ("[1, 2", None),
        ("no array", None), ("", None), (None, None), ('  [ {"a": 1} ]  ', 1), ('[{"a": "]"}]', 1),
    ],
)
def test_response_arrays(spark, text, wanted):
    got = spark.createDataFrame([(text,)], "t string").select(responses.elements(F.col("t")).alias("x")).first().x
    assert (None if got is None else len(got)) == wanted


def test_validation_rules(spark):
    items = [
        '{"sentence_id": 1, "micro_label": "TEST", "test_context": "post_rule", "specificity": "across_panels", "confidence": "high"}', '{"sentence_id": 2, "micro_label": "TEST", "specificity": "across_panel"}',
        '{"sentence_id": 3, "micro_label": "JUDGE", "judgement": "unclear", "confidence": "low"}', '{"sentence_id": 4, "micro_label": "judge"}', '{"micro_label": "RULE"}', "7", '{"sentence_id": 1, "micro_label": "PLAN", "test_context": "post_rule"}',
    ]
    rows = spark.createDataFrame([("k", items)], "trace_key string, items array<string>")
    got = responses.validated(rows).orderBy("place").collect()
    assert [(r.invalid, r.missing, r.confidence, r.macro_label) for r in got] == [(False, 0, "high", "INVESTIGATE"), (False, 2, "medium", "INVESTIGATE"), (False, 1, "medium", "INVESTIGATE"), (True, 0, "medium", "UNKNOWN"), (False, 0, "medium", "CONCLUDE"), (False, 0, "medium", "REGULATE")]
    sentences = spark.createDataFrame([("k", k) for k in range(4)], "trace_key string, sentence_id bigint")
    merged = {r.sentence_id: r for r in responses.merged(sentences, responses.validated(rows)).collect()}
    assert merged[0].micro_label is None and (merged[1].micro_label, merged[1].test_context) == ("PLAN", None) and merged[3].judgement == "unclear"


def test_lineage_and_actions(spark):
    rows = spark.createDataFrame([(1, 0, "1.", 1, False), (1, 1, "Red cone is there now.", 6, False), (1, 2, "A.", 1, False), (1, 3, "cut off", 2, False), (2, 0, "Whole words stand here, six.", 6, True), (2, 1, "B", 1, True)], "trace bigint, sid bigint, text string, tokens bigint, completed boolean")
    found = {(r.trace, r.old_sid): r.new_sid for r in cleaning.lineage(rows, F.col("completed")).collect()}
    assert found == {(1, 0): 0, (1, 1): 0, (1, 2): -1, (1, 3): -1, (2, 0): 0, (2, 1): 0}
    done = {(r.trace, r.old_sid, r.action, r.reason, r.new_sid) for r in cleaning.actions(rows, F.col("completed")).collect()}
    assert done == {(1, 0, "fragment_merge", "digit_period", 0), (1, 2, "fragment_merge", "letter_period", -1), (1, 3, "truncation_removal", "le5_tokens+no_terminal_punct", -1), (2, 1, "fragment_merge", "letter_alone_to_prev", 0)}
    spec = spark.createDataFrame([(1, 0, 1, "now.")], "trace bigint, source bigint, target bigint, split_off string")
    parts = cleaning.manual_merges_split(rows.drop("completed"), spec).where("trace = 1 AND sid = 1").orderBy("part").collect()
    assert [(r.text, r.tokens) for r in parts] == [("1. Red cone is there", 6), ("now.", 1)]


def test_token_spans(spark):
    tokens = spark.createDataFrame([(1, "ab, cd  " + " " * 40 + "ef")], "trace int, text string").select("trace", T.token_places(F.col("text")).alias("tokens"))
    spans = spark.createDataFrame([(1, 0, 2), (1, 1, 5), (1, 2, 4), (1, 6, 8), (1, 20, 21), (1, 47, 50)], "trace int, start_char int, end_char int")
    got = {(r.start_char, r.end_char): (r.span_start, r.span_end) for r in T.token_spans(spans, tokens).collect()}
    assert got == {(0, 2): (0, 0), (1, 5): (0, 1), (2, 4): (1, 0), (6, 8): (None, 1), (20, 21): (2, 1), (47, 50): (2, 2)}


def test_simple_cycles_against_permutations(spark):
    dice = random.Random(3)
    for trial in range(4):
        n = 6
        deps = {s: [d for d in range(n) if dice.random() < 0.3] for s in range(n)}
        table = spark.createDataFrame([(trial, s, d) for s, d in deps.items()], "trace bigint, sid bigint, depends_on array<bigint>")
        wanted = {p for k in range(1, n + 1) for p in itertools.permutations(range(n), k) if p[0] == min(p) and all(b in deps[a] for a, b in zip(p, (*p[1:], p[0])))}
        got = [tuple(r.cycle) for r in graph.simple_cycles(table).collect()]
        assert len(got) == len(set(got)) and set(got) == wanted


def test_chains_and_density(spark):
    hypo = [(1, 0, None), (1, 1, 0), (1, 2, 0), (1, 3, 1), (1, 4, None), (1, 5, 3), (2, 7, None), (2, 8, 9), (2, 9, 7)]
    rows = spark.createDataFrame([(t, s, "HYPO", a) for t, s, a in hypo], "trace bigint, sid bigint, label string, antecedent bigint")
    assert sorted((r.trace, r.root, r.length) for r in graph.chains(rows).collect()) == [(1, 0, 4), (1, 4, 1), (2, 7, 2)]
    d = spark.createDataFrame([(1, 0, [5]), (1, 1, [0, 0]), (1, 2, None), (2, 4, [])], "trace bigint, sid bigint, depends_on array<bigint>")
    assert sorted(map(tuple, graph.density(d).collect())) == [(1, 3, 1, 1 / 6), (2, 1, 0, 0.0)]


def test_ranks_over_ranges(spark):
    values = [random.Random(5).randrange(4000) / 7 for _ in range(3000)]
    rows = spark.createDataFrame([(k % 3, v) for k, v in enumerate(values)], "g int, v double")
    ranks = {r.v: r["rank"] for r in rank_tests.ranked(rows, "v", "g").collect()}
    ordered = sorted(values)
    first = {v: k for k, v in reversed(list(enumerate(ordered)))}
    assert all(ranks[v] == first[v] + (values.count(v) + 1) / 2 for v in set(values[:300]))


def test_probe_is_at_its_optimum(spark):
    """The gradient of the balanced, penalised loss vanishes at the coefficients; scales and scores are those of numpy."""
    dice = np.random.default_rng(2)
    x = dice.normal(size=(120, 4)) * [1, 2, 3, 4] + 5
    y = (x[:, 0] + x[:, 1] / 2 + dice.normal(size=120) > 7.5).astype(int) + (x[:, 2] > 9)
    rows = spark.createDataFrame([(k, row.tolist(), int(label)) for k, (row, label) in enumerate(zip(x, y))], "k int, v array<double>, label int")
    probe = vectors.Probe(rows, "v", "label", 0.5, 200)
    scale, model = probe.model.stages
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    assert np.allclose(scale.std.toArray(), x.std(axis=0, ddof=1))
    logits = z @ model.coefficientMatrix.toArray().T + model.interceptVector.toArray()
    p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    weight = len(y) / (3 * np.bincount(y))[y]
    gradient = ((p - np.eye(3)[y]) * weight[:, None]).T @ z / weight.sum() + model.coefficientMatrix.toArray() / (0.5 * len(y))
    assert np.abs(gradient).max() < 1e-3 and probe.converged
    said = {r.k: r.b for r in probe.said(rows).collect()}
    assert sum(said[k] == logits[k].argmax() for k in range(120)) == 120


def test_cross_validation_rows(spark):
    dice = random.Random(1)
    rows = spark.createDataFrame([(k % 2, [k % 2 + dice.random() * 1.5, dice.random()], k // 2 % 5) for k in range(100)], "label int, v array<double>, fold int")
    got = vectors.cross_validated(rows, "v", "label", "fold", c=1.0, iterations=50).collect()
    assert sorted((r.split, r.fold) for r in got if r.fold is not None) == [("test", 0), *[("validation", k) for k in (1, 2, 3, 4)]]
    valid = [r.macro_f1 for r in got if r.split == "validation"]
    by = {r.split: r.macro_f1 for r in got}
    assert by["mean"] == pytest.approx(np.mean(valid)) and by["deviation"] == pytest.approx(np.std(valid)) and by["test"] > 0.5


def test_grounding_classes(spark):
    cases = [(None, 0.5, 0.01, "Performative"), (0.4, 0.5, 0.01, "Performative"), (0.6, None, None, "Not tested"), (0.6, 0.03, 0.01, "Mechanistically grounded"), (0.6, 0.03, None, "Mechanistically grounded"), (0.6, 0.03, 0.2, "Partially grounded"), (0.6, 0.01, 0.01, "Partially grounded"), (0.6, -0.1, 0.01, "Performative")]
    got = spark.createDataFrame(cases, "f double, s double, p double, w string").select("w", steering.grounding(F.col("f"), F.col("s"), F.col("p")).alias("g")).collect()
    assert all(r.w == r.g for r in got)


def test_confounds_and_dominance(spark):
    rows = spark.createDataFrame([("x", 0, 20.0, 100.0, 0), ("x", 1, 26.0, 131.0, 31), ("y", 0, 20.0, 100.0, 0), ("y", 1, 25.0, 130.5, 30), ("z", 0, 1.0, 1.0, 1)], "by string, g int, words double, chars double, points int")
    assert {r.by: (r.flags, r.verdict) for r in steering.confound_verdict(rows, "by", "g", 0, 1).collect()} == {"x": (3, "CONFOUNDED"), "y": (1, "MINOR DIFFERENCES"), "z": (0, "COMPARABLE")}
    labels = spark.createDataFrame([(1, "TEST")] * 8 + [(1, "HYPO")] * 2 + [(2, "TEST")] * 7 + [(2, "HYPO")] * 3, "trace int, label string")
    assert [(r.trace, r.label) for r in aggregates.dominance(labels).collect()] == [(1, "TEST")]


def test_files_round_trip(spark, tmp_path):
    folder = f"file://{tmp_path}/x"
    rows = spark.createDataFrame([("a/1.txt", "é"), ("b/2.txt", None)], "name string, body string")
    assert files.write_files(rows, folder) == 2 and (tmp_path / "x/a/1.txt").read_text() == "é" and (tmp_path / "x/b/2.txt").read_bytes() == b""
    (tmp_path / "x/bad.npz").write_bytes(b"no archive")
    files.write_npz(spark.createDataFrame([("good.npz", ["b", "a"], [[1.0, 2.0], [3.0]])], "name string, keys array<string>, vectors array<array<float>>"), folder)
    assert sorted(map(str, files.read_npz(spark, folder).collect())) == sorted(["Row(name='bad', key=None, vector=None)", "Row(name='good', key='a', vector=[3.0])", "Row(name='good', key='b', vector=[1.0, 2.0])"])
    assert files.read_table(spark, folder + "/none", "a string") is None


def test_repetition_probes(spark):
    """Starts step by the text's length over 500 and end before the last piece; shorter texts than all repetitions never count."""

    def plain(t, size, times):
        step = max(1, len(t) // 500)
        return len(t) >= size * times and any(t.count(t[p : p + size]) >= times for p in range(0, len(t) - size, step))

    dice = random.Random(8)
    texts = ["x" * 400, "x" * 399, "ab" * 300, "".join(dice.choice("abc") for _ in range(900)), ("q" * 79 + "w") * 5, ("q" * 79 + "w") * 6]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", T.repeats(F.col("t")).alias("a"), T.repeats(F.col("t"), 50, 3).alias("b")).orderBy("k").collect()
    assert [r.a for r in got] == [plain(t, 80, 5) for t in texts] == [True, False, True, False, True, True]
    assert [r.b for r in got] == [plain(t, 50, 3) for t in texts]


def test_chi_squared_tail_is_monotone(spark):
    got = [r.p for r in spark.range(1, 9).select(rank_tests.chi2_tail(F.col("id").cast("double"), 3).alias("p")).collect()]
    assert got == sorted(got, reverse=True) and math.isclose(got[0], 0.8012519569012008, rel_tol=1e-5)


def test_work_list_states(spark):
    expected = spark.createDataFrame([("a",), ("b",)], "key string")
    states = spark.createDataFrame([("a", "ok"), ("c", "empty")], "key string, state string")
    assert {tuple(r) for r in files.work_list(expected, states).collect()} == {("a", "ok"), ("b", "missing")}
    assert traces.REQUIRED == ("task_id", "trace_id", "set")
