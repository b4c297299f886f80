"""Exact rank tests by enumeration, and every quality rule by planted faults."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tracelode.operators import exact_tests as X
from tracelode.operators import quality as Y
from tracelode.plans import facts


def test_counts_equal_enumeration(spark):
    got = spark.range(1).select(*[X.signed_rank_counts(F.lit(n)).alias(f"s{n}") for n in range(13)]).first()
    for n in range(13):
        wanted = [0] * (n * (n + 1) // 2 + 1)
        for picks in itertools.product((0, 1), repeat=n):
            wanted[sum(k + 1 for k, p in enumerate(picks) if p)] += 1
        assert got[n] == wanted
    for m, n in ((0, 3), (1, 1), (1, 7), (2, 5), (3, 3), (4, 8), (6, 6)):
        wanted = [0] * (m * n + 1)
        for picks in itertools.combinations(range(m + n), m):
            wanted[sum(p - k for k, p in enumerate(picks))] += 1
        assert spark.range(1).select(X.u_counts(F.lit(m), F.lit(n)).alias("u")).first().u == wanted


def test_p_values_equal_enumeration(spark):
    dice, rows, pairs = random.Random(1), [], []
    for g in range(12):
        a, b = dice.randint(1, 6), dice.randint(1, 7)
        rows += [(g, dice.random(), k < a) for k in range(a + b)]
        pairs += [(g, dice.random(), dice.random()) for _ in range(g + 1)]
    got = {r.g: r for r in X.two_samples(spark.createDataFrame(rows, "g int, v double, f boolean"), ["g"], "v", "f").collect()}
    for g, r in got.items():
        mine = [(v, f) for k, v, f in rows if k == g]
        order = [v for v, _ in sorted(mine)]
        u = sum(v > w for v, f in mine if f for w, h in mine if not h)
        every = [sum(p - k for k, p in enumerate(c)) for c in itertools.combinations(range(len(order)), r.n1)]
        low = min(u, r.n1 * r.n2 - u)
        assert r.exact and r.u == u and r.p == pytest.approx(min(1, 2 * sum(x <= low for x in every) / len(every)))
    got = {r.g: r for r in X.signed_ranks(spark.createDataFrame(pairs, "g int, x double, y double"), ["g"], "x", "y").collect()}
    for g, r in got.items():
        d = sorted((x - y for k, x, y in pairs if k == g), key=abs)
        plus = sum(k + 1 for k, v in enumerate(d) if v > 0)
        low = min(plus, len(d) * (len(d) + 1) // 2 - plus)
        every = [sum((k + 1) * p for k, p in enumerate(c)) for c in itertools.product((0, 1), repeat=len(d))]
        assert r.exact and (r.n, r.w) == (len(d), low) and r.p == pytest.approx(min(1, 2 * sum(x <= low for x in every) / len(every)))


def test_largest_exact_groups_and_others(spark):
    """50 pairs against counts by plain Python; ties, zeros, large and one-sided groups by the normal approximation or null."""
    dice = random.Random(2)
    d = [dice.choice((-1, 1)) * (k + 0.5) for k in range(50)]
    rows = [("fifty", v, 0.0) for v in d] + [("more", v, 0.0) for v in [*d, 60.0]] + [("tied", v, 0.0) for v in (1.0, -1.0, 2.0, 3.0)] + [("zero", 1.0, 1.0), ("zero", 2.0, 1.0), ("same", 4.0, 4.0), ("null", None, 1.0)]
    got = {r.g: r for r in X.signed_ranks(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").collect()}
    counts = [1]
    for k in range(1, 51):
        counts = [(counts[i] if i < len(counts) else 0) + (counts[i - k] if 0 <= i - k < len(counts) else 0) for i in range(len(counts) + k)]
    assert got["fifty"].exact and got["fifty"].p == pytest.approx(min(1, 2 * sum(counts[: int(got["fifty"].w) + 1]) / 2**50))
    assert {g: got[g].exact for g in got} == {"fifty": True, "more": False, "tied": False, "zero": False, "same": False} and got["same"].p == 1 and got["same"].n == 0
    assert abs(got["more"].p - got["fifty"].p) < 0.1
    two = spark.createDataFrame([(1, 1.0, True), (1, 2.0, True), (2, 1.0, True), (2, 1.0, False), (2, 3.0, False), (3, None, True)], "g int, v double, f boolean")
    got = {r.g: r for r in X.two_samples(two, ["g"], "v", "f").collect()}
    assert set(got) == {1, 2} and got[1].p is None and not got[2].exact and 0 < got[2].p <= 1
    assert X.two_samples(two.limit(0), ["g"], "v", "f").count() == X.signed_ranks(spark.createDataFrame([], "g int, x double, y double"), ["g"], "x", "y").count() == 0


def test_ranks_of_a_large_group_equal_a_sort(spark):
    dice = random.Random(3)
    rows = [(g, dice.randint(0, 300) / 7) for g in (1, 1, 1, 2) for _ in range(700)]
    for r in X.ranks(spark.createDataFrame(rows, "g int, v double"), ["g"], "v").collect():
        mine = [v for g, v in rows if g == r.g]
        assert r.n == mine.count(r.v) and r["rank"] == sum(v < r.v for v in mine) + (r.n + 1) / 2


SENTENCE = "trace bigint, sid bigint, coded boolean, label string, macro string, test_context string, specificity string, judgement string"
DOMAINS = {"test_context": facts.TEST_CONTEXT, "specificity": facts.SPECIFICITY, "judgement": facts.JUDGEMENT}


def quality(spark, traces, sentences):
    table = spark.createDataFrame(traces, "trace bigint, state string, error string, answer string")
    return {r.trace: r for r in Y.trace_quality(table, spark.createDataFrame(sentences, SENTENCE), facts.MACRO, DOMAINS).collect()}


def good(trace, labels):
    more = {"TEST": ("post_rule", "within_panel", None), "JUDGE": (None, None, "accept")}
    return [(trace, k, True, x, facts.MACRO[x], *more.get(x, (None, None, None))) for k, x in enumerate(labels)]


def test_each_planted_fault_is_found_alone(spark):
    labels = ["ORIENT", "HYPO", "TEST", "JUDGE"] * 10 + ["RULE"]
    faults = {
        1: ({}, []),
        2: ({5: {2: False}}, ["missing_coding_block_s5"]),
        3: ({5: {2: None}}, ["missing_coding_block_s5"]),
        4: ({7: {3: "GUESS"}}, ["invalid_micro_label_s7:'GUESS'"]),
        5: ({7: {3: None}}, ["invalid_micro_label_s7:None"]),
        6: ({1: {4: "SETUP"}}, ["macro_mismatch_s1:'SETUP'!='INVESTIGATE'"]),
        7: ({1: {4: None}}, ["macro_mismatch_s1:None!='INVESTIGATE'"]),
        8: ({2: {5: "later"}}, ["coverage_test_context_below_95"]),
        9: ({2: {6: None}}, ["coverage_specificity_below_95"]),
        10: ({3: {7: "maybe"}}, ["coverage_judgement_below_95"]),
        11: ({0: {4: "X"}, 9: {2: False}, 4: {3: "Y"}}, ["macro_mismatch_s0:'X'!='SETUP'", "invalid_micro_label_s4:'Y'", "missing_coding_block_s9"]),
    }
    sentences = []
    for trace, (changes, _) in faults.items():
        for row in good(trace, labels):
            row = list(row)
            for at, value in changes.get(row[1], {}).items():
                row[at] = value
            sentences.append(tuple(row))
    sentences += good(20, labels) + good(21, labels)
    traces = [(k, "ok", None, "so") for k in faults] + [(20, "missing", None, "x"), (21, "corrupt", "line 3", None), (22, "ok", None, "x")]
    got = quality(spark, traces, sentences)
    assert {k: got[k].issues for k in faults} == {k: told for k, (_, told) in faults.items()}
    assert [got[k].issues for k in (20, 21, 22)] == [["missing_trace_file"], ["corrupt_json: line 3"], ["missing_or_empty_sentences"]]
    assert [got[k].status for k in (1, 2, 20)] == ["PASS", "FAIL", "FAIL"] and (got[20].n_sentences, got[22].entropy_norm, got[22].has_answer, got[1].has_answer) == (0, 0.0, False, True)


def test_metrics_of_the_order(spark):
    labels = ["DESCRIBE", "ORIENT"] + ["HYPO"] * 10 + ["TEST"] + ["PLAN"] * 12 + ["HYPO"] * 12
    rows = good(1, labels)
    rows.insert(5, (1, 4, False, "RULE", None, None, None, None))  # no part of the order, same sid as a good one
    got = quality(spark, [(1, "ok", None, " ")], rows)[1]
    assert (got.longest_run_len, got.longest_run_label, got.n_long_runs, got.orient_in_first5, got.rule_present, got.has_answer) == (12, "PLAN", 3, True, False, False)
    grams = [tuple(labels[k : k + 4]) for k in range(len(labels) - 3)]
    assert got.repetition_ratio == pytest.approx((len(grams) - len(set(grams))) / len(grams)) and got.hypo_test_share == pytest.approx(1 / (len(labels) - 1)) and got.unique_label_count == 5


def test_numbers_of_labels():
    assert facts.NUMBERED == "ORIENT DESCRIBE SYNTHESIZE HYPO TEST JUDGE PLAN MONITOR RULE".split() and (Y.COVERAGE, Y.LONG_RUN, Y.GRAM, X.MOST_PAIRS, X.MOST_SMALLER) == (95, 10, 4, 50, 8)
