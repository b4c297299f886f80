"""Fixed values against a second, hand-written statement of them: queries and their SQL may not share a mistake."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tracelode.operators import cleaning, responses, steering
from tracelode.plans import catalog, facts
from tracelode.sources import traces


def test_label_tables():
    groups = {"SETUP": "ORIENT", "OBSERVE": "DESCRIBE SYNTHESIZE", "INVESTIGATE": "HYPO TEST JUDGE", "REGULATE": "PLAN MONITOR", "CONCLUDE": "RULE"}
    assert facts.MACRO == {x: g for g, listed in groups.items() for x in listed.split()} and sorted(facts.LABELS) == sorted(facts.MACRO)
    assert (set(facts.JUDGEMENT), set(facts.CONFIDENCE)) == ({"accept", "reject", "uncertain"}, {"high", "medium"})
    assert (set(facts.TEST_CONTEXT), set(facts.SPECIFICITY)) == ({"post_hypothesis", "pre_hypothesis", "post_rule"}, {"within_panel", "across_panels"})


def test_published_label_shares():
    """Published shares: TEST 50.19 %, HYPO 17.48 %, JUDGE 12.34 % are one broad category, which has 80 % of all."""
    shares = {"TEST": 50.19, "HYPO": 17.48, "JUDGE": 12.34}
    assert {facts.MACRO[x] for x in shares} == {"INVESTIGATE"} and sum(shares.values()) == pytest.approx(80.01)


def test_bins_prices_and_gaps():
    assert catalog._BINS == [1, 6, 11, 21, 31, 51, 76, 101, 151, 201]
    assert responses.PRICE == (1.5, 7.5) and steering.GAPS == {"words": 5, "chars": 30, "points": 30}
    assert sum(catalog.DOMAINS.values()) == pytest.approx(1) and len(catalog.DOMAINS) == 8
    assert [(s, t) for _, s, t, _ in cleaning.MANUAL] == [(list(range(206, 210)), 210), (list(range(230, 235)), 235), ([108, 109], 107)]


def test_groups_and_seeds(spark):
    rows = spark.createDataFrame([("A", 4096, 2, 7), ("a", 1, 3, 1), ("B", 4096, 2, 7), ("b", 6144, 4, 80), ("B", 2048, 1, 1), ("C", 4096, 1, 1), ("B", None, 1, 2)], "s string, b int, task int, trace int")
    got = rows.select(traces.trace_group(F.col("s"), F.col("b")).alias("g"), traces.seed(F.col("s"), F.col("task"), F.col("trace")).alias("x"), traces.steered_seed(F.col("task"), F.col("trace")).alias("y")).collect()
    assert [r.g for r in got] == ["Set A", "Set A", "Set B (4096)", "Set B (6144)", "UNEXPECTED", "UNEXPECTED", "UNEXPECTED"]
    assert [(r.x, r.y) for r in got[:4]] == [(2007, 2807), (3001, 3801), (2507, 2807), (4580, 4880)]
