"""Quality rules of coded traces: one row a trace with its metrics, the issues found and a status.

A rule has a code, a scope (a sentence or a whole trace) and a condition. Rules of sentences are looked at where a sentence is
read, those of traces on a trace's sums; further rules are further rows of the two tables. Labels that aren't valid are no part of
the order that runs, pairs and four-grams are taken from.

Scale: one shuffle by trace serves the order and all sums. Valid sentences come first in a trace's order, so each is
next to the valid one before it. What a trace keeps besides sums is its issues and its distinct four-grams, 9 ** 4 at most.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The share of coded flags, in percent, that a trace has at least, and what a long run has.
COVERAGE, LONG_RUN, GRAM, EARLY = 95.0, 10, 4, 5


@dataclass(frozen=True)
class Rule:
    """code is told where the condition holds, with the detail behind it."""

    code: str
    when: Column
    detail: Column | None = None

    def issue(self) -> Column:
        return F.when(self.when, F.lit(self.code) if self.detail is None else F.concat(F.lit(self.code), self.detail))


def _quoted(value: Column) -> Column:
    return F.coalesce(F.concat(F.lit("'"), value, F.lit("'")), F.lit("None"))


def sentence_rules(macro_of: dict[str, str]) -> list[Rule]:
    """Of columns sid, coded, label, macro."""
    valid = F.col("coded") & F.coalesce(F.col("label").isin(*macro_of), F.lit(False))
    wanted = F.create_map(*[F.lit(x) for pair in macro_of.items() for x in pair])[F.col("label")]
    at = F.concat(F.lit("_s"), F.col("sid").cast("string"))
    return [
        Rule("missing_coding_block", ~F.col("coded"), at),
        Rule("invalid_micro_label", F.col("coded") & ~valid, F.concat(at, F.lit(":"), _quoted(F.col("label")))),
        Rule("macro_mismatch", valid & ~F.col("macro").eqNullSafe(wanted), F.concat(at, F.lit(":"), _quoted(F.col("macro")), F.lit("!="), _quoted(wanted))),
    ]


def trace_rules() -> list[Rule]:
    """Of a trace's metric columns. A trace that can't be read, or has no sentence, has one issue."""
    low = lambda n, share: (F.col(n) > 0) & (F.col(share) < COVERAGE)
    return [
        Rule("missing_trace_file", F.col("state") == "missing"),
        Rule("corrupt_json", F.col("state") == "corrupt", F.concat(F.lit(": "), F.coalesce("error", F.lit("")))),
        Rule("missing_or_empty_sentences", (F.col("state") == "ok") & (F.col("n_sentences") == 0)),
        Rule("coverage_test_context_below_95", low("n_test", "test_context_pct")),
        Rule("coverage_specificity_below_95", low("n_test", "specificity_pct")),
        Rule("coverage_judgement_below_95", low("n_judge", "judgement_pct")),
    ]


def _told(rules: list[Rule]) -> Column:
    return F.array_compact(F.array(*[r.issue() for r in rules]))


def trace_quality(traces: DataFrame, sentences: DataFrame, macro_of: dict[str, str], domains: dict[str, list[str]], more: list[Rule] | None = None) -> DataFrame:
    """One row for each of traces (trace, state, error, answer): its metrics, issues (array<string>) and status FAIL or PASS.

    sentences: (trace, sid, coded, label, macro, test_context, specificity, judgement); those of traces that aren't
    `ok` are not looked at. domains: the values that each of the last three may have, for labels TEST, TEST and JUDGE. Metrics of a
    trace without sentences are 0, its flags false and its longest run null. Shares are percentages.
    """
    whole = lambda c: F.coalesce(c, F.lit(False))
    rows = sentences.withColumn("coded", whole(F.col("coded"))).withColumn("valid", F.col("coded") & whole(F.col("label").isin(*macro_of)))
    rows = rows.withColumn("_told", _told(sentence_rules(macro_of)))
    order = Window.partitionBy("trace").orderBy(F.col("valid").desc(), "sid")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("k", F.row_number().over(order))
    back = [F.col("label"), *[F.lag("label", n).over(order) for n in range(1, GRAM)]]
    rows = rows.select("*", *[b.alias(f"b{n}") for n, b in enumerate(back)])
    rows = rows.withColumn("first", F.last(F.when(F.col("b1").isNull() | (F.col("b1") != F.col("label")), F.col("k")), ignorenulls=True).over(so_far))
    v = F.col("valid")
    run = F.col("k") - F.col("first") + 1
    pair = v & (F.col("k") > 1)
    flip = pair & (((F.col("b1") == "HYPO") & (F.col("label") == "TEST")) | ((F.col("b1") == "TEST") & (F.col("label") == "HYPO")))
    has = lambda c, label: v & (F.col("label") == label) & whole(F.col(c).isin(*domains[c]))
    told = F.collect_list(F.when(F.size("_told") > 0, F.struct("sid", "_told")))
    sums = rows.groupBy("trace").agg(
        F.count("*").alias("n_sentences"),
        F.count_if(~F.col("coded")).alias("n_missing_coding"),
        F.count_if(F.col("coded") & ~v).alias("n_invalid_micro"),
        F.count_if(F.array_contains(F.transform("_told", lambda x: x.startswith("macro_mismatch")), True)).alias("n_macro_mismatch"),
        F.count_if(v).alias("n_valid_labels"),
        *[F.count_if(v & (F.col("label") == x)).alias(f"n_{x.lower()}") for x in macro_of],
        F.count_if(has("test_context", "TEST")).alias("_context"),
        F.count_if(has("specificity", "TEST")).alias("_specific"),
        F.count_if(has("judgement", "JUDGE")).alias("_judged"),
        F.coalesce(F.bool_or(v & (F.col("k") <= EARLY) & (F.col("label") == "ORIENT")), F.lit(False)).alias("orient_in_first5"),
        F.max(F.when(v & (run >= LONG_RUN), F.struct(run.alias("length"), (-F.col("first")).alias("at"), F.col("label").alias("label")))).alias("_run"),
        F.count_if(v & (run == LONG_RUN)).alias("n_long_runs"),
        F.count_if(pair).alias("_pairs"),
        F.count_if(flip).alias("_flips"),
        F.size(F.collect_set(F.when(v & (F.col("k") >= GRAM), F.concat_ws(">", *[f"b{n}" for n in range(GRAM)])))).alias("_grams"),
        F.flatten(F.transform(F.array_sort(told), lambda x: x["_told"])).alias("_told"),
    )
    counts = [f"n_{x.lower()}" for x in macro_of]
    n = F.col("n_valid_labels")
    pct = lambda a, b: F.coalesce(F.try_divide(100.0 * F.col(a), F.col(b)), F.lit(0.0))
    part = lambda c: F.when(F.col(c) > 0, -F.col(c) / n * F.log2(F.col(c) / n)).otherwise(0.0)
    metrics = sums.select(
        "trace", "n_sentences", "n_missing_coding", "n_invalid_micro", "n_macro_mismatch", "n_valid_labels", *counts, "n_long_runs", "orient_in_first5",
        pct("_context", "n_test").alias("test_context_pct"), pct("_specific", "n_test").alias("specificity_pct"), pct("_judged", "n_judge").alias("judgement_pct"),
        (F.col("n_rule") > 0).alias("rule_present"),
        F.coalesce(F.col("_run.length"), F.lit(0)).alias("longest_run_len"), F.col("_run.label").alias("longest_run_label"),
        F.coalesce(F.try_divide(F.col("_flips"), F.col("_pairs")), F.lit(0.0)).alias("hypo_test_share"),
        F.coalesce(F.try_divide(F.greatest(n - (GRAM - 1), F.lit(0)) - F.col("_grams"), F.greatest(n - (GRAM - 1), F.lit(0))), F.lit(0.0)).alias("repetition_ratio"),
        (reduce(lambda a, b: a + b, map(part, counts)) / F.log2(F.lit(float(len(macro_of))))).alias("entropy_norm"),
        reduce(lambda a, b: a + b, [(F.col(c) > 0).cast("int") for c in counts]).alias("unique_label_count"),
        "_told",
    )
    read = traces.select("trace", "state", "error", whole(F.trim("answer") != "").alias("has_answer"))
    known = metrics.withColumnRenamed("trace", "_trace")
    found = read.join(known, (F.col("trace") == F.col("_trace")) & (F.col("state") == "ok"), "left").drop("_trace")
    found = found.withColumn("has_answer", F.col("has_answer") & F.col("n_sentences").isNotNull())
    zero = {c: 0 for c, kind in known.dtypes if c != "_trace" and kind in ("bigint", "int", "double")}
    found = found.fillna(zero).fillna({"orient_in_first5": False, "rule_present": False})
    found = found.withColumn("issues", F.concat(F.coalesce("_told", F.array().cast("array<string>")), _told(trace_rules() + (more or [])))).drop("_told", "error")
    return found.withColumn("status", F.when(F.size("issues") > 0, "FAIL").otherwise("PASS"))
