"""Operators over ordered label sequences. All take the sentence table: trace, sid (order), label.

One shuffle by trace serves every window of an operator; aggregates over traces combine on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def trace_order() -> WindowSpec:
    return Window.partitionBy("trace").orderBy("sid")


def transitions(rows: DataFrame) -> DataFrame:
    """(from_label, to_label, n): bigrams within traces."""
    pairs = rows.withColumn("to_label", F.lead("label").over(trace_order())).where(F.col("to_label").isNotNull())
    return pairs.groupBy(F.col("label").alias("from_label"), "to_label").agg(F.count("*").alias("n"))


def transition_matrix(rows: DataFrame, labels: list[str]) -> DataFrame:
    """(from_label, to_label, n, p) for every pair of labels; p is 0 in a row without transitions."""
    dim = rows.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    grid = dim.select(F.col("label").alias("from_label")).crossJoin(dim.select(F.col("label").alias("to_label")))  # labels x labels, a fixed size
    full = F.broadcast(transitions(rows)).join(grid, ["from_label", "to_label"], "right").na.fill(0, ["n"])
    total = F.sum("n").over(Window.partitionBy("from_label"))
    return full.withColumn("p", F.coalesce(F.try_divide("n", total), F.lit(0.0)))


def top_transitions(rows: DataFrame, k: int) -> DataFrame:
    return transitions(rows).orderBy(F.desc("n"), "from_label", "to_label").limit(k)


def self_transitions(rows: DataFrame) -> DataFrame:
    """(label, n_self, n_from, rate)."""
    own = F.when(F.col("from_label") == F.col("to_label"), F.col("n")).otherwise(0)
    found = transitions(rows).groupBy(F.col("from_label").alias("label")).agg(F.sum(own).alias("n_self"), F.sum("n").alias("n_from"))
    return found.withColumn("rate", F.col("n_self") / F.col("n_from"))


def entropy(rows: DataFrame, group: str, *value: str) -> DataFrame:
    """(group, bits): Shannon entropy of the values within each group."""
    counts = rows.groupBy(group, *value).agg(F.count("*").alias("n"))
    # H = log2 N - sum(n log2 n) / N, so that no second pass over the counts is needed.
    return counts.groupBy(group).agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("bits"))


def transition_entropy(rows: DataFrame) -> DataFrame:
    pairs = rows.withColumn("to_label", F.lead("label").over(trace_order())).where(F.col("to_label").isNotNull())
    return entropy(pairs, "trace", "label", "to_label")


def runs(rows: DataFrame, least: int = 1) -> DataFrame:
    """(trace, label, first_sid, length) of maximal runs of a label with at least `least` rows."""
    turn = (F.col("label") != F.lag("label").over(trace_order())).cast("int")
    islands = rows.withColumn("turn", F.coalesce(turn, F.lit(0))).withColumn("island", F.sum("turn").over(trace_order()))
    found = islands.groupBy("trace", "island").agg(F.first("label").alias("label"), F.min("sid").alias("first_sid"), F.count("*").alias("length"))
    return found.where(F.col("length") >= least).drop("island")


def longest_run(rows: DataFrame) -> DataFrame:
    """(trace, label, length): of each trace's longest run, the first one if several are."""
    return runs(rows).groupBy("trace").agg(F.max_by("label", F.struct("length", -F.col("first_sid"))).alias("label"), F.max("length").alias("length"))


def ends(rows: DataFrame) -> DataFrame:
    """(trace, opening, closing, n_labels)."""
    return rows.groupBy("trace").agg(F.min_by("label", "sid").alias("opening"), F.max_by("label", "sid").alias("closing"), F.countDistinct("label").alias("n_labels"))


def phases(rows: DataFrame) -> DataFrame:
    """(trace, first_hypo, scanning, cycling, convergence, strategy): shares of a trace before its first HYPO, from there to its last later JUDGE, and after."""
    first = F.min(F.when(F.col("label") == "HYPO", F.col("sid"))).over(Window.partitionBy("trace"))
    seen = rows.withColumn("h", first)
    per = seen.groupBy("trace").agg(F.count("*").alias("n"), F.first("h").alias("h"), F.max(F.when((F.col("label") == "JUDGE") & (F.col("sid") > F.col("h")), F.col("sid"))).alias("j"))
    scanning = F.when(F.col("h").isNull(), 1.0).otherwise(F.col("h") / F.col("n"))
    cycling = F.when(F.col("h").isNull(), 0.0).when(F.col("j").isNull(), (F.col("n") - F.col("h")) / F.col("n")).otherwise((F.col("j") - F.col("h") + 1) / F.col("n"))
    strategy = F.when(F.col("h").isNull(), "direct").when(F.col("j").isNull(), "scan_test").otherwise("full")
    return per.select("trace", F.col("h").alias("first_hypo"), scanning.alias("scanning"), cycling.alias("cycling"), (1 - scanning - cycling).alias("convergence"), strategy.alias("strategy"))


def repetition_ratio(rows: DataFrame, n: int = 4) -> DataFrame:
    """(trace, ratio): share of label n-grams that repeat an earlier one; 0 for shorter traces."""
    gram = F.when(F.lead("label", n - 1).over(trace_order()).isNotNull(), F.concat_ws(">", *[F.lead("label", k).over(trace_order()) for k in range(n)]))
    found = rows.withColumn("gram", gram).groupBy("trace").agg(F.count("gram").alias("grams"), F.countDistinct("gram").alias("kinds"))
    return found.select("trace", F.coalesce(F.try_divide(F.col("grams") - F.col("kinds"), F.col("grams")), F.lit(0.0)).alias("ratio"))


def adjacency_share(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(trace, share): bigrams that go between a and b, in either direction."""
    pairs = rows.withColumn("t", F.lead("label").over(trace_order())).where(F.col("t").isNotNull())
    between = ((F.col("label") == a) & (F.col("t") == b)) | ((F.col("label") == b) & (F.col("t") == a))
    return pairs.groupBy("trace").agg(F.avg(between.cast("double")).alias("share"))


def presence(rows: DataFrame, first: int = 5) -> DataFrame:
    """(trace, orient_early, has_rule)."""
    return rows.groupBy("trace").agg(F.bool_or((F.col("label") == "ORIENT") & (F.col("sid") < first)).alias("orient_early"), F.bool_or(F.col("label") == "RULE").alias("has_rule"))


def latest(labels: tuple[str, ...], back: int, where: Column | None = None) -> Column:
    """sid of the nearest earlier row with one of the labels among the last `back`."""
    hit = F.col("label").isin(*labels) if where is None else F.col("label").isin(*labels) & where
    return F.last(F.when(hit, F.col("sid")), ignorenulls=True).over(trace_order().rowsBetween(-back, -1))


def _earlier(back: int) -> Column:
    return F.collect_list(F.struct("sid", "label")).over(trace_order().rowsBetween(-back, -1))


def _newest(found: Column, k: int) -> Column:
    """The last k of ascending sids."""
    return F.slice(found, F.greatest(F.size(found) - k + 1, F.lit(1)), F.lit(k))


def latest_few(labels: tuple[str, ...], back: int, k: int) -> Column:
    """sids of the newest k rows with one of the labels among the last `back`, ascending."""
    return _newest(F.transform(F.filter(_earlier(back), lambda x: x["label"].isin(*labels)), lambda x: x["sid"]), k)


def preceding_run(labels: tuple[str, ...], back: int, k: int) -> Column:
    """sids of the unbroken run of these labels right before the row, its newest k, ascending."""
    broken = F.max(F.when(~F.col("label").isin(*labels), F.col("sid"))).over(trace_order().rowsBetween(-back, -1))
    run = F.filter(_earlier(back), lambda x: x["sid"] > F.coalesce(broken, F.lit(-1)))
    return _newest(F.transform(run, lambda x: x["sid"]), k)


def dependencies(rows: DataFrame, window: int = 20, hypo: int = 35, rule: int = 50) -> DataFrame:
    """rows with depends_on: the earlier sentences each one rests on, by a rule for its label.

    `window`, `hypo` and `rule` count coded rows back. A row without a label has no list; one whose rule finds nothing
    has an empty one. All frames share one sort by trace and sid.
    """
    some = lambda *found: F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull()))
    before, before_sid = F.lag("label").over(trace_order()), F.lag("sid").over(trace_order())
    anchor, judge = latest(("HYPO",), window), latest(("JUDGE",), hypo)
    tests = F.transform(F.filter(_earlier(window), lambda x: (x["label"] == "TEST") & (x["sid"] > F.coalesce(anchor, F.lit(-1)))), lambda x: x["sid"])
    moved = F.col("status").isin("revised", "repeated") & F.col("antecedent").isNotNull()
    accepted = latest(("JUDGE",), rule, F.col("judgement") == "accept")
    found = (
        F.when(F.col("label") == "ORIENT", F.when(before == "ORIENT", some(before_sid)).otherwise(some()))
        .when(F.col("label") == "PLAN", some(latest(("ORIENT", "MONITOR", "JUDGE", "SYNTHESIZE"), window)))
        .when(F.col("label") == "DESCRIBE", some(F.when(before == "DESCRIBE", before_sid).otherwise(latest(("PLAN",), window))))
        .when(F.col("label") == "SYNTHESIZE", preceding_run(("DESCRIBE", "SYNTHESIZE", "TEST"), window, 5))
        .when(F.col("label") == "HYPO", F.when(moved, some(F.col("antecedent"), judge)).otherwise(some(F.coalesce(judge, latest(("SYNTHESIZE", "MONITOR"), hypo)))))
        .when(F.col("label") == "TEST", F.array_distinct(F.concat(some(anchor), preceding_run(("DESCRIBE", "TEST"), window, 3))))
        .when(F.col("label") == "JUDGE", F.array_distinct(F.concat(some(anchor), _newest(tests, 3))))
        .when(F.col("label") == "MONITOR", some(before_sid))
        .when(F.col("label") == "RULE", some(F.coalesce(accepted, latest(("JUDGE",), rule)), latest(("HYPO",), rule)))
        .when(F.col("label").isNotNull(), some())
    )
    return rows.withColumn("depends_on", found)
