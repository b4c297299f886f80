"""Distributions, contingency tables, subtotals and robust summaries of labelled rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.operators.quantiles import quantiles


def label_distribution(rows: DataFrame, labels: list[str]) -> DataFrame:
    """(label, ord, n, pct) in a fixed order, absent labels with null."""
    dim = rows.sparkSession.createDataFrame(list(zip(labels, range(len(labels)))), "label string, ord int")
    counts = rows.groupBy("label").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return F.broadcast(counts.withColumn("pct", 100 * F.col("n") / total)).join(dim, "label", "right").select("label", "ord", "n", "pct")


def contingency(rows: DataFrame, group: str, labels: list[str], percent: bool = False, label: str = "label") -> DataFrame:
    """One row a group, one column a label, zero-filled; as row percentages if asked."""
    table = rows.groupBy(group).pivot(label, labels).agg(F.count(F.lit(1))).na.fill(0)
    if not percent:
        return table
    total = reduce(lambda a, b: a + b, map(F.col, labels))
    return table.select(group, *[(100 * F.col(x) / total).alias(x) for x in labels])


def long_flags(rows: DataFrame, flags: list[str]) -> DataFrame:
    """(flag, value, n, pct): values of several flag columns in one long table, nulls left out."""
    counts = rows.unpivot([], flags, "flag", "value").where(F.col("value").isNotNull()).groupBy("flag", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy("flag")))


def describe(value: str | Column) -> list[Column]:
    v = F.col(value) if isinstance(value, str) else value
    return [F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_samp(v).alias("sd"), F.min(v).alias("least"), F.max(v).alias("most")]


def described(rows: DataFrame, keys: list[str], value: str | Column) -> DataFrame:
    """(keys, describe()) of each group, the median by ranks: no group's values are held in a buffer. A group of nulls alone has n 0."""
    v = F.col(value) if isinstance(value, str) else value
    named = rows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], v.alias("_v"))
    own = [f"_k{i}" for i in range(len(keys))]
    basic = named.groupBy(*own).agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("sd"), F.min("_v").alias("least"), F.max("_v").alias("most"))
    half = quantiles(named, own, "_v", [0.5]).select(*[F.col(k).alias(f"{k}q") for k in own], F.col("q")[0].alias("median"))
    same = F.lit(True)
    for k in own:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}q"))
    return basic.join(half, same, "left").select(*[F.col(k).alias(name) for k, name in zip(own, keys)], "n", "mean", "median", "sd", "least", "most")


def _by_sets(rows: DataFrame, keys: list[str], sets: list[list[str]], value: str) -> DataFrame:
    """described() of each of `sets`; a key that a set lacks is null. Rows are repeated once a set, as grouping sets do."""
    # `_set` tells a key's own nulls from those of a set without it.
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("_set"), *[(F.col(k) if k in s else F.lit(None).cast(rows.schema[k].dataType)).alias(k) for k in keys]) for i, s in enumerate(sets)]))
    return described(rows.select(F.col(value).alias("_value"), each.alias("_e")).select("_value", "_e.*"), ["_set", *keys], "_value").drop("_set")


def subtotals(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """described() of every prefix of keys down to the whole."""
    return _by_sets(rows, keys, [keys[:i] for i in range(len(keys) + 1)], value)


def grouped(rows: DataFrame, sets: list[list[str]], metrics: list[str]) -> DataFrame:
    """(metric, keys..., described()) for each grouping set; absent keys are null."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    long = rows.unpivot(keys, [F.col(m).cast("double").alias(m) for m in metrics], "metric", "v")
    return _by_sets(long, ["metric", *keys], [["metric", *s] for s in sets], "v")


def histogram(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, n): bins of equal width from least to most, the last one closed; all in bin 1 if all are equal."""
    bounds = rows.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    v = F.col(value).cast("double")
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1, F.lit(bins))).otherwise(1)
    return rows.where(F.col(value).isNotNull()).join(F.broadcast(bounds)).groupBy(at.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def checks(rows: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """(check, n_issues) of all tests in one pass."""
    wide = rows.agg(*[F.count_if(F.coalesce(test, F.lit(False))).alias(name) for name, test in tests.items()])
    return wide.unpivot([], list(tests), "check", "n_issues")


def dominance(rows: DataFrame, over: float = 0.7) -> DataFrame:
    """(trace, label, share) of traces in which one label has more than `over` of the rows."""
    counts = rows.groupBy("trace", "label").agg(F.count("*").alias("k"))
    top = counts.groupBy("trace").agg(F.max_by("label", F.struct("k", "label")).alias("label"), (F.max("k") / F.sum("k")).alias("share"))
    return top.where(F.col("share") > over)


def robust(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, q1, median, q3, low, high): quartiles and Tukey's fences; least and most serve as quartiles of three values, the least of fewer. A group of nulls alone has no row."""
    q = quantiles(rows, [group], value, [0.25, 0.5, 0.75])
    q1 = F.when(F.col("n") <= 3, F.col("least")).otherwise(F.col("q")[0])
    q3 = F.when(F.col("n") < 3, F.col("least")).when(F.col("n") == 3, F.col("most")).otherwise(F.col("q")[2])
    found = q.select(group, "n", q1.alias("q1"), F.col("q")[1].alias("median"), q3.alias("q3"))
    spread = 1.5 * (F.col("q3") - F.col("q1"))
    return found.withColumn("low", F.col("q1") - spread).withColumn("high", F.col("q3") + spread)


def class_weights(rows: DataFrame, labels: list[str]) -> DataFrame:
    """(label, weight): balanced weights, 1 for absent labels."""
    dist = label_distribution(rows, labels)
    total = F.sum("n").over(Window.partitionBy())
    return dist.select("label", F.coalesce(F.round(total / (len(labels) * F.col("n")), 3), F.lit(1.0)).alias("weight"))


def keep_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row by `order` of each key."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_r", last).where("_r = 1").drop("_r")


def macro_average(rows: DataFrame, labels: list[str]) -> DataFrame:
    """(label, mean_pct): mean over traces of each label's share in the trace, absent ones as 0."""
    wide = contingency(rows, "trace", labels, percent=True)
    return wide.unpivot([], labels, "label", "pct").groupBy("label").agg(F.avg("pct").alias("mean_pct"))


def sample(rows: DataFrame, k: int, seed: int, *key: str) -> DataFrame:
    """k rows in order of MD5 over seed and key: the same in every run and engine."""
    joined = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in key])
    return rows.withColumn("_h", F.md5(joined)).orderBy("_h", *key).limit(k).drop("_h")


def closest(rows: DataFrame, keys: list[str], value: str, target: float, tie: str) -> DataFrame:
    """Of each group the row whose value is nearest to target."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.abs(F.col(value) - target), tie))).where("_r = 1").drop("_r")


def binned(rows: DataFrame, value: str, starts: list[int]) -> DataFrame:
    """(bin, n): counts by bins of whole numbers, each from its start to the next one's; the last is open, the first open below."""
    names = [f"{a}-{b - 1}" for a, b in zip(starts, starts[1:])] + [f"{starts[-1]}+"]
    name = F.lit(names[0])
    for start, text in zip(starts[1:], names[1:]):
        name = F.when(F.col(value) >= start, text).otherwise(name)
    return rows.groupBy(name.alias("bin")).agg(F.count("*").alias("n"))


def domain_shares(rows: DataFrame, published: dict[str, float]) -> DataFrame:
    """(domain, share, published, difference): shares of all rows by domain, JUDGE by its judgement; uncertainty and self-checking as one."""
    label, judgement = F.col("label"), F.col("judgement")
    merged = "uncertainty_management+self_checking"
    domain = (
        F.when(label == "ORIENT", "problem_setup").when(label.isin("HYPO", "PLAN"), "plan_generation").when(label == "DESCRIBE", "fact_retrieval").when(label == "TEST", "active_computation")
        .when((label == "MONITOR") | ((label == "JUDGE") & judgement.isin("reject", "uncertain")), merged).when((label == "SYNTHESIZE") | ((label == "JUDGE") & (judgement == "accept")), "result_consolidation").when(label == "RULE", "final_answer_emission")
    )
    counts = rows.groupBy(domain.alias("domain")).agg(F.count("*").alias("n"))
    shares = counts.select("domain", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))  # eight rows
    apart = merged.split("+")
    values = [(d, p) for d, p in published.items() if d not in apart] + [(merged, round(sum(published[d] for d in apart), 6))]
    known = rows.sparkSession.createDataFrame(values, "domain string, published double")
    found = known.join(F.broadcast(shares), "domain", "left").withColumn("share", F.round(F.coalesce("share", F.lit(0.0)), 4))
    return found.select("domain", "share", "published", F.round(F.col("share") - F.col("published"), 4).alias("difference"))
