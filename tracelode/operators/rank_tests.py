"""Rank and contingency tests. Ranks come from counts of distinct values and a running sum, so ties cost nothing.

p-values are asymptotic: chi-squared by the regularised gamma function in closed form for whole degrees of freedom,
normal by an erfc expansion. The few numbers of a test's result are finished on the driver's side of the plan as columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, value: str, group: str) -> DataFrame:
    """(group, value, n, ties, rank): counts of a group's values with their average rank over all groups."""
    cells = rows.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("n"))
    ties = cells.groupBy("v").agg(F.sum("n").alias("ties"))
    return cells.join(_below(ties).withColumn("rank", F.col("below") + (F.col("ties") + 1) / 2).drop("below"), "v")


def _below(ties: DataFrame, ranges: int = 64) -> DataFrame:
    """ties (v, ties) with the sum of ties over smaller v: in ranges between approximate quantiles, so that no task sorts all values."""
    bounds = sorted(set(ties.select(F.col("v").cast("double").alias("v")).approxQuantile("v", [k / ranges for k in range(1, ranges)], 0.01)))
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("v"))) if bounds else F.lit(0)
    ranged = ties.withColumn("part", part)
    own = F.sum("ties").over(Window.partitionBy("part").orderBy("v")) - F.col("ties")
    totals = ranged.groupBy("part").agg(F.sum("ties").alias("n"))
    lower = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("lower"))  # a row a range
    return ranged.withColumn("own", own).join(F.broadcast(lower), "part").select("v", "ties", (F.col("own") + F.col("lower")).alias("below"))


def chi2_tail(x: Column, df: int) -> Column:
    """P(chi-squared with df degrees of freedom > x)."""
    h = x / 2
    if df % 2 == 0:
        term, total = F.lit(1.0), F.lit(1.0)
        for k in range(1, df // 2):
            term = term * h / k
            total = total + term
        return F.exp(-h) * total
    total = 2 * normal_tail(F.sqrt(x))
    term = F.sqrt(h) / math.gamma(1.5)
    for k in range((df - 1) // 2):
        total = total + F.exp(-h) * term
        term = term * h / (k + 1.5)
    return total


def normal_tail(z: Column) -> Column:
    """P(N > z) for z >= 0, relative error below 1.2e-7 (rational Chebyshev fit of erfc)."""
    x = z / math.sqrt(2)
    t = 1 / (1 + x / 2)
    #: Coefficients of the fit, from the constant on.
    fit = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(fit[-1])
    for c in fit[-2::-1]:
        poly = poly * t + c
    return t * F.exp(-x * x + poly) / 2


def _sums(rows: DataFrame, value: str, group: str) -> tuple[DataFrame, DataFrame]:
    cells = ranked(rows, value, group)
    groups = cells.groupBy("g").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("r"))
    ties = cells.groupBy("v").agg(F.first("ties").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double").alias("tie"))
    return groups, ties


def kruskal(rows: DataFrame, value: str, group: str, k: int) -> DataFrame:
    """(h, df, p) over k groups, corrected for ties."""
    groups, ties = _sums(rows, value, group)
    total = groups.agg(F.sum("n").cast("double").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q")).join(F.broadcast(ties))
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("tie") / (n * n * n - n))
    return total.select(h.alias("h"), F.lit(k - 1).alias("df")).withColumn("p", chi2_tail(F.col("h"), k - 1))


def mann_whitney(rows: DataFrame, value: str, group: str) -> DataFrame:
    """(u, z, p) of group true against false: two-sided, continuity and tie corrections."""
    groups, ties = _sums(rows, value, group)
    first = lambda c, is_: F.sum(F.when(F.col("g") == is_, F.col(c))).cast("double")
    t = groups.agg(first("n", True).alias("n1"), first("n", False).alias("n2"), first("r", True).alias("r1")).join(F.broadcast(ties))
    n = F.col("n1") + F.col("n2")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * (n + 1 - F.col("tie") / (n * (n - 1))))
    z = (F.greatest(u, F.col("n1") * F.col("n2") - u) - F.col("n1") * F.col("n2") / 2 - 0.5) / sd
    return t.select(u.alias("u"), z.alias("z")).withColumn("p", F.least(2 * normal_tail(F.greatest("z", F.lit(0.0))), F.lit(1.0)))


def dunn(rows: DataFrame, value: str, group: str) -> DataFrame:
    """(a, b, z, p): pairs of groups, Bonferroni-corrected."""
    groups, ties = _sums(rows, value, group)
    whole = groups.agg(F.sum("n").cast("double").alias("total"), F.count("*").alias("m")).join(F.broadcast(ties))
    one = groups.select("g", "n", (F.col("r") / F.col("n")).alias("mean"))
    two = one.toDF("h", "k", "other")
    pairs = one.join(two, F.col("g") < F.col("h")).join(F.broadcast(whole))  # pairs of groups: as many as tests are made
    n = F.col("total")
    sd = F.sqrt((n * (n + 1) / 12 - F.col("tie") / (12 * (n - 1))) * (1 / F.col("n") + 1 / F.col("k")))
    z = F.abs(F.col("mean") - F.col("other")) / sd
    tests = F.col("m") * (F.col("m") - 1) / 2
    return pairs.select(F.col("g").alias("a"), F.col("h").alias("b"), z.alias("z"), tests.alias("tests")).withColumn("p", F.least(2 * normal_tail(F.col("z")) * F.col("tests"), F.lit(1.0))).drop("tests")


def wilcoxon(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """(n, w, z, p) of paired values: zero differences dropped, normal approximation with tie correction; p = 1 without a difference."""
    d = pairs.select((F.col(x) - F.col(y)).alias("d")).where("d <> 0").select(F.abs("d").alias("v"), (F.col("d") > 0).alias("g"))
    groups, ties = _sums(d, "v", "g")
    t = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("n"), F.coalesce(F.sum(F.when(F.col("g"), F.col("r"))), F.lit(0.0)).alias("plus")).join(F.broadcast(ties))
    n = F.col("n")
    w = F.least("plus", n * (n + 1) / 2 - F.col("plus"))
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.coalesce("tie", F.lit(0.0)) / 48)
    z = F.when(sd > 0, F.abs(w - n * (n + 1) / 4) / sd)
    return t.select(n.cast("bigint").alias("n"), w.alias("w"), z.alias("z")).withColumn("p", F.coalesce(F.least(2 * normal_tail(F.col("z")), F.lit(1.0)), F.lit(1.0)))


def chi_squared(rows: DataFrame, a: str, b: str, df: int) -> DataFrame:
    """(chi2, df, p) of independence: sum of observed squares over expected counts, less n."""
    cells = rows.groupBy(a, b).agg(F.count("*").alias("o"))
    total = lambda *k: F.sum("o").over(Window.partitionBy(*k))
    part = cells.select((F.col("o") * F.col("o") / total(a) / total(b)).alias("q"), "o")
    found = part.agg((F.sum("q") * F.sum("o") - F.sum("o")).alias("chi2")).withColumn("df", F.lit(df))
    return found.withColumn("p", chi2_tail(F.col("chi2"), df))


def cohens_d(pairs: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, n, d): mean difference over its population deviation, 0 if that is 0."""
    d = F.col(x) - F.col(y)
    return pairs.groupBy(key).agg(F.count(d).alias("n"), F.coalesce(F.try_divide(F.avg(d), F.stddev_pop(d)), F.lit(0.0)).alias("d"))
