"""Rank tests of many groups at once, with exact p-values where a group is small and without ties.

The null distributions are counted by recurrences, as folds over an array of counts: subsets of 1..n by their sum for
signed ranks, m of m + n ranks by U for two samples. Counts up to 2 ** 53 are exact in doubles. Larger groups and ones with ties have
the normal approximation of `rank_tests`.

Ranks come from counts of a group's distinct values and sums over the ranges before, so that one large group is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.operators.rank_tests import normal_tail

#: Up to so many pairs, and so many in the smaller of two samples, p is exact in the published tests' choice.
MOST_PAIRS, MOST_SMALLER = 50, 8
#: The larger of two samples has so many at most where p is exact.
MOST_LARGER = 50


def signed_rank_counts(n: Column, most: int = MOST_PAIRS) -> Column:
    """array<double>: how many subsets of 1..n have the sum 0, 1, ... n (n + 1) / 2; n is `most` at most."""
    n = F.least(n, F.lit(most)).cast("int")
    size = (n * (n + 1) / 2).cast("int") + 1
    start = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), size - 1))
    ranks = F.filter(F.sequence(F.lit(0), n), lambda k: k > 0)
    return F.aggregate(ranks, start, lambda c, k: F.transform(c, lambda v, i: v + F.when(i >= k, F.get(c, i - k)).otherwise(0.0)))


def u_counts(m: Column, n: Column) -> Column:
    """array<double>: how many choices of m among m + n ranks have U = 0, 1, ... m n; the m + 1 rows of sizes are folded as one array."""
    m, n = m.cast("int"), n.cast("int")
    wide = m * n + 1
    start = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), (m + 1) * wide - 1))
    ranks = F.filter(F.sequence(F.lit(0), m + n), lambda k: k > 0)

    def step(c: Column, k: Column) -> Column:
        # The j-th of the chosen, if it is rank k, is above k - j of the others.
        def one(v: Column, i: Column) -> Column:
            j = F.floor(i / wide).cast("int")
            more = (j > 0) & (k >= j) & (i - j * wide >= k - j)
            return v + F.when(more, F.get(c, i - wide - (k - j))).otherwise(0.0)

        return F.transform(c, one)

    return F.slice(F.aggregate(ranks, start, step), m * wide + 1, wide)


def _with_counts(t: DataFrame, sizes: list[Column], counts: Column) -> DataFrame:
    """t with _counts where it is exact: one distribution for all groups of the same sizes, of which there are few."""
    names = [f"_size{k}" for k in range(len(sizes))]
    t = t.select("*", *[F.when(F.col("exact"), c).alias(n) for c, n in zip(sizes, names)])
    known = t.where("exact").select(*names).distinct().withColumn("_counts", counts)
    return t.join(F.broadcast(known), names, "left")


def _tail(counts: Column, least: Column) -> Column:
    """Twice the share of counts up to index `least`, one at most."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    low = F.slice(counts, F.lit(1), least.cast("int") + 1)
    return F.least(2 * total(low) / total(counts), F.lit(1.0))


def ranks(rows: DataFrame, keys: list[str], value: str, ranges: int = 64) -> DataFrame:
    """(keys, value, n, rank): counts of a group's distinct values and their average rank in the group."""
    cells = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    # One row; ranges by the same bounds in all groups.
    bounds = cells.agg(F.percentile_approx(value, F.array(*[F.lit(k / ranges) for k in range(1, ranges)])).alias("bounds"))
    parts = cells.join(F.broadcast(bounds)).withColumn("part", F.size(F.filter("bounds", lambda b: b <= F.col(value)))).drop("bounds")
    own = F.sum("n").over(Window.partitionBy(*keys, "part").orderBy(value))
    lower = parts.groupBy(*keys, "part").agg(F.sum("n").alias("lower"))
    lower = lower.withColumn("lower", F.sum("lower").over(Window.partitionBy(*keys).orderBy("part")) - F.col("lower"))
    found = parts.withColumn("own", own).join(lower, [*keys, "part"])
    return found.select(*keys, value, "n", (F.col("lower") + F.col("own") - (F.col("n") - 1) / 2).alias("rank"))


def signed_ranks(pairs: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, n, w, exact, p) of the paired differences of each group, two-sided.

    Pairs with a null are left out; zero differences are dropped and, like ties, rule the exact p out. A group without a
    difference has w 0 and p 1. No row, no group.
    """
    d = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, (F.col(x) - F.col(y)).cast("double").alias("d"))
    zero = d.groupBy(*keys).agg(F.count_if(F.col("d") == 0).alias("zeros"))
    some = d.where("d <> 0").select(*keys, F.abs("d").alias("v"), (F.col("d") > 0).alias("up"))
    ranked = ranks(some, keys, "v")
    # Map-side sums: each distinct difference has one rank.
    plus = some.groupBy(*keys, "v").agg(F.count_if("up").alias("ups"))
    t = ranked.join(plus, [*keys, "v"]).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("ups") * F.col("rank")).alias("plus"), F.sum(F.col("n") * (F.col("n") * F.col("n") - 1)).cast("double").alias("tie"))
    t = zero.join(t, keys, "left").fillna({"n": 0, "plus": 0.0, "tie": 0.0})
    n = F.col("n").cast("double")
    w = F.least(F.col("plus"), n * (n + 1) / 2 - F.col("plus"))
    exact = (F.col("n") > 0) & (F.col("n") <= MOST_PAIRS) & (F.col("tie") == 0) & (F.col("zeros") == 0)
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tie") / 48)
    near = F.coalesce(F.least(2 * normal_tail(F.when(sd > 0, F.abs(F.col("w") - n * (n + 1) / 4) / sd)), F.lit(1.0)), F.lit(1.0))
    t = _with_counts(t.withColumn("w", w).withColumn("exact", exact), [F.col("n")], signed_rank_counts(F.col("_size0")))
    return t.select(*keys, "n", "w", "exact", F.when(F.col("exact"), _tail(F.col("_counts"), F.col("w"))).otherwise(near).alias("p"))


def two_samples(rows: DataFrame, keys: list[str], value: str, first: str) -> DataFrame:
    """(keys, n1, n2, u, exact, p): U of the rows where `first` holds against the others of a group, two-sided.

    Rows with a null in either are left out. A group of one sample has u 0 and p null.
    """
    rows = rows.where(F.col(value).isNotNull() & F.col(first).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"), F.col(first).alias("f"))
    side = rows.groupBy(*keys, "v").agg(F.count_if("f").alias("k"))
    t = ranks(rows, keys, "v").join(side, [*keys, "v"]).groupBy(*keys)
    t = t.agg(F.sum("k").alias("n1"), (F.sum("n") - F.sum("k")).alias("n2"), F.sum(F.col("k") * F.col("rank")).alias("r"), F.sum(F.col("n") * (F.col("n") * F.col("n") - 1)).cast("double").alias("tie"))
    a, b = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = a + b
    low, high = F.least("n1", "n2"), F.greatest("n1", "n2")
    exact = (low > 0) & (low <= MOST_SMALLER) & (high <= MOST_LARGER) & (F.col("tie") == 0)
    t = t.withColumn("u", F.col("r") - a * (a + 1) / 2).withColumn("exact", exact)
    sd = F.sqrt(a * b / 12 * (n + 1 - F.col("tie") / (n * (n - 1))))
    z = (F.greatest(F.col("u"), a * b - F.col("u")) - a * b / 2 - 0.5) / sd
    near = F.when(low > 0, F.when(sd > 0, F.least(2 * normal_tail(F.greatest(z, F.lit(0.0))), F.lit(1.0))).otherwise(1.0))
    t = _with_counts(t, [low, high], u_counts(F.col("_size0"), F.col("_size1")))
    p = F.when(F.col("exact"), _tail(F.col("_counts"), F.least(F.col("u"), a * b - F.col("u")))).otherwise(near)
    return t.select(*keys, "n1", "n2", "u", "exact", p.alias("p"))
