"""Agreement of two label columns a and b, and classification scores from their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(pairs: DataFrame, labels: list, a: str = "a", b: str = "b") -> DataFrame:
    """One row for each value of a, one column for each label of b, zero-filled."""
    return pairs.groupBy(a).pivot(b, labels).agg(F.count(F.lit(1))).na.fill(0)


def kappa(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """(keys, n, agreement, kappa) of each group; kappa is null below two pairs or if chance alone agrees fully.

    From counts of (a, b): the rows are never gathered by group.
    """
    cells = pairs.groupBy(*keys, a, b).agg(F.count("*").alias("k"))
    marks = cells.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("s"), F.col(a).alias("v")), F.struct(F.lit(1).alias("s"), F.col(b).alias("v")))).alias("m"), "k")
    sums = marks.groupBy(*keys, "m.v").agg(F.sum(F.when(F.col("m.s") == 0, F.col("k")).otherwise(0)).alias("x"), F.sum(F.when(F.col("m.s") == 1, F.col("k")).otherwise(0)).alias("y"))
    chance = sums.groupBy(*keys).agg(F.sum(F.col("x") * F.col("y")).alias("c"), F.sum("x").alias("n"))
    same = cells.groupBy(*keys).agg(F.sum(F.when(F.col(a) == F.col(b), F.col("k")).otherwise(0)).alias("s"))
    both = chance.join(same, keys) if keys else chance.join(F.broadcast(same))
    po, pe = F.col("s") / F.col("n"), F.col("c") / (F.col("n") * F.col("n"))
    value = F.when((F.col("n") >= 2) & (pe < 1), (po - pe) / (1 - pe))
    return both.select(*keys, "n", po.alias("agreement"), value.alias("kappa"))


def kappa_by_category(pairs: DataFrame, labels: list, a: str = "a", b: str = "b") -> DataFrame:
    """(category, n, agreement, kappa): each label against the rest, in one pass over the pairs' counts."""
    cells = pairs.groupBy(a, b).agg(F.count("*").alias("k"))
    each = cells.withColumn("category", F.explode(F.array(*map(F.lit, labels))))
    x, y = F.col(a) == F.col("category"), F.col(b) == F.col("category")
    total = lambda test: F.sum(F.when(test, F.col("k")).otherwise(0))
    sums = each.groupBy("category").agg(F.sum("k").alias("n"), total(x == y).alias("s"), total(x).alias("x"), total(y).alias("y"))
    n = F.col("n")
    po, pe = F.col("s") / n, (F.col("x") * F.col("y") + (n - F.col("x")) * (n - F.col("y"))) / (n * n)
    return sums.select("category", "n", po.alias("agreement"), F.when((n >= 2) & (pe < 1), (po - pe) / (1 - pe)).alias("kappa"))


def gate(value: Column, least: float) -> Column:
    return F.when(value.isNull(), "N/A").when(value >= least, "PASS").otherwise("FAIL")


def class_scores(pairs: DataFrame, truth: str = "a", said: str = "b") -> DataFrame:
    """(label, support, precision, recall, f1) for labels that occur on either side; 0 where nothing was said or true."""
    cells = pairs.groupBy(truth, said).agg(F.count("*").alias("k"))
    right = F.when(F.col(truth) == F.col(said), F.col("k")).otherwise(0)
    sides = cells.select(F.col(truth).alias("label"), F.col("k").alias("t"), F.lit(0).alias("p"), right.alias("c")).unionAll(cells.select(said, F.lit(0), "k", F.lit(0)))
    sums = sides.groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("given"), F.sum("c").alias("hit"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    f1 = zero(F.try_divide(2 * F.col("hit"), F.col("support") + F.col("given")))
    return sums.select("label", "support", zero(F.try_divide("hit", "given")).alias("precision"), zero(F.try_divide("hit", "support")).alias("recall"), f1.alias("f1"))


def overall_scores(pairs: DataFrame, truth: str = "a", said: str = "b") -> DataFrame:
    """(macro_f1, weighted_f1, accuracy)."""
    s = class_scores(pairs, truth, said)
    return s.agg(F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"), (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"))


def row_shares(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b, n, share): the row-normalised confusion counts in long form."""
    cells = pairs.groupBy(a, b).agg(F.count("*").alias("n"))
    return cells.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(a)))


def grouped_scores(pairs: DataFrame, keys: list[str], truth: str = "a", said: str = "b", times: str | None = None) -> DataFrame:
    """(keys, n, macro_f1, weighted_f1, accuracy) of each group, from counts; macro over labels that occur on either side. A row counts `times`, or once."""
    cells = pairs.groupBy(*keys, truth, said).agg((F.sum(times) if times else F.count("*")).alias("k"))
    right = F.when(F.col(truth) == F.col(said), F.col("k")).otherwise(0)
    sides = cells.select(*keys, F.col(truth).alias("label"), F.col("k").alias("t"), F.lit(0).cast("bigint").alias("p"), right.alias("c")).unionAll(cells.select(*keys, said, F.lit(0).cast("bigint"), "k", F.lit(0).cast("bigint")))
    sums = sides.groupBy(*keys, "label").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("c").alias("c"))
    f1 = F.coalesce(F.try_divide(2 * F.col("c"), F.col("t") + F.col("p")), F.lit(0.0))
    return sums.groupBy(*keys).agg(F.sum("t").alias("n"), F.avg(f1).alias("macro_f1"), (F.sum(f1 * F.col("t")) / F.sum("t")).alias("weighted_f1"), (F.sum("c") / F.sum("t")).alias("accuracy"))
