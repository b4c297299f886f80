"""Effects of steering: label shares by condition against the baseline's, dose-response, shift matrix, grounding; and confounds of two groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.functions import text as T
from tracelode.operators.aggregates import contingency


def effects(rows: DataFrame, labels: list[str]) -> DataFrame:
    """(condition, category, direction, alpha, label, n, mean, shift) of rows (trace, condition, label): mean shares over a condition's traces, and their shift from the baseline's."""
    shares = contingency(rows.withColumn("_k", F.struct("trace", "condition")), "_k", labels, percent=True)
    long = shares.select("_k.condition", *[(F.col(x) / 100).alias(x) for x in labels]).unpivot(["condition"], labels, "label", "share")
    means = long.groupBy("condition", "label").agg(F.count("*").alias("n"), F.avg("share").alias("mean"))
    base = means.where("condition = 'baseline'").select("label", F.col("mean").alias("base"))
    found = means.where("condition <> 'baseline'").join(F.broadcast(base), "label", "left")  # a row a label
    parts = T.condition_parts(F.col("condition"))
    return found.select("condition", parts["category"].alias("category"), parts["direction"].alias("direction"), parts["alpha"].alias("alpha"), "label", "n", "mean", (F.col("mean") - F.col("base")).alias("shift"))


def dose_response(found: DataFrame) -> DataFrame:
    """(category, dose, n, mean, shift): the target's own share by signed alpha."""
    return found.where("label = category").select("category", (F.col("direction") * F.col("alpha")).alias("dose"), "n", "mean", "shift")


def shift_matrix(found: DataFrame, labels: list[str], alpha: float) -> DataFrame:
    """A row for each steered category and sign at one alpha, a column for each label."""
    name = F.concat("category", F.when(F.col("direction") > 0, "+").otherwise("-"))
    return found.where(F.col("alpha") == alpha).groupBy(name.alias("steered")).pivot("label", labels).agg(F.max("shift"))


def diagonal_dominance(found: DataFrame, alpha: float) -> DataFrame:
    """(category, most_shifted, dominant): whether steering towards a category raises that label most; of equal ones the last by name counts."""
    up = found.where((F.col("alpha") == alpha) & (F.col("direction") > 0))
    most = up.groupBy("category").agg(F.max_by("label", F.struct(F.round("shift", 9), "label")).alias("most_shifted"))
    return most.withColumn("dominant", F.col("most_shifted") == F.col("category"))


def with_steering(scores: DataFrame, found: DataFrame, alpha: float = 1.0) -> DataFrame:
    """scores (category, ...) with the shift of each category's own label when steered towards it; null where it wasn't."""
    own = found.where((F.col("alpha") == alpha) & (F.col("direction") > 0) & (F.col("label") == F.col("category")))
    return scores.join(own.select("category", "shift"), "category", "left")


def grounding(f1: Column, shift: Column, p: Column) -> Column:
    """What a probe's score and steering's shift together say of a category; a missing p doesn't speak against it."""
    sure = F.coalesce(p < 0.05, F.lit(True))
    return (
        F.when(f1.isNull() | (f1 < 0.5), "Performative").when(shift.isNull(), "Not tested")
        .when((shift > 0.02) & sure, "Mechanistically grounded").when(shift > 0, "Partially grounded").otherwise("Performative")
    )


#: Differences over which two groups count as unlike, in words a sentence, characters a sentence, and points of a rate.
GAPS = {"words": 5, "chars": 30, "points": 30}


def confound_verdict(rows: DataFrame, by: str, group: str, one, two) -> DataFrame:
    """(by, flags, verdict): how many of GAPS' columns differ between two groups of rows, and what that means. A group without rows differs in nothing."""
    mean = lambda c, g: F.avg(F.when(F.col(group) == g, F.col(c)))
    flags = [F.coalesce(F.abs(mean(c, one) - mean(c, two)) > most, F.lit(False)).cast("bigint") for c, most in GAPS.items()]
    out = rows.groupBy(by).agg((flags[0] + flags[1] + flags[2]).alias("flags"))
    return out.withColumn("verdict", F.when(F.col("flags") == 0, "COMPARABLE").when(F.col("flags") <= 1, "MINOR DIFFERENCES").otherwise("CONFOUNDED"))
