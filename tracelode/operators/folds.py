"""Folds that keep groups whole and label counts level.

Groups are dealt one by one, the most uneven first, each to the fold where labels are then spread most evenly. That is
sequential, so groups are cut into blocks of a bounded size by a hash, blocks are dealt apart, and a block's folds are
then matched to those of other blocks in the same way, by a tree of fixed fan-in. What a task holds is a block's counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups of a block, and blocks whose folds one task matches.
BLOCK, FAN_IN = 20_000, 64
#: Places to which spreads are compared, so that ties don't hang on the order of additions.
PLACES = 9


def dealt(counts: np.ndarray, totals: np.ndarray, folds: int, apart: np.ndarray | None = None) -> np.ndarray:
    """The fold of each row of counts (rows x labels), in order of rows.

    A row goes where the mean over labels of the deviation between folds, in shares of `totals`, is then least; of equals,
    to the fold with fewest, then the first. Rows of the same number in `apart` go to folds of their own.
    """
    share = counts / np.maximum(totals, 1)
    held, size = np.zeros((folds, counts.shape[1])), np.zeros(folds)
    given = np.zeros(len(counts), dtype=np.int64)
    taken: dict[int, set] = {}
    for i, x in enumerate(share):
        held_sq, mean = (held * held).sum(axis=0), (held.sum(axis=0) + x) / folds
        squares = held_sq + 2 * held * x + x * x
        spread = np.sqrt(np.maximum(squares / folds - mean * mean, 0)).mean(axis=1).round(PLACES)
        free = [f for f in range(folds) if apart is None or f not in taken.setdefault(int(apart[i]), set())]
        best = min(free, key=lambda f: (spread[f], size[f], f))
        given[i] = best
        held[best] += x
        size[best] += counts[i].sum()
        if apart is not None:
            taken[int(apart[i])].add(best)
    return given


def _level(summary: DataFrame, key: str, key_type: str, folds: int, labels: list, apart: bool) -> DataFrame:
    """(block, key, fold, counts): rows of each block dealt in order of their counts' deviation."""

    def deal(part: pd.DataFrame) -> pd.DataFrame:
        counts = np.array(part["counts"].tolist(), dtype=np.float64).reshape(len(part), len(labels))
        part = part.assign(spread=counts.std(axis=1).round(PLACES))
        if apart:  # the folds of a block together, blocks in the order of their numbers
            order = part.sort_values(["of", "spread", "tie"], ascending=[True, False, True]).index
        else:
            order = part.sort_values(["spread", "tie"], ascending=[False, True]).index
        part, counts = part.loc[order], counts[part.index.get_indexer(order)]
        fold = dealt(counts, counts.sum(axis=0), folds, part["of"].to_numpy() if apart else None)
        return pd.DataFrame({"block": part["block"], key: part[key], "fold": fold, "counts": [c.astype(np.int64).tolist() for c in counts]})

    return summary.groupBy("block").applyInPandas(deal, f"block bigint, {key} {key_type}, fold bigint, counts array<bigint>")


def balanced_folds(rows: DataFrame, group: str, label: str, folds: int = 5, block: int = BLOCK) -> DataFrame:
    """(group, fold): each group in one fold of 0 to folds - 1, the counts of every label as even between folds as dealing makes them.

    Rows without a group are left out; a null label is a label of its own. Groups of equal counts are told apart by a hash, so
    a rerun agrees. Labels are few: a task holds their counts for a block of groups. No row, no fold.
    """
    from tracelode.sources.files import work_folder  # sources import operators

    spark = rows.sparkSession
    named = rows.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(label).alias("l"))
    labels = [r.l for r in named.select("l").distinct().sort("l").collect()]  # few, by contract
    if not labels:
        return named.select(F.col("g").alias(group), F.lit(0).cast("bigint").alias("fold")).limit(0)
    each = [F.count_if(F.col("l").eqNullSafe(F.lit(x))) for x in labels]
    counts = named.groupBy("g").agg(F.array(*each).alias("counts")).withColumn("tie", F.md5(F.col("g").cast("string")))

    def written(part: DataFrame) -> DataFrame:
        folder = work_folder(spark, "folds")
        part.write.parquet(folder)
        return spark.read.schema(part.schema).parquet(folder)

    counts = written(counts)
    blocks = max(1, -(-counts.count() // block))
    summary = counts.withColumn("block", F.pmod(F.xxhash64("tie"), F.lit(blocks)))
    given = written(_level(summary, "g", counts.schema["g"].dataType.simpleString(), folds, labels, False))
    found = given.select("g", "block", "fold")
    while blocks > 1:
        parts = given.select("block", "fold", F.posexplode("counts").alias("i", "n")).groupBy("block", "fold", "i").agg(F.sum("n").alias("n"))
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "n"))), lambda s: s["n"])  # an entry a label
        sums = parts.groupBy("block", "fold").agg(ordered.alias("counts"))
        key = F.col("block") * folds + F.col("fold")
        up = sums.select(F.floor(F.col("block") / FAN_IN).alias("block"), key.alias("key"), F.col("block").alias("of"), F.format_string("%012d", key).alias("tie"), "counts")
        given = written(_level(up, "key", "bigint", folds, labels, True))
        up = given.select(F.col("key").alias("_key"), F.col("block").alias("_block"), F.col("fold").alias("_fold"))
        # `folds` rows a block.
        found = found.withColumn("_key", F.col("block") * folds + F.col("fold")).join(up, "_key").select("g", F.col("_block").alias("block"), F.col("_fold").alias("fold"))
        blocks = -(-blocks // FAN_IN)
    return found.select(F.col("g").alias(group), "fold")
