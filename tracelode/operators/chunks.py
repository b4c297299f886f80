"""Sequence operators over traces of any length: a trace is cut into chunks, so that a hot trace is the work of many tasks.

A rule that looks a bounded number of rows back or ahead works in a chunk that also has the rows around it (its halo);
the operators of `sequence` see a chunk as a trace. Runs are found in each chunk, and only those that touch an end of a
chunk, at most two a chunk, meet again by trace. Results equal those of the one-window forms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelode.operators import sequence as Q

#: Rows of a chunk.
SIZE = 4096


def positions(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """rows (trace, sid, ...) with _pos, the place in the trace from 0 on.

    Places are counted within stretches of sids; what comes before a stretch is a sum over the trace's stretches, a row
    for each `size` sids. sid is unique in a trace and may have gaps; a null trace is a trace of its own.
    """
    key = F.struct("trace", F.floor(F.col("sid") / size).alias("stretch"))
    parted = rows.withColumn("_part", key)
    own = F.row_number().over(Window.partitionBy("_part").orderBy("sid")) - 1
    earlier = Window.partitionBy("_of").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = parted.groupBy("_part").agg(F.count("*").alias("_k"))
    before = totals.select(F.col("_part").alias("_there"), F.col("_part.trace").alias("_of"), F.col("_part.stretch").alias("_stretch"), "_k").select("_there", F.coalesce(F.sum("_k").over(earlier), F.lit(0)).alias("_before"))
    met = parted.withColumn("_own", own).join(before, F.col("_part").eqNullSafe(F.col("_there")))
    return met.withColumn("_pos", F.col("_own") + F.col("_before")).drop("_part", "_there", "_own", "_before")


def _placed(rows: DataFrame, size: int, dense: bool) -> DataFrame:
    return rows.withColumn("_pos", F.col("sid")) if dense else positions(rows, size)


def by_chunks(rows: DataFrame, of: Callable[[DataFrame], DataFrame], back: int = 0, ahead: int = 0, size: int = SIZE, dense: bool = False) -> DataFrame:
    """of(rows), where `of` adds columns to rows of a trace from at most `back` rows before and `ahead` rows after each.

    dense: sids count from 0 on without a gap, so that they are the places.
    """
    if max(back, ahead) > size:
        raise ValueError("a halo is not longer than a chunk")
    placed = _placed(rows, size, dense)
    own, at = F.floor(F.col("_pos") / size), F.col("_pos") % size
    here = F.array(own)
    later = F.when(at >= size - back, F.array(own + 1)).otherwise(F.array().cast("array<bigint>"))
    sooner = F.when((at < ahead) & (own > 0), F.array(own - 1)).otherwise(F.array().cast("array<bigint>"))
    parts = placed.withColumn("_chunk", F.explode(F.concat(here, later, sooner))).withColumn("_own", F.col("_chunk") == own)
    found = of(parts.withColumn("trace", F.struct("trace", "_chunk")))
    return found.where("_own").withColumn("trace", F.col("trace.trace")).drop("_pos", "_chunk", "_own")


def dependencies(rows: DataFrame, window: int = 20, hypo: int = 35, rule: int = 50, size: int = SIZE, dense: bool = False) -> DataFrame:
    """As sequence.dependencies, in chunks."""
    return by_chunks(rows, lambda part: Q.dependencies(part, window, hypo, rule), max(window, hypo, rule, 1), 0, size, dense)


def repetition_ratio(rows: DataFrame, n: int = 4, size: int = SIZE, dense: bool = False) -> DataFrame:
    """As sequence.repetition_ratio, in chunks: (trace, ratio). Counts of kinds combine before they are shuffled."""

    def grams(part: DataFrame) -> DataFrame:
        ahead = [F.lead("label", k).over(Q.trace_order()) for k in range(n)]
        return part.withColumn("gram", F.when(ahead[-1].isNotNull(), F.concat_ws(">", *ahead)))

    kinds = by_chunks(rows.select("trace", "sid", "label"), grams, 0, n - 1, size, dense).groupBy("trace", "gram").agg(F.count("gram").alias("k"))
    counted = kinds.groupBy("trace").agg(F.sum("k").alias("grams"), F.count("gram").alias("kinds"))
    return counted.select("trace", F.coalesce(F.try_divide(F.col("grams") - F.col("kinds"), F.col("grams")), F.lit(0.0)).alias("ratio"))


def runs(rows: DataFrame, least: int = 1, size: int = SIZE, dense: bool = False) -> DataFrame:
    """(trace, label, first_sid, length) of maximal runs of a label with at least `least` rows.

    Rows without a label are left out first, so the rows around them are neighbours.
    """
    coded = rows.where(F.col("label").isNotNull()).select("trace", "sid", "label")
    # With rows left out, dense sids have gaps.
    placed = positions(coded, size)
    cut = placed.select(F.struct("trace", F.floor(F.col("_pos") / size).alias("chunk")).alias("trace"), F.struct(F.col("_pos").alias("pos"), "sid").alias("sid"), "label")
    pieces = Q.runs(cut).select("trace.trace", "trace.chunk", "label", "first_sid.pos", "first_sid.sid", "length")
    # Pieces at an end of a chunk meet under their trace, others stay with their chunk.
    at_end = (F.col("pos") % size == 0) | ((F.col("pos") + F.col("length")) % size == 0)
    meeting = pieces.withColumn("where", F.when(at_end, -1).otherwise(F.col("chunk")))
    order = Window.partitionBy("trace", "where").orderBy("pos")
    goes_on = (F.lag("label").over(order) == F.col("label")) & (F.lag(F.col("pos") + F.col("length")).over(order) == F.col("pos"))
    islands = meeting.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("island", F.sum("new").over(order))
    found = islands.groupBy("trace", "where", "island").agg(F.first("label").alias("label"), F.min_by("sid", "pos").alias("first_sid"), F.sum("length").alias("length"))
    return found.where(F.col("length") >= least).select("trace", "label", "first_sid", "length")


def longest_run(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """(trace, label, length): of each trace's longest run, the first one if several are."""
    return runs(rows, 1, size).groupBy("trace").agg(F.max_by("label", F.struct("length", -F.col("first_sid"))).alias("label"), F.max("length").alias("length"))
