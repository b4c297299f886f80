"""Exact quantiles of many groups at once, without a buffer of a group's values.

Rows are first counted by group and value, a thin table in the shared folder that everything below reads, so that rows are
computed once. Groups of up to `small` distinct values are ranked by a window over those counts. A larger group is cut into
ranges by a mergeable sketch of its values; ranges are counted map-side, and only those that hold a wanted rank are cut
again, until each has at most `small` values. The sketch decides where ranges lie and never what is returned, so its error
costs at most another round. A bound between ranges is a range of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distinct values that one window may sort, and ranges a large group is cut into in a round.
SMALL, RANGES = 1_000_000, 64
#: Spans to be cut that are sent to all workers; more of them are joined by key.
MOST_SENT = 100_000


def _ranks(shares: list[float]) -> Column:
    """The ranks, from 1, that the quantiles of n values lie at or between."""
    place = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    return F.array_sort(F.array_distinct(F.array(*[(f(place(p)) + 1).cast("bigint") for p in shares for f in (F.floor, F.ceil)])))


def _holds(ranks: Column, below: Column, n: Column) -> Column:
    return F.filter(ranks, lambda r: (r > below) & (r <= below + n))


def _inside(cells: DataFrame, spans: DataFrame, sent: bool) -> DataFrame:
    """(k, lo, v, m): counts in the spans (k, lo, hi). Spans of a group don't overlap and are at most two a share."""
    named = spans.select(F.col("k").alias("_k"), "lo", "hi")
    met = F.col("k").eqNullSafe(F.col("_k")) & F.col("v").between(F.col("lo"), F.col("hi"))
    return cells.join(F.broadcast(named) if sent else named, met).select("k", "lo", "v", "m")


def _cut(cells: DataFrame, large: DataFrame, ranges: int, sent: bool) -> DataFrame:
    """The ranges (k, lo, hi, n, c, below, ranks) of large spans that hold one of their ranks."""
    inside = _inside(cells, large, sent)
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    bounds = inside.groupBy("k", "lo").agg(F.array_distinct(F.percentile_approx("v", shares, 1000)).alias("bounds"))
    about = large.select(F.col("k").alias("_k"), F.col("lo").alias("_lo"), F.col("below").alias("_below"), "ranks")
    known = bounds.join(about, F.col("k").eqNullSafe(F.col("_k")) & (F.col("lo") == F.col("_lo"))).select("_k", "_lo", "_below", "ranks", "bounds")
    # Odd parts are single bounds, even ones lie between two.
    part = 2 * F.size(F.filter("bounds", lambda b: b < F.col("v"))) + F.array_contains("bounds", F.col("v")).cast("int")
    on = F.col("k").eqNullSafe(F.col("_k")) & (F.col("lo") == F.col("_lo"))
    parts = inside.join(F.broadcast(known) if sent else known, on).withColumn("part", part)
    counts = parts.groupBy("k", "_lo", "part").agg(F.sum("m").alias("n"), F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.first("_below").alias("_below"), F.first("ranks").alias("ranks"))
    before = F.sum("n").over(Window.partitionBy("k", "_lo").orderBy("part")) - F.col("n") + F.col("_below")
    return counts.withColumn("below", before).where(F.size(_holds(F.col("ranks"), F.col("below"), F.col("n"))) > 0).select("k", "lo", "hi", "n", "c", "below", "ranks")


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float], small: int = SMALL, ranges: int = RANGES) -> DataFrame:
    """(keys, n, mean, least, most, q): counts, means, extremes and the quantiles at `shares`, between two ranks on the line that joins them.

    value is a number and counts as double; nulls are left out, a NaN is the greatest of values. A null in a key is a group
    like any other; a group of nulls alone has no row. Without keys there is one group. No row, no group. Keys are named
    otherwise than the five results.
    """
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))
    data = rows.select(key.alias("k"), (F.col(value).cast("double") + F.lit(0.0)).alias("v")).where(F.col("v").isNotNull())
    cells = _written(data.groupBy("k", "v").agg(F.count("*").alias("m")), "values")
    cut = None
    # Fewer values than one window may sort have no group that is too large.
    if cells.count() > small:
        whole = cells.groupBy("k").agg(F.sum("m").alias("n"), F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        large = whole.where(F.col("c") > small)
        spans = large.select("k", "lo", "hi", "n", "c", F.lit(0).cast("bigint").alias("below"), _ranks(shares).alias("ranks"))
        too_large = (F.col("c") > small) & (F.col("lo") < F.col("hi"))
        while True:
            spans = _written(spans, "ranges")
            n_open = spans.where(too_large).count()
            if not n_open:
                break
            spans = spans.where(~too_large).unionByName(_cut(cells, spans.where(too_large), ranges, n_open <= MOST_SENT))
        n_spans = spans.count()
        if n_spans:
            cut = spans, spans.select(F.col("k").alias("_k")).distinct(), n_spans <= MOST_SENT

    def found(cells: DataFrame, by: list[str]) -> DataFrame:
        """(k, rank, v) of the cells (k, v, m, below, ranks) that hold wanted ranks."""
        upto = F.sum("m").over(Window.partitionBy(*by).orderBy("v")) + F.col("below")
        at = cells.withColumn("upto", upto)
        return at.select("k", F.explode(_holds(F.col("ranks"), F.col("upto") - F.col("m"), F.col("m"))).alias("rank"), "v")

    rest = cells if cut is None else cells.join(F.broadcast(cut[1]) if cut[2] else cut[1], F.col("k").eqNullSafe(F.col("_k")), "left_anti")
    of_group = Window.partitionBy("k")
    counted = rest.withColumn("n", F.sum("m").over(of_group)).withColumn("below", F.lit(0).cast("bigint")).withColumn("ranks", _ranks(shares))
    hits = found(counted, ["k"])
    if cut is not None:
        spans, _, sent = cut
        some = spans.where("lo < hi")
        here = _inside(cells, some, sent)
        about = some.select(F.col("k").alias("_k"), F.col("lo").alias("_lo"), "below", "ranks")
        here = here.join(about, F.col("k").eqNullSafe(F.col("_k")) & (F.col("lo") == F.col("_lo"))).select("k", "lo", "v", "m", "below", "ranks")
        alone = spans.where("lo = hi").select("k", F.explode(_holds(F.col("ranks"), F.col("below"), F.col("n"))).alias("rank"), F.col("lo").alias("v"))
        hits = hits.unionByName(found(here, ["k", "lo"])).unionByName(alone)
    # At most two values a share.
    named = hits.groupBy("k").agg(F.map_from_entries(F.collect_set(F.struct("rank", "v"))).alias("at")).withColumnRenamed("k", "_k")
    sums = cells.groupBy("k").agg(F.sum("m").alias("n"), (F.sum(F.col("v") * F.col("m")) / F.sum("m")).alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"))

    def between(p: float) -> Column:
        place = F.lit(float(p)) * (F.col("n") - 1)
        low, high = (F.element_at("at", (f(place) + 1).cast("bigint")) for f in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise(low + (high - low) * (place - F.floor(place)))

    out = sums.join(named, F.col("k").eqNullSafe(F.col("_k"))).withColumn("q", F.array(*[between(p) for p in shares]))
    return out.select(*([F.col("k")[i].alias(i) for i in keys]), "n", "mean", "least", "most", "q")


def _written(rows: DataFrame, tag: str) -> DataFrame:
    """rows as a table in the shared folder, so that their lineage ends there."""
    from tracelode.sources.files import work_folder  # sources import operators

    spark = rows.sparkSession
    folder = work_folder(spark, tag)
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)
