"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is a share of all words by its weight, held to a multiple of what it has. Each document's
expected number of copies is its source's target over its source's words; the whole part is certain and the
rest is rounded: two documents of a source meet, words move at random from one to the other until one of them
is whole, and the other goes on to meet the next. The words of the two together stay as they were, so a
source's taken words differ from its target by less than its last document.

Scale: rows are dealt by a hash into leaves of about ROWS_PER_LEAF rows, whatever their source, so a source
with most rows is spread like the rest. Equal rows share their hash; those of a row that HOT_SHARE of all rows repeat
are counted, numbered and dealt apart. A leaf leaves one unfinished document a source; these meet in a tree
of fan-in FAN, a pass over ever fewer rows each. Sources are ranked and summed in one task up to BROADCAST_SOURCES of
them, and by ranges with prefix sums beyond.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.llm._shared import bound_batches, discard, repeated_rows, returned, written

ROWS_PER_LEAF = 4096
FAN = 64
#: Parts by source into which a tree level is cut, so that very many sources don't meet in one task.
PARTS = 64
#: Source tables up to this many rows are broadcast (about 100 bytes each).
BROADCAST_SOURCES = 50_000
#: A row repeated by over this share of all rows, and more than a leaf has, is dealt apart: there are at most 1 / HOT_SHARE.
HOT_SHARE = 0.001
WORD = "[^\\x20\\x09-\\x0D]+"
EPS = 1e-9


def running(rows: DataFrame, order: list, sums: dict) -> DataFrame:
    """rows with, for each name of sums, the sum of its column over the rows before in that order; and _all of it over all rows.

    Up to BROADCAST_SOURCES rows in one task; more of them in ranges, whose totals are summed on the way.
    """
    if rows.count() <= BROADCAST_SOURCES:
        earlier = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.select("*", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(n) for n, c in sums.items()], *[F.sum(c).over(Window.partitionBy()).alias(f"{n}_all") for n, c in sums.items()])
    ranged = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    inner = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    totals = totals.select("_range", *[F.coalesce(F.sum(n).over(outer), F.lit(0)).alias(f"{n}_low") for n in sums], *[F.sum(n).over(Window.partitionBy()).alias(f"{n}_all") for n in sums])
    found = ranged.select("*", *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(n) for n, c in sums.items()]).join(F.broadcast(totals), "_range")
    for n in sums:
        found = found.withColumn(n, F.col(n) + F.col(f"{n}_low")).drop(f"{n}_low")
    return found.drop("_range")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) of rows (source, size).

    Sources by code point, null last, get the weights in turn. Targets are `share` of all sizes by weight; one
    above `most` times its source's size stops there and the rest is shared again. That ends at one level L with
    target = least(most * size, L * weight), found by running sums over sources sorted by size / weight.
    """
    each = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    each = running(each, [F.col("source").asc_nulls_last()], {"_n": F.lit(1)}).drop("_n_all")
    each = each.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int")))
    each = each.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    each = running(each, [F.col("_cap") / F.col("_w"), F.col("_n")], {"_at": F.lit(1), "_caps": F.col("_cap"), "_ws": F.col("_w"), "_sizes": F.col("source_size")})
    level = (F.col("_sizes_all") * F.lit(float(share)) - F.col("_caps")) / (F.col("_ws_all") - F.col("_ws"))
    each = written(each.withColumn("_level", level), "levels")
    fits = F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct("_at", "_level"))
    found = each.agg(F.min(fits)["_level"]).first()[0]
    return each.select("source", "source_size", (F.col("_cap") if found is None else F.least("_cap", F.lit(found) * F.col("_w"))).alias("target"))


def meet(size_a: float, x: float, size_b: float, y: float, u: float) -> tuple[float, float]:
    """The fractions of two documents after words moved from one to the other; size_a * x + size_b * y stays."""
    up = min(1 - x, y * size_b / size_a)
    down = min(x, (1 - y) * size_b / size_a)
    if u * (up + down) < down:
        x, y = (1.0, y - up * size_a / size_b) if up == 1 - x else (x + up, 0.0)
    else:
        x, y = (0.0, y + down * size_a / size_b) if down == x else (x - down, 1.0)
    near = lambda v: 0.0 if v < EPS else 1.0 if v > 1 - EPS else v
    return near(x), near(y)


def _pass(rows: DataFrame, seed: int, level: int, last: bool) -> DataFrame:
    """Rounds _rest within each _group, rows of a group being together and in order; one row a source may stay between 0 and 1 unless last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}  # source: [fraction, size, the row once its batch has gone, place in this batch]
        group, dice = None, None

        def flush(rest: np.ndarray, out: list) -> None:
            for fraction, _, row, place in held.values():
                if last:
                    fraction = 1.0 if dice.random() < fraction else 0.0
                if row is None:
                    rest[place] = fraction
                else:
                    out.append(_with(row, [fraction]))
            held.clear()

        def _with(part: pa.RecordBatch, rest) -> pa.RecordBatch:
            return part.set_column(part.schema.get_field_index("_rest"), "_rest", pa.array(rest, pa.float64()))

        for batch in batches:
            groups, sources = batch.column("_group").to_pylist(), batch.column("_source").to_pylist()
            sizes = batch.column("_size").to_pylist()
            rest = batch.column("_rest").to_numpy(zero_copy_only=False).copy()
            out: list = []
            for k, (g, s, size) in enumerate(zip(groups, sources, sizes)):
                if g != group:
                    flush(rest, out)
                    group, dice = g, np.random.default_rng([seed, level, g])
                x = float(rest[k])
                if x <= 0.0 or x >= 1.0:
                    continue
                if size <= 0:
                    rest[k] = 1.0 if dice.random() < x else 0.0
                    continue
                if (other := held.pop(s, None)) is None:
                    held[s] = [x, float(size), None, k]
                    continue
                was, x = meet(other[1], other[0], float(size), x, dice.random())
                rest[k] = x
                stays = was if 0.0 < was < 1.0 else None
                if 0.0 < x < 1.0:
                    held[s] = [x, float(size), None, k]
                elif stays is not None:
                    held[s] = [was, *other[1:]]
                    continue
                if other[2] is None:
                    rest[other[3]] = was
                else:
                    out.append(_with(other[2], [was]))
            waiting = sorted(v[3] for v in held.values() if v[2] is None)
            for v in held.values():
                if v[2] is None:
                    v[2] = batch.slice(v[3], 1)
            stay = np.ones(batch.num_rows, bool)
            stay[waiting] = False
            whole = _with(batch, rest)
            yield whole if not waiting else whole.filter(pa.array(stay))
            yield from out
        if held:
            out = []
            flush(np.empty(0), out)
            yield from out

    order = ["_group", *[c for c in ("_key", "_size", "_source") if c in rows.columns]]
    return rows.repartition("_group").sortWithinPartitions(*order).mapInArrow(returned(run), rows.schema)


def _keyed(docs: DataFrame, counted: Column, source: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """(_row, _size, _source, _key, _copy): rows of docs in a struct, so that no name of theirs meets another. And (_source, _key, _n, _words): how many rows share a key, and their words.

    _copy numbers the repetitions of a row that HOT_SHARE of all rows repeat, in stretches of ROWS_PER_LEAF; 0 elsewhere.
    """
    maps = "map<" in docs.schema.simpleString()  # can be neither hashed nor grouped
    key = F.xxhash64(F.lit(seed), *[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), counted.cast("bigint").alias("_size"), F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n")).alias("_source"), key.alias("_key"))
    tally = written(rows.groupBy("_source", "_key").agg(F.count("*").alias("_n"), F.sum("_size").alias("_words")), "tally")
    numbered = rows.withColumn("_copy", F.lit(0).cast("bigint"))
    total = tally.agg(F.sum("_n")).first()[0] or 0
    hot = tally.where(F.col("_n") > max(ROWS_PER_LEAF, HOT_SHARE * total)).select("_key").distinct()
    if maps or hot.isEmpty():
        return numbered, tally
    hot = F.broadcast(hot)
    once = rows.join(hot, "_key", "left_semi").groupBy("_row", "_size", "_source", "_key").agg(F.count("*").alias("_n"))
    apart = repeated_rows(written(once, "hot"), "_n", "_copy").withColumn("_copy", F.floor(F.col("_copy") / ROWS_PER_LEAF))
    return numbered.join(hot, "_key", "left_anti").unionByName(apart.select(*numbered.columns)), tally


def mix(docs: DataFrame, source: str = "source", size: str | None = None, text: str = "text", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """docs with size, source_size, target and copies added as _size, _source_size, _target and _copies.

    size: a column of sizes; without one, the words of the text count. Nulls: a null text has size 0, a null
    source is a source of its own. A document of size 0 is rounded by itself, since it carries no words.
    Equal rows are rounded apart. The result depends on rows and seed alone: not on partitions, nor on their order.
    Columns of docs that are named like the four added ones give way to them; all others stay, whatever their names.
    """
    return _mixed(docs, source, size, text, weights, share, most, seed).select(*[F.col(f"_row.`{c}`") for c in docs.columns if c.lower() not in ADDED], *ADDED)


ADDED = ("_size", "_source_size", "_target", "_copies")


def _mixed(docs: DataFrame, source: str, size: str | None, text: str, weights: tuple[float, ...], share: float, most: float, seed: int) -> DataFrame:
    bound_batches(docs.sparkSession)
    counted = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)) if size is None else F.coalesce(F.col(size), F.lit(0))
    rows, tally = _keyed(docs, counted, source, seed)
    name = F.when(F.col("_source") != "n", F.substring("_source", 2, 1 << 30))
    sizes = written(tally.groupBy(name.alias("source")).agg(F.sum("_words").alias("size"), F.sum("_n").alias("n")), "sizes")
    targets = source_targets(sizes, weights, share, most)
    targets = written(targets.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target")), "targets")
    total, sources = sizes.agg(F.sum("n"), F.count("*")).first()
    leaves = max(1, math.ceil((total or 0) / ROWS_PER_LEAF))
    if sources <= BROADCAST_SOURCES:
        rows = rows.join(F.broadcast(targets), "_source")
    else:  # a copy of each target for each part of a source, so that a large source is spread
        parts = targets.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        rows = rows.withColumn("_part", F.pmod(F.xxhash64("_key", "_copy"), F.lit(PARTS)).cast("int")).join(parts, ["_source", "_part"]).drop("_part")
    expected = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)
    expected = F.when(F.abs(expected - F.round(expected)) < EPS, F.round(expected)).otherwise(expected)
    rows = rows.withColumn("_copies", F.floor(expected).cast("int")).withColumn("_rest", expected - F.floor(expected)).withColumn("_leaf", F.pmod(F.xxhash64(F.lit(seed + 1), "_key", "_copy"), F.lit(leaves)))
    rows = rows.withColumn("_group", F.col("_leaf"))
    done, level = [], 0
    while True:
        rounded = written(_pass(rows, seed, level, leaves == 1), "mix")
        if leaves == 1:
            done.append(rounded)
            break
        open_ = (F.col("_rest") > 0) & (F.col("_rest") < 1)
        done.append(rounded.where(~open_))
        leaves, level = math.ceil(leaves / FAN), level + 1
        node = F.floor(F.col("_leaf") / FAN).cast("bigint")
        rows = rounded.where(open_).withColumn("_leaf", node).withColumn("_group", node * PARTS + F.pmod(F.xxhash64("_source"), F.lit(PARTS)))
    discard(tally, sizes, targets)
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole.withColumn("_copies", F.col("_copies") + F.col("_rest").cast("int"))


def repeated(docs: DataFrame, source: str = "source", size: str | None = None, text: str = "text", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """The mix itself: each row of docs as often as mix() takes it, with the columns of docs and no others, whatever their names."""
    mixed = _mixed(docs, source, size, text, weights, share, most, seed).where("_copies > 0")
    return mixed.withColumn("_k", F.explode(F.sequence(F.lit(1), "_copies"))).select("_row.*")
