"""Cleaning of segmented sentences (trace, sid, text, tokens): merges, tails, splits, numbering. One shuffle by trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from tracelode.functions import text as T


def trace_order() -> WindowSpec:
    return Window.partitionBy("trace").orderBy("sid")


def merge_target(odd: Column, least: int = 0) -> Column:
    """The sid that a row joins: its own, or for odd rows the next other row's, or the previous one's at the end of a trace."""
    after = F.first(F.when(~odd, F.col("sid")), ignorenulls=True).over(trace_order().rowsBetween(0, Window.unboundedFollowing))
    before = F.last(F.when(~odd, F.col("sid")), ignorenulls=True).over(trace_order().rowsBetween(Window.unboundedPreceding, 0))
    size = F.count("*").over(Window.partitionBy("trace"))
    return F.when(size < least, F.col("sid")).otherwise(F.coalesce(after, before, F.col("sid")))


def merge_into_neighbours(rows: DataFrame, odd: Column, least: int = 0) -> DataFrame:
    """Rows for which `odd` holds join the next other row, or the previous one at the end of a trace.

    Texts are joined by spaces in order, tokens added. A trace of odd rows only, or of fewer than `least` rows, stays.
    """
    marked = rows.withColumn("target", merge_target(odd, least))
    ordered = F.array_sort(F.collect_list(F.struct("sid", "text")))
    found = marked.groupBy("trace", F.col("target").alias("sid")).agg(F.array_join(F.transform(ordered, lambda s: s["text"]), " ").alias("text"), F.sum("tokens").cast("bigint").alias("tokens"), F.count("*").alias("merged"))
    return found


def merge_fragments(rows: DataFrame, least: int = 0) -> DataFrame:
    return merge_into_neighbours(rows, T.is_fragment(F.col("text"), F.col("tokens")), least)


def merge_without_content(rows: DataFrame) -> DataFrame:
    return merge_into_neighbours(rows, ~F.col("text").rlike("[A-Za-z0-9]"))


def drop_cut_off_tail(rows: DataFrame, answered: Column, most: int = 10, longest: int | None = None) -> DataFrame:
    """Without the last rows, at most `most`, that all look cut off; traces with an answer stay whole."""
    back = Window.partitionBy("trace").orderBy(F.desc("sid"))
    cut = T.is_cut_off(F.col("text"), F.col("tokens"), longest)
    marked = rows.withColumn("_run", F.min(cut.cast("int")).over(back.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_k", F.row_number().over(back))
    return marked.where(~((F.col("_run") == 1) & (F.col("_k") <= most) & ~answered)).drop("_run", "_k")


def renumber(rows: DataFrame) -> DataFrame:
    """old_sid and a dense sid from 0."""
    return rows.withColumn("new_sid", F.row_number().over(trace_order()) - 1).withColumnRenamed("sid", "old_sid").withColumnRenamed("new_sid", "sid")


def split_oversized(rows: DataFrame, most: int = 100) -> DataFrame:
    """Rows of more than `most` tokens in parts at blank lines, or at line ends if they have none; part counts from 0."""
    mark = F.when(F.instr("text", "\n\n") > 0, F.split("text", "\n\n")).otherwise(F.split("text", "\n"))
    parts = F.filter(F.when(F.col("tokens") > most, mark).otherwise(F.array("text")), lambda p: T.stripped(p) != "")
    out = rows.select("trace", "sid", F.posexplode(parts).alias("part", "text"))
    return out.withColumn("tokens", T.word_count(F.col("text")).cast("bigint"))


def manual_merges(rows: DataFrame, spec: DataFrame) -> DataFrame:
    """spec (trace, source, target): sources join their targets, in order of sid. Broadcast: a hand-written table."""
    moved = rows.join(F.broadcast(spec.withColumnRenamed("source", "sid")), ["trace", "sid"], "left").withColumn("target", F.coalesce("target", "sid"))
    ordered = F.array_sort(F.collect_list(F.struct("sid", "text")))
    return moved.groupBy("trace", F.col("target").alias("sid")).agg(F.array_join(F.transform(ordered, lambda s: s["text"]), " ").alias("text"), F.sum("tokens").cast("bigint").alias("tokens"))


def id_map(before: DataFrame, after: DataFrame) -> DataFrame:
    """(trace, id_mapping): old sid to new, -1 for rows that went. after: old_sid, sid."""
    both = before.select("trace", F.col("sid").alias("old_sid")).join(after.select("trace", "old_sid", "sid"), ["trace", "old_sid"], "left")
    entries = F.collect_list(F.struct(F.col("old_sid").cast("string"), F.coalesce("sid", F.lit(-1)).cast("int")))
    return both.groupBy("trace").agg(F.map_from_entries(F.array_sort(entries)).alias("id_mapping"))


#: Sentences of two traces that are merged by hand, (trace, sources, target, what is split off again).
MANUAL = [
    ("set_a/task4/trace_008", [206, 207, 208, 209], 210, None),
    ("set_a/task4/trace_008", [230, 231, 232, 233, 234], 235, None),
    ("set_b/task3/trace_012", [108, 109], 107, "Not seeing a pattern."),
]


def manual_spec(spark: SparkSession) -> DataFrame:
    """(trace_key, source, target, split_off) of MANUAL: one row a source."""
    rows = [(key, source, target, tail) for key, sources, target, tail in MANUAL for source in sources]
    return spark.createDataFrame(rows, "trace_key string, source bigint, target bigint, split_off string")


def manual_merges_split(rows: DataFrame, spec: DataFrame) -> DataFrame:
    """manual_merges() of spec (trace, source, target, split_off); a merged text that ends with split_off gives it up as a part of its own.

    (trace, sid, part, text, tokens): part 1 is what was split off, after its sentence.
    """
    merged = manual_merges(rows, spec.drop("split_off"))
    tails = spec.where("split_off IS NOT NULL").select("trace", F.col("target").alias("sid"), "split_off").distinct()
    marked = merged.join(F.broadcast(tails), ["trace", "sid"], "left").withColumn("cut", F.coalesce(F.endswith("text", "split_off"), F.lit(False)))
    words = T.word_count(F.col("split_off")).cast("bigint")
    head = F.rtrim(F.substr("text", F.lit(1), F.length("text") - F.length("split_off")))
    whole = marked.select("trace", "sid", F.lit(0).cast("bigint").alias("part"), F.when(F.col("cut"), head).otherwise(F.col("text")).alias("text"), F.when(F.col("cut"), F.col("tokens") - words).otherwise(F.col("tokens")).alias("tokens"))
    return whole.unionByName(marked.where("cut").select("trace", "sid", F.lit(1).cast("bigint").alias("part"), F.col("split_off").alias("text"), words.alias("tokens")))


def lineage(rows: DataFrame, answered: Column, most: int = 10) -> DataFrame:
    """(trace, old_sid, target, new_sid) of rows (trace, sid, text, tokens, completed) through fragment merges, tail removal and renumbering; -1 for what went."""
    target = merge_target(T.is_fragment(F.col("text"), F.col("tokens")))
    placed = rows.select("trace", F.col("sid").alias("old_sid"), target.alias("target"))
    after = renumber(_cleaned(rows, answered, most)).select("trace", F.col("old_sid").alias("target"), F.col("sid").cast("bigint").alias("new"))
    return placed.join(after, ["trace", "target"], "left").select("trace", "old_sid", "target", F.coalesce("new", F.lit(-1)).cast("bigint").alias("new_sid"))


def _cleaned(rows: DataFrame, answered: Column, most: int) -> DataFrame:
    merged = merge_fragments(rows).join(rows.groupBy("trace").agg(F.first("completed").alias("completed")), "trace")
    return drop_cut_off_tail(merged, answered, most)


def actions(rows: DataFrame, answered: Column, most: int = 10) -> DataFrame:
    """(trace, old_sid, new_sid, action, reason, preview): what cleaning did to each row it merged or removed, with ids resolved."""
    one_line = lambda n: F.left(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(n))
    back = F.when(F.col("target") < F.col("old_sid"), "_to_prev").otherwise("")
    moved = lineage(rows, answered, most).where("target <> old_sid").join(rows.withColumnRenamed("sid", "old_sid"), ["trace", "old_sid"])
    moved = moved.select("trace", "old_sid", "new_sid", F.lit("fragment_merge").alias("action"), F.concat(T.fragment_kind(F.col("text")), back).alias("reason"), one_line(40).alias("preview"))
    merged = merge_fragments(rows).join(rows.groupBy("trace").agg(F.first("completed").alias("completed")), "trace")
    gone = merged.join(drop_cut_off_tail(merged, answered, most).select("trace", "sid"), ["trace", "sid"], "left_anti")
    gone = gone.select("trace", F.col("sid").alias("old_sid"), F.lit(-1).cast("bigint").alias("new_sid"), F.lit("truncation_removal").alias("action"), T.cut_off_reason(F.col("text"), F.col("tokens")).alias("reason"), one_line(60).alias("preview"))
    return moved.unionByName(gone)
