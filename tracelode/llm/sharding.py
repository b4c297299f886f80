"""Shards that each hold the sources in the mixture of the whole: proportional stratified interleaving.

Rows of a source are put in a seeded order and ranked; sorting all rows by fractional rank (rank - 1 + phase) / rows
of the source interleaves the sources in proportion, and equal cuts of that order are the shards. The phase is a
source's own hash in (0, 1): with one phase for all, the only rows of very many small sources would come together.

Scale: only ids, sources and two numbers of a text are shuffled. Ranks come from buckets of the seeded hash and
then of the fractional rank, each of about ROWS_PER_BUCKET rows: the hash takes in id, checksum, size and the number
of a repeated row among its like, so no id or row fills a bucket, and the phases spread small sources. Bases of
buckets are prefix sums over their counts, in two levels. No window spans a source or the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelode.llm._shared import before, discard, repeated_rows, written

ROWS_PER_BUCKET = 8_192
HASH_BITS = 60


def seeded_hash(seed: int, *columns, bits: int = HASH_BITS):
    """The first `bits` bits (a multiple of 4) of MD5 over the seed and the columns as text: even, and the same in any SQL engine."""
    joined = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(joined), 1, bits // 4), 16, 10).cast("bigint")


def stratified_shards(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 11, overhead: int = 16) -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot): one row for each row of docs.

    Shards' row counts differ by one at most, the larger ones first; slots count from 0 in the interleaved order.
    size: UTF-8 bytes of the text plus `overhead`. Nulls: a null text is empty, a null source is a source of its
    own, a null doc_id sorts first. Rows that are alike in all of these are counted, numbered and placed apart. An
    empty table gives no row; with fewer rows than shards the last shards stay empty. Other columns of docs, whatever
    their names, are not touched.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), (F.octet_length(raw) + overhead).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"))
    counted = written(rows.groupBy("doc_id", "source", "size", "text_crc32").agg(F.count("*").alias("_n")), "shard-rows")
    total = counted.agg(F.sum("_n")).first()[0] or 0
    bits = max(0, (total // ROWS_PER_BUCKET).bit_length())
    rows = repeated_rows(counted, "_n", "_copy").withColumn("_s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    rows = rows.withColumn("_h", seeded_hash(seed, F.col("doc_id"), F.col("text_crc32"), F.col("size"), F.col("_copy"))).withColumn("_b", F.shiftright("_h", HASH_BITS - bits))
    counts = rows.groupBy("_s", "_b").agg(F.count("*").alias("_n"))
    sizes = counts.groupBy("_s").agg(F.sum("_n").alias("_all"))
    counts = before(counts, "_b", "_n", ("_s",)).drop("_n").join(sizes, "_s")
    in_bucket = Window.partitionBy("_s", "_b").orderBy("_h", "doc_id", "text_crc32", "size", "_copy")
    phase = (seeded_hash(seed, F.col("_s"), bits=52) + F.lit(0.5)) / F.lit(float(1 << 52))
    ranked = rows.join(counts, ["_s", "_b"]).withColumn("_rank", F.row_number().over(in_bucket) + F.col("_base"))
    ranked = ranked.withColumn("_f", (F.col("_rank") - 1 + phase) / F.col("_all")).withColumn("_c", F.floor(F.col("_f") * (1 << bits)))
    ranked = written(ranked.select("doc_id", "source", "size", "text_crc32", "_s", "_f", "_c"), "shard-ranks")
    discard(counted)
    bases = before(ranked.groupBy("_c").agg(F.count("*").alias("_n")), "_c", "_n").drop("_n")
    place = F.row_number().over(Window.partitionBy("_c").orderBy("_f", "_s")) + F.col("_base") - 1
    placed = ranked.join(bases, "_c").withColumn("_p", place)
    least, larger = divmod(total, shards)
    edge = larger * (least + 1)
    shard = F.when(F.col("_p") < edge, F.floor(F.col("_p") / (least + 1))).otherwise(larger + F.floor((F.col("_p") - edge) / max(least, 1)))
    start = F.col("shard") * least + F.least("shard", F.lit(larger))
    placed = placed.withColumn("shard", shard.cast("int"))
    return placed.select("doc_id", "source", "size", "text_crc32", "shard", (F.col("_p") - start).cast("bigint").alias("slot"))
