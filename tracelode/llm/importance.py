"""Importance resampling towards a target: documents drawn by how much likelier their features are in the target.

Features are runs of 1 to `longest` words; each falls in one of `buckets` by the CRC-32 of its bytes. Distinct features are
a dictionary: strings are counted over the whole corpus first, each distinct one is hashed once, and buckets are summed
from the dictionary. A bucket's gain is a floor(1000 ln) of the ratio of smoothed shares in target and corpus. Gains go
back over the dictionary to each document's feature counts; the sum is its weight. A Gumbel number by a hash of the
document's id is added, and the highest sums are a sample without replacement in proportion to exp(weight / 1000).

Scale: workers count features of a stretch of texts before anything is shuffled. Features with over HOT_SHARE of all
occurrences, at most 1 / HOT_SHARE of them, go to workers as a table; others are joined by string, none with a larger
share of the rows than that. Gains are a table of `buckets` rows. Ranks come from ranges and the counts before them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelode.llm._shared import bound_batches, discard, repeated_rows, returned, slices, written

#: Lower-cased words: digits, letters and all bytes beyond ASCII.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: A feature with more than this share of all occurrences is hot.
HOT_SHARE = 1e-5
#: Feature rows that a worker holds before it passes them on.
HELD = 1 << 18


def features(text: str | None, longest: int = 1) -> list[bytes]:
    """All runs of 1 to `longest` consecutive words, joined by a space, repeats included."""
    words = WORD.findall((text or "").encode().lower())
    return words + [b" ".join(words[k : k + n]) for n in range(2, longest + 1) for k in range(len(words) - n + 1)]


def _counted(texts: DataFrame, longest: int) -> DataFrame:
    """(w, n): features of texts (_text) with their number in a stretch of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "_text"):
                for text in part.column("_text").to_pylist():
                    held.update(features(text, longest))
                if len(held) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["w", "n"])
                    held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["w", "n"])

    return texts.mapInArrow(returned(run), "w binary, n bigint")


def dictionary(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """(w, n, gain): each distinct feature of docs, how often it occurs there, and its bucket's gain; a written table."""
    bound_batches(docs.sparkSession)
    of = lambda df, c: _counted(df.select(F.col(c).cast("string").alias("_text")), longest)
    both = of(docs, text).select("w", "n", F.lit(0).cast("bigint").alias("t")).unionByName(of(target, target_text).select("w", F.lit(0).cast("bigint").alias("n"), F.col("n").alias("t")))
    words = both.groupBy("w").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).withColumn("bucket", (F.crc32("w") % buckets).cast("int"))
    words = written(words, "dictionary")
    sums = words.groupBy("bucket").agg(F.sum("n").alias("s"), F.sum("t").alias("t"))
    all_s, all_t = sums.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    ratio = ((F.col("t") + 1.0) * F.lit(float(all_s + buckets))) / ((F.col("s") + 1.0) * F.lit(float(all_t + buckets)))
    gains = F.broadcast(sums.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).cast("bigint").alias("gain")))
    found = written(words.where("n > 0").join(gains, "bucket").select("w", "n", "gain"), "gains")
    found._total = all_s
    discard(words)
    return found


def weights(docs: DataFrame, words: DataFrame, doc_id: str = "doc_id", text: str = "text", longest: int = 1) -> DataFrame:
    """(doc_id, mark, copy, n_features, weight) for each row of docs; mark is the text's digest, copy numbers equal rows."""
    spark = docs.sparkSession
    hot = spark.sparkContext.broadcast({bytes(r.w): r.gain for r in words.where(F.col("n") > F.lit(words._total * HOT_SHARE)).select("w", "gain").collect()})
    names = ["doc_id", "mark", "w", "n", "size", "rows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain_of, at = hot.value, 0
        for batch in batches:
            for part in slices(batch, "_text"):
                owner, marks, ws, ns, sizes, rows = [], [], [], [], [], []
                for k, text in enumerate(part.column("_text").to_pylist()):
                    counts, weight, size = Counter(features(text, longest)), 0, 0
                    mark = xxhash.xxh64_intdigest((text or "").encode()) - (1 << 63)
                    cold = []
                    for w, n in counts.items():
                        size += n
                        if (gain := gain_of.get(w)) is None:
                            cold.append((w, n))
                        else:
                            weight += n * gain
                    # A row of its own, under a key that no feature has and that doesn't meet others': its hot features' weight.
                    at += 1
                    for w, n, s, r in [(b"\0%d" % at, weight, size, 1), *((w, n, 0, 0) for w, n in cold)]:
                        owner.append(k), marks.append(mark), ws.append(w), ns.append(n), sizes.append(s), rows.append(r)
                    if len(owner) > HELD:
                        yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(owner)), pa.array(marks, pa.int64()), pa.array(ws, pa.binary()), pa.array(ns, pa.int64()), pa.array(sizes, pa.int64()), pa.array(rows, pa.int64())], names)
                        owner, marks, ws, ns, sizes, rows = [], [], [], [], [], []
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(marks, pa.int64()), pa.array(ws, pa.binary()), pa.array(ns, pa.int64()), pa.array(sizes, pa.int64()), pa.array(rows, pa.int64())], names)

    kind = docs.schema[doc_id].dataType.simpleString()
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("_text"))
    counts = texts.mapInArrow(returned(run), f"doc_id {kind}, mark bigint, w binary, n bigint, size bigint, rows bigint")
    cold = words.where(F.col("n") <= F.lit(words._total * HOT_SHARE)).select("w", "gain")
    gained = counts.join(cold, "w", "left").select("doc_id", "mark", (F.col("n") * F.coalesce("gain", F.lit(1))).alias("n"), "size", "rows")
    each = gained.groupBy("doc_id", "mark").agg(*[F.sum(c).alias(c) for c in ("n", "size", "rows")])
    # Equal rows fell together: each has its part of the sums.
    each = each.select("doc_id", "mark", F.expr("n div rows").alias("weight"), F.expr("size div rows").alias("n_features"), "rows")
    return repeated_rows(each, "rows", "copy")


def resampled(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = 1, buckets: int = 10_000, least: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of docs; rank counts the drawn from 1, others have none.

    Of the rows with at least `least` words, floor(percent / 100) of them have the highest scores and are drawn; ties go to
    the smaller doc_id (null last), then by a digest of the text. A null text has no features, a null doc_id counts as
    empty in the hash. Repeated rows are rows of their own with equal scores and ranks next to each other. An empty table gives an
    empty one, an empty target gains by smoothing alone. Other columns, whatever their names, are not touched.
    """
    if longest < 1 or buckets < 1:
        raise ValueError("longest and buckets are 1 at least")
    words = dictionary(docs, target, text, target_text, longest, buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    luck = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("bigint")
    rows = written(weights(docs, words, doc_id, text, longest).withColumn("score", F.col("weight") + luck), "weights")
    discard(words)
    # Of a feature of n words a text of m has m - n + 1; from those of all lengths to its words.
    size = F.col("n_features") if longest == 1 else _words_of(F.col("n_features"), longest)
    able = rows.where(size >= least)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("mark"), F.col("copy")]
    ranged = written(able.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    # A row a range.
    totals = ranged.groupBy("_range").count()
    totals = totals.select("_range", F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("count").over(Window.partitionBy()).alias("_all"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    ranked = ranged.join(F.broadcast(totals), "_range").select("*", F.when(place <= F.expr(f"_all * {int(percent)} div 100"), place).cast("bigint").alias("rank"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(rows.where(size < least).withColumn("rank", F.lit(None).cast("bigint")).select(*columns))


def _words_of(n: F.Column, longest: int) -> F.Column:
    """Words of a text with n features of 1 to `longest` words: n = m L - L (L - 1) / 2 once m is L at least."""
    few = F.floor((F.sqrt(8.0 * n + 1) - 1) / 2)
    full = (n + longest * (longest - 1) // 2) / longest
    return F.when(n >= longest * (longest + 1) // 2, full).otherwise(few).cast("bigint")
