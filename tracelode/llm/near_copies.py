"""Near copies by similarity: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Three searches give candidates, each verified by the exact similarity of both texts:

* operator 9's, over 64-bit fingerprints of the shingles: balls within segments, complete distances of 2 at most. It ties
  copies with few edits at once, but two texts at 0.8 differ in about ten bits of 64 and those of few shingles in more;
* sets of up to LARGE shingles by prefixes: in one order of all shingles, rare ones first, two sets at 0.8 share one of
  the first n - ceil(0.8 n) + 1 of each. No link of theirs is lost;
* sets of over SMALL shingles by BANDS bands of DEEP min-hashes: a pair at exactly 0.8 shares one with a chance of 0.997, at
  0.85 of 0.9999. Pairs of such sets may differ in 1-bit min-hashes by DEVIATIONS standard deviations over the mean at 0.8.

A pair at 0.8 with a set of up to SMALL has a partner of up to LARGE, so every pair is in one of the two latter.

A value that m texts meet under would give pairs by m squared. Each of its texts is first compared with the least of
those under it. After that only pairs whose texts are not in one group yet are left, and all of those are compared: the
groups are the same as if every pair had been. A few values go first, together with operator 9's; what they tie together
is not compared under the others.

Scale: texts are read once for their values; texts that are equal fall together before any join. A text has at most
BANDS values of 8 bytes or 11 of prefixes. The order of shingles is by counts of 65,536 groups of them, a bounded table; it need
not be exact for prefixes to be. Only texts of candidate pairs are moved, as sets of 64-bit shingle hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.llm._shared import bound_batches, discard, returned, slices, unused, written
from tracelode.llm.simhash import components, fingerprint_words, linked, majority, with_least

SHINGLE, SIMILARITY = 5, 0.8
BANDS, DEEP = 20, 6
#: Sets of so many shingles at most have prefixes; those of more than SMALL have bands.
LARGE, SMALL = 50, 40
DEVIATIONS = 3.5
#: Values of a text that are searched in the first round.
FIRST = 4
SEED = 42
#: Bytes of text whose min-hashes a worker takes at a time.
PRINT_BYTES = 1 << 20
#: Sets of so many shingles at most are compared inside a join.
LISTED = 512
#: Shingle hashes of pairs that a worker compares at a time.
PAIR_BYTES = 4 << 20
MIX, PREFIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(fingerprint_words((text or "").encode().lower().split(), SHINGLE, SEED))


def most_bits() -> int:
    """How many 1-bit min-hashes a pair of large sets may differ in."""
    bits, p = BANDS * DEEP, (1 - SIMILARITY) / 2
    return math.ceil(bits * p + DEVIATIONS * math.sqrt(bits * p * (1 - p)))


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """BANDS x DEEP min-hashes of each set; the greatest number for an empty one."""
    dice = np.random.default_rng(SEED)
    factor = dice.integers(0, 1 << 63, BANDS * DEEP, np.uint64) * np.uint64(2) + np.uint64(1)
    shift = dice.integers(0, 1 << 63, BANDS * DEEP, np.uint64)
    out = np.full((BANDS * DEEP, len(sets)), np.uint64(2**64 - 1))
    full = [k for k, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[k] for k in full])
        first = np.cumsum([0, *(len(sets[k]) for k in full[:-1])])
        for k in range(BANDS * DEEP):
            out[k, full] = np.minimum.reduceat(flat * factor[k] + shift[k], first)
    return np.ascontiguousarray(out.T)


def _bands(hashes: np.ndarray) -> np.ndarray:
    """One number for each band of each row."""
    out = np.zeros((len(hashes), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(DEEP):
        out = (out ^ hashes[:, k::DEEP]) * MIX
        out ^= out >> np.uint64(31)
    return out


def _sketches(hashes: np.ndarray) -> np.ndarray:
    """A bit of each min-hash, in whole words."""
    bits = ((hashes * MIX) >> np.uint64(63)).astype(np.uint8)
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64)))
    return np.ascontiguousarray(np.packbits(bits, axis=1)).view(np.int64)


def prefix(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Values of a small set: its first shingles, rare ones first; one of its own for the empty set."""
    if not len(found):
        return np.array([PREFIX])
    keep = len(found) - (4 * len(found) + 4) // 5 + 1
    order = np.lexsort((found, counts[(found >> np.uint64(48)).astype(np.int64)]))
    return (found[order[:keep]] ^ PREFIX) * MIX


def _node(text: Column) -> Column:
    """A text's digest; a null text counts as empty."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def _prints(docs: DataFrame) -> DataFrame:
    """(node, doc_id, n, fp, sketch, bands, small): of each text its digest, least doc_id, number of shingles, operator 9's fingerprint, 1-bit min-hashes, band values and, if it is small, its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", PRINT_BYTES):
                each = [fingerprint_words((t or "").encode().lower().split(), SHINGLE, SEED) for t in part.column("_text").to_pylist()]
                sets = [np.unique(h) for h in each]
                hashes = min_hashes(sets)
                size = np.fromiter(map(len, sets), np.int32, len(sets))
                listed = lambda v, keep: pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(keep * v.shape[1])]).astype(np.int32), pa.array(v[keep].view(np.int64).ravel()))
                columns = [part.column("node"), part.column("doc_id"), pa.array(size), pa.array(majority(each).view(np.int64)), listed(_sketches(hashes), size >= 0), listed(_bands(hashes), size > SMALL)]
                small = pa.array([s.tobytes() if len(s) <= LARGE else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([*columns, small], ["node", "doc_id", "n", "fp", "sketch", "bands", "small"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.mapInArrow(returned(run), f"node binary, doc_id {kind}, n int, fp bigint, sketch array<bigint>, bands array<bigint>, small binary")
    return found.groupBy("node").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n", "fp", "sketch", "bands", "small")])


def _shingle_counts(marks: DataFrame) -> np.ndarray:
    """How many shingles of small sets begin with each 16 bits: what the order of prefixes goes by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            found = np.frombuffer(b"".join(v for v in batch.column(0).to_pylist() if v), np.uint64)
            total += np.bincount((found >> np.uint64(48)).astype(np.int64), minlength=1 << 16)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["i", "n"])

    out = np.zeros(1 << 16, np.int64)
    for i, n in marks.select("small").mapInArrow(returned(run), "i bigint, n bigint").groupBy("i").agg(F.sum("n")).collect():
        out[i] = n
    return out


def _values(marks: DataFrame, counts: np.ndarray) -> DataFrame:
    """(id, values): what a text is found under, prefixes after bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for bands, small in zip(batch.column("bands").to_pylist(), batch.column("small").to_pylist()):
                more = [] if small is None else prefix(np.frombuffer(small, np.uint64), counts).view(np.int64).tolist()
                found.append(bands + more)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(pa.int64()))], ["id", "values"])

    return marks.select("id", "bands", "small").mapInArrow(returned(run), "id bigint, values array<bigint>")


def _sets(docs: DataFrame) -> DataFrame:
    """(id, s, l): the sorted shingle hashes of each row of docs (id, _text), and as a list if they are LISTED at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", PRINT_BYTES):
                found = [shingles(t) for t in part.column("_text").to_pylist()]
                few = pa.array([s.view(np.int64) if len(s) <= LISTED else None for s in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([s.tobytes() for s in found], pa.binary()), few], ["id", "s", "l"])

    return docs.mapInArrow(returned(run), "id bigint, s binary, l array<bigint>")


def _sets_of(ids: DataFrame, marks: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, s, l) of the texts ids (id, no repeats)."""
    # Of a text's exact copies the one with its least doc_id is read, so that they don't meet in one task.
    wanted = marks.select("id", F.struct("node", "doc_id").alias("_at")).join(ids, "id", "left_semi")
    once = texts.select(F.struct("node", "doc_id").alias("_at"), "_text").join(wanted, "_at").dropDuplicates(["id"])
    return _sets(once.select("id", "_text"))


def _likely(n: str, m: str, one: str, two: str) -> Column:
    """Whether sets of n and m shingles with these sketches may be similar enough."""
    size = F.least(n, m) * 5 >= F.greatest(n, m) * 4
    words = -(-BANDS * DEEP // 64)
    differ = sum(F.bit_count(F.col(one)[k].bitwiseXOR(F.col(two)[k])) for k in range(words))
    return size & ((F.least(n, m) <= LARGE) | (differ <= most_bits()))


def similar(pairs: DataFrame) -> DataFrame:
    """(a, b): the rows of pairs (a, b, s, t) whose sets s and t are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "s", PAIR_BYTES):
                keep = []
                for s, t in zip(part.column("s"), part.column("t")):
                    one, two = (np.frombuffer(v.as_buffer(), np.uint64) for v in (s, t))
                    both = np.concatenate([one, two])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    # In whole numbers, so that a similarity of exactly 4/5 is in. Two empty texts are equal.
                    keep.append(common * 5 >= (len(both) - common) * 4)
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(returned(run), "a bigint, b bigint")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, s, t)"""
    one = sets.select(F.col("id").alias("a"), "s")
    return pairs.join(one, "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("t")), "b").select("a", "b", "s", "t")


def _verified(pairs: DataFrame, marks: DataFrame, texts: DataFrame, tag: str) -> DataFrame:
    """Those of pairs (a, b) that are near copies; marks has the sketches, texts (doc_id, node, _text), repeats included."""
    of = lambda name, size, value: marks.select(F.col("id").alias(name), F.col("n").alias(size), F.col("sketch").alias(value))
    near = pairs.distinct().join(of("a", "n", "p"), "a").join(of("b", "m", "q"), "b").where(_likely("n", "m", "p", "q"))
    pairs = written(near.select("a", "b"), f"{tag}-pairs")
    sets = written(_sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), marks, texts).drop("l"), f"{tag}-sets")
    both = _with_sets(pairs, sets)
    links = written(similar(both), f"{tag}-links")
    discard(pairs, sets)
    return links


def _pairs(rows: DataFrame, one: str, two: str) -> DataFrame:
    return rows.where(F.col(one) != F.col(two)).select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b"))


def _printed(marks: DataFrame) -> DataFrame:
    """(a, b): each text with the least of its group by operator 9's fingerprints."""
    tied = components(linked(marks.select("fp").distinct()))
    named = marks.select("id", "fp").join(tied.withColumnRenamed("node", "fp"), "fp", "left").select("id", F.coalesce("root", "fp").alias("key"))
    named = written(named, "printed")
    least = named.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1")
    most = least.agg(F.max("n")).first()[0] or 0
    return _pairs(with_least(named, least, "key", named.count(), most), "id", "a")


def _met(placed: DataFrame, total: int) -> DataFrame:
    """(a, b): of texts (v, id, root) each with the least under its value v, if that is of another group."""
    # Map-side minima: a value that many texts share is not gathered in one place.
    first = F.min(F.struct("id", "root"))
    least = placed.groupBy("v").agg(first["id"].alias("a"), first["root"].alias("of"), F.max("root").alias("high"), F.min("root").alias("low"), F.count("*").alias("n")).where("low <> high")
    most = least.agg(F.max("n")).first()[0] or 0
    return _pairs(with_least(placed, least, "v", total, most, F.col("root") != F.col("of")), "id", "a")


def _rooted(rows: DataFrame, tied: DataFrame | None) -> DataFrame:
    """rows (id) with root: the group of tied (node, root) that a text is in, itself if none."""
    if tied is None:
        return rows.withColumn("root", F.col("id"))
    return rows.join(tied.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))


def _edges(links: DataFrame, tied: DataFrame | None) -> DataFrame:
    """links, and an edge from each text of a group found before (tied) to the group's root, which stands for all links in it."""
    return links if tied is None else links.unionByName(tied.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))


def _across(placed: DataFrame, marks: DataFrame, texts: DataFrame, tried: DataFrame) -> DataFrame:
    """(a, b): near copies among all pairs of texts (v, id, root) under one value that are of different groups, but those tried.

    Sets of up to LISTED shingles are compared inside the join, so that only links come out of it; pairs with a larger one after it.
    """
    split = placed.groupBy("v").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("k"))
    # Two texts of a value were compared as the least and the other one.
    split = split.where("low <> high AND k > 2").select("v")
    rows = written(placed.join(split, "v", "left_semi"), "placed")
    sets = written(_sets_of(rows.select("id").distinct(), marks, texts), "across-sets")
    each = rows.join(marks.select("id", "n", "sketch"), "id").join(sets.select("id", "l"), "id")
    other = each.select("v", F.col("id").alias("b"), F.col("root").alias("roots"), F.col("n").alias("m"), F.col("sketch").alias("q"), F.col("l").alias("k"))
    small = F.col("l").isNotNull() & F.col("k").isNotNull()
    alike = 9 * F.size(F.array_intersect("l", "k")) >= 4 * (F.col("n") + F.col("m"))
    found = each.join(other, "v").where((F.col("id") < F.col("b")) & (F.col("root") != F.col("roots")) & _likely("n", "m", "sketch", "q") & (~small | alike))
    found = written(found.select(F.col("id").alias("a"), "b", small.alias("sure")).distinct(), "across-pairs")
    open_ = found.where("NOT sure").select("a", "b").join(tried, ["a", "b"], "left_anti")
    links = written(found.where("sure").select("a", "b").unionByName(similar(_with_sets(open_, sets))), "across-links")
    discard(rows, sets, found)
    return links


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, node, root): for each row of docs its text's digest, and one number for all of its near copies."""
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("_text")).withColumn("node", _node(F.col("_text")))
    texts = texts.select("doc_id", "node", "_text")
    # A text's number is given once, when the table is written; which one it gets changes no group.
    marks = written(_prints(texts).withColumn("id", F.monotonically_increasing_id()), "prints")
    total = marks.count()
    values = written(_values(marks, _shingle_counts(marks)), "values")
    under = lambda rows, low, n: rows.select("id", "root", F.explode(F.slice("values", low, n)).alias("v"))
    most = BANDS + LARGE
    # First operator 9's groups and a few values, then all values, both with the least; then all pairs across groups.
    tried = written(_printed(marks).unionByName(_met(under(_rooted(values, None), 1, FIRST), total)).distinct(), "first")
    found = _verified(tried, marks, texts, "first")
    tied = written(components(found), "tied")
    discard(found)
    stars = written(_met(under(_rooted(values, tied), 1, most), total).distinct().join(tried, ["a", "b"], "left_anti"), "stars")
    found = _verified(stars, marks, texts, "star")
    was, tied = tied, written(components(_edges(found, tied)), "tied")
    discard(was, found)
    found = _across(under(_rooted(values, tied), 1, most), marks, texts, tried.unionByName(stars))
    was, tied = tied, written(components(_edges(found, tied)), "tied")
    discard(was, found, tried, stars, values)
    named = marks.select("id", "node").join(tied.withColumnRenamed("node", "id"), "id", "left").select("node", F.coalesce("root", "id").alias("root"))
    named = written(named, "named")
    discard(marks, tied)
    return texts.select("doc_id", "node").join(named, "node")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without near copies: of each group the row of its smallest doc_id stays, one only where that is repeated.

    Of rows with that doc_id and different texts, the one with the least digest; a text that has no near copy always
    stays, whatever other rows its doc_id has. Rows without a doc_id come last. A null text counts as empty. Columns are
    those of docs, whatever their names; a row that stays is whole. An empty table gives an empty one.
    """
    at = unused(docs.columns, "_at")
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("node"))
    picks = groups(docs, doc_id, text).groupBy("root").agg(F.min(rank).alias("_pick")).select("_pick.doc_id", "_pick.node")
    picks = picks.select(F.struct("doc_id", "node").alias(at))
    marked = docs.withColumn(at, F.struct(F.col(doc_id).alias("doc_id"), _node(F.col(text)).alias("node")))
    return marked.join(picks, at, "left_semi").dropDuplicates([at]).drop(at)
