"""SimHash fingerprints, multi-index hashing over their segments, and the groups they form.

A text's fingerprint has a bit set where over half of the XXH64 values of its word shingles have it.
Fingerprints at a Hamming distance of at most `radius` are linked. With m segments, two linked
fingerprints differ by at most radius // m bits in some segment; so each fingerprint is stored under
its m segment values and looked up under every value of the ball of that radius around each segment.
Matches are verified over all 64 bits.

A ball around a segment is enumerated from one side: the value itself and those with one more bit set. Of two values
that differ in one bit, the one without it finds the other; so a pair is fetched once, and half of the ball is left out.

Scale: texts are read once, for fingerprints of 8 bytes. Equal fingerprints fall together before any
join, so the size of a group of copies doesn't matter to the search. Half a ball has 17 values of a 32-bit
segment, so a table of 10^10 fingerprints holds about two candidates under each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.llm._shared import bound_batches, discard, returned, slices, written

#: A fingerprint that this share of all rows has is joined apart: there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001


def fingerprint_words(words: list[bytes], shingle: int = 3, seed: int = 42) -> np.ndarray:
    """The XXH64 values of a text's shingles, repeats included; of the whole sequence if it has fewer words."""
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())), np.uint64, len(starts))


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """One fingerprint for each array of hashes; zero for an empty one."""
    out = np.zeros(len(hashes), np.uint64)
    full = [k for k, h in enumerate(hashes) if len(h)]
    if not full:
        return out
    sizes = np.array([len(hashes[k]) for k in full])
    flat = np.concatenate([hashes[k] for k in full])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for bit in range(64):
        ones = np.add.reduceat(((flat >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), first)
        out[full] |= (2 * ones > sizes).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): one row for each row of docs; fp holds the 64 bits as a signed long. A null text counts as empty: fp 0."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                texts = part.column("_text").to_pylist()
                found = majority([fingerprint_words((t or "").encode().lower().split(), shingle, seed) for t in texts])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("_text")).mapInArrow(returned(run), f"doc_id {kind}, fp bigint")


def ball(value: Column, width: int, radius: int) -> list[Column]:
    """What a segment's value asks for: itself and, at radius 1, the values with one more bit set; null for a bit it has."""
    more = [F.when(value.bitwiseAND(F.lit(1 << i)) == 0, value.bitwiseOR(F.lit(1 << i))) for i in range(width)]
    return [value, *(more if radius else [])]


def linked(fps: DataFrame, radius: int = 2, segments: int = 2) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints (column fp, no repeats) within `radius` bits, each once.

    A pair comes from its first segment whose bits are near enough; others pass it over, so no distinct() follows.
    """
    width = 64 // segments
    near = radius // segments
    if near > 1:
        raise ValueError("balls of radius 0 or 1 are enumerated; take more segments for a larger radius")
    mask = (1 << width) - 1
    fp = F.col("fp")
    segment = [F.shiftrightunsigned(fp, width * (segments - 1 - k)).bitwiseAND(F.lit(mask)) for k in range(segments)]
    tagged = lambda k, value: F.when(value.isNotNull(), F.struct(F.lit(k).alias("k"), value.alias("v")))
    stored = fps.select(fp.alias("y"), F.explode(F.array(*[tagged(k, s) for k, s in enumerate(segment)])).alias("s"))
    asked = fps.select(fp.alias("x"), F.explode(F.array_compact(F.array(*[tagged(k, v) for k, s in enumerate(segment) for v in ball(s, width, near)]))).alias("s"))
    differ = F.col("x").bitwiseXOR(F.col("y"))
    distance = lambda k: F.bit_count(F.shiftrightunsigned(differ, width * (segments - 1 - k)).bitwiseAND(F.lit(mask)))
    first, here = F.lit(True), F.lit(0)
    for k in range(segments):
        here = F.when(F.col("s.k") == k, distance(k)).otherwise(here)
        first = first & ((F.col("s.k") <= k) | (distance(k) > near))
    # Values that are equal in the segment fetch each other; of values at distance 1 only one fetches the other.
    found = asked.join(stored, "s").where((F.bit_count(differ) <= radius) & first & ((F.col("x") < F.col("y")) | (here == 1)))
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


#: A key with over so many rows, and this share of all, is joined apart.
HUB_ROWS, HUB_SHARE = 100_000, 0.001


def with_least(rows: DataFrame, least: DataFrame, key: str, total: int, most: int, where: Column | None = None) -> DataFrame:
    """rows joined with least (key, n and others; no repeats of a key) without n, which counts a key's rows among `total`.

    most: what n is at most. Rows of a key with over HUB_ROWS and HUB_SHARE of them stay where they are: of such keys
    there are at most 1 / HUB_SHARE, which are broadcast. `where`: on columns of both, what is joined at all.
    """
    more = [c for c in least.columns if c not in (key, "n")]
    name, limit = f"_{key}", max(HUB_ROWS, total * HUB_SHARE)
    least = least.withColumnRenamed(key, name)

    def joined(some: DataFrame, with_: DataFrame) -> DataFrame:
        on = F.col(key) == F.col(name)
        return some.join(with_, on if where is None else on & where).select(*rows.columns, *more)

    if most <= limit:
        return joined(rows, least.drop("n"))
    hubs = least.where(F.col("n") > limit).drop("n")
    rest = rows.join(F.broadcast(hubs.select(name)), F.col(key) == F.col(name), "left_anti")
    return joined(rows, F.broadcast(hubs)).unionByName(joined(rest, least.where(F.col("n") <= limit).drop("n")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of edges (a, b), by alternating large and small stars.

    Each round is written to the shared folder, and the one before is removed. A node's smallest neighbour comes from a
    map-side combined minimum and is joined back, hubs by broadcast, so a hub's neighbours are never gathered in one place.
    Rounds end once the edges are stars: no node points to two others, and none that is pointed to points to another.
    """

    def state(df: DataFrame) -> tuple:
        """Edges, the most that meet in a node, and whether they are no stars yet."""
        ends = df.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(df.select("b", F.lit(0), F.lit(1)))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        loose = (F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))
        return tuple(ends.agg(F.coalesce(F.sum("up"), F.lit(0)), F.max(F.col("up") + F.col("down")), F.coalesce(F.max(loose), F.lit(False))).first())

    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    count, most, loose = state(now)
    while loose:
        both = now.union(now.select("b", "a"))
        # What a node has of neighbours bounds what it has of smaller ones after the first star.
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        large = with_least(both.where("b > a"), least, "a", 2 * count, most).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        paired = with_least(large, least, "a", count, most)
        small = paired.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        then = written(small.union(paired.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(now)
        now = then
        count, most, loose = state(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b")).distinct()


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): for each row of docs the smallest doc_id of the rows its fingerprint reaches over links.

    Nulls: a null text counts as empty (fp 0, linked like any other); a null doc_id keeps its row and is no
    component_id unless no row of the component has one. Repeated rows give repeated results; an empty table, none.
    Other columns of docs, whatever their names, are not touched.
    """
    rows = written(fingerprints(docs, doc_id, text, shingle, seed), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    tied = components(linked(classes.select("fp"), radius))
    members = classes.join(tied, classes.fp == tied.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    members = written(members, "members")
    least = members.where("fp <> root").select("root").distinct().join(members, "root").groupBy("root").agg(F.min("least").alias("of_group"))
    named = members.join(least, "root", "left").select("fp", F.coalesce("of_group", "least").alias("component_id"), "n")
    named = written(named, "named")
    discard(classes, members)
    total = named.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(named.where(F.col("n") > total * HOT_SHARE).select("fp", F.col("component_id").alias("_hot"), F.lit(True).alias("_is")))
    split = rows.join(hot, "fp", "left")
    cold = split.where("_is IS NULL").select("doc_id", "fp").join(named.select("fp", "component_id"), "fp")
    return split.where("_is").select("doc_id", "fp", F.col("_hot").alias("component_id")).unionByName(cold.select("doc_id", "fp", "component_id"))
