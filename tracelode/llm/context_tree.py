"""Context-tree weighting of bytes, learned from counts and scored as code length.

Text as modelled: words (runs of bytes other than white space) in lower case, one space between them, then an end
byte; before the first word stand DEPTH end bytes. Each byte is eight binary decisions, and each decision, named by
the bits before it, has a tree of contexts: the last 0 to DEPTH bytes. A node holds the Krichevsky-Trofimov
probability of what training saw there, weighted half and half against the product of its children; the posterior
weights mix the estimates of all depths into each decision's probability. A context that training never saw leaves
its share to the deepest one that it did see, so each decision's two probabilities sum to 1.

How it is laid out: training texts become counts of (DEPTH + 1)-grams, packed into a 64-bit key with the nearest
context byte first, so that every context of every depth is a stretch of sorted keys. Keys are dealt into parts of at
most PART_GRAMS grams: several pairs of nearest bytes, or, of a pair with more grams than that, several triples, and so
on, down to a whole context, which has at most 256 grams. A part computes the depths from its own prefixes' length on.
What lies above follows from sums over parts: depths 0 and 1, and the nodes of the prefixes that were split (a split
prefix has over PART_GRAMS grams, so there are at most DEPTH times as many of them as parts). Parts are sorted arrays
in the shared folder. Workers map them to memory: nothing of the model is broadcast but the bounds of parts and the
nodes above them.

The word base counts whole words by 128-bit hash, in files of the same kind.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm._shared import bound_batches, discard, flat_text, local_path, map_array, shared_folder, slices, write_bytes, written

DEPTH = 6
END = 10
#: Grams of a part, at most.
PART_GRAMS = 200_000
PART_WORDS = 500_000
#: Distinct grams, and words, that a task holds before it passes counts on.
HELD, HELD_WORDS = 2_000_000, 250_000
#: Bytes of a text that are taken together; a longer text is cut at white space.
STRETCH = 2 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER[SPACE] = 32


def canonical(flat: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text as depth end bytes, its words and an end byte; and where each text's own bytes begin."""
    n = len(at) - 1
    data = LOWER[flat]
    space = data == 32
    first = np.zeros(len(data) + 1, bool)
    first[at[:-1]] = True
    first = first[:-1]
    before = np.concatenate([[True], space[:-1]]) | first
    keep = ~(space & before)
    # A space before the end of its text goes, too.
    doc = np.repeat(np.arange(n), np.diff(at))
    where = np.flatnonzero(keep)
    doc = doc[where]
    data = data[where]
    last = np.concatenate([doc[1:] != doc[:-1], [True]]) if len(doc) else np.empty(0, bool)
    stay = ~((data == 32) & last)
    data, doc = data[stay], doc[stay]
    sizes = np.bincount(doc, minlength=n)
    begin = np.cumsum(sizes + depth + 1) - sizes - 1
    out = np.full(int(sizes.sum()) + n * (depth + 1), END, np.uint8)
    out[np.arange(len(data)) + (doc + 1) * (depth + 1) - 1] = data
    return out, begin


def stretches(part: pa.RecordBatch, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """All texts of a batch as modelled, in stretches: (bytes, where texts' own bytes begin, their rows, whether they end there).

    Short texts come together. One longer than STRETCH comes alone, stretch by stretch, cut at white space (a longer
    word is taken whole); the `depth` bytes before a stretch are those it follows on.
    """
    flat, at = flat_text(part.column("_text"))
    long = np.flatnonzero(np.diff(at) > STRETCH)
    for first, stop in zip([0, *(long + 1).tolist()], [*long.tolist(), part.num_rows]):
        if first < stop:
            data, begin = canonical(flat[at[first] : at[stop]], at[first : stop + 1] - at[first], depth)
            yield data, begin, np.arange(first, stop), np.ones(stop - first, bool)
        if stop == part.num_rows:
            break
        text = flat[at[stop] : at[stop + 1]]
        before, place, started = np.full(depth, END, np.uint8), 0, False
        while place < len(text):
            cut = place + STRETCH
            if cut < len(text):
                spaces = np.flatnonzero(SPACE[text[place:cut]])
                if len(spaces) and spaces[-1]:
                    cut = place + int(spaces[-1])
                else:
                    later = np.flatnonzero(SPACE[text[cut:]])
                    cut = cut + int(later[0]) if len(later) else len(text)
            cut = min(cut, len(text))
            body = canonical(text[place:cut], np.array([0, cut - place]), 0)[0][:-1]
            place = cut
            if len(body) and started:
                body = np.concatenate([[np.uint8(32)], body])
            started |= len(body) > 0
            if place == len(text):
                body = np.append(body, np.uint8(END))
            if len(body):
                data = np.concatenate([before, body]).astype(np.uint8)
                yield data, np.array([depth]), np.array([stop]), np.array([place == len(text)])
                before = data[len(data) - depth :]


def packed(data: np.ndarray, depth: int) -> np.ndarray:
    """The key of the byte at each place from depth on: nearest context byte first, the byte itself last."""
    n = len(data) - depth
    key = np.zeros(max(n, 0), np.int64)
    for k in range(1, depth + 1):
        key |= data[depth - k : depth - k + n].astype(np.int64) << (8 * (depth + 1 - k))
    return key | data[depth : depth + n]


def own(data: np.ndarray, begin: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the texts' own bytes and their end bytes, and where each text's keys begin."""
    ends = np.append(begin[1:] - depth, len(data))
    sizes = ends - begin
    keys = packed(data, depth)
    starts = np.cumsum(sizes) - sizes
    return keys[np.arange(sizes.sum()) + np.repeat(begin - depth - starts, sizes)], starts


def lgamma(x: np.ndarray) -> np.ndarray:
    """Log of the gamma function for x >= 1/2, by Stirling's series past 10."""
    shift = np.ones_like(x)
    z = x.copy()
    low = np.flatnonzero(z < 10)
    y = z[low]
    product = np.ones_like(y)
    for _ in range(10):
        more = y < 10
        product = np.where(more, product * y, product)
        y = np.where(more, y + 1, y)
    z[low], shift[low] = y, product
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(shift)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - lgamma(n0 + n1 + 1.0) - np.log(np.pi)


def weigh(n0: np.ndarray, n1: np.ndarray, children: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Log weighted probability of nodes and the posterior weight of their own estimate."""
    own_ = log_kt(n0, n1)
    if children is None:
        return own_, np.ones_like(own_)
    both = np.logaddexp(own_, children) + np.log(0.5)
    return both, np.exp(own_ + np.log(0.5) - both)


def nodes(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decision nodes of sorted (context, byte) keys: context << 8 | bits so far, zeros and ones counted. Sorted by key."""
    context, byte = key >> 8, key & 255
    found = []
    for j in range(8):
        node = context << 8 | 1 << j | byte >> (8 - j)
        bit = byte >> (7 - j) & 1
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        ones = np.add.reduceat(n * bit, first)
        found.append((node[first], np.add.reduceat(n, first) - ones, ones))
    key, zeros, ones = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(key, kind="stable")
    return key[order], zeros[order].astype(float), ones[order].astype(float)


def build(key: np.ndarray, n: np.ndarray, depth: int, top: int = 2) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], tuple]:
    """The tree below depth `top` over sorted keys with counts.

    For each depth: node keys and the probability of a one if the mixture starts at `top` and ends there. And of the
    nodes at `top`: key, zeros, ones, log weighted probability.
    """
    level, grams = {}, (key, n)
    for d in range(depth, top - 1, -1):
        at, zeros, ones = nodes(*grams)
        children = None
        if d < depth:
            deeper = level[d + 1][0]
            parent = (deeper >> 16) << 8 | deeper & 255
            up = np.searchsorted(at, parent)
            children = np.bincount(up, level[d + 1][3], len(at))
            level[d + 1] = (*level[d + 1], up)
        both, weight = weigh(zeros, ones, children)
        level[d] = (at, zeros, ones, both, weight)
        shorter = (grams[0] >> 16) << 8 | grams[0] & 255
        merged, inverse = np.unique(shorter, return_inverse=True)
        grams = merged, np.bincount(inverse, grams[1], len(merged)).astype(np.int64)
    out = {}
    sure = rest = None
    for d in range(top, depth + 1):
        at, zeros, ones, _, weight = level[d][:5]
        one = (ones + 0.5) / (zeros + ones + 1)
        if d == top:
            sure, rest = np.zeros(len(at)), np.ones(len(at))
        else:
            up = level[d][5]
            sure, rest = sure[up], rest[up]
        out[d] = (at, sure + rest * one)
        sure, rest = sure + rest * weight * one, rest * (1 - weight)
    return out, level[top][:4]


class Upper:
    """Depths 0 and 1: for a nearest byte and the bits so far, what a deeper mixture is added to and multiplied by, and the probability of a one without one."""

    def __init__(self, table: np.ndarray):
        """table: zeros, ones and log weighted probability of the children by nearest byte and bits so far."""
        seen = table[0] + table[1] > 0
        both, weight = weigh(table[0].ravel(), table[1].ravel(), table[2].ravel())
        both, weight = np.where(seen, both.reshape(256, 256), 0), weight.reshape(256, 256)
        zeros, ones = table[0].sum(axis=0), table[1].sum(axis=0)
        _, root = weigh(zeros, ones, both.sum(axis=0))
        first = (ones + 0.5) / (zeros + ones + 1)
        one = (table[1] + 0.5) / (table[0] + table[1] + 1)
        root = np.where(zeros + ones > 0, root, 1)
        self.alone = np.where(seen, root * first + (1 - root) * one, first)
        self.add = root * first + (1 - root) * weight * one
        self.times = (1 - root) * (1 - weight)


class Split:
    """A prefix whose grams were too many for a part: its nodes' counts, then the same three arrays as in Upper, by bits so far."""

    def __init__(self, prefix: int, length: int, parent: int):
        """prefix: its bytes, nearest first; parent: number of the split prefix one byte shorter, -1 if that is a single byte."""
        self.prefix, self.length, self.parent = prefix, length, parent
        self.table = np.zeros((3, 256))
        self.alone = self.add = self.times = np.empty(0)

    def weighted(self) -> np.ndarray:
        """Zeros, ones and log weighted probability by bits so far; 0 where nothing was seen."""
        seen = self.table[0] + self.table[1] > 0
        both, self.weight = weigh(*self.table)
        return np.stack([self.table[0], self.table[1], np.where(seen, both, 0)])

    def finish(self, alone: np.ndarray, add: np.ndarray, times: np.ndarray) -> None:
        zeros, ones, _ = self.table
        one = (ones + 0.5) / (zeros + ones + 1)
        self.alone = np.where(zeros + ones > 0, add + times * one, alone)
        self.add, self.times = add + times * self.weight * one, times * (1 - self.weight)


def combined(splits: list[Split], table: np.ndarray) -> Upper:
    """Depths 0 and 1 from the sums over parts in `table` and from the split prefixes, which are finished on the way. Parents come before their children."""
    for split in reversed(splits):
        into = table[:, split.prefix >> 8] if split.parent < 0 else splits[split.parent].table
        into += split.weighted()
    upper = Upper(table)
    for split in splits:
        c = split.prefix >> 8
        over = (upper.alone[c], upper.add[c], upper.times[c]) if split.parent < 0 else (lambda s: (s.alone, s.add, s.times))(splits[split.parent])
        split.finish(*over)
    return upper


@lru_cache(512)
def _mapped(name: str, kind: str) -> np.ndarray:
    return map_array(name, kind)


@lru_cache(16)
def _read(name: str, kind: str) -> np.ndarray:
    return map_array(name, kind)


def _array(name: str, kind: str) -> np.ndarray:
    """A file's values; many are kept at hand where they are mapped, few where they are read whole."""
    return _mapped(name, kind) if local_path(name) else _read(name, kind)


class Model:
    """Log10 probabilities of keys from the parts in a folder."""

    def __init__(self, folder: str, depth: int, starts: np.ndarray, parts: np.ndarray, above: np.ndarray, splits: list[Split]):
        """starts: the first key of each region, ascending from 0; parts: its part, -1 if it has no grams; above: the split prefix it lies in, -1 for none."""
        self.folder, self.depth, self.starts, self.parts, self.above, self.splits = folder, depth, starts, parts, above, splits
        self.upper: Upper | None = None

    def lookup(self, part: int, d: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, one = _array(f"{self.folder}/{part}-{d}.key", "<i8"), _array(f"{self.folder}/{part}-{d}.one", "<f4")
        where = np.minimum(np.searchsorted(at, node), len(at) - 1)
        return at[where] == node, one[where]

    def decide(self, region: int, key: np.ndarray) -> np.ndarray:
        """Log10 probability of the byte of each key of a region, decision by decision."""
        byte, near = key & 255, key >> (8 * self.depth)
        part, above = int(self.parts[region]), int(self.above[region])
        split = self.splits[above] if above >= 0 else None
        top = 2 if split is None else split.length + 1
        total = np.zeros(len(key))
        # A context that was not seen with the bits so far is not seen with more of them.
        deep = np.full(len(key), self.depth if part >= 0 else top - 1)
        for j in range(8):
            bits = 1 << j | byte >> (8 - j)
            alone, add, times = (t[bits] for t in (split.alone, split.add, split.times)) if split else (t[near, bits] for t in (self.upper.alone, self.upper.add, self.upper.times))
            one = alone.copy()
            for d in range(self.depth, top - 1, -1):
                at = np.flatnonzero(deep == d)
                if not len(at):
                    continue
                node = (key[at] >> (8 * (self.depth + 1 - d))) << 8 | bits[at]
                hit, value = self.lookup(part, d, node)
                deep[at[~hit]] = d - 1
                at = at[hit]
                one[at] = add[at] + times[at] * value[hit]
            one = np.clip(one, 1e-12, 1 - 1e-12)
            total += np.log10(np.where(byte >> (7 - j) & 1, one, 1 - one))
        return total

    def score(self, key: np.ndarray) -> np.ndarray:
        """Log10 probability of each of the sorted distinct keys; whole grams that training saw were worked out before."""
        out = np.empty(len(key))
        region_of = np.searchsorted(self.starts, key, "right") - 1
        cuts = np.flatnonzero(np.concatenate([[True], region_of[1:] != region_of[:-1]])) if len(key) else []
        for a, b in zip(cuts, [*cuts[1:], len(key)]):
            region, own_ = int(region_of[a]), key[a:b]
            part = int(self.parts[region])
            if part < 0:
                out[a:b] = self.decide(region, own_)
                continue
            at, value = _array(f"{self.folder}/{part}.gram", "<i8"), _array(f"{self.folder}/{part}.log", "<f4")
            where = np.minimum(np.searchsorted(at, own_), len(at) - 1)
            hit = at[where] == own_
            out[a:b][hit] = value[where[hit]]
            if not hit.all():
                out[a:b][~hit] = self.decide(region, own_[~hit])
        return out


class Words:
    """Training counts of words by 128-bit hash, from files."""

    def __init__(self, folder: str, bits: int, parts: frozenset[int]):
        self.folder, self.bits, self.parts = folder, bits, parts

    @staticmethod
    def hashed(words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), ">i8").astype(np.int64).reshape(-1, 2)

    def counts(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        if not words or not self.parts:
            return out
        key = self.hashed(words)
        order = np.argsort(key[:, 0], kind="stable")
        part_of = key[order, 0] >> (63 - self.bits) >> 1
        cuts = np.flatnonzero(np.concatenate([[True], part_of[1:] != part_of[:-1]]))
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            part = int(part_of[a])
            if part not in self.parts:
                continue
            table = _array(f"{self.folder}/word{part}", "<i8").reshape(-1, 3)
            own_ = order[a:b]
            first = np.searchsorted(table[:, 0], key[own_, 0])
            for more in range(4):  # equal first halves lie together
                where = np.minimum(first + more, len(table) - 1)
                same = (table[where] [:, :2] == key[own_]).all(axis=1)
                out[own_[same]] = table[where[same], 2]
                if same.all():
                    break
        return out


def _counts(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    words: Counter = Counter()

    def merged() -> tuple[np.ndarray, np.ndarray]:
        key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        return key, np.bincount(inverse, np.concatenate(counts), len(key)).astype(np.int64)

    def rows() -> Iterator[pa.RecordBatch]:
        key, n = merged() if keys else (np.empty(0, np.int64), np.empty(0, np.int64))
        for k in range(0, len(key), 200_000):
            part = slice(k, k + 200_000)
            zero = np.zeros(len(key[part]), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(zero.astype(bool)), pa.array(key[part]), pa.array(zero), pa.array(n[part])], ["word", "key", "more", "n"])
        listed = list(words)
        for k in range(0, len(listed), 200_000):
            hashed = Words.hashed(listed[k : k + 200_000])
            n = np.fromiter((words[w] for w in listed[k : k + 200_000]), np.int64, len(hashed))
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(n), bool)), pa.array(hashed[:, 0].copy()), pa.array(hashed[:, 1].copy()), pa.array(n)], ["word", "key", "more", "n"])

    for batch in batches:
        for data, begin, _, ends in (s for part in slices(batch, "_text", STRETCH) for s in stretches(part, depth)):
            key, n = np.unique(own(data, begin, depth)[0], return_counts=True)
            keys.append(key)
            counts.append(n)
            words.update(data[begin[0] :].tobytes().replace(b"\n", b" ").split())
            words[b"\n"] += int(ends.sum())
            if sum(map(len, keys)) > HELD or len(words) > HELD_WORDS:
                if sum(map(len, keys)) > HELD:
                    keys, counts = ([x] for x in merged())
                if sum(map(len, keys)) > HELD // 2 or len(words) > HELD_WORDS:
                    yield from rows()
                    keys, counts, words = [], [], Counter()
    yield from rows()


def train(texts: DataFrame, text: str = "text", depth: int = DEPTH) -> tuple[Model, Words, int, int]:
    """The tree over the texts, their word counts, and how many words and distinct words they have (ends counted as words).

    A null text is empty and teaches its end alone; repeated rows count each. Other columns, whatever their names, are
    not touched. No row: a model without grams, for which every decision is even.
    """
    if not 2 <= depth <= 6:
        raise ValueError("depths 2 to 6")
    spark = texts.sparkSession
    bound_batches(spark)
    folder = shared_folder(spark, "tree")
    rows = texts.select(F.col(text).cast("string").alias("_text"))
    # A task's counts are combined already: they are dealt out first and added up once.
    counted = rows.mapInArrow(lambda b: _counts(b, depth), "word boolean, key bigint, more bigint, n bigint").repartition("key")
    counted = written(counted.groupBy("word", "key", "more").agg(F.sum("n").alias("n")), "grams")
    grams, words = counted.where("NOT word").select("key", "n"), counted.where("word").select("key", "more", "n")
    model = _regions(grams, folder, depth)
    model.upper = _build_parts(grams, model)
    _finish_parts(spark, model)
    total, distinct = words.agg(F.sum("n"), F.count("*")).first()
    bits = max(0, (distinct // PART_WORDS).bit_length())
    base = Words(folder, bits, _write_words(words, folder, bits))
    discard(counted)
    return model, base, int(total or 0), int(distinct)


def _regions(grams: DataFrame, folder: str, depth: int) -> Model:
    """The model's bounds. The driver sees counts of pairs (at most 65,536) and of the prefixes one byte longer than a split one."""
    spark = grams.sparkSession
    children: dict[tuple[int, int], list[tuple[int, int]]] = {}  # (prefix, length) of a split one: its children's last byte and grams
    roots = sorted(tuple(r) for r in grams.groupBy(F.shiftright("key", 8 * (depth - 1))).count().collect())
    heavy, length = [p for p, n in roots if n > PART_GRAMS], 2
    while heavy and length < depth:
        prefixes = F.broadcast(spark.createDataFrame([(p,) for p in heavy], "prefix bigint"))  # each has over PART_GRAMS grams
        longer = grams.select(F.shiftright("key", 8 * (depth - length)).alias("longer")).withColumn("prefix", F.shiftright("longer", 8)).join(prefixes, "prefix")
        found = sorted(tuple(r) for r in longer.groupBy("longer").count().collect())
        for p in heavy:
            children[p, length] = []
        for p, n in found:
            children[p >> 8, length].append((p, n))
        heavy, length = [p for p, n in found if n > PART_GRAMS], length + 1
    starts, parts, above, splits, number = [], [], [], [], count()

    def add(prefix: int, size: int, part: bool, parent: int) -> None:
        starts.append(prefix << (8 * (depth + 1 - size)))
        parts.append(next(number) if part else -1)
        above.append(parent)

    def cut(listed: list[tuple[int, int]], size: int, first: int, parent: int) -> None:
        """Regions from prefix `first` of `size` bytes on, over listed prefixes of that size."""
        held, begin = 0, first
        for prefix, n in listed:
            if held and (held + n > PART_GRAMS or (prefix, size) in children):
                add(begin, size, True, parent)
                held, begin = 0, prefix
            if (prefix, size) in children:
                if begin < prefix:
                    add(begin, size, False, parent)
                splits.append(Split(prefix, size, parent))
                cut(children[prefix, size], size + 1, prefix << 8, len(splits) - 1)
                begin = prefix + 1
            else:
                held += n
        add(begin, size, bool(held), parent)

    cut(roots, 2, 0, -1)
    return Model(folder, depth, np.array(starts, np.int64), np.array(parts, np.int64), np.array(above, np.int64), splits)


def _own_tasks(df: DataFrame, part, parts: int) -> DataFrame:
    """Each part in a task of its own."""
    df = df.withColumn("_part", part.cast("int"))
    return df.repartitionById(max(parts, 1), F.col("_part")) if hasattr(df, "repartitionById") else df.repartition(max(parts, 1), "_part")


def _build_parts(grams: DataFrame, model: Model) -> Upper:
    """Writes the parts' arrays and returns what lies above them."""
    folder, depth, starts, parts, above = model.folder, model.depth, model.starts, model.parts, model.above
    total = int(parts.max(initial=-1)) + 1
    table = np.zeros((3, 256, 256))
    if not total:
        return combined([], table)
    lengths = np.array([s.length for s in model.splits] + [1], np.int64)[above]
    of_part = {int(p): (int(a), int(n) + 1) for p, a, n in zip(parts, above, lengths) if p >= 0}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = parts[np.searchsorted(starts, batch.column("key").to_numpy(), "right") - 1]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), pa.array(where)], ["key", "n", "_k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(b.column("_part").to_numpy(), b.column("key").to_numpy(), b.column("n").to_numpy()) for b in batches]
        if not found:
            return
        part, key, n = (np.concatenate(x) for x in zip(*found))
        del found
        for k in np.unique(part).tolist():
            mine = np.flatnonzero(part == k)
            mine = mine[np.argsort(key[mine])]
            parent, top = of_part[k]
            levels, (at, zeros, ones, both) = build(key[mine], n[mine], depth, top)
            for d, (node, one) in levels.items():
                write_bytes(f"{folder}/{k}-{d}.key", node.astype("<i8"))
                write_bytes(f"{folder}/{k}-{d}.one", one.astype("<f4"))
            write_bytes(f"{folder}/{k}.gram", key[mine].astype("<i8"))
            first, inverse = np.unique((at >> 16 if parent < 0 else 0 * at) << 8 | at & 255, return_inverse=True)
            sums = [np.bincount(inverse, x, len(first)) for x in (zeros, ones, both)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), parent)), pa.array(first >> 8), pa.array(first & 255), *map(pa.array, sums)], ["parent", "c", "p", "zeros", "ones", "below"])

    placed = grams.mapInArrow(place, "key bigint, n bigint, _k bigint")
    sums = _own_tasks(placed, F.col("_k"), total).drop("_k").mapInArrow(run, "parent bigint, c bigint, p bigint, zeros double, ones double, below double")
    stored = written(sums, "upper")
    # At most 256 x 255 rows, and 255 for each split prefix.
    for parent, c, p, *values in stored.groupBy("parent", "c", "p").agg(*[F.sum(x).alias(x) for x in ("zeros", "ones", "below")]).collect():
        if parent < 0:
            table[:, c, p] = values
        else:
            model.splits[parent].table[:, p] = values
    discard(stored)
    return combined(model.splits, table)


def _finish_parts(spark: SparkSession, model: Model) -> None:
    """Works out the probability of each whole gram of training."""
    region_of = {int(p): k for k, p in enumerate(model.parts) if p >= 0}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column("_part").to_pylist():
                key = np.asarray(map_array(f"{model.folder}/{part}.gram", "<i8"))
                write_bytes(f"{model.folder}/{part}.log", model.decide(region_of[part], key).astype("<f4"))
            yield batch

    if region_of:
        parts = spark.range(len(region_of)).select(F.col("id").cast("int").alias("_k"))
        _own_tasks(parts, F.col("_k"), len(region_of)).drop("_k").mapInArrow(run, "_part int").count()


def _write_words(words: DataFrame, folder: str, bits: int) -> frozenset[int]:
    part = F.shiftright(F.shiftright("key", 63 - bits), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [[b.column(c).to_numpy() for c in ("_p", "key", "more", "n")] for b in batches]
        if not table:
            return
        p, *rest = (np.concatenate(x) for x in zip(*table))
        for k in np.unique(p).tolist():
            mine = np.stack([x[p == k] for x in rest], axis=1)
            write_bytes(f"{folder}/word{k}", mine[np.lexsort((mine[:, 1], mine[:, 0]))].astype("<i8"))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64())], ["k"])

    dealt = _own_tasks(words.withColumn("_p", part), F.col("_p") + (1 << bits >> 1), 1 << bits).drop("_part")
    return frozenset(r[0] for r in dealt.mapInArrow(run, "k bigint").collect())


def score(docs: DataFrame, trained: tuple[Model, Words, int, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte): one row for each row of docs.

    score: log10 probability of the text as modelled; n_bytes: its bytes with the end byte; bits_per_byte: its code
    length over them. base_score: log10 probability of its words and end under smoothed word counts. A null text is
    empty: the end alone. Equal texts score alike; an empty table gives no row. With no training text every decision is
    even. Other columns of docs, whatever their names, are not touched.
    """
    bound_batches(docs.sparkSession)
    model, words, total, distinct = trained
    depth = model.depth
    shared = docs.sparkSession.sparkContext.broadcast((model, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words = shared.value
        for batch in batches:
            for part in slices(batch, "_text", STRETCH):
                # A row's bytes, tokens, known tokens, base score and score: sums over its stretches.
                sums = np.zeros((5, part.num_rows))
                for data, begin, rows, ends in stretches(part, depth):
                    keys, starts = own(data, begin, depth)
                    key, inverse = np.unique(keys, return_inverse=True)
                    logs = np.add.reduceat(model.score(key)[inverse], starts)
                    sizes = np.diff(np.append(starts, len(keys)))
                    number: dict[bytes, int] = {b"\n": 0}
                    raw, listed = data.tobytes(), []
                    for a, n, end in zip(begin.tolist(), sizes.tolist(), ends.tolist()):
                        found = [number.setdefault(w, len(number)) for w in raw[a : a + n - end].split()]
                        listed.append([*found, 0] if end else found)
                    seen = words.counts(list(number))
                    value = np.log10((seen + 0.5) / (total + 0.5 * (distinct + 1)))
                    tokens = np.array([len(x) for x in listed])
                    flat = np.fromiter((w for x in listed for w in x), np.int64, int(tokens.sum()))
                    doc = np.repeat(np.arange(len(listed)), tokens)
                    base, known = (np.bincount(doc, x, len(listed)) for x in (value[flat], seen[flat] > 0))
                    sums[:, rows] += [sizes, tokens, known, base, logs]
                size, token, known = (x.astype(np.int64) for x in sums[:3])
                bits = -sums[4] / np.log10(2) / size
                columns = [size, token, known, np.full(len(size), total), sums[3], sums[4], bits]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, columns)], ["doc_id", "n_bytes", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double")
