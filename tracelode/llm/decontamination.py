"""Documents that hold passages of a benchmark, within an edit budget: q-gram lemma filter, then banded alignment.

Both sides are compared as lower-cased ASCII letters, digits and other scripts' bytes, all else being one space. A
benchmark item is cut into overlapping windows; a window of m bytes with at most k edits shares at least
m + 1 - q - k * q q-grams with the text, within a band of k + 1 diagonals. So:

1. positions whose q-gram is in no window are dropped by a bit table, and stretches of text with fewer such
   positions than any window asks for with them;
2. the remaining hits are counted for each window and band of diagonals (bands overlap by half, so one holds all of
   a match);
3. bands that reach the window's bound are aligned, in a band of diagonals again, and matches within k edits stay.

Nothing that meets the bound is passed over, however frequent its q-grams are. A passage of WINDOW + STRIDE - 1 = 95
folded bytes of an item holds a whole window wherever it begins, so it is found for sure; a shorter one is found if it
holds a window within the window's edits. An item too short for the lemma (under Q + SHARED - 1 = 16 folded bytes) is
one window of its own and matches as whole words, without an edit.

Scale: documents are read once, without a shuffle. Items are folded and cut into pieces by tasks. Up to BLOCK bytes of
pieces make one index, which is broadcast (under 40 bytes a byte). A larger benchmark is dealt by hash into blocks of
about that size; tasks build their indexes as files in the shared folder, and a document's task maps them to memory one
after the other (where that folder isn't mounted, it reads them).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.llm._shared import bound_batches, flat_text, load_object, returned, save_object, shared_folder, slices, unused, written

Q = 8
WINDOW, STRIDE = 64, 32
#: Edits allowed for each byte of a window, and the shared q-grams that a window asks for at least.
RATE, SHARED = 0.1, 9
#: Pairs of a text's and a window's q-gram that are counted at a time.
PAIRS = 1 << 18
#: Folded bytes of the benchmark in an index.
BLOCK = 4_000_000
#: Folded bytes of an item in a piece (a multiple of STRIDE); its last windows reach into the next piece's bytes.
PIECE = 1 << 16
#: Bytes of documents that are looked at together; parts of a document overlap by more than a match is long.
PART, OVERLAP = 1 << 19, 256


def _fold() -> np.ndarray:
    table = np.full(256, 32, np.uint8)
    for c in range(256):
        if c >= 128 or chr(c).isalnum():
            table[c] = ord(chr(c).lower()) if c < 128 else c
    return table


FOLD = _fold()


def folded(flat: np.ndarray) -> np.ndarray:
    """Bytes of a text as compared: folded, runs of spaces as one."""
    out = FOLD[flat]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    return out[keep]


def budget(m: int) -> int:
    """Edits allowed in a window of m bytes: a tenth, and so few that SHARED q-grams are shared at least; below 0 the window is too short to tell."""
    return min(int(RATE * m), (m + 1 - Q - SHARED) // Q)


def grams(data: np.ndarray) -> np.ndarray:
    if len(data) < Q:
        return np.empty(0, np.uint64)
    return np.lib.stride_tricks.as_strided(np.frombuffer(data.tobytes(), np.uint8), (len(data) - Q + 1, Q), (1, 1)).copy().view(np.uint64).ravel()


def trimmed(text: str | None) -> np.ndarray:
    """An item as compared, without spaces around it."""
    data = folded(np.frombuffer((text or "").encode(), np.uint8))
    data = data[1:] if len(data) and data[0] == 32 else data
    return data[:-1] if len(data) and data[-1] == 32 else data


def pieces(data: np.ndarray) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(first byte, bytes, whether it is the last) of an item's pieces: each of its windows lies in one of them."""
    last = max(len(data) - WINDOW, 0)
    for first in range(0, last + 1, PIECE):
        yield first, data[first : first + PIECE + WINDOW], first + PIECE > last


class Index:
    """q-grams of a block's windows, and items too short for them."""

    BITS = 22

    def __init__(self, parts: list[tuple]):
        """parts: (item, first byte, bytes, whether it is the last) of pieces."""
        item, window, edits, short = [], [], [], {}
        for key, _, data, ends in parts:
            data = np.frombuffer(data, np.uint8)
            last = max(len(data) - WINDOW, 0)
            starts = {*range(0, min(last, PIECE) if ends else PIECE, STRIDE), *([last] if ends else [])}
            for at in sorted(starts):
                part = data[at : at + WINDOW]
                if budget(len(part)) >= 0:
                    item.append(key)
                    window.append(part)
                    edits.append(budget(len(part)))
                elif len(part):
                    short.setdefault(part.tobytes(), []).append(key)
        self.edits = edits
        self.window = window
        #: Short items by length: their bytes, sorted, and the first of their places in `item`.
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        places: dict[int, list] = {}
        for text in sorted(short):
            for key in short[text]:
                places.setdefault(len(text), []).append((text, len(item)))
                item.append(key)
        for size, found in places.items():
            self.short[size] = np.array([t for t, _ in found], f"S{size}"), np.array([k for _, k in found], np.int64)
        self.item = item
        each = [grams(w) for w in self.window]
        self.edits = np.array(self.edits, np.int64)
        self.size = np.array([len(w) for w in self.window], np.int64)
        self.need = self.size + 1 - Q - self.edits * Q
        flat = np.concatenate(each) if each else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.of = np.repeat(np.arange(len(each)), [len(g) for g in each])[order] if each else np.empty(0, np.int64)
        self.at = np.concatenate([np.arange(len(g)) for g in each])[order] if each else np.empty(0, np.int64)
        self.gram, self.first = np.unique(flat[order], return_index=True)
        self.end = np.append(self.first, len(flat))[1:]
        self.table = np.zeros(1 << self.BITS, bool)
        self.table[self.slot(self.gram)] = True
        self.reach = int((self.size + self.edits).max(initial=0))
        self.least = int(self.need.min(initial=SHARED))
        self.padded = np.zeros((len(each), WINDOW), np.uint8)
        for k, w in enumerate(self.window):
            self.padded[k, : len(w)] = w
        del self.window

    def slot(self, gram: np.ndarray) -> np.ndarray:
        return ((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def candidates(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and first diagonals of the bands that share enough q-grams with data."""
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        gram = grams(data)
        if not len(gram) or not len(self.gram):
            return none
        maybe = self.table[self.slot(gram)]
        # A match lies in a stretch of `reach` bytes and has at least `least` hits there.
        before = np.concatenate([[0], np.cumsum(maybe)])
        width = min(self.reach, len(gram))
        enough = before[width:] - before[:-width] >= self.least
        if not enough.any():
            return none
        marks = np.zeros(len(gram) + 1, np.int64)
        marks[: len(enough)] += enough
        marks[width : width + len(enough)] -= enough
        place = np.flatnonzero(maybe & (np.cumsum(marks[:-1]) > 0))
        where = np.minimum(np.searchsorted(self.gram, gram[place]), len(self.gram) - 1)
        sure = self.gram[where] == gram[place]
        place, where = place[sure], where[sure]
        before = np.concatenate([[0], np.cumsum(self.end[where] - self.first[where])])
        if before[-1] <= PAIRS:
            return self._bands(place, where)
        # Frequent q-grams: a stretch at a time. Two stretches share `reach` bytes, so one of them holds all hits of a match.
        found, start = [], 0
        while True:
            stop = max(int(np.searchsorted(before, before[start] + PAIRS, "right")) - 1, int(np.searchsorted(place, place[start] + self.reach)))
            found.append(self._bands(place[start:stop], where[start:stop]))
            if stop >= len(place):
                return tuple(np.concatenate(x) for x in zip(*found))
            start = int(np.searchsorted(place, place[stop] - self.reach, "right"))

    def _bands(self, place: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and first diagonals of the bands in which the q-grams `where` at `place` reach a window's bound."""
        many = self.end[where] - self.first[where]
        entry = np.repeat(self.first[where] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        window, diagonal = self.of[entry], np.repeat(place, many) - self.at[entry]
        step = self.edits[window] + 1
        # Bands of 2 * step diagonals from every multiple of step: any step + 1 neighbours lie in one of them.
        band = diagonal // step
        key = np.concatenate([window * (1 << 40) + band + (1 << 30), window * (1 << 40) + band - 1 + (1 << 30)])
        # A position may hold a gram that the window has twice in the band; it counts once for each, which only adds candidates.
        key, count = np.unique(key, return_counts=True)
        window, band = key >> 40, (key & ((1 << 40) - 1)) - (1 << 30)
        good = count >= self.need[window]
        window, band = window[good], band[good]
        return window, band * (self.edits[window] + 1)

    def align(self, data: np.ndarray, window: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least edits of each window against the text within its band of diagonals, and where in data the match ends."""
        step = self.edits[window] + 1
        low = diagonal - step  # a match may leave the band of its q-grams by its own edits
        span = int((4 * step).max()) + 1
        pad = WINDOW + span + 1
        text = np.concatenate([np.zeros(pad, np.uint8), data, np.zeros(pad + WINDOW, np.uint8)])
        cost = np.zeros((len(window), span), np.int32)  # a match begins anywhere in the band
        across = np.arange(span, dtype=np.int32)
        best = np.full(len(window), 1 << 20)
        end = np.zeros(len(window), np.int64)
        for row in range(int(self.size[window].max())):
            at = low + row + pad
            cell = text[np.clip(at[:, None] + across, 0, len(text) - 1)]
            match = cell != self.padded[window, row][:, None]
            moved = np.append(cost[:, 1:], np.full((len(window), 1), 1 << 20, np.int32), axis=1) + 1
            new = np.minimum(cost + match, moved)
            cost = np.minimum.accumulate(new - across, axis=1) + across
            done = np.flatnonzero(self.size[window] == row + 1)
            if len(done):
                least = cost[done].argmin(axis=1)
                best[done] = cost[done, least]
                end[done] = low[done] + row + 1 + least
        return best, np.clip(end, 0, len(data))


def _short(index: Index, data: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(window, 0, end) of all short items that stand in folded bytes as whole words."""
    if not index.short or not len(data):
        return
    edge = np.concatenate([[True], (data == 32) | (data == 0), [True]])  # edge[k]: whether a word may begin at k or end before it
    begins = np.flatnonzero(edge[:-2] & ~edge[1:-1])
    for size, (known, window) in index.short.items():
        at = begins[begins + size <= len(data)]
        at = at[edge[at + size + 1]]
        if not len(at):
            continue
        said = np.ascontiguousarray(data[at[:, None] + np.arange(size)]).view(f"S{size}").ravel()
        kinds, inverse = np.unique(said, return_inverse=True)
        names = {bytes(k): n for n, k in enumerate(kinds)}
        ends = [np.empty(0, np.int64)] * len(kinds)
        for text, w in zip(known, window.tolist()):
            if (n := names.get(bytes(text))) is not None:
                if not len(ends[n]):
                    ends[n] = at[inverse == n] + size
                yield from ((w, 0, e) for e in ends[n].tolist())


def _search(index: Index, data: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(window, edits, end) of all windows found in folded bytes."""
    window, diagonal = index.candidates(data)
    for k in range(0, len(window), 4096):
        w = window[k : k + 4096]
        edits, end = index.align(data, w, diagonal[k : k + 4096])
        good = edits <= index.edits[w]
        yield from zip(w[good].tolist(), edits[good].tolist(), end[good].tolist())
    yield from _short(index, data)


#: For each (row of a batch, item): [(edits, end in the folded text, block, window)] of the windows found.
Hits = dict[tuple, list]


def _hits(index: Index, part: pa.RecordBatch, hits: Hits, block: int = 0) -> None:
    """Adds all windows found in the column _text to hits. Texts are searched together, up to PART bytes at a time."""
    gap = np.zeros(index.reach + Q, np.uint8)
    flat, at = flat_text(part.column("_text"))
    held, owner, lengths, size = [], [], [], 0

    def flush() -> None:
        bounds = np.cumsum(lengths) - np.array(lengths)
        for w, edits, end in _search(index, np.concatenate(held)):
            k = int(np.searchsorted(bounds, max(end - 1, 0), "right")) - 1
            row, start, low, high = owner[k]
            place = end - int(bounds[k])
            # A short item at the cut of a long text is a whole word only where the next part has it, too.
            if w < len(index.size) or low <= place - 1 and place <= high:
                hits.setdefault((row, index.item[w]), []).append((edits, place + start, block, w))
        held.clear(), owner.clear(), lengths.clear()

    for row in range(part.num_rows):
        data = folded(flat[at[row] : at[row + 1]])
        for start in range(0, max(len(data) - OVERLAP, 1), PART - OVERLAP):
            piece = data[start : start + PART]
            held.extend((piece, gap))
            # Ends of short items that count: not those that touch the cut on either side.
            owner.append((row, start, 2 * Q if start else 0, len(piece) if start + PART >= len(data) else len(piece) - 1))
            lengths.append(len(piece) + len(gap))
            size += lengths[-1]
            if size >= PART:
                flush()
                size = 0
    if held:
        flush()


@lru_cache(64)
def _index(uri: str) -> Index:
    return load_object(uri)


def _indexes(benchmark: DataFrame, item_id: str, item_text: str, block: int) -> Callable[[], Iterator[Index]]:
    """What gives a task the benchmark's indexes, one after the other."""
    spark = benchmark.sparkSession
    kind = benchmark.schema[item_id].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("item_id").to_pylist(), batch.column("item_text")):
                for first, data, ends in pieces(trimmed(text.as_py())):
                    row = [[key], [first], [data.tobytes()], [ends], [len(data)]]
                    types = [batch.schema.field("item_id").type, pa.int64(), pa.binary(), pa.bool_(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], ["item_id", "first", "data", "ends", "size"])

    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("item_text"))
    cuts = written(items.mapInArrow(cut, f"item_id {kind}, first bigint, data binary, ends boolean, size bigint"), "benchmark")
    blocks = -(-int(cuts.agg(F.sum("size")).first()[0] or 0) // block)
    names = ("item_id", "first", "data", "ends")
    if blocks <= 1:
        shared = spark.sparkContext.broadcast(Index([tuple(r) for r in cuts.select(*names).orderBy(*names).collect()]))
        return lambda: iter([shared.value])
    folder = shared_folder(spark, "indexes")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                held.setdefault(row["_block"], []).append(tuple(row[n] for n in names))
        for k in sorted(held):
            uri = f"{folder}/{k}-{uuid.uuid4().hex}"
            save_object(uri, Index(sorted(held.pop(k), key=lambda r: (str(r[0]), r[1]))))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([uri])], ["block", "uri"])

    dealt = cuts.select(*names).withColumn("_block", F.pmod(F.xxhash64("item_id", "first", "data"), F.lit(blocks)))
    files = written(dealt.repartition(blocks, "_block").mapInArrow(build, "block bigint, uri string"), "blocks")
    uris = [r.uri for r in files.orderBy("block").collect()]
    return lambda: map(_index, uris)


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, n_windows, edits, ends): pairs of a document and an item of which it holds at least a window.

    n_windows: how many of the item's windows it holds; edits: of the best of them; ends: where in the folded text
    the best one ends. A null text or item is empty; an empty item matches nothing. Rows with the same doc_id count as
    one document, and so do all rows without one. An empty table on either side gives no row. Other columns of both
    tables, whatever their names, are not touched.
    """
    bound_batches(docs.sparkSession)
    keys = [docs.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("_text"))
    indexes = _indexes(benchmark, item_id, item_text, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.int64() if keys[1] == "bigint" else pa.int32() if keys[1] == "int" else pa.string()
        for batch in batches:
            for part in slices(batch, "_text", 2 << 20):
                hits: Hits = {}
                for k, index in enumerate(indexes()):
                    _hits(index, part, hits, k)
                if hits:
                    ids = part.column("doc_id").take(pa.array([r for r, _ in hits], pa.int64()))
                    best = [min(h) for h in hits.values()]
                    numbers = [[len({(b, w) for _, _, b, w in h}) for h in hits.values()], [b[0] for b in best], [b[1] for b in best]]
                    yield pa.RecordBatch.from_arrays([ids, pa.array([i for _, i in hits], kind), *(pa.array(c, pa.int64()) for c in numbers)], ["doc_id", "item_id", "n_windows", "edits", "ends"])

    found = rows.mapInArrow(returned(run), f"doc_id {keys[0]}, item_id {keys[1]}, n_windows bigint, edits bigint, ends bigint")
    return found.groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.min("edits").alias("edits"), F.min_by("ends", F.struct("edits", "ends")).alias("ends"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """docs without those that hold a benchmark window, rows and columns as they are: a filter, without a shuffle.

    Each row is judged by its own text, whatever its id; a null text is empty and stays.
    """
    bound_batches(docs.sparkSession)
    column = unused(docs.columns, "_text")
    rows = docs.withColumn(column, F.col(text).cast("string"))
    indexes = _indexes(benchmark, item_id, item_text, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, 2 << 20):
                only = pa.RecordBatch.from_arrays([part.column(column)], ["_text"])
                stay, hits = np.ones(part.num_rows, bool), {}
                for index in indexes():
                    _hits(index, only, hits)
                stay[[row for row, _ in hits]] = False
                yield part.filter(pa.array(stay))

    return rows.mapInArrow(returned(run), rows.schema).select(*[F.col(f"`{c}`") for c in docs.columns])
