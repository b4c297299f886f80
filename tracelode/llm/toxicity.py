"""Toxicity by class-conditional Kneser-Ney models: how much likelier a text's words are among toxic texts than among ordinary ones.

Both classes have an interpolated Kneser-Ney model of order two over lower-cased words. A pair counts once a text, so
repeated lines weigh nothing. A class's lower order counts the distinct words that a word follows there, less the
discount; what that leaves, and STRENGTH times as much as all of it, goes to the shared order: the same counts over both
classes together, one more for any unknown word. So a word that one class has rarely takes its probability from both
classes alike, and the ratio of its likelihoods stays near one.

    P_c(w)     = (max(k_c(w) - D, 0) + (D T_c + STRENGTH K_c) P(w)) / (K_c + STRENGTH K_c)
    P_c(w | v) = (max(n_c(v w) - D_2, 0) + (R_c(v) + n_c(v) + 1) P_c(w)) / (2 n_c(v) + 1)

where k_c(w) are the words before w in class c, K_c and T_c their sum and the words that have any, n_c counts pairs, and
R_c(v) is what the discount D_2 takes from those of v.

A text is compared by length-normalised log ratios: over the whole text in both orders, the mean of the evidence beyond
one in the lower order, and the strongest single expression, which length can't dilute. A logistic curve over the four,
fitted on texts that the model it takes them from has not seen, makes them a score.

Scale: labels of at most `sample` documents are learned, chosen by a hash of their ids, and are broadcast as ids; so the
model is bounded by the sample and lies in the shared folder, where workers map it to memory. Documents are read twice,
for the sample and to be scored; only the sample's texts and pairs are shuffled.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.llm._shared import bound_batches, discard, file_system, load_object, returned, save_object, shared_folder, slices, written

#: Labelled documents that are learned from, at most.
SAMPLE = 10_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DISCOUNT, DISCOUNT_PAIRS, STRENGTH = 0.75, 3.0, 1.0
#: Evidence up to here, in nats a word, is what ordinary words have by chance.
CHANCE = 1.0
#: What stands before a text's first word, and a factor that mixes two hashes.
START, MIX = np.uint64(1), np.uint64(0x9E3779B97F4A7C15)
SEED = 7
#: Pull of the logistic curve's slopes towards zero, in documents.
RIDGE = 1.0
FEATURES = ("pairs", "words", "evidence", "strongest")


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words and the n + 1 offsets of the texts."""
    digest, found, ends = xxhash.xxh64_intdigest, [], [0]
    for text in texts:
        found += [digest(w, SEED) for w in WORD.findall((text or "").lower())]
        ends.append(len(found))
    return np.array(found, np.uint64), np.array(ends, np.int64)


def paired(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word what comes before it, and one number for both."""
    first = np.concatenate([[START], words[:-1]]).astype(np.uint64)[: len(words)]
    first[ends[:-1][ends[:-1] < len(words)]] = START
    return first, ((first ^ (first >> np.uint64(29))) * MIX) ^ words


def _place(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Model:
    """Log ratios (toxic over ordinary): of known pairs, of words, of words before others for pairs that aren't known."""

    pairs: np.ndarray
    of_pair: np.ndarray
    words: np.ndarray
    of_word: np.ndarray
    before: np.ndarray
    of_before: np.ndarray
    unknown: float

    @classmethod
    def of(cls, v: np.ndarray, w: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray) -> Model:
        """From distinct pairs (v, w) and the texts of either class that have them."""
        seen = (ordinary > 0) | (toxic > 0)
        v, w, counts = v[seen], w[seen], [c[seen].astype(float) for c in (ordinary, toxic)]
        words, word = np.unique(w, return_inverse=True)
        before, at = np.unique(v, return_inverse=True)
        total = np.bincount(word, minlength=len(words)) / (len(w) + 1)
        low, rest, high, left = [], [], [], []
        for n in counts:
            k = np.bincount(word, n > 0, len(words))
            # A class without words has the shared order's probabilities.
            mass = (DISCOUNT * (k > 0).sum() + STRENGTH * k.sum()) or 1.0
            low.append((np.maximum(k - DISCOUNT, 0) + mass * total) / ((1 + STRENGTH) * k.sum() or 1.0))
            rest.append(mass / ((1 + STRENGTH) * k.sum() or 1.0))
            whole, taken = np.bincount(at, n, len(before)), np.bincount(at, np.minimum(n, DISCOUNT_PAIRS), len(before))
            left.append((taken + whole + 1) / (2 * whole + 1))
            high.append(np.maximum(n - DISCOUNT_PAIRS, 0) / (2 * whole + 1)[at] + left[-1][at] * low[-1][word])
        key = ((v ^ (v >> np.uint64(29))) * MIX) ^ w
        order = np.argsort(key)
        ratio = lambda two: np.log(two[1] / two[0])
        return cls(key[order], ratio(high)[order].astype(np.float32), words, ratio(low).astype(np.float32), before, ratio(left).astype(np.float32), float(ratio(rest)))

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Of each text FEATURES; zeros without a word."""
        words, ends = words_of(texts)
        out = np.zeros((len(texts), len(FEATURES)))
        if not len(words):
            return out
        v, key = paired(words, ends)
        at, known = _place(self.words, words)
        low = np.where(known, self.of_word[at] if len(self.words) else 0, self.unknown)
        at, known = _place(self.before, v)
        high = low + np.where(known, self.of_before[at] if len(self.before) else 0, 0)
        at, known = _place(self.pairs, key)
        high = np.where(known, self.of_pair[at] if len(self.pairs) else 0, high)
        full = np.flatnonzero(np.diff(ends))
        first, size = ends[:-1][full], np.diff(ends)[full]
        for k, part in enumerate((high, low, np.maximum(low - CHANCE, 0))):
            out[full, k] = np.add.reduceat(part, first) / size
        out[full, 3] = np.maximum.reduceat(low, first)
        return out


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Slopes and a last offset of P(y = 1) over columns of x, by Newton's method with RIDGE on slopes of unit spread."""
    spread = np.maximum(x.std(axis=0), 1e-9)
    rows = np.column_stack([x / spread, np.ones(len(x))])
    pull = np.array([RIDGE] * x.shape[1] + [1e-6])
    at = np.zeros(rows.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ at, -30, 30)))
        step = np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + np.diag(pull + 1e-9), rows.T @ (y - p) - pull * at)
        at = at + step
        if np.abs(step).max() < 1e-9:
            break
    at[:-1] /= spread
    return at


@dataclass
class Fitted:
    """The model's file, the curve over FEATURES, and the share of toxic labels, which is the score where a class is missing."""

    uri: str | None
    curve: np.ndarray | None
    share: float


@lru_cache(maxsize=3)
def _model(uri: str) -> Model:
    return load_object(uri)


def _taught(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, sample: int) -> DataFrame:
    """(_text, _y, _half): a text of each learned document, its label, and which half of the texts it is in."""
    y = F.col(label).cast("int")
    some = labels.where(F.col(doc_id).isNotNull() & y.isin(0, 1)).groupBy(F.col(doc_id).alias("_id")).agg(F.max(y).alias("_y"))
    some = some.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    digest = F.md5(F.coalesce(F.col("_text"), F.lit("")).cast("binary"))
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text")).join(F.broadcast(some), "_id")
    return texts.groupBy("_id").agg(F.min_by("_text", digest).alias("_text"), F.first("_y").alias("_y")).select("_text", "_y", (F.crc32(F.coalesce("_text", F.lit("")).cast("binary")) % 2).cast("int").alias("_half"))


def _pairs(taught: DataFrame) -> DataFrame:
    """(v, w, a0, b0, a1, b1): the texts of each label (a: ordinary, b: toxic) and half that have a pair of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                words, ends = words_of(part.column("_text").to_pylist())
                v, key = paired(words, ends)
                kind = np.asarray(part.column("_half")) * 2 + np.asarray(part.column("_y"))
                owner = np.repeat(np.arange(len(kind)), np.diff(ends))
                # Once a text, then all texts of the slice together.
                _, once = np.unique((key ^ (key >> np.uint64(31))) * MIX + owner.astype(np.uint64), return_index=True)
                _, first, same = np.unique(key[once], return_index=True, return_inverse=True)
                counts = [np.bincount(same, kind[owner[once]] == k, len(first)).astype(np.int32) for k in range(4)]
                at = once[first]
                yield pa.RecordBatch.from_arrays([pa.array(v[at].view(np.int64)), pa.array(words[at].view(np.int64)), *map(pa.array, counts)], ["v", "w", "a0", "b0", "a1", "b1"])

    found = taught.mapInArrow(returned(run), "v bigint, w bigint, a0 int, b0 int, a1 int, b1 int")
    return found.groupBy("v", "w").agg(*[F.sum(c).cast("int").alias(c) for c in ("a0", "b0", "a1", "b1")])


def _models(pairs: DataFrame) -> list[str]:
    """Files of three models over the written table of pairs: of its second half, of its first, of both. One task each: the table is bounded by the sample."""
    spark, table, folder = pairs.sparkSession, pairs._folder, shared_folder(pairs.sparkSession, "toxicity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for leave in batch.column(0).to_pylist():
                fs, path = file_system(table)
                rows = ds.dataset(path, filesystem=fs, format="parquet", exclude_invalid_files=False).to_table()
                got = {c: rows.column(c).to_numpy() for c in rows.column_names}
                ordinary, toxic = (sum(got[f"{c}{h}"] for h in (0, 1) if h != leave) for c in "ab")
                # Named by the attempt: only the committed row's file is read.
                uri = f"{folder}/{leave}-{uuid.uuid4().hex}"
                save_object(uri, Model.of(got["v"].view(np.uint64), got["w"].view(np.uint64), ordinary, toxic))
                yield pa.RecordBatch.from_arrays([pa.array([leave], pa.int64()), pa.array([uri])], ["leave", "uri"])

    made = spark.range(0, 3, 1, 3).mapInArrow(returned(run), "leave bigint, uri string").collect()
    return [r.uri for r in sorted(made, key=lambda r: r.leave)]


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Fitted:
    """Learns from labels (doc_id, label 0 or 1) of the documents that have them.

    A row without id or with another label teaches nothing; an id with both labels is toxic; of an id with several texts
    the one of the least digest is learned. With labels of one class or none, every score is the share of toxic ones (0
    of none). Other columns, whatever their names, are not touched.
    """
    bound_batches(docs.sparkSession)
    taught = written(_taught(docs, labels, doc_id, text, label, sample), "taught")
    n, toxic = taught.agg(F.count("*"), F.coalesce(F.sum("_y"), F.lit(0))).first()
    if toxic in (0, n):
        discard(taught)
        return Fitted(None, None, toxic / n if n else 0.0)
    pairs = written(_pairs(taught), "pairs")
    files = _models(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half = np.asarray(batch.column("_half"))
            for k in (0, 1):
                for part in slices(batch.filter(pa.array(half == k)), "_text"):
                    found = _model(files[k]).features(part.column("_text").to_pylist())
                    yield pa.RecordBatch.from_arrays([part.column("_y"), *[pa.array(c) for c in found.T]], ["_y", *FEATURES])

    # At most `sample` rows of five numbers.
    seen = taught.mapInArrow(returned(run), "_y int, " + ", ".join(f"{c} double" for c in FEATURES)).toPandas()
    seen = seen.sort_values(["_y", *FEATURES])
    curve = logistic(seen[list(FEATURES)].to_numpy(), seen["_y"].to_numpy(float))
    discard(taught, pairs)
    return Fitted(files[2], curve, toxic / n)


def scored(docs: DataFrame, fitted: Fitted, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) for each row of docs: the probability of label 1, and whether it reaches the threshold (1 or 0).

    A null text counts as empty; texts without a word have the score of no evidence. Repeated rows and equal texts get
    equal scores; an empty table gives an empty one. Nothing but the text is looked at.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                score = np.full(part.num_rows, fitted.share)
                if fitted.uri:
                    found = _model(fitted.uri).features(part.column("_text").to_pylist())
                    score = 1 / (1 + np.exp(-np.clip(found @ fitted.curve[:-1] + fitted.curve[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(returned(run), f"doc_id {kind}, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
