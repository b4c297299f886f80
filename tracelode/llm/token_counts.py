"""Token counts by rank-synchronous merging of ragged arrays.

All new pre-tokens of a batch lie in one flat array of symbols with a sequence number each. A round finds every
sequence's lowest-ranked adjacent pair and merges all its occurrences, left ones first where they overlap, in all
sequences at once; a sequence without a ranked pair is done, and its surviving symbols are counted. A merge can
only make pairs of higher rank than its own, so this equals merging one pair at a time.

Scale: no shuffle; a worker keeps the counts of up to CACHE distinct pre-tokens between batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.llm._shared import bound_batches, slices
from tracelode.llm.pretokens import Learned, Splitter, byte_symbols

CACHE = 400_000
NONE = np.iinfo(np.int64).max


class Merges:
    """Ranks of symbol pairs; symbols are vocabulary ids."""

    def __init__(self, model: dict):
        vocab = model["model"]["vocab"]
        self.byte = np.full(256, -1, np.int64)
        for char, byte in byte_symbols().items():
            self.byte[byte] = vocab[char]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        self.span = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.span + vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), NONE)
        key = left * self.span + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NONE)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Symbols of each word after all merges."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        left = sizes.copy()
        symbol = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        rank = np.full(len(symbol), NONE)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self.rank(symbol[inner], symbol[inner + 1])
        while len(symbol):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            counts = np.diff(np.append(first, len(word)))
            lowest = np.minimum.reduceat(rank, first)
            busy = lowest < NONE
            left[word[first[~busy]]] = counts[~busy]
            keep = np.repeat(busy, counts)
            symbol, word, rank = symbol[keep], word[keep], rank[keep]
            if not len(symbol):
                break
            hit = rank == np.repeat(lowest[busy], counts[busy])
            # Of a run of overlapping hits every other one merges, from the left.
            at = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(hit & ~np.concatenate([[False], hit[:-1]]), at, -1))
            hit &= (at - run) % 2 == 0
            symbol[hit] = self.made[rank[hit]]
            stay = ~np.concatenate([[False], hit[:-1]])
            symbol, word, hit, rank = symbol[stay], word[stay], hit[stay], rank[stay]
            old = np.flatnonzero(hit | np.concatenate([hit[1:], [False]]))
            rank[old] = NONE
            old = old[old + 1 < len(word)]
            old = old[word[old] == word[old + 1]]
            rank[old] = self.rank(symbol[old], symbol[old + 1])
        return left


@lru_cache(1)
def _worker(path: str) -> tuple:
    splitter = Splitter(path)
    merges = Merges(splitter.model)

    def look(words: list) -> tuple[np.ndarray, np.ndarray]:
        plain = np.array([isinstance(w, str) for w in words])
        counts = np.ones(len(words), np.int64)
        if plain.any():
            counts[plain] = merges.count([w.encode() for w in words if isinstance(w, str)])
        return counts, np.empty(0, np.int64)

    return splitter, Learned(look, CACHE)


def token_counts(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens): one row for each row of docs. A null text is empty and has no token.

    tokenizer: the path of a byte-level BPE file, the same on all machines. Strings of its added tokens inside
    texts count as one token each, which is its library's default. Repeated rows are counted each; an empty table gives
    no row. Other columns of docs, whatever their names, are not touched.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, learned = _worker(tokenizer)
        for batch in batches:
            for part in slices(batch, "_text"):
                texts = [t or "" for t in part.column("_text").to_pylist()]
                words, at = learned(texts, split)
                ends = np.concatenate([[0], np.cumsum(learned.sizes[words])])[at]
                sizes = [len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(np.diff(ends))], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("_text")).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
