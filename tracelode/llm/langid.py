"""Language ID from per-language unigrams over a fixed piece vocabulary, all segmentations summed.

A text's evidence is its runs of letters, lower-cased. Each run is a word with the vocabulary's word mark in front; its
probability in a language is the sum over all its segmentations into pieces of the product of piece probabilities, by
the forward algorithm. A letter outside the vocabulary is a piece of its own. Piece probabilities come from expected
counts (forward-backward), a few rounds from a uniform start. Runs of up to SHORT letters are summed as products, longer
ones, of any length, as logarithms: the same numbers.

Scale: the model has a number for each piece and language, however large the corpus is. Texts are read once, without a
shuffle; a worker keeps the values of up to CACHE distinct words between batches.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.llm._shared import bound_batches, discard, returned, slices, unused, written

#: Letters of a run whose products stay within doubles.
SHORT = 40
#: Training documents, by hash, at most about so many, a like share for each language; what they teach is one number for each piece and language.
SAMPLE = 20_000
ROUNDS = 3
#: Distinct words, and their letters, that a worker keeps; numbers of a lattice that it computes at a time.
CACHE, CACHE_LETTERS, CELLS = 150_000, 4_000_000, 1_000_000
#: Languages that a model learns unless fit() is told otherwise: it has 22,000 or so numbers for each.
LANGUAGES = 1000
MARK = "▁"
#: Keeps products of up to SHORT + 1 letters within doubles; cancels out between languages.
LIFT = 16.0
LETTERS = re.compile(r"[^\W\d_]+")


def letter_runs(text: str) -> list[str]:
    runs = LETTERS.findall(text.lower())
    if not "".join(runs).isalpha():  # fractions, raised digits and the like are no letters
        runs = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    return runs


def batched(words: list[str], wide: int) -> Iterator[list[int]]:
    """Places of the words in batches of short or of long ones, of about CELLS / wide letters (wide: 8 at least); a longer word comes alone."""
    for chosen in ([k for k, w in enumerate(words) if len(w) <= SHORT], [k for k, w in enumerate(words) if len(w) > SHORT]):
        held, letters = [], 0
        for k in chosen:
            if held and (letters + len(words[k]) + 2) * max(wide, 8) > CELLS:
                yield held
                held, letters = [], 0
            held.append(k)
            letters += len(words[k]) + 2
        if held:
            yield held


class Lattice:
    """Where pieces of a vocabulary lie in words."""

    def __init__(self, pieces: list[str]):
        self.pieces = sorted({p for p in pieces if p and LETTERS.fullmatch(p.replace(MARK, "a")) and MARK not in p[1:] and p == p.lower()})
        self.unknown = len(self.pieces)
        self.most = max(map(len, self.pieces), default=0)
        hashed = np.array([self._hash(p) for p in self.pieces], np.uint64)
        self.order = np.argsort(hashed)
        self.hashed = hashed[self.order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(hashed >> np.uint64(44)).astype(np.int64)] = True

    @staticmethod
    def _step(value, code):
        value = (value ^ code) * np.uint64(0x9E3779B97F4A7C15)
        return value ^ (value >> np.uint64(29))

    def _hash(self, piece: str) -> np.uint64:
        with np.errstate(over="ignore"):
            value = np.uint64(0)
            for c in piece:
                value = self._step(value, np.uint64(ord(c)))
            return (value + np.uint64(len(piece))) * np.uint64(0xD6E8FEB86659FD93)

    def edges(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """start node, end node, piece of all edges, in order of the end's place in its word; the bounds of places; each word's nodes (first, last)."""
        marked = [MARK + w for w in words]
        code = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
        size = np.fromiter(map(len, marked), np.int64, len(words))
        first = np.cumsum(size) - size
        word = np.repeat(np.arange(len(words)), size)
        place = np.arange(len(code)) - first[word]
        left = size[word] - place
        found = []
        value, at, single = np.zeros(len(code), np.uint64), np.arange(len(code)), np.zeros(len(code), bool)
        for length in range(1, max(self.most, 1) + 1):
            longer = left[at] >= length
            at, value = at[longer], value[longer]
            if not len(at):
                break
            value = self._step(value, code[at + length - 1])
            key = (value + np.uint64(length)) * np.uint64(0xD6E8FEB86659FD93)
            likely = np.flatnonzero(self.maybe[(key >> np.uint64(44)).astype(np.int64)])
            if len(self.hashed) and len(likely):
                where = np.minimum(np.searchsorted(self.hashed, key[likely]), len(self.hashed) - 1)
                sure = self.hashed[where] == key[likely]
                starts = at[likely[sure]]
                found.append((starts, np.full(len(starts), length), self.order[where[sure]]))
                if length == 1:
                    single[starts] = True
        alone = np.flatnonzero(~single)
        found.append((alone, np.ones(len(alone), np.int64), np.full(len(alone), self.unknown)))
        start, length, piece = (np.concatenate(x) for x in zip(*found))
        node = start + word[start]
        end_place = place[start] + length
        order = np.lexsort((node, node + length, end_place))
        bounds = np.searchsorted(end_place[order], np.arange(1, size.max(initial=0) + 2))
        return node[order], (node + length)[order], piece[order], bounds, first + np.arange(len(words)), size

    def forward(self, words: list[str], prob: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language; prob has a row for each piece, the last for unknown letters."""
        out = np.empty((len(words), prob.shape[1]))
        for at in batched(words, prob.shape[1]):
            own = [words[k] for k in at]
            start, end, piece, bounds, first, size = self.edges(own)
            if len(own[0]) > SHORT:
                for low in range(0, prob.shape[1], 16):  # so that a very long word's lattice stays small, however many languages there are
                    logs = self._log_alpha(start, end, np.log(prob[:, low : low + 16])[piece], bounds, first, size)
                    out[at, low : low + 16] = logs[first + size]
            else:
                out[at] = np.log(self._alpha(start, end, piece, bounds, first, size, prob)[first + size]) - (size * np.log(LIFT))[:, None]
        return out

    def _alpha(self, start, end, piece, bounds, first, size, prob) -> np.ndarray:
        alpha = np.zeros((int(size.sum()) + len(size), prob.shape[1]))
        alpha[first] = 1
        lift = LIFT ** (end - start)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if a == b:
                continue
            part = alpha[start[a:b]] * prob[piece[a:b]] * lift[a:b, None]
            cut = np.flatnonzero(np.concatenate([[True], end[a + 1 : b] != end[a : b - 1]]))
            alpha[end[a:b][cut]] = np.add.reduceat(part, cut, axis=0)
        return alpha

    def _log_alpha(self, start, end, logs, bounds, first, size) -> np.ndarray:
        """The same as logarithms; logs: of each edge's probability, a column for each language."""
        alpha = np.full((int(size.sum()) + len(size), logs.shape[1]), -np.inf)
        alpha[first] = 0
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if a == b:
                continue
            part = alpha[start[a:b]] + logs[a:b]
            cut = np.flatnonzero(np.concatenate([[True], end[a + 1 : b] != end[a : b - 1]]))
            alpha[end[a:b][cut]] = np.logaddexp.reduceat(part, cut, axis=0)
        return alpha

    def expected(self, words: list[str], counts: np.ndarray, prob: np.ndarray) -> np.ndarray:
        """Expected piece counts of words that occur counts times; prob of one language, a row for each piece."""
        out = np.zeros(self.unknown + 1)
        for at in batched(words, 1):
            own = [words[k] for k in at]
            start, end, piece, bounds, first, size = self.edges(own)
            logs = np.log(prob[piece])
            backwards = list(zip(bounds[:-1][::-1].tolist(), bounds[1:][::-1].tolist()))
            if len(own[0]) > SHORT:
                alpha = self._log_alpha(start, end, logs[:, None], bounds, first, size)[:, 0]
                beta = np.full(len(alpha), -np.inf)
                beta[first + size] = np.log(counts[at]) - alpha[first + size]
                for a, b in backwards:
                    np.logaddexp.at(beta, start[a:b], logs[a:b] + beta[end[a:b]])
                out += np.bincount(piece, np.exp(alpha[start] + logs + beta[end]), self.unknown + 1)
                continue
            alpha = self._alpha(start, end, piece, bounds, first, size, prob[:, None])[:, 0]
            weight = prob[piece] * LIFT ** (end - start)
            beta = np.zeros(len(alpha))
            beta[first + size] = counts[at] / alpha[first + size]
            for a, b in backwards:
                np.add.at(beta, start[a:b], weight[a:b] * beta[end[a:b]])
            out += np.bincount(piece, alpha[start] * weight * beta[end], self.unknown + 1)
        return out


def sentencepieces(path: str) -> list[str]:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_byte(k) or model.is_unknown(k))]


def fit(
    labelled: DataFrame, pieces: list[str], text: str = "text", lang: str = "lang", sample: int = SAMPLE, rounds: int = ROUNDS, smooth: float = 0.05, languages: int = LANGUAGES
) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities (a row for each piece and one for unknown letters, a column for each language).

    Learns from rows with a lang, at most about `sample` of them. Each language has an equal share of these, so that a
    rare one isn't lost beside a frequent one; rows are chosen by a hash of the text. Of more than `languages` labels
    those with the most rows are learned, the first by name of equal ones; `languages` bounds the model. A null text is
    empty and teaches nothing; repeated rows count each. No row with a lang: no language.
    """
    bound_batches(labelled.sparkSession)
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("_text"))
    sizes = dict(tuple(r) for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages + 1).collect())
    if len(sizes) > languages:
        sizes = dict(list(sizes.items())[:languages])
        rows = rows.where(F.col("lang").isin(list(sizes)))
    langs = sorted(sizes)
    if not langs:
        return [], np.ones((1, 0))
    if any(n > sample / len(langs) for n in sizes.values()):
        share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, sample / len(langs) / n))])
        rows = rows.where(F.pmod(F.xxhash64("_text", F.lit(7)), F.lit(1 << 40)) < share[F.col("lang")] * float(1 << 40))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                seen: dict[str, Counter] = {}
                for name, t in zip(part.column("lang").to_pylist(), part.column("_text").to_pylist()):
                    seen.setdefault(name, Counter()).update(letter_runs(t or ""))
                flat = [(name, w, n) for name, words in seen.items() for w, n in words.items()]
                if flat:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*flat))), ["lang", "word", "n"])

    words = rows.mapInArrow(returned(count), "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = written(words, "words")
    lattice = Lattice(pieces)
    prob = np.full((lattice.unknown + 1, len(langs)), 1 / (lattice.unknown + 1))
    for _ in range(rounds):
        shared = labelled.sparkSession.sparkContext.broadcast((lattice, langs, prob))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice, langs, prob = shared.value
            sums = np.zeros(prob.shape)
            for batch in batches:
                names = np.array(batch.column("lang").to_pylist(), object)
                all_words, n = np.array(batch.column("word").to_pylist(), object), batch.column("n").to_numpy()
                for k, name in enumerate(langs):
                    own = names == name
                    if own.any():
                        sums[:, k] += lattice.expected(all_words[own].tolist(), n[own].astype(float), prob[:, k])
            at, k = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(k), pa.array(sums[at, k])], ["piece", "k", "n"])

        sums = np.zeros(prob.shape)
        for piece, k, n in words.mapInArrow(returned(expect), "piece bigint, k bigint, n double").groupBy("piece", "k").agg(F.sum("n")).collect():
            sums[piece, k] = n
        prob = (sums + smooth) / (sums + smooth).sum(axis=0)
        shared.unpersist()
    discard(words)
    return langs, prob


def identify(docs: DataFrame, langs: list[str], prob: np.ndarray, pieces: list[str], doc_id: str = "doc_id", text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """(doc_id, lang_pred, score) and the columns `keep`: one row for each row of docs.

    score: the posterior of lang_pred, languages being equally likely before. A null text, one without a letter, or a
    model without languages gives `und` with score 0. Ties go to the first language by name. Columns of `keep` that are
    named like one of the three are left out; to keep them, put them in a struct. Other columns of docs are not touched.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((Lattice(pieces), langs, prob))
    own = ("doc_id", "lang_pred", "score")
    kept = [c for c in docs.select(*(keep or [])).columns] if keep else []
    kept = [c for c, name in zip(keep or [], kept) if name.lower() not in own]
    column = unused(docs.select(*kept).columns if kept else [], "_text")
    rows = docs.select(F.col(doc_id).alias("doc_id"), *kept, F.col(text).cast("string").alias(column))
    names = [c for c in rows.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, langs, prob = shared.value
        known: dict[str, int] = {}
        values, letters = np.empty((0, len(langs))), 0
        for batch in batches:
            for part in slices(batch, column):
                runs = [letter_runs(t or "") for t in part.column(column).to_pylist()]
                if len(known) > CACHE or letters > CACHE_LETTERS or len(known) * len(langs) > CACHE_LETTERS:
                    known, values, letters = {}, values[:0], 0
                new = list(set().union(*runs).difference(known)) if langs else []
                if new:
                    known.update(zip(new, range(len(known), len(known) + len(new))))
                    letters += sum(map(len, new))
                    values = np.concatenate([values, lattice.forward(new, prob)])
                said, score = [], np.zeros(len(runs))
                for k, words in enumerate(runs):
                    if not words or not langs:
                        said.append("und")
                        continue
                    total = values[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(axis=0)
                    best = int(total.argmax())
                    said.append(langs[best])
                    score[k] = 1 / np.exp(np.maximum(total - total[best], -745)).sum()
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(said, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != column)
    return rows.mapInArrow(returned(run), f"{schema}, lang_pred string, score double")
