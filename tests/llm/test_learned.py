"""Toxicity, importance resampling and whitening against plain Python, and their edges."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import prose
from tracelode.llm import importance, queries, toxicity, whitening

SF = "/root/testdata/sf0.01"


# Toxicity


def plain_ratios(texts, labels):
    """The two orders' log ratios of a class-conditional model, by dictionaries."""
    pairs = [Counter(), Counter()]
    for text, y in zip(texts, labels):
        words = toxicity.WORD.findall((text or "").lower())
        pairs[y].update(set(zip(["^", *words], words)))
    both = set(pairs[0]) | set(pairs[1])
    shared, before, whole, taken = Counter(w for _, w in both), [], [], []
    for c in (0, 1):
        before.append(Counter(w for _, w in pairs[c]))
        whole.append(Counter()), taken.append(Counter())
        for (v, _), n in pairs[c].items():
            whole[c][v] += n
            taken[c][v] += min(n, 3)

    def low(c, w):
        k, kinds = sum(before[c].values()), len(before[c])
        mass = 0.75 * kinds + k
        return (max(before[c][w] - 0.75, 0) + mass * shared[w] / (len(both) + 1)) / (2 * k), mass / (2 * k)

    def word(w):
        (a, p), (b, q) = low(0, w), low(1, w)
        return math.log(b / a) if shared[w] else math.log(q / p)

    def pair(v, w):
        if (v, w) not in both:
            known = any(v in x for x in whole)
            left = [(taken[c][v] + whole[c][v] + 1) / (2 * whole[c][v] + 1) for c in (0, 1)]
            return word(w) + (math.log(left[1] / left[0]) if known else 0)
        p = [max(pairs[c][v, w] - 3, 0) / (2 * whole[c][v] + 1) + (taken[c][v] + whole[c][v] + 1) / (2 * whole[c][v] + 1) * low(c, w)[0] for c in (0, 1)]
        return math.log(p[1] / p[0])

    return word, pair


def test_ratios_equal_plain_counts():
    texts = ["a b a b c", "a b, A b. d", None, "", "b b b b", "e f a b", "a b c d", "é f é"] * 5 + ["x y z a b"]
    labels = [k % 3 == 0 for k in range(len(texts))]
    words, ends = toxicity.words_of(texts)
    v, _ = toxicity.paired(words, ends)
    owner = np.repeat(np.arange(len(texts)), np.diff(ends))
    rows = defaultdict(lambda: [0, 0])
    for a, b, k in {(int(a), int(b), int(k)) for a, b, k in zip(v, words, owner)}:
        rows[a, b][int(labels[k])] += 1
    keys = sorted(rows)
    model = toxicity.Model.of(*(np.array([k[i] for k in keys], np.uint64) for i in (0, 1)), *(np.array([rows[k][i] for k in keys]) for i in (0, 1)))
    word, pair = plain_ratios(texts, [int(y) for y in labels])
    for text in ["a b c", "b q", "q", "a c q r b", "x y z", "f é"]:
        ws = text.split()
        got = model.features([text, ""])
        lows, highs = [word(w) for w in ws], [pair(a, b) for a, b in zip(["^", *ws], ws)]
        wanted = [np.mean(highs), np.mean(lows), np.mean(np.maximum(np.array(lows) - 1, 0)), max(lows)]
        assert np.allclose(got[0], wanted, atol=1e-5) and not got[1].any()


def test_logistic_is_at_the_zero_of_its_gradient():
    dice = np.random.default_rng(3)
    x = dice.normal(size=(400, 3)) * [1, 10, 0.1]
    y = (dice.random(400) < 1 / (1 + np.exp(-(x @ [1, 0.2, -4] + 0.5)))).astype(float)
    at = toxicity.logistic(x, y)
    p = 1 / (1 + np.exp(-(x @ at[:-1] + at[-1])))
    spread = x.std(axis=0)
    assert np.allclose((x / spread).T @ (y - p), at[:-1] * spread, atol=1e-5) and abs((y - p).sum()) < 1e-4


def test_held_out_toxic_texts_are_found(spark):
    """Insults of few words in long ordinary texts, half of them not among the learned texts' insults' neighbours."""
    dice, rows, labels = random.Random(4), [], []
    for k in range(600):
        words, bad = prose(k, dice.choice((20, 200, 900))).split(), k % 4 == 0
        for _ in range(2 if bad else 0):
            words.insert(dice.randrange(len(words)), dice.choice(("vileword", "Foulword,", "NASTY")))
        rows.append((k, " ".join(words)))
        if k < 400:
            labels.append((k, int(bad)))
    docs, table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(docs, toxicity.fit(docs, table)).collect()}
    new = range(400, 600)
    assert all(got[k].predicted == (k % 4 == 0) for k in new) and all(0 <= got[k].score <= 1 for k in got)


def test_toxicity_of_given_tables(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op11_kneser_ney_toxicity(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p for y, p in held if not y) <= 2 and sum(p for y, p in held if y) >= 0.5 * sum(y for y, _ in held)


def test_toxicity_at_the_edges(spark):
    docs = spark.createDataFrame([(1, "a b", 0), (1, "a b", 0), (2, None, 1), (3, "", 2), (None, "a b", 3), (4, "mean word " * 60000, 4), (5, "mean", 5)], "doc_id bigint, text string, score int")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.scored(docs, toxicity.fit(docs, none)).collect()} == {(0.0, 0)}
    one = spark.createDataFrame([(1, 1), (4, 1), (9, 0), (None, 0), (3, None), (2, 7)], "doc_id bigint, toxic int")
    assert {r.score for r in toxicity.scored(docs, toxicity.fit(docs, one)).collect()} == {1.0}
    both = spark.createDataFrame([(1, 0), (3, 0), (4, 1), (4, 0), (5, 1)], "doc_id bigint, toxic int")
    fitted = toxicity.fit(docs, both)
    got = toxicity.scored(docs, fitted).collect()
    of = {r.doc_id: r.score for r in got}
    assert len(got) == 7 and of[1] == of[None] and of[2] == of[3] and toxicity.scored(docs.limit(0), fitted).count() == 0
    assert toxicity.fit(docs, both, sample=2).share in (0.0, 0.5, 1.0)


# Importance resampling


def plain_draw(docs, target, longest=1, buckets=10_000, least=20, percent=10, seed=2024):
    def grams(text):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
        return [b" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)], len(words)

    s, t = Counter(), Counter()
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            counts.update(zlib.crc32(g) % buckets for g in grams(text)[0])
    total, wanted = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (wanted + buckets))))
    rows = []
    for doc_id, text in docs:
        found, n = grams(text)
        weight = sum(gain(zlib.crc32(g) % buckets) for g in found)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted((str((*r[:4], ranks.get(id(r)))) for r in rows))


@pytest.mark.parametrize("longest, least, percent", [(1, 20, 10), (2, 3, 50), (3, 2, 100)])
def test_draw_equals_plain_python(spark, longest, least, percent):
    dice = random.Random(longest)
    docs = [(k, prose(k % 60, dice.choice((1, 2, 3, 19, 20, 40)))) for k in range(150)]
    docs += [(7, docs[7][1])] * 5 + [(None, docs[9][1]), (200, None), (201, ""), (202, "É é_É-9 " * 3000), (203, "\0a\0 b")]
    target = [prose(k, 30) for k in range(5)] + [None, ""]
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id bigint, text string, rank int, W string").repartition(3)
    got = importance.resampled(table, spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, least=least, percent=percent, buckets=97)
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_draw(docs, target, longest, 97, least, percent)


def test_cold_features_are_joined(spark, monkeypatch):
    """With no feature hot, with some, and with batches of a row, the draw is the same."""
    docs = [(k, prose(k, 30)) for k in range(40)]
    table, target = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(prose(3, 40),)], "text string")
    wanted = plain_draw(docs, [prose(3, 40)])
    for share, held in ((2.0, 1), (0.005, 50), (0.0, 1 << 18)):
        monkeypatch.setattr(importance, "HOT_SHARE", share)
        monkeypatch.setattr(importance, "HELD", held)
        assert sorted(str(tuple(r)) for r in importance.resampled(table, target).collect()) == wanted


def test_empty_tables_of_a_draw(spark):
    none, some = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    assert importance.resampled(none, some).count() == 0
    assert [(r.n_features, r.rank) for r in importance.resampled(some, none, least=0, percent=100).collect()] == [(3, 1)]


# Whitening


def exact(rows, k=4, scale=256):
    """(x by key, mean, eigenvalues, vectors, trace, n) by numpy."""
    fine = [(key, np.floor(np.array(v) * scale).astype(int)) for key, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.unique([x for _, x in fine], axis=0)
    cov = np.cov(fit.T, bias=True)
    e, q = np.linalg.eigh(cov)
    return fine, fit.mean(axis=0), e[::-1][:k], q[:, ::-1][:, :k], np.trace(cov), len(fit), fit.sum(axis=0)


def test_whitening_equals_eigenvectors(spark):
    dice = np.random.default_rng(8)
    data = dice.normal(size=(900, 40)) * np.linspace(1.0, 0.5, 40)
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(data)]
    rows += [(1000 + k, rows[0][1]) for k in range(300)] + [(2000, None), (2001, [None] + rows[1][1][1:]), (2002, [math.nan] + rows[1][1][1:]), (2003, [math.inf] + rows[1][1][1:]), (2004, []), (2005, [1.0])]
    fine, mean, e, q, trace, n, sums = exact([r for r in rows if r[0] != 2005])
    table = spark.createDataFrame([(*r, 5) for r in rows], "vec_id bigint, embedding array<double>, n int").repartition(4)
    got = whitening.whitened(table, block=8).collect()
    assert len(got) == 4 * len(fine) and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    by = defaultdict(dict)
    for r in got:
        by[r.vec_id][r.component] = r
    flip = {}
    for key, x in fine:
        for c in range(4):
            r, wanted = by[key][c + 1], (x - mean) @ q[:, c] / math.sqrt(e[c])
            flip.setdefault(c, np.sign(r.whitened * wanted))
            assert abs(r.whitened - flip[c] * wanted) < 1e-8 and abs(r.explained - e[c] / trace) < 1e-12
            assert r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums))


def test_block_iteration_restarts_and_finds_flat_spectra(monkeypatch):
    dice = np.random.default_rng(1)
    q = np.linalg.qr(dice.normal(size=(300, 300)))[0]
    for values in (np.linspace(1, 0.9, 300), np.r_[5, 5, 4, 3.999, np.ones(296)], np.r_[2, 1, np.zeros(298)], 0.9 ** np.arange(300)):
        monkeypatch.setattr(whitening, "KEPT", 64)
        v = (q * values) @ q.T
        found = whitening.components(lambda b: v @ b, 300, 4, values.sum())
        assert np.allclose(found.values, values[:4], atol=1e-10) and found.residuals.max() < 1e-9
        assert np.allclose(found.vectors.T @ found.vectors, np.eye(4), atol=1e-10)


def test_whitening_at_the_edges(spark):
    schema = "vec_id bigint, embedding array<float>, COMPONENT int"
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, None, 0), (2, [], 0)], schema)).count() == 0
    same = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (None, [1.0, 2.0], 0)], schema)).collect()
    assert len(same) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(1, 0, None, None, None)}
    two = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [-1.0, -0.0], 0), (3, [3e38, 1.0], 0)], schema)).collect()
    assert len(two) == 6
    line = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [-1.0, -2.0], 0)], schema)).collect()
    assert {(r.component, r.whitened is None) for r in line} == {(1, False), (2, True)} and {abs(r.whitened) for r in line if r.component == 1} == {1.0}
