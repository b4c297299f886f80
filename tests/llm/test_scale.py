"""Hot keys, long texts and large tables of each operator: nothing is cut, and no task takes more than its share."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import SCHEMA, filled, ordered, prose
from tracelode.llm import _shared, context_tree, decontamination, langid, media, mixing, sharding, simhash
from tracelode.llm.queries import PIECES, tokenizer_path


@pytest.fixture(scope="module")
def pieces():
    return langid.sentencepieces(tokenizer_path(PIECES))


@pytest.mark.parametrize("kind", ["small sources", "no ids", "one row"])
def test_shards_have_no_hot_bucket(spark, monkeypatch, kind):
    """100,000 sources of a row, as many rows without an id, and one row as many times: no window takes over twice a bucket."""
    kept = {}

    def written(df, tag):
        kept[tag] = _shared.written(df, tag)
        return kept[tag]

    monkeypatch.setattr(sharding, "written", written)
    monkeypatch.setattr(sharding, "discard", lambda *tables: None)
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 1024)
    rows = spark.range(100_000)
    if kind == "small sources":
        rows = rows.select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.concat(F.lit("host"), "id").alias("source"))
    else:
        text = F.concat(F.lit("t"), "id") if kind == "no ids" else F.lit("t")
        rows = rows.select(F.lit(None).cast("bigint").alias("doc_id"), text.alias("text"), F.when(F.col("id") % 3 == 0, "a").alias("source"))
    got = sharding.stratified_shards(rows, 40)
    sizes = Counter(r.shard for r in got.select("shard").collect())
    assert len(sizes) == 40 and set(sizes.values()) == {2500}
    assert kept["shard-ranks"].groupBy("_c").count().agg(F.max("count")).first()[0] <= 2 * 1024
    counted = kept["shard-rows"]
    if kind == "one row":
        assert counted.count() == 2
    else:
        bits = (100_000 // 1024).bit_length()
        hashed = _shared.repeated_rows(counted, "_n", "_copy").select("source", F.shiftright(sharding.seeded_hash(11, F.col("doc_id"), F.col("text_crc32"), F.col("size"), F.col("_copy")), 60 - bits).alias("b"))
        assert hashed.groupBy("source", "b").count().agg(F.max("count")).first()[0] <= 2 * 1024


def test_prefix_sums_and_repeated_rows(spark):
    dice = random.Random(1)
    rows = [(k % 3, at, dice.randint(1, 9)) for k in range(3) for at in sorted(dice.sample(range(30_000), 60))]
    got = _shared.before(spark.createDataFrame(rows, "k int, at bigint, n bigint"), "at", "n", ("k",)).collect()
    assert all(r["_base"] == sum(n for k, at, n in rows if k == r.k and at < r.at) for r in got) and len(got) == len(rows)
    many = _shared.repeated_rows(spark.createDataFrame([("a", 20_000), ("b", 1), ("c", 8192), ("d", 8193)], "x string, n bigint"), "n", "k")
    assert {(r.x, r.n, r.k) for r in many.groupBy("x").agg(F.count("*").alias("n"), F.max("k").alias("k")).collect()} == {("a", 20_000, 19_999), ("b", 1, 0), ("c", 8192, 8191), ("d", 8193, 8192)}
    assert many.distinct().count() == many.count()


def test_objects_are_mapped_again(tmp_path):
    value = {"a": np.arange(1000), "b": [np.zeros(3, "S5"), "text"], "c": np.empty(0)}
    _shared.save_object(f"file://{tmp_path}/x", value)
    got = _shared.load_object(f"file://{tmp_path}/x")
    assert (got["a"] == value["a"]).all() and got["b"][1] == "text" and len(got["c"]) == 0


def test_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    class Conf:
        def __init__(self, values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Session:
        conf = Conf({})
        sparkContext = type("C", (), {"getConf": staticmethod(lambda: Conf({"spark.master": "spark://host:7077"}))})

    with pytest.raises(ValueError):
        _shared.shared_folder(Session(), "x")
    table = _shared.written(spark.range(3), "gone")
    folder = table._folder.removeprefix("file://")
    _shared.discard(table)
    import os

    assert not os.path.exists(folder)


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_of_95_bytes_are_found_at_all_offsets(seed):
    item = prose(seed, 40)
    data = decontamination.trimmed(item).tobytes()
    index = decontamination.Index([(1, at, part.tobytes(), ends) for at, part, ends in decontamination.pieces(np.frombuffer(data, np.uint8))])
    for at in range(len(data) - 95):
        text = np.frombuffer(b"qq zz " + data[at : at + 95] + b" vv ww", np.uint8)
        assert any(True for _ in decontamination._search(index, decontamination.folded(text))), at


def test_pieces_of_an_item_have_its_windows(monkeypatch):
    item = decontamination.trimmed(prose(3, 300))
    cut = lambda: decontamination.Index([(1, at, part.tobytes(), ends) for at, part, ends in decontamination.pieces(item)])
    whole = cut()
    monkeypatch.setattr(decontamination, "PIECE", 128)
    parts = cut()
    assert sorted(map(bytes, whole.padded)) == sorted(map(bytes, parts.padded)) and len(whole.padded) > 30


def test_long_text_over_part_bounds(spark, monkeypatch):
    """Short items and windows that lie across the cuts of a long text are found, and no part of a word is."""
    monkeypatch.setattr(decontamination, "PART", 600)
    item, short = prose(5, 14), "tiny item"
    index = decontamination.Index([(k, at, part.tobytes(), ends) for k, t in ((1, item), (2, short)) for at, part, ends in decontamination.pieces(decontamination.trimmed(t))])
    for lead in range(300, 660, 7):
        for text, wanted in ((item, {1}), (short, {2}), ("x" + short, set()), (short + "x", set())):
            batch = pa.RecordBatch.from_arrays([pa.array(["y" * lead + " " + text + " " + "z " * 500])], ["_text"])
            hits: dict = {}
            decontamination._hits(index, batch, hits)
            assert {k for _, k in hits} == wanted, (lead, text)


def test_stretches_of_a_long_text(monkeypatch):
    texts = ["a b", "  \t ", None, prose(1, 400) + " \n\t " + "w" * 300 + " end ", "z", "   " * 100, prose(2, 300)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["_text"])

    def keys():
        found: dict = {}
        for data, begin, rows, ends in context_tree.stretches(batch, 4):
            key, starts = context_tree.own(data, begin, 4)
            for row, part, end in zip(rows.tolist(), np.split(key, starts[1:]), ends.tolist()):
                found.setdefault(row, []).extend(part.tolist() + ([-1] if end else []))
        return found

    whole = keys()
    monkeypatch.setattr(context_tree, "STRETCH", 64)
    assert keys() == whole and len(whole) == len(texts) and all(v[-1] == -1 and v.count(-1) == 1 for v in whole.values())


def test_a_run_of_5000_letters(pieces):
    lattice = langid.Lattice(pieces)
    prob = np.random.default_rng(1).random((lattice.unknown + 1, 20)) / 1e4
    at = {p: k for k, p in enumerate(lattice.pieces)}
    word = langid.MARK + (prose(4, 900).replace(" ", ""))[:5000]
    plain = np.full((len(word) + 1, 20), -np.inf)
    plain[0] = 0
    for e in range(1, len(word) + 1):
        for s in range(max(0, e - lattice.most), e):
            k = at.get(word[s:e], lattice.unknown if e == s + 1 else None)
            if k is not None:
                plain[e] = np.logaddexp(plain[e], plain[s] + np.log(prob[k]))
    found = lattice.forward([word[1:], "the"], prob)
    assert np.allclose(found[0], plain[-1]) and np.isfinite(found).all()
    counts = lattice.expected([word[1:], "the"], np.array([2.0, 1.0]), prob[:, 0])
    lengths = np.array([*map(len, lattice.pieces), 1])
    assert counts @ lengths == pytest.approx(2 * 5001 + 4)


def test_training_against_plain_expectation(spark, pieces):
    """One round of training by summing over all segmentations of each word, then the most probable language."""
    texts = [("a", "tan tanta belt tan"), ("b", "gale gal le ale"), ("b", "legale q")]
    table = spark.createDataFrame([(k, t, x) for k, (x, t) in enumerate(texts)], "doc_id int, text string, lang string")
    langs, prob = langid.fit(table, pieces, rounds=1)
    lattice = langid.Lattice(pieces)
    at = {p: k for k, p in enumerate(lattice.pieces)}

    def cuts(word):
        if not word:
            yield []
        for e in range(1, len(word) + 1):
            k = at.get(word[:e], lattice.unknown if e == 1 else None)
            if k is not None:
                yield from ([k, *rest] for rest in cuts(word[e:]))

    for column, name in enumerate(langs):
        sums = np.full(lattice.unknown + 1, 0.05)
        for word in " ".join(t for x, t in texts if x == name).split():
            found = list(cuts(langid.MARK + word))
            weights = [(lattice.unknown + 1.0) ** -len(c) for c in found]
            for c, w in zip(found, weights):
                for k in c:
                    sums[k] += w / sum(weights)
        assert np.allclose(prob[:, column], sums / sums.sum())
    asked = ["tan belt", "gale", "ale tan q"]
    said = langid.identify(spark.createDataFrame(list(enumerate(asked)), "doc_id int, text string"), langs, prob, pieces).collect()
    for r in said:
        totals = [sum(math.log(sum(math.prod(prob[k, c] for k in cut) for cut in cuts(langid.MARK + w))) for w in asked[r.doc_id].split()) for c in range(2)]
        assert r.lang_pred == langs[int(np.argmax(totals))] and r.score == pytest.approx(1 / sum(math.exp(x - max(totals)) for x in totals))


def test_many_languages(spark, pieces):
    rows = [(k, f"{prose(k, 6)} wq{k}zx{k * 7}", f"l{k:03d}") for k in range(450)] + [(1000, "the", "l003"), (1001, "the", "l007"), (1002, "the", None)]
    table = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    langs, prob = langid.fit(table, pieces, rounds=1)
    assert len(langs) == 450 and prob.shape[1] == 450
    assert langid.identify(table, langs, prob, pieces).count() == len(rows)
    assert langid.fit(table, pieces, rounds=1, languages=2)[0] == ["l003", "l007"]


def test_cosine_hash_against_its_definition():
    """Shrunk to 32 x 32 by averages, cosine terms by double sums, bits by the median without the mean term."""
    for n, seed in ((1, 1), (5, 2), (32, 3), (64, 4), (77, 5)):
        image = np.random.default_rng(seed).integers(0, 256, (n, 64), dtype=np.uint8)
        small = np.zeros((32, 32))
        for r in range(32):
            for y in range(n):
                share = max(0.0, min((r + 1) * n / 32, y + 1) - max(r * n / 32, y)) * 32 / n
                if share:
                    small[r] += share * image[y].reshape(32, 2).mean(axis=1)
        terms = [round(sum(small[r, c] * math.cos(math.pi * u * (2 * r + 1) / 64) * math.cos(math.pi * v * (2 * c + 1) / 64) for r in range(32) for c in range(32)), 6) for u in range(8) for v in range(8)]
        middle = sorted(terms[1:])[31]
        assert media.cosine_hash(image) == int("".join("01"[int(t > middle)] for t in terms), 2)


@pytest.mark.parametrize("sources", [50_000, 1])
def test_mix_with_hot_rows_and_ranged_sources(spark, monkeypatch, sources):
    monkeypatch.setattr(mixing, "ROWS_PER_LEAF", 16)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", sources)
    rows = [(k, prose(k, 3 + k % 9), None, f"s{k % 7}" if k % 6 else None, 1) for k in range(200)] + [(7, "one hot row of words", None, "s1", 1)] * 300
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = mixing.mix(docs).collect()
    sizes: Counter = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(t.split())
    wanted = filled(dict(sizes))
    taken: Counter = Counter()
    for r in got:
        taken[r.source] += r["_size"] * r["_copies"]
        assert r["_target"] == pytest.approx(wanted[r.source])
    assert len(got) == len(rows) and all(abs(taken[s] - wanted[s]) <= 11 for s in sizes)
    assert ordered(map(tuple, got)) == ordered(map(tuple, mixing.mix(docs.repartition(3)).collect()))


def test_components_with_hubs(spark, monkeypatch):
    """Stars, chains and rings against plain union-find, with every node of over 5 neighbours taken for a hub."""
    monkeypatch.setattr(simhash, "HUB_ROWS", 5)
    monkeypatch.setattr(simhash, "HUB_SHARE", 0.0)
    dice = random.Random(6)
    edges = [(0, k) for k in range(1, 60)] + [(100 + k, 101 + k) for k in range(40)] + [(200 + k, 200 + (k + 1) % 7) for k in range(7)] + [(500 - k, 499) for k in range(2, 30)]
    edges += [(dice.randrange(1000, 1100), dice.randrange(1000, 1100)) for _ in range(80)]
    edges = [(a, b) for a, b in edges if a != b]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert sorted((r.node, r.root) for r in got) == sorted((x, find(x)) for x in root)
