"""Each corpus operator against plain Python on small tables, with nulls, empty, long and repeated texts."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracelode.llm import context_tree, decontamination, langid, media, mixing, pii, sharding, simhash, token_counts, token_files
from tracelode.llm.queries import BYTE_BPE, PIECES, tokenizer_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "the of and thing ered onble stan wher ting arro belt crane dune ember flint gale".split()


def prose(seed: int, n: int) -> str:
    dice = random.Random(seed)
    return " ".join(dice.choice(WORDS) + dice.choice(WORDS) * (dice.random() < 0.4) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    texts = [prose(k, 5 + 7 * (k % 11)) for k in range(60)]
    texts += [texts[3]] * 25 + [texts[4] + " x", "", None, "   \t\n", "é中 ñandú, 1234 +x", prose(99, 9000), "12 34 !!"]
    out = [(k, t, ("en", "fr", None)[k % 3], f"s{k % 4}" if k % 7 else None, len(t or "")) for k, t in enumerate(texts)]
    return [*out, (5, texts[5], "en", "s1", 1), (5, texts[5], "en", "s1", 1), (None, texts[6], "fr", "s0", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ordered(found):
    return sorted(found, key=lambda r: tuple((x is not None, str(type(x)), x) for x in r if not isinstance(x, list)))


# 1. pseudonyms


def one(spark, text, key="k"):
    return pii.pseudonymised(spark.createDataFrame([(1, text)], "doc_id int, text string"), key).first()


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(d)) % 10 == 0


def test_pseudonyms_keep_format_and_validity(spark):
    import re

    for text, form in [("4366826422043230", r"4\d{15}"), ("4366-8264-2204-3230", r"4\d{3}-\d{4}-\d{4}-\d{4}"), ("+1 (366) 555-9807", r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}"), ("123-45-6789", r"\d{3}-\d{2}-\d{4}"), ("61.131.143.218", r"\d+\.\d+\.\d+\.\d+"), ("bo.42@mail8.example.com", r"[a-z]{2}\.\d\d@mail8\.example\.com"), ("2000-02-29", r"\d{4}-\d\d-\d\d"), ("31.12.1999", r"\d\d\.\d\d\.\d{4}"), ("12/31/1999", r"\d\d/(1[3-9]|[23]\d)/\d{4}"), ("+49 30 1234567", r"\+49 \d\d \d{7}")]:
        got = one(spark, f"a {text} b, {text}")
        first, second = got.text[2:].split(" b, ")
        assert first == second and first != text and re.fullmatch(form, first) and got.n_replaced == 2, (text, got)
        if text[0] == "4" and "+" not in text:
            assert luhn(re.sub(r"\D", "", first))
    iban = one(spark, "DE89 3704 0044 0532 0130 00").text
    plain = iban.replace(" ", "")
    assert iban != "DE89 3704 0044 0532 0130 00" and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


@pytest.mark.parametrize("text", ["", "no numbers", "4366826422043231 and 000-12-3456", "2001-02-29", "999.1.1.1", "v1.2.3 10.5 2024", "DE00 3704 0044 0532 0130 00"])
def test_what_is_not_valid_stays(spark, text):
    assert one(spark, text).text == text


def test_pair_and_text_networks_are_permutations(spark):
    pairs = spark.range(17 * 31).select(pii.feistel_pair("k", "t", F.floor(F.col("id") / 31), F.col("id") % 31, 17, 31).alias("p"))
    assert pairs.distinct().count() == 17 * 31
    texts = spark.range(1000).select(pii.feistel_text("k", "t", F.lpad(F.col("id").cast("string"), 3, "0")).alias("p"))
    assert texts.distinct().count() == 1000
    leaps = spark.range(49).select(F.format_string("02/29/%04d", F.col("id") * 4 + 1904).alias("text"))
    assert pii.pseudonymised(leaps, "k").distinct().count() == 49


def test_pseudonyms_of_whole_tables(docs, none, rows):
    got = pii.pseudonymised(docs.withColumn("n_replaced", F.lit("x")), "k")
    assert got.count() == len(rows) and got.where("text IS NULL").count() == 1
    assert pii.pseudonymised(none, "k").count() == 0


# 2. media


def test_png_round_trip_and_faults():
    for text in (None, "", "a", "é" * 33, prose(1, 5000)):
        data = media.payload(text)
        png = media.write_png(data)
        assert media.read_png(png).tobytes() == data and len(data) % 64 == 0 and len(data) >= 64
        for at in (3, 40, len(png) // 2, len(png) - 3):
            with pytest.raises(ValueError):
                media.read_png(png[:at] + bytes([png[at] ^ 1]) + png[at + 1 :])


def test_all_row_filters():
    dice = np.random.default_rng(5)
    image = dice.integers(0, 256, (20, 7), dtype=np.uint8).astype(int)
    kinds = dice.integers(0, 5, 20)
    rows = np.zeros((20, 8), np.uint8)
    for r, c in itertools.product(range(20), range(7)):
        a, b = (image[r, c - 1] if c else 0), (image[r - 1, c] if r else 0)
        d = image[r - 1, c - 1] if r and c else 0
        paeth = min((abs(b - d), 0, a), (abs(a - d), 1, b), (abs(a + b - 2 * d), 2, d))[2]
        rows[r, c + 1] = (image[r, c] - (0, a, b, (a + b) // 2, paeth)[kinds[r]]) % 256
    rows[:, 0] = kinds
    assert (media.unfilter(rows) == image).all()


def test_media_query_columns(docs, none, rows):
    got = media.with_features(media.with_media(docs.select("doc_id", "text"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert bytes(r.image.payload) == media.payload(r.text) and r.image.tail_crc32 == zlib.crc32(media.payload(r.text)[-64:]) and len(r.image.feature) == 16
    assert len({(r.text, bytes(r.media), r.image.feature) for r in got}) == len({r.text for r in got})
    assert media.with_features(media.with_media(none)).count() == 0


# 3. shards


def test_shards_are_even_and_proportional(docs, none, rows):
    got = sharding.stratified_shards(docs, 8).collect()
    sizes = Counter(r.shard for r in got)
    assert sorted(sizes) == list(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for k, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == k) == list(range(n))
    all_of = Counter(r.source for r in got)
    for k in range(8):
        here = Counter(r.source for r in got if r.shard == k)
        assert all(abs(here[s] - n * sizes[k] / len(got)) <= 2 for s, n in all_of.items())
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    again = sharding.stratified_shards(docs.repartition(3), 8).collect()
    assert ordered(got) == ordered(again)
    assert sharding.stratified_shards(none, 8).count() == 0 and sharding.stratified_shards(docs.limit(3), 8).count() == 3


# 4. and 8. tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(BYTE_BPE))


ODD = ["it's  we'll\n\n x", "<|endoftext|>a<|endoftext|>", " <|endoftext|> ", "a" * 3000, "ab" * 999 + "é中🙂", "²½ ٣ x​x　y", "\r\n\t 'S 'll"]


def test_token_files_round_trip(spark, docs, none, rows, library, tmp_path):
    more = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(ODD)], "doc_id bigint, text string")
    parts = token_files.write_token_files(docs.select("doc_id", "text").union(more), tokenizer_path(BYTE_BPE), 2, f"file://{tmp_path}/t")
    got = token_files.read_token_files(parts).collect()
    wanted = sorted([(-1 if r[0] is None else r[0], r[1] or "") for r in rows] + [(1000 + k, t) for k, t in enumerate(ODD)])
    start, out = 0, []
    for key, text in wanted:
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted(out)
    assert token_files.read_token_files(token_files.write_token_files(none, tokenizer_path(BYTE_BPE), 2)).count() == 0


def test_token_counts_equal_the_library(spark, docs, none, rows, library):
    more = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(ODD)], "doc_id bigint, text string")
    got = token_counts.token_counts(docs.select("doc_id", "text").union(more), tokenizer_path(BYTE_BPE)).collect()
    texts = [(r[0], r[1] or "") for r in rows] + [(1000 + k, t) for k, t in enumerate(ODD)]
    wanted = [(k, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for k, t in texts]
    assert ordered(map(tuple, got)) == ordered(wanted)
    assert token_counts.token_counts(none, tokenizer_path(BYTE_BPE)).count() == 0


# 5. decontamination


def brute_matches(text: str, item: str) -> bool:
    """Any window of the item within its budget, by full semi-global alignment."""
    fold = lambda t: decontamination.folded(np.frombuffer(t.encode(), np.uint8)).tobytes()
    data, item_ = fold(text), fold(item).strip()
    last = max(len(item_) - 64, 0)
    for at in sorted({*range(0, last, 32), last}):
        window = item_[at : at + 64]
        if (k := decontamination.budget(len(window))) < 0:
            return bool(item_) and b" " + item_ + b" " in b" " + data + b" "
        row = [0] * (len(data) + 1)
        for i, c in enumerate(window, 1):
            new = [i]
            for j, d in enumerate(data, 1):
                new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
            row = new
        if min(row) <= k:
            return True
    return False


def test_decontamination_against_full_alignment(spark, none):
    dice = random.Random(3)
    items = [prose(500 + k, 20) for k in range(4)] + ["", "short one", prose(600, 4), None]
    docs = []
    for k in range(40):
        text, item = prose(700 + k, 60), items[k % 4]
        edits = k // 4
        piece = list(item)
        for _ in range(edits):
            at = dice.randrange(len(piece))
            piece[at : at + 1] = dice.choice([[], ["q"], [piece[at], "z"]])
        docs.append((k, text[:100] + " " + "".join(piece)[:80].upper() + " " + text[100:]))
    docs += [(100, ""), (101, None), (102, prose(800, 3000) + items[0] + prose(801, 300)), (103, items[1]), (104, "my Short, one!"), (105, "my short oneness"), (106, "short one x")]
    table = spark.createDataFrame(docs, "doc_id int, text string")
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id int, text string")
    wanted = {(d, i) for d, t in docs if d != 102 for i, item in enumerate(items) if brute_matches(t or "", item or "")} | {(102, 0)}
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(table, bench).collect()}
    assert got == wanted and len(wanted) > 14 and {(104, 5), (106, 5)} <= got
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(table, bench, block=150).collect()} == wanted
    left = {r.doc_id for r in decontamination.clean(table, bench, block=150).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in wanted}
    assert decontamination.contaminated(none, bench).count() == 0 and decontamination.contaminated(table, bench.limit(0)).count() == 0


# 6. context trees


def tree_probability(train: list[bytes], text: bytes, depth: int) -> float:
    """Log10 probability by the definition: recursive weighting over dictionaries."""
    counts: dict = defaultdict(lambda: [0, 0])
    pad = bytes([10]) * depth

    def nodes(data: bytes, i: int):
        for j in range(8):
            bits, bit = 1 << j | data[i] >> (8 - j), data[i] >> (7 - j) & 1
            yield [(data[i - d : i], bits) for d in range(depth + 1)], bit

    for t in train:
        data = pad + t
        for i in range(depth, len(data)):
            for path, bit in nodes(data, i):
                for node in path:
                    counts[node][bit] += 1
    kids = defaultdict(set)
    for context, bits in counts:
        if context:
            kids[context[1:], bits].add((context, bits))
    log_kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    done: dict = {}

    def weighted(node):
        if node not in done:
            own = log_kt(*counts[node])
            if len(node[0]) == depth:
                done[node] = own, 1.0
            else:
                below = sum(weighted(k)[0] for k in kids[node])
                both = np.logaddexp(own, below) + math.log(0.5)
                done[node] = both, math.exp(own + math.log(0.5) - both)
        return done[node]

    total, data = 0.0, pad + text
    for i in range(depth, len(data)):
        for path, bit in nodes(data, i):
            seen = [n for n in path if n in counts]
            one, left = 0.0, 1.0
            for k, node in enumerate(seen):
                share = 1.0 if k == len(seen) - 1 else weighted(node)[1]
                one += left * share * (counts[node][1] + 0.5) / (sum(counts[node]) + 1)
                left *= 1 - share
            one = one if seen else 0.5
            total += math.log10(one if bit else 1 - one)
    return total


def as_modelled(text: str | None) -> bytes:
    return b" ".join((text or "").encode().lower().split()) + b"\n"


@pytest.mark.parametrize(("grams", "depth"), [(60, 3), (4, 4)])
def test_context_tree_against_definition(spark, docs, rows, none, monkeypatch, grams, depth):
    monkeypatch.setattr(context_tree, "PART_GRAMS", grams)
    texts = [prose(k, 12) for k in range(12)] + ["", None, " A\t b ", "éè"]
    train = spark.createDataFrame([(t,) for t in texts[:9]], "text string")
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    trained = context_tree.train(train, depth=depth)
    assert trained[0].parts.max() > 2 and (grams == 60 or {s.length for s in trained[0].splits} == {2, 3})
    got = {r.doc_id: r for r in context_tree.score(table, trained).collect()}
    seen = Counter(w for t in texts[:9] for w in [*as_modelled(t).split(), b"\n"])
    n, v = sum(seen.values()), len(seen)
    for k, t in enumerate(texts):
        tokens = [*as_modelled(t).split(), b"\n"]
        assert got[k].n_tokens == len(tokens) and got[k].n_known == sum(seen[w] > 0 for w in tokens) and got[k].train_tokens == n
        assert got[k].base_score == pytest.approx(sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens))
        assert got[k].score == pytest.approx(tree_probability([as_modelled(x) for x in texts[:9]], as_modelled(t), depth), rel=1e-4), t
    assert context_tree.score(none, trained).count() == 0
    blank = context_tree.score(table, context_tree.train(none)).where("doc_id = 12").first()
    assert blank.score == pytest.approx(8 * math.log10(0.5)) and blank.n_known == 0
    assert context_tree.score(docs, trained).count() == len(rows)


# 7. languages


@pytest.fixture(scope="module")
def pieces():
    return langid.sentencepieces(tokenizer_path(PIECES))


def test_forward_sums_all_segmentations(pieces):
    lattice = langid.Lattice(pieces)
    prob = np.random.default_rng(1).random((lattice.unknown + 1, 2)) / 1e4
    at = {p: k for k, p in enumerate(lattice.pieces)}
    words = ["the", "thetion", "ñañez", "中q", "z", "x" * 40, "thetionally" * 9]

    def brute(word: str, k: int) -> float:
        alpha = [1.0] + [0.0] * len(word)
        for e in range(1, len(word) + 1):
            for s in range(e):
                if word[s:e] in at:
                    alpha[e] += alpha[s] * prob[at[word[s:e]], k]
                elif e == s + 1:
                    alpha[e] += alpha[s] * prob[lattice.unknown, k]
        return math.log(alpha[-1])

    assert np.allclose(lattice.forward(words, prob), [[brute("▁" + w, k) for k in (0, 1)] for w in words])
    counts = lattice.expected(words, np.ones(len(words)), prob[:, 0])
    lengths = np.array([*map(len, lattice.pieces), 1])
    assert counts @ lengths == pytest.approx(sum(len(w) + 1 for w in words))


def test_held_out_languages(spark, pieces):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    langs, prob = langid.fit(table.where(~held), pieces)
    said = langid.identify(table.where(held), langs, prob, pieces, keep=[F.col("lang")])
    assert said.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_language_edges(docs, none, rows, pieces):
    langs, prob = langid.fit(docs, pieces)
    got = langid.identify(docs, langs, prob, pieces, keep=[F.col("text")]).collect()
    assert langs == ["en", "fr"] and len(got) == len(rows)
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    nobody, flat = langid.fit(none, pieces)
    assert {r.lang_pred for r in langid.identify(docs, nobody, flat, pieces).collect()} == {"und"}
    assert langid.identify(none, langs, prob, pieces).count() == 0


# 9. near copies


def brute_groups(rows, radius=2):
    def fingerprint(text):
        words = (text or "").encode().lower().split()
        parts = [b" ".join(words[k : k + 3]) for k in range(max(len(words) - 2, 1))] if words else []
        h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius and group[a] != group[b]:
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    least = {g: min((k for (k, _), h in zip(rows, group) if h == g and k is not None), default=None) for g in set(group)}
    return [(k, p, least[g]) for (k, _), p, g in zip(rows, prints, group)]


def test_near_groups_against_all_pairs(spark, docs, rows, none):
    dice = random.Random(2)
    base = prose(1, 400).split()
    near = []
    for k in range(60):
        words = list(base)
        words[dice.randrange(400)] = f"w{k}"
        near.append((1000 + k, " ".join(words)))
    all_rows = [(r[0], r[1]) for r in rows] + near
    table = spark.createDataFrame(all_rows, "doc_id bigint, text string").repartition(4)
    got = simhash.near_groups(table).collect()
    wanted = brute_groups(all_rows)
    assert ordered((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got) == ordered(wanted)
    assert len({c for _, _, c in wanted}) < len(all_rows) - 40
    assert simhash.near_groups(none).count() == 0


def test_linked_finds_every_pair(spark):
    dice = random.Random(9)
    prints = {dice.getrandbits(64) for _ in range(50)}
    for p in list(prints):
        prints |= {p ^ 1 << dice.randrange(64) ^ 1 << dice.randrange(64) for _ in range(6)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = [tuple(r) for r in simhash.linked(spark.createDataFrame([(p,) for p in signed], "fp bigint")).collect()]
    wanted = {(a, b) for a, b in itertools.permutations(signed, 2) if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert len(got) == len(set(got)) and set(got) == wanted


# 10. mixing


def filled(sizes: dict, weights=(5, 2, 1), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    while open_:
        rest = share * sum(sizes.values()) - sum(target.values())
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: most * sizes[s] for s in over}
        open_ -= over
    return target


@pytest.mark.parametrize("leaf", [4096, 16])
def test_mix_meets_targets(docs, none, rows, monkeypatch, leaf):
    monkeypatch.setattr(mixing, "ROWS_PER_LEAF", leaf)
    monkeypatch.setattr(mixing, "FAN", 3 if leaf == 16 else 64)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode().split())
    sizes: Counter = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += size(t)
    wanted = filled(dict(sizes))
    largest: Counter = Counter()
    taken: Counter = Counter()
    for r in got:
        assert r["_size"] == size(r.text) and r["_target"] == pytest.approx(wanted[r.source]) and 0 <= r["_copies"] <= 2
        taken[r.source] += r["_size"] * r["_copies"]
        largest[r.source] = max(largest[r.source], r["_size"])
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= largest[s] + 1e-6
    again = mixing.mix(docs.repartition(7)).collect()
    assert ordered(map(tuple, got)) == ordered(map(tuple, again))
    assert mixing.repeated(docs).count() == sum(r["_copies"] for r in got)
    assert mixing.mix(none).count() == 0


def test_meeting_keeps_words_and_chances():
    dice = random.Random(1)
    for _ in range(300):
        a, b, x, y = dice.randint(1, 99), dice.randint(1, 99), dice.random(), dice.random()
        u, v = mixing.meet(a, x, b, y, dice.random())
        assert a * u + b * v == pytest.approx(a * x + b * y, abs=1e-6) and (u in (0, 1) or v in (0, 1)) and 0 <= u <= 1 and 0 <= v <= 1
    up = [mixing.meet(3, 0.3, 5, 0.6, (k + 0.5) / 4000)[0] for k in range(4000)]
    assert sum(up) / 4000 == pytest.approx(0.3, abs=2e-3)


def test_payload_hash_is_of_whole_text():
    assert hashlib.sha256(media.payload("a")).hexdigest() == hashlib.sha256(b"a" + bytes(63)).hexdigest()


def test_letters_are_letters():
    assert langid.letter_runs("\u00bd\u00b2 \u2167 12 _") == []
    assert langid.letter_runs("a\u00bdB \u00c9t\u00e9_x") == ["a", "b", "\u00e9t\u00e9", "x"]


def test_rare_language_beside_a_frequent_one(spark, pieces):
    rare = "zorq vlim plux qort"
    many = [(k, prose(k, 30), "often") for k in range(400)] + [(1000 + k, f"{rare} {rare} wq{k}", "seldom") for k in range(4)]
    langs, prob = langid.fit(spark.createDataFrame(many, "doc_id bigint, text string, lang string"), pieces, sample=20)
    asked = spark.createDataFrame([(1, "vlim zorq qort plux"), (2, prose(7777, 20))], "doc_id bigint, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(asked, langs, prob, pieces).collect()} == {1: "seldom", 2: "often"}


def test_frequent_grams_are_counted_in_stretches(monkeypatch):
    dice = random.Random(5)
    items = [(k, "the same phrase again and again " * 3 + prose(500 + k, 30)) for k in range(20)]
    index = decontamination.Index([(k, at, part.tobytes(), ends) for k, t in items for at, part, ends in decontamination.pieces(decontamination.trimmed(t))])
    text = " ".join(x for k in range(12) for x in (prose(9000 + k, 60), items[dice.randrange(20)][1][40:200], "the same phrase again and again " * dice.randrange(6)))
    data = decontamination.folded(np.frombuffer(text.encode(), np.uint8))
    whole = set(decontamination._search(index, data))
    for pairs in (1, 500, 20_000):
        monkeypatch.setattr(decontamination, "PAIRS", pairs)
        assert set(decontamination._search(index, data)) == whole and whole
