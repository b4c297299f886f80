"""Extra columns of any name, among them all that the operators use themselves, change no result and none is lost."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import SCHEMA, ordered, prose
from tracelode.llm import context_tree, decontamination, langid, media, mixing, near_copies, pii, sharding, simhash, token_counts, token_files
from tracelode.llm.queries import BYTE_BPE, PIECES, tokenizer_path

NAMES = "_text _size _key _source _source_size _copies _rest _leaf _group _target _row _copy _part _s _h _b _n _base _all _f _c _p _m _at _k _block media image lang_pred score n_replaced pseudonyms fp node root a b id v s own other start n_tokens n_bytes size shard slot item_id n_windows edits print segments held_out word key n".split()


@pytest.fixture(scope="module")
def plain(spark):
    rows = [(k, prose(k, 30) + (" 4366826422043230" if k % 5 == 0 else ""), "en" if k % 2 else "fr", f"s{k % 3}", 9) for k in range(24)]
    rows += [(30, rows[3][1], "en", "s1", 9), (31, rows[4][1], "en", None, 9), (32, None, None, "s1", 0), (32, "", "en", "s2", 0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(2).cache()


@pytest.fixture(scope="module")
def extra(plain):
    return plain.select("*", *[F.lit("MINE").alias(c) for c in NAMES]).cache()


@pytest.fixture(scope="module")
def bench(spark, plain):
    return spark.createDataFrame([(1, plain.where("doc_id = 7").first().text, "MINE")], "item_id bigint, text string, _text string")


RUNS = {
    "sharding": lambda d, b: sharding.stratified_shards(d, 4),
    "token_files": lambda d, b: token_files.read_token_files(token_files.write_token_files(d, tokenizer_path(BYTE_BPE), 2)),
    "token_counts": lambda d, b: token_counts.token_counts(d, tokenizer_path(BYTE_BPE)),
    "contaminated": lambda d, b: decontamination.contaminated(d, b),
    "context_tree": lambda d, b: context_tree.score(d, context_tree.train(d)),
    "near_groups": lambda d, b: simhash.near_groups(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_no_result_changes(plain, extra, bench, name):
    assert ordered(map(tuple, RUNS[name](extra, bench).collect())) == ordered(map(tuple, RUNS[name](plain, bench).collect()))


def test_language_results(plain, extra):
    pieces = langid.sentencepieces(tokenizer_path(PIECES))
    langs, prob = langid.fit(extra, pieces)
    got = langid.identify(extra, langs, prob, pieces, keep=[F.col(c) for c in ("lang", *NAMES)])
    assert got.columns == ["doc_id", "lang", *[c for c in NAMES if c not in ("lang_pred", "score")], "lang_pred", "score"]
    assert {r.lang_pred for r in got.where("text IS NOT NULL" if "text" in got.columns else "true").collect()} <= {"en", "fr", "und"}
    assert {r["_text"] for r in got.collect()} == {"MINE"}


WHOLE = {
    "pseudonyms": (lambda d, b: pii.pseudonymised(d, "k"), {"n_replaced", "pseudonyms"}),
    "media": (lambda d, b: media.with_features(media.with_media(d)), {"media", "image"}),
    "clean": (lambda d, b: decontamination.clean(d, b), set()),
    "one_of_each": (lambda d, b: near_copies.one_of_each(d), set()),
    "mix": (lambda d, b: mixing.mix(d), set(mixing.ADDED)),
    "repeated": (lambda d, b: mixing.repeated(d), set()),
    "language stage": (lambda d, b: corpus_pipeline.known_language(d.sparkSession, d, ""), set()),
}


@pytest.mark.parametrize("name", WHOLE)
def test_no_column_is_lost(plain, extra, bench, name):
    run, gives_way = WHOLE[name]
    got, wanted = run(extra, bench), run(plain, bench)
    assert set(got.columns) == {*extra.columns, *gives_way} and len(got.columns) == len(set(got.columns))
    mine = got.collect()
    assert all(r[c] == "MINE" for r in mine for c in NAMES if c not in gives_way)
    if name not in ("mix", "repeated"):  # rows are dealt by a hash of all of their columns
        both = [c for c in wanted.columns if c not in gives_way]
        assert ordered(tuple(r[c] for c in both) for r in mine) == ordered(tuple(r[c] for c in both) for r in wanted.collect())


def test_empty_tables(spark, extra, bench):
    none = extra.limit(0)
    for run in RUNS.values():
        assert run(none, bench).count() == 0
    for run, _ in WHOLE.values():
        assert run(none, bench).count() == 0
