"""The pipeline's stages, each against plain Python on its own input, and the queries over a small table."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import SCHEMA, brute_groups, brute_matches, filled, prose
from tracelode.llm import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    items = [(k, prose(900 + k, 18)) for k in range(3)]
    french = "le chat noir et la maison verte dans une rue tranquille avec des fleurs".split()
    rows = []
    for k in range(70):
        text = prose(k, 60) if k % 3 else " ".join(french[(k * j + j) % len(french)] for j in range(40 + k))
        rows.append((k, text, "fr" if k % 3 == 0 else "en", f"s{k % 5}" if k % 11 else None, len(text)))
    rows += [(100 + k, rows[7][1], "en", "s1", 1) for k in range(12)]
    rows += [(120 + k, prose(300 + k, 30) + " " + items[k][1].upper() + " " + prose(400 + k, 30), "en", "s2", 1) for k in range(3)]
    rows += [(130, None, None, "s3", 0), (131, "", "en", "s3", 0), (132, "12 34 %%", None, None, 8), (133, prose(55, 4000), "en", "s4", 1)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)], "doc_id bigint, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(k, [float(k * j % 7) for j in range(1, 6)]) for k in range(30)] + [(30, None)], "vec_id bigint, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
    return str(at)


def test_stages_against_plain_python(spark, folder):
    docs = queries.documents(spark, folder).cache()
    columns, before = docs.columns, docs.collect()
    steps = dict(corpus_pipeline.STAGES)
    bench = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]

    spoken = steps["language ID"](spark, docs, folder).cache()
    kept = spoken.collect()
    assert spoken.columns == columns and {r.doc_id for r in before} - {r.doc_id for r in kept} == {130, 131, 132}

    single = steps["near copies"](spark, spoken, folder).cache()
    groups = brute_groups([(r.doc_id, r.text) for r in kept])
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted({c for _, _, c in groups})

    free = steps["benchmark passages"](spark, single, folder).cache()
    held = {r.doc_id for r in single.where("doc_id <> 133").collect() if any(brute_matches(r.text, b) for b in bench)}
    assert held == {120, 121, 122} and {r.doc_id for r in free.collect()} == {r.doc_id for r in single.collect()} - held

    mixed = steps["mixture"](spark, free, folder).cache()
    words = lambda r: len((r.text or "").split())
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in free.collect():
        sizes[r.source] += words(r)
        largest[r.source] = max(largest[r.source], words(r))
    for r in mixed.collect():
        taken[r.source] += words(r)
    wanted = filled(dict(sizes))
    assert mixed.columns == columns and all(abs(taken[s] - wanted[s]) <= largest[s] for s in sizes)
    assert max(Counter(r.doc_id for r in mixed.collect()).values()) <= 2

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path(queries.BYTE_BPE))
    start, out = 0, []
    for r in sorted(mixed.collect(), key=lambda r: r.doc_id):
        ids = [*library.encode(r.text, add_special_tokens=False).ids, queries.END_ID]
        out.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, steps["token ids"](spark, mixed, folder).collect())) == out
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == out


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_return_a_row_a_document(spark, folder, name):
    got = queries.queries()[name](spark, folder)
    if name.startswith("op13_"):
        assert Counter(r.vec_id for r in got.collect()) == dict.fromkeys(range(30), 4)
        return
    assert "doc_id" in got.columns
    ids = Counter(r.doc_id for r in got.select("doc_id").collect())
    if name.startswith("op5_"):
        assert set(ids) == {120, 121, 122}
    else:
        assert ids == Counter(r.doc_id for r in queries.documents(spark, folder).select("doc_id").collect())


def test_contract_columns(spark, folder):
    crc = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) for r in queries.documents(spark, folder).select("doc_id").collect()}
    got = queries.op7_piece_language_id(spark, folder).collect()
    assert all(r.held_out == (crc[r.doc_id] % 3 == 1) for r in got) and {r.lang_pred for r in got} <= {"en", "fr", "und"}
    got = queries.op6_context_tree_scores(spark, folder).collect()
    assert all(r.held_out == (crc[r.doc_id] % 5 == 1) for r in got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    got = queries.op9_simhash_groups(spark, folder).collect()
    assert all(len(r.fingerprint) == 16 for r in got) and sum(r.component_id == 7 for r in got) == 13
    assert queries.op3_stratified_shards(spark, folder).select(F.max("shard")).first()[0] == 39
