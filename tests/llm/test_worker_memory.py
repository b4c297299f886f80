"""What a reused worker holds: other operators' caches go, and frequent passages are searched in bounded memory."""

from __future__ import annotations

import random
import tracemalloc

import pyarrow as pa

from tracelode.llm import decontamination, token_files
from tracelode.llm._shared import returned
from tracelode.llm.queries import BYTE_BPE, END_ID, tokenizer_path


def test_another_operators_task_drops_the_encoder(spark):
    docs = spark.createDataFrame([(k, f"some words of text {k}") for k in range(40)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a passage that no document holds at all, with enough letters to be one")], "item_id bigint, text string")
    assert token_files.write_token_files(docs, tokenizer_path(BYTE_BPE), END_ID).count() > 0
    assert decontamination.clean(docs.repartition(4), items).count() == 40

    def held(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([token_files._encoder.cache_info().currsize])], ["n"])

    # Four tasks of one worker each have cleaned; none of their workers has an encoder any more.
    assert {r.n for r in docs.repartition(4).mapInArrow(held, "n bigint").collect()} == {0}


def test_own_cache_stays():
    tokenizer = tokenizer_path(BYTE_BPE)
    mine = token_files._encoder(tokenizer)
    assert list(returned(iter, token_files._encoder)([1])) == [1] and token_files._encoder(tokenizer) is mine
    assert list(returned(iter)([2])) == [2] and token_files._encoder.cache_info().currsize == 0


def test_memory_of_a_search():
    """Two megabytes of text made of passages: the same windows as in short texts, and under 64 MB at a time."""
    dice = random.Random(3)
    words = ["".join(dice.choices("abcdefghij", k=dice.randint(3, 9))) for _ in range(40)]
    passages = [" ".join(dice.choices(words, k=30)) for _ in range(60)]
    index = decontamination.Index([(k, first, data.tobytes(), ends) for k, p in enumerate(passages) for first, data, ends in decontamination.pieces(decontamination.trimmed(p))])
    text = " ".join(dice.choices(passages, k=2 * 10**6 // 180))
    hits = {}
    tracemalloc.start()
    try:
        decontamination._hits(index, pa.RecordBatch.from_arrays([pa.array([text])], ["_text"]), hits)
        most = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert {item for _, item in hits} == set(range(60))
    assert all(min(h)[0] == 0 for h in hits.values())
    assert most < 64, most
