"""Documents as flat files of token ids with 64-bit document offsets, written in order and memory-mapped again.

A part has three files: `.bin`, all ids as unsigned integers (16 bits if the vocabulary allows, else 32); `.off`,
n + 1 offsets in ids as 64-bit integers; `.doc`, n document ids as 64-bit integers followed by n bytes that are 1
where the id is null. Parts follow each other in document order; `parts` names them with the ids before them.

Scale: one range shuffle of the texts into parts of about PART_BYTES; a task encodes and writes its range as it reads
it, keeping 17 bytes a document, and a part's base is a prefix sum over part sizes. File names carry the attempt, and only names in the written `parts` table count, so
tasks can be repeated at any time.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelode.llm._shared import bound_batches, file_system, kept, map_array, returned, shared_folder, slices, written
from tracelode.llm.pretokens import Learned, Splitter

#: Distinct pre-tokens whose ids a worker keeps between batches.
CACHE = 400_000
#: UTF-8 bytes of text in a part, about.
PART_BYTES = 64 << 20
#: Documents of a part that are read back at a time.
READ_DOCS = 20_000


class Encoder:
    """Ids of whole texts from the tokenizers library, which encodes each distinct pre-token once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.split = Splitter(path)
        self.library = Tokenizer.from_file(path)
        self.kind = "<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.learned = Learned(self.look, CACHE)

    def look(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all ids: from the library, which gets the words as one sequence."""
        asked = [w if isinstance(w, str) else "" for w in words]
        found = self.library.encode(asked, is_pretokenized=True, add_special_tokens=False)
        ids, sizes = np.array(found.ids, self.kind), np.bincount(np.array(found.word_ids, np.int64), minlength=len(words))
        if added := [k for k, w in enumerate(words) if not isinstance(w, str)]:
            ends = np.cumsum(sizes)
            ids = np.insert(ids, ends[added], np.array([words[k][0] for k in added], self.kind))
            sizes[added] = 1
        return sizes, ids

    def __call__(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each with end_id if given, and how many each text has."""
        words, at = self.learned(texts, self.split)
        sizes, starts = self.learned.sizes[words], self.learned.starts[words]
        before = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.learned.values[np.arange(before[-1]) + np.repeat(starts - before[:-1], sizes)].astype(self.kind)
        ends = before[at]
        if end_id is None:
            return ids, np.diff(ends)
        out = np.full(len(ids) + len(texts), end_id, self.kind)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), np.diff(ends))] = ids
        return out, np.diff(ends) + 1


@kept
@lru_cache(1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes docs to a folder every machine sees and returns its parts: (part, name, kind, n_docs, n_tokens, base).

    Documents are in ascending order of doc_id, nulls first, then of text. A null text is empty: the end id alone.
    Repeated rows are written each. An empty table has no parts. Other columns of docs, whatever their names, are not
    touched.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    folder = folder or shared_folder(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        fs, base = file_system(folder)
        sizes, keys, nulls, out = [], [], [], None
        for batch in batches:
            for part in slices(batch, "_text", 2 << 20):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}.bin")
                ids, counts = encode([t or "" for t in part.column("_text").to_pylist()], end_id)
                out.write(ids.tobytes())
                sizes.append(counts)
                found = part.column("doc_id")
                keys.append(found.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                nulls.append(found.is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
        if out is None:
            return
        out.close()
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype("<i8")
        for tail, body in ((".off", offsets.tobytes()), (".doc", np.concatenate(keys).tobytes() + np.concatenate(nulls).tobytes())):
            with fs.open_output_stream(f"{base}/{name}{tail}") as file:
                file.write(body)
        row = [[TaskContext.get().partitionId()], [f"{folder}/{name}"], [encode.kind], [len(offsets) - 1], [int(offsets[-1])]]
        yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), *map(pa.array, row[1:])], ["part", "name", "kind", "n_docs", "n_tokens"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("_text"))
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")) + 16)).first()[0] or 0
    count = max(spark.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    ordered = rows.repartitionByRange(count, "doc_id", F.xxhash64("_text")).sortWithinPartitions("doc_id", "_text")
    parts = written(ordered.mapInArrow(returned(run, _encoder), "part int, name string, kind string, n_docs bigint, n_tokens bigint"), "parts")
    return parts.withColumn("base", F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens"))


def read_token_files(parts: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files, read from them alone."""
    count = max(1, parts.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, offsets, n = map_array(row["name"] + ".bin", row["kind"]), map_array(row["name"] + ".off", "<i8"), row["n_docs"]
                about = map_array(row["name"] + ".doc", "u1")
                keys, nulls = about[: 8 * n].view("<i8"), about[8 * n :].astype(bool)
                for first in range(0, n, READ_DOCS):
                    at = np.asarray(offsets[first : first + READ_DOCS + 1])
                    size = np.diff(at)
                    sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                    doc = pa.array(np.asarray(keys[first : first + READ_DOCS]), mask=np.asarray(nulls[first : first + READ_DOCS]))
                    yield pa.RecordBatch.from_arrays([doc, pa.array(at[:-1] + row["base"]), pa.array(size), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = parts.withColumn("_to", (F.row_number().over(Window.orderBy("part")) - 1).cast("int"))
    spread = spread.repartitionById(count, F.col("_to")) if hasattr(spread, "repartitionById") else spread.repartition(count)
    return spread.drop("_to").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
