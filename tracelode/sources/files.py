"""Files of traces, tables, logs, reports and vectors in a folder that all machines see: written by tasks, read back by Spark.

A file sink writes each file whole under its final name, so a repeated task writes the same bytes again.
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions.batches import bound_batches
from tracelode.sources.traces import upserted

BOM = "﻿"


def work_folder(spark: SparkSession, tag: str) -> str:
    """A new folder below spark.checkpoint.dir, as a URI; only a local session may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.getConf().get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="tracelode-")
        spark.conf.set("spark.checkpoint.dir", base)
    if base.startswith("file:/") and not base.startswith("file:///"):
        base = "file:///" + base[6:].lstrip("/")
    return f"{base.rstrip('/')}/tracelode-{tag}-{uuid.uuid4().hex}" if "://" in base else f"file://{os.path.abspath(base)}/tracelode-{tag}-{uuid.uuid4().hex}"


def _putter(folder: str) -> Callable[[str, bytes], None]:
    """Writes files (name, body) below folder; a subfolder is made when its first file comes."""
    from pyarrow import fs

    where, base = fs.FileSystem.from_uri(folder)
    made = set()

    def put(name: str, body: bytes) -> None:
        path = f"{base}/{name}"
        if (parent := path.rpartition("/")[0]) not in made:
            where.create_dir(parent, recursive=True)
            made.add(parent)
        with where.open_output_stream(path) as out:
            out.write(body)

    return put


def write_files(rows: DataFrame, folder: str) -> int:
    """A file for each row (name, body string or binary), in subfolders as the name says; how many were written. A null body is an empty file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        put = _putter(folder)
        for batch in batches:
            # One body at a time: a batch's all as Python strings would be as much again.
            for name, body in zip(batch.column("name"), batch.column("body")):
                text = body.as_py()
                put(name.as_py(), text.encode() if isinstance(text, str) else text or b"")
            yield batch.select(["name"])

    bound_batches(rows.sparkSession)
    return rows.select("name", "body").mapInArrow(run, "name string").count()


def write_traces(traces: DataFrame, folder: str, name: Column) -> int:
    """Trace documents (columns of TRACE) as indented JSON, characters as they are, one file each under `name`."""
    fields = [c for c in traces.columns if c != "_corrupt"]
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in fields]), {"pretty": "true"})
    return write_files(traces.select(name.alias("name"), body.alias("body")), folder)


def write_table(rows: DataFrame, folder: str) -> None:
    """A table as CSV with a header."""
    rows.write.mode("overwrite").option("header", True).csv(folder)


def read_table(spark: SparkSession, folder: str, schema: str) -> DataFrame | None:
    """A CSV table; None if the folder isn't there."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).option("header", True).csv(folder)
    except AnalysisException:
        return None


def merge_table(new: DataFrame, folder: str, version: int, keys: list[str], schema: str, defaults: dict | None = None) -> DataFrame:
    """Version + 1 of a CSV table below folder: version's rows with new ones in place of those of the same keys, columns it lacks by default.

    Versions are written beside each other, so readers of the old one go on and a repeated job gives the same table.
    """
    old = read_table(new.sparkSession, f"{folder}/v{version}", schema) if version else None
    write_table((upserted(old, new, keys) if old is not None else new).na.fill(defaults or {}), f"{folder}/v{version + 1}")
    return new.sparkSession.read.option("header", True).option("inferSchema", True).csv(f"{folder}/v{version + 1}")


def append_log(entries: DataFrame, folder: str) -> None:
    """Entries appended as JSON lines."""
    entries.write.mode("append").json(folder)


def read_log(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(folder)


def write_npz(rows: DataFrame, folder: str) -> int:
    """A .npz for each row (name, keys array<string>, vectors array<array<float>>): an array of each key. How many were written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        put = _putter(folder)
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("name", "keys", "vectors"))):
                name, keys, vectors = (x.as_py() for x in row)
                body = io.BytesIO()
                np.savez(body, **{k: np.array(v, np.float32) for k, v in sorted(zip(keys, vectors))})
                put(name, body.getvalue())
            yield batch.select(["name"])

    bound_batches(rows.sparkSession)
    return rows.select("name", "keys", "vectors").mapInArrow(run, "name string").count()


def read_npz(spark: SparkSession, folder: str, glob: str = "*.npz") -> DataFrame:
    """(name, key, vector) of all arrays of one dimension in .npz files; a damaged file has one row without a key. No pickled object is loaded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    with np.load(io.BytesIO(content), allow_pickle=False) as found:
                        rows = [(k, found[k].astype(float).tolist()) for k in sorted(found.files)]
                except (ValueError, OSError, zipfile.BadZipFile):
                    rows = [(None, None)]
                names = pa.array([path.rpartition("/")[2].removesuffix(".npz")] * len(rows), pa.string())
                yield pa.RecordBatch.from_arrays([names, pa.array([k for k, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.list_(pa.float64()))], ["name", "key", "vector"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.select("path", "content").mapInArrow(run, "name string, key string, vector array<double>")


def work_list(expected: DataFrame, states: DataFrame, key: str = "key") -> DataFrame:
    """(key, state) of expected keys: missing where there is no file, else the state of file_state()."""
    return expected.join(states, key, "left").select(key, F.coalesce("state", F.lit("missing")).alias("state"))


def markdown_table(rows: DataFrame, order: list[str], most: int = 20) -> str:
    """A report's table: the first `most` rows in an order. The limit is the feature."""
    names = rows.columns
    lines = [f"| {' | '.join(names)} |", f"|{'---|' * len(names)}"]
    return "\n".join(lines + ["| " + " | ".join("—" if r[c] is None else str(r[c]) for c in names) + " |" for r in rows.orderBy(*order).limit(most).collect()]) + "\n"

