"""What the corpus operators share: the cluster's shared folder, prefix sums, column names and views of Arrow text."""

from __future__ import annotations

import ctypes
import os
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a worker turns into arrays at a time (a longer single text is taken alone).
SLICE_BYTES = 4 << 20


#: Folders of this process that no discard() has removed.
_FOLDERS: set[str] = set()


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder below spark.checkpoint.dir, as a URI. Only a local session may do without that setting: a folder of its own takes its place."""
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", "") or conf.get("spark.checkpoint.dir", "")
    if not base:
        if not conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="tracelode-")
        spark.conf.set("spark.checkpoint.dir", base)
    if base.startswith("file:/") and not base.startswith("file:///"):
        base = "file:///" + base[6:].lstrip("/")
    elif "://" not in base:
        base = "file://" + os.path.abspath(base)
    folder = f"{base.rstrip('/')}/tracelode-{tag}-{uuid.uuid4().hex}"
    _FOLDERS.add(folder)
    return folder


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: what follows no longer depends on any executor."""
    spark = df.sparkSession
    folder = shared_folder(spark, tag)
    df.write.parquet(folder)
    table = spark.read.schema(df.schema).parquet(folder)
    table._folder = folder
    return table


def discard(*tables: DataFrame | str | None) -> None:
    """Removes the folders of written() tables that nothing reads any more. One that this machine can't reach stays."""
    for table in tables:
        if folder := table if isinstance(table, str) else getattr(table, "_folder", None):
            try:
                fs, path = file_system(folder)
                fs.delete_dir(path)
            except (OSError, pa.ArrowException):
                continue
            _FOLDERS.discard(folder)


def clear() -> None:
    """Removes all folders that this process made; for when results are saved elsewhere."""
    discard(*list(_FOLDERS))


def spread(df: DataFrame, small: int = 256 << 20) -> DataFrame:
    """A small table that lies in fewer files than there are cores is dealt out to all of them; any other stays as it is."""
    spark, files = df.sparkSession, df.inputFiles()
    cores = spark.sparkContext.defaultParallelism
    if not files or len(files) >= cores:
        return df
    size = spark.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0] or 0
    return df if size > small else df.repartition(cores)


def unused(columns: list[str], name: str) -> str:
    """name, with as many underscores behind it as set it apart from all columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def before(counts: DataFrame, at: str, n: str, keys: tuple[str, ...] = (), width: int = 4096) -> DataFrame:
    """counts with _base: the sum of n over rows of the same keys and a smaller `at` (whole numbers from 0, no repeats).

    In two levels: within stretches of `width` values of `at`, then over the stretches' sums, so that no task sorts more
    than a stretch, or a 1 / width part of all rows.
    """
    part = F.floor(F.col(at) / width)
    low = counts.withColumn("_part", part)
    inner = Window.partitionBy(*keys, "_part").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = low.groupBy(*keys, "_part").agg(F.sum(n).alias("_sum"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(outer), F.lit(0))).drop("_sum")
    found = low.withColumn("_base", F.coalesce(F.sum(n).over(inner), F.lit(0))).join(sums, [*keys, "_part"])
    return found.withColumn("_base", F.col("_base") + F.col("_before")).drop("_part", "_before")


def repeated_rows(rows: DataFrame, n: str, index: str, block: int = 8192) -> DataFrame:
    """Each row n times, numbered from 0 in `index`. Rows of large n are dealt out in blocks before they are repeated."""
    few = rows.where(F.col(n) <= block).withColumn(index, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)))
    many = rows.where(F.col(n) > block).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(n) - 1) / block))))
    many = many.repartition(rows.sparkSession.sparkContext.defaultParallelism, "_block")
    first = F.col("_block") * block
    many = many.withColumn(index, F.explode(F.sequence(first, F.least(first + block, F.col(n)) - 1))).drop("_block")
    return few.unionByName(many).drop(n)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches to Python workers are cut by bytes, so that long texts don't add up."""
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", "16777216"), ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")):
        try:
            spark.conf.set(key, value)
        except Exception:  # noqa: BLE001 - a Spark without the setting keeps its row bound
            continue


#: Functions whose caches a worker keeps from one task to the next.
_CACHES: list = []


def kept(cached: Callable) -> Callable:
    """An lru_cache() whose values stay in a worker until a task of another operator comes."""
    _CACHES.append(cached)
    return cached


def give_back() -> None:
    """Gives this process's free memory back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def release(own: tuple[Callable, ...]) -> None:
    """Drops what kept() functions other than `own` hold in this process."""
    held = [c for c in _CACHES if c not in own and c.cache_info().currsize]
    for cached in held:
        cached.cache_clear()
    if held:
        give_back()


def returned(run: Callable[[Iterator], Iterator], *own: Callable) -> Callable[[Iterator], Iterator]:
    """run, after which its worker gives free memory back to the system, and before which it drops other operators' caches than
    `own`: workers are used again by later stages."""

    def task(batches: Iterator) -> Iterator:
        release(own)
        yield from run(batches)
        give_back()

    return task


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def local_path(uri: str) -> str | None:
    return uri[7:] if uri.startswith("file://") else uri if "://" not in uri else None


def write_bytes(uri: str, *parts: bytes | memoryview | np.ndarray) -> None:
    """A whole file in one go; the folder is made if needed."""
    fs, path = file_system(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as out:
        for part in parts:
            out.write(np.ascontiguousarray(part).tobytes() if isinstance(part, np.ndarray) else part)


def save_object(uri: str, value) -> None:
    """A pickled object; its arrays lie apart from it, so that load_object() can map them to memory."""
    buffers: list[pickle.PickleBuffer] = []
    body = pickle.dumps(value, protocol=5, buffer_callback=buffers.append)
    parts = [body, *(b.raw() for b in buffers)]
    sizes = np.array([len(parts), *(p.nbytes if isinstance(p, memoryview) else len(p) for p in parts)], "<i8")
    fs, path = file_system(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as out:
        place = 0
        for part in [sizes.tobytes(), *parts]:
            out.write(bytes(-place % 64))
            place += -place % 64
            out.write(part)
            place += len(part) if isinstance(part, bytes) else part.nbytes


def load_object(uri: str):
    """The object that save_object() wrote; its arrays are mapped to memory where the shared folder is mounted."""
    data = map_array(uri, "u1")
    count = int(data[:8].view("<i8")[0])
    sizes = data[8 : 8 * (count + 1)].view("<i8").tolist()
    place, parts = 8 * (count + 1), []
    for size in sizes:
        place += -place % 64
        parts.append(data[place : place + size])
        place += size
    return pickle.loads(parts[0].tobytes(), buffers=parts[1:])


def map_array(uri: str, dtype: str) -> np.ndarray:
    """The file as an array, memory-mapped if the shared folder is mounted and read otherwise."""
    if path := local_path(uri):
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.empty(0, dtype)
    fs, path = file_system(uri)
    with fs.open_input_file(path) as source:
        return np.frombuffer(source.read(), dtype=dtype)


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a column and the n + 1 offsets of its texts. A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return flat, at - at[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold about `most` bytes, a longer text alone. Empty batches give nothing."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
    start, held = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += size
    yield batch.slice(start)
