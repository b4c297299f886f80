"""How much of a table a Python worker is handed at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of an Arrow batch to a Python worker, about.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches to Python workers are cut by bytes, so that long rows don't add up."""
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    except Exception:  # noqa: BLE001 - a Spark without the setting keeps its row bound
        pass


def parts(batch: pa.RecordBatch, most: int = 64) -> Iterator[pa.RecordBatch]:
    """A batch by so many rows, for rows that become Python objects: those take many times a batch's bytes."""
    for start in range(0, batch.num_rows, most):
        yield batch.slice(start, most)
