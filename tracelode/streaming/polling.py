"""Polled batches: status events folded into a state for each key, with an event-time timer for keys that fall silent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def polled(events: DataFrame, key: str, ts: str, status: str, statuses: list[str], expiry_minutes: int, late: str = "2 hours") -> DataFrame:
    """(key, n, a count for each of statuses, first_ms, last_ms, state): a row for each key that a micro-batch changes.

    state is open, or expired once the watermark has passed the key's last event by more than expiry_minutes; then the
    key's state is dropped, and later events begin anew. Counts, first and last don't depend on the order of events, so
    a key's rows are folded batch by batch of Arrow rows and never gathered. Rows without key or time are left out; a
    null status and ones not listed count in n alone.
    """
    kind = events.schema[key].dataType.simpleString()
    names = ["n", *(f"n_{k}" for k in range(len(statuses))), "first_ms", "last_ms"]
    held = ", ".join(f"{name} bigint" for name in names)

    def row(found: tuple, values: tuple, state: str) -> pd.DataFrame:
        return pd.DataFrame([(*found, *values, state)], columns=["key", *names, "state"])

    def fold(found: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            values = state.get
            state.remove()
            yield row(found, values, "expired")
            return
        *counts, first, last = state.get if state.exists else [0] * (len(statuses) + 1) + [None, None]
        for part in parts:
            seen = part["status"].value_counts()
            counts = [n + int(k) for n, k in zip(counts, [len(part), *(seen.get(s, 0) for s in statuses)])]
            low, high = int(part["at"].min()), int(part["at"].max())
            first, last = (low, high) if first is None else (min(first, low), max(last, high))
        values = (*counts, first, last)
        state.update(values)
        state.setTimeoutTimestamp(max(last + expiry_minutes * 60_000, state.getCurrentWatermarkMs() + 1))
        yield row(found, values, "open")

    kept = events.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("time"), F.col(status).alias("status")).where(F.col("key").isNotNull() & F.col("time").isNotNull())
    timed = kept.withColumn("at", F.unix_millis("time")).withWatermark("time", late)
    found = timed.groupBy("key").applyInPandasWithState(fold, f"key {kind}, {held}, state string", held, "update", GroupStateTimeout.EventTimeTimeout)
    return found.toDF(key, "n", *statuses, "first_ms", "last_ms", "state")


def landed(spark: SparkSession, changes: DataFrame, key: str, folder: str) -> DataFrame:
    """The last row of each key once all input that is there has been read.

    Each micro-batch is written under its number, so a batch that runs again after a failure replaces its own rows.
    """

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    changes.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/rows")
    columns = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("_last")).select(key, "_last.*")
