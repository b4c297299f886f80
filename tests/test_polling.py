"""Polled batches against counting by hand: one read, several micro-batches, a key that expires."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tracelode.streaming import polling

START = datetime(2024, 1, 1)
STATUSES = ["view", "click"]


def _write(spark, rows, folder, mode="append"):
    made = [(k, None if m is None else START + timedelta(minutes=m), s) for k, m, s in rows]
    spark.createDataFrame(made, "k bigint, ts timestamp, status string").coalesce(1).write.mode(mode).parquet(folder)


def _run(spark, source, folder, files=None):
    stream = spark.readStream.schema("k bigint, ts timestamp, status string")
    stream = stream.option("maxFilesPerTrigger", files) if files else stream
    changes = polling.polled(stream.parquet(source), "k", "ts", "status", STATUSES, 60, "10 minutes")
    return {r.k: (r.n, r.view, r.click, (r.last_ms - r.first_ms) // 60000, r.state) for r in polling.landed(spark, changes, "k", folder).collect()}


def test_states_of_keys(spark, tmp_path):
    rows = [(1, 0, "view"), (1, 30, "click"), (1, 10, "view"), (2, 200, None), (2, 150, "other"), (3, 130, "click"), (3, 129, "click"), (None, 5, "view"), (4, None, "view")]
    _write(spark, rows, str(tmp_path / "in"))
    # The watermark ends at 190: key 1 was last seen at 30, key 3 at 130, which is not more than 60 minutes before.
    wanted = {1: (3, 2, 1, 30, "expired"), 2: (2, 0, 0, 50, "open"), 3: (2, 0, 2, 1, "open")}
    assert _run(spark, str(tmp_path / "in"), str(tmp_path / "one")) == wanted


def test_several_micro_batches(spark, tmp_path):
    for part in ([(1, 0, "view"), (2, 1, "click")], [(1, 20, "click"), (3, 40, "view")], [(3, 45, "view"), (1, 50, "view")], [(5, 300, "view")]):
        _write(spark, part, str(tmp_path / "in"))
    got = _run(spark, str(tmp_path / "in"), str(tmp_path / "many"), 1)
    assert got == {1: (3, 2, 1, 50, "expired"), 2: (1, 0, 1, 0, "expired"), 3: (2, 2, 0, 5, "expired"), 5: (1, 1, 0, 0, "open")}
    # A second run of the same log finds nothing new.
    assert _run(spark, str(tmp_path / "in"), str(tmp_path / "many"), 1) == got


def test_no_events(spark, tmp_path):
    _write(spark, [(1, 0, "view")], str(tmp_path / "in"))
    spark.read.parquet(str(tmp_path / "in")).where(F.lit(False)).write.parquet(str(tmp_path / "none"))
    assert _run(spark, str(tmp_path / "none"), str(tmp_path / "out")) == {}
