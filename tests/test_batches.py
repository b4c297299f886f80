"""How much of a table a Python worker holds at a time."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tracelode.functions import batches
from tracelode.functions import text as T
from tracelode.operators import graph as G
from tracelode.sources import files as X


def test_parts_are_all_rows_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array(range(150))], ["x"])
    assert [p.num_rows for p in batches.parts(batch)] == [64, 64, 22] and [x for p in batches.parts(batch) for x in p.column("x").to_pylist()] == list(range(150))


def test_batches_are_cut_by_bytes(spark):
    batches.bound_batches(spark)
    sizes = lambda it: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in it)
    rows = spark.range(400).coalesce(1).select(F.repeat(F.lit("x"), 100_000).alias("t"))
    assert rows.mapInArrow(sizes, "n bigint").agg(F.max("n")).first()[0] < 2 * batches.BATCH_BYTES


def test_no_more_graphs_at_once_than_a_part(spark, monkeypatch):
    """Nodes become Python objects by parts of a batch, with the same rows."""
    rows = spark.range(200 * 5).select((F.col("id") % 200).alias("trace"), F.floor(F.col("id") / 200).alias("sid"), F.lit(1).alias("task"), F.lit("a").alias("set"), F.lit(True).alias("completed"))
    rows = rows.withColumn("depends_on", F.when(F.col("sid") > 0, F.array(F.col("sid") - 1, F.col("sid") - 1, F.lit(99).cast("bigint"))).otherwise(F.array().cast("array<bigint>")))
    row = {r.asDict().pop("trace"): r for r in G.metric_row(rows).collect()}
    assert len(row) == 200 and all(tuple(r)[1:] == (1, "a", True, 5, 4, 0.2, 1, 4, 0.8, 1, 1) for r in row.values())
    plan = G.metric_row(rows)._jdf.queryExecution().toString()
    assert plan.count("Join") == 0
    assert G.shape(rows).where("n_components = 1 AND longest_path = 4 AND acyclic").count() == 200 and G.simple_cycles(rows).count() == 0


def test_files_of_long_rows(spark, tmp_path):
    rows = spark.range(300).coalesce(1).select(F.concat(F.lit("d"), F.col("id") % 3, F.lit("/f"), "id").alias("name"), F.repeat(F.lit("é"), 50_000).alias("body"))
    assert X.write_files(rows, f"file://{tmp_path}") == 300
    found = [p for p in tmp_path.rglob("f*") if p.is_file()]
    assert len(found) == 300 and {p.stat().st_size for p in found} == {100_000}
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b") == str(batches.BATCH_BYTES)


def test_repeats_hold_a_few_texts_at_a_time(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    sizes = F.pandas_udf(lambda x: pd.Series([len(x)] * len(x)), "bigint")
    rows = spark.range(400).coalesce(1).select(F.when(F.col("id") % 2 == 0, F.repeat(F.lit("abcdefg-"), 12_500)).otherwise(F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda x: x.cast("string")))).alias("t"))
    assert rows.select(T.repeats(F.col("t"), 50, 3).alias("r")).groupBy("r").count().orderBy("r").collect() == [(False, 200), (True, 200)]
    assert rows.select(sizes("t").alias("n")).agg(F.max("n")).first()[0] < 100
