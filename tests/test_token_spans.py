"""Token spans of odd documents against their SQL: empty texts, texts without tokens, documents that share an id or lack one."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tracelode.functions import text as T

LONG = "".join(f"w{k} " + " " * (k % 40) for k in range(40))[:600]


@pytest.mark.parametrize(
    "texts",
    [
        [(1, "Some words here."), (2, "")],
        [(1, ""), (1, "words"), (2, "--- ---"), (3, None), (4, "a"), (5, LONG), (6, LONG + LONG)],
        [(1, "Some words here."), (1, "... more words"), (1, "... more words"), (2, LONG), (2, " " * 100), (2, "x" * 599)],
        [(1, "Some words here."), (None, "more words"), (None, "others, of another text")],
    ],
    ids=["empty", "without_tokens", "shared", "without_id"],
)
def test_as_in_sql(spark, tmp_path, texts):
    spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    said = con.execute(entry.oracle_sql()["tx27_token_spans"]).fetchall()
    got = entry.queries()["tx27_token_spans"](spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, said))


def test_tokens_are_never_broadcast(spark, tmp_path):
    plan = lambda found: found._jdf.queryExecution().executedPlan().toString()
    spark.createDataFrame([(1, "Some words here.")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert "Join" not in plan(entry.queries()["tx27_token_spans"](spark, str(tmp_path)))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumnRenamed("doc_id", "trace")
    spans = docs.select("trace", F.lit(0).alias("start_char"), F.lit(5).alias("end_char"))
    found = T.token_spans(spans, docs.select("trace", T.token_places(F.col("text")).alias("tokens")))
    assert "SortMergeJoin" in plan(found) and "Broadcast" not in plan(found)
    assert [(r.span_start, r.span_end) for r in found.collect()] == [(0, 0)]
