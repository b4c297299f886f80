"""Traces numbered from 1000 on: short keys coincide, what lies under them must not."""

from __future__ import annotations

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tracelode.sources import traces as S

#: Numbers that share three places, set and task with others, and some that share a state or a form of response too.
USERS = [4, 7, 43, 100, 104, 1000, 1001, 1004, 1008, 1009, 1040, 1043, 1047, 10043, 10083, 1048, 10480, 1056, 10560, 105600, 102, 1022, 1026]


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("wide")
    kinds = ["view", "click", "signup", "purchase", "error"]
    rows = [(u * 31 + k * 7 + n, datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=n * 5 + k), u, kinds[(u + k * k) % 5], float(k), None) for n, u in enumerate(USERS) for k in range(8 + u % 2)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").coalesce(1).write.parquet(f"{at}/events.parquet")
    return str(at)


def both(spark, wide, name, leave=()):
    found = entry.queries()[name](spark, wide)
    columns = [c for c in found.columns if c not in leave]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{wide}/events.parquet/*.parquet')")
    said = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    key = lambda rows: sorted(map(repr, rows))
    return key(tuple(r) for r in found.select(*columns).collect()), key(said)


def test_no_two_traces_share_a_key(spark):
    rows = spark.createDataFrame([(t,) for t in (7, 42, 100, 999, 1000, 1004, 10043)], "t bigint")
    keys = [r[0] for r in rows.select(S.trace_key(F.lit("A"), F.lit(1), F.col("t"))).collect()]
    assert [k[12:] for k in keys] == ["trace_007", "trace_042", "trace_100", "trace_999", "trace_1000", "trace_1004", "trace_10043"]
    assert [r[0] for r in rows.select(S.short_key(S.trace_key(F.lit("A"), F.lit(1), F.col("t")))).collect()] == [k[:21] for k in keys]


@pytest.mark.parametrize("name", ["ex10_download_log", "ex10_results_by_type", "jn01_merged_codings", "sc02_marked_files", "sc04_file_states", "sc06_valid_work_list", "sc08_discovered_files", "sk08_dead_letter_files"])
def test_as_in_sql(spark, wide, name):
    got, said = both(spark, wide, name)
    assert got == said


def test_read_traces_has_all_sentences(spark, wide):
    # any_value(completed) is open where traces that share a short key differ.
    got, said = both(spark, wide, "sc01_read_traces", ("completed",))
    assert got == said


def test_read_traces_completed(spark, wide):
    # SQL says it where a key's traces agree; elsewhere it is the smallest trace's.
    sql = entry.oracle_sql()["sc01_read_traces"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{wide}/events.parquet/*.parquet')")
    assert sql.count("any_value(completed) AS completed") == 1
    said = con.execute(sql.replace("any_value(completed) AS completed", "arg_min(completed, trace) AS completed, bool_and(completed) = bool_or(completed) AS agree")).fetchall()
    assert {r[2] for r in said} == {True, False}
    assert {r[0]: r[1] for r in said} == {r.key: r.completed for r in entry.queries()["sc01_read_traces"](spark, wide).collect()}
    closed = {r[0]: r[1] for r in said if r[2]}
    assert closed == {k: v for k, v, *_ in con.execute(sql).fetchall() if k in closed}
