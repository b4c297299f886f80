"""The versioned manifest: writers at once, conflicts, snapshots, compaction."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tracelode.sources import manifest as M


def rows(spark, pairs, schema="k bigint, v string"):
    return spark.createDataFrame(pairs, schema)


def held(frame):
    return sorted(map(tuple, frame.collect()))


def test_versions_are_snapshots(spark, tmp_path):
    table = M.Manifest(spark, f"file://{tmp_path}/m", ["k"])
    assert table.version().number == 0 and table.snapshot() is None and table.compact() is None
    assert table.upsert(rows(spark, [(1, "a"), (2, "b"), (2, "c"), (2, None)])) == (1, 2)
    assert table.upsert(rows(spark, [(2, "d"), (3, None), (None, "e")])) == (2, 3)
    assert table.upsert(rows(spark, [])) == (3, 0)
    assert held(table.snapshot(1)) == [(1, "a"), (2, "c")] and sorted(map(str, held(table.snapshot(2).fillna(0)))) == sorted(map(str, [(0, "e"), (1, "a"), (2, "d"), (3, None)]))
    assert table.upsert(rows(spark, [(1, 5)], "k bigint, n int")) == (4, 1)
    assert held(table.snapshot().where("k = 1").select("k", "v", "n")) == [(1, None, 5)]
    before = sorted(map(str, table.snapshot().collect()))
    assert table.compact() == 5 and len(table.version().folders) == 1 and sorted(map(str, table.snapshot().collect())) == before and table.compact() is None
    with pytest.raises(KeyError):
        table.snapshot(9)


def test_two_writers_at_once_lose_no_row(spark, tmp_path):
    uri = f"file://{tmp_path}/m"
    write = lambda w: [M.Manifest(spark, uri, ["k"]).upsert(rows(spark, [(100 * w + t, f"{w}"), (7, f"{w}-{t}")]))[0] for t in range(4)]
    with ThreadPoolExecutor(3) as pool:
        numbers = sorted(n for found in pool.map(write, range(1, 4)) for n in found)
    got = dict(held(M.Manifest(spark, uri, ["k"]).snapshot()))
    assert numbers == list(range(1, 13)) and set(got) == {7} | {100 * w + t for w in range(1, 4) for t in range(4)}


def test_conflicts_are_retried_and_a_compaction_keeps_what_came_meanwhile(spark, tmp_path):
    uri, other, tries = f"file://{tmp_path}/m", [], []

    def beaten(name, body):
        """Another writer is first, once."""
        tries.append(name)
        if other:
            other.pop()()
        return M.created(name, body)

    plain, slow = M.Manifest(spark, uri, ["k"]), M.Manifest(spark, uri, ["k"], beaten)
    plain.upsert(rows(spark, [(1, "a"), (2, "a")]))
    other.append(lambda: plain.upsert(rows(spark, [(1, "b"), (3, "b")])))
    assert slow.upsert(rows(spark, [(1, "c")]))[0] == 3 and len(tries) == 2 and held(plain.snapshot()) == [(1, "c"), (2, "a"), (3, "b")]
    other.append(lambda: plain.upsert(rows(spark, [(2, "d")])))
    assert slow.compact() == 5 and len(plain.version().folders) == 2 and held(plain.snapshot()) == [(1, "c"), (2, "d"), (3, "b")]
    other.append(plain.compact)
    assert slow.compact() is None and held(plain.snapshot()) == [(1, "c"), (2, "d"), (3, "b")]
    never = M.Manifest(spark, uri, ["k"], lambda name, body: False)
    M.WAIT, wait = 0, M.WAIT
    with pytest.raises(TimeoutError):
        never.upsert(rows(spark, [(9, "x")]))
    M.WAIT = wait
    assert 9 not in dict(held(plain.snapshot()))


def test_a_file_is_made_once_and_only_where_that_is_sure(tmp_path):
    assert M.created(f"file://{tmp_path}/a/b", b"1") and not M.created(f"{tmp_path}/a/b", b"2") and [p.read_bytes() for p in (tmp_path / "a").iterdir()] == [b"1"]
    with pytest.raises(ValueError):
        M.created("s3://bucket/a", b"")


def test_upserted_columns_of_keys_alone(spark, tmp_path):
    table = M.Manifest(spark, f"file://{tmp_path}/m", ["k"])
    table.upsert(rows(spark, [(1,), (1,)], "k bigint"))
    table.upsert(rows(spark, [(1,), (2,)], "k bigint").withColumn("v", F.lit("x")))
    assert held(table.snapshot()) == [(1, "x"), (2, "x")]
