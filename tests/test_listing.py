"""The listing source: depths, patterns, empty files, folders that aren't there."""

from __future__ import annotations

import pytest

from tracelode.sources import traces as S
from tracelode.sources.listing import ListingReader, listed


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    at = tmp_path_factory.mktemp("tree")
    for name in ("top.json", "set_a/side.json", "set_a/task1/trace_1.json", "set_a/task1/deep/er/trace_2.json", "set_a/task2/trace_3.json", "set_b/task1/trace_4.json", "set_b/task1/notes.txt"):
        (at / name).parent.mkdir(parents=True, exist_ok=True)
        (at / name).write_bytes(b"x" * (len(name) % 3))
    (at / "set_c/task9").mkdir(parents=True)
    return at


def names(frame, at):
    return sorted(r.path[len(str(at)) + 1 :] for r in frame.collect())


@pytest.mark.parametrize("depth", [0, 1, 2, 5])
def test_all_files_once_at_any_depth(spark, tree, depth):
    got = listed(spark, f"file://{tree}", depth=depth)
    every = sorted(str(p.relative_to(tree)) for p in tree.rglob("*") if p.is_file())
    assert names(got, tree) == every and {r.path: r.size for r in got.collect()} == {str(tree / n): (tree / n).stat().st_size for n in every}


def test_patterns(spark, tree):
    assert names(listed(spark, str(tree), "trace_*.json", "set_a"), tree) == ["set_a/task1/deep/er/trace_2.json", "set_a/task1/trace_1.json", "set_a/task2/trace_3.json"]
    assert names(listed(spark, str(tree), "*", "*/task1"), tree) == ["set_a/task1/deep/er/trace_2.json", "set_a/task1/trace_1.json", "set_b/task1/notes.txt", "set_b/task1/trace_4.json"]
    assert [p.name for p in ListingReader(str(tree), "*", "set_b/*", 2).partitions() if not p.flat] == ["set_b/task1"]
    assert listed(spark, f"{tree}/nowhere").count() == 0 and listed(spark, f"{tree}/set_c").count() == 0


def test_documents_are_read_from_the_listing(spark, tmp_path):
    """Tasks read the files: no list of them in the plan. Arrays, marks, faults and blank files are as the JSON reader has them."""
    bodies = {"one": '﻿{"task_id": 1, "trace_id": 7, "set": "A"}', "two": '[{"task_id": 1, "trace_id": 8}, {"trace_id": 9}]', "cut": '{"task_id": 1', "number": "5", "odd": '{"trace_id": "x", "set": "B"}', "blank": " \n", "empty": ""}
    for name, body in bodies.items():
        (tmp_path / f"{name}.json").write_text(body, encoding="utf-8")
    found = S.read_traces(spark, f"file://{tmp_path}")
    assert "FileScan" not in found._jdf.queryExecution().toString()
    got = sorted((r.path.rpartition("/")[2][:-5], r.trace_id, r.set, r._corrupt is not None) for r in found.na.fill(-1, ["trace_id"]).na.fill("", ["set"]).collect())
    assert got == [("cut", -1, "", True), ("number", -1, "", True), ("odd", -1, "B", True), ("one", 7, "A", False), ("two", 8, "", False), ("two", 9, "", False)]
    assert [r.trace_id for r in S.read_traces(spark, str(tmp_path / "one.json")).collect()] == [7]
    assert S.read_traces(spark, f"file://{tmp_path}/nowhere").count() == 0
