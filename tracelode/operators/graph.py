"""Dependency graphs of traces: an edge goes from a sentence to the one that declares it."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions.batches import bound_batches, parts
from tracelode.operators.quantiles import quantiles


def edges(rows: DataFrame) -> DataFrame:
    """(trace, src, dst): declared dependencies on sentences of the trace, each once; others are left out."""
    found = rows.select("trace", F.col("sid").alias("dst"), F.explode("depends_on").alias("src")).distinct()
    nodes = rows.select(F.col("trace"), F.col("sid").alias("src"))
    return found.join(nodes, ["trace", "src"], "left_semi").select("trace", "src", "dst")


def degrees(rows: DataFrame) -> DataFrame:
    """(trace, sid, label, n_declared, n_referenced_by)."""
    e = edges(rows)
    declared = e.groupBy("trace", F.col("dst").alias("sid")).agg(F.count("*").alias("n_declared"))
    referenced = e.groupBy("trace", F.col("src").alias("sid")).agg(F.count("*").alias("n_referenced_by"))
    return rows.select("trace", "sid", "label").join(declared, ["trace", "sid"], "left").join(referenced, ["trace", "sid"], "left").na.fill(0)


def degree_by_label(rows: DataFrame) -> DataFrame:
    return degrees(rows).groupBy("label").agg(
        F.count("*").alias("n"), F.avg("n_declared").alias("mean_declared"), F.stddev_pop("n_declared").alias("sd_declared"),
        F.avg("n_referenced_by").alias("mean_referenced_by"), F.stddev_pop("n_referenced_by").alias("sd_referenced_by"),
        (F.stddev_pop("n_declared") / F.sqrt(F.count("*"))).alias("se_declared"),
    )


def collected(rows: DataFrame, *columns: str) -> DataFrame:
    """(trace, nodes array<struct<sid, ...>>): a row a trace, in order of sid. Its size is that of a trace."""
    bound_batches(rows.sparkSession)
    return rows.groupBy("trace").agg(F.array_sort(F.collect_list(F.struct("sid", *columns))).alias("nodes"))


def density(rows: DataFrame) -> DataFrame:
    """(trace, n_nodes, n_edges, density): distinct dependencies on sentences of the trace, joined by sentence, so that no trace is gathered."""
    nodes = rows.select("trace", "sid")
    edges = rows.select("trace", F.explode(F.array_distinct("depends_on")).alias("sid")).join(nodes.distinct(), ["trace", "sid"], "left_semi")
    per = nodes.groupBy("trace").agg(F.count("*").alias("n_nodes")).join(edges.groupBy("trace").agg(F.count("*").alias("n_edges")), "trace", "left").fillna({"n_edges": 0})
    return per.withColumn("density", F.coalesce(F.try_divide(F.col("n_edges"), F.col("n_nodes") * (F.col("n_nodes") - 1)), F.lit(0.0)))


def _strong(out: list[list[int]]) -> list[list[int]]:
    """Strong components by Tarjan, without recursion; they come out dependencies first."""
    index, low, on, stack, order = {}, {}, set(), [], []
    for start in range(len(out)):
        work = [] if start in index else [(start, iter(out[start]))]
        if work:
            index[start] = low[start] = len(index)
            stack.append(start)
            on.add(start)
        while work:
            node, rest = work[-1]
            for d in rest:
                if d not in index:
                    index[d] = low[d] = len(index)
                    stack.append(d)
                    on.add(d)
                    work.append((d, iter(out[d])))
                    break
                if d in on:
                    low[node] = min(low[node], index[d])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    members = []
                    while not members or members[-1] != node:
                        members.append(stack.pop())
                        on.discard(members[-1])
                    order.append(members)
    return order


def _indexed(nodes: list[dict]) -> list[list[int]]:
    """The places of each node's dependencies among the nodes, each once; others are left out."""
    place = {x["sid"]: k for k, x in enumerate(nodes)}
    return [list(dict.fromkeys(place[d] for d in x["depends_on"] or () if d in place)) for x in nodes]


def _shape(nodes: list[dict]) -> tuple[int, int, bool]:
    """Weak components, longest path (a cycle's nodes count as one) and whether there is no cycle."""
    out = _indexed(nodes)
    group = list(range(len(out)))

    def root(k: int) -> int:
        while group[k] != k:
            group[k] = group[group[k]]
            k = group[k]
        return k

    for k, deps in enumerate(out):
        for d in deps:
            group[root(k)] = root(d)
    components = len({root(k) for k in range(len(out))})
    if all(d < k for k, deps in enumerate(out) for d in deps):  # every edge goes backwards: one pass in order
        depth: list[int] = []
        for deps in out:
            depth.append(max((depth[d] + 1 for d in deps), default=0))
        return components, max(depth, default=0), True
    order = _strong(out)
    where = {m: c for c, members in enumerate(order) for m in members}
    depth = []
    for c, members in enumerate(order):
        depth.append(max((depth[where[d]] + 1 for m in members for d in out[m] if where[d] != c), default=0))
    return components, max(depth, default=0), len(order) == len(out) and not any(k in deps for k, deps in enumerate(out))


def shape(rows: DataFrame) -> DataFrame:
    """(trace, n_components, longest_path, acyclic): many traces of a batch in one call."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole)):
            found = [_shape(nodes) for nodes in batch.column("nodes").to_pylist()]
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("trace"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_())))], ["trace", "n_components", "longest_path", "acyclic"])

    return collected(rows, "depends_on").mapInArrow(run, "trace bigint, n_components bigint, longest_path bigint, acyclic boolean")


def metric_row(rows: DataFrame) -> DataFrame:
    """The twelve columns of a trace's graph: what it is of, size, density, components, longest path, mean and most of dependencies declared, most of references."""
    counted = ["n_nodes", "n_edges", "n_components", "longest_path", "most_declared", "most_referenced_by"]

    def measured(nodes: list[dict]) -> tuple[int, ...]:
        out = _indexed(nodes)
        declared, (components, longest, _) = [len(deps) for deps in out], _shape(nodes)
        return len(out), sum(declared), components, longest, max(declared, default=0), max(Counter(d for deps in out for d in deps).values(), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole)):
            columns = list(zip(*map(measured, batch.column("nodes").to_pylist())))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("trace", "task", "set", "completed")), *(pa.array(c, pa.int64()) for c in columns)], ["trace", "task", "set", "completed", *counted])

    # One shuffle and one pass over a trace's nodes: each join of partial results would work out the dependencies again.
    about = [F.first(c).alias(c) for c in ("task", "set", "completed")]
    bound_batches(rows.sparkSession)
    nodes = rows.groupBy("trace").agg(*about, F.array_sort(F.collect_list(F.struct("sid", "depends_on"))).alias("nodes"))
    types = dict(nodes.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in ("trace", "task", "set", "completed")] + [f"{c} bigint" for c in counted])
    pairs = F.col("n_nodes") * (F.col("n_nodes") - 1)
    return nodes.mapInArrow(run, schema).select(
        "trace", "task", "set", "completed", "n_nodes", "n_edges", F.coalesce(F.try_divide("n_edges", pairs), F.lit(0.0)).alias("density"), "n_components", "longest_path",
        F.round(F.col("n_edges") / F.col("n_nodes"), 3).alias("mean_declared"), "most_declared", "most_referenced_by",
    )


def simple_cycles(rows: DataFrame) -> DataFrame:
    """(trace, cycle array<bigint>): every simple cycle of a trace's graph, from its smallest node on along dependencies. Only strong components are searched."""

    def search(nodes: list[dict]) -> list[list[int]]:
        out, found = _indexed(nodes), []
        for members in _strong(out):
            inside = set(members)
            for start in sorted(members):
                path, work = [start], [iter(out[start])]
                while work:
                    for d in work[-1]:
                        if d == start:
                            found.append([nodes[k]["sid"] for k in path])
                        elif d in inside and d > start and d not in path:
                            path.append(d)
                            work.append(iter(out[d]))
                            break
                    else:
                        work.pop()
                        path.pop()
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole)):
            rows = [(t, c) for t, nodes in zip(batch.column("trace").to_pylist(), batch.column("nodes").to_pylist()) for c in search(nodes)]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.int64()), pa.array([c for _, c in rows], pa.list_(pa.int64()))], ["trace", "cycle"])

    return collected(rows, "depends_on").mapInArrow(run, "trace bigint, cycle array<bigint>")


def distances(rows: DataFrame) -> DataFrame:
    """(label, n, mean, median, p95) of how far back sentences reach."""
    far = rows.select("label", "sid", F.explode("depends_on").alias("src")).withColumn("d", F.abs(F.col("sid") - F.col("src")))
    return quantiles(far, ["label"], "d", [0.5, 0.95]).select("label", "n", "mean", F.col("q")[0].alias("median"), F.col("q")[1].alias("p95"))


def coverage(rows: DataFrame) -> DataFrame:
    """(label, n, n_with, n_deps, pct): sentences with a dependency."""
    size = F.size("depends_on")
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if(size > 0).alias("n_with"), F.sum(size).cast("bigint").alias("n_deps"), (100 * F.count_if(size > 0) / F.count("*")).alias("pct"))


def hypothesis_cycles(rows: DataFrame) -> DataFrame:
    """(trace, hypo_sid, judge_sid, length, outcome): each HYPO and the first later JUDGE that declares it; length counts both."""
    judge = rows.where("label = 'JUDGE'").select("trace", F.col("sid").alias("judge_sid"), "judgement", F.explode("depends_on").alias("hypo_sid"))
    hypo = rows.where("label = 'HYPO'").select("trace", F.col("sid").alias("hypo_sid"))
    pairs = judge.where("judge_sid > hypo_sid").join(hypo, ["trace", "hypo_sid"])
    first = pairs.groupBy("trace", "hypo_sid").agg(F.min("judge_sid").alias("judge_sid"), F.min_by("judgement", "judge_sid").alias("outcome"))
    return first.select("trace", "hypo_sid", "judge_sid", (F.col("judge_sid") - F.col("hypo_sid") + 1).alias("length"), "outcome")


def chains(rows: DataFrame) -> DataFrame:
    """(trace, root, length): from every HYPO without antecedent along first children, in one pass over each collected trace."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole)):
            found = []
            for trace, nodes in zip(batch.column("trace").to_pylist(), batch.column("nodes").to_pylist()):
                child, length = {}, {}
                for x in reversed(nodes):  # a child comes after its antecedent, so it is done first
                    length[x["sid"]] = 1 + length.get(child.get(x["sid"]), 0)
                    if x["antecedent"] is not None and x["antecedent"] < x["sid"]:
                        child[x["antecedent"]] = x["sid"]
                found += [(trace, x["sid"], length[x["sid"]]) for x in nodes if x["antecedent"] is None]
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["trace", "root", "length"])

    return collected(rows.where("label = 'HYPO'"), "antecedent").mapInArrow(run, "trace bigint, root bigint, length bigint")


def provenance(rows: DataFrame) -> DataFrame:
    """(trace, rule_sid, judge_sid, hypo_sid, status): the last RULE, a JUDGE it declares, a HYPO that one declares."""
    dep = lambda label, name: rows.where(F.col("label") == label).select("trace", F.col("sid").alias(name), "depends_on")
    last = rows.where("label = 'RULE'").groupBy("trace").agg(F.max("sid").alias("rule_sid"), F.max_by("depends_on", "sid").alias("d"))
    judge = last.select("trace", "rule_sid", F.explode_outer("d").alias("judge_sid")).join(dep("JUDGE", "judge_sid"), ["trace", "judge_sid"])
    judge = judge.groupBy("trace", "rule_sid").agg(F.min("judge_sid").alias("judge_sid"), F.min_by("depends_on", "judge_sid").alias("d"))
    hypo = judge.select("trace", "judge_sid", F.explode("d").alias("hypo_sid")).join(rows.where("label = 'HYPO'").select("trace", F.col("sid").alias("hypo_sid"), "status"), ["trace", "hypo_sid"])
    hypo = hypo.groupBy("trace").agg(F.min("hypo_sid").alias("hypo_sid"), F.min_by("status", "hypo_sid").alias("status"))
    found = last.select("trace", "rule_sid").join(judge.select("trace", "judge_sid"), "trace", "left").join(hypo, "trace", "left")
    return found.select("trace", "rule_sid", "judge_sid", "hypo_sid", F.coalesce("status", F.lit("unknown")).alias("status"))


def low_coverage(rows: DataFrame, under: float = 90.0) -> DataFrame:
    """(trace, pct) of traces in which fewer sentences than that have a dependency, ORIENT left out."""
    per = rows.where("label <> 'ORIENT'").groupBy("trace").agg((100 * F.count_if(F.size("depends_on") > 0) / F.count("*")).alias("pct"))
    return per.where(F.col("pct") < under)


def side_chains(rows: DataFrame) -> DataFrame:
    """(trace, sid, rank): children of a HYPO after its first one, which start chains of their own."""
    hypo = rows.where("label = 'HYPO' AND antecedent IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("trace", "antecedent").orderBy("sid"))
    return hypo.withColumn("rank", rank).where("rank > 1").select("trace", "sid", "rank")
