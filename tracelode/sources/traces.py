"""Reading and writing traces: JSON documents, keys, selectors, work lists, incremental tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tracelode.operators.aggregates import keep_last
from tracelode.sources.listing import listed, plain_path

CODING = "struct<macro_label:string,micro_label:string,confidence:string,test_context:string,specificity:string,judgement:string,representation:string,hypo_status:string,hypo_antecedent_sid:int,depends_on:array<int>>"
SENTENCE = f"struct<sentence_id:int,text:string,start_char:int,end_char:int,token_count:int,coding:{CODING}>"
TRACE = f"task_id int, trace_id int, `set` string, seed int, prompt string, raw_output string, thinking_text string, answer_text string, thinking_tokens int, total_tokens int, prompt_tokens int, truncated boolean, generation_params struct<temperature:double,top_p:double,max_new_tokens:int>, generation_time_seconds double, timestamp string, model string, quantization string, sentences array<{SENTENCE}>, _corrupt string"
REQUIRED = ("task_id", "trace_id", "set")


#: Bytes of files that a task holds at a time (a longer file alone), and tasks a core that read files.
READ_BYTES, READ_TASKS = 4 << 20, 4


def read_texts(files: DataFrame, root: str) -> DataFrame:
    """(path, body): the text of each of the listed files, which tasks deal out and read. A byte order mark goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        row = lambda found: pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([b for _, b in found], pa.string())], ["path", "body"])
        for batch in batches:
            found, held = [], 0
            for path in batch.column("path").to_pylist():
                with store.open_input_stream(path) as source:
                    raw = source.read()
                found.append((path, raw.decode("utf-16" if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8-sig", "replace")))
                held += len(raw)
                if held > READ_BYTES:
                    yield row(found)
                    found, held = [], 0
            if found:
                yield row(found)

    tasks = files.sparkSession.sparkContext.defaultParallelism * READ_TASKS
    return files.select("path").repartition(tasks, "path").mapInArrow(run, "path string, body string")


def read_traces(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """One row a document, with its path; a document that is no JSON has only _corrupt and path. A file may hold an array of documents.

    Tasks list and read the files: neither a list of them nor a task for each few of them is the driver's.
    """
    texts = read_texts(listed(spark, path, glob).where("size > 0"), path).where(F.trim("body", F.lit(" \t\n\r")) != "")
    options = {"columnNameOfCorruptRecord": "_corrupt"}
    one = F.array(F.from_json("body", TRACE, options))
    many = F.when(F.ltrim("body", F.lit(" \t\n\r")).startswith("["), F.from_json("body", f"array<struct<{TRACE}>>"))
    return texts.select("path", F.explode(F.coalesce(many, one)).alias("t")).select("t.*", "path")


def file_state(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(path, state): ok, empty, corrupt or incomplete, for each file."""
    # Scans pass over files without bytes; the listing has them.
    files = listed(spark, path, glob)
    read = read_traces(spark, path, glob)
    whole = F.lit(True)
    for c in REQUIRED:
        whole = whole & F.col(c).isNotNull()
    seen = read.select(plain_path(F.col("path")).alias("path"), "_corrupt", whole.alias("whole"))
    state = F.when(F.col("size") == 0, "empty").when(F.col("_corrupt").isNotNull() | F.col("whole").isNull(), "corrupt").when(~F.col("whole"), "incomplete").otherwise("ok")
    return files.join(seen, "path", "left").select("path", state.alias("state"))


def trace_key(set_: Column, task: Column, trace: Column) -> Column:
    """set_x/taskN/trace_NNN, a number of at least three places; longer numbers have all of theirs, so that no two traces share a key."""
    number = trace.cast("string")
    return F.concat(F.lit("set_"), F.lower(set_), F.lit("/task"), task.cast("string"), F.lit("/trace_"), F.lpad(number, F.greatest(F.length(number), F.lit(3)), F.lit("0")))


def short_key(key: Column) -> Column:
    """A key as reports have it: its number is cut after three places, so traces from 1000 on share one. Never a file's name or a join's key."""
    return F.regexp_replace(key, r"(trace_\d{3})\d+", "$1")


def trace_group(set_: Column, budget: Column) -> Column:
    """A trace's group by set and token budget; fixed values."""
    in_b = F.when(budget == 4096, "Set B (4096)").when(budget == 6144, "Set B (6144)").otherwise("UNEXPECTED")
    return F.when(F.upper(set_) == "A", "Set A").when(F.upper(set_) == "B", in_b).otherwise("UNEXPECTED")


def seed(set_: Column, task: Column, trace: Column) -> Column:
    """The seed that a trace is generated with: thousands by task, the second set 500 on."""
    return task * 1000 + F.when(F.upper(set_) == "A", 0).otherwise(500) + trace


def plural_panels(specificity: Column) -> Column:
    return F.when(specificity == "across_panel", "across_panels").otherwise(specificity)


def steered_seed(task: Column, trace: Column) -> Column:
    return task * 1000 + 800 + trace


def key_from_path(path: Column) -> Column:
    return F.regexp_extract(path, r"(set_[a-z]/task\d+/trace_\d+)", 1)


def encode_key(key: Column) -> Column:
    return F.replace(key, F.lit("/"), F.lit("__"))


def decode_key(key: Column) -> Column:
    return F.replace(key, F.lit("__"), F.lit("/"))


def expected_keys(spark: SparkSession, sets: list[str], tasks: list[int], first: int, last: int) -> DataFrame:
    """(set, task, trace_id) of every trace there should be."""
    base = spark.range(first, last + 1).select(F.col("id").alias("trace_id"))
    return base.withColumn("set", F.explode(F.array(*map(F.lit, sets)))).withColumn("task", F.explode(F.array(*map(F.lit, tasks))))


def missing(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(found, keys, "left_anti")


def selector(text: str, key: str = "trace_key", validation: tuple[str, ...] = ()) -> Column:
    """A predicate from `all`, `validation`, set_x, taskN, set_x/taskN, whole keys, and comma-separated unions; case does not matter."""
    found = F.lit(False)
    for part in (p.strip().lower() for p in text.split(",") if p.strip()):
        if part == "all":
            return F.lit(True)
        if part == "validation":
            found = found | F.col(key).isin(*validation)
        elif re.fullmatch(r"set_[a-z]", part):
            found = found | F.col(key).startswith(part + "/")
        elif re.fullmatch(r"task\d+", part):
            found = found | F.contains(F.col(key), F.lit(f"/{part}/"))
        elif re.fullmatch(r"set_[a-z]/task\d+", part):
            found = found | F.col(key).startswith(part + "/")
        elif re.fullmatch(r"set_[a-z]/task\d+/trace_\d+", part):
            found = found | (F.col(key) == part)
        else:
            raise ValueError(f"unknown selector {part!r}")
    return found


def flatten(traces: DataFrame) -> DataFrame:
    """The sentence table of trace documents: one row a sentence with its place in the trace."""
    completed = F.coalesce(F.length(F.regexp_replace("answer_text", r"(?U)^\s+|\s+$", "")) > 0, F.lit(False))
    rows = traces.select(trace_key(F.col("set"), F.col("task_id"), F.col("trace_id")).alias("trace_key"), "set", "task_id", "trace_id", completed.alias("completed"), F.size("sentences").alias("trace_length"), F.posexplode("sentences").alias("position_idx", "s"))
    c = F.col("s.coding")
    at = F.col("position_idx") / F.greatest(F.col("trace_length") - 1, F.lit(1))
    return rows.select(
        "trace_key", "set", "task_id", "trace_id", "completed", F.col("s.sentence_id").alias("sentence_id"), F.col("s.text").alias("text"), F.col("s.token_count").alias("token_count"), "position_idx", "trace_length", at.alias("position_norm"),
        F.when(at <= 1 / 3, "early").when(at <= 2 / 3, "middle").otherwise("late").alias("position_third"), c["micro_label"].alias("micro_label"), c["macro_label"].alias("macro_label"), c["confidence"].alias("confidence"), c["test_context"].alias("test_context"),
        plural_panels(c["specificity"]).alias("specificity"), c["judgement"].alias("judgement"), c["depends_on"].alias("depends_on"), F.coalesce(F.size(c["depends_on"]), F.lit(0)).alias("n_dependencies"), c["hypo_status"].alias("hypo_status"), c["hypo_antecedent_sid"].alias("hypo_antecedent_sid"),
    )


def merge_codings(sentences: DataFrame, codings: DataFrame, order: str) -> DataFrame:
    """Sentences with their coding by (trace_key, sentence_id); the last of several wins, codings of no sentence go."""
    return sentences.join(keep_last(codings, ["trace_key", "sentence_id"], [order]).drop(order), ["trace_key", "sentence_id"], "left")


def read_conditions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV files of one schema, the file's stem as column condition."""
    return spark.read.schema(schema).option("header", True).csv(path).withColumn("condition", F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new rows in place of those of the same keys; columns that only one has are null in the other's rows."""
    both = old.withColumn("_load", F.lit(0)).unionByName(new.withColumn("_load", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, keys, ["_load"]).drop("_load")


def write_missing(rows: DataFrame, target: str, keys: list[str], partition: list[str]) -> int:
    """Appends the rows whose keys the target table lacks; the number written. A target that isn't there is made."""
    spark, seen = rows.sparkSession, Observation()
    try:
        new = missing(rows, spark.read.parquet(target).select(*keys), keys)
    except AnalysisException as absent:
        if absent.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        new = rows
    # The rows are counted as they are written; another writer's are none of them.
    new.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy(*partition).parquet(target)
    return seen.get["n"]
