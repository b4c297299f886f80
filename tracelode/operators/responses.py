"""Responses of a coding model: parsed, validated, merged into sentences, logged and costed.

results: (custom_id, type, text, error, input_tokens, output_tokens), a row a request; type is succeeded, errored, or what
else the service reports. Everything is a projection but the merge, which is one join by (trace_key, sentence_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.functions import text as T
from tracelode.operators.aggregates import keep_last
from tracelode.plans.facts import CONFIDENCE, JUDGEMENT, LABELS, MACRO, SPECIFICITY, TEST_CONTEXT

CODING = "struct<sentence_id:bigint,micro_label:string,confidence:string,test_context:string,specificity:string,judgement:string>"
#: Dollars a million words in and out, in a batch.
PRICE = (1.5, 7.5)


def macro(label: Column) -> Column:
    """The broader category of a label, UNKNOWN for others."""
    known = F.create_map(*[F.lit(x) for pair in MACRO.items() for x in pair])
    return F.coalesce(F.try_element_at(known, label), F.lit("UNKNOWN"))


def elements(text: Column) -> Column:
    """array<string>: the elements of the JSON array in a response; null if there is none.

    The content of a code fence if there is one; that as a whole; if it is no JSON at all, what lies between its first [
    and its last ]. JSON that is no array counts as none.
    """
    fence = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = T.stripped(F.when(text.rlike(r"(?s)```(?:json)?\s*.*?```"), fence).otherwise(text))
    read = lambda t: F.from_json(F.when(t.startswith("["), t), "array<string>")
    other = ~body.startswith("[") & F.get_json_object(body, "$").isNotNull()
    return F.when(~other, F.coalesce(read(body), read(F.regexp_extract(body, r"(?s)(\[.*\])", 1))))


def parsed(results: DataFrame) -> DataFrame:
    """results with trace_key, status (success, parse_error, batch_error or the type reported) and items (array<string>)."""
    found = results.withColumn("trace_key", F.replace("custom_id", F.lit("__"), F.lit("/"))).withColumn("items", F.when(F.col("type") == "succeeded", elements(F.col("text"))))
    status = F.when(F.col("type") == "errored", "batch_error").when(F.col("type") != "succeeded", F.col("type")).when(F.col("items").isNull(), "parse_error").otherwise("success")
    return found.withColumn("status", status)


def validated(responses: DataFrame) -> DataFrame:
    """(trace_key, place, sentence_id, micro_label, macro_label, confidence, test_context, specificity, judgement, invalid, missing) of parsed() rows: one row a coding.

    Elements that are no objects go. invalid: the label is none of the nine; the coding stays. missing: required flags
    that are absent or outside of their domain. Confidence is medium where absent or unknown. place: among all elements.
    """
    rows = responses.select("trace_key", F.posexplode("items").alias("place", "item")).where(F.col("item").startswith("{"))
    rows = rows.select("trace_key", "place", F.from_json("item", CODING).alias("c")).select("trace_key", "place", "c.*")
    label = F.coalesce("micro_label", F.lit(""))
    lacks = lambda value, domain: (~F.coalesce(F.col(value), F.lit("")).isin(domain)).cast("int")
    missing = F.when(label == "TEST", lacks("test_context", TEST_CONTEXT) + lacks("specificity", SPECIFICITY)).when(label == "JUDGE", lacks("judgement", JUDGEMENT)).otherwise(0)
    sure = F.when(F.col("confidence").isin(CONFIDENCE), F.col("confidence")).otherwise("medium")
    return rows.withColumn("confidence", sure).withColumn("macro_label", macro(label)).withColumn("invalid", ~label.isin(LABELS)).withColumn("missing", missing)


def merged(sentences: DataFrame, codings: DataFrame) -> DataFrame:
    """sentences (trace_key, sentence_id, ...) with their coding: the last of several; flags only where their label has them; codings of no sentence go."""
    last = keep_last(codings.where(F.col("sentence_id").isNotNull()), ["trace_key", "sentence_id"], ["place"])
    only = lambda label, flag: F.when(F.col("micro_label") == label, F.col(flag)).alias(flag)
    kept = last.select("trace_key", "sentence_id", "macro_label", "micro_label", "confidence", only("TEST", "test_context"), only("TEST", "specificity"), only("JUDGE", "judgement"))
    return sentences.join(kept, ["trace_key", "sentence_id"], "left")


def log(responses: DataFrame, codings: DataFrame, sentences: DataFrame) -> DataFrame:
    """(trace_key, status, n_sentences, n_coded, n_invalid, n_missing, input_tokens, output_tokens, cost): a row a request; counts and cost of successes alone."""
    n = sentences.groupBy("trace_key").agg(F.count("*").alias("n_sentences"))
    counts = codings.groupBy("trace_key").agg(F.count("*").alias("n_coded"), F.count_if("invalid").alias("n_invalid"), F.sum("missing").cast("bigint").alias("n_missing"))
    rows = responses.select("trace_key", "status", "input_tokens", "output_tokens").join(n, "trace_key", "left").join(counts, "trace_key", "left")
    ok = F.col("status") == "success"
    number = lambda c: F.when(ok, F.coalesce(c, F.lit(0).cast("bigint"))).alias(c)
    cost = F.when(ok, (F.col("input_tokens") * PRICE[0] + F.col("output_tokens") * PRICE[1]) / 1e6)
    return rows.select("trace_key", "status", *map(number, ("n_sentences", "n_coded", "n_invalid", "n_missing")), "input_tokens", "output_tokens", cost.alias("cost"))


def summary(logged: DataFrame) -> DataFrame:
    """(status, n, n_mismatched, input_tokens, output_tokens, cost): what a download comes to, by status; mismatched: another number of codings than of sentences."""
    return logged.groupBy("status").agg(
        F.count("*").alias("n"), F.count_if(F.col("n_coded") != F.col("n_sentences")).alias("n_mismatched"),
        F.sum("input_tokens").cast("bigint").alias("input_tokens"), F.sum("output_tokens").cast("bigint").alias("output_tokens"), F.sum("cost").alias("cost"),
    )


def prompt(task_json: Column, sentences: Column, template: str) -> Column:
    """A user message: the template's {task_json} and {numbered_sentences}. sentences: array<struct<sentence_id, text>>."""
    listed = F.array_join(F.transform(sentences, lambda s: F.concat(s["sentence_id"].cast("string"), F.lit(". "), s["text"])), "\n")
    return F.replace(F.replace(F.lit(template), F.lit("{task_json}"), task_json), F.lit("{numbered_sentences}"), listed)


def system_prompt(rules: Column, examples: Column) -> Column:
    """Rules and examples, stripped, with a line of three hyphens between them."""
    return F.concat(T.stripped(rules), F.lit("\n\n---\n\n"), T.stripped(examples))


def panel_prompt(task_json: Column, set_: Column, cue: str) -> Column:
    """The user turn of a generated trace: the panels, and for the second set the cue to come to an end."""
    base = F.concat(F.lit("Here are the panel descriptions:\n\n"), task_json)
    return F.when(F.upper(set_) == "B", F.concat(base, F.lit(cue))).otherwise(base)
