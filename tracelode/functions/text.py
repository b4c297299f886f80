"""Column functions over text: segmentation, fragments, repetition, character checks, responses."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tracelode.functions.batches import bound_batches

SPACE = r"[ \t\n\r\f\x0b]"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def sentences(text: Column) -> Column:
    """Non-empty sentences, cut after . ! or ? and white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), rf"(?<=[.!?]){SPACE}+"), lambda s: stripped(s) != "")


def segments(text: Column) -> Column:
    """array<struct<sentence_id, text, start_char, end_char, token_count>>: stripped sentences with the places of the unstripped ones."""
    parts = F.split(text, rf"(?<=[.!?])(?={SPACE})")
    start = F.aggregate(parts, F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("next")), lambda s, p: F.struct(F.array_append(s["at"], s["next"]).alias("at"), (s["next"] + F.length(p)).alias("next")))["at"]
    placed = F.zip_with(parts, start, lambda p, a: F.struct(p.alias("p"), a.alias("a")))
    kept = F.filter(placed, lambda x: stripped(x["p"]) != "")
    return F.transform(kept, lambda x, k: F.struct(k.alias("sentence_id"), stripped(x["p"]).alias("text"), x["a"].alias("start_char"), (x["a"] + F.length(x["p"])).alias("end_char"), word_count(x["p"]).alias("token_count")))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, f"{SPACE}+"), lambda w: w != ""))


def is_fragment(text: Column, tokens: Column) -> Column:
    return (tokens <= 2) & stripped(text).rlike(r"^([A-F0-9]\.?|\.)$")


def fragment_kind(text: Column) -> Column:
    t = stripped(text)
    out = F.when(t.rlike(r"^[0-9]+\.$"), "digit_period").when(t.rlike(r"^[A-F]\.$"), "letter_period")
    return out.when(t.rlike(r"^[0-9]+$"), "digit_alone").when(t.rlike(r"^[A-F]$"), "letter_alone").when(t == ".", "period_alone").otherwise("other")


def ends_whole(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+$", "").rlike(r"[.!?\")]$")


def is_cut_off(text: Column, tokens: Column, longest: int | None = None) -> Column:
    """A final sentence that looks truncated: at most 5 tokens or no closing mark; never over `longest` tokens."""
    found = (tokens <= 5) | ~ends_whole(text)
    return found if longest is None else found & (tokens <= longest)


def cut_off_reason(text: Column, tokens: Column) -> Column:
    return F.concat_ws("+", F.when(tokens <= 5, "le5_tokens"), F.when(~ends_whole(text), "no_terminal_punct"))


def thinking(raw: Column) -> Column:
    """The part before the first </think>, without an opening tag; null if there is none."""
    at = F.instr(raw, "</think>")
    return F.when(at > 0, stripped(F.replace(F.substr(raw, F.lit(1), at - 1), F.lit("<think>"), F.lit(""))))


def without_tags(raw: Column) -> Column:
    """Text without opening and closing tags of thinking, stripped."""
    return stripped(F.regexp_replace(raw, "</?think>", ""))


def answer(raw: Column) -> Column:
    at = F.instr(raw, "</think>")
    return F.when(at > 0, stripped(F.substr(raw, at + 8)))


def preview(text: Column, most: int = 180) -> Column:
    t = stripped(F.replace(text, F.lit("\n"), F.lit(" ")))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.left(t, F.lit(most - 3)), F.lit("...")))


def repeats(text: Column, size: int = 80, times: int = 5, starts: int = 500) -> Column:
    """Whether one of about `starts` evenly spaced pieces of `size` characters occurs `times` times without overlap.

    An Arrow UDF: the same by replace() in SQL walks the UTF-8 of a text anew for every piece, 70 times as long.
    """

    if session := SparkSession.getActiveSession():
        bound_batches(session)

    def found(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> bool:
            if t is None or len(t) < size * times:
                return False
            pieces = dict.fromkeys(t[p : p + size] for p in range(0, len(t) - size, max(len(t) // starts, 1)))
            return any(t.count(p) >= times for p in pieces)

        return texts.map(one, na_action=None).astype(bool)

    return F.pandas_udf(found, BooleanType())(text)


def foreign_share(text: Column) -> Column:
    """Characters outside printable ASCII and white space over all; 0 for empty texts."""
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(text, r"[\x20-\x7e\t\n\r]", "")), F.length(text)), F.lit(0.0))


def to_budget(text: Column, tokens: Column, budget: int = 4096) -> Column:
    return F.when(tokens > budget, F.substr(text, F.lit(1), F.floor(F.length(text) * budget / tokens).cast("int"))).otherwise(text)


def json_array(response: Column, schema: str) -> Column:
    """The array of objects in a model's response: bare, fenced, or between the first [ and the last ]."""
    fenced = F.regexp_extract(response, r"(?s)```(?:json)?\s*(.*?)```", 1)
    between = F.regexp_extract(response, r"(?s)(\[.*\])", 1)
    read = lambda t: F.from_json(F.when(stripped(t).startswith("["), t), schema)
    return F.coalesce(read(response), read(fenced), read(between))


def share(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 for an empty whole."""
    return F.coalesce(F.try_divide(100 * part, whole), F.lit(0.0))


def condition_parts(name: Column) -> Column:
    """struct<category, direction, alpha> of names such as hypo_pos_1.5; null for others, prefix or not."""
    form = r"^(?:[a-z]+_)??([a-z]+)_(pos|neg)_([0-9]+(?:\.[0-9]+)?)$"
    found = F.struct(F.upper(F.regexp_extract(name, form, 1)).alias("category"), F.when(F.regexp_extract(name, form, 2) == "pos", 1).otherwise(-1).alias("direction"), F.try_to_number(F.regexp_extract(name, form, 3), F.lit("999.99")).cast("double").alias("alpha"))
    return F.when(name.rlike(form), found)


def token_places(text: Column, token: str = "[A-Za-z0-9]+") -> Column:
    """array<struct<k, first, last>>: number, first and last place (from 0) of each token of a text; a token is a match of a pattern of single characters repeated."""
    words = F.regexp_extract_all(text, F.lit(token), F.lit(0))
    gaps = F.split(text, token, -1)
    both = F.zip_with(words, F.slice(gaps, F.lit(1), F.size(words)), lambda w, g: F.struct(F.length(g).alias("g"), F.length(w).alias("w")))
    none = F.struct(F.array().cast("array<struct<k:bigint,first:bigint,last:bigint>>").alias("l"), F.lit(0).cast("bigint").alias("at"))

    def step(s: Column, x: Column) -> Column:
        first = s["at"] + x["g"]
        place = F.struct(F.size(s["l"]).cast("bigint").alias("k"), first.alias("first"), (first + x["w"] - 1).alias("last"))
        return F.struct(F.array_append(s["l"], place).alias("l"), (first + x["w"]).alias("at"))

    return F.aggregate(both, none, step, lambda s: s["l"])


def token_span(tokens: Column, first: Column, last: Column, reach: int = 30) -> Column:
    """struct<span_start, span_end> of a stretch of characters, by its first and last place, on the tokens of token_places().

    Where no token lies at a place, the nearest within `reach` characters counts: after it for the start, before it for
    the end; null without one.
    """
    after = F.filter(tokens, lambda t: (t["last"] >= first) & (t["first"] - first < reach))
    before = F.filter(tokens, lambda t: (t["first"] <= last) & (last - t["last"] < reach))
    number = lambda found: F.transform(found, lambda t: t["k"])
    return F.struct(F.array_min(number(after)).alias("span_start"), F.array_max(number(before)).alias("span_end"))


def token_spans(spans: DataFrame, tokens: DataFrame, reach: int = 30) -> DataFrame:
    """spans (trace, sid, start_char, end_char) with span_start and span_end of token_span().

    tokens: (trace, tokens) of token_places(). One join by trace, the search in its row. It is a merge join: tokens are far
    larger than the files that their size is estimated from, and don't fit a broadcast.
    """
    found = token_span(F.col("tokens"), F.col("start_char"), F.col("end_char") - 1, reach)
    return spans.join(tokens.hint("merge"), "trace").select(*spans.columns, found.alias("_span")).select(*spans.columns, "_span.*")
