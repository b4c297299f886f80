"""documents to token files: language ID, near-copies, benchmark passages, mixture, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm import decontamination, langid, mixing, near_copies as copies, token_files
from tracelode.llm._shared import written
from tracelode.llm.queries import BYTE_BPE, END_ID, PIECES, documents, fold, tokenizer_path

#: A document stays if its language is at least so likely among those learned.
LEAST_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letter or no clear language."""
    pieces = langid.sentencepieces(tokenizer_path(PIECES))
    langs, prob = langid.fit(docs.where(fold(F.col("doc_id"), 3) != 1), pieces)
    said = langid.identify(docs, langs, prob, pieces, keep=[F.struct(*docs.columns).alias("_row")])
    return said.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("_row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash tables of five-word shingles, verified at a similarity of 0.8."""
    return copies.one_of_each(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark passage."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    return mixing.repeated(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, and what they hold of each document."""
    return token_files.read_token_files(token_files.write_token_files(docs, tokenizer_path(BYTE_BPE), END_ID))


STAGES = [("language ID", known_language), ("near copies", near_copies), ("benchmark passages", benchmark_free), ("mixture", mixture), ("token ids", token_ids)]

#: Fingerprints, alignment, random rounding and the tokenizer have no SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
