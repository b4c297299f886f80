"""Queries by chunks and tiles: the answers of the one-window queries where a trace is cut, and cosines within a trace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.operators import chunks, tiles
from tracelode.operators import sequence as Q
from tracelode.plans.catalog import _SQL, _add, _on, _text
from tracelode.plans.facts import sentences, table

#: Short chunks, so that traces of the driver's tables are cut too. Tiles are not: what is sent grows with their number.
CHUNK = 64
#: Pairs of vectors are similar from this cosine on.
SIMILAR = 0.25


def _chunked(name: str, whole: str, of) -> None:
    """A query by chunks with the SQL of the query over whole traces."""
    _add(name, _SQL[whole], None)(lambda spark, d: of(sentences(spark, d)))


def _latest(s: DataFrame) -> DataFrame:
    return chunks.by_chunks(s, lambda part: part.withColumn("found", Q.latest(("HYPO", "JUDGE"), 20)), back=20, size=CHUNK, dense=True).select("trace", "sid", "found")


_chunked("wn12_runs_in_chunks", "wn12_runs", lambda s: chunks.runs(s, 2, CHUNK))
_chunked("wn15_ngrams_in_chunks", "wn15_ngram_repetition", lambda s: chunks.repetition_ratio(s, 4, CHUNK, dense=True))
_chunked("wn17_latest_in_chunks", "wn17_latest_match", _latest)
_chunked("wn20_dependencies_in_chunks", "wn20_dependencies", lambda s: chunks.dependencies(s, size=CHUNK, dense=True).select("trace", "sid", "label", _text(F.col("depends_on")).alias("depends_on")))
_on(
    "tx18_places_with_gaps",
    "SELECT trace, sid, row_number() OVER (PARTITION BY trace ORDER BY sid) - 1 AS place FROM s WHERE label <> 'TEST'",
    lambda s: chunks.positions(s.where("label <> 'TEST'"), CHUNK).select("trace", "sid", F.col("_pos").alias("place")),
)

_PAIRS = f"""WITH v AS (SELECT label AS trace, vec_id AS sid, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0),
u AS (SELECT trace, sid, e, sqrt(list_sum([x * x FOR x IN e])) AS size FROM v WHERE len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT a.trace, a.sid, b.sid AS early, round(least(greatest(list_dot_product(a.e, b.e) / (a.size * b.size), -1), 1), 9) AS sim FROM u a JOIN u b ON a.trace IS NOT DISTINCT FROM b.trace AND b.sid < a.sid WHERE a.size > 0 AND b.size > 0)
"""
_add("jn13_similar_vectors", _PAIRS + f"SELECT trace::BIGINT AS trace, sid, early, round(sim, 6)::DOUBLE AS sim FROM p WHERE sim >= {SIMILAR}", None)(
    lambda spark, d: tiles.similar_pairs(table(spark, d, "embeddings"), "label", "vec_id", "embedding", SIMILAR)
)
_add("jn14_best_earlier_vector", _PAIRS + "SELECT u.trace::BIGINT AS trace, u.sid, round(max(p.sim), 6)::DOUBLE AS sim, arg_max(p.early, (p.sim, -p.early)) AS early FROM u LEFT JOIN p ON p.trace IS NOT DISTINCT FROM u.trace AND p.sid = u.sid GROUP BY u.trace, u.sid", None)(
    lambda spark, d: tiles.best_earlier(table(spark, d, "embeddings"), "label", "vec_id", "embedding")
)
