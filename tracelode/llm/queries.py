"""The operators as queries over the tables documents and embeddings, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm import context_tree, decontamination, importance, langid, media, mixing, pii, sharding, simhash, token_counts, token_files, toxicity, whitening
from tracelode.llm._shared import spread, written

#: Production parameters.
BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
END_ID, TOKEN_LIMIT, SHARDS, SHARD_SEED = 2, 512, 40, 11
TOXIC_FROM = 0.7
BUCKETS, LEAST_WORDS, PERCENT, DRAW_SEED = 10_000, 20, 10, 2024
WHITE_COMPONENTS = 4
#: The session's setting that names the key of pseudonyms; without it the key is the one of the tests.
PII_KEY_CONF, PII_KEY = "spark.tracelode.pseudonym.key", "corpus-pseudonyms-1"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def fold(doc_id: Column, folds: int) -> Column:
    """The fold of a document: crc32 of its id as text (null: empty)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(documents(spark, sf_dir).select("doc_id", "text"), spark.conf.get(PII_KEY_CONF, PII_KEY))


def op2_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    stored = written(media.with_media(docs).drop("text"), "media")
    return media.with_features(stored).select(
        "doc_id",
        "n_bytes",
        F.octet_length("image.payload").cast("bigint").alias("payload_bytes"),
        F.sha2("image.payload", 256).alias("payload_sha256"),
        F.col("image.tail_crc32").alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.col("image.feature").alias("feature"),
    )


def op3_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.stratified_shards(documents(spark, sf_dir), SHARDS, seed=SHARD_SEED)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_token_files(token_files.write_token_files(documents(spark, sf_dir), tokenizer_path(BYTE_BPE), END_ID))


def op5_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 5) == 1
    trained = context_tree.train(docs.where(~held_out))
    return context_tree.score(docs, trained).withColumn("held_out", held_out)


def op7_piece_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = fold(F.col("doc_id"), 3) == 1
    pieces = langid.sentencepieces(tokenizer_path(PIECES))
    langs, prob = langid.fit(docs.where(~held_out), pieces)
    return langid.identify(docs, langs, prob, pieces).withColumn("held_out", held_out)


def op8_rank_synchronous_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(documents(spark, sf_dir), tokenizer_path(BYTE_BPE))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(documents(spark, sf_dir))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = documents(spark, sf_dir).select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).cast("bigint").alias("size"))
    mixed = mixing.mix(sized, size="size")
    return mixed.select("doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("size") * F.col("_copies")).alias("taken"), F.col("_copies").cast("bigint").alias("copies"))


def op11_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 3) == 1
    fitted = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out))
    return toxicity.scored(docs, fitted, threshold=TOXIC_FROM).withColumn("held_out", held_out)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return importance.resampled(documents(spark, sf_dir), benchmark, buckets=BUCKETS, least=LEAST_WORDS, percent=PERCENT, seed=DRAW_SEED)


def op13_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), k=WHITE_COMPONENTS)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = [op1_feistel_pseudonyms, op2_png_media, op3_stratified_shards, op4_token_files, op5_qgram_decontamination, op6_context_tree_scores, op7_piece_language_id, op8_rank_synchronous_counts, op9_simhash_groups, op10_pivotal_mix, op11_kneser_ney_toxicity, op12_importance_resampling, op13_whitened_embeddings]
    return {f.__name__: f for f in listed}


#: CRC-32 of a text's bytes by the table method, as DuckDB lists.
SHARDS_SQL = f"""
WITH crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
raw AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (
  SELECT doc_id, source, length(h) // 2 + 16 AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(h) // 2 + 1), lambda k: ('0x' || substr(h, 2 * k - 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32,
    coalesce('s' || source, 'n') AS s
  FROM raw, crc_table),
numbered AS (SELECT *, row_number() OVER (PARTITION BY s, doc_id, text_crc32, size) - 1 AS copy FROM sized),
hashed AS (
  SELECT *, CAST('0x' || substr(md5('{SHARD_SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text_crc32 || ':' || size || ':' || copy), 1, 15) AS BIGINT) AS hash,
    (CAST('0x' || substr(md5('{SHARD_SEED}:' || s), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496 AS phase FROM numbered),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY s ORDER BY hash, doc_id NULLS FIRST, text_crc32, size, copy) - 1 + phase) / count(*) OVER (PARTITION BY s) AS f FROM hashed),
placed AS (SELECT *, row_number() OVER (ORDER BY f, s) - 1 AS p, count(*) OVER () AS n FROM ranked),
cut AS (
  SELECT *, n // {SHARDS} AS few, n % {SHARDS} AS larger FROM placed),
dealt AS (
  SELECT *, CASE WHEN p < larger * (few + 1) THEN p // (few + 1) ELSE larger + (p - larger * (few + 1)) // greatest(few, 1) END AS shard FROM cut)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(p - (shard * few + CASE WHEN shard < larger THEN shard ELSE larger END) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM dealt
"""


#: Importance resampling: words, buckets by the same CRC-32, gains, and the ranked draw.
RESAMPLING_SQL = f"""
WITH crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
cut AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
wanted AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark),
counts AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(ws) AS w FROM cut) GROUP BY r, w),
words AS (
  SELECT w, sum(s) AS s, sum(t) AS t, hex(encode(w)) AS h
  FROM (SELECT w, sum(n) AS s, 0 AS t FROM counts GROUP BY w UNION ALL SELECT w, 0, count(*) FROM wanted GROUP BY w) GROUP BY w),
placed AS (
  SELECT w, words.s, words.t,
    xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(h) // 2 + 1), lambda k: ('0x' || substr(h, 2 * k - 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, crc_table.t[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM words, crc_table),
sums AS (SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM placed GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + {BUCKETS}) / ((s + 1) * (sum(t) OVER () + {BUCKETS}))))::BIGINT AS gain FROM sums),
weighed AS (SELECT r, sum(n * gain)::BIGINT AS weight FROM counts JOIN placed USING (w) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{DRAW_SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM cut LEFT JOIN weighed USING (r)),
able AS (
  SELECT *, n_features >= {LEAST_WORDS} AS fits, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST) AS place,
    count(*) OVER (PARTITION BY n_features >= {LEAST_WORDS}) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN fits AND place <= {PERCENT} * n // 100 THEN place END::BIGINT AS rank FROM able
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_stratified_shards": SHARDS_SQL, "op12_importance_resampling": RESAMPLING_SQL}
