"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm import bpe, decontaminate, htmltext, langid, lblm, mpegts, phrases, quality, shard, simhash, tokencount, toxicity, whitening
from mnemospark.llm.common import held_out, read_table


def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    sharded = shard.shuffle_shards(docs, 16, "doc_id", shard.text_size())
    return sharded.select(
        "doc_id",
        shard.text_size().alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return bpe.token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id"])


def op5_mpegts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegts.media_columns(read_table(spark, sf_dir, "documents"), ["doc_id"])


def op6_lblm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lblm.score_documents(read_table(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(read_table(spark, sf_dir, "pages"), ["page_id", "url"])


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model, ["doc_id"])
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), 5, 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model, ["doc_id"])
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), 5, 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.train(langid.training_texts(docs))
    return langid.identify(docs, model, ["doc_id"]).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(read_table(spark, sf_dir, "embeddings"), "embedding", ["vec_id"])
    # null only if the exact value is none of a long
    return found.withColumn("deviation", F.expr("try_cast(deviation as long)"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_shard": op1_shard,
    "op2_decontaminate": op2_decontaminate,
    "op3_simhash": op3_simhash,
    "op4_bpe": op4_bpe,
    "op5_mpegts": op5_mpegts,
    "op6_lblm": op6_lblm,
    "op7_html": op7_html,
    "op8_toxicity": op8_toxicity,
    "op9_quality": op9_quality,
    "op10_langid": op10_langid,
    "op11_phrases": op11_phrases,
    "op12_token_counts": op12_token_counts,
    "op13_whitening": op13_whitening,
}

#: SQL for op11 only. The others can't be written in SQL that runs over whole tables in reasonable
#: time (checksums, hashes, tokenisers, learned models, eigenvectors); tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op11_phrases": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
phrases AS (
  SELECT lang, 1 AS depth, w[i] AS phrase FROM places
  UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM places WHERE i + 1 <= len(w)
  UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM places WHERE i + 2 <= len(w)),
f AS (SELECT lang, depth, phrase, count(*) AS f FROM phrases GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE depth = 1 GROUP BY lang),
candidates AS (SELECT lang, depth, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE depth > 1 AND f >= 10),
longer AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM candidates WHERE depth = 3
    UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM candidates WHERE depth = 3) GROUP BY ALL),
kept AS (SELECT c.* FROM candidates c LEFT JOIN longer g ON g.lang = c.lang AND g.phrase = c.phrase WHERE g.longer IS NULL OR 100 * g.longer < 50 * c.a),
cuts AS (SELECT *, unnest(range(1, depth)) AS k FROM kept),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, h.f AS l, t.f AS r, ((1000000::HUGEINT * c.a * c.a) // (h.f::HUGEINT * t.f))::BIGINT AS score
  FROM cuts c
  JOIN f h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[1:c.k], ' ') AND h.depth = c.k
  JOIN f t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[c.k + 1:], ' ') AND t.depth = c.depth - c.k),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) AS rank, w.phrase, a, l, r, n, score
FROM worst w JOIN totals USING (lang) QUALIFY rank <= 2000
""",
}
