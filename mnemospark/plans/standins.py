"""The engine's tables built from the driver's tables, in Spark and, word for word, in SQL.

``vec_id = doc_id`` is a convention of these stand-ins; nothing in the data relates the two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as memories: every 17th is superseded by the next id, access counts come from events."""
    d = table(spark, sf_dir, "documents")
    hits = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.count("*").alias("hits"))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    minutes = lambda m: F.timestamp_seconds(F.unix_timestamp(start) + 60 * m)
    return d.join(hits, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("text").alias("content"),
        F.array("lang", "source").alias("tags"),
        F.when(F.col("source") == "src0", "__global__").otherwise(F.col("source")).alias("project"),
        F.lit(None).cast("string").alias("agent"),
        minutes(F.col("doc_id")).alias("created_at"),
        minutes(F.pmod(F.col("doc_id") * 7919, F.lit(100_003))).alias("updated_at"),
        F.coalesce("hits", F.lit(0)).alias("access_count"),
        F.col("lang").alias("memory_type"),
        F.lit(None).cast("string").alias("content_raw"),
        F.when(F.pmod("doc_id", F.lit(17)) == 0, (F.col("doc_id") + 1).cast("string")).alias("superseded_by"),
        F.when(F.pmod("doc_id", F.lit(3)) == 0, "v1").when(F.pmod("doc_id", F.lit(3)) == 1, "v0").alias("condenser_version"),
        F.lit(None).cast("string").alias("embedding_model"),
        "doc_id",
    )


MEMORIES_SQL = """memories AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id, d.text AS content, [d.lang, d.source] AS tags,
    CASE WHEN d.source = 'src0' THEN '__global__' ELSE d.source END AS project,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(d.doc_id) AS created_at,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes((d.doc_id * 7919) % 100003) AS updated_at,
    COALESCE(h.hits, 0) AS access_count, d.lang AS memory_type,
    CASE WHEN d.doc_id % 17 = 0 THEN CAST(d.doc_id + 1 AS VARCHAR) END AS superseded_by,
    CASE d.doc_id % 3 WHEN 0 THEN 'v1' WHEN 1 THEN 'v0' END AS condenser_version, d.doc_id
  FROM documents d LEFT JOIN (SELECT user_id, COUNT(*) AS hits FROM events GROUP BY 1) h ON h.user_id = d.doc_id)"""


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, label = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels")
    return d.join(label, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("memory_id"),
        F.concat(F.lit("Agent Memory/"), "lang").alias("concept_type"),
        F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("string").alias("description"),
        F.when(F.col("toxic") == 1, "deprecated").otherwise("stable").alias("status"),
        F.lit(None).cast("string").alias("stale_after"),
        F.lit(1).cast("bigint").alias("current_revision"),
        F.concat(F.lit("memories/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("virtual_path"),
        F.lit(None).cast("string").alias("extensions"),
    )


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search reads of a memory and its concept: both come from one row of documents, so no text moves to meet the other."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("memory_id"),
        F.col("text").alias("content"),
        F.array("lang", "source").alias("tags"),
        F.concat(F.lit("Agent Memory/"), "lang").alias("concept_type"),
        F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("string").alias("description"),
    )


CONCEPTS_SQL = """concepts AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS memory_id, 'Agent Memory/' || d.lang AS concept_type,
    CASE WHEN l.toxic = 1 THEN 'deprecated' ELSE 'stable' END AS status, 1 AS current_revision
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as an operation log: each user's events numbered in time order."""
    from mnemospark.operators.revisions import revision_rows

    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("memory_id"), F.col("event_type").alias("operation"), F.col("ts").alias("created_at"), "event_id", "props")
    return revision_rows(e, "memory_id", ["created_at", "event_id"])


REVISIONS_SQL = """revisions AS (
  SELECT CAST(user_id AS VARCHAR) AS memory_id, event_type AS operation, ts AS created_at, event_id, props,
    ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS revision FROM events)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed edges from the keys: customer to nation to region, orders to customers; some nations are unresolved."""
    c, n, o = (table(spark, sf_dir, t) for t in ("customer", "nation", "orders"))
    name = lambda p, col: F.concat(F.lit(p), F.col(col).cast("string"))
    parts = [
        c.select(name("c", "c_custkey").alias("src_memory_id"), F.when(F.col("c_nationkey") % 7 != 3, name("n", "c_nationkey")).alias("dst_memory_id"), name("n", "c_nationkey").alias("dst_ref"), F.lit("links_to").alias("relation")),
        n.select(name("n", "n_nationkey").alias("src_memory_id"), name("r", "n_regionkey").alias("dst_memory_id"), name("r", "n_regionkey").alias("dst_ref"), F.lit("derived_from").alias("relation")),
        o.select(name("o", "o_orderkey").alias("src_memory_id"), name("c", "o_custkey").alias("dst_memory_id"), name("c", "o_custkey").alias("dst_ref"), F.lit("cites").alias("relation")),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("*", F.lit("keys").alias("producer"), F.lit(None).cast("bigint").alias("ordinal"), F.concat("src_memory_id", F.lit(">"), "dst_ref").alias("id"), F.lit(1).cast("bigint").alias("source_revision"))


EDGES_SQL = """edges AS (
  SELECT 'c' || c_custkey AS src, CASE WHEN c_nationkey % 7 <> 3 THEN 'n' || c_nationkey END AS dst, 'n' || c_nationkey AS dst_ref, 'links_to' AS relation FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'r' || n_regionkey, 'derived_from' FROM nation
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'c' || o_custkey, 'cites' FROM orders)"""


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item as a query, with the vector of the same number and a current project."""
    b = table(spark, sf_dir, "benchmark")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    first = F.array_join(F.slice(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), 1, 8), " ")
    return b.join(e, "item_id", "left").select(F.col("item_id").alias("query_id"), first.alias("text"), "embedding", F.concat(F.lit("src"), F.pmod("item_id", F.lit(20)).cast("string")).alias("current_project"))


QUERIES_SQL = r"""asked AS (
  SELECT item_id AS query_id, array_to_string(list_slice(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), 1, 8), ' ') AS text,
    'src' || (item_id % 20) AS current_project FROM benchmark)"""
