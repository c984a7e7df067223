"""Schemas of the engine's tables, and loading and saving them as Parquet datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

GLOBAL = "__global__"
NO_PROJECT = "__null__"

_DDL = {
    "memories": "id string, content string, tags array<string>, project string, agent string, source_file string, created_at timestamp, "
    "updated_at timestamp, access_count bigint, embedding array<float>, memory_type string, content_raw string, superseded_by string, "
    "condenser_version string, embedding_model string",
    "concepts": "memory_id string, concept_type string, title string, description string, resource string, status string, stale_after string, "
    "generated_by string, generated_at string, extensions string, raw_frontmatter string, current_revision bigint, virtual_path string, "
    "created_at timestamp, updated_at timestamp",
    "revisions": "id string, memory_id string, revision bigint, parent_revision bigint, operation string, actor string, snapshot_json string, "
    "content_hash string, created_at timestamp",
    "relationships": "id string, src_memory_id string, dst_memory_id string, dst_ref string, relation string, confidence string, producer string, "
    "source_revision bigint, ordinal bigint, metadata_json string, created_at timestamp",
    "sources": "memory_id string, source_key string, ordinal bigint, resource string, title string, author string, usage_count bigint, "
    "usage_window_from string, usage_window_to string, last_modified string, metadata_json string",
    "verifications": "id string, memory_id string, actor string, verified_at string, verification_kind string, metadata_json string",
    "tombstones": "id string, memory_id string, virtual_path string, project string, scope string, last_revision bigint, content_hash string, "
    "actor string, reason string, deleted_at timestamp",
    "segments": "memory_id string, segment_no int, heading_path string, searchable string",
    "working_context": "project string, content string, version bigint, updated_at timestamp",
    "gateway_sync": "local_memory_id string, project string, gateway_memory_id string, last_seen_server_revision bigint, "
    "last_pushed_content_hash string, last_pulled_content_hash string, sync_state string, tombstone_deleted boolean, tombstone_at timestamp, "
    "created_at timestamp, updated_at timestamp",
    "delete_queue": "local_memory_id string, project string, gateway_memory_id string, last_seen_server_revision bigint, "
    "last_pushed_content_hash string, last_pulled_content_hash string, tombstone_at timestamp, created_at timestamp, updated_at timestamp",
    "pull_state": "project string, last_pull_server_revision bigint, last_pull_cursor string, updated_at timestamp",
    "project_state": "project string, last_dream_at timestamp",
}
SCHEMAS: dict[str, T.StructType] = {}


def schema(name: str) -> T.StructType:
    """The schema of one of the engine's tables."""
    if name not in SCHEMAS:
        SCHEMAS[name] = T.StructType.fromDDL(_DDL[name])
    return SCHEMAS[name]


def tables() -> list[str]:
    return list(_DDL)


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema(name))


def open_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A stored table, read by its declared schema; predicates and columns reach the scan."""
    return spark.read.schema(schema(name)).parquet(f"{path}/{name}")


def conform(df: DataFrame, name: str) -> DataFrame:
    """``df`` cast to a table's columns, missing ones as nulls."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)))
