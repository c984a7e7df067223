"""Document-bundle views: lists, index, log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions.predicates import in_scope, live, stale_in_index
from mnemospark.functions.text import bounded_preview, scope_label
from mnemospark.operators.aggregates import page


def list_memories(memories: DataFrame, project: str | None) -> DataFrame:
    return memories.where(live() & in_scope(project)).select("id").orderBy("id")


def index_rows(memories: DataFrame, concepts: DataFrame, today: Column, concept_type: str | None = None, tag: str | None = None) -> DataFrame:
    """Index entries by type and title; deprecated rows are listed, superseded ones aren't."""
    rows = memories.where(live()).join(concepts.select("memory_id", "concept_type", "title", "description", "status", "stale_after"), F.col("id") == F.col("memory_id"))
    if concept_type is not None:
        rows = rows.where(F.col("concept_type") == concept_type)
    if tag is not None:
        rows = rows.where(F.array_contains("tags", tag))
    preview = bounded_preview(F.coalesce("description", "content"), 160)
    shown = rows.select("id", "concept_type", F.coalesce("title", "id").alias("title"), preview.alias("preview"), "status", stale_in_index(F.col("stale_after"), today).alias("stale"))
    return shown.orderBy("concept_type", "title", "id")


def index_document(entries: DataFrame) -> DataFrame:
    """(concept_type, body): one Markdown list for each type."""
    line = F.concat(F.lit("- ["), "title", F.lit("](memories/"), "id", F.lit(".md): "), "preview", F.when(F.col("status") != "stable", F.concat(F.lit(" ("), "status", F.lit(")"))).otherwise(""), F.when(F.col("stale"), " (stale)").otherwise(""))
    lines = F.array_sort(F.collect_list(F.struct("title", "id", line.alias("line"))))
    return entries.groupBy("concept_type").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("body")).orderBy("concept_type")


def event_log(revisions: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(at, memory_id, revision, operation) of changes and deletions."""
    a = revisions.select(F.col("created_at").alias("at"), "memory_id", "revision", "operation")
    b = tombstones.select(F.col("deleted_at").alias("at"), "memory_id", F.col("last_revision").alias("revision"), F.lit("forget").alias("operation"))
    return a.unionByName(b)


def log_page(events: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of the log, the latest first, with the day each event belongs to."""
    rows = page(events, [F.desc("at"), F.desc("memory_id"), F.desc("revision")], offset, limit)
    return rows.withColumn("day", F.date_format("at", "yyyy-MM-dd"))


def root_directory(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(e,) for e in ("index.md", "log.md", "memories/", "tags/", "types/")], "entry string")


def read(spark: SparkSession, path: str, memories: DataFrame, concepts: DataFrame, events: DataFrame, today: Column) -> DataFrame:
    """The view that a bundle path names."""
    parts = [p for p in path.strip("/").split("/") if p]
    if not parts:
        return root_directory(spark)
    if parts == ["index.md"]:
        return index_document(index_rows(memories, concepts, today))
    if parts == ["log.md"]:
        return log_page(events)
    if parts[0] == "types" and len(parts) == 2:
        return index_document(index_rows(memories, concepts, today, concept_type=parts[1].removesuffix(".md")))
    if parts[0] == "tags" and len(parts) == 2:
        return index_document(index_rows(memories, concepts, today, tag=parts[1].removesuffix(".md")))
    if parts[0] == "memories" and len(parts) == 2:
        return memories.where(F.col("id") == parts[1].removesuffix(".md"))
    raise ValueError(f"the bundle has no {path}")


__all__ = ["event_log", "index_document", "index_rows", "list_memories", "log_page", "read", "root_directory", "scope_label"]
