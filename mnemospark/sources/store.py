"""Scans of stored tables: point lookups, vector scans, walks, snapshots by ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.operators.vector import vectors_of
from mnemospark.schemas import open_table


def by_id(memories: DataFrame, id_: str) -> DataFrame:
    """The row of an id, superseded or not; the predicate reaches the scan."""
    return memories.where(F.col("id") == id_)


def curation_walk(memories: DataFrame, limit: int = 0) -> DataFrame:
    """All rows, the longest untouched first; 0 is no limit."""
    rows = memories.orderBy("updated_at", "id")
    return rows.limit(limit) if limit else rows


def snapshot_rows(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, project, updated_at) of the given ids."""
    return memories.join(ids.select("id"), "id", "left_semi").select("id", "project", "updated_at").orderBy("id")


def with_concepts(memories: DataFrame, concepts: DataFrame) -> DataFrame:
    return memories.join(concepts.drop("created_at", "updated_at"), memories["id"] == concepts["memory_id"])


def current_revisions(concepts: DataFrame, revisions: DataFrame) -> DataFrame:
    r = revisions.withColumnRenamed("memory_id", "rid")
    return concepts.join(r, (concepts["memory_id"] == r["rid"]) & (concepts["current_revision"] == r["revision"])).drop("rid")


__all__ = ["by_id", "curation_walk", "current_revisions", "open_table", "snapshot_rows", "vectors_of", "with_concepts"]
