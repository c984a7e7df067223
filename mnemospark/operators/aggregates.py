"""Groupings, distinct lists, tag clouds, paging and set operations over memories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from mnemospark.functions.predicates import live


def projects(memories: DataFrame) -> DataFrame:
    """(project, cnt) of live rows, rows without a project as one group."""
    return memories.where(live()).groupBy("project").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "project")


def distinct_projects(memories: DataFrame) -> DataFrame:
    return memories.select("project").distinct()


def distinct_types(rows: DataFrame) -> DataFrame:
    return rows.where(live()).select("concept_type").distinct().orderBy("concept_type")


def distinct_tags(memories: DataFrame) -> DataFrame:
    return memories.where(live()).select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


def tag_cloud(memories: DataFrame, order: str = "id") -> DataFrame:
    """(tag): one spelling of each tag regardless of case, the first in row order; sorted without case."""
    rows = memories.select(F.col(order).alias("row"), F.posexplode("tags").alias("pos", "tag"))
    first = rows.groupBy(F.lower("tag").alias("low")).agg(F.min_by("tag", F.struct("row", "pos")).alias("tag"))
    return first.orderBy("low").select("tag")


def next_ordinal(sources: DataFrame, memories: DataFrame) -> DataFrame:
    """(memory_id, next_ordinal) for each memory, 0 without sources."""
    top = sources.groupBy("memory_id").agg(F.max("ordinal").alias("m"))
    return memories.select(F.col("id").alias("memory_id")).join(top, "memory_id", "left").select("memory_id", (F.coalesce("m", F.lit(-1)) + 1).alias("next_ordinal"))


def missing_concepts(memories: DataFrame, concepts: DataFrame) -> DataFrame:
    """Memories without a concept row; empty when the invariant holds."""
    return memories.join(concepts, memories["id"] == concepts["memory_id"], "left_anti")


def page(rows: DataFrame, order: list, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page in a total order, the limit between 1 and 200."""
    size = max(1, min(limit, 200))
    return rows.orderBy(*order).offset(offset).limit(size)


def next_cursor(count: int, offset: int, limit: int) -> int | None:
    size = max(1, min(limit, 200))
    return offset + size if offset + size < count else None


def top_per_key(rows: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The first n rows of each key; each task cuts its rows before they move."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= n)


def chunks(rows: DataFrame, partition: str, order: list, size: int) -> DataFrame:
    """Rows with ``chunk``: fixed-size batches within each partition."""
    return rows.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(partition).orderBy(*order)) - 1) / size))


def union_projects(local: DataFrame, queued: DataFrame) -> DataFrame:
    return local.select("project").union(queued.select("project")).where(F.col("project").isNotNull()).distinct().orderBy("project")


def tallies(rows: DataFrame, filled: str = "filled") -> DataFrame:
    """(field, n): how often each field was filled."""
    return rows.select(F.explode(filled).alias("field")).groupBy("field").agg(F.count("*").alias("n")).orderBy("field")
