"""Changes that touch several tables at once, each a function from tables and a batch to new tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.operators.revisions import supersede, with_hash

#: The column that names the memory in the tables whose rows go with it.
OWNED = {"concepts": "memory_id", "revisions": "memory_id", "sources": "memory_id", "verifications": "memory_id", "segments": "memory_id", "gateway_sync": "local_memory_id"}
#: A memory's events in a batch are numbered in so many parts, so a memory that most events name is not one task's work.
PARTS = 64


def supersede_logged(memories: DataFrame, concepts: DataFrame, mapping: DataFrame, actor: str, operation: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(memories, concepts, new revisions, new edges) of a batch of supersessions (older, newer).

    The older memory points to the newer and keeps its time; both get a revision, and the newer a ``supersedes`` edge
    of that revision. Pointers that stand already, memories that supersede themselves and unknown ids do nothing. A memory
    named as older several times takes its least newer; repeated rows are one. A memory's revisions in a
    batch: first those in which it is the newer, then the one in which it is the older.
    """
    known = memories.join(concepts.select(F.col("memory_id").alias("id"), "current_revision"), "id").select("id", "superseded_by", "current_revision")
    asked = mapping.where("older <> newer").groupBy("older").agg(F.min("newer").alias("newer"))
    ends = asked.join(known.select(F.col("id").alias("older"), "superseded_by"), "older").where(~F.col("superseded_by").eqNullSafe(F.col("newer")))
    pairs = ends.join(known.select(F.col("id").alias("newer")), "newer").select("older", "newer")
    part = F.pmod(F.xxhash64("other"), F.lit(PARTS))
    events = pairs.select(F.col("newer").alias("memory_id"), F.col("older").alias("other"), F.lit(None).cast("string").alias("pointer")).withColumn("part", part)
    events = events.unionByName(pairs.select(F.col("older").alias("memory_id"), F.col("newer").alias("other"), F.col("newer").alias("pointer"), F.lit(PARTS).cast("bigint").alias("part")))
    before = Window.partitionBy("memory_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = events.groupBy("memory_id", "part").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("memory_id", "part").orderBy("other"))
    numbered = events.withColumn("place", place).join(starts, ["memory_id", "part"])
    rows = numbered.join(known.select(F.col("id").alias("memory_id"), "current_revision"), "memory_id").withColumn("revision", F.col("current_revision") + F.col("start") + F.col("place"))

    described = [c for c in concepts.columns if c not in {*memories.columns, "current_revision"}]
    whole = memories.join(concepts.select(*described), memories["id"] == concepts["memory_id"]).drop("id")
    full = rows.select("memory_id", "revision", "pointer").join(whole, "memory_id").withColumn("superseded_by", F.coalesce("pointer", "superseded_by"))
    logged = with_hash(full).select("memory_id", "revision", (F.col("revision") - 1).alias("parent_revision"), F.lit(operation).alias("operation"), F.lit(actor).alias("actor"), "snapshot_json", "content_hash")
    edges = rows.where("pointer IS NULL").select(F.col("memory_id").alias("src_memory_id"), F.col("other").alias("dst_memory_id"), F.col("other").alias("dst_ref"), F.lit("supersedes").alias("relation"), F.lit(actor).alias("producer"), F.col("revision").alias("source_revision"))
    last = rows.groupBy("memory_id").agg(F.max("revision").alias("last"))
    raised = concepts.join(last, "memory_id", "left").withColumn("current_revision", F.coalesce("last", "current_revision")).select(*concepts.columns)
    return supersede(memories, pairs), raised, logged, edges


def clear_verifications(verifications: DataFrame, logged: DataFrame) -> DataFrame:
    """``verifications`` without those of the memories that a batch's revisions (memory_id) changed: what was attested is another text now.

    Of a supersession both memories' go; marks that leave a memory's meaning alone (a contradiction's edge) are not to be passed.
    """
    return verifications.join(logged.select("memory_id").distinct(), "memory_id", "left_anti").select(*verifications.columns)


def cascade(tables: dict[str, DataFrame], tombstones: DataFrame) -> dict[str, DataFrame]:
    """``tables`` by name without what belonged to forgotten memories; edges that led to one lose their target, not their reference."""
    gone = tombstones.select(F.col("memory_id").alias("gone_id")).distinct()
    out = {}
    for name, df in tables.items():
        if name == "relationships":
            kept = df.join(gone, F.col("src_memory_id") == F.col("gone_id"), "left_anti")
            kept = kept.join(gone, F.col("dst_memory_id") == F.col("gone_id"), "left")
            out[name] = kept.withColumn("dst_memory_id", F.when(F.col("gone_id").isNull(), F.col("dst_memory_id"))).select(*df.columns)
        else:
            out[name] = df.join(gone, F.col(OWNED[name]) == F.col("gone_id"), "left_anti")
    return out


def repair_producers(relationships: DataFrame, revisions: DataFrame, actor: str, wrong: str) -> DataFrame:
    """Edges of producer ``wrong`` that a revision by ``actor`` made are the actor's; those that it has already go."""
    made = revisions.where(F.col("actor") == actor).select(F.col("memory_id").alias("src_memory_id"), F.col("revision").alias("source_revision")).distinct()
    key = ["src_memory_id", "source_revision", "relation", "dst_ref", "_place"]
    rows = relationships.withColumn("_place", F.coalesce("ordinal", F.lit(-1)))
    rows = rows.join(made.withColumn("_made", F.lit(True)), ["src_memory_id", "source_revision"], "left")
    right = rows.where(F.col("producer") == actor).select(*key).distinct().withColumn("_twin", F.lit(True))
    mend = (F.col("producer") == wrong) & F.col("_made").isNotNull()
    left = rows.join(right, key, "left").where(~(F.coalesce(mend, F.lit(False)) & F.col("_twin").isNotNull()))
    return left.withColumn("producer", F.when(mend, F.lit(actor)).otherwise(F.col("producer"))).select(*relationships.columns)


def count_check(memories: DataFrame, concepts: DataFrame, revisions: DataFrame) -> DataFrame:
    """One row (memories, concepts, first_revisions, equal): each memory has a concept and a first revision."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    one = count(memories, "memories").join(count(concepts, "concepts")).join(count(revisions.where("revision = 1"), "first_revisions"))
    return one.withColumn("equal", (F.col("memories") == F.col("concepts")) & (F.col("memories") == F.col("first_revisions")))
