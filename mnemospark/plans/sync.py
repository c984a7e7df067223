"""Push and pull planning against a remote store, as joins; no transport."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def push_plan(local: DataFrame, mapping: DataFrame, queue: DataFrame) -> DataFrame:
    """(local_memory_id, action) of local rows (id, content_hash), known mappings and queued deletions.

    A hash that another live mapping holds already is skipped; a hash is looked up once for each row.
    """
    m = mapping.select("local_memory_id", "last_pushed_content_hash", "last_pulled_content_hash", "tombstone_deleted")
    j = local.join(m, local["id"] == m["local_memory_id"], "left")
    held = j.where(F.col("local_memory_id").isNotNull() & ~F.coalesce("tombstone_deleted", F.lit(False))).select(F.coalesce("last_pushed_content_hash", "last_pulled_content_hash").alias("held_hash")).where(F.col("held_hash").isNotNull()).distinct()
    k = j.join(held, j["content_hash"] == held["held_hash"], "left")
    same = lambda c: F.coalesce(F.col(c) == F.col("content_hash"), F.lit(False))
    mapped = F.col("local_memory_id").isNotNull()
    action = (
        F.when(mapped & F.col("tombstone_deleted"), "blocked_tombstone")
        .when(mapped & (same("last_pushed_content_hash") | same("last_pulled_content_hash")), "skipped")
        .when(mapped, "update")
        .when(F.col("held_hash").isNotNull(), "skipped")
        .otherwise("create")
    )
    rows = k.select(F.col("id").alias("local_memory_id"), action.alias("action"))
    return rows.unionByName(queue.select("local_memory_id", F.lit("delete").alias("action")))


def pull_plan(remote: DataFrame, mapping: DataFrame, local: DataFrame) -> DataFrame:
    """(gateway_memory_id, action, local_memory_id) of remote rows.

    remote: gateway_memory_id, server_revision, content_hash, tombstone. mapping: one project's
    mappings. local: id, content_hash of live rows. A link takes the smallest id of that hash.
    """
    m = mapping.select("gateway_memory_id", F.col("local_memory_id").alias("mapped_id"), "last_seen_server_revision", F.coalesce("last_pulled_content_hash", "last_pushed_content_hash").alias("base_hash"), F.coalesce("tombstone_deleted", F.lit(False)).alias("stone"))
    dead = m.where("stone").select(F.col("mapped_id").alias("id"))
    hashes = local.select("id", "content_hash").join(dead, "id", "left_anti")
    j = remote.join(m, "gateway_memory_id", "left")
    j = j.join(hashes.select(F.col("id").alias("mapped_id"), F.col("content_hash").alias("local_hash")), "mapped_id", "left")
    exact = hashes.groupBy("content_hash").agg(F.min("id").alias("link_id"))
    j = j.join(exact, "content_hash", "left")
    known, rev = F.col("mapped_id").isNotNull(), F.col("server_revision")
    action = (
        F.when(F.coalesce("tombstone", F.lit(False)), F.when(known & (rev < F.col("last_seen_server_revision")), "skipped").when(known, "tombstone").otherwise("tombstone_unknown"))
        .when(rev.isNull() | F.col("gateway_memory_id").isNull(), "rejected")
        .when(known & F.col("stone"), "conflict")
        .when(known & (F.col("last_seen_server_revision") >= rev), "skipped")
        .when(known & F.col("local_hash").eqNullSafe(F.col("base_hash")), "update")
        .when(known, "conflict")
        .when(F.col("link_id").isNotNull(), "link")
        .otherwise("import")
    )
    out = j.withColumn("action", action)
    target = F.when(F.col("action") == "rejected", F.lit(None)).otherwise(F.coalesce("mapped_id", F.when(F.col("action") == "link", F.col("link_id"))))
    return out.select("gateway_memory_id", "action", target.alias("local_memory_id"))


def may_advance(plan: DataFrame) -> DataFrame:
    """One row (conflicts, advance): a pull's cursor moves only without conflicts."""
    return plan.agg(F.count_if(F.col("action") == "conflict").alias("conflicts")).withColumn("advance", F.col("conflicts") == 0)


def apply_push_results(mapping: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Mappings after a push: (local_memory_id, project, gateway_memory_id, server_revision, content_hash, outcome).

    A result that names another gateway id than the mapping does is ignored.
    """
    r = results.select("local_memory_id", F.col("project").alias("r_project"), F.col("gateway_memory_id").alias("r_id"), "server_revision", F.col("content_hash").alias("r_hash"), "outcome")
    j = mapping.join(r, "local_memory_id", "full_outer")
    good = F.col("outcome").isin("created", "updated", "deleted") & (F.col("gateway_memory_id").isNull() | (F.col("gateway_memory_id") == F.col("r_id")))
    pick = lambda new, old: F.when(good, new).otherwise(F.col(old))
    new = {
        "project": pick(F.coalesce("r_project", "project"), "project"),
        "gateway_memory_id": pick(F.col("r_id"), "gateway_memory_id"),
        "last_seen_server_revision": pick(F.greatest(F.coalesce("server_revision", F.lit(0)), F.coalesce("last_seen_server_revision", F.lit(0))), "last_seen_server_revision"),
        "last_pushed_content_hash": pick(F.col("r_hash"), "last_pushed_content_hash"),
        "tombstone_deleted": pick(F.col("outcome") == "deleted", "tombstone_deleted"),
        "updated_at": pick(now, "updated_at"),
    }
    return j.where(F.col("gateway_memory_id").isNotNull() | good).select(*((new[c] if c in new else F.col(c)).alias(c) for c in mapping.columns))


def upsert_mappings(mapping: DataFrame, new: DataFrame) -> DataFrame:
    """Latest row wins for each local id."""
    both = mapping.withColumn("turn", F.lit(0)).unionByName(new.withColumn("turn", F.lit(1)))
    w = Window.partitionBy("local_memory_id").orderBy(F.desc("updated_at"), F.desc("turn"))
    return both.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "turn")


def retained_history(remote: DataFrame, revisions: DataFrame) -> DataFrame:
    """Remote rows equal to some kept revision: its body or original, project, type and sorted tags."""
    s = lambda f: F.get_json_object("snapshot_json", f"$.{f}")
    kept = revisions.select(s("project").alias("p"), s("memory_type").alias("t"), s("tags").alias("g"), F.explode(F.array_distinct(F.array(s("content"), s("content_raw")))).alias("body")).where(F.col("body").isNotNull()).distinct()
    cond = (remote["content"] == kept["body"]) & remote["project"].eqNullSafe(kept["p"]) & remote["memory_type"].eqNullSafe(kept["t"]) & F.to_json(F.array_sort(F.array_distinct(remote["tags"]))).eqNullSafe(kept["g"])
    return remote.join(kept, cond, "left_semi")


def reconcile(conflicts: DataFrame, fresh_remote: DataFrame) -> DataFrame:
    """Conflicts that one verified retry may settle: the remote is seen whole and is no tombstone."""
    f = fresh_remote.select("gateway_memory_id", F.col("server_revision").alias("fresh_revision"), F.coalesce("tombstone", F.lit(False)).alias("stone"))
    j = conflicts.join(f, "gateway_memory_id", "left")
    verdict = F.when(F.col("fresh_revision").isNull(), "remote_missing").when(F.col("stone"), "keep_tombstone").when(F.col("fresh_revision") > F.col("server_revision"), "pull_first").otherwise("retry")
    return j.withColumn("verdict", verdict).drop("fresh_revision", "stone")
