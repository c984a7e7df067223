"""The append-only revision log: snapshots, compare-and-swap, tombstones, supersession, diffs.

State is a set of DataFrames; every change is a function from state and a batch to new state.
Nothing is updated in place. Writers publish a new version of a table with ``publish``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from mnemospark.functions.text import canonical_uri, next_amendment, normal_tags, scope_label

SNAPSHOT_FIELDS = ["content", "content_raw", "tags", "project", "agent", "source_file", "memory_type", "superseded_by", "condenser_version"]
CONCEPT_FIELDS = ["concept_type", "title", "description", "resource", "status", "stale_after", "extensions", "raw_frontmatter"]
CONTEXT_LIMIT = 65_536


def snapshot(columns: list[str]) -> Column:
    """The semantic snapshot as JSON: nulls kept, tags sorted and distinct; no vector, counter or time."""
    parts = [(normal_tags(F.col(c)) if c == "tags" else F.col(c)).alias(c) for c in [*SNAPSHOT_FIELDS, *CONCEPT_FIELDS] if c in columns]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def with_hash(rows: DataFrame) -> DataFrame:
    return rows.withColumn("snapshot_json", snapshot(rows.columns)).withColumn("content_hash", F.sha2("snapshot_json", 256))


def cas_apply(current: DataFrame, proposals: DataFrame) -> DataFrame:
    """(memory_id, outcome, revision, content_hash) of a batch of proposed changes.

    current: memory_id, revision, content_hash. proposals: memory_id, expected (null: any),
    new_hash. Outcomes: missing, conflict, unchanged, changed; only changed gets a new number.
    """
    joined = proposals.join(current, "memory_id", "left")
    outcome = (
        F.when(F.col("revision").isNull(), "missing")
        .when(F.col("expected").isNotNull() & (F.col("expected") != F.col("revision")), "conflict")
        .when(F.col("new_hash") == F.col("content_hash"), "unchanged")
        .otherwise("changed")
    )
    out = joined.withColumn("outcome", outcome)
    changed = F.col("outcome") == "changed"
    return out.select("memory_id", "outcome", F.when(changed, F.col("revision") + 1).otherwise(F.col("revision")).alias("revision"), F.when(changed, F.col("new_hash")).otherwise(F.col("content_hash")).alias("content_hash"))


def revision_rows(events: DataFrame, key: str, order: list) -> DataFrame:
    """Events numbered densely from 1 for each key, each with its parent."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("bigint")
    return events.withColumn("revision", n).withColumn("parent_revision", F.when(F.col("revision") > 1, F.col("revision") - 1))


def history(revisions: DataFrame, memory_id: Column | str, limit: int = 20) -> DataFrame:
    return revisions.where(F.col("memory_id") == memory_id).orderBy(F.desc("revision")).limit(limit)


def diff(old: Column, new: Column, limit: int = 240) -> Column:
    """array<struct<field, before, after>> of top-level JSON fields that differ, values cut."""
    a, b = F.from_json(old, "map<string,string>"), F.from_json(new, "map<string,string>")
    cut = lambda x: F.when(F.length(x) > limit, F.concat(F.left(x, F.lit(limit)), F.lit("…"))).otherwise(x)
    keys = F.array_sort(F.array_union(F.coalesce(F.map_keys(a), F.array().cast("array<string>")), F.coalesce(F.map_keys(b), F.array().cast("array<string>"))))
    rows = F.transform(keys, lambda k: F.struct(k.alias("field"), F.element_at(a, k).alias("before"), F.element_at(b, k).alias("after")))
    return F.transform(F.filter(rows, lambda r: ~r["before"].eqNullSafe(r["after"])), lambda r: F.struct(r["field"].alias("field"), cut(r["before"]).alias("before"), cut(r["after"]).alias("after")))


def forget(memories: DataFrame, concepts: DataFrame, revisions: DataFrame, ids: DataFrame, now: Column, actor: str | None = None, reason: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(memories left, tombstones) after forgetting ``ids`` (id); tombstones outlive the rows.

    A tombstone holds the hash of the current revision's snapshot. A memory without a concept or without that
    revision isn't forgotten. ``writes.cascade`` takes what belongs to the forgotten from the other tables.
    """
    state = concepts.select(F.col("memory_id").alias("id"), "virtual_path", F.col("current_revision").alias("revision"))
    hashes = revisions.select(F.col("memory_id").alias("id"), "revision", "content_hash")
    gone = memories.join(ids.select("id").distinct(), "id", "left_semi").join(state, "id").join(hashes, ["id", "revision"])
    stones = gone.select(
        F.sha2(F.concat(F.lit("tombstone:"), F.col("id")), 256).alias("id"), F.col("id").alias("memory_id"), "virtual_path", "project", scope_label(F.col("project")).alias("scope"),
        F.col("revision").cast("bigint").alias("last_revision"), "content_hash", F.lit(actor).cast("string").alias("actor"), F.lit(reason).cast("string").alias("reason"), now.alias("deleted_at"),
    )
    return memories.join(stones.select(F.col("memory_id").alias("id")), "id", "left_anti"), stones


def pending_deletes(queue: DataFrame, memories: DataFrame) -> DataFrame:
    """Queue rows whose memory is gone or superseded."""
    m = memories.select(F.col("id").alias("mid"), F.col("superseded_by").alias("newer"))
    return queue.join(m, queue["local_memory_id"] == m["mid"], "left").where(F.col("mid").isNull() | F.col("newer").isNotNull()).drop("mid", "newer")


def supersede(memories: DataFrame, mapping: DataFrame) -> DataFrame:
    """``memories`` with ``superseded_by`` from mapping (older, newer); other columns stay."""
    m = mapping.select(F.col("older").alias("id"), "newer")
    return memories.join(m, "id", "left").withColumn("superseded_by", F.coalesce("newer", "superseded_by")).drop("newer").select(*memories.columns)


def update_content(memories: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """New content for (id, new_content, new_tags?, new_type?): the first original is kept, supersession ends."""
    u = updates.select("id", "new_content", *(F.col(c) if c in updates.columns else F.lit(None).cast(t).alias(c) for c, t in (("new_tags", "array<string>"), ("new_type", "string"))))
    j, hit = memories.join(u, "id", "left"), F.col("new_content").isNotNull()
    changed = hit & (F.col("new_content") != F.col("content"))
    out = {
        "content_raw": F.when(changed, F.coalesce("content_raw", "content")).otherwise(F.col("content_raw")),
        "superseded_by": F.when(hit, F.lit(None).cast("string")).otherwise(F.col("superseded_by")),
        "tags": F.when(hit, F.coalesce(F.filter("new_tags", lambda t: t != ""), "tags")).otherwise(F.col("tags")),
        "memory_type": F.when(hit, F.coalesce("new_type", "memory_type")).otherwise(F.col("memory_type")),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
        "content": F.when(hit, F.col("new_content")).otherwise(F.col("content")),
    }
    return j.select(*((out[c] if c in out else F.col(c)).alias(c) for c in memories.columns))


def move(memories: DataFrame, source: str | None, target: str) -> tuple[DataFrame, DataFrame]:
    """(memories, alias edges): live rows of one project put into another; the old address stays as an alias."""
    if target == "__global__":
        raise ValueError("moving to the global scope is refused")
    hit = F.col("project").eqNullSafe(F.lit(source)) & F.col("superseded_by").isNull()
    edges = memories.where(hit).select(F.col("id").alias("src_memory_id"), canonical_uri(F.col("id"), F.col("project")).alias("dst_ref"), F.lit("aliases").alias("relation"))
    return memories.withColumn("project", F.when(hit, F.lit(target)).otherwise(F.col("project"))), edges


def copy(memories: DataFrame, source: str | None, target: str | None, now: Column) -> tuple[DataFrame, DataFrame]:
    """(new rows, derived_from edges): live rows of one project copied to another under derived ids."""
    rows = memories.where(F.col("project").eqNullSafe(F.lit(source)) & F.col("superseded_by").isNull())
    fresh = F.left(F.sha2(F.concat_ws("|", "id", F.lit(target or "__null__")), 256), F.lit(36))
    new = {"id": fresh, "project": F.lit(target).cast("string"), "access_count": F.lit(0).cast("bigint"), "created_at": now, "updated_at": now}
    edges = rows.select(fresh.alias("src_memory_id"), F.col("id").alias("dst_memory_id"), canonical_uri(F.col("id"), F.col("project")).alias("dst_ref"), F.lit("derived_from").alias("relation"))
    return rows.select(*((new[c] if c in new else F.col(c)).alias(c) for c in memories.columns)), edges


def record_verification(verifications: DataFrame, new: DataFrame) -> DataFrame:
    """``verifications`` and the new ones; each actor verifies a memory once."""
    fresh = new.dropDuplicates(["memory_id", "actor"]).join(verifications.select("memory_id", "actor"), ["memory_id", "actor"], "left_anti")
    return verifications.unionByName(fresh.select(*verifications.columns))


def enrich(concepts: DataFrame, memories: DataFrame) -> DataFrame:
    """Concepts with title and description where they had none, and ``filled`` naming what was filled."""
    from mnemospark.functions.text import title_description

    derived = memories.select(F.col("id").alias("memory_id"), title_description(F.col("content")).alias("d"))
    j = concepts.join(derived, "memory_id", "left")
    names = F.array(*(F.when(F.col(c).isNull() & F.col(f"d.{c}").isNotNull(), c) for c in ("title", "description")))
    j = j.withColumn("filled", F.array_compact(names)).withColumn("title", F.coalesce("title", "d.title")).withColumn("description", F.coalesce("description", "d.description"))
    return j.withColumn("current_revision", F.col("current_revision") + (F.size("filled") > 0).cast("bigint")).drop("d")


def append_context(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, content, version): each key's texts folded in order, each under a numbered heading.

    A context is one bounded text (``CONTEXT_LIMIT`` characters), so its appends fit one task;
    ``too_long`` tells of a fold beyond the limit, which a writer refuses.
    """
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))

    def add(acc: Column, x: Column) -> Column:
        gap = F.when(acc == "", "").when(acc.endswith("\n\n"), "").when(acc.endswith("\n"), "\n").otherwise("\n\n")
        return F.concat(acc, gap, F.lit("## Ammendment "), next_amendment(acc).cast("string"), F.lit("\n"), x["t"])

    grouped = rows.groupBy(key).agg(parts.alias("parts"))
    out = grouped.select(key, F.aggregate("parts", F.lit(""), add).alias("content"), F.size("parts").cast("bigint").alias("version"))
    return out.withColumn("too_long", F.length("content") > CONTEXT_LIMIT)


def move_context(contexts: DataFrame, source: str, target: str | None, now: Column) -> DataFrame:
    """A context under another project; refused if that has one; without a target it goes."""
    if target is None:
        return contexts.where(F.col("project") != source)
    taken = contexts.where(F.col("project") == target).limit(1).count()
    if taken:
        raise ValueError("the target project has a working context already")
    hit = F.col("project") == source
    return contexts.withColumn("version", F.col("version") + hit.cast("bigint")).withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at"))).withColumn("project", F.when(hit, F.lit(target)).otherwise(F.col("project")))


def publish(spark: SparkSession, df: DataFrame, root: str, name: str) -> str:
    """Writes a new version of a table beside the old ones, then points to it; one writer only.

    A pointer is a folder of its own name, made last through Spark's file system, so readers see
    the old version or the new one, whole.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    fs = base.getFileSystem(conf)
    done = [int(s.getPath().getName()[5:]) for s in fs.listStatus(base) if s.getPath().getName().startswith("done_")] if fs.exists(base) else []
    version = max(done, default=0) + 1
    df.write.mode("overwrite").parquet(f"{root}/{name}/data_{version}")
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/done_{version}"))
    return f"{root}/{name}/data_{version}"


def latest(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The last published version of a table."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    done = [int(s.getPath().getName()[5:]) for s in base.getFileSystem(conf).listStatus(base) if s.getPath().getName().startswith("done_")]
    return spark.read.parquet(f"{root}/{name}/data_{max(done)}")


def carry_concepts(concepts: DataFrame, mapping: DataFrame) -> DataFrame:
    """``concepts`` and, for each (id, new_id), the old one's description under the new id.

    Type, title, description, resource, status, staleness and extensions carry over; the revision starts anew.
    """
    j = concepts.join(mapping, concepts["memory_id"] == mapping["id"])
    new = {"memory_id": F.col("new_id"), "current_revision": F.lit(1).cast("bigint"), "virtual_path": F.concat(F.lit("memories/"), "new_id", F.lit(".md")), "generated_by": F.lit(None).cast("string"), "generated_at": F.lit(None).cast("string")}
    return concepts.unionByName(j.select(*((new[c] if c in new else F.col(c)).alias(c) for c in concepts.columns)))


def enrichable(memories: DataFrame, project: str | None = None) -> DataFrame:
    """Ids of live rows, of one project if given, the earliest first."""
    rows = memories.where(F.col("superseded_by").isNull())
    return (rows if project is None else rows.where(F.col("project") == project)).orderBy("created_at", "id").select("id")


def resolve_references(links: DataFrame, memories: DataFrame) -> DataFrame:
    """Links (src, target) with ``dst``: the memory that a local reference names, if it exists.

    A canonical address must name the memory's own scope exactly.
    """
    from mnemospark.functions.text import canonical_uri, reference_id

    known = memories.select(F.col("id").alias("known_id"), canonical_uri(F.col("id"), F.col("project")).alias("uri"))
    j = links.withColumn("candidate", reference_id(F.col("target"))).join(known, F.col("candidate") == F.col("known_id"), "left")
    bare = F.regexp_extract("target", r"^([^#?]*)", 1)
    ok = F.col("known_id").isNotNull() & (~F.col("target").startswith("memory://") | (bare == F.col("uri")))
    return j.withColumn("dst", F.when(ok, F.col("known_id"))).drop("candidate", "known_id", "uri")
