"""Documents put into the store in a batch, each checked against the revision that the one before left.

A batch is a table of parsed documents; its proposals for one memory are folded in their order. The fold needs only a
proposal's hash, its expected revision and what is known of the memory, so just these narrow rows are brought together,
sorted by memory and place, and read as a stream: a task holds one memory's state, never its proposals. (A memory's own
proposals are one after the other by their nature: whether one conflicts depends on all before.) Everything wide stays
where it is and is joined by (memory, place) afterwards.

``put`` returns new tables; nothing is changed in place. Of what a batch does to a memory, every step is a revision, and the last
step is its state.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.links import links as links_of
from mnemospark.functions.semantic import semantic_diff, semantic_hash, semantic_json, semantic_parts
from mnemospark.operators.graph import project_edges
from mnemospark.operators.revisions import resolve_references
from mnemospark.plans import lineage

SOURCES = "array<struct<source_key:string,resource:string,title:string,author:string,usage_count:bigint,usage_window_from:string,usage_window_to:string,last_modified:string,metadata_json:string>>"
VERIFIED = "array<struct<actor:string,verified_at:string,metadata_json:string>>"
EDGES = "array<struct<target:string,relation:string,confidence:string>>"
#: A document's columns beside its place, target, id and conditions.
DOCUMENT = {
    **{c: "string" for c in ("concept_type", "title", "description", "resource", "status", "stale_after", "content", "memory_type", "generated_by", "generated_at")},
    **{c: "string" for c in ("usage_window", "runtime", "parameters", "computation", "executor", "attester", "extensions")},
    "tags": "array<string>",
    "sources": SOURCES,
    "verified": VERIFIED,
    "edges": EDGES,
}
#: Fields that a stored concept keeps together as one JSON object.
EXTRAS = ["usage_window", "runtime", "parameters", "computation", "executor", "attester", "extensions"]
READ_ONLY = ("index.md", "log.md")
DEFAULT_TYPE, DEFAULT_STATUS = "user", "stable"


class Put(NamedTuple):
    """``results`` (seq, memory_id, outcome, revision, created, changed, diff), the new tables, the batch's revisions, and the ids whose segments change."""

    results: DataFrame
    memories: DataFrame
    concepts: DataFrame
    sources: DataFrame
    verifications: DataFrame
    relationships: DataFrame
    revisions: DataFrame
    touched: DataFrame


def conformed(documents: DataFrame) -> DataFrame:
    """``documents`` with every column of ``DOCUMENT`` and of a proposal, absent ones null."""
    have = set(documents.columns)
    wanted = {"seq": "bigint", "target": "string", "id": "string", "scope": "string", "project": "string", "expected": "bigint", "dry_run": "boolean"} | DOCUMENT
    return documents.select(*((F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()))


def normal(documents: DataFrame, project: str | None) -> DataFrame:
    """Documents with their defaults, and the memory's own fields (``agent_memory``) and ``generated`` as they are compared."""
    scope = {None: "unscoped", "__global__": "global"}.get(project, "project")
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    keyed = F.transform("sources", lambda s, k: s.withField("source_key", F.coalesce(s["source_key"], F.concat(F.lit("source-"), k.cast("string")))))
    edges = F.transform("edges", lambda e: e.withField("confidence", F.coalesce(e["confidence"], F.lit("asserted"))))
    df = documents.withColumns({"memory_type": F.coalesce(text("memory_type"), F.lit(DEFAULT_TYPE)), "status": F.coalesce(text("status"), F.lit(DEFAULT_STATUS)), "sources": F.coalesce(keyed, F.array().cast(SOURCES)), "edges": F.coalesce(edges, F.array().cast(EDGES)), "verified": F.coalesce("verified", F.array().cast(VERIFIED)), "tags": F.coalesce("tags", F.array().cast("array<string>"))})
    agent = F.struct(F.col("memory_id").alias("id"), F.lit(project).cast("string").alias("project"), F.lit(scope).alias("scope"), "memory_type", "edges")
    return df.withColumn("agent_memory", F.to_json(agent)).withColumn("generated", F.when(F.col("generated_by").isNotNull(), F.to_json(F.struct(F.col("generated_by").alias("by"), F.col("generated_at").alias("at")))))


def stored_documents(memories: DataFrame, concepts: DataFrame, sources: DataFrame, verifications: DataFrame, relationships: DataFrame) -> DataFrame:
    """The stored memories as documents: memory_id and the columns of ``DOCUMENT``.

    A memory's sources, verifications and declared edges come from its own document, so they are gathered to it.
    """
    def gathered(df: DataFrame, key: str, name: str, order: list[Column], value: Column) -> DataFrame:
        rows = df.groupBy(F.col(key).alias("owner")).agg(F.sort_array(F.collect_list(F.struct(*order, value.alias("v")))).alias("rows"))
        return rows.select("owner", F.transform("rows", lambda r: r["v"]).alias(name))

    field = lambda kind: [f.split(":")[0] for f in kind[len("array<struct<") : -2].split(",")]
    own = [
        gathered(sources, "memory_id", "sources", [F.col("ordinal"), F.col("source_key")], F.struct(*field(SOURCES))),
        gathered(verifications, "memory_id", "verified", [F.col("verified_at"), F.col("id")], F.struct(*field(VERIFIED))),
        gathered(relationships.where("producer = 'document'"), "src_memory_id", "edges", [F.col("ordinal"), F.col("id")], F.struct(F.col("dst_ref").alias("target"), "relation", "confidence")),
    ]
    extras = F.from_json("extensions", "map<string,string>")
    c = concepts.select("memory_id", "concept_type", "title", "description", "resource", "status", "stale_after", "generated_by", "generated_at", *(F.element_at(extras, x).alias(x) for x in EXTRAS))
    df = memories.select(F.col("id").alias("owner"), "content", "tags", "memory_type").join(c, F.col("owner") == F.col("memory_id"))
    for part in own:
        df = df.join(part, "owner", "left")
    return df.select("memory_id", *(F.col(x).cast(t).alias(x) for x, t in DOCUMENT.items()))


def refusal(project: str | None) -> Column:
    """Why a proposal is refused whatever the store holds; null if it isn't."""
    scope = {None: "unscoped", "__global__": "global"}.get(project, "project")
    prefix = {"unscoped": "memory://unscoped/", "global": "memory://global/"}.get(scope, f"memory://project/{quote(project or '', safe='')}/")
    keys = F.transform("sources", lambda s: s["source_key"])
    return (
        F.when(F.regexp_replace("target", "^/", "").isin(*READ_ONLY), "read_only")
        .when(F.col("target").startswith("memory://") & ~F.col("target").startswith(prefix), "scope")
        .when((F.col("scope") != scope) | ~F.col("project").eqNullSafe(F.lit(project)) & F.col("project").isNotNull(), "scope")
        .when(F.col("target_id") != F.col("id"), "id_mismatch")
        .when(F.size(F.array_distinct(keys)) < F.size(keys), "duplicate_source")
    )


FOLDED = "memory_id string, seq bigint, outcome string, revision bigint, before bigint, applied boolean"


def fold(rows: DataFrame) -> DataFrame:
    """(memory_id, seq, outcome, revision, before, applied) of proposals against what each memory is.

    rows: memory_id, seq, refused, expected, dry_run, hash, revision (null: no such memory), state (its hash), in_scope, tombstoned. ``before``: the
    place whose document the proposal met, -1 for the stored one, null for none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, revision, state, at, scoped = None, None, None, None, True
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                if r["memory_id"] != now:
                    now, revision, state = r["memory_id"], r["revision"], r["state"]
                    # what the batch creates is in its own bundle
                    at, scoped = (None, True) if revision is None else (-1, r["in_scope"])
                created = revision is None
                if r["refused"] is not None:
                    outcome = r["refused"]
                elif created and r["expected"] is not None:
                    outcome = "expected_of_new"
                elif created and r["tombstoned"]:
                    outcome = "tombstoned"
                elif not scoped:
                    outcome = "scope"
                elif not created and r["expected"] is not None and r["expected"] != revision:
                    outcome = "conflict"
                elif not created and r["hash"] == state:
                    outcome = "unchanged"
                else:
                    outcome = "created" if created else "changed"
                applied = outcome in ("created", "changed") and not r["dry_run"]
                met = at
                if applied:
                    revision, state, at = (revision or 0) + 1, r["hash"], r["seq"]
                out.append((now, r["seq"], outcome, 1 if outcome == "created" else revision, met, applied))
            yield pa.RecordBatch.from_pylist([dict(zip(("memory_id", "seq", "outcome", "revision", "before", "applied"), x)) for x in out], pa.schema([("memory_id", pa.string()), ("seq", pa.int64()), ("outcome", pa.string()), ("revision", pa.int64()), ("before", pa.int64()), ("applied", pa.bool_())]))

    return rows.repartition("memory_id").sortWithinPartitions("memory_id", "seq").mapInArrow(run, FOLDED)


def put(tables: dict[str, DataFrame], documents: DataFrame, project: str | None, now: Column, operation: str = "put") -> Put:
    """Puts a batch of ``documents`` into the bundle of a project (null: unscoped).

    ``tables``: memories, concepts, sources, verifications, relationships, tombstones. documents: seq (a place of its own for each), target (an
    address or file), id, scope, project, expected (a revision), dry_run, and the columns of ``DOCUMENT``; absent ones are null.

    Outcomes: created, changed, unchanged; conflict (another revision than expected), expected_of_new (a revision of what doesn't exist), tombstoned (the id was
    deleted), scope, id_mismatch (target and document name two ids), read_only (index and log), duplicate_source (two sources with one key). A dry
    run tells what would be and leaves everything. A document without an id gets one from its place and meaning. Verifications are the document's own from
    then on, supersession ends, the first original text is kept; edges of the document, its links and its sources are made anew, others stay.
    """
    d = conformed(documents).withColumn("target_id", F.nullif(F.regexp_extract("target", r"([^/]+?)(?:\.md)?$", 1), F.lit("")))
    drawn = F.sha2(F.concat_ws("|", F.col("seq").cast("string"), "concept_type", "content"), 256)
    named = d.withColumn("memory_id", F.coalesce("target_id", "id", F.left(drawn, F.lit(36))))
    parts = semantic_parts({**{c: t for c, t in DOCUMENT.items()}, "agent_memory": "string", "generated": "string"})
    batch = normal(named, project).withColumn("refused", refusal(project)).withColumn("parts", parts).withColumn("hash", semantic_hash(F.col("parts")))
    batch = lineage.cut(batch)
    ids = batch.select("memory_id").distinct()
    m = tables["memories"].join(ids.withColumnRenamed("memory_id", "id"), "id", "left_semi")
    held = {name: tables[name].join(ids.withColumnRenamed("memory_id", key), key, "left_semi") for name, key in (("concepts", "memory_id"), ("sources", "memory_id"), ("verifications", "memory_id"), ("relationships", "src_memory_id"), ("tombstones", "memory_id"))}
    stored = stored_documents(m, held["concepts"], held["sources"], held["verifications"], held["relationships"])
    met = normal(stored, project).select("memory_id", parts.alias("parts"))
    state = met.select("memory_id", semantic_hash(F.col("parts")).alias("state")).join(held["concepts"].select("memory_id", F.col("current_revision").cast("bigint").alias("revision")), "memory_id")
    state = state.join(m.select(F.col("id").alias("memory_id"), F.col("project").eqNullSafe(F.lit(project)).alias("in_scope")), "memory_id")
    stones = held["tombstones"].select("memory_id").distinct().withColumn("tombstoned", F.lit(True))
    narrow = batch.select("memory_id", "seq", "refused", "expected", F.coalesce("dry_run", F.lit(False)).alias("dry_run"), "hash")
    done = lineage.cut(fold(narrow.join(state, "memory_id", "left").join(stones, "memory_id", "left").select(*narrow.columns, "revision", "state", "in_scope", F.coalesce("tombstoned", F.lit(False)).alias("tombstoned"))))

    # what each proposal met: the stored document or an earlier one of the batch
    wrote = batch.select("memory_id", "seq", "parts")
    earlier = wrote.select("memory_id", F.col("seq").alias("before"), F.col("parts").alias("old")).unionByName(met.select("memory_id", F.lit(-1).cast("bigint").alias("before"), F.col("parts").alias("old")))
    told = done.join(wrote, ["memory_id", "seq"]).join(earlier, ["memory_id", "before"], "left")
    moved = F.col("outcome").isin("created", "changed")
    results = told.select("seq", "memory_id", "outcome", "revision", (F.col("outcome") == "created").alias("created"), moved.alias("changed"), F.when(moved, semantic_diff(F.col("old"), F.col("parts"))).alias("diff"))

    steps = done.where("applied").join(batch, ["memory_id", "seq"])
    revisions = steps.select(F.sha2(F.concat_ws("|", "memory_id", F.col("revision").cast("string"), "hash"), 256).alias("id"), "memory_id", "revision", F.when(F.col("revision") > 1, F.col("revision") - 1).alias("parent_revision"), F.lit(operation).alias("operation"), F.col("generated_by").alias("actor"), semantic_json(F.col("parts")).alias("snapshot_json"), F.col("hash").alias("content_hash"), now.alias("created_at"))

    # a memory's last step is its state; its first text is what an original is
    last = done.where("applied").groupBy("memory_id").agg(F.max_by("seq", "revision").alias("seq"), F.min_by("seq", "revision").alias("first_seq"), F.min_by("outcome", "revision").alias("first_outcome"))
    final = batch.join(last.select("memory_id", "seq"), ["memory_id", "seq"]).join(done.select("memory_id", "seq", "revision"), ["memory_id", "seq"])
    began = last.where("first_outcome = 'created'").select("memory_id", F.col("first_seq").alias("seq")).join(batch.select("memory_id", "seq", F.col("content").alias("first_text")), ["memory_id", "seq"]).drop("seq")
    differs = steps.join(began, "memory_id", "left").join(m.select(F.col("id").alias("memory_id"), F.col("content").alias("held_text")), "memory_id", "left").groupBy("memory_id").agg(F.max((F.col("content") != F.coalesce("first_text", "held_text")).cast("int")).alias("differs"), F.first("first_text").alias("first_text"))
    final = lineage.cut(final.join(differs, "memory_id"))
    return Put(results, *written(tables, final, project, now), revisions, final.select("memory_id"))


def written(tables: dict[str, DataFrame], final: DataFrame, project: str | None, now: Column) -> tuple[DataFrame, ...]:
    """(memories, concepts, sources, verifications, relationships) after each memory of ``final`` got its last document."""
    memories, concepts = tables["memories"], tables["concepts"]
    f = final.select(*(F.col(c).alias(f"n_{c}") for c in final.columns))
    hit = F.col("n_memory_id").isNotNull()
    tags = F.when(F.size("n_tags") > 0, F.col("n_tags"))
    change = {
        "content_raw": lambda old: F.when(F.col("n_differs") == 1, F.coalesce("content_raw", "content")).otherwise(old),
        "content": lambda old: F.col("n_content"),
        "tags": lambda old: tags,
        "memory_type": lambda old: F.col("n_memory_type"),
        "superseded_by": lambda old: F.lit(None).cast("string"),
        "updated_at": lambda old: now,
    }
    j = memories.join(f, F.col("id") == F.col("n_memory_id"), "left")
    kept = j.select(*(F.when(hit, change[c](F.col(c))).otherwise(F.col(c)).alias(c) if c in change else F.col(c) for c in memories.columns))
    fresh = f.join(memories.select("id"), F.col("n_memory_id") == F.col("id"), "left_anti")
    new = {"id": F.col("n_memory_id"), "content": F.col("n_content"), "content_raw": F.when(F.col("n_differs") == 1, F.col("n_first_text")), "tags": tags, "project": F.lit(project), "agent": F.col("n_generated_by"), "memory_type": F.col("n_memory_type"), "created_at": now, "updated_at": now, "access_count": F.lit(0)}
    out_memories = kept.unionByName(fresh.select(*(new.get(c, F.lit(None)).cast(memories.schema[c].dataType).alias(c) for c in memories.columns)))

    extras = F.to_json(F.struct(*(F.col(f"n_{x}").alias(x) for x in EXTRAS)))
    described = {c: F.col(f"n_{c}") for c in ("concept_type", "title", "description", "resource", "status", "stale_after", "generated_by", "generated_at")} | {"extensions": extras, "current_revision": F.col("n_revision"), "updated_at": now}
    j = concepts.join(f, F.col("memory_id") == F.col("n_memory_id"), "left")
    kept = j.select(*(F.when(hit, described[c]).otherwise(F.col(c)).cast(concepts.schema[c].dataType).alias(c) if c in described else F.col(c) for c in concepts.columns))
    new = described | {"memory_id": F.col("n_memory_id"), "created_at": now, "virtual_path": F.concat(F.lit("memories/"), "n_memory_id", F.lit(".md"))}
    out_concepts = kept.unionByName(fresh.select(*(new.get(c, F.lit(None)).cast(concepts.schema[c].dataType).alias(c) for c in concepts.columns)))

    def replaced(table: DataFrame, column: str, values: dict[str, Column]) -> DataFrame:
        rows = final.select("memory_id", F.posexplode(column).alias("k", "v"))
        values = values | {"memory_id": F.col("memory_id"), "id": F.sha2(F.concat_ws("|", F.lit(column), "memory_id", F.col("k").cast("string")), 256)}
        other = table.join(final.select("memory_id"), "memory_id", "left_anti")
        return other.unionByName(rows.select(*(values.get(c, F.col(f"v.{c}") if c in rows.schema["v"].dataType.names else F.lit(None)).cast(table.schema[c].dataType).alias(c) for c in table.columns)))

    out_sources = replaced(tables["sources"], "sources", {"ordinal": F.col("k")})
    out_verifications = replaced(tables["verifications"], "verified", {})

    links = final.select("memory_id", "revision", F.explode(links_of("content")).alias("l"))
    edges = [
        final.select("memory_id", "revision", F.posexplode("edges").alias("ordinal", "e")).select("memory_id", "revision", "ordinal", "e.target", "e.relation", "e.confidence", F.lit("document").alias("producer")),
        links.select("memory_id", "revision", F.col("l.ordinal").alias("ordinal"), "l.target", F.lit("links_to").alias("relation"), F.lit("extracted").alias("confidence"), F.lit("markdown").alias("producer")),
        final.select("memory_id", "revision", F.posexplode("sources").alias("ordinal", "s")).select("memory_id", "revision", "ordinal", F.col("s.resource").alias("target"), F.lit("cites").alias("relation"), F.lit("asserted").alias("confidence"), F.lit("sources").alias("producer")),
    ]
    relationships = tables["relationships"]
    made = []
    for rows in edges:
        e = resolve_references(rows, out_memories.select("id", "project"))
        id_ = F.sha2(F.concat_ws("|", "memory_id", "producer", "relation", "target", F.col("ordinal").cast("string")), 256)
        values = {"id": id_, "src_memory_id": F.col("memory_id"), "dst_memory_id": F.col("dst"), "dst_ref": F.col("target"), "relation": F.col("relation"), "confidence": F.col("confidence"), "producer": F.col("producer"), "source_revision": F.col("revision"), "ordinal": F.col("ordinal"), "metadata_json": F.lit("{}"), "created_at": now}
        made.append(e.select(*(values.get(c, F.lit(None)).cast(relationships.schema[c].dataType).alias(c) for c in relationships.columns)))
    return out_memories, out_concepts, out_sources, out_verifications, project_edges(relationships, final.select("memory_id"), *made)


