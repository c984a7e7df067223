"""A model's decisions over batches of memories: read, checked, and applied to the tables as joins.

A batch's reply stands or falls as a whole: a key that names no row of it, a row named twice or not at all, and a blank
body fail the batch. What stands is checked against its targets and budgets, then failures (of embedding, of a gateway, whatever
the caller met while it made replacements) spread: a merge whose target failed fails too. Targets of merges are kept or replaced,
never merged themselves, so one step reaches all.

All is set-based over all batches; replacements, other decisions and merges take effect in this order because
merges point to what their target's replacement is called.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.text import canonical_uri, merge_budget, rewrite_budget, trimmed
from mnemospark.operators.curate import deprecate, validate
from mnemospark.operators.revisions import carry_concepts, supersede
from mnemospark.plans import lineage

#: What a decision does, by its action.
EFFECTS = {"keep": "kept", "keep_original": "kept", "drop": "dropped", "deprecate": "deprecated", "merge_into": "merged", "supersede_by": "superseded", "extract": "extracted", "contradiction": "contradictions"}
REPLACES = ("supersede_by", "extract")
ACTIONS = [a for a in EFFECTS if a != "keep_original"]
#: The counters of a pass, in order: of the pass itself, then of the review.
COUNTERS = ["total_walked", "kept", "rewritten", "forgot", "superseded", "failed", "review_kept", "review_dropped", "review_deprecated", "review_merged", "review_superseded", "review_extracted", "review_contradictions"]


class Review(NamedTuple):
    """``outcomes`` (batch, id, action, target, content, tags, reason, outcome, why), the tables after it, what was made, and who goes on.

    outcome is an effect (kept, merged, ...) or failed; ``survivors`` (id) go on to dedup and condensation, ``disputed`` (id) stay out of dedup,
    ``retry`` (id) failed. ``tombstones`` (memory_id, reason) are of dropped and replaced memories.
    """

    outcomes: DataFrame
    memories: DataFrame
    concepts: DataFrame
    edges: DataFrame
    tombstones: DataFrame
    survivors: DataFrame
    disputed: DataFrame
    retry: DataFrame


def named(members: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions with ``id`` for ``key`` and targets by id, failed batches (batch, why)).

    members: batch, id, place (from 1). decisions: batch, key, action, target, content, tags, reason. A key is an id, or r1, r2, ... by place; an id wins over
    a place's name. A member of a batch without any decision fails it too.
    """
    own = members.select("batch", "id", F.col("id").alias("name"), F.lit(0).alias("turn")).unionByName(members.select("batch", "id", F.concat(F.lit("r"), F.col("place").cast("string")).alias("name"), F.lit(1).alias("turn")))
    names = own.groupBy("batch", "name").agg(F.min_by("id", "turn").alias("named"))
    found = decisions.join(names.select("batch", F.col("name").alias("key"), F.col("named").alias("id")), ["batch", "key"], "left")
    found = found.join(names.select("batch", F.col("name").alias("target"), F.col("named").alias("target_id")), ["batch", "target"], "left").withColumn("target", F.coalesce("target_id", "target")).drop("target_id")
    per = found.groupBy("batch", "id").agg(F.count("*").alias("n"), F.max(F.col("action").isin(ACTIONS)).alias("known"), F.min(F.col("action").isin(ACTIONS)).alias("all_known"))
    whole = members.select("batch", "id").distinct().withColumn("member", F.lit(True)).join(per.where("id IS NOT NULL"), ["batch", "id"], "full_outer")
    unknown = per.where("id IS NULL").select("batch", F.lit("unknown id").alias("why"), F.lit(0).alias("turn"))
    wrong = whole.where("n IS NULL").select("batch", F.lit("coverage mismatch").alias("why"), F.lit(3).alias("turn"))
    twice = whole.where("n > 1").select("batch", F.lit("duplicate decision").alias("why"), F.lit(1).alias("turn"))
    odd = per.where("NOT coalesce(all_known, false)").select("batch", F.lit("unknown action").alias("why"), F.lit(2).alias("turn"))
    failed = unknown.unionByName(twice).unionByName(odd).unionByName(wrong).groupBy("batch").agg(F.min_by("why", "turn").alias("why"))
    return found, failed


def budgeted(valid: DataFrame, memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions (batch, id, action, target, content, ...) with over-long ones kept, batches with a blank body (batch)).

    The limits are those of ``curate.length_budget``: three quarters of what is merged, or half as much again as the original.
    """
    n = lambda c: F.length(trimmed(c))
    rows = valid.join(memories.select("id", F.col("content").alias("own"), F.coalesce("content_raw", "content").alias("raw")), "id", "left")
    fed = rows.where("action = 'merge_into'").groupBy("batch", F.col("target").alias("id")).agg(F.sum(n(F.col("own"))).alias("incoming"))
    j = rows.join(fed, ["batch", "id"], "left")
    replaced, merged = F.when(F.col("action").isin(*REPLACES), F.coalesce("content", F.lit(""))), F.col("incoming").isNotNull()
    body = F.coalesce(replaced, F.when(merged, F.col("own")))
    most = F.when(merged, merge_budget(n(F.col("own")) + F.col("incoming"))).otherwise(rewrite_budget(F.col("raw")))
    sized = lineage.cut(j.select("batch", "id", n(body).alias("size"), most.alias("most")).where("size IS NOT NULL"))
    over = sized.where("size > most").select("batch", "id")
    marked = valid.join(over.withColumn("own_over", F.lit(True)), ["batch", "id"], "left").join(over.select("batch", F.col("id").alias("target"), F.lit(True).alias("target_over")), ["batch", "target"], "left")
    keep = F.coalesce("own_over", F.lit(False)) | (F.coalesce("target_over", F.lit(False)) & (F.col("action") == "merge_into"))
    kept = {"action": F.when(keep, "keep_original").otherwise(F.col("action")), "reason": F.when(keep, "length budget").otherwise(F.col("reason"))} | {c: F.when(~keep, F.col(c)) for c in ("target", "content", "tags")}
    return marked.withColumns(kept).drop("own_over", "target_over"), sized.where("size = 0").select("batch").distinct()


def decide(members: DataFrame, decisions: DataFrame, memories: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """(batch, id, action, target, content, tags, reason, outcome, why) of every member.

    failures: (id, why) of replacements or writes that failed. Members of a failed batch all fail.
    """
    found, failed = named(members, decisions)
    # a member may have several decisions in a batch that fails for it; those batches are out from here on
    found = lineage.cut(found.join(failed.select("batch"), "batch", "left_anti"))
    checked = validate(found).join(found.select("batch", "id", "content", "tags", "reason"), ["batch", "id"])
    rows, blank = budgeted(checked, memories)
    failed = failed.unionByName(blank.withColumn("why", F.lit("blank body")))
    broken = (failures if failures is not None else failed.sparkSession.createDataFrame([], f"id {members.schema['id'].dataType.simpleString()}, why string")).groupBy("id").agg(F.min("why").alias("own_why"))
    rows = members.select("batch", "id").distinct().join(rows, ["batch", "id"], "left").join(failed, "batch", "left").join(broken, "id", "left")
    own = F.coalesce("why", "own_why")
    state = lineage.cut(rows.withColumn("own_failed", own))
    lost = state.where("own_failed IS NOT NULL").select("batch", F.col("id").alias("target"), F.lit("merge target replacement failed").alias("target_why")).distinct()
    out = state.join(lost, ["batch", "target"], "left")
    why = F.coalesce("own_failed", F.when(F.col("action") == "merge_into", F.col("target_why")))
    effect = F.lit(None).cast("string")
    for action, name in EFFECTS.items():
        effect = F.when(F.col("action") == action, name).otherwise(effect)
    return out.select("batch", "id", "action", "target", "content", "tags", "reason", F.when(why.isNotNull(), "failed").otherwise(effect).alias("outcome"), why.alias("why"))


def new_id(id_: Column) -> Column:
    """What the replacement of a memory is called."""
    return F.left(F.sha2(F.concat_ws("|", F.lit("replaced"), id_), 256), F.lit(36))


def apply(outcomes: DataFrame, memories: DataFrame, concepts: DataFrame, actor: str, stamp: str, now: Column) -> Review:
    """The tables after the decisions ``decide`` let pass. An id is in one batch."""
    rows = lineage.cut(outcomes)
    done = rows.where("outcome <> 'failed'")
    replaced = done.where(F.col("action").isin(*REPLACES))
    j = memories.join(replaced.select("id", F.col("content").alias("new_body"), F.col("tags").alias("new_tags")), "id")
    blank = F.lit(None)
    new = {"id": new_id(F.col("id")), "content": F.col("new_body"), "tags": F.coalesce("new_tags", "tags"), "created_at": now, "updated_at": now, "access_count": F.lit(0), "content_raw": blank, "superseded_by": blank, "embedding": blank, "embedding_model": blank, "condenser_version": F.lit(stamp)}
    fresh = j.select(*((new[c].cast(memories.schema[c].dataType) if c in new else F.col(c)).alias(c) for c in memories.columns))
    gone = done.where(F.col("action").isin("drop", *REPLACES)).select("id", "action")
    # merges point to what their target is called now
    targets = replaced.select(F.col("id").alias("target"), new_id(F.col("id")).alias("called"))
    merges = done.where("action = 'merge_into'").select(F.col("id").alias("older"), "target").join(targets, "target", "left").select("older", F.coalesce("called", "target").alias("newer"), "target", F.col("called").isNotNull().alias("into_new"))
    kept = memories.join(gone, "id", "left_anti")
    out_memories = supersede(kept, merges).unionByName(fresh)
    carried = carry_concepts(concepts, j.select("id", new_id(F.col("id")).alias("new_id")))
    made = replaced.select(new_id(F.col("id")).alias("made_id"))
    carried = carried.join(made, F.col("memory_id") == F.col("made_id"), "left")
    generated = {"generated_by": F.lit(actor), "generated_at": now.cast("string")}
    carried = carried.select(*((F.when(F.col("made_id").isNotNull(), generated[c]).otherwise(F.col(c)) if c in generated else F.col(c)).alias(c) for c in concepts.columns))
    carried = carried.join(gone, F.col("memory_id") == F.col("id"), "left_anti")
    out_concepts = deprecate(carried, done.where("action = 'deprecate'").select(F.col("id").alias("memory_id"), F.coalesce("reason", F.lit("")).alias("reason")))

    where = memories.select(F.col("id").alias("old_id"), canonical_uri(F.col("id"), F.col("project")).alias("uri"))
    old = replaced.join(where, F.col("id") == F.col("old_id"))
    kinds = F.when(F.col("action") == "supersede_by", F.array(F.lit("derived_from"), F.lit("supersedes"))).otherwise(F.array(F.lit("derived_from")))
    edges = old.select(new_id(F.col("id")).alias("src_memory_id"), F.lit(None).cast(memories.schema["id"].dataType).alias("dst_memory_id"), F.col("uri").alias("dst_ref"), F.explode(kinds).alias("relation"), F.lit(None).cast("string").alias("reason"))
    fed = merges.where("into_new").join(where, F.col("older") == F.col("old_id")).select(F.col("newer").alias("src_memory_id"), F.lit(None).cast(memories.schema["id"].dataType).alias("dst_memory_id"), F.col("uri").alias("dst_ref"), F.lit("derived_from").alias("relation"), F.lit(None).cast("string").alias("reason"))
    disputes = done.where("action = 'contradiction'")
    against = disputes.join(where, F.col("target") == F.col("old_id")).select(F.col("id").alias("src_memory_id"), F.col("target").alias("dst_memory_id"), F.col("uri").alias("dst_ref"), F.lit("contradicts").alias("relation"), "reason")
    stones = gone.select(F.col("id").alias("memory_id"), F.when(F.col("action") == "drop", "project review drop").when(F.col("action") == "extract", "dream_extract").otherwise("dream_supersede").alias("reason"))
    stay = rows.where(F.col("outcome").isin("failed", "kept", "contradictions")).select("id").unionByName(replaced.select(new_id(F.col("id")).cast(memories.schema["id"].dataType).alias("id")))
    disputed = disputes.select("id").unionByName(disputes.select(F.col("target").alias("id"))).distinct()
    return Review(rows, out_memories, out_concepts, edges.unionByName(fed).unionByName(against).withColumn("producer", F.lit(actor)), stones, stay, disputed, rows.where("outcome = 'failed'").select("id"))


def review_counters(outcomes: DataFrame) -> DataFrame:
    """One row: how many decisions had each effect, and how many failed."""
    names = list(dict.fromkeys(EFFECTS.values()))
    return outcomes.agg(*(F.count_if(F.col("outcome") == n).alias(n) for n in [*names, "failed"]))


def pass_counters(reviewed: DataFrame, condensed: DataFrame, walked: DataFrame, doubles: DataFrame) -> DataFrame:
    """The counters of a whole pass, a row: reviewed outcomes, condensation outcomes (outcome), candidates walked, and pairs superseded by dedup."""
    rows = [
        walked.select(F.lit("total_walked").alias("counter")),
        doubles.select(F.lit("superseded").alias("counter")),
        condensed.select(F.when(F.col("outcome").isin("skip", "error_too_long"), "kept").when(F.col("outcome") == "rewrite", "rewritten").when(F.col("outcome") == "forget", "forgot").otherwise("failed").alias("counter")),
        reviewed.select(F.when(F.col("outcome") == "failed", "failed").otherwise(F.concat(F.lit("review_"), "outcome")).alias("counter")),
    ]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    return every.agg(*(F.count_if(F.col("counter") == c).alias(c) for c in COUNTERS))
