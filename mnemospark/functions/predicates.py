"""Row predicates over memories and concepts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

# What marks a secret, a refusal, and a question about the state of a repository.
SECRET_MARKERS = ["-----BEGIN PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----", "AWS_SECRET_ACCESS_KEY", "GITHUB_TOKEN=", "API_KEY=", "PASSWORD="]
REFUSAL_MARKERS = ["i cannot", "i can't", "i'm unable", "i am unable", "i'm sorry, but", "i am sorry, but", "as an ai", "as a language model"]
STATE_WORDS = ["git", "commit", "commits", "committed", "committing", "tag", "tags", "tagged", "tagging", "version", "versions", "versioned", "versioning", "semver", "release", "releases", "released", "releasing", "changelog", "push", "pushed", "pushing", "rebase", "merge", "branch", "sha"]


def live(superseded_by: str = "superseded_by") -> Column:
    return F.col(superseded_by).isNull()


def in_scope(project: str | None) -> Column:
    """A project, ``__global__``, or None for rows without one."""
    return F.col("project").eqNullSafe(F.lit(project))


def contains_any(c: Column, markers: list[str]) -> Column:
    out = c.contains(markers[0])
    for m in markers[1:]:
        out = out | c.contains(m)
    return out


def has_secret(text: Column) -> Column:
    return contains_any(F.upper(text), SECRET_MARKERS)


def is_refusal(text: Column) -> Column:
    return contains_any(F.lower(text), REFUSAL_MARKERS)


def canonical_state_intent(text: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(text), "[^a-z0-9]+"), F.array(*map(F.lit, STATE_WORDS)))


def has_tag(tag: str, like: bool = False) -> Column:
    """Exact tag; ``like``: case-insensitive, with ``%`` and ``_`` as wildcards."""
    if like:
        return F.to_json("tags").ilike(f'%"{tag}"%')
    return F.array_contains("tags", tag)


def stale_in_search(stale_after: Column, now: Column) -> Column:
    """Only full RFC 3339 times count; a bare date is never stale."""
    full = stale_after.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$")
    return F.coalesce(full & (F.try_to_timestamp(F.when(full, F.upper(stale_after))) <= now), F.lit(False))


def stale_in_index(stale_after: Column, today: Column) -> Column:
    """A comparison of text, so that a bare date counts."""
    return F.coalesce(stale_after < today, F.lit(False))


def trust_tier(actors: Column) -> Column:
    """By the array of verifying actors."""
    return F.when(F.coalesce(F.size(actors), F.lit(0)) <= 0, "unverified").when(F.exists(actors, lambda a: a.startswith("human:")), "human_reviewed").otherwise("machine_confirmed")


def prune_candidates(memories: DataFrame, now: Column, days: int = 90, max_access: int = 0) -> DataFrame:
    """Live rows not updated for ``days`` and read at most ``max_access`` times."""
    return memories.where(live() & (F.col("updated_at") < now - F.expr(f"INTERVAL {days} DAYS")) & (F.col("access_count") <= max_access))


def recall(memories: DataFrame, limit: int = 10, project: str | None = None, agent: str | None = None, memory_type: str | None = None, tags: tuple[str, ...] = (), like: bool = False) -> DataFrame:
    """Live rows under all given filters, the latest first."""
    df = memories.where(live())
    for name, value in (("project", project), ("agent", agent), ("memory_type", memory_type)):
        if value is not None:
            df = df.where(F.col(name) == value)
    for t in tags:
        df = df.where(has_tag(t, like))
    return df.orderBy(F.desc("updated_at"), "id").limit(limit)


def resolve_prefix(memories: DataFrame, prefix: str) -> DataFrame:
    """(id, tier, matches) of the best tier: 0 the exact id, 1 live ids, 2 any ids by prefix.

    One row is a match, several (at most 17) are ambiguous, none is not found.
    """
    if len(prefix.encode()) < 4:
        raise ValueError("an id prefix has four bytes at least")
    tier = F.when(F.col("id") == prefix, 0).when(live(), 1).otherwise(2)
    found = memories.where(F.col("id").startswith(prefix)).select("id", tier.alias("tier"))
    best = found.groupBy().agg(F.min("tier").alias("best"))
    kept = found.join(F.broadcast(best), F.col("tier") == F.col("best")).select("id", "tier")
    return kept.orderBy("id").limit(17).withColumn("matches", F.count("*").over(Window.partitionBy("tier")))


def lifecycle(rows: DataFrame, memory_type: str | None = None, tags: tuple[str, ...] = (), only_project: str | None = None) -> DataFrame:
    """Rows (memories joined with concepts) that search may show."""
    df = rows.where(live() & (F.col("status") != "deprecated"))
    if memory_type is not None:
        df = df.where(F.col("concept_type") == memory_type)
    for t in tags:
        df = df.where(has_tag(t))
    return df if only_project is None else df.where(F.col("project") == only_project)


def curation_candidates(memories: DataFrame, state: DataFrame, version: str, full: bool = False) -> DataFrame:
    """Live rows a curation pass must look at: edited since the project's last pass, or not stamped by ``version``."""
    key = F.coalesce(F.col("project"), F.lit("__null__"))
    joined = memories.where(live()).withColumn("state_key", key).join(state.select(F.col("project").alias("state_key"), "last_dream_at"), "state_key", "left").drop("state_key")
    due = F.col("last_dream_at").isNull() | (F.col("updated_at") > F.col("last_dream_at")) | F.col("condenser_version").isNull() | (F.col("condenser_version") != version)
    return joined if full else joined.where(due)
