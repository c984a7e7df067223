"""Hybrid retrieval: fusion, match quality, rerank, graph neighbours, freshness, scope boosts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from mnemospark.operators.graph import traverse
from mnemospark.operators.lexical import top_k
from mnemospark.operators.search_index import PORTER, Analyzer, Index, in_memory, search
from mnemospark.operators.vector import knn

RRF_K, OVERFETCH = 60, 3
CURRENT_BOOST, GLOBAL_BOOST, STALE_FACTOR, DISTANCE_DECAY = 1.5, 1.25, 0.9, 0.75
# What a neighbour's score keeps, by the relation that leads to it.
RELATION_FACTORS = {"supports": 0.80, "supersedes": 0.78, "derived_from": 0.70, "links_to": 0.65, "cites": 0.62}
OTHER_RELATION = 0.60
# How far a search looks over edges.
GRAPH_DEPTH, GRAPH_FAN_OUT, GRAPH_PATHS = 2, 12, 300
OFF_VALUES = ("0", "false", "off", "no", "n")


@dataclass(frozen=True)
class SearchOptions:
    limit: int = 10
    current_boost: float | None = CURRENT_BOOST
    global_boost: float | None = GLOBAL_BOOST
    graph_depth: int = 0
    #: an SQL predicate over the memories' columns, after the candidates are cut ("post") or before ("pre")
    where: str | None = None
    filter_mode: str = "post"
    legacy_order: bool = False
    rerank: Callable[[DataFrame], DataFrame] | None = None


def resolve_boosts(current_project: str | None, disabled: bool = False) -> tuple[float | None, float | None]:
    """The two boosts: none if disabled, the current project's only if there is one."""
    return (None, None) if disabled else (CURRENT_BOOST if current_project else None, GLOBAL_BOOST)


def rerank_enabled(setting: str | None) -> bool:
    return (setting or "").strip().lower() not in OFF_VALUES


def rrf(lexical: DataFrame, vector: DataFrame, id_column: str, limit: int | None = None) -> DataFrame:
    """(query_id, id, score, bm25_rank, vector_rank), ranks from 0; by reciprocal rank fusion.

    Both lists are already cut to their ranks, so the fusion moves a few rows for each query.
    """
    a = lexical.select("query_id", id_column, (F.col("rank") - 1).alias("bm25_rank"))
    b = vector.select("query_id", id_column, (F.col("rank") - 1).alias("vector_rank"))
    part = lambda r: F.coalesce(1 / (F.lit(RRF_K) + F.col(r) + 1), F.lit(0.0))
    fused = a.join(b, ["query_id", id_column], "full_outer").withColumn("score", part("bm25_rank") + part("vector_rank"))
    return fused if limit is None else top_k(fused, id_column, limit).drop("rank")


def match_quality(bm25_rank: Column, vector_rank: Column) -> Column:
    near = lambda r, n: F.coalesce(r < n, F.lit(False))
    return (
        F.when(near(bm25_rank, 5) & near(vector_rank, 5), "high")
        .when(near(bm25_rank, 10) & near(vector_rank, 10), "medium")
        .when(near(bm25_rank, 5) | near(vector_rank, 5), "medium")
        .otherwise("low")
    )


def apply_rerank(candidates: DataFrame, reranked: DataFrame) -> DataFrame:
    """Scores of ``reranked`` (query_id, id, logit) through a sigmoid, for queries that it covers whole."""
    joined = candidates.join(reranked, ["query_id", "id"], "left")
    per_query = Window.partitionBy("query_id")
    whole = F.count("logit").over(per_query) == F.count("*").over(per_query)
    return joined.withColumn("score", F.when(whole, 1 / (1 + F.exp(-F.col("logit")))).otherwise(F.col("score"))).drop("logit")


def freshness(score: Column, stale: Column) -> Column:
    return F.when(stale, score * STALE_FACTOR).otherwise(score)


def scope_boost(score: Column, project: Column, current: Column, current_boost: float | None = CURRENT_BOOST, global_boost: float | None = GLOBAL_BOOST) -> Column:
    """The current project's rows by one factor, else global rows by the other."""
    cond = None
    if current_boost not in (None, 1.0):
        cond = F.when(project == current, score * current_boost)
    if global_boost not in (None, 1.0):
        cond = (F if cond is None else cond).when(project == "__global__", score * global_boost)
    return score if cond is None else cond.otherwise(score)


def section(project: Column, current: Column) -> Column:
    return F.when(project == "__global__", "general_knowledge").when(project == current, "project_memories").when(current.isNotNull(), "other_projects").otherwise("project_memories")


def relation_factor(relation: Column) -> Column:
    out = None
    for name, factor in RELATION_FACTORS.items():
        out = F.when(relation == name, F.lit(factor)) if out is None else out.when(relation == name, F.lit(factor))
    return out.otherwise(F.lit(OTHER_RELATION))


def graph_neighbours(results: DataFrame, paths: DataFrame, limit: int, live: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, relation, distance): neighbours that join the results.

    ``results``: (query_id, id, score, rank); ``paths``: (query_id, ord, root, node, relation,
    distance, cycle) in traversal order. A third of the limit, rounded up, of new nodes by path order;
    only nodes of ``live`` (id), if given, which others don't take the places of.
    """
    budget = max(1, -(-limit // 3))
    seeds = results.where(F.col("rank") <= max(limit, 1)).select("query_id", F.col("id").alias("root"), F.col("score").alias("seed_score"))
    known = results.select("query_id", F.col("id").alias("node"))
    fresh = paths.where(~F.col("cycle")).join(seeds, ["query_id", "root"]).join(known, ["query_id", "node"], "left_anti")
    if live is not None:
        fresh = fresh.join(live.select(F.col("id").alias("node")), "node", "left_semi")
    first = Window.partitionBy("query_id", "node").orderBy("ord")
    place = Window.partitionBy("query_id").orderBy("ord")
    once = fresh.withColumn("n", F.row_number().over(first)).where("n = 1").withColumn("n", F.row_number().over(place)).where(F.col("n") <= budget)
    score = F.col("seed_score") * relation_factor(F.col("relation")) * F.pow(F.lit(DISTANCE_DECAY), F.greatest(F.col("distance") - 1, F.lit(0)))
    return once.select("query_id", F.col("node").alias("id"), score.alias("score"), "relation", "distance")


def hybrid_search(memories: DataFrame, concepts: DataFrame, index: Index | DataFrame, queries: DataFrame, options: SearchOptions = SearchOptions(), edges: DataFrame | None = None, analyzer: Analyzer = PORTER, digits: int | None = None) -> DataFrame:
    """Results of a batch of queries (query_id, text, embedding, current_project).

    Lexical list (the query language of ``search_index``, over a stored index or rows of segments) and vector list of three times
    the limit, fusion cut to as many, filters, optional rerank, graph neighbours of the best over ``edges``, freshness (column ``stale`` of
    memories), scope boosts, the best ``limit``. Superseded and deprecated memories take no places of the lexical list, superseded ones none
    of the vector list; none of both comes out, nor do those that the predicate refuses. ``digits``: scores are rounded before they are compared.
    """
    over = OVERFETCH * options.limit
    live = memories.where("superseded_by IS NULL")
    allowed = live if options.where is None else live.where(options.where)
    if options.filter_mode == "pre":
        live = allowed
    stable = concepts.where("status <> 'deprecated'").select("memory_id")
    ranked_ids = live.select(F.col("id").alias("memory_id")).join(stable, "memory_id")
    lexical = search(index if isinstance(index, Index) else in_memory(index, analyzer), queries.select("query_id", "text"), over, ranked_ids, analyzer, digits).withColumnRenamed("memory_id", "id")
    vector = knn(live, queries.where("embedding IS NOT NULL").select("query_id", "embedding"), over)
    fused = rrf(lexical, vector, "id", over)
    rows = allowed.join(stable, F.col("id") == F.col("memory_id"))
    rows = rows.select("id", "project", F.coalesce(F.col("stale"), F.lit(False)).alias("stale") if "stale" in memories.columns else F.lit(False).alias("stale"))
    found = fused.join(rows, "id")
    if options.rerank is not None:
        found = apply_rerank(found, options.rerank(found))
    if edges is not None and options.graph_depth > 0:
        best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).select("query_id", "id", "score", "rank")
        roots = best.where(F.col("rank") <= options.limit).select("query_id", F.col("id").alias("root"), F.col("rank").alias("position"))
        paths, _ = traverse(edges, roots, "both", (), min(options.graph_depth, GRAPH_DEPTH), GRAPH_FAN_OUT, min(max(OVERFETCH * options.limit, 1), GRAPH_PATHS))
        paths = paths.select("query_id", "ord", "root", "node", F.element_at("relations", -1).alias("relation"), F.col("depth").alias("distance"), "cycle")
        near = graph_neighbours(best, paths, options.limit, rows).select("query_id", "id", "score").join(rows, "id")
        found = found.unionByName(near, allowMissingColumns=True)
    found = found.join(queries.select("query_id", "current_project"), "query_id")
    score = scope_boost(freshness(F.col("score"), F.col("stale")), F.col("project"), F.col("current_project"), options.current_boost, options.global_boost)
    found = found.withColumn("fused_score", F.col("score")).withColumn("score", score)
    order_by = "fused_score" if options.legacy_order and options.current_boost is None and options.global_boost is None else "score"
    if digits is not None:
        found = found.withColumn(order_by, F.round(order_by, digits))
    order = Window.partitionBy("query_id").orderBy(F.desc(order_by), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= options.limit)
    return ranked.select("query_id", "id", "project", "score", "bm25_rank", "vector_rank", match_quality(F.col("bm25_rank"), F.col("vector_rank")).alias("quality"), section(F.col("project"), F.col("current_project")).alias("section"), "rank")


def access_increments(results: DataFrame) -> DataFrame:
    """(id, n): how often each id came up, to be added to an access log; reading never writes."""
    return results.select("query_id", "id").distinct().groupBy("id").agg(F.count("*").alias("n"))


def delete_hits(memories: DataFrame, results: DataFrame) -> DataFrame:
    """The memories without those that a search found."""
    return memories.join(results.select("id").distinct(), "id", "left_anti")


def result_hints(results: DataFrame) -> DataFrame:
    """(query_id, n_other_projects, n_global)."""
    return results.groupBy("query_id").agg(F.count_if(F.col("section") == "other_projects").alias("n_other_projects"), F.count_if(F.col("project") == "__global__").alias("n_global"))
