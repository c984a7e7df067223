"""Bounded breadth-first traversal of typed edges, level by level as joins."""

from __future__ import annotations

import functools
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from mnemospark.plans import lineage

MAX_DEPTH, MAX_FAN_OUT, MAX_RESULTS = 8, 100, 1000
EDGE_KEY = ["src_memory_id", "producer", "source_revision", "relation", "dst_ref"]


class Walks(NamedTuple):
    """``paths`` (query_id, root, node, nodes, relations, reversed, depth, ord, cycle), ``diagnostics`` (query_id, source, relation,
    reference) of edges that lead nowhere, and ``truncated`` (query_id, truncated): whether a walk may have missed something."""

    paths: DataFrame
    diagnostics: DataFrame
    truncated: DataFrame


def adjacency(edges: DataFrame, direction: str = "both", fan_out: int = 12, nodes: DataFrame | None = None) -> DataFrame:
    """(node, place, relation, neighbour, reference, reversed, full): each node's first edges; only of ``nodes`` (node) if given.

    Outgoing edges come first, then incoming ones in what is left of the limit. Edges keep the
    node's own order; ``full`` tells whether the node reached the limit. Each task cuts its rows first.
    """
    limit = max(1, min(fan_out, MAX_FAN_OUT))
    tail = [F.col("producer"), F.coalesce("ordinal", F.lit(-1)).alias("ordinal_key"), F.col("id").alias("edge_id")]
    out = edges.select(F.col("src_memory_id").alias("node"), F.lit(0).alias("dir"), "relation", F.col("dst_ref").alias("far"), *tail, F.col("dst_memory_id").alias("neighbour"), F.col("dst_ref").alias("reference"))
    back = edges.where(F.col("dst_memory_id").isNotNull()).select(F.col("dst_memory_id").alias("node"), F.lit(1).alias("dir"), "relation", F.col("src_memory_id").alias("far"), *tail, F.col("src_memory_id").alias("neighbour"), F.col("dst_ref").alias("reference"))
    both = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    if nodes is not None:
        both = both.join(nodes, "node", "left_semi")
    order = Window.partitionBy("node").orderBy("dir", "relation", "far", "producer", "ordinal_key", "edge_id")
    cut = both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    full = F.max("place").over(Window.partitionBy("node")) == limit
    return cut.select("node", "place", "relation", "neighbour", "reference", (F.col("dir") == 1).alias("reversed"), full.alias("full"))


def bounded_walks(edges: DataFrame, roots: DataFrame, direction: str = "both", relations: tuple[str, ...] = (), max_depth: int = 2, fan_out: int = 12, max_results: int = 300) -> Walks:
    """Breadth-first walks from ``roots`` (root, and query_id if there are several walks, position if a walk has several).

    A path that comes back to one of its nodes is kept but not extended. Each level is ranked by its parents' order and the
    edges' own, cut at what is left of the walk's ``max_results``, and written before the next; a walk that has reached its cap
    stops, so a level holds at most cap x fan_out rows of a walk. Edges that lead nowhere are told as far as the walk came.
    """
    depth_limit, cap = min(max_depth, MAX_DEPTH), max(1, min(max_results, MAX_RESULTS))
    if "query_id" not in roots.columns:
        roots = roots.withColumn("query_id", F.lit(0))
    # a root's place among its walk's roots begins every path's order
    position = F.col("position").cast("int") if "position" in roots.columns else F.dense_rank().over(Window.partitionBy("query_id").orderBy("root"))
    frontier = roots.select("query_id", "root", F.col("root").alias("last"), F.array("root").alias("nodes"), F.array().cast("array<string>").alias("relations"), F.array().cast("array<boolean>").alias("reversed"), F.array(position).alias("way"), F.lit(cap).alias("left"))
    walk = Window.partitionBy("query_id")
    turn = walk.orderBy("way", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wanted = F.col("relation").isin(*relations) if relations else F.lit(True)
    levels = []
    for depth in range(1, max(1, depth_limit) + 1):
        if depth > depth_limit:
            frontier = frontier.limit(0)
        near = adjacency(edges, direction, fan_out, frontier.select(F.col("last").alias("node")).distinct()).withColumnRenamed("reversed", "back")
        step = frontier.join(near, F.col("last") == F.col("node")).withColumn("leads", (wanted & F.col("neighbour").isNotNull()).cast("int"))
        step = step.withColumn("found", F.sum("leads").over(turn)).withColumn("after", F.col("left") - F.least("left", F.sum("leads").over(walk)))
        kept = (F.col("leads") == 1) & (F.col("found") <= F.col("left"))
        lost = wanted & F.col("neighbour").isNull() & (F.col("found") < F.col("left"))
        filled = F.col("full") & (F.col("place") == 1) & (F.col("found") - F.col("leads") < F.col("left"))
        named = step.select("*", kept.alias("kept"), lost.alias("lost"), (filled | (F.col("after") == 0)).alias("truncated"), F.array_contains("nodes", F.col("neighbour")).alias("cycle"))
        level = lineage.cut(named.where("kept OR lost OR truncated").withColumn("depth", F.lit(depth)).withColumn("ord", (F.lit(cap) - F.col("left") + F.col("found")).cast("int")))
        levels.append(level)
        frontier = level.where("kept AND NOT cycle AND after > 0").select(
            "query_id",
            "root",
            F.col("neighbour").alias("last"),
            F.concat("nodes", F.array("neighbour")).alias("nodes"),
            F.concat("relations", F.array("relation")).alias("relations"),
            F.concat("reversed", F.array("back")).alias("reversed"),
            F.concat("way", F.array("place")).alias("way"),
            F.col("after").cast("int").alias("left"),
        )
        if depth < depth_limit and frontier.isEmpty():
            break
    rows = functools.reduce(DataFrame.unionByName, levels)
    paths = rows.where("kept").select(
        "query_id",
        "root",
        F.col("neighbour").alias("node"),
        F.concat("nodes", F.array("neighbour")).alias("nodes"),
        F.concat("relations", F.array("relation")).alias("relations"),
        F.concat("reversed", F.array("back")).alias("reversed"),
        "depth",
        "ord",
        "cycle",
    )
    diagnostics = rows.where("lost").select("query_id", F.col("last").alias("source"), "relation", "reference").distinct()
    short = rows.where("truncated").select("query_id").distinct().withColumn("truncated", F.lit(True))
    told = roots.select("query_id").distinct().join(short, "query_id", "left").select("query_id", F.coalesce("truncated", F.lit(False)).alias("truncated"))
    return Walks(paths, diagnostics, told)


def traverse(edges: DataFrame, roots: DataFrame, direction: str = "both", relations: tuple[str, ...] = (), max_depth: int = 2, fan_out: int = 12, max_results: int = 300) -> tuple[DataFrame, DataFrame]:
    """(paths, diagnostics) of ``bounded_walks``."""
    return bounded_walks(edges, roots, direction, relations, max_depth, fan_out, max_results)[:2]


def truncated(edges: DataFrame, nodes: DataFrame, direction: str, fan_out: int) -> DataFrame:
    """(node, truncated): whether a node has as many edges as the limit, so some may be missing."""
    near = adjacency(edges, direction, fan_out)
    return nodes.join(near.groupBy("node").agg(F.max("full").alias("truncated")), "node", "left").select("node", F.coalesce("truncated", F.lit(False)).alias("truncated"))


def insert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """``edges`` and those of ``new`` that aren't there yet; the first of equal ones stays."""
    key = [*EDGE_KEY, "ordinal_key"]
    both = edges.withColumn("turn", F.lit(0)).unionByName(new.withColumn("turn", F.lit(1))).withColumn("ordinal_key", F.coalesce("ordinal", F.lit(-1)))
    first = Window.partitionBy(*key).orderBy("turn", "created_at", "id")
    return both.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "turn", "ordinal_key")


def project_edges(edges: DataFrame, documents: DataFrame, declared: DataFrame, links: DataFrame, citations: DataFrame) -> DataFrame:
    """The edges after documents (memory_id) were put: their three producers' edges made anew."""
    producers = ["document", "markdown", "sources"]
    put = documents.select(F.col("memory_id").alias("src_memory_id")).distinct()
    old = edges.where(F.col("producer").isin(producers)).join(put, "src_memory_id", "left_semi").select("id")
    kept = edges.join(old, "id", "left_anti")
    for rows in (declared, links, citations):
        kept = kept.unionByName(rows, allowMissingColumns=True)
    return kept
