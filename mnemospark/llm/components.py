"""Connected components, and joins with a table of one row a key in which a key may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import cut_lineage

#: A key with more rows than this, and more than a ``HOT_KEYS``-th of all, is split: so at most ``HOT_KEYS`` keys are.
HOT, HOT_KEYS = 512, 1000
#: From so many edges on, the rounds that look for components split hot nodes; fewer are a moment's work for one task.
SPLIT_EDGES = 200_000


def join_spread(rows: DataFrame, told: DataFrame, key: str, total: int, by: Column) -> DataFrame:
    """``rows`` with the columns of ``told`` (one row a key; ``n``: how many of the ``total`` rows have it).

    Rows of a hot key are dealt by the hash of ``by`` over as many copies of its row in ``told`` as it has ``HOT`` rows
    (at this size; a ``HOT_KEYS``-th of all rows at a larger one), so no task gets them all. The hot keys that are broadcast are ``HOT_KEYS`` at most.
    """
    bound = max(HOT, -(-total // HOT_KEYS))
    if total <= bound:  # not even one key can be hot
        return rows.join(told.drop("n"), key)
    pieces = F.ceil(F.col("n") / bound).cast("int")
    hot = told.where(F.col("n") > bound).select(key, pieces.alias("_pieces"))
    salt = F.coalesce(F.pmod(F.xxhash64(by), F.col("_pieces")), F.lit(0)).cast("int")
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", salt).drop("_pieces")
    copies = told.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(pieces, F.lit(1)) - 1))).drop("n")
    return dealt.join(copies, [key, "_salt"]).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b), root the least node it reaches.

    Alternates large stars (greater neighbours go to the least one) and small stars (lesser
    neighbours too), each cut to the shared folder, until nothing changes; the number of
    rounds is logarithmic, and nothing is collected but a count and a checksum. The neighbours of a node
    that most others point to are spread over many tasks.
    """

    def star(e: DataFrame, large: bool, total: int) -> DataFrame:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        joined = join_spread(both, least, "a", 2 * total, F.col("b")) if total > SPLIT_EDGES else both.join(least.drop("n"), "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a != b").distinct()

    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    now = cut_lineage(edges)
    before, after = None, state(now)
    while after != before and after[0]:
        before = after
        now = cut_lineage(star(star(now, True, before[0]), False, before[0]))
        after = state(now)
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())


def name_components(rows: DataFrame, node: str, roots: DataFrame) -> DataFrame:
    """``rows`` (doc_id and ``node``) with component_id: the least doc_id of the component of the row's node.

    ``roots`` is (node, root) of the nodes that have links. A null doc_id is least only where a component has no other.
    """
    total = rows.count()
    nodes = rows.groupBy(node).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    rooted = nodes.join(roots.withColumnRenamed("node", node), node, "left").withColumn("root", F.coalesce("root", node))
    # only components of several nodes need their least id gathered
    several = cut_lineage(rooted.where(F.col("root") != F.col(node)).select("root").distinct())
    members = rooted.join(several, "root", "left_semi")
    least = members.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n"))
    linked = join_spread(members.select("root", node, F.col("n").alias("rows")), least, "root", total, F.col(node)).select(node, "component_id", F.col("rows").alias("n"))
    alone = rooted.join(several, "root", "left_anti").select(node, F.col("first_id").alias("component_id"), "n")
    return join_spread(rows, linked.unionByName(alone), node, total, F.xxhash64(*rows.columns))
