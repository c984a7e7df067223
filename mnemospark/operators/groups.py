"""Connected groups of pairs, by label spreading in joins; nothing is collected but a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.plans.lineage import cut


def connected(pairs: DataFrame) -> DataFrame:
    """(node, root) for each node of ``pairs`` (a, b); root is the least node of its group.

    Every round a node takes the least label around it, then its label's label, until no label
    moves; the number of rounds grows with the logarithm of a group's width. Rounds are cut to the shared folder.
    """
    both = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    moved = 1
    while moved:
        around = both.join(labels, both["b"] == labels["node"]).groupBy(both["a"].alias("n")).agg(F.min("root").alias("m"))
        near = labels.join(around, labels["node"] == around["n"]).select("node", F.least("root", "m").alias("root"), F.col("root").alias("old"))
        above = near.select(F.col("node").alias("up"), F.col("root").alias("up_root"))
        jumped = cut(near.join(above, near["root"] == above["up"]).select("node", F.least("root", "up_root").alias("root"), "old"))
        moved = jumped.where("root <> old").limit(1).count()
        labels = jumped.select("node", "root")
    return labels
