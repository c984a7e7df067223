"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints are 64-bit SimHashes of word shingles; two link when they differ in at
most ``radius`` bits; a component is everything reachable over links.

Search: the 64 bits are grouped into partitions, correlated bits together. If partition i is
given a threshold T_i >= -1 and the sum of T_i + 1 is radius + 1, any linked pair agrees
within T_i bits on some partition i. A dynamic programme allocates the thresholds (they may
be unequal; -1 leaves a partition unused) so that the estimated number of probes and
candidates is least; so the number of partitions follows the number of fingerprints too.
Each fingerprint is indexed under its bits of each partition, probes all values within T_i,
and candidates are verified on all 64 bits inside the join, which returns linked pairs only.
A fingerprint has at most 2,080 others within two bits, so links stay linear in
fingerprints; equal fingerprints are one before the search. Keys that hold many fingerprints
are split exactly: outside the partition a linked pair again agrees on one of radius + 1 groups
of the remaining bits, so those keys are extended by each group in turn.

With ``similarity`` given, texts link by the Jaccard similarity of their shingle sets instead: pairs that the search
finds are candidates, verified on the sets. Texts that alike may differ in up to twenty of 64 bits, farther than a
pigeonhole search can reach, so ``resemblance`` finds the others exactly; no linked pair is lost.

Null, empty and wordless texts have fingerprint zero and link like any other (by similarity: to each other only);
texts of fewer words than a shingle are one shingle; long texts are read whole. Null ids keep their row; a component's
id is the smallest non-null doc_id in it (null if there is none). Repeated rows are kept as they are by
``near_duplicates``. Ties can't occur: components don't depend on any order. An empty table gives no rows.
Columns of other names are not read, and ``drop_near_duplicates`` returns them as they are.
"""

from __future__ import annotations

import itertools
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemospark.llm import resemblance
from mnemospark.llm import shingles as pieces
from mnemospark.llm.common import append_columns, cut_lineage, keep_one
from mnemospark.llm.components import components, name_components
from mnemospark.llm.shingles import BITS

RADIUS, SHINGLE = 2, 3
#: The plan of the search is fitted on at most so many distinct fingerprints.
PLAN_SAMPLE = 4000
#: Keys with more fingerprints than this are extended by further bits.
DENSE = 256
#: Cost of making and moving a probe, in candidate comparisons.
PROBE_COST = 30.0


def fingerprints(texts: list[str | None], shingle: int = SHINGLE) -> np.ndarray:
    """The 64-bit fingerprints (unsigned) of whole texts."""
    out = np.zeros(len(texts), np.uint64)
    for at in range(0, len(texts), 64):  # hashes of a few texts at a time
        out[at : at + 64] = pieces.fingerprints([pieces.hashes(t, shingle) for t in texts[at : at + 64]])
    return out


def add_fingerprint(docs: DataFrame, keep: list[str], name: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """``keep`` and each row's fingerprint as a signed long."""
    make = lambda: lambda texts: [pa.array(fingerprints(texts, shingle).view(np.int64))]
    return append_columns(docs, "text", keep, [(name, T.LongType())], make)


# --- the plan of the search -------------------------------------------------------------


def correlated_groups(bits: np.ndarray, count: int) -> list[list[int]]:
    """Positions 0..63 in ``count`` groups of nearly equal width, each grown by the most correlated bit."""
    with np.errstate(divide="ignore", invalid="ignore"):
        corr = np.nan_to_num(np.abs(np.corrcoef(bits.T))) if len(bits) > 2 else np.eye(BITS)
    free, groups = list(range(BITS)), []
    for g in range(count):
        width = BITS // count + (g < BITS % count)
        pair = max(itertools.combinations(free, 2), key=lambda ab: corr[ab], default=None) if width > 1 else None
        group = list(pair) if pair else [free[0]]
        while len(group) < width:
            rest = [b for b in free if b not in group]
            group.append(max(rest, key=lambda b: corr[b, group].sum()))
        groups.append(sorted(group))
        free = [b for b in free if b not in group]
    return groups


def ball(width: int, radius: int) -> int:
    """How many values lie within ``radius`` of one of ``width`` bits."""
    total, term = 0, 1
    for k in range(radius + 1):
        total, term = total + term, term * (width - k) // (k + 1)
    return total


def within(bits: np.ndarray, group: list[int], radius: int) -> float:
    """The estimated share of fingerprint pairs that agree within ``radius`` bits on a group.

    The larger of the share among sampled pairs and of what the bits' own frequencies give.
    """
    p = bits[:, group].mean(axis=0)
    differ = np.clip(2 * p * (1 - p), 1e-6, 0.5)
    dist = np.zeros(radius + 1)
    dist[0] = 1
    for q in differ:
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    some = bits[:800, group].astype(np.float32)
    apart = some @ (1 - some.T) + (1 - some) @ some.T
    n = len(some)
    seen = ((apart <= radius + 0.5).sum() - n) / (n * (n - 1)) if n > 1 else 0.0
    return max(float(dist.sum()), float(seen))


def search_plan(sample: np.ndarray, total: int, radius: int = RADIUS) -> list[tuple[int, int]]:
    """(mask, threshold) for each partition that is probed, by the least estimated cost."""
    if not len(sample):
        return [(2**BITS - 1, radius)]
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    best: tuple[float, list[tuple[int, int]]] = (float("inf"), [])
    for count in (1, 2, 3, 4):
        groups = correlated_groups(bits, count)
        # least[k]: the cheapest way to spend k of radius + 1 on the groups so far
        least: list[tuple[float, list[int]]] = [(0.0, [])] + [(float("inf"), [])] * (radius + 1)
        for group in groups:
            cost = [0.0] + [total * (ball(len(group), t) * PROBE_COST + total * within(bits, group, t)) for t in range(radius + 1)]
            least = [min(((least[k - s][0] + cost[s], [*least[k - s][1], s - 1]) for s in range(k + 1)), key=lambda x: x[0]) for k in range(radius + 2)]
        if least[-1][0] < best[0]:
            best = (least[-1][0], [(sum(1 << b for b in g), t) for g, t in zip(groups, least[-1][1]) if t >= 0])
    return best[1]


def signed(x: int) -> int:
    return x - 2**BITS if x >= 2 ** (BITS - 1) else x


def masks_within(mask: int, radius: int) -> list[int]:
    """Every way to flip up to ``radius`` of the mask's bits."""
    ones = [1 << b for b in range(BITS) if mask >> b & 1]
    return [signed(sum(c)) for k in range(radius + 1) for c in itertools.combinations(ones, k)]


def rest_groups(mask: int, radius: int = RADIUS) -> list[int]:
    """The bits outside ``mask`` in radius + 1 groups: a linked pair agrees on one of them."""
    rest = [b for b in range(BITS) if not mask >> b & 1]
    return [signed(sum(1 << b for b in rest[k :: radius + 1])) for k in range(radius + 1)]


# --- links and components ---------------------------------------------------------------


def links(prints: DataFrame, plan: list[tuple[int, int]], radius: int = RADIUS) -> DataFrame:
    """Pairs (a < b) of the distinct fingerprints ``prints.fp`` within ``radius`` bits."""

    def flip(key: Column):
        return lambda m: key.bitwiseXOR(m)

    def keyed(flips: bool) -> DataFrame:
        out = []
        for k, (mask, threshold) in enumerate(plan):
            key: Column = F.col("fp").bitwiseAND(F.lit(signed(mask)))
            if flips and threshold:
                masks = F.array(*map(F.lit, masks_within(mask, threshold)))
                key = F.explode(F.transform(masks, flip(key)))
            out.append(prints.select("fp", F.lit(k).alias("part"), key.alias("key")))
        return out[0] if len(out) == 1 else union_all(out)

    index, probe = keyed(False), keyed(True)
    dense = index.groupBy("part", "key").count().where(F.col("count") > DENSE).select("part", "key", F.lit(True).alias("dense"))

    def extended(rows: DataFrame) -> DataFrame:
        """Each row once, or, under a dense key, once for each group of the remaining bits."""
        groups = F.lit(None)
        for k, (mask, _) in enumerate(plan):
            groups = F.when(F.col("part") == k, F.array(*(F.struct(F.lit(g).alias("g"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for g, m in enumerate(rest_groups(mask, radius))))).otherwise(groups)
        whole = F.array(F.struct(F.lit(-1).alias("g"), F.lit(0).cast("long").alias("v")))
        return (
            rows.join(dense, ["part", "key"], "left")
            .select("fp", "part", "key", F.explode(F.when(F.col("dense"), groups).otherwise(whole)).alias("e"))
            .select("fp", "part", "key", "e.g", "e.v")
        )

    a, b = extended(probe).withColumnRenamed("fp", "a"), extended(index).withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    symmetric = all(t == 0 for _, t in plan)
    apart = F.col("a") < F.col("b") if symmetric else F.col("a") != F.col("b")
    cond = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("part", "key", "g", "v")]
    found = a.alias("x").join(b.alias("y"), [*cond, near & apart]).select("a", "b")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def linked_fingerprints(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Linked pairs (a < b) of the distinct fingerprints ``prints.fp``, by a plan fitted on a sample of them."""
    sample = prints.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(PLAN_SAMPLE).collect()
    plan = search_plan(np.array([r["fp"] for r in sample], np.int64).view(np.uint64), prints.count(), radius)
    return links(prints.select("fp"), plan, radius)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, similarity: Fraction | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs`` (doc_id, text); links by bits or, if given, by similarity."""
    if similarity is not None:
        common = resemblance.common_shingles(docs, shingle)
        rows = cut_lineage(resemblance.describe(docs, common, shingle, similarity))
        sets = cut_lineage(rows.groupBy("node").agg(*(F.min(c).alias(c) for c in ("size", "prefix", "text_key", "fp"))))
        # sets of one fingerprint are candidates by the least of them, and so are those of linked ones
        prints = cut_lineage(sets.groupBy("fp").agg(F.min("node").alias("node")))
        one, other = prints.select(F.col("fp").alias("a"), F.col("node").alias("x")), prints.select(F.col("fp").alias("b"), F.col("node").alias("y"))
        near = linked_fingerprints(prints, radius).join(one, "a").join(other, "b").select("x", "y")
        same = sets.select("fp", F.col("node").alias("y")).join(prints.select("fp", F.col("node").alias("x")), "fp").where("x <> y").select("x", "y")
        candidates = near.unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        roots = components(resemblance.links(docs, sets, common, shingle, similarity, candidates))
        return name_components(rows.select("doc_id", "text_key", "node", "fp"), "node", roots)
    rows = cut_lineage(add_fingerprint(docs.withColumn("text_key", F.xxhash64("text")), ["doc_id", "text_key"], "fp", shingle))
    roots = components(linked_fingerprints(rows.select("fp").distinct(), radius))
    return name_components(rows, "fp", roots)


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, similarity: Fraction | None = None) -> DataFrame:
    """One document, with its columns, of each component: the one with the smallest id (a null id is the largest).

    Documents are told apart by doc_id and text, null being a value too, so one row stays of any number of equal
    ones, and of two different texts under one id only those stay that are least in their component.
    """
    found = cut_lineage(near_duplicates(docs.select("doc_id", "text"), shingle, radius, similarity))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("first")
    # where a component has no id at all, its node is its name
    told = found.withColumn("node", F.when(F.col("component_id").isNull(), F.col("node" if similarity is not None else "fp")))
    kept = told.groupBy("component_id", "node").agg(first).select(F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key"))
    return keep_one(docs, found.select("doc_id", "text_key"), kept.distinct())
