"""Links by resemblance: the exact Jaccard similarity of shingle sets.

Two sets link when their Jaccard similarity is ``similarity`` or more. Equal sets are one node before the search.

Search: with the shingles of all sets in one global order, sets that alike share a shingle
among the first ``size - ceil(similarity * size) + 1`` of each (the prefix filter), so no
linked pair is missed. Shingles that tasks met often come last in the order, so prefixes hold
rare ones; what order it is changes the work, never the links. Each prefix shingle that may stand in two prefixes (a count by cells tells) is a key.
First every set is verified against one set under each of its keys, that with the fewest rarer shingles, and against the caller's candidates, which
is linear and joins large groups of copies; then pairs not yet connected are verified if a key that both have may be
the first they share: from its places on, each set has as many shingles left as alike sets of their sizes share. Every alike
pair passes that test at its first shared key, while sets that share only a passage at the end of their
orders fail it. So the links' components are those of all linked pairs, though pairs within a component need not all be listed.

Pairs are verified in two steps. Sketches of the sets, some bits a shingle, bound from above what two sets can share and drop most
pairs; whole sets move for the others only, which are verified exactly. The bound holds for any sets, so no linked pair is dropped.

Shingles are compared by 64-bit hashes and sets by a hash of their shingles. Null, empty and
wordless texts are one empty set, alike to each other only; fewer words than a shingle are one
shingle. Long texts are read whole. Repeated rows are one node. An empty table has no links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemospark.llm import cells
from mnemospark.llm import shingles as pieces
from mnemospark.llm.common import append_columns, cut_lineage, release_memory
from mnemospark.llm.components import HOT, HOT_KEYS, components, join_spread

#: Shingles met so often among ``FLUSH`` of a task are told as common, at most so many of them.
OFTEN, COMMON, FLUSH = 3, 100_000, 2_000_000
#: Bits of the filter that keeps unwanted sets from being moved; a wrong hit is dropped by the join.
SPOTS = 2**26
#: Keys are counted in 2^CELL_BITS cells before they are moved.
CELL_BITS = 27
#: Bits of a set's sketch for each of its shingles, at least.
SKETCH = 4


def digest_of(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), pieces.SEED)).view(np.int64))


def least_overlap(size: int, similarity: Fraction) -> int:
    """The fewest shingles that a set of ``size`` shares with any set alike to it."""
    return -(-size * similarity.numerator // similarity.denominator)


def common_shingles(docs: DataFrame, shingle: int) -> np.ndarray:
    """Hashes of the shingles that tasks met often, the rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        waiting = 0

        def flush() -> pa.RecordBatch:
            met, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]), return_counts=True)
            parts.clear()
            often = times >= OFTEN
            return pa.RecordBatch.from_arrays([pa.array(met[often].view(np.int64)), pa.array(times[often].astype(np.int64))], names=["s", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                parts.append(pieces.hashes(text, shingle))
                waiting += len(parts[-1])
                if waiting > FLUSH:
                    yield flush()
                    waiting = 0
        yield flush()
        release_memory()

    found = docs.select("text").mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    return found.orderBy(F.desc("n"), "s").limit(COMMON).select("s").toArrow().column(0).to_numpy()[::-1].astype(np.int64)


def describe(docs: DataFrame, common: np.ndarray, shingle: int, similarity: Fraction) -> DataFrame:
    """doc_id, text_key (hash of the text), fp (SimHash), node (the set's hash), its size, and its prefix in the global order."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def make():
        common = shared.value
        order = np.argsort(common)
        known = common[order]

        def compute(texts: list[str | None]) -> list:
            fps, nodes, sizes, prefixes = [], [], [], []
            for at in range(0, len(texts), 64):
                hashed = [pieces.hashes(t, shingle) for t in texts[at : at + 64]]
                fps += pieces.fingerprints(hashed).view(np.int64).tolist()
                for h in hashed:
                    s = np.unique(h).view(np.int64)
                    nodes.append(digest_of(s))
                    sizes.append(len(s))
                    if len(s) and len(known):
                        place = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        s = s[np.argsort(np.where(known[place] == s, order[place], -1), kind="stable")]
                    prefixes.append(s[: len(s) - least_overlap(len(s), similarity) + 1].astype("<i8").tobytes() if len(s) else b"")
            return [fps, nodes, sizes, prefixes]

        return compute

    new = [("fp", T.LongType()), ("node", T.LongType()), ("size", T.LongType()), ("prefix", T.BinaryType())]
    return append_columns(docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")), "text", ["doc_id", "text_key"], new, make)


def sketch_of(shingles: np.ndarray) -> bytes:
    """A set's sketch: one bit for each value of its shingles' low bits, of which there are ``SKETCH`` a shingle at least."""
    size = 1 << max(6, (SKETCH * len(shingles) - 1).bit_length())
    out = np.zeros(size, bool)
    out[shingles & (size - 1)] = True
    return np.packbits(out, bitorder="little").tobytes()


def most_shared(x: bytes, n: int, y: bytes, m: int) -> int:
    """The most shingles that sets of ``n`` and ``m`` with sketches ``x`` and ``y`` can share: a bit that one sketch lacks is at least one shingle that its set lacks."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    size = min(len(a), len(b))
    a, b = (np.bitwise_or.reduce(k.reshape(-1, size), axis=0) for k in (a, b))
    return min(n - int(np.bitwise_count(a & ~b).sum()), m - int(np.bitwise_count(b & ~a).sum()))


def with_blobs(docs: DataFrame, pairs: DataFrame, sets: DataFrame, shingle: int, blob: Callable[[np.ndarray], bytes]) -> DataFrame:
    """The pairs (a, b) with ``size`` and ``blob`` of both ends' sets: na, sa, nb, sb."""
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = cut_lineage(asked.join(sets.select("node", "text_key"), "node").select("text_key").distinct())
    spot = F.col("text_key").bitwiseAND(F.lit(SPOTS - 1)) + 1
    maps = wanted.groupBy(F.bitmap_bucket_number(spot).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("m")).collect()
    spots = np.zeros(SPOTS // 8, np.uint8)
    for r in maps:
        spots[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(r["m"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(spots)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Size and blob of the sets of texts that are wanted (and of a few that only look so)."""
        bits, seen = shared.value, set()
        for batch in batches:
            keys = batch.column(0).to_numpy()
            at = keys & (SPOTS - 1)
            hit = np.flatnonzero(bits[at >> 3] >> (at & 7) & 1)
            # copies of a text are one in each task
            hit = np.array([k for k in hit.tolist() if keys[k] not in seen and not seen.add(int(keys[k]))], np.int64)
            for k in range(0, len(hit), 256):
                part = hit[k : k + 256]
                own = [np.unique(pieces.hashes(t, shingle)).view(np.int64) for t in batch.column(1).take(pa.array(part)).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([digest_of(x) for x in own], pa.int64()), pa.array([len(x) for x in own], pa.int64()), pa.array([blob(x) for x in own], pa.binary())], names=["node", "size", "blob"])
                del own
        release_memory()

    found = docs.select(F.xxhash64("text").alias("text_key"), "text").mapInArrow(pick, "node long, size long, blob binary")
    own = cut_lineage(found.groupBy("node").agg(F.min("size").alias("size"), F.min("blob").alias("blob")))
    shared.destroy()
    del spots, maps
    release_memory()
    total = pairs.count()

    def with_sets(rows: DataFrame, end: str, other: str) -> DataFrame:
        """The rows with the blobs of one end; one that many pairs have goes to several tasks."""
        per = pairs.groupBy(end).agg(F.count("*").alias("n"))
        told = per.join(own.select(F.col("node").alias(end), F.col("size").alias(f"n{end}"), F.col("blob").alias(f"s{end}")), end)
        return join_spread(rows, told, end, total, F.col(other))

    return with_sets(with_sets(pairs, "a", "b"), "b", "a").select("a", "b", "na", "sa", "nb", "sb")


def verified(docs: DataFrame, pairs: DataFrame, sets: DataFrame, shingle: int, similarity: Fraction) -> DataFrame:
    """Those of the pairs (a, b) of sets that are alike.

    Sketches tell first which pairs can be; whole sets move for those only.
    """

    def told(shared_by: Callable[[bytes, int, bytes, int], int]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for n, x, m, y in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5))):
                    shared = shared_by(x, n, y, m)
                    keep.append(shared * similarity.denominator >= similarity.numerator * (n + m - shared))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
            release_memory()

        return run

    def exactly(x: bytes, n: int, y: bytes, m: int) -> int:
        return len(np.intersect1d(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), assume_unique=True))

    likely = cut_lineage(with_blobs(docs, pairs, sets, shingle, sketch_of).mapInArrow(told(most_shared), "a long, b long"))
    return cut_lineage(with_blobs(docs, likely, sets, shingle, np.ndarray.tobytes).mapInArrow(told(exactly), "a long, b long"))


def keys_of_several(sets: DataFrame) -> np.ndarray:
    """One bit for each cell of keys: whether two sets have a key of it in their prefixes. Most shingles are in one set, and needn't move."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        waiting = 0
        for batch in batches:
            for prefix in batch.column(0):
                parts.append(np.frombuffer(prefix.as_buffer(), np.uint64))
                waiting += len(parts[-1])
                if waiting > FLUSH // 4:
                    met, times = np.unique(cells.mixed(np.concatenate(parts)), return_counts=True)
                    parts, waiting = [], 0
                    yield from cells.batches(met, times, CELL_BITS, 2)
        if waiting:
            met, times = np.unique(cells.mixed(np.concatenate(parts)), return_counts=True)
            yield from cells.batches(met, times, CELL_BITS, 2)
        release_memory()

    return cells.often(sets.select("prefix").mapInArrow(counted, "range int, cells binary"), CELL_BITS, 2)


def links(docs: DataFrame, sets: DataFrame, common: np.ndarray, shingle: int, similarity: Fraction, candidates: DataFrame) -> DataFrame:
    """Pairs (a, b) of alike sets that connect all that are alike.

    ``sets`` is (node, size, prefix, text_key), each node once; ``candidates`` (a < b) are pairs likely to be alike;
    ``common`` are the shingles that tasks met often.
    """
    spark = docs.sparkSession
    shared_common = spark.sparkContext.broadcast(np.sort(common))
    shared_may = spark.sparkContext.broadcast(keys_of_several(sets))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, node, size, often, place) for each shingle of a prefix that may be in another's too."""
        known, may = shared_common.value, shared_may.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                blobs = batch.column(2).to_pylist()
                per = np.array([len(b) // 8 for b in blobs], np.int64)
                if not per.sum():
                    continue
                keys = np.frombuffer(b"".join(blobs), "<i8")
                node, size = (np.repeat(batch.column(k).to_numpy(), per) for k in (0, 1))
                place = np.arange(len(keys)) - np.repeat(np.cumsum(per) - per, per)
                several = cells.told(may, cells.mixed(keys.view(np.uint64)), CELL_BITS)
                keys, node, size, place = keys[several], node[several], size[several], place[several]
                often = known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys if len(known) else np.zeros(len(keys), bool)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(node), pa.array(size), pa.array(often), pa.array(place)], names=["key", "node", "size", "often", "place"])
        release_memory()

    postings = cut_lineage(sets.select("node", "size", "prefix").mapInArrow(spread, "key long, node long, size long, often boolean, place long"))
    total = sets.agg(F.sum(F.octet_length("prefix")).alias("n")).first()["n"] or 0
    # a key in so many sets is among those that tasks met often; at most HOT_KEYS of them, so they may be broadcast,
    # and no task takes all sets of one
    bound = max(HOT, total // 8 // HOT_KEYS)
    # the set with the fewest rarer shingles of its own stands nearest to the others under a key
    hub = F.min_by(F.struct("node", "size"), F.struct("place", "node"))
    hot = cut_lineage(postings.where("often").groupBy("key").agg(F.count("*").alias("n"), hub.alias("hub")).where(F.col("n") > bound).select("key", "hub"))
    under = Window.partitionBy("key")
    cold = postings.join(F.broadcast(hot.select("key")), "key", "left_anti")
    told = cold.withColumn("n", F.count("*").over(under)).withColumn("hub", hub.over(under)).where("n > 1")
    columns = ["key", "node", "size", "place", "hub"]
    shared = cut_lineage(told.select(*columns).unionByName(postings.join(F.broadcast(hot), "key").select(*columns)))
    p, q = similarity.numerator, similarity.denominator

    def fits(x, y):
        return (x * q >= y * p) & (y * q >= x * p)

    def met(rows: DataFrame) -> DataFrame:
        """Pairs of the rows' sets ``own`` and ``hub`` that share as many keys as alike sets must."""
        a, b = F.least("own", "hub"), F.greatest("own", "hub")
        counted = rows.select(a.alias("a"), b.alias("b")).groupBy("a", "b").count()
        least = [F.ceil(F.col(f"{k}.size") * p / q) for k in "ab"]
        overlap = F.ceil((F.col("a.size") + F.col("b.size")) * p / (p + q))
        return counted.where(F.col("count") >= overlap + 1 - F.greatest(*least)).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))

    first = shared.withColumn("own", F.struct("node", "size")).where((F.col("node") != F.col("hub.node")) & fits(F.col("size"), F.col("hub.size")))
    near = verified(docs, cut_lineage(met(first).unionByName(candidates).distinct()), sets, shingle, similarity)
    rooted = cut_lineage(shared.select("key", "node", "size", "place").join(components(near), "node", "left").withColumn("root", F.coalesce("root", "node")))
    # a key whose sets are all connected has nothing left to find
    open_ = rooted.groupBy("key").agg(F.min("root").alias("l"), F.max("root").alias("h"), F.count("*").alias("n")).where("l < h").select("key", "n")
    left = cut_lineage(join_spread(rooted, open_, "key", rooted.count(), F.col("node")))
    cond = (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root"))
    reach = F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place"))
    cond &= fits(F.col("x.size"), F.col("y.size")) & (reach * (p + q) >= (F.col("x.size") + F.col("y.size")) * p)
    found = cut_lineage(left.alias("x").join(left.alias("y"), cond).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())
    return near.unionByName(verified(docs, found, sets, shingle, similarity)) if found.limit(1).count() else near
