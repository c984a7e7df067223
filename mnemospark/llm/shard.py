"""Sharding by a two-pass external shuffle, in DataFrame operations only.

Pass one scatters whole records into buckets of about ``BUCKET_BYTES``: the bucket is a
seeded hash of the record, so the result doesn't depend on files, splits or order. Equal records are equal
anyway; those that occur over ``REPEATS`` times are scattered by their place too, so no bucket depends on the
data's skew. Pass two shuffles each bucket by itself: ``shuffle`` of an array is a seeded Fisher-Yates. Records keep the
order of buckets, then of places in the bucket; that place in the whole, modulo the number of shards, is the
shard, and divided by it the slot. So shard sizes differ by one record at most (law ``rows``)
and slots run from 0 without gaps.

Buckets' offsets are sums of bucket counts, taken in two levels so that no task sees all
buckets. The only wide step for records is the scatter, into one partition for each bucket, or from ``PARTITIONS``
on into partitions of up to ``PARTITION_BYTES``, in which a task gathers one bucket after the other.

Nulls in any column are records like others; a null text has size 1. A long text is a record of its own size, in a bucket
like others. Ties, that is equal hashes of different records, stay in the order of the records' second hash. An empty table
gives no rows. Columns of ``df`` named like the new ones are replaced. Columns can be of any type that can be hashed (not maps).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from mnemospark.llm.common import cut_lineage

BUCKET_BYTES, PARTITION_BYTES, PARTITIONS = 8 << 20, 1 << 30, 4096
#: Records that occur more often, and are more than such a part of all, are scattered by their place in the input too.
REPEATS, REPEATED_KINDS = 1000, 10_000
#: Buckets whose counts are summed in one task before the groups' sums are.
GROUP = 1024


def text_size(text: str = "text") -> Column:
    """UTF-8 bytes of a text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def offsets(counts: DataFrame) -> DataFrame:
    """(bucket, offset): how many records the buckets before each hold, from (bucket, n)."""
    before = (Window.unboundedPreceding, -1)
    inner = Window.partitionBy("g").orderBy("bucket").rowsBetween(*before)
    grouped = counts.withColumn("g", (F.col("bucket") / GROUP).cast("long"))
    sums = grouped.groupBy("g").agg(F.sum("n").alias("n"))
    # one row for each GROUP buckets of BUCKET_BYTES: some hundred rows for a terabyte
    ahead = sums.select(F.col("g").alias("h"), F.coalesce(F.sum("n").over(Window.orderBy("g").rowsBetween(*before)), F.lit(0)).alias("ahead"))
    own = grouped.select("bucket", "g", F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("own"))
    return own.join(ahead, own["g"] == ahead["h"]).select("bucket", (F.col("own") + F.col("ahead")).alias("offset"))


def shuffle_shards(df: DataFrame, shards: int, id_column: str, size: Column, seed: int = 1, bucket_bytes: int = BUCKET_BYTES, stable: bool = True) -> DataFrame:
    """The records of ``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (0, 1, ... in each shard).

    ``stable`` says that ``df`` gives the same rows when it is read again, as any table scan does; else its lineage is cut first.
    """
    if shards < 1:
        raise ValueError("there must be one shard at least")
    if not stable:
        df = cut_lineage(df)
    columns = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    fields = [F.col(f"`{c}`") for c in columns]
    drawn = df.select(F.struct(*fields).alias("record"), F.xxhash64(F.lit(seed), F.col(id_column), *fields).alias("own"), F.hash(F.lit(seed), *fields).alias("second"), size.alias("size"))
    kinds = drawn.groupBy("own").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    told = kinds.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    total, records = int(told["s"] or 0), int(told["n"] or 0)
    buckets = max(1, -(-total // bucket_bytes))
    partitions = min(buckets, max(PARTITIONS, total // PARTITION_BYTES))
    # at most REPEATED_KINDS kinds can occur so often, so they may be broadcast
    often = kinds.where(F.col("n") > max(REPEATS, records // REPEATED_KINDS)).select("own", F.lit(True).alias("often"))
    place = F.when(F.col("often"), F.monotonically_increasing_id()).otherwise(0)
    spread = drawn.join(F.broadcast(often), "own", "left").select("record", "second", F.xxhash64("own", place).alias("draw"))
    scattered = spread.withColumn("bucket", F.pmod("draw", F.lit(buckets)))
    counts = scattered.groupBy("bucket").agg(F.count("*").alias("n"))
    gathered = scattered.repartition(partitions, "bucket").groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("draw", "second", "record"))).alias("records"))
    # buckets in a fixed order within a task, so a repeated task draws the same numbers again
    ordered = gathered.join(offsets(counts), "bucket").sortWithinPartitions("bucket")
    shuffled = ordered.select("offset", F.shuffle(F.col("records"), seed).alias("records"))
    flat = shuffled.select("offset", F.posexplode("records").alias("at", "r"))
    index = F.col("offset") + F.col("at")
    return flat.select("r.record", (index % shards).cast("int").alias("shard"), F.floor(index / shards).cast("long").alias("slot")).select("record.*", "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes the records of ``shuffle_shards`` as Parquet, one folder for each shard."""
    sharded.write.partitionBy("shard").parquet(path)
