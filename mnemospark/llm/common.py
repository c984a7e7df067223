"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import glob
import os
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from mnemospark.plans import lineage

#: White space of the contracts' words ``[^\x20\x09-\x0D]+``.
WORD_BREAKS = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``, through Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release_memory() -> None:
    """Gives freed memory back to the system: a worker or driver keeps what it once took otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


@functools.cache
def one_thread() -> None:
    """Matrix products in this process take one thread: each core has a task of its own, and idle threads only spin."""
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), "..", "numpy.libs", "*openblas*")):
        try:
            library = ctypes.CDLL(path)
        except OSError:
            continue
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                return


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that driver and executors share, and read from there."""
    return lineage.cut(df)


def fold(id_column: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus`` (null for a null id)."""
    return F.crc32(id_column.cast("string")) % F.lit(modulus)


def held_out(id_column: Column, modulus: int, remainder: int) -> Column:
    """Whether the fold is ``remainder``; false for a null id (which is never learned from either)."""
    return F.coalesce(fold(id_column, modulus) == remainder, F.lit(False))


#: Of a sample of texts at most so many bytes are collected for each class or language, and no text over ``TEXT_BYTES``.
SAMPLE_BYTES, TEXT_BYTES = 24_000_000, 2_000_000


def bounded_texts(docs: DataFrame, picked: DataFrame, by: list[str], budget: int = SAMPLE_BYTES) -> DataFrame:
    """``picked`` (``by``, doc_id: a bounded number of ids) with one text of each id, within ``budget`` bytes for each ``by``.

    Of the texts of a repeated id the one with the least hash counts. Ids are taken in the order of their hash while
    their texts fit; a text of more than ``TEXT_BYTES`` isn't taken. Only sizes and hashes are put in order; whole
    texts move once, when they have been chosen.
    """
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    key = F.xxhash64("text")
    sized = texts.where(F.octet_length("text") <= TEXT_BYTES).join(F.broadcast(picked), "doc_id").select(*by, "doc_id", key.alias("text_key"), F.octet_length("text").alias("size"))
    one = sized.groupBy(*by, "doc_id").agg(F.min(F.struct("text_key", "size")).alias("t"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    running = F.sum("t.size").over((Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(*order))
    fits = one.withColumn("running", running).where(F.col("running") <= budget).select(*by, "doc_id", "t.text_key")
    # equal rows of an id are one; of two texts with one hash the lesser counts
    chosen = texts.join(F.broadcast(fits), "doc_id").where(key == F.col("text_key"))
    return chosen.groupBy(*by, "doc_id").agg(F.min("text").alias("text"))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, modulus: int, per_class: int
) -> tuple[list[tuple[str, int]], tuple[int, int]]:
    """At most ``per_class`` labelled texts of each class 0/1, picked by a hash of the id.

    Only rows whose fold (``fold(doc_id, modulus)``) is not 0 are used; null ids, labels
    and texts are skipped, repeated ids count once (a repeated label's larger value holds). The sample is a
    fixed function of the tables; its rows and bytes are bounded whatever their size.
    Beside it: how many usable labels of class 0 and of class 1 there are in all.
    """
    usable = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where((fold(F.col("doc_id"), modulus) != 0) & F.col("y").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = usable.where("y = 0").orderBy(*order).limit(per_class).unionByName(
        usable.where("y = 1").orderBy(*order).limit(per_class)
    )
    rows = bounded_texts(docs, picked, ["y"]).orderBy(*order).select("text", "y").collect()
    totals = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    return [(r["text"], int(r["y"])) for r in rows], (totals.get(0, 0), totals.get(1, 0))


#: Rows of a narrow table (an id, a hash, a mark) that may be broadcast once they have been counted: some 20 MB.
FEW = 200_000


def small(df: DataFrame) -> DataFrame:
    """``df`` (written already, narrow), marked for broadcast if it has at most ``FEW`` rows; else a join shuffles."""
    return F.broadcast(df) if df.count() <= FEW else df


def keep_one(docs: DataFrame, rows: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of ``docs`` for each (doc_id, text_key) of ``kept``; ``rows`` lists those of all rows.

    ``text_key`` is xxhash64 of the text; nulls are values. Documents move only if what is dropped is too much to broadcast;
    of equal documents a task keeps one before they move.
    """
    named = rows.groupBy("doc_id", "text_key").agg(F.count("*").alias("n"))
    own = kept.select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key"))
    same = named["doc_id"].eqNullSafe(own["kept_id"]) & (named["text_key"] == own["kept_key"])
    state = cut_lineage(named.join(own, same, "left").select(F.col("doc_id").alias("told_id"), F.col("text_key").alias("told_key"), F.col("kept_key").isNotNull().alias("stays"), "n").where("not stays or n > 1"))
    gone, repeated = small(state.where("not stays")), small(state.where("stays"))
    wrapped = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("record"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"))

    def at(told: DataFrame):
        return wrapped["id"].eqNullSafe(told["told_id"]) & (wrapped["key"] == told["told_key"])

    left = wrapped.join(gone, at(gone), "left_anti")
    once = left.join(repeated, at(repeated), "left_anti")
    one = left.join(repeated, at(repeated), "left_semi").dropDuplicates(["id", "key"])
    return once.unionByName(one).select("record.*")


def append_columns(
    df: DataFrame,
    text: str,
    keep: list[str],
    new: list[tuple[str, T.DataType]],
    make: Callable[[], Callable[[list[str | None]], list[Any]]],
) -> DataFrame:
    """``df`` narrowed to ``keep`` plus the columns ``new``, computed from the column ``text``.

    A column of ``keep`` that is named like a new one (in any case) is replaced by it.

    ``make`` runs once in each Python task and returns the function from a list of whole
    texts to one sequence for each new column. Rows stream through in Arrow batches; memory
    is bounded by a batch, whatever the partition holds.
    """
    made = {n.lower() for n, _ in new}
    keep = [c for c in keep if c.lower() not in made]
    columns = list(dict.fromkeys([*keep, text]))
    fields = [df.schema[c] for c in keep] + [T.StructField(n, t, True) for n, t in new]
    types = [{"double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}[t.simpleString()] for _, t in new]
    names = [n for n, _ in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        compute = make()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                got = compute(part.column(columns.index(text)).to_pylist())
                arrays = [part.column(columns.index(c)) for c in keep]
                arrays += [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(got, types)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *names])
        del compute
        release_memory()

    return df.select(*columns).mapInArrow(run, T.StructType(fields))


class Adam:
    """Adam over a dict of arrays, updated in place."""

    def __init__(self, params: dict[str, np.ndarray], rate: float = 1e-2) -> None:
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            m, v = self.m[k], self.v[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            self.params[k] -= (scale * m / (np.sqrt(v) + 1e-8)).astype(self.params[k].dtype)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5
