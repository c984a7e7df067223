"""Cosine similarity and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.operators.lexical import top_k

#: Query vectors held against the corpus at a time.
QUERY_BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of one length; 0 if either has no length, null if lengths differ."""
    n = norm(a) * norm(b)
    return F.when(F.size(a) != F.size(b), F.lit(None).cast("double")).when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def vectors_of(memories: DataFrame) -> DataFrame:
    return memories.where(F.col("superseded_by").isNull() & F.col("embedding").isNotNull()).select("id", "embedding")


def knn(corpus: DataFrame, queries: DataFrame, limit: int, id_column: str = "id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank): exact nearest neighbours of a stated set of queries.

    Queries (query_id, embedding) go to the corpus in blocks of ``QUERY_BLOCK``; every task keeps
    its own best ``limit`` of each query by matrix products, so what moves is bounded by
    tasks x queries x limit. Vectors of another length than a query's don't match it.
    """
    id_type = corpus.schema[id_column].dataType.simpleString()
    q_type = queries.schema["query_id"].dataType.simpleString()
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    out = None
    for b in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", "embedding").collect()
        by_size: dict[int, tuple[list, np.ndarray]] = {}
        for size in {len(r["embedding"]) for r in mine if r["embedding"] is not None}:
            rows = [r for r in mine if r["embedding"] is not None and len(r["embedding"]) == size]
            by_size[size] = ([r["query_id"] for r in rows], unit(np.array([r["embedding"] for r in rows], np.float64)))
        shared = corpus.sparkSession.sparkContext.broadcast(by_size)

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            best: dict = {}
            for frame in frames:
                sizes = frame[vector].map(len)
                for size, (ids, q) in shared.value.items():
                    part = frame[sizes == size]
                    if not len(part):
                        continue
                    s = unit(np.array(part[vector].tolist(), np.float64)) @ q.T
                    own = part[id_column].to_numpy()
                    order = np.lexsort((np.broadcast_to(np.argsort(np.argsort(own))[:, None], s.shape), -s), axis=0)[:limit]
                    for k, query in enumerate(ids):
                        best[query] = sorted(best.get(query, []) + [(-s[i, k], own[i]) for i in order[:, k]])[:limit]
            rows = [(q, i, -s) for q, found in best.items() for s, i in found]
            yield pd.DataFrame(rows, columns=["query_id", id_column, "score"])

        part = corpus.where(F.col(vector).isNotNull()).select(id_column, vector).mapInPandas(run, f"query_id {q_type}, {id_column} {id_type}, score double")
        out = part if out is None else out.unionByName(part)
    return top_k(out, id_column, limit)


def unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n != 0)
