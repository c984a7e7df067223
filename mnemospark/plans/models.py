"""What a user plugs in: an embedder, a reranker, a generator; and deterministic stand-ins."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def __call__(self, queries: list[str], documents: list[str]) -> list[float]: ...


class Generator(Protocol):
    def __call__(self, prompts: list[str]) -> list[str | None]: ...


def embed(load: Callable[[], Embedder], text: Column) -> Column:
    """Vectors of texts; the model is loaded once in each task."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for b in batches:
            yield pd.Series(model(b.fillna("").tolist()))

    return run(text)


def rerank(load: Callable[[], Reranker], query: Column, document: Column) -> Column:
    """Logits of (query, document) pairs; null for a whole batch that the model fails on."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for q, d in batches:
            try:
                got = model(q.fillna("").tolist(), d.fillna("").tolist())
            except Exception:  # a failing reranker must leave the fused order as it is
                got = []
            yield pd.Series(got if len(got) == len(q) else [None] * len(q), dtype="float64")

    return run(query, document)


def generate(load: Callable[[], Generator], prompt: Column) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for b in batches:
            yield pd.Series(model(b.fillna("").tolist()))

    return run(prompt)


class HashEmbedder:
    """A stand-in without weights: signed hashed words."""

    def __init__(self, size: int = 64) -> None:
        self.size = size

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.size), np.float32)
        for k, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                out[k, h % self.size] += 1 if h >> 63 else -1
        return out.tolist()


class OverlapReranker:
    """A stand-in: the share of a query's words that a document has, as a logit."""

    def __call__(self, queries: list[str], documents: list[str]) -> list[float]:
        return [6 * len(set(q.lower().split()) & set(d.lower().split())) / max(1, len(set(q.lower().split()))) - 3 for q, d in zip(queries, documents)]


class FixedGenerator:
    """A stand-in that always replies the same."""

    def __init__(self, reply: str = "KEEP_UNCHANGED") -> None:
        self.reply = reply

    def __call__(self, prompts: list[str]) -> list[str | None]:
        return [self.reply] * len(prompts)
