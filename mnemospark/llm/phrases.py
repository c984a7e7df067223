"""Phrase collocations from generalised suffix automata of bounded depth.

A shard's texts make one automaton over words, laid out in arrays and built level by level: a state of depth k is
a state of depth k - 1 and a word that follows it within a piece, its suffix link the state of the same
phrase without its first word, and its endpos count the number of places where it ends. (A state and its suffix link with the same count are one
endpos class; both are listed, as the shard's counts are only addends.) The automaton enumerates its phrases up to the
depth, and Spark adds their counts over all shards.

Most phrases occur once, so they aren't moved as text. A first pass adds up counts by a hash of the phrase in
``2^BITS`` cells, packed by ranges of cells into binary rows, which tasks add and turn into one bit a cell: whether its count
reaches the minimum. A phrase in a cell without the bit can't be frequent, nor can any that holds it; all others are counted exactly by
their text in the second pass. The bits are the only thing broadcast (16 MiB, whatever the input). Where a huge
corpus fills most cells, fewer phrases are told apart early; results don't change.

Subsumption: a phrase within a longer candidate is within one that is longer by one word and no rarer than that one, so
each candidate reports its count to two phrases: that of its suffix link, and that of its path less its last word.

A null text is empty, a null language ``und``. Repeated rows and ids count each time. A text of any length is one
shard at most, so memory is bounded by ``SHARD`` bytes or the longest text. Ties in score and count go by the phrase's bytes;
of cuts with one score the shortest first part counts. Texts without words, and tables without rows, give no rows. Columns besides text and lang
are not read. Arithmetic is in decimals of 38 digits, which hold a phrase's count up to 10^15.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm import cells
from mnemospark.llm.common import cut_lineage, release_memory

#: 2^BITS cells of the sketch.
BITS = 27
#: Bytes of text that make a shard.
SHARD = 4 << 20
NO_LANG = "und"

BLANK, BREAK = 1, 2
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = BLANK
KIND[[*b".,;:!?\n\x0b\x0c\r"]] = BREAK
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Level(NamedTuple):
    """The states of one depth: the state before the last word, the last word's state, suffix link, endpos count, hash."""

    before: np.ndarray
    last: np.ndarray
    link: np.ndarray
    count: np.ndarray
    hash: np.ndarray


class Automaton(NamedTuple):
    """A shard's suffix automaton down to a depth: levels[0] are words of a language (``before``: the language, ``last``: the word)."""

    words: pa.Array
    langs: list[str]
    levels: list[Level]
    totals: np.ndarray


def split_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(the words, lower-cased, dictionary-encoded; whether each follows the one before within a piece; the text of each)."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    kind = KIND[data]
    inside = np.concatenate([[False], kind == 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    breaks = np.flatnonzero(kind == BREAK)
    piece = np.searchsorted(breaks, starts)
    follows = np.concatenate([[False], piece[1:] == piece[:-1]])[: len(starts)]
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]])
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    # 64-bit offsets: a single text may have any length
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(LOWER[data[kind == 0]])])
    return words.dictionary_encode(), follows, np.searchsorted(begins, starts, "right") - 1


def states(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, a place of each, each place's key number, counts)."""
    return np.unique(key, return_index=True, return_inverse=True, return_counts=True)


def build(langs: list[str], texts: list[bytes], depth: int, may: np.ndarray | None = None, bits: int = BITS) -> Automaton:
    """The automaton of a shard; with ``may`` (a bit a cell) only of phrases whose cells have the bit, as have all cells of their parts."""
    words, follows, text = split_words(texts)
    names = sorted(set(langs))
    number = {x: k for k, x in enumerate(names)}
    code = np.array([number[x] for x in langs], np.int64)[text]
    totals = np.bincount(code, minlength=len(names))
    of_word = np.array([xxhash.xxh3_64_intdigest(w) for w in words.dictionary.to_pylist()], np.uint64)
    of_lang = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in names], np.uint64)
    width = max(1, len(words.dictionary))
    key, at, now, count = states(code * width + words.indices.to_numpy().astype(np.int64))
    before, last = np.divmod(key, width)
    level = Level(before, last, np.full(len(key), -1), count, cells.mixed(of_word[last] ^ cells.mixed(of_lang[before])))
    one, first = now, level
    levels = []
    for k in range(1, depth + 1):
        if k > 1:
            here = np.flatnonzero(follows[1:] & (now[:-1] >= 0) & (one[1:] >= 0) & (now[1:] >= 0)) + 1
            key, at, own, count = states(now[here - 1] * len(first.count) + one[here])
            before, last = np.divmod(key, max(1, len(first.count)))
            link = now[here[at]]
            level = Level(before, last, link, count, cells.mixed(level.hash[before] * np.uint64(0x9E3779B97F4A7C15) + first.hash[last]))
            now = np.full(len(now), -1, np.int64)
            now[here] = own
        if may is not None:
            # the state keeps its number; places that lead to a hopeless one lead nowhere
            hope = cells.told(may, level.hash, bits)
            if k == 1:
                one = now = np.where(hope[now], now, -1) if len(hope) else now
            else:
                now[here] = np.where(hope[own], own, -1)
            level = level._replace(count=np.where(hope, level.count, 0))
        if k == 1:
            first = level
        levels.append(level)
    return Automaton(words.dictionary, names, levels, totals)


def phrases(automaton: Automaton) -> Iterator[pa.RecordBatch]:
    """(key, f) of the automaton's phrases, and how many words each language has, as those of the empty phrase.

    A key is a phrase, a tab, which no word has, and the language: one column takes less than two when it is moved.
    """
    names = pa.array([x.encode() for x in automaton.langs], pa.large_binary())
    tab, blank = pa.scalar(b"\t", pa.large_binary()), pa.scalar(b" ", pa.large_binary())
    yield pa.RecordBatch.from_arrays([pa.array(["\t" + x for x in automaton.langs]), pa.array(automaton.totals.astype(np.int64))], names=["key", "f"])
    first = automaton.levels[0]
    for k, level in enumerate(automaton.levels):
        kept = np.flatnonzero(level.count)
        for at in range(0, len(kept), 1 << 17):
            own = kept[at : at + (1 << 17)]
            state, parts = own, []
            for j in range(k, 0, -1):
                parts.append(first.last[automaton.levels[j].last[state]])
                state = automaton.levels[j].before[state]
            parts.append(first.last[state])
            text = pc.binary_join_element_wise(*(automaton.words.take(pa.array(p)) for p in reversed(parts)), blank)
            key = pc.binary_join_element_wise(text, names.take(pa.array(first.before[state])), tab)
            yield pa.RecordBatch.from_arrays([key.cast(pa.binary()).cast(pa.string()), pa.array(level.count[own])], names=["key", "f"])


def shards(batches: Iterator[pa.RecordBatch], shard: int) -> Iterator[tuple[list[str], list[bytes]]]:
    """(languages, texts) of rows (lang, text) in shards of ``shard`` bytes."""
    langs, texts, size = [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            langs.append(lang)
            texts.append(text.as_py())
            size += len(texts[-1])
            if size >= shard:
                yield langs, texts
                langs, texts, size = [], [], 0
    if texts:
        yield langs, texts


def sketch(rows: DataFrame, depth: int, least: int, bits: int = BITS, shard: int = SHARD) -> np.ndarray:
    """One bit for each cell: whether the phrases with that hash together occur ``least`` times (255 times, if that is less)."""
    top = min(least, 255)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in shards(batches, shard):
            levels = build(langs, texts, depth).levels
            yield from cells.batches(np.concatenate([v.hash for v in levels]), np.concatenate([v.count for v in levels]), bits, top)
            del levels
        release_memory()

    return cells.often(rows.mapInArrow(counted, "range int, cells binary"), bits, top)


def counts(docs: DataFrame, depth: int = 3, least: int = 10, text: str = "text", lang: str = "lang", bits: int = BITS, shard: int = SHARD) -> DataFrame:
    """(lang, depth, phrase, f) of all phrases of up to ``depth`` words that occur ``least`` times in a language; depth 0: all its words."""
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(f"`{text}`").alias("text")).where(F.col("text").isNotNull())
    shared = docs.sparkSession.sparkContext.broadcast(sketch(rows, depth, least, bits, shard))

    def enumerated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in shards(batches, shard):
            yield from phrases(build(langs, texts, depth, shared.value, bits))
        release_memory()

    found = rows.mapInArrow(enumerated, "key string, f long").groupBy("key").agg(F.sum("f").alias("f"))
    phrase, words = F.substring_index("key", "\t", 1), F.size(F.split("phrase", " "))
    named = found.select(F.expr("substring(key, instr(key, '\t') + 1)").alias("lang"), phrase.alias("phrase"), "f")
    out = named.select("lang", F.when(F.col("phrase") == "", 0).otherwise(words).alias("depth"), "phrase", "f")
    return out.where((F.col("f") >= least) | (F.col("depth") == 0))


def collocations(docs: DataFrame, depth: int = 3, least: int = 10, top: int = 2000, subsumed: int = 50, text: str = "text", lang: str = "lang", bits: int = BITS, shard: int = SHARD) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    A candidate goes if a longer one that holds it has ``subsumed`` per cent of its count.
    """
    found = cut_lineage(counts(docs, depth, least, text, lang, bits, shard))
    candidates = found.where("depth > 1")
    shorter = F.explode(F.array(F.expr("substring(phrase, instr(phrase, ' ') + 1)"), F.expr("substring_index(phrase, ' ', depth - 1)")))
    longer = candidates.where("depth > 2").select("lang", shorter.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = candidates.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < subsumed * F.col("f")))
    cut = left.select("lang", "phrase", F.col("f").alias("a"), "depth", F.explode(F.sequence(F.lit(1), F.col("depth") - 1)).alias("k"))
    cut = cut.withColumn("head", F.expr("substring_index(phrase, ' ', k)")).withColumn("tail", F.expr("substring_index(phrase, ' ', k - depth)"))
    parts = found.where((F.col("depth") > 0) & (F.col("depth") < depth)).select("lang", "phrase", "f")
    heads, tails = parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), parts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    score = F.expr("cast((cast(1000000 as decimal(7, 0)) * (cast(a as decimal(15, 0)) * cast(a as decimal(15, 0)))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0))) as long)")
    scored = cut.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumn("score", score)
    worst = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = worst.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = found.where("depth = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
