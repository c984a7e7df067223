"""Language identification by cross-parsing entropy over suffix automata.

For each language a suffix automaton of its labelled training text tells, byte by byte,
how long the next bytes of a document go on occurring somewhere in that text. The document
is parsed greedily, from its first byte to its last, into such longest matches; the language that needs the fewest
phrases per byte wins. The automaton's transitions are laid out as a dense table, in which a missing
transition counts a phrase and starts the next one, so whole batches of texts are parsed in
numpy, one step for all texts at a time: long texts in segments at once, whose beginnings are then parsed again
from the state that the segment before ended in, until both parses meet.

Letters are lower-cased and read as UTF-8, so all letters of all scripts differ; everything else counts as one
space. Each language's automaton has an alphabet of its own: the bytes of its text. All languages are learned; every
language keeps all its training text, and phrases against shorter texts are scaled by what less text costs the longest.

Nulls and texts without a letter are ``und`` with score 0, as is everything if there is nothing to learn from. Ties go
to the language that sorts first. The score is the winner's share of a softmax over the languages'
phrases per byte. Equal texts get equal results, and repeated rows are identified like others; a repeated id is learned
from once. An empty table gives no rows. Columns besides doc_id, text and lang are not read; those named like the new ones are replaced.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemospark.llm.common import append_columns, cut_lineage, fold

#: Per language, at most so many texts and so many bytes of them are learned from.
TEXTS, LETTERS = 200, 40_000
#: All languages' automata together hold about so many bytes, so a task's tables stay small, but each language ``FEWEST``.
ALL_LETTERS, FEWEST = 480_000, 1_000
#: A column with more different values than this holds no languages.
LANGUAGES = 4_000
SEGMENT, SHARPNESS = 2048, 60.0
UNKNOWN = "und"


def automaton(symbols: np.ndarray, alphabet: int) -> np.ndarray:
    """The dense transitions (states, alphabet) of the suffix automaton of symbols; -1: none."""
    size = 2 * len(symbols) + 2
    step = np.full((size, alphabet), -1, np.int32)
    link, length = [-1] * size, [0] * size
    states, last = 1, 0
    for c in symbols.tolist():
        now, states = states, states + 1
        length[now] = length[last] + 1
        p = last
        while p != -1 and step[p, c] == -1:
            step[p, c] = now
            p = link[p]
        if p == -1:
            link[now] = 0
        else:
            q = int(step[p, c])
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy, states = states, states + 1
                length[copy] = length[p] + 1
                step[copy] = step[q]
                link[copy] = link[q]
                while p != -1 and step[p, c] == q:
                    step[p, c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return step[:states].copy()


def parser_table(symbols: np.ndarray, alphabet: int) -> np.ndarray:
    """For state * alphabet + symbol: twice the next state's row, plus 1 if a phrase ends before the symbol.

    One more state than the automaton has stands behind a symbol that never occurs, which is a
    phrase by itself: whatever follows begins a phrase.
    """
    step = automaton(symbols, alphabet).astype(np.int64)
    behind = len(step)
    begin = np.where(step[0] >= 0, step[0], behind)
    step = np.concatenate([step, np.full((1, alphabet), -1)])
    table = np.where(step >= 0, 2 * step * alphabet, 2 * begin[None, :] * alphabet + 1)
    table[0] = 2 * begin * alphabet
    return table.astype(np.int32).ravel()


@functools.cache
def letters() -> np.ndarray:
    """Of each code point, whether it is a letter."""
    return np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)


def encode(text: str | None) -> np.ndarray:
    """The text's letters, lower-cased, as UTF-8 bytes; whatever stands between letters is one space."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")
    own = letters()[points]
    points = np.where(own, points, np.uint32(32)).astype("<u4")
    if len(points) > 1:
        points = points[np.concatenate([[True], own[1:] | own[:-1]])]
    if len(points) and points.max() < 0x80:
        return points.astype(np.uint8)
    return np.frombuffer(points.tobytes().decode("utf-32-le").encode(), np.uint8)


def symbols_of(reference: np.ndarray) -> tuple[np.ndarray, int]:
    """A language's symbol for each byte and how many symbols it has: 0 is the space, 1 any byte that its text lacks."""
    known = np.setdiff1d(np.unique(reference), [32])
    table = np.ones(256, np.uint8)
    table[known] = np.arange(2, len(known) + 2)
    table[32] = 0
    return table, len(known) + 2


def train(texts: dict[str, list[str]], letters_each: int = LETTERS) -> dict:
    """The parser tables from texts by language."""
    if not texts:
        return {"languages": []}
    letters_each = max(min(FEWEST, letters_each), min(letters_each, ALL_LETTERS // len(texts)))
    coded = {}
    for language, own in texts.items():
        # whole texts as long as they fit; if not even one does, a part of the first
        parts, total = [], 0
        for t in own:
            got = np.append(encode(t), np.uint8(32))
            if total + len(got) <= letters_each:
                parts.append(got)
                total += len(got)
        coded[language] = np.concatenate(parts) if parts else encode(own[0])[:letters_each]
    languages = sorted(coded)
    references, maps, sizes = [], [], []
    for x in languages:
        table, size = symbols_of(coded[x])
        references.append(table[coded[x]])
        maps.append(table)
        sizes.append(size)
    return {"languages": languages, "maps": maps, "scales": length_scales(references, sizes), "tables": [parser_table(r, n) for r, n in zip(references, sizes)]}


def length_scales(references: list[np.ndarray], sizes: list[int]) -> list[float]:
    """What each language's phrases per byte are multiplied by: more text means longer matches.

    The phrases per byte that the longest references need for text of their own language, cut
    from their ends, with all the rest learned, to those with only as many bytes learned.
    References within a tenth of the longest are taken as equally long.
    """
    longest = max(map(len, references))
    if all(10 * len(r) >= 9 * longest for r in references):
        return [1.0] * len(references)
    probes = [(r[: -len(r) // 10], r[-len(r) // 10 :], n) for r, n in zip(references, sizes) if 10 * len(r) >= 9 * longest][:3]

    def needed(length: int) -> float:
        return float(np.mean([phrases(x, np.array([len(x)]), parser_table(r[:length], n))[0] / max(1, len(x)) for r, x, n in probes]))

    whole = needed(longest)
    return [1.0 if 10 * len(r) >= 9 * longest else min(1.0, whole / max(needed(len(r)), 1e-9)) for r in references]


def phrases(symbols: np.ndarray, sizes: np.ndarray, table: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Phrases of each text; ``symbols`` holds them end to end, ``sizes`` their lengths."""
    begin = np.cumsum(sizes) - sizes
    pieces = -(-sizes // segment)
    owner = np.repeat(np.arange(len(sizes)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = begin[owner] + nth * segment
    spans = np.minimum(segment, begin[owner] + sizes[owner] - starts)
    after = np.zeros(len(symbols), np.int32)  # what the table says at each symbol

    def parse(which: np.ndarray) -> None:
        """Parses segments, the longest first, each from the automaton's beginning."""
        alive = len(which)
        state, at = np.zeros(alive, np.int32), starts[which]
        ends = np.searchsorted(-spans[which], -np.arange(1, int(spans[which[0]]) + 1), side="right")
        for end in ends.tolist():
            if end != alive:
                alive = end
                state, at = state[:alive], at[:alive]
            got = table[state + symbols[at]]
            state = got >> 1
            after[at] = got  # twice the state, plus 1 if a phrase ends
            at = at + 1

    def parse_on(which: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Parses segments from given states, each up to where it meets the parse before; returns those that never do."""
        never, at, end = [], starts[which], starts[which] + spans[which]
        while len(which):
            got = table[state + symbols[at]]
            state, met = got >> 1, after[at] >> 1 == got >> 1
            after[at] = got
            at = at + 1
            out = at == end
            never.append(which[out & ~met])
            on = ~(met | out)
            which, state, at, end = which[on], state[on], at[on], end[on]
        return np.concatenate([np.zeros(0, np.int64), *never])

    if len(owner):
        parse(np.argsort(-spans, kind="stable"))
    again = np.flatnonzero(nth > 0)
    while len(again):  # a parse that doesn't meet the one before changes the next segment's beginning
        over = parse_on(again, after[starts[again] - 1] >> 1)
        following = over + 1
        following = following[following < len(owner)]
        again = np.sort(following[nth[following] > 0])
    whole = np.concatenate([[0], np.cumsum(after & 1, dtype=np.int64)])
    return 1 + whole[begin + sizes] - whole[begin]


def classifier(model: dict):
    """A function from whole texts to their languages and scores."""
    if not model["languages"]:
        return lambda texts: [[UNKNOWN] * len(texts), [0.0] * len(texts)]
    names = np.array(model["languages"], object)

    def some(texts: list[str | None]) -> tuple[list, list]:
        coded = [encode(t) for t in texts]
        sizes = np.array([len(c) for c in coded])
        joined = np.concatenate([*coded, np.zeros(0, np.uint8)])
        cost = np.stack([phrases(own[joined], sizes, table) * scale for own, table, scale in zip(model["maps"], model["tables"], model["scales"])], axis=1)
        cost = cost / np.maximum(sizes, 1)[:, None]
        lettered = np.array([bool((c != 32).any()) for c in coded])
        best = cost.argmin(axis=1)
        share = 1 / np.exp(-SHARPNESS * (cost - cost.min(axis=1, keepdims=True))).sum(axis=1)
        return np.where(lettered, names[best], UNKNOWN).tolist(), np.where(lettered, share, 0.0).tolist()

    def classify(texts: list[str | None]) -> list:
        out, at = [[], []], 0
        while at < len(texts):  # as many texts at a time as make about two million characters
            n, size = 0, 0
            while at + n < len(texts) and (not n or size + len(texts[at + n] or "") < 2_000_000):
                size += len(texts[at + n] or "")
                n += 1
            for o, got in zip(out, some(texts[at : at + n])):
                o += got
            at += n
        return out

    return classify


def training_texts(docs: DataFrame, texts_each: int = TEXTS, letters_each: int = LETTERS) -> dict[str, list[str]]:
    """At most ``texts_each`` hash-picked learnable texts of each language, of about ``letters_each`` characters in all.

    Learnable: lang and text are not null and the id's fold of four is not 2. Texts are taken whole while they fit;
    the first of a language always is, up to ``letters_each`` characters of it.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), 4) != 2)).select("lang", "doc_id", "text")
    # one row for each language; LANGUAGES at most, so they may be broadcast
    per = cut_lineage(usable.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("ids")))
    languages = per.count()
    if languages > LANGUAGES:
        raise ValueError(f"lang has {languages} values, more than the {LANGUAGES} that can be learned")
    # the first of every language by a hash; only ids with a hash below that of about eight times as many are put in
    # order, so a language with most of the rows sends no more than any other
    key = F.xxhash64("doc_id")
    first = Window.partitionBy("lang").orderBy("key", "doc_id", "text_key")
    size = F.least(F.length("text"), F.lit(letters_each))
    low = (key.cast("double") + 2.0**63) / 2.0**64 * F.col("ids") < 8 * texts_each
    ids = usable.join(F.broadcast(per), "lang").where(low).select("lang", "doc_id", key.alias("key"), F.xxhash64("text").alias("text_key"), size.alias("size"))
    # of a repeated id one text is taken
    one = ids.withColumn("r", F.row_number().over(first)).where(F.col("r") <= 4 * texts_each).groupBy("lang", "doc_id", "key").agg(F.min(F.struct("text_key", "size")).alias("t"))
    order = Window.partitionBy("lang").orderBy("key", "doc_id")
    before = F.coalesce(F.sum("t.size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    picked = one.withColumn("before", before).withColumn("r", F.row_number().over(order)).where((F.col("before") < letters_each) & (F.col("r") <= texts_each))
    picked = picked.select("lang", "doc_id", F.col("t.text_key").alias("text_key"))
    found = usable.join(F.broadcast(picked), ["lang", "doc_id"]).where(F.xxhash64("text") == F.col("text_key"))
    rows = found.groupBy("lang", "doc_id").agg(F.min("text").alias("text")).select("lang", key.alias("key"), "doc_id", F.substring("text", 1, letters_each).alias("text"))
    out: dict[str, list[str]] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["lang"], r["key"], r["doc_id"])):
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def identify(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """``keep`` with ``lang_pred`` and ``score`` of every row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return append_columns(docs, "text", keep, [("lang_pred", T.StringType()), ("score", T.DoubleType())], lambda: classifier(shared.value))
