"""BM25 over text segments: postings, boolean and phrase match, scoring, collapse to records."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from mnemospark.functions.text import searchable_text, segment_markdown, simple_tokens

K1, B = 1.2, 0.75
MAX_QUERY_CHARS, MAX_QUERY_TOKENS = 4096, 64
#: Rows of (query, term) that may be sent to every task; of more, joins shuffle.
BROADCAST_ROWS = 200_000
#: Texts that are cut into segments at a time.
CUT_ROWS = 256
OPERATORS = {"AND", "OR", "NOT", "NEAR"}


def segment_table(memories: DataFrame, concepts: DataFrame) -> DataFrame:
    """(memory_id, segment_no, heading_path, searchable) of every memory's segments."""
    return segments_of(memories.join(concepts, memories["id"] == concepts["memory_id"]))


def segments_of(rows: DataFrame) -> DataFrame:
    """(memory_id, segment_no, heading_path, searchable) of rows that hold a memory's content and tags beside its concept's fields."""
    kept = rows.select("memory_id", "title", "description", "concept_type", "tags", "content")
    names = kept.columns[:-1]
    added = [T.StructField("segment_no", T.IntegerType()), T.StructField("heading_path", T.StringType()), T.StructField("body", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CUT_ROWS):
                part = batch.slice(at, CUT_ROWS)
                found = [(k, *x) for k, text in enumerate(part["content"].to_pylist()) for x in segment_markdown(text)]
                own, *made = zip(*found) if found else ((), (), (), ())
                columns = [part[c].take(pa.array(own, pa.int32())) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(v, t) for v, t in zip(made, (pa.int32(), pa.string(), pa.string())))], names=[*names, *(f.name for f in added)])
        pa.default_memory_pool().release_unused()

    cut = kept.mapInArrow(run, T.StructType([*(kept.schema[c] for c in names), *added]))
    text = searchable_text(F.col("title"), F.col("description"), F.col("concept_type"), F.col("tags"), F.col("heading_path"), F.col("body"))
    return cut.select("memory_id", "segment_no", "heading_path", text.alias("searchable"))


def normalise_query(query: str) -> list[str]:
    """The query's tokens, phrases quoted; empty if it is too long or not text."""
    q = query.strip()
    if not q or len(q) > MAX_QUERY_CHARS or "\0" in q:
        return []
    return [t if t in OPERATORS or re.fullmatch(r"\w+", t) else '"' + t.replace('"', '""') + '"' for t in q.split()[:MAX_QUERY_TOKENS]]


def normalise_query(query: str) -> list[str]:
    """The query's tokens, phrases quoted; empty if it is too long or not text."""
    q = query.strip()
    if not q or len(q) > MAX_QUERY_CHARS or "\0" in q:
        return []
    return [t if t in OPERATORS or re.fullmatch(r"\w+", t) else '"' + t.replace('"', '""') + '"' for t in q.split()[:MAX_QUERY_TOKENS]]


def simple_words(text: str) -> list[str]:
    """A query's words as ``simple_tokens`` cuts them."""
    return re.findall("[a-z0-9]+", text.lower())


def parse_query(query: str | None, words: Callable[[str], list[str]]) -> tuple[list[str], list[tuple[int, list[int]]]]:
    """(phrases, terms joined by a space; branches (needed phrases, vetoed groups), as masks); no branches if malformed or hopeless."""
    groups: list[list[list[str]]] = [[]]
    operators: list[str] = []
    for item in normalise_query(query or ""):
        if item in ("AND", "OR", "NOT"):
            if not groups[-1]:
                return [], []
            operators.append(item)
            groups.append([])
        else:
            groups[-1].append(words(item))
    if not groups[-1]:
        return [], []
    phrases: list[str] = []
    masks: list[int] = []
    for group in groups:
        mask = 0
        for terms in filter(None, group):
            mask |= 1 << len(phrases)
            phrases.append(" ".join(terms))
        masks.append(mask)
    # a group without a term matches nothing
    branches: list[list] = [[masks[0], [], masks[0] == 0]]
    for operator, mask in zip(operators, masks[1:]):
        if operator == "OR":
            branches.append([mask, [], mask == 0])
        elif operator == "AND":
            branches[-1][0] |= mask
            branches[-1][2] |= mask == 0
        elif mask:
            branches[-1][1].append(mask)
    return phrases, [(need, veto) for need, veto, hopeless in branches if not hopeless]


def term_rows(rows: DataFrame, keys: list[str], text: str, tokens=simple_tokens) -> DataFrame:
    """keys, len, term: one row for each token."""
    t = tokens(F.col(text))
    # the outer form: the plain one makes the planner test the tokens first, by splitting each text twice
    return rows.select(*keys, t.alias("ts")).select(*keys, F.size("ts").cast("bigint").alias("len"), F.explode_outer("ts").alias("term"))


def postings(rows: DataFrame, keys: list[str], text: str, tokens=simple_tokens, wanted: DataFrame | None = None) -> DataFrame:
    """keys, term, len, tf; only the terms of ``wanted`` (term) if it is given.

    Other terms go before the count, so what the count moves is hits, combined in each task first.
    """
    terms = term_rows(rows, keys, text, tokens)
    if wanted is not None:
        terms = terms.join(wanted, "term", "left_semi")
    else:
        terms = terms.where(F.col("term").isNotNull())
    return terms.groupBy(*keys, "term", "len").agg(F.count("*").alias("tf"))


def corpus_statistics(rows: DataFrame, text: str, tokens=simple_tokens) -> DataFrame:
    """One row (n_docs, avg_len)."""
    return rows.select(F.size(tokens(F.col(text))).alias("len")).agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))


def idf(n: Column, df: Column) -> Column:
    raw = F.ln((n - df + 0.5) / (df + 0.5))
    return F.when(raw <= 0, F.lit(1e-6)).otherwise(raw)


def bm25(rows: DataFrame, keys: list[str], text: str, queries: DataFrame, match_all: bool = False, tokens=simple_tokens) -> DataFrame:
    """(query_id, keys, score) of rows that hold any (or all) of a query's terms.

    ``queries`` is (query_id, text). Rows' terms are cut to the queries' own before anything
    moves; document frequency is a partial aggregate; a hot term's postings are joined with
    AQE's skew handling, and scores are summed with map-side combining.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    wanted = asked.select("term").distinct()
    # a batch's (query, term) rows are counted, and sent to the tasks only if they are few; more
    # of them are joined by a shuffle
    few = asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if few:
        wanted = F.broadcast(wanted)
    hits = postings(rows, keys, text, tokens, wanted)
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    stats = corpus_statistics(rows, text, tokens)
    weights = df.join(F.broadcast(stats)).select("term", "avg_len", idf(F.col("n_docs"), F.col("df")).alias("idf"))
    per_query = asked.join(weights, "term")
    scored = hits.join(F.broadcast(per_query) if few else per_query, "term")
    tf = F.col("tf")
    part = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    out = scored.groupBy("query_id", *keys).agg(F.sum(part).alias("score"), F.count("*").alias("matched"))
    if match_all:
        need = asked.groupBy("query_id").agg(F.count("*").alias("needed"))
        out = out.join(need, "query_id").where("matched = needed").drop("needed")
    return out.drop("matched")


def collapse(scored: DataFrame, id_column: str, limit: int, segment_limit: int | None = None, segment_column: str | None = None) -> DataFrame:
    """(query_id, id, score, rank): the best segments of each query, the best score of each record."""
    df = scored
    if segment_column is not None:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), id_column, segment_column)
        df = df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= (segment_limit or 8 * limit)).drop("place")
    best = df.groupBy("query_id", id_column).agg(F.max("score").alias("score"))
    return top_k(best, id_column, limit)


def top_k(scored: DataFrame, id_column: str, limit: int) -> DataFrame:
    """The ``limit`` best of each query by score, then id; each task cuts its own rows first."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id_column)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def phrase_match(rows: DataFrame, keys: list[str], text: str, phrase: str, tokens=simple_tokens, words=simple_words) -> DataFrame:
    """Keys of rows where the phrase's tokens stand side by side; ``words`` cuts the phrase as ``tokens`` cuts the rows."""
    want = words(phrase)
    found = rows.select(*keys, tokens(F.col(text)).alias("ts"))
    return found.where(holds("ts", " ".join(want)) if want else F.lit(False)).select(*keys)


def holds(tokens: str, phrase: str) -> Column:
    """Whether an array of tokens has the phrase's tokens side by side."""
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).contains(f" {phrase} ")


def boolean_match(rows: DataFrame, keys: list[str], text: str, query: str, tokens=simple_tokens, words=simple_words) -> DataFrame:
    """Keys of rows under one query of ``parse_query``'s language; nothing if it is malformed. For a batch, scored, see ``search_index``."""
    phrases, branches = parse_query(query, words)
    test = F.lit(False)
    found = rows.select(*keys, tokens(F.col(text)).alias("ts"))
    every = lambda mask: functools.reduce(lambda a, b: a & b, (holds("ts", p) for k, p in enumerate(phrases) if mask >> k & 1))
    for need, veto in branches:
        test = test | functools.reduce(lambda a, v: a & ~every(v), veto, every(need))
    return found.where(test).select(*keys)
