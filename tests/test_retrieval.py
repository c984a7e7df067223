import sqlite3

import pytest
from pyspark.sql import functions as F

from mnemospark.functions.text import porter_tokens
from mnemospark.operators import lexical as L
from mnemospark.operators import retrieve as V
from mnemospark.operators.vector import knn

TEXTS = ["The quick brown foxes jumped", "a lazy dog sleeps; the dog dreams", "foxes and dogs running quickly", "database indexes speed queries", "", None, "running runs runner ran", "Indexing databases is what indexers do"]


@pytest.mark.parametrize("asked", ["foxes", "running dogs", "database indexing", "absent"])
def test_bm25_equals_fts5(spark, asked):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize='porter unicode61')")
    con.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", [(i, t or "") for i, t in enumerate(TEXTS)])
    want = {i: -s for i, s in con.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (asked,))}
    rows = spark.createDataFrame([(i, t or "") for i, t in enumerate(TEXTS)], "id long, t string")
    queries = spark.createDataFrame([(1, asked)], "query_id long, text string")
    got = {r["id"]: r["score"] for r in L.bm25(rows, ["id"], "t", queries, match_all=True, tokens=porter_tokens).collect()}
    assert set(got) == set(want)
    assert all(abs(got[i] - want[i]) < 1e-9 + 1e-6 * abs(want[i]) for i in want)


def test_query_normalisation():
    assert L.normalise_query("foo bar_1 AND x-y") == ["foo", "bar_1", "AND", '"x-y"']
    assert L.normalise_query("x" * 4097) == [] and L.normalise_query("a\0b") == [] and L.normalise_query("  ") == []
    assert len(L.normalise_query("w " * 100)) == 64


def test_boolean_and_phrase(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string").where("t IS NOT NULL")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(L.phrase_match(rows, ["id"], "t", "lazy dog")) == [1]
    assert ids(L.boolean_match(rows, ["id"], "t", "foxes AND dogs")) == [2]
    assert ids(L.boolean_match(rows, ["id"], "t", "foxes OR dog")) == [0, 1, 2]
    assert ids(L.boolean_match(rows, ["id"], "t", "foxes NOT dogs")) == [0]
    for bad in ("OR foxes", "foxes AND", "NEAR(thing, 9)", "AND OR"):
        assert ids(L.boolean_match(rows, ["id"], "t", bad)) == []


def test_knn_ties_zero_vectors_and_lengths(spark):
    corpus = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("z", [0.0, 0.0]), ("n", None), ("s", [1.0])], "id string, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    got = knn(corpus, queries, 3).orderBy("rank").collect()
    assert [(r["id"], round(r["score"], 6)) for r in got] == [("a", 1.0), ("b", 1.0), ("z", 0.0)]


def test_rrf_quality_boosts_and_stale(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id long, id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "w", 30)], "query_id long, id string, rank int")
    got = {r["id"]: r for r in V.rrf(a, b, "id").withColumn("q", V.match_quality(F.col("bm25_rank"), F.col("vector_rank"))).collect()}
    assert abs(got["y"]["score"] - (1 / 62 + 1 / 61)) < 1e-12 and got["y"]["q"] == "high"
    assert got["x"]["q"] == "medium" and got["w"]["q"] == "low"
    s = spark.createDataFrame([("p", True), ("__global__", False), (None, False)], "project string, stale boolean")
    got = [r["s"] for r in s.select(V.scope_boost(V.freshness(F.lit(1.0), F.col("stale")), F.col("project"), F.lit("p")).alias("s")).collect()]
    assert [round(x, 6) for x in got] == [1.35, 1.25, 1.0]


def test_hybrid_search_end_to_end(spark):
    m = spark.createDataFrame([(str(i), t, ["t"], "p" if i % 2 else "__global__", [float(i), 1.0], None) for i, t in enumerate(TEXTS) if t], "id string, content string, tags array<string>, project string, embedding array<float>, superseded_by string")
    c = m.select(F.col("id").alias("memory_id"), F.lit("x").alias("concept_type"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("description"), F.when(F.col("id") == "0", "deprecated").otherwise("stable").alias("status"))
    q = spark.createDataFrame([(7, "foxes", [1.0, 1.0], "p")], "query_id long, text string, embedding array<float>, current_project string")
    got = V.hybrid_search(m, c, L.segment_table(m, c), q, V.SearchOptions(limit=3)).orderBy("rank").collect()
    assert len(got) == 3 and "0" not in {r["id"] for r in got}
    assert "2" in {r["id"] for r in got}
    flat = V.hybrid_search(m, c, L.segment_table(m, c), q, V.SearchOptions(limit=3, current_boost=None, global_boost=None)).collect()
    assert {r["id"] for r in flat}


def test_hybrid_search_filters_and_graph(spark):
    rows = [("a", "the running fox", "p", [1.0, 0.0], None), ("b", "stone", "p", [0.0, 1.0], None), ("c", "old stone", "p", [0.0, 1.0], "b"), ("d", "gone", "p", [0.0, 1.0], None), ("e", "a fox ran", "q", [0.9, 0.1], None)]
    m = spark.createDataFrame(rows, "id string, content string, project string, embedding array<float>, superseded_by string").withColumn("tags", F.array(F.lit("t")))
    c = m.select(F.col("id").alias("memory_id"), F.lit("x").alias("concept_type"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("description"), F.when(F.col("id") == "d", "deprecated").otherwise("stable").alias("status"))
    q = spark.createDataFrame([(1, "runs", [1.0, 0.0], None)], "query_id long, text string, embedding array<float>, current_project string")
    edges = spark.createDataFrame([("a", x, x, "supports", i) for i, x in enumerate("cdb")], "src_memory_id string, dst_memory_id string, dst_ref string, relation string, ordinal long").withColumn("id", F.concat("src_memory_id", "dst_ref")).withColumn("producer", F.lit("x")).withColumn("source_revision", F.lit(1).cast("long"))

    def search(*args, **options):
        return V.hybrid_search(m, c, L.segment_table(m, c), q, V.SearchOptions(limit=1, **options), *args).orderBy("rank").collect()

    top = search()
    # "runs" and "running" have one stem
    assert [r["id"] for r in top] == ["a"] and top[0]["bm25_rank"] == 0
    assert [r["id"] for r in search(where="project = 'q'")] == ["e"] == [r["id"] for r in search(where="project = 'q'", filter_mode="pre")]
    assert search(where="id = 'b'", filter_mode="pre")[0]["id"] == "b"
    wide = V.hybrid_search(m.where("id <> 'e'"), c, L.segment_table(m, c), q, V.SearchOptions(limit=1, graph_depth=1, where="id IN ('a', 'b')"), edges).collect()
    assert [r["id"] for r in wide] == ["a"]
    seeds = spark.createDataFrame([(1, "a", 1.0, 1)], "query_id long, id string, score double, rank int")
    paths = spark.createDataFrame([(1, k, "a", x, "supports", 1, False) for k, x in enumerate("cdb")], "query_id long, ord int, root string, node string, relation string, distance int, cycle boolean")
    live = m.where("superseded_by IS NULL AND id <> 'd'")
    assert [(r["id"], r["score"]) for r in V.graph_neighbours(seeds, paths, 1, live).collect()] == [("b", 0.8)]


def test_rerank_covers_a_query_or_leaves_it(spark):
    cand = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.4), (2, "a", 0.3), (2, "b", 0.2)], "query_id long, id string, score double")
    logits = spark.createDataFrame([(1, "a", 0.0), (1, "b", 2.0), (2, "a", 1.0)], "query_id long, id string, logit double")
    got = {(r["query_id"], r["id"]): round(r["score"], 4) for r in V.apply_rerank(cand, logits).collect()}
    assert got == {(1, "a"): 0.5, (1, "b"): 0.8808, (2, "a"): 0.3, (2, "b"): 0.2}


def test_hybrid_search_moves_its_postings_once_and_no_text(spark):
    from mnemospark import catalog

    found = catalog.hybrid_search_full(spark, "/root/testdata/sf0.001")
    assert found.collect()
    plan = found._jdf.queryExecution().executedPlan().executedPlan().toString()
    scans = [x for x in plan.split("\n") if "FileScan parquet" in x]
    assert sum("FileScan parquet [term" in x for x in scans) == 1 and "ReusedExchange" in plan
    assert not any("FileScan parquet [doc_id" in x and "text" in x.split("Batched")[0] for x in scans)
