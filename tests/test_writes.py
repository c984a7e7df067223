from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mnemospark import schemas
from mnemospark.operators import revisions as H
from mnemospark.operators import writes as W

NOW = datetime(2024, 6, 1)


@pytest.fixture(scope="module")
def tables(spark):
    m = spark.createDataFrame([(str(k), f"text {k}", "p", "1" if k == 0 else None) for k in range(300)], "id string, content string, project string, superseded_by string")
    c = spark.createDataFrame([(str(k), 1, f"memories/{k}.md") for k in range(300)], "memory_id string, current_revision long, virtual_path string")
    return schemas.conform(m, "memories"), schemas.conform(c, "concepts")


def test_many_supersessions_by_one(spark, tables):
    m, c = tables
    pairs = [(str(k), "1") for k in range(300)] + [("7", "1"), ("8", "nobody"), ("1", "2"), ("9", "3")]
    memories, concepts, log, edges = W.supersede_logged(m, c, spark.createDataFrame(pairs, "older string, newer string"), "curator", "merge")
    found = {r["memory_id"]: r["current_revision"] for r in concepts.collect()}
    # 0 points to 1 already, 1 can't supersede itself, and 9 takes the lesser of its two
    newer_revisions = sorted(r["source_revision"] for r in edges.where("src_memory_id = '1'").collect())
    assert newer_revisions == list(range(2, 300)) and edges.where("dst_memory_id IN ('0', '1') AND src_memory_id = '1'").count() == 0
    assert found["0"] == 1 and found["1"] == 300 and found["2"] == 3 and found["3"] == 2
    rows = log.where("memory_id = '1'").orderBy("revision").collect()
    assert [r["revision"] for r in rows] == list(range(2, 301)) and [r["parent_revision"] for r in rows] == list(range(1, 300))
    pointers = [r[0] for r in log.where("memory_id = '1'").orderBy("revision").select(F.get_json_object("snapshot_json", "$.superseded_by")).collect()]
    assert pointers == [None] * 298 + ["2"]
    assert memories.where("superseded_by = '1'").count() == 299 and memories.count() == 300
    again = W.supersede_logged(memories, concepts, spark.createDataFrame(pairs[:9], "older string, newer string"), "curator", "merge")
    assert again[2].count() == 0 and again[3].count() == 0


def test_a_supersession_clears_both_memories_verifications(spark, tables):
    m, c = tables
    _, _, log, _ = W.supersede_logged(m, c, spark.createDataFrame([("5", "6"), ("0", "1")], "older string, newer string"), "curator", "merge")
    v = schemas.conform(spark.createDataFrame([("x", "5"), ("y", "6"), ("z", "7"), ("w", "0"), ("u", "1")], "id string, memory_id string"), "verifications")
    # 0 points to 1 already, so neither changes
    left = W.clear_verifications(v, log)
    assert sorted(r["id"] for r in left.collect()) == ["u", "w", "z"] and left.columns == v.columns


def test_empty_batch(spark, tables):
    m, c = tables
    memories, concepts, log, edges = W.supersede_logged(m, c, spark.createDataFrame([], "older string, newer string"), "curator", "merge")
    assert log.count() == edges.count() == 0 and memories.count() == concepts.count() == 300


def test_forget_needs_a_current_revision_and_cascades(spark, tables):
    m, c = tables
    log = spark.createDataFrame([("1", 1, "h1"), ("1", 2, "h2"), ("2", 2, "h3")], "memory_id string, revision long, content_hash string")
    ids = spark.createDataFrame([("1",), ("1",), ("2",), ("gone",)], "id string")
    left, stones = H.forget(m, c, log, ids, F.lit(NOW))
    assert [(r["memory_id"], r["content_hash"], r["last_revision"]) for r in stones.collect()] == [("1", "h1", 1)]
    assert left.count() == 299 and left.where("id = '2'").count() == 1
    rel = spark.createDataFrame([("1", "2", "2"), ("2", "1", "1"), ("3", None, "x")], "src_memory_id string, dst_memory_id string, dst_ref string")
    out = W.cascade({"relationships": rel, "revisions": log, "concepts": c}, stones)
    assert sorted(map(tuple, out["relationships"].collect()), key=str) == [("2", None, "1"), ("3", None, "x")]
    assert out["revisions"].count() == 1 and out["concepts"].count() == 299
