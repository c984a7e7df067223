import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mnemospark import schemas
from mnemospark.functions import predicates as P
from mnemospark.operators import revisions as H
from mnemospark.plans import models
from mnemospark.plans import sync as Y
from mnemospark.sources import documents as doc
from mnemospark.streaming.context import append_text

T0, NOW = datetime(2024, 1, 1), datetime(2024, 6, 1)


@pytest.fixture(scope="module")
def memories(spark):
    rows = [("aaaa1", "one", ["b", "a", "a"], "p", T0, T0, 0, None), ("aaaa2", "two", ["A%"], "__global__", T0, NOW, 3, None), ("bbbb1", "three", None, None, T0, T0, 0, "aaaa1")]
    df = spark.createDataFrame(rows, "id string, content string, tags array<string>, project string, created_at timestamp, updated_at timestamp, access_count long, superseded_by string")
    return schemas.conform(df, "memories")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_schemas_round_trip(spark, memories, tmp_path):
    for name in schemas.tables():
        assert schemas.empty(spark, name).count() == 0
    memories.write.parquet(f"{tmp_path}/memories")
    back = schemas.open_table(spark, str(tmp_path), "memories")
    assert back.schema == schemas.schema("memories") and ids(back) == ids(memories)


def test_predicates(spark, memories):
    now = F.lit(NOW)
    assert ids(P.prune_candidates(memories, now)) == ["aaaa1"]
    assert ids(P.recall(memories, tags=("a",))) == ["aaaa1"] and ids(P.recall(memories, tags=("A_",), like=True)) == ["aaaa2"]
    assert [tuple(r)[:2] for r in P.resolve_prefix(memories, "aaaa1").collect()] == [("aaaa1", 0)]
    assert [r["matches"] for r in P.resolve_prefix(memories, "aaaa").collect()] == [2, 2]
    assert [tuple(r)[:2] for r in P.resolve_prefix(memories, "bbbb").collect()] == [("bbbb1", 2)] and P.resolve_prefix(memories, "zzzz").count() == 0
    with pytest.raises(ValueError):
        P.resolve_prefix(memories, "aaa")
    s = spark.createDataFrame([("2024-05-01T00:00:00Z",), ("2024-05-01",), ("nonsense",), (None,)], "s string")
    assert [r["x"] for r in s.select(P.stale_in_search(F.col("s"), now).alias("x")).collect()] == [True, False, False, False]
    assert [r["x"] for r in s.select(P.stale_in_index(F.col("s"), F.lit("2024-06-01")).alias("x")).collect()] == [True, True, False, False]


def test_snapshots_ignore_order_and_keep_nulls(memories):
    got = {r["id"]: r for r in H.with_hash(memories).collect()}
    assert '"tags":["a","b"]' in got["aaaa1"]["snapshot_json"] and '"agent":null' in got["aaaa1"]["snapshot_json"]
    assert len(got["aaaa1"]["content_hash"]) == 64


def test_updates_supersession_and_scopes(spark, memories):
    up = spark.createDataFrame([("aaaa1", "new"), ("bbbb1", "three")], "id string, new_content string")
    got = {r["id"]: r for r in H.update_content(memories, up, F.lit(NOW)).collect()}
    assert (got["aaaa1"]["content"], got["aaaa1"]["content_raw"]) == ("new", "one")
    assert got["bbbb1"]["superseded_by"] is None and got["bbbb1"]["content_raw"] is None
    done = {r["id"]: r for r in H.supersede(memories, spark.createDataFrame([("aaaa1", "aaaa2")], "older string, newer string")).collect()}
    assert done["aaaa1"]["superseded_by"] == "aaaa2" and done["aaaa1"]["updated_at"] == T0
    moved, edges = H.move(memories, "p", "q")
    assert {r["id"]: r["project"] for r in moved.collect()}["aaaa1"] == "q" and edges.first()["dst_ref"] == "memory://project/p/aaaa1"
    with pytest.raises(ValueError):
        H.move(memories, "p", "__global__")
    copies, links = H.copy(memories, "p", None, F.lit(NOW))
    row = copies.first()
    assert row["project"] is None and row["access_count"] == 0 and links.first()["dst_memory_id"] == "aaaa1"


def test_publish_points_to_the_last_version(spark, memories, tmp_path):
    H.publish(spark, memories, str(tmp_path), "memories")
    H.publish(spark, memories.limit(1), str(tmp_path), "memories")
    assert H.latest(spark, str(tmp_path), "memories").count() == 1
    assert sorted(x for x in os.listdir(f"{tmp_path}/memories") if x.startswith("done")) == ["done_1", "done_2"]


def test_contexts(spark):
    rows = spark.createDataFrame([("p", 1, "a\n"), ("p", 2, "b\n\n"), ("p", 3, "c"), ("q", 1, "")], "project string, seq int, text string")
    got = {r["project"]: r for r in H.append_context(rows, "project", "seq", "text").collect()}
    want = append_text(append_text(append_text("", "a\n"), "b\n\n"), "c")
    assert got["p"]["content"] == want and got["p"]["version"] == 3 and not got["p"]["too_long"]
    ctx = spark.createDataFrame([("p", "x", 1, T0), ("q", "y", 1, T0)], "project string, content string, version long, updated_at timestamp")
    with pytest.raises(ValueError):
        H.move_context(ctx, "p", "q", F.lit(NOW))
    assert sorted(r["project"] for r in H.move_context(ctx, "p", "r", F.lit(NOW)).collect()) == ["q", "r"]
    assert [r["project"] for r in H.move_context(ctx, "p", None, F.lit(NOW)).collect()] == ["q"]


def test_working_context_stream(spark, tmp_path):
    from mnemospark.streaming.context import working_contexts

    schema = "project string, seq int, text string"
    spark.createDataFrame([("p", 1, "a"), ("p", 2, "b")], schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = working_contexts(stream).writeStream.format("memory").queryName("ctx").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("ctx").collect()[-1]["content"] == "## Ammendment 1\na\n\n## Ammendment 2\nb"


def test_import_plan_and_export(spark, memories, tmp_path):
    os.makedirs(f"{tmp_path}/memories")
    for name, body in (("aaaa1", "one"), ("aaaa2", "changed"), ("new1", "x"), ("bad1", "API_KEY=1")):
        with open(f"{tmp_path}/memories/{name}.md", "w") as f:
            f.write(f"---\nid: {name}\ntype: t\n---\n{body}")
    read = doc.read_bundle(spark, str(tmp_path))
    assert {r["id"]: r["outcome"] for r in doc.import_plan(read, memories).collect()} == {"aaaa1": "unchanged", "aaaa2": "updated", "new1": "created", "bad1": "blocked"}
    rows = read.where("id <> 'bad1'")
    doc.export(rows, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
    with pytest.raises(Exception):
        doc.export(rows, f"{tmp_path}/out")


def test_models_and_sync(spark):
    df = spark.createDataFrame([("q a", "a b"), ("q", None)], "q string, d string")
    got = df.select(models.embed(models.HashEmbedder, F.col("d")).alias("e"), models.rerank(models.OverlapReranker, F.col("q"), F.col("d")).alias("r"), models.generate(models.FixedGenerator, F.col("q")).alias("g")).collect()
    assert len(got[0]["e"]) == 64 and got[0]["r"] == 0.0 and got[0]["g"] == "KEEP_UNCHANGED"
    plan = spark.createDataFrame([("link",), ("conflict",)], "action string")
    assert Y.may_advance(plan).first()["advance"] is False
    m = spark.createDataFrame([("a", "old", T0), ("b", "x", T0)], "local_memory_id string, v string, updated_at timestamp")
    n = spark.createDataFrame([("a", "new", T0)], "local_memory_id string, v string, updated_at timestamp")
    assert {r["local_memory_id"]: r["v"] for r in Y.upsert_mappings(m, n).collect()} == {"a": "new", "b": "x"}
