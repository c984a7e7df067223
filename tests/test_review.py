"""Decisions of a review: which stand, and what they do to the tables."""

import json

from pyspark.sql import functions as F

from mnemospark import schemas
from mnemospark.operators import review as K

DECISION = "batch int, key string, action string, target string, content string, tags array<string>, reason string"


def decided(spark, rows, members=None, bodies=None, failures=None):
    """{id: (action, outcome, why)}; rows (batch, key, action, target?, content?), members {batch: ids}."""
    members = members or {1: ["a", "b", "c"]}
    m = spark.createDataFrame([(b, i, k) for b, ids in members.items() for k, i in enumerate(ids, 1)], "batch int, id string, place int")
    d = spark.createDataFrame([(*r, *[None] * (7 - len(r))) for r in rows], DECISION)
    memories = spark.createDataFrame([(i, (bodies or {}).get(i, "body of twenty chars"), None) for ids in members.values() for i in ids], "id string, content string, content_raw string")
    broken = spark.createDataFrame(failures, "id string, why string") if failures else None
    return {r["id"]: (r["action"], r["outcome"], r["why"]) for r in K.decide(m, d, memories, broken).collect()}


def test_a_bad_reply_fails_its_batch_only(spark):
    good = [(2, "x", "keep"), (2, "r2", "drop")]
    for bad, why in (
        ([(1, "r1", "keep"), (1, "zz", "keep"), (1, "c", "keep")], "unknown id"),
        ([(1, "r1", "keep"), (1, "a", "keep"), (1, "b", "keep"), (1, "c", "keep")], "duplicate decision"),
        ([(1, "r1", "keep"), (1, "r2", "keep")], "coverage mismatch"),
        ([], "coverage mismatch"),
        ([(1, "r1", "keep"), (1, "r2", "keep"), (1, "r3", "fly")], "unknown action"),
        ([(1, "r1", "keep"), (1, "r2", "keep"), (1, "r3", None)], "unknown action"),
        ([(1, "r01", "keep"), (1, "r2", "keep"), (1, "r3", "keep")], "unknown id"),
        ([(1, "r1", "keep"), (1, "r2", "extract", None, " \n"), (1, "r3", "keep")], "blank body"),
        ([(1, "r1", "keep"), (1, "r2", "supersede_by", None, None), (1, "r3", "keep")], "blank body"),
    ):
        got = decided(spark, bad + good, {1: ["a", "b", "c"], 2: ["x", "y"]})
        assert {got[i][1:] for i in "abc"} == {("failed", why)}, why
        assert got["x"][1] == "kept" and got["y"][1] == "dropped"


def test_an_id_wins_over_a_places_name(spark):
    got = decided(spark, [(1, "r1", "drop"), (1, "r2", "keep")], {1: ["r2", "r1"]})
    assert got["r1"][1] == "dropped" and got["r2"][1] == "kept"


def test_failures_reach_the_merges_into_them(spark):
    rows = [(1, "a", "merge_into", "r2"), (1, "b", "supersede_by", None, "short"), (1, "c", "merge_into", "a"), (1, "d", "merge_into", "e"), (1, "e", "keep")]
    members = {1: list("abcde")}
    fine = decided(spark, rows, members)
    # a merge into what is merged itself is no merge
    assert {i: r[1] for i, r in fine.items()} == {"a": "merged", "b": "superseded", "c": "kept", "d": "merged", "e": "kept"}
    lost = decided(spark, rows, members, failures=[("b", "embedding"), ("b", "gateway")])
    assert lost["b"][1:] == ("failed", "embedding") and lost["a"][1:] == ("failed", "merge target replacement failed") and lost["c"][1] == "kept"


def test_budgets_keep_the_target_and_its_sources(spark):
    rows = [(1, "a", "merge_into", "b"), (1, "b", "supersede_by", None, "x" * 31), (1, "c", "extract", None, "y" * 31)]
    got = decided(spark, rows)  # 20 + 20 characters give 30 at most, and so does one of 20
    assert {r[:2] for r in got.values()} == {("keep_original", "kept")}
    rows = [(1, "a", "merge_into", "b"), (1, "b", "supersede_by", None, "x" * 30), (1, "c", "extract", None, "y" * 30)]
    assert [r[1] for _, r in sorted(decided(spark, rows).items())] == ["merged", "superseded", "extracted"]


def state(spark):
    ids = ["keep", "drop", "old", "from", "part", "dep", "one", "two", "fail"]
    memories = spark.createDataFrame([(i, f"text of {i}", ["t"], "p", "note") for i in ids], "id string, content string, tags array<string>, project string, memory_type string")
    memories = schemas.conform(memories, "memories")
    concepts = schemas.conform(memories.select(F.col("id").alias("memory_id"), F.lit("Note").alias("concept_type"), F.concat(F.lit("title "), "id").alias("title"), F.lit("stable").alias("status"), F.lit('{"n":{"k":1}}').alias("extensions"), F.lit(4).alias("current_revision")), "concepts")
    return memories, concepts


def test_decisions_change_the_tables(spark):
    memories, concepts = state(spark)
    rows = [
        (1, "keep", "keep"), (1, "drop", "drop"), (1, "old", "supersede_by", None, "new text"), (1, "from", "merge_into", "old"), (1, "part", "extract", None, "part", ["u"]),
        (1, "dep", "deprecate", None, None, None, "stale"), (1, "one", "contradiction", "two", None, None, "differs"), (1, "two", "keep"), (1, "fail", "drop"),
    ]
    ids = [r[1] for r in rows]
    members = spark.createDataFrame([(1, i, k) for k, i in enumerate(ids, 1)], "batch int, id string, place int")
    d = spark.createDataFrame([(*r, *[None] * (7 - len(r))) for r in rows], DECISION)
    out = K.decide(members, d, memories, spark.createDataFrame([("fail", "gateway")], "id string, why string"))
    done = K.apply(out, memories, concepts, "curator", "v2", F.lit("2024-05-01 00:00:00").cast("timestamp"))
    new = {r["old"]: r["new"] for r in spark.createDataFrame([("old",), ("part",)], "old string").select("old", K.new_id(F.col("old")).alias("new")).collect()}
    m = {r["id"]: r for r in done.memories.collect()}
    assert set(m) == {"keep", "from", "dep", "one", "two", "fail", *new.values()}
    assert m["from"]["superseded_by"] == new["old"] and m[new["old"]]["content"] == "new text" and m[new["old"]]["tags"] == ["t"] and m[new["part"]]["tags"] == ["u"]
    assert m[new["old"]]["condenser_version"] == "v2" and m[new["old"]]["project"] == "p"
    c = {r["memory_id"]: r for r in done.concepts.collect()}
    assert set(c) == set(m) and c["dep"]["status"] == "deprecated" and json.loads(c["dep"]["extensions"]) == {"n": {"k": 1}, "deprecated_reason": "stale"}
    assert c[new["old"]]["title"] == "title old" and c[new["old"]]["generated_by"] == "curator" and c[new["old"]]["current_revision"] == 1
    edges = {(r["src_memory_id"], r["dst_ref"], r["relation"], r["reason"]) for r in done.edges.collect()}
    uri = "memory://project/p/"
    assert edges == {(new["old"], uri + "old", "derived_from", None), (new["old"], uri + "old", "supersedes", None), (new["part"], uri + "part", "derived_from", None), (new["old"], uri + "from", "derived_from", None), ("one", uri + "two", "contradicts", "differs")}
    assert {r["id"] for r in done.survivors.collect()} == {"keep", "one", "two", "fail", *new.values()}
    assert {r["id"] for r in done.disputed.collect()} == {"one", "two"} and [r["id"] for r in done.retry.collect()] == ["fail"]
    assert {(r["memory_id"], r["reason"]) for r in done.tombstones.collect()} == {("drop", "project review drop"), ("old", "dream_supersede"), ("part", "dream_extract")}
    condensed = spark.createDataFrame([("skip",), ("rewrite",), ("forget",), ("error_refused",)], "outcome string")
    counted = K.pass_counters(done.outcomes, condensed, members, spark.createDataFrame([("x", "y")], "older string, newer string")).first().asDict()
    assert counted == dict(zip(K.COUNTERS, [9, 1, 1, 1, 1, 2, 2, 1, 1, 1, 1, 1, 1])) and len(K.COUNTERS) == 13


def test_a_review_of_nothing(spark):
    memories, concepts = state(spark)
    out = K.decide(spark.createDataFrame([], "batch int, id string, place int"), spark.createDataFrame([], DECISION), memories)
    done = K.apply(out, memories, concepts, "curator", "v2", F.current_timestamp())
    assert out.count() == 0 and done.memories.count() == memories.count() and sum(K.review_counters(out).first()) == 0
