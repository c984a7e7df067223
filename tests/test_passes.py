from datetime import datetime

from pyspark.sql import functions as F

from mnemospark import schemas
from mnemospark.functions import render
from mnemospark.operators import curate as D
from mnemospark.operators import revisions as H

T0, NOW = datetime(2024, 1, 1), datetime(2024, 6, 1)


def table(spark):
    rows = [("a", "same text", "p", T0), ("b", "same text", "p", datetime(2024, 1, 2)), ("c", "long body here", "p", T0), ("d", "gone soon", None, T0)]
    df = spark.createDataFrame(rows, "id string, content string, project string, created_at timestamp").withColumn("updated_at", F.col("created_at"))
    return schemas.conform(df, "memories")


def test_a_pass_supersedes_condenses_and_stamps(spark):
    replies = spark.createDataFrame([("c", "short"), ("d", "forget"), ("b", "I cannot do that")], "id string, response string")
    state = schemas.empty(spark, "project_state")
    after, new_state, summary = D.curation_pass(table(spark), state, "v1", F.lit(NOW), replies)
    got = {r["id"]: r for r in after.collect()}
    assert set(got) == {"a", "b", "c"}
    assert got["a"]["superseded_by"] == "b" and got["b"]["condenser_version"] is None
    assert (got["c"]["content"], got["c"]["content_raw"], got["c"]["condenser_version"]) == ("short", "long body here", "v1")
    assert {r["project"] for r in new_state.collect()} == {"p", "__null__"}
    s = summary.first()
    assert (s["processed"], s["rewrite"], s["forget"], s["error_refused"]) == (3, 1, 1, 1)
    again, _, second = D.curation_pass(after, new_state, "v1", F.lit(NOW), None)
    assert second.first()["processed"] == 1  # only b is not stamped yet
    assert {r["id"] for r in again.collect()} == {"a", "b", "c"}


def test_replacement_carries_the_concept(spark):
    concepts = schemas.conform(spark.createDataFrame([("c", "T", "stable", "old title")], "memory_id string, concept_type string, status string, title string"), "concepts")
    new = spark.createDataFrame([("c", "new body")], "id string, new_body string")
    m, c, edges = D.replace(table(spark), concepts, new, F.lit(NOW))
    ids = {r["id"] for r in m.collect()}
    fresh = (ids - {"a", "b", "d"}).pop()
    assert "c" not in ids and {r["memory_id"]: r["title"] for r in c.collect()}[fresh] == "old title"
    assert sorted((r["src_memory_id"], r["relation"], r["dst_ref"]) for r in edges.collect()) == [(fresh, "derived_from", "memory://project/p/c"), (fresh, "supersedes", "memory://project/p/c")]


def test_references_need_their_scope(spark):
    links = spark.createDataFrame([(1, "memory://project/p/a"), (2, "memory://project/q/a"), (3, "a.md#x"), (4, "zz.md"), (5, "https://a.md/a"), (6, "memory://unscoped/d")], "src long, target string")
    got = {r["src"]: r["dst"] for r in H.resolve_references(links, table(spark)).collect()}
    assert got == {1: "a", 2: None, 3: "a", 4: None, 5: None, 6: "d"}


def test_one_run_at_a_time(tmp_path):
    path = str(tmp_path / "lock")
    with D.SingleRun(path) as first, D.SingleRun(path) as second:
        assert first and not second
    with D.SingleRun(path) as again:
        assert again


def test_rendering():
    rows = [{"id": "abcdefghij", "score": 0.5, "section": "project_memories", "content": "a <b>\n" + "x" * 300, "quality": 'h"'}]
    text = render.results(rows)
    assert text.startswith("<project_memories>") and 'id="abcdefgh"' in text and "&lt;b&gt;" in text and "&quot;" in text and "…" in text
    assert render.results([]) == "<no_results/>" and render.tag_cloud(["Arch", "arch", "b"]) == "<tags>Arch, b</tags>" and render.tag_cloud([]) == ""
    assert len(render.hints(2, 1)) == 2 and render.hints(0, 0) == []
