"""Bundles as files and snapshots in pages."""

import json
import os

import pytest
from pyspark.sql import functions as F

from mnemospark import schemas
from mnemospark.operators import put as P
from mnemospark.sources import bundle_files as B
from mnemospark.sources import pages as G

NAMES = ["memories", "concepts", "sources", "verifications", "relationships", "revisions", "tombstones"]


def now():
    return F.lit("2024-05-01 00:00:00").cast("timestamp")


def stored(spark, project="p"):
    """A few memories, put as documents."""
    t = {n: schemas.empty(spark, n) for n in NAMES}
    source = {"source_key": "s", "resource": "src/a.py", "title": "A", "author": None, "usage_count": 2, "usage_window_from": None, "usage_window_to": None, "last_modified": None, "metadata_json": None}
    rows = [
        {"seq": 0, "id": "a", "concept_type": "Note", "title": "first", "content": "see [b](b.md)\n", "tags": ["x", "y"], "sources": [source], "generated_by": "model", "generated_at": "2024"},
        {"seq": 1, "id": "b", "concept_type": "Note", "content": "---\ntext: é\n", "edges": [{"target": "a.md", "relation": "supports", "confidence": "asserted"}], "verified": [{"actor": "v", "verified_at": "2024-01-01", "metadata_json": None}]},
        {"seq": 2, "id": "c", "concept_type": "Rule", "title": "third", "content": "", "extensions": '{"k":{"a":1}}', "description": "what it is"},
    ]
    from pyspark.sql import types as T

    kinds = {"seq": "bigint", "id": "string"} | P.DOCUMENT
    df = spark.createDataFrame([{k: r.get(k) for k in kinds} for r in rows], T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in kinds.items())))
    return after(P.put(t, df, project, now()), t)


def after(done, t):
    fixed = {"memories": done.memories, "concepts": done.concepts, "sources": done.sources, "verifications": done.verifications, "relationships": done.relationships, "tombstones": t["tombstones"]}
    return fixed | {"revisions": t["revisions"].unionByName(done.revisions.select(*t["revisions"].columns))}


def files(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(root) for f in fs}


def outcomes(told):
    return {os.path.basename(r["path"]): r["outcome"] for r in told.collect()}


def test_export_dry_run_round_trip_and_compare_and_swap(spark, tmp_path):
    t = stored(spark)
    root = str(tmp_path / "bundle")
    assert B.export_bundle(t, root, F.lit("2024-05-01").cast("date"), dry_run=True) == 3 and not os.path.exists(root)
    assert B.export_bundle(t, root, F.lit("2024-05-01").cast("date")) == 3
    got = files(root)
    assert set(got) == {"memories/a.md", "memories/b.md", "memories/c.md", "index.md", "log.md"}
    assert got["memories/b.md"].decode().endswith("---\n---\ntext: é\n") and b"## Note" in got["index.md"] and got["log.md"].count(b"put") == 3
    assert os.listdir(tmp_path) == ["bundle"]
    # the same tables give the same files
    B.export_bundle(t, str(tmp_path / "again"), F.lit("2024-05-01").cast("date"))
    assert files(str(tmp_path / "again")) == got
    with pytest.raises(ValueError):
        B.export_bundle(t, root, F.lit("2024-05-01").cast("date"))

    empty = {n: schemas.empty(spark, n) for n in NAMES}
    new, told = B.import_bundle(empty, root, "p", now())
    assert outcomes(told) == {"a.md": "created", "b.md": "created", "c.md": "created"}
    same, told = B.import_bundle(t, root, "p", now())
    assert set(outcomes(told).values()) == {"unchanged"} and same.revisions.count() == 0
    back = after(new, empty)
    assert {r["id"]: r["content"] for r in back["memories"].collect()} == {r["id"]: r["content"] for r in t["memories"].collect()}

    with open(f"{root}/memories/a.md", "ab") as f:
        f.write(b"more\n")
    dry, told = B.import_bundle(t, root, "p", now(), dry_run=True)
    assert outcomes(told)["a.md"] == "changed" and dry.revisions.count() == 0
    one, told = B.import_bundle(t, f"{root}/memories/a.md", "p", now())
    assert outcomes(told) == {"a.md": "changed"}
    newer = after(one, t)
    # the file's revision is the old one by now
    with open(f"{root}/memories/a.md", "ab") as f:
        f.write(b"and more\n")
    assert outcomes(B.import_bundle(newer, root, "p", now())[1]) == {"a.md": "conflict", "b.md": "unchanged", "c.md": "unchanged"}


def test_an_import_rejects_and_blocks(spark, tmp_path):
    os.makedirs(tmp_path / "memories" / "deeper")
    for name, text in {"bad.md": "no frontmatter", "key.md": "---\ntype: T\n---\napi_key=abc sk-abcdefghijklmnopqrstuvwxyz123456 -----BEGIN PRIVATE KEY-----", "ok.md": "---\ntype: T\nid: ok\nrevision: 7\n---\nfine", "other.md": "---\ntype: T\nid: ok2\n---\nx", "far.md": "---\ntype: T\nscope: global\n---\nx", "deeper/no.md": "---\ntype: T\n---\nx"}.items():
        (tmp_path / "memories" / name).write_text(text)
    t = {n: schemas.empty(spark, n) for n in NAMES}
    _, told = B.import_bundle(t, str(tmp_path), "p", now())
    assert outcomes(told) == {"bad.md": "rejected", "key.md": "blocked", "ok.md": "created", "other.md": "id_mismatch", "far.md": "scope"}


def test_a_failed_export_leaves_nothing(spark, tmp_path):
    t = stored(spark)
    for change in (F.lit("../up"), F.lit("same"), F.lit(".hid")):
        bad = t | {"memories": t["memories"].withColumn("id", change)}
        with pytest.raises(ValueError):
            B.export_bundle(bad, str(tmp_path / "x"), F.lit("2024-05-01").cast("date"))
    secret = t | {"memories": t["memories"].withColumn("content", F.lit("-----BEGIN PRIVATE KEY-----"))}
    with pytest.raises(ValueError):
        B.export_bundle(secret, str(tmp_path / "x"), F.lit("2024-05-01").cast("date"))
    # a task that fails after others wrote
    spark.dataSource.register(B.BundleSource)
    rows = spark.range(40).select(F.concat(F.lit("memories/"), "id", F.lit(".md")).alias("path"), F.when(F.col("id") == 33, F.raise_error(F.lit("broken"))).otherwise("x").alias("document")).repartition(4)
    with pytest.raises(Exception, match="broken"):
        rows.write.format(B.FORMAT).mode("append").save(str(tmp_path / "x"))
    assert os.listdir(tmp_path) == []


# --- pages ---


def write_pages(root, pages):
    """pages: (token, next or None, has_more, rows)."""
    os.makedirs(root, exist_ok=True)
    for token, following, more, rows in pages:
        with open(f"{root}/{token}.jsonl", "w") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows)
        with open(f"{root}/{token}.json", "w") as f:
            json.dump({"next": following, "has_more": more}, f)


def row(i, rev=None, **more):
    return {"gateway_memory_id": f"g{i}", "server_revision": rev or i, "content": f"text {i}", "content_hash": f"h{i}", "project": "p", "tombstone": False} | more


def test_a_snapshot_follows_its_pages(spark, tmp_path):
    spark.dataSource.register(G.PagesSource)
    good = str(tmp_path / "good")
    write_pages(good, [("start", "20", True, [row(1), row(2)]), ("20", "30", True, []), ("30", None, False, [row(3)])])
    df = spark.read.format(G.FORMAT).load(good)
    assert sorted(r["gateway_memory_id"] for r in df.collect()) == ["g1", "g2", "g3"] and df.rdd.getNumPartitions() == 3
    for name, pages, what in (
        ("stuck", [("start", "start", True, [])], "does not advance"),
        ("blank", [("start", None, True, [])], "does not advance"),
        ("circle", [("start", "2", True, []), ("2", "3", True, []), ("3", "2", True, [])], "goes back"),
    ):
        write_pages(str(tmp_path / name), pages)
        with pytest.raises(Exception, match=what):
            spark.read.format(G.FORMAT).load(str(tmp_path / name)).collect()


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    spark.dataSource.register(G.PagesSource)
    root, out, point = (str(tmp_path / n) for n in ("pages", "out", "point"))
    write_pages(root, [("start", "2", True, [row(1)]), ("2", "3", True, [row(2)]), ("3", None, False, [row(3)])])

    def run():
        q = spark.readStream.format(G.FORMAT).load(root).writeStream.format("parquet").option("checkpointLocation", point).trigger(availableNow=True).start(out)
        q.awaitTermination(120)
        return sorted(r["gateway_memory_id"] for r in spark.read.parquet(out).collect())

    assert run() == ["g1", "g2", "g3"] == run()
    write_pages(root, [("3", "4", True, [row(3)]), ("4", None, False, [row(4)])])
    assert run() == ["g1", "g2", "g3", "g4"] and run() == ["g1", "g2", "g3", "g4"]


def test_the_cursor_moves_only_without_conflicts(spark, tmp_path):
    spark.dataSource.register(G.PagesSource)
    root = str(tmp_path / "pages")
    write_pages(root, [("start", "2", True, [row(1, 5), row(2, 6)]), ("2", None, False, [row(9, 7)])])
    remote = spark.read.format(G.FORMAT).load(root)
    mapping = schemas.conform(spark.createDataFrame([("l1", "p", "g1", 3, "old"), ("l2", "q", "g2", 3, "old")], "local_memory_id string, project string, gateway_memory_id string, last_seen_server_revision long, last_pulled_content_hash string"), "gateway_sync")
    state = schemas.conform(spark.createDataFrame([("q", 2)], "project string, last_pull_server_revision long"), "pull_state")
    local = lambda h: spark.createDataFrame([("l1", h), ("l9", "h9")], "id string, content_hash string")
    plan, mappings, moved = G.pull(remote, mapping, local("edited here"), state, "p", now())
    assert {r["gateway_memory_id"]: r["action"] for r in plan.collect()} == {"g1": "conflict", "g2": "import", "g9": "link"}
    assert {r["project"]: r["last_pull_server_revision"] for r in moved.collect()} == {"q": 2}
    plan, mappings, moved = G.pull(remote, mapping, local("old"), state, "p", now())
    assert {r["gateway_memory_id"]: r["action"] for r in plan.collect()} == {"g1": "update", "g2": "import", "g9": "link"}
    assert {r["project"]: r["last_pull_server_revision"] for r in moved.collect()} == {"q": 2, "p": 7}
    assert {r["local_memory_id"]: (r["project"], r["last_seen_server_revision"], r["last_pulled_content_hash"]) for r in mappings.collect()} == {"l1": ("p", 5, "h1"), "l2": ("q", 3, "old"), "l9": ("p", 7, "h9")}
