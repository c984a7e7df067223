"""Batched puts against a plain fold, and the canonical JSON of a document against Python's."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from mnemospark import schemas
from mnemospark.functions import semantic as S
from mnemospark.operators import put as P



def put(tables, documents, project):
    return P.put(tables, documents, project, F.lit("2024-05-01 00:00:00").cast("timestamp"))

NAMES = ["memories", "concepts", "sources", "verifications", "relationships", "tombstones"]


def tables(spark):
    return {n: schemas.empty(spark, n) for n in NAMES}


def after(done, before):
    return {"memories": done.memories, "concepts": done.concepts, "sources": done.sources, "verifications": done.verifications, "relationships": done.relationships, "tombstones": before["tombstones"]}


def frame(spark, rows):
    from pyspark.sql import types as T

    kinds = {"seq": "bigint", "target": "string", "id": "string", "scope": "string", "project": "string", "expected": "bigint", "dry_run": "boolean"} | P.DOCUMENT
    schema = T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in kinds.items()))
    return spark.createDataFrame([{k: r.get(k) for k in kinds} for r in rows], schema)


def results(done):
    return [(r["memory_id"], r["outcome"], r["revision"]) for r in done.results.orderBy("seq").collect()]


# --- canonical JSON ---


@pytest.mark.parametrize("value", [{"b": [1, {"y": None, "x": "é\"\\\n"}], "a": {}}, [], "text", 3, None, {"é": True, "z": {"k": {"j": 1, "i": [2]}}}])
def test_canonical_json_has_sorted_keys(spark, value):
    def shuffled(v):
        return {k: shuffled(v[k]) for k in reversed(list(v))} if isinstance(v, dict) else [shuffled(x) for x in v] if isinstance(v, list) else v

    rows = spark.createDataFrame([(json.dumps(value, indent=2),), (json.dumps(shuffled(value), ensure_ascii=False),)], "j string")
    got = {r[0] for r in rows.select(S.canonical(F.col("j"))).collect()}
    assert got == {json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)}


def test_what_is_no_json_counts_as_text(spark):
    rows = spark.createDataFrame([("not json",), (None,), ('{"a":1,"a":2}',)], "j string")
    assert [r[0] for r in rows.select(S.canonical(F.col("j"))).collect()] == ['"not json"', None, '"{\\"a\\":1,\\"a\\":2}"']


FULL = {
    "attester": '{"n":1}', "content": "body", "computation": '{"a":[1,2]}', "description": "d", "executor": '"e"', "extensions": '{"k":{"b":1,"a":2}}', "generated": '{"by":"x"}', "parameters": '[{"p":1}]', "resource": "r",
    "runtime": '{"r":0}', "sources": '[{"id":"s"}]', "stale_after": "2025-01-01", "status": "stable", "tags": ["t", "u"], "title": "T", "concept_type": "Type", "usage_window": '{"from":"a","to":"b"}', "verified": '[{"by":"v"}]', "agent_memory": '{"id":"m"}',
}


def test_each_of_the_19_fields_counts(spark):
    ddl = ", ".join(f"{c} {'array<string>' if c == 'tags' else 'string'}" for c in FULL)
    other = {c: (["u", "t"] if c == "tags" else v + "x" if S.SEMANTIC_FIELDS[f][1] == "text" else '{"other":1}') for f, (c, _) in S.SEMANTIC_FIELDS.items() for v in [FULL[c]]}
    rows = [FULL, {c: ' { "k" : {"a":2,"b":1} } ' if c == "extensions" else v for c, v in FULL.items()}, *({**FULL, c: other[c]} for c in FULL)]
    df = spark.createDataFrame([tuple(r[c] for c in FULL) for r in rows], ddl)
    parts = S.semantic_parts(dict(df.dtypes))
    got = [r[0] for r in df.select(S.semantic_hash(parts)).collect()]
    assert got[0] == got[1] and len(set(got)) == 20 and len(S.SEMANTIC_FIELDS) == 19
    want = {f: FULL[c] if kind == "text" else FULL[c] if c == "tags" else json.loads(FULL[c]) for f, (c, kind) in S.SEMANTIC_FIELDS.items()}
    assert got[0] == hashlib.sha256(json.dumps(want, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    one = df.limit(1).select(parts.alias("p"))
    fields = [d["field"] for d in one.select(S.semantic_diff(F.lit(None).cast("array<string>"), F.col("p"))).first()[0]]
    assert fields == sorted(S.SEMANTIC_FIELDS)


# --- the fold ---


def plain_fold(rows, held):
    """Outcomes of (memory_id, seq, refused, expected, dry_run, hash) in order; held: id -> (revision, hash, in_scope) and 'dead' ids."""
    state, dead = dict(held[0]), held[1]
    out = []
    for i, seq, refused, expected, dry, h in sorted(rows, key=lambda r: (r[0], r[1])):
        rev, old, scoped = state.get(i, (None, None, True))
        outcome = (
            refused or ("expected_of_new" if rev is None and expected is not None else "tombstoned" if rev is None and i in dead else "created" if rev is None else None)
            or ("scope" if not scoped else "conflict" if expected is not None and expected != rev else "unchanged" if h == old else "changed")
        )
        if outcome in ("created", "changed") and not dry:
            state[i] = ((rev or 0) + 1, h, True)
        out.append((i, seq, outcome, 1 if outcome == "created" else state.get(i, (None,))[0]))
    return out


def test_the_fold_equals_a_plain_one(spark):
    draw = random.Random(4)
    held = {f"m{i}": (draw.randrange(1, 5), draw.choice("abc"), draw.random() < 0.8) for i in range(20)}
    dead = {"n1", "n2"}
    rows = [(draw.choice([f"m{draw.randrange(20)}", f"n{draw.randrange(6)}", "m0", "m0"]), k, draw.choice([None] * 9 + ["read_only"]), draw.choice([None, None, 1, 2, 3, 4]), draw.random() < 0.2, draw.choice("abc")) for k in range(600)]
    df = spark.createDataFrame([(*r, *held.get(r[0], (None, None, None)), r[0] in dead) for r in rows], "memory_id string, seq long, refused string, expected long, dry_run boolean, hash string, revision long, state string, in_scope boolean, tombstoned boolean").repartition(5)
    got = sorted((r["memory_id"], r["seq"], r["outcome"], r["revision"]) for r in P.fold(df).collect())
    assert got == sorted(plain_fold(rows, (held, dead)))


# --- put ---


def document(seq, i, text, **more):
    return {"seq": seq, "id": i, "concept_type": "Note", "content": text, **more}


def test_put_creates_changes_and_refuses(spark):
    t = tables(spark)
    source = {"source_key": None, "resource": "src/a.py", "title": None, "author": None, "usage_count": 2, "usage_window_from": None, "usage_window_to": None, "last_modified": None, "metadata_json": '{"b":1,"a":2}'}
    first = frame(spark, [
        document(0, "a", "see [b](b.md)", tags=["x", "y"], sources=[source], verified=[{"actor": "v", "verified_at": "2024", "metadata_json": None}], extensions='{"k":{"b":1,"a":2}}'),
        document(1, "b", "two", generated_by="model", edges=[{"target": "a.md", "relation": "supports", "confidence": None}]),
        document(2, "b", "two", expected=1, generated_by="model", title="named", edges=[{"target": "a.md", "relation": "supports", "confidence": None}]),
        document(3, "b", "three", expected=1),
        document(4, "c", "new", expected=1),
        document(5, "d", "dry", dry_run=True),
        document(6, None, "no id"),
        document(7, "e", "x", target="/memories/f.md"),
        document(8, "index", "x", target="/index.md"),
        document(9, "g", "x", target="memory://project/other/g"),
        document(10, "h", "x", sources=[source | {"source_key": "k"}, source | {"source_key": "k"}]),
        document(11, "i", "x", scope="global"),
        document(12, "j", "x", target="memory://project/p/j", scope="project", project="p"),
    ])
    one = put(t, first, "p")
    outcomes = [r[1] for r in results(one)]
    assert outcomes == ["created", "created", "changed", "conflict", "expected_of_new", "created", "created", "id_mismatch", "read_only", "scope", "duplicate_source", "scope", "created"]
    stored = {r["id"]: r for r in one.memories.collect()}
    assert set(stored) >= {"a", "b", "j"} and len(stored) == 4 and "d" not in stored and stored["a"]["tags"] == ["x", "y"] and stored["b"]["agent"] == "model"
    assert {(r["memory_id"], r["revision"], r["parent_revision"]) for r in one.revisions.where("memory_id = 'b'").collect()} == {("b", 1, None), ("b", 2, 1)}
    assert {r["memory_id"]: r["current_revision"] for r in one.concepts.collect()}["b"] == 2
    edges = {(r["src_memory_id"], r["dst_memory_id"], r["dst_ref"], r["relation"], r["producer"]) for r in one.relationships.collect()}
    assert edges == {("a", "b", "b.md", "links_to", "markdown"), ("a", None, "src/a.py", "cites", "sources"), ("b", "a", "a.md", "supports", "document")}
    diffs = {r["seq"]: [d["field"] for d in r["diff"]] for r in one.results.where("diff IS NOT NULL").collect()}
    assert diffs[2] == ["title"] and set(diffs[0]) == {"body", "extensions", "sources", "status", "tags", "type", "verified", "x-agent-memory"} and 5 in diffs

    t = after(one, t) | {"tombstones": spark.createDataFrame([("t", "gone")], "id string, memory_id string").select(*(F.col(c) if c in ("id", "memory_id") else F.lit(None).cast(f.dataType).alias(c) for c, f in ((f.name, f) for f in schemas.schema("tombstones"))))}
    again = frame(spark, [
        # the same document with other white space and order of keys is the same
        document(0, "a", "see [b](b.md)", tags=["x", "y"], sources=[source | {"metadata_json": '{"b":1,"a":2}'}], verified=[{"actor": "v", "verified_at": "2024", "metadata_json": None}], extensions=' {"k": {"a":2, "b":1}} '),
        document(1, "b", "three", expected=2, target="/memories/b.md"),
        document(2, "b", "four", expected=3),
        document(3, "gone", "back"),
        document(4, "a", "seen", dry_run=True),
        document(5, "a", "seen", expected=1),
    ])
    two = put(t, again, "p")
    assert results(two) == [("a", "unchanged", 1), ("b", "changed", 3), ("b", "changed", 4), ("gone", "tombstoned", None), ("a", "changed", 1), ("a", "changed", 2)]
    rows = {r["id"]: r for r in two.memories.collect()}
    assert rows["b"]["content"] == "four" and rows["b"]["content_raw"] == "two" and rows["a"]["content_raw"] == "see [b](b.md)"
    assert two.verifications.count() == 0 and two.sources.count() == 0 and {r["memory_id"] for r in two.touched.collect()} == {"a", "b"}
    # the stored state means what the last revision says
    held = P.stored_documents(two.memories, two.concepts, two.sources, two.verifications, two.relationships)
    parts = S.semantic_parts({**P.DOCUMENT, "agent_memory": "string", "generated": "string"})
    state = {r["memory_id"]: r["h"] for r in P.normal(held, "p").select("memory_id", S.semantic_hash(parts).alias("h")).collect()}
    assert {r["memory_id"]: r["content_hash"] for r in two.revisions.collect() if (r["memory_id"], r["revision"]) in (("a", 2), ("b", 4))} == {k: state[k] for k in "ab"}
    # another bundle may not write here
    assert results(put(after(two, t), frame(spark, [document(0, "a", "x")]), None)) == [("a", "scope", 2)]


def test_put_of_nothing(spark):
    t = tables(spark)
    none = put(t, frame(spark, []), "p")
    assert none.results.count() == 0 and none.memories.count() == 0 and none.memories.schema == t["memories"].schema
