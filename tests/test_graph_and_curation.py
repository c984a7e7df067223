import random
from collections import deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import curate as D
from mnemospark.operators import graph as G
from mnemospark.operators.groups import connected


def walk(edges, root, direction, depth, fan, cap):
    """A plain breadth-first walk."""
    out, queue = [], deque([[root]])
    while queue:
        path = queue.popleft()
        if len(path) > depth:
            continue
        node = path[-1]
        near = [(r, d, d) for s, d, r in sorted(edges, key=lambda e: (e[2], e[1])) if s == node and direction != "in"][:fan]
        if direction != "out" and len(near) < fan:
            near += [(r, s, s) for s, d, r in sorted(edges, key=lambda e: (e[2], e[0])) if d == node][: fan - len(near)]
        for _, n, _ in near:
            cycle = n in path
            out.append(("/".join([*path, n]), cycle))
            if len(out) >= cap:
                return out
            if not cycle:
                queue.append([*path, n])
    return out


def test_traverse_equals_a_plain_walk(spark):
    rnd = random.Random(5)
    edges = sorted({(f"n{rnd.randrange(12)}", f"n{rnd.randrange(12)}", rnd.choice(["cites", "links_to"])) for _ in range(40)})
    df = spark.createDataFrame([(f"{s}{d}{r}", s, d, d, r, "p", None, 1) for s, d, r in edges], "id string, src_memory_id string, dst_memory_id string, dst_ref string, relation string, producer string, ordinal long, source_revision long")
    for direction in ("out", "in", "both"):
        for fan, cap in ((3, 300), (12, 7)):
            roots = spark.createDataFrame([("n0",)], "root string")
            paths, _ = G.traverse(df, roots, direction, (), 3, fan, cap)
            got = [("/".join(r["nodes"]), r["cycle"]) for r in paths.orderBy("ord").collect()]
            assert got == walk(edges, "n0", direction, 3, fan, cap), (direction, fan, cap)


def plain_walks(edges, roots, direction, relations, depth, fan, cap):
    """(paths, diagnostics, truncated) of a queue; edges (id, src, dst or None, ref, relation)."""
    paths, lost, truncated = [], set(), False
    queue = deque([r] for r in roots)
    while queue:
        path = queue.popleft()
        if len(path) > depth:
            continue
        node = path[-1]
        near = [(r, d, ref) for i, s, d, ref, r in sorted(edges, key=lambda e: (e[4], e[3], e[0])) if s == node and direction != "in"][:fan]
        if direction != "out":
            near += [(r, s, ref) for i, s, d, ref, r in sorted(edges, key=lambda e: (e[4], e[1], e[0])) if d == node][: fan - len(near)]
        truncated |= len(near) == fan
        for relation, other, ref in near:
            if relations and relation not in relations:
                continue
            if other is None:
                lost.add((node, relation, ref))
                continue
            paths.append(("/".join([*path, other]), other in path))
            if len(paths) >= cap:
                return paths, lost, True
            if other not in path:
                queue.append([*path, other])
    return paths, lost, truncated


def test_bounded_walks_equal_a_queue(spark):
    rnd = random.Random(8)
    edges = [(f"e{k:03d}", f"n{rnd.randrange(14)}", None if rnd.random() < 0.25 else f"n{rnd.randrange(14)}", f"ref{rnd.randrange(9)}", rnd.choice(["cites", "links_to"])) for k in range(70)]
    edges = [(i, s, d, d or ref, r) for i, s, d, ref, r in edges]
    df = spark.createDataFrame([(i, s, d, ref, r, "p", None, 1) for i, s, d, ref, r in edges], "id string, src_memory_id string, dst_memory_id string, dst_ref string, relation string, producer string, ordinal long, source_revision long")
    walks = {0: ["n0"], 1: ["n3", "n1"], 2: ["nowhere"], 3: ["n5"]}
    roots = spark.createDataFrame([(q, r, k) for q, rs in walks.items() for k, r in enumerate(rs)], "query_id int, root string, position int")
    for direction, relations, depth, fan, cap in (("both", (), 3, 4, 25), ("out", ("cites",), 8, 100, 1000), ("in", (), 2, 2, 3), ("both", ("links_to",), 4, 3, 1), ("out", (), 0, 5, 5)):
        got = G.bounded_walks(df, roots, direction, relations, depth, fan, cap)
        paths, lost, cut = got.paths.orderBy("query_id", "ord").collect(), got.diagnostics.collect(), {r["query_id"]: r["truncated"] for r in got.truncated.collect()}
        for q, own in walks.items():
            want = plain_walks(edges, own, direction, relations, depth, fan, cap)
            mine = [r for r in paths if r["query_id"] == q]
            assert [("/".join(r["nodes"]), r["cycle"]) for r in mine] == want[0] and [r["ord"] for r in mine] == list(range(1, len(mine) + 1))
            assert {tuple(r)[1:] for r in lost if r["query_id"] == q} == want[1] and cut[q] == want[2], (direction, q)


def test_a_deep_walk_over_a_dense_graph_ends(spark):
    """Eight levels of a hundred edges each: 10^16 paths, of which a thousand are looked at."""
    n = spark.range(120).crossJoin(spark.range(120).withColumnRenamed("id", "j"))
    df = n.select(F.concat("id", F.lit(">"), "j").alias("id"), F.col("id").cast("string").alias("src_memory_id"), F.col("j").cast("string").alias("dst_memory_id"), F.col("j").cast("string").alias("dst_ref"), F.lit("cites").alias("relation"), F.lit("p").alias("producer"), F.lit(None).cast("long").alias("ordinal"))
    got = G.bounded_walks(df, spark.createDataFrame([("7",)], "root string"), "out", (), 8, 100, 1000)
    assert got.paths.count() == 1000 and got.truncated.collect()[0]["truncated"]


def test_unresolved_edges_and_repeats(spark):
    schema = "id string, src_memory_id string, dst_memory_id string, dst_ref string, relation string, producer string, ordinal long, source_revision long, created_at timestamp"
    now = datetime(2024, 1, 1)
    df = spark.createDataFrame([("1", "a", None, "ext", "cites", "p", None, 1, now), ("2", "a", "b", "b", "cites", "p", None, 1, now)], schema)
    paths, lost = G.traverse(df, spark.createDataFrame([("a",)], "root string"), "out", (), 2)
    assert [r["node"] for r in paths.collect()] == ["b"] and [tuple(r)[1:] for r in lost.collect()] == [("a", "cites", "ext")]
    new = spark.createDataFrame([("3", "a", "b", "b", "cites", "p", None, 1, now), ("4", "a", "c", "c", "cites", "p", None, 1, now)], schema)
    assert sorted(r["id"] for r in G.insert_edges(df, new).collect()) == ["1", "2", "4"]
    assert G.truncated(df, spark.createDataFrame([("a",), ("q",)], "node string"), "out", 2).orderBy("node").collect()[0]["truncated"]


def test_connected_groups(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 450)]
    pairs = [(a, b) for a, b in pairs if a != b]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_near_pairs_over_tiles_and_greedy_walk(spark):
    rnd = random.Random(3)
    vectors = [[rnd.gauss(0, 1), rnd.gauss(0, 1), rnd.gauss(0, 1)] for _ in range(80)]
    start = datetime(2024, 1, 1)
    rows = spark.createDataFrame([(i, v, "g" if i % 3 else None, None, start + timedelta(minutes=i // 2)) for i, v in enumerate(vectors)], "id long, embedding array<float>, label string, superseded_by string, created_at timestamp")
    before, D.TILE = D.TILE, 16
    try:
        got = {(r["a"], r["b"]): r["score"] for r in D.near_pairs(rows, 0.95, ["label"]).collect()}
        folded = sorted(tuple(r) for r in D.greedy_dedup(D.near_pairs(rows, 0.95, ["label"]), rows).collect())
    finally:
        D.TILE = before
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)
    want = {(i, j): cos(vectors[i], vectors[j]) for i in range(80) for j in range(i + 1, 80) if (i % 3 == 0) == (j % 3 == 0) and cos(vectors[i], vectors[j]) >= 0.95}
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-6 for p in want)
    gone, plain = set(), []
    at = lambda i: (i // 2, i)
    for x in range(80):
        peers = [(-got[min(x, y), max(x, y)], at(y)) for y in range(80) if (min(x, y), max(x, y)) in got and y not in gone and y != x]
        if x not in gone and peers:
            y = min(peers)[1][1]
            older, newer = sorted((x, y), key=at)
            gone.add(older)
            plain.append((older, newer))
    assert folded == sorted(plain)


def test_cluster_and_budgets(spark):
    t = datetime(2024, 1, 1)
    rows = [("a", "p", ["x", "y"], t), ("b", "p", ["y", "x", "z"], t + timedelta(days=14, hours=23)), ("c", "p", ["x", "y"], t + timedelta(days=16)), ("d", "p", ["x"], t), ("e", None, None, None)]
    df = spark.createDataFrame(rows, "id string, project string, tags array<string>, updated_at timestamp")
    got = {r["id"]: r["cluster"] for r in D.cluster(df).collect()}
    assert got["a"] == got["b"] != got["c"] and got["e"] == 0 and got["d"] != got["a"]
    part = df.withColumn("content", F.lit("é" * 100)).withColumn("superseded_by", F.lit(None).cast("string"))
    assert {r["project"]: r["whole"] for r in D.review_partition(part, 3, 1_000).collect()} == {"p": False, None: True}


def plain_clusters(rows):
    """A walk over (id, project, tags, at, stamped) of all projects."""
    out, heads = {}, {}
    far = datetime.max
    for i, project, tags, at, stamped in sorted(rows, key=lambda r: (r[3] is None, r[3] or far, r[0])):
        own = heads.setdefault(project, [])
        for k, (had, when, mark) in enumerate(own):
            near = stamped or mark or (at is not None and when is not None and abs(at - when) < timedelta(days=15))
            if near and sum(t in had for t in tags or [] if t is not None) >= 2:
                out[i] = k
                break
        else:
            own.append((set(tags or []), at, stamped))
            out[i] = len(own) - 1
    return out


def test_clusters_in_rounds_equal_a_plain_walk(spark):
    rnd = random.Random(11)
    for n, words, days, marks in ((300, "abcdef", 90, 0.0), (300, "abcd", 400, 0.03), (200, "abcdefghijkl", 30, 0.3), (40, "ab", 200, 0.0)):
        rows = []
        for i in range(n):
            tags = rnd.choice([None, [], [rnd.choice(words)] * 2, rnd.choices(words, k=rnd.randrange(1, 5)), rnd.choices([*words, None], k=3)])
            at = None if rnd.random() < 0.05 else datetime(2024, 1, 1) + timedelta(hours=rnd.randrange(days * 24))
            rows.append((f"i{i:04d}", rnd.choice(["p", "p", "q", None]), tags, at, rnd.random() < marks))
        df = spark.createDataFrame(rows, "id string, project string, tags array<string>, updated_at timestamp, stamped boolean").repartition(3)
        assert {r["id"]: r["cluster"] for r in D.cluster(df).collect()} == plain_clusters(rows), (n, words)


def test_clusters_of_nothing(spark):
    df = spark.createDataFrame([], "id string, project string, tags array<string>, updated_at timestamp")
    assert D.cluster(df).collect() == []


def test_parse_decisions():
    ids = ["m1", "m2"]
    ok = '```json\n{"decisions": {"r1": {"action": "merge_into", "target_id": "r2"}, "m2": {"action": "keep"}}}\n```'
    assert D.parse_decisions(ok, ids) == [{"id": "m1", "action": "merge_into", "target": "m2", "content": None}, {"id": "m2", "action": "keep", "target": None, "content": None}]
    for bad in (None, "", "x", "{}", '{"decisions": {"r1": {"action": "keep"}}}', '{"decisions": {"r1": {"action": "keep"}, "m1": {"action": "keep"}}}', '{"decisions": {"zz": {"action": "keep"}, "m2": {"action": "keep"}}}'):
        assert D.parse_decisions(bad, ids) is None


def test_a_blank_replacement_keeps_the_original(spark):
    from mnemospark.operators import curate

    memories = spark.createDataFrame([("a", "an own text", None), ("b", "another text", None)], "id string, content string, content_raw string")
    decisions = spark.createDataFrame([(1, "a", "supersede_by", None, "  "), (1, "b", "supersede_by", None, "other")], "batch int, id string, action string, target string, content string")
    got = {r["id"]: r["action"] for r in curate.length_budget(decisions, memories).collect()}
    assert got == {"a": "keep_original", "b": "supersede_by"}


@pytest.mark.parametrize("seed, values, blocks", [(1, 30, 0), (2, 200, 99)])
def test_dedup_near_equals_the_walk(spark, monkeypatch, seed, values, blocks):
    """The walk, row by row, over pairs with ties, copies, unequal lengths, null times and rows that are no vectors; no pair is made, no group folded."""
    monkeypatch.setattr(D, "PEER_VALUES", values)
    monkeypatch.setattr(D, "BROADCAST_BLOCKS", blocks)
    monkeypatch.setattr(D, "TILE", 5)
    rnd = random.Random(seed)
    vectors = [[rnd.gauss(0, 1), rnd.gauss(0, 1), rnd.gauss(0, 1)][: 3 if i % 7 else 2] for i in range(120)]
    for i in range(0, 120, 4):
        vectors[i] = list(vectors[rnd.randrange(120)])
    vectors += [[0.0, 0.0, 0.0], [float("nan"), 1.0, 0.0], [], None]
    start = datetime(2024, 1, 1)
    rows = [(i, v, "g" if i % 3 else None, "x" if i % 17 == 5 else None, None if i % 29 == 3 else start + timedelta(minutes=rnd.randrange(60))) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, label string, superseded_by string, created_at timestamp")
    pairs = D.near_pairs(df, 0.8 - 1e-6, ["label"]).withColumn("score", F.round("score", 9)).where("score >= 0.8")
    near = {(r["a"], r["b"]): r["score"] for r in pairs.collect()}
    place = {r[0]: (r[4] is not None, r[4] or start, r[0]) for r in rows}
    gone, plain = set(), []
    for x in sorted({i for p in near for i in p}, key=place.get):
        peers = [(-near[min(x, y), max(x, y)], place[y]) for y in place if (min(x, y), max(x, y)) in near and y not in gone and y != x]
        if x not in gone and peers:
            older, newer = sorted((x, min(peers)[1][2]), key=place.get)
            gone.add(older)
            plain.append((older, newer))
    assert len(plain) > 50
    assert sorted(tuple(r) for r in D.dedup_near(df, 0.8, ["label"]).collect()) == sorted(plain)
    assert sorted(tuple(r) for r in D.greedy_dedup(pairs, df).collect()) == sorted(plain)
    skip = spark.createDataFrame([(i,) for i in range(0, 120, 5)], "id long")
    kept = df.join(skip, "id", "left_anti")
    assert sorted(map(tuple, D.greedy_dedup(pairs, df, skip).collect())) == sorted(map(tuple, D.dedup_near(kept, 0.8, ["label"]).collect()))
