"""The pipeline's near-dedup stage: exact Jaccard of five-word shingles."""

import itertools
from fractions import Fraction

import numpy as np

import corpus_pipeline
from mnemospark.llm import components, resemblance, simhash


def brute_kept(rows):
    """The ids that stay, by all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a == b or (a | b and len(a & b) / len(a | b) >= 0.8):
            root[find(j)] = find(i)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted(min(g) for g in groups.values())


def test_stage_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(resemblance, "OFTEN", 2)
    rng = np.random.default_rng(5)
    vocabulary = np.array([f"w{i}" for i in range(400)])
    phrase = list(rng.choice(vocabulary, 30))
    texts = [None, "", " ", "a b", "A  b", "a b c", "one two three four five"]
    for k in range(25):
        base = list(rng.choice(vocabulary, rng.integers(5, 160))) + phrase * (k % 3 == 0)
        texts.append(" ".join(base))
        for edits in (0, 1, 1, 2, 3, 4, 6):
            copy = list(base)
            for i in rng.integers(0, len(copy), edits):
                copy[i] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    hub = list(rng.choice(vocabulary, 60))
    texts += [" ".join([*hub[:i], "new%d" % i, *hub[i:]]) for i in range(40)]  # a large group of near copies
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.near_dedup_stage(spark, docs, "")
    assert sorted(r["doc_id"] for r in got.collect()) == brute_kept(rows)


def test_stage_drops_copies_far_apart_in_simhash_bits(spark):
    words = [f"x{i}" for i in range(80)]
    other = [*words[:40], "changed", *words[41:]]  # 71 of 81 shingles are shared
    docs = spark.createDataFrame([(2, " ".join(words)), (1, " ".join(other)), (None, " ".join(words))], "doc_id long, text string")
    # null is a value like others: one document of the group stays
    assert [r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()] == [1]


def test_one_row_of_equal_documents_stays(spark):
    a, b = " ".join(f"x{i}" for i in range(30)), " ".join(f"y{i}" for i in range(30))
    rows = [(5, a), (5, a), (5, a), (7, b), (7, a), (None, b), (None, "only here now"), (None, "only here now")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, prefix string")
    for f in (lambda d: corpus_pipeline.near_dedup_stage(spark, d, ""), simhash.drop_near_duplicates):
        got = f(docs)
        assert got.columns == docs.columns
        assert sorted(((r["doc_id"] or 0), r["text"]) for r in got.collect()) == [(0, "only here now"), (5, a), (7, b)]


def test_hot_keys_are_spread(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT", 3)
    monkeypatch.setattr(components, "SPLIT_EDGES", 0)
    rng = np.random.default_rng(2)
    rows = [(int(k), int(i)) for i, k in enumerate(rng.choice(5, 400, p=[0.8, 0.05, 0.05, 0.05, 0.05]))]
    df = spark.createDataFrame(rows, "key long, i long")
    told = df.groupBy("key").count().withColumnRenamed("count", "n").selectExpr("key", "n", "key * 10 as v")
    got = components.join_spread(df, told, "key", 400, df["i"]).select("key", "i", "v").collect()
    assert sorted((r["key"], r["i"], r["v"]) for r in got) == sorted((k, i, 10 * k) for k, i in rows)
    edges = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(100, 160)]
    roots = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots == {i: 0 for i in range(60)} | {i: 100 for i in range(100, 161)}


def test_sketches_bound_overlap():
    rng = np.random.default_rng(9)
    for n, m in ((1, 1), (1, 900), (40, 40), (300, 350), (700, 800), (5000, 4500)):
        for part in (0.0, 0.3, 0.9, 1.0):
            x = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
            same = x[: int(part * min(n, m))]
            y = np.unique(np.concatenate([same, rng.integers(-(2**63), 2**63 - 1, m - len(same))]))
            bound = resemblance.most_shared(resemblance.sketch_of(x), len(x), resemblance.sketch_of(y), len(y))
            assert len(same) <= bound <= min(len(x), len(y))
            if part == 0.0 and min(n, m) > 30:
                assert bound < 0.5 * min(n, m)
    nothing = resemblance.sketch_of(np.zeros(0, np.int64))
    assert resemblance.most_shared(nothing, 0, nothing, 0) == 0


def test_whole_sets_move_for_likely_pairs_only(spark, monkeypatch):
    moved = {}
    whole = resemblance.with_blobs

    def counted(docs, pairs, sets, shingle, blob):
        moved[blob] = sorted((r["a"], r["b"]) for r in pairs.collect())
        return whole(docs, pairs, sets, shingle, blob)

    monkeypatch.setattr(resemblance, "with_blobs", counted)
    words = [f"x{i}" for i in range(200)]
    texts = [words, [*words[:100], "new", *words[101:]], *([*words[:80], *(f"y{k}_{i}" for i in range(120))] for k in range(20)), []]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    rows = resemblance.describe(docs, np.zeros(0, np.int64), 5, Fraction(4, 5)).orderBy("doc_id").collect()
    sets = spark.createDataFrame([(r["node"], r["text_key"]) for r in rows], "node long, text_key long")
    node = [r["node"] for r in rows]
    pairs = spark.createDataFrame([(node[0], n) for n in node[1:]], "a long, b long")
    got = resemblance.verified(docs, pairs, sets, 5, Fraction(4, 5)).collect()
    assert [(r["a"], r["b"]) for r in got] == [(node[0], node[1])]
    assert len(moved[resemblance.sketch_of]) == len(node) - 1 and moved[np.ndarray.tobytes] == [(node[0], node[1])]
