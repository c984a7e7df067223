"""Classifiers, language identification and the language model: accuracy, edge cases, exactness."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from mnemospark.llm import langid, lblm, quality, queries, toxicity

DATA = "/root/testdata/sf0.01"
LONG = "word " * 30_000
ODD = [None, "", " \n\t", "x", "Ünïcödé 中国 🙂", LONG, "dup text", "dup text"]


@pytest.fixture(scope="module")
def labelled():
    rows = duckdb.connect().execute(f"SELECT doc_id, text, quality, toxic FROM '{DATA}/documents.parquet' JOIN '{DATA}/labels.parquet' USING (doc_id) ORDER BY doc_id").fetchall()
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    return [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5], held


def test_quality_on_held_out_rows_and_odd_texts(labelled):
    train, held = labelled
    f = quality.scorer(quality.train([(r[1], r[2]) for r in train]))
    p = f([r[1] for r in held])[0] >= quality.THRESHOLD
    assert np.mean(p == np.array([r[2] == 1 for r in held])) > 0.9
    odd = f(ODD)[0]
    assert ((odd >= 0) & (odd <= 1)).all() and abs(odd[0] - odd[1]) < 1e-6 and abs(odd[-1] - odd[-2]) < 1e-6
    alone = np.array([f([t])[0][0] for t in ODD])
    assert np.allclose(odd, alone, atol=1e-6)  # a text's score doesn't depend on its neighbours


def test_quality_reads_every_byte(labelled):
    train, _ = labelled
    f = quality.scorer(quality.train([(r[1], r[2]) for r in train]))
    clean = next(r[1] for r in train if r[2] == 1 and len(r[1]) > 3000)
    junk = clean[:1500] + " %%% &&& $$$ ###" * 400
    assert f([junk])[0][0] < f([clean])[0][0]


def test_toxicity_on_held_out_rows_and_odd_texts(labelled):
    train, held = labelled
    f = toxicity.scorer(toxicity.train([(r[1], r[3]) for r in train]))
    s = f([r[1] for r in held])[0]
    y = np.array([r[3] for r in held])
    pairs = s[y == 1][:, None] - s[y == 0][None, :]
    assert (pairs > 0).mean() > 0.75
    odd = f(ODD)[0]
    assert ((odd >= 0) & (odd <= 1)).all() and abs(odd[0] - odd[1]) < 1e-6 and abs(odd[-1] - odd[-2]) < 1e-6


def test_toxicity_reads_long_tokens_to_their_end():
    run = "".join(chr(97 + k * k % 26) for k in range(997))
    pieces = toxicity.words_of(f"ab {run} cd")
    rebuilt = pieces[1] + "".join(p[toxicity.PIECE // 2 :] for p in pieces[2:-1])
    assert pieces[0] == "ab" and pieces[-1] == "cd" and rebuilt == run
    assert toxicity.words_of("-" * 60 + "word") == ["-" * 60 + "word"]
    rng = np.random.default_rng(4)
    clean = lambda: "".join(rng.choice(["calm", "green", "river", "stone", "window", "paper"], 12))
    rows = [(clean() + "grobfoul" * y + clean(), y) for y in (0, 1) * 60]
    f = toxicity.scorer(toxicity.train(rows))
    first = clean()
    toxic, mild = f([first + clean() + "grobfoul", first + clean() + clean()])[0]
    assert toxic > 0.5 > mild


def test_classifiers_without_labels_of_both_classes():
    for m in (quality, toxicity):
        assert m.scorer(m.train([]))([None, "a"])[0].shape == (2,)
        assert m.scorer(m.train([("a", 1), ("b", 1)]))(["x"])[0][0] == 1.0


def test_gru_gradients():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3, 5, 3 * toxicity.STATE)).astype(np.float64)
    u = rng.normal(0, 0.3, (toxicity.STATE, 3 * toxicity.STATE))
    w = rng.normal(size=(5, 3, toxicity.STATE))
    for reverse in (False, True):
        out, tape = toxicity.run_gru(x, u, reverse, True)
        dx, du = toxicity.back_gru(tape, u, w)
        for arr, grad in ((x, dx), (u, du)):
            i = tuple(rng.integers(0, n) for n in arr.shape)
            arr[i] += 1e-3
            up = (toxicity.run_gru(x, u, reverse)[0] * w).sum()
            arr[i] -= 2e-3
            down = (toxicity.run_gru(x, u, reverse)[0] * w).sum()
            arr[i] += 1e-3
            assert abs((up - down) / 2e-3 - grad[i]) < 1e-2 * max(1, abs(grad[i]))


def brute_phrases(x: bytes, ref: bytes) -> int:
    n = i = 0
    while i < len(x):
        j = i
        while j < len(x) and x[i : j + 1] in ref:
            j += 1
        i, n = max(j, i + 1), n + 1
    return n


def test_cross_parsing_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(60):
        ref, x = rng.integers(0, 3, rng.integers(1, 90)).astype(np.uint8), rng.integers(0, 4, rng.integers(1, 90)).astype(np.uint8)
        for segment in (1, 3, 7, 1000):  # long texts are parsed as one, however they are cut for the work
            both = langid.phrases(np.concatenate([x, x[:5], x]), np.array([len(x), len(x[:5]), len(x)]), langid.parser_table(ref, 4), segment)
            assert both.tolist() == [brute_phrases(bytes(x), bytes(ref)), brute_phrases(bytes(x[:5]), bytes(ref)), brute_phrases(bytes(x), bytes(ref))]


def test_langid_tells_many_scripts_apart():
    rng = np.random.default_rng(3)
    texts, held = {}, []
    for k, first in enumerate([0x4E00, 0x5E00, 0xAC00, 0x3041, 0x0430, 0x0561, 0x05D0, 0x0E01, 0x10D0] + [0x61] * 70):
        # languages of one script differ by their words
        words = ["".join(chr(first + int(c)) for c in rng.integers(0, 26, rng.integers(2, 7))) for _ in range(60)]
        texts[f"l{k:02}"] = [" ".join(rng.choice(words, 400))]
        held.append((f"l{k:02}", " ".join(rng.choice(words, 40))))
    model = langid.train(texts)
    assert len(model["languages"]) == 79
    assert langid.classifier(model)([t for _, t in held])[0] == [x for x, _ in held]


def test_langid_query(spark):
    got = {r["doc_id"]: r for r in queries.QUERIES["op10_langid"](spark, DATA).collect()}
    rows = duckdb.connect().execute(f"SELECT doc_id, lang FROM '{DATA}/documents.parquet'").fetchall()
    assert set(got) == {d for d, _ in rows}
    held = [(d, x) for d, x in rows if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, _ in rows)
    assert np.mean([got[d]["lang_pred"] == x for d, x in held]) > 0.97


def test_langid_odd_texts():
    f = langid.classifier(langid.train({"aa": ["abab abba " * 50], "bb": ["cdcd dccd " * 50]}))
    names, scores = f([None, "", "12 !?", "abba", "CDCD", "abab " * 30_000, "中国"])
    assert names[:3] == ["und"] * 3 and names[3:6] == ["aa", "bb", "aa"] and names[6] in ("aa", "bb") and all(0 <= s <= 1 for s in scores)
    assert langid.classifier(langid.train({}))(["x"]) == [["und"], [0.0]]


def test_a_rare_language_leaves_the_others_whole():
    rows = duckdb.connect().execute(f"SELECT lang, text, doc_id FROM '{DATA}/documents.parquet' WHERE text IS NOT NULL ORDER BY doc_id").fetchall()
    texts = {}
    for lang, t, d in rows:
        if zlib.crc32(str(d).encode()) % 4 != 2:
            texts.setdefault(lang, []).append(t)
    held = [(lang, t[:300]) for lang, t, d in rows if zlib.crc32(str(d).encode()) % 4 == 2]
    right = lambda m: np.mean([a == b for a, (b, _) in zip(langid.classifier(m)([t for _, t in held])[0], held)])
    without, rare = langid.train(texts, 10_000), langid.train(texts | {"zz": ["zaq wox vuk " * 30]}, 10_000)
    sizes = {k: len(v) for k, v in zip(rare["languages"], rare["tables"])}
    assert all(sizes[k] == len(v) for k, v in zip(without["languages"], without["tables"]))
    assert right(rare) >= right(without) - 0.01
    assert langid.classifier(rare)(["vuk zaq wox vuk zaq"])[0] == ["zz"]


def test_langid_learns_only_from_its_fold(spark):
    rows = [(i, "abc", "xx") for i in range(40) if zlib.crc32(str(i).encode()) % 4 == 2] + [(None, "abc", "yy"), (1, None, "zz"), (3, "abc", None)]
    assert langid.training_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string")) == {}


def brute_base(rows):
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)})) + [None]
    c = Counter()
    for d, t in rows:
        if d is not None and zlib.crc32(str(d).encode()) % 10:
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    return [(d, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))) for d, t in rows]


@pytest.mark.parametrize("head", [300_000, 5, 0])
def test_lm_statistics_equal_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(lblm, "HEAD_WORDS", head)
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "É x", "中"]
    rows = [(i, " \t".join(rng.choice(vocabulary, rng.integers(0, 40)))) for i in range(60)] + [(100, None), (101, ""), (None, "w1 w2"), (7, "w1"), (102, "w3 " * 5000)]
    got = lblm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda r: (str(r[0]), r[1], round(r[4], 4))
    have = sorted([(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got], key=key)
    want = sorted(brute_base(rows), key=key)
    assert [h[:4] for h in have] == [w[:4] for w in want]
    assert all(abs(h[4] - w[4]) < 1e-6 * max(1, abs(w[4])) for h, w in zip(have, want))
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in got)


@pytest.fixture
def small_lm(monkeypatch):
    """A model whose words are single, in bands, by ending in the head and by ending outside it, with random weights."""
    for k, v in {"SINGLE": 4, "BAND": 3, "ENDINGS": 5, "LEAST": 2, "WORDS": 12}.items():
        monkeypatch.setattr(lblm, k, v)
    rng = np.random.default_rng(5)
    head = [(b"w%d" % i, 40 - 2 * i) for i in range(14)]
    outside = [(b"r%d" % i, 1) for i in range(9)]
    tokens, distinct = sum(n for _, n in head + outside) + 6, len(head) + len(outside) + 1
    tail = np.zeros(5)
    for w, n in outside:
        tail[lblm.ending(w)] += (n + 0.1) / (tokens + 0.1 * (distinct + 1))
    stats = lblm.Statistics(tokens, distinct, 6, head, tail)
    stats.network = {k: rng.normal(0, 0.7, v.shape).astype(np.float32) for k, v in lblm.first_weights(stats).items()}
    return stats, dict(head + outside)


def plain_log10(stats, counts, word, before):
    """log10 p(word | the two before it), in plain loops; word None is the end, before None the start."""
    p, s = stats.network, stats
    names = [w for w, _ in s.head]
    base = lambda w: (counts.get(w, 0) + 0.1) / (s.tokens + 0.1 * (s.distinct + 1))
    row = lambda w: s.own + 1 + lblm.ENDINGS if w is None else names.index(w) if w in names[: s.own] else s.own + 1 + lblm.ending(w)
    h = p["r"][row(before[0])].astype(float) @ p["c1"] + p["r"][row(before[1])].astype(float) @ p["c2"]
    first = np.array([math.exp(sum(h[d] * p["q"][k][d] for d in range(len(h))) + p["b"][k]) for k in range(s.outputs)])
    first /= first.sum()
    if word is None:
        return math.log10(first[s.single])
    if word in names[: s.single]:
        return math.log10(first[names.index(word)])
    if word in names[: s.own]:
        band, at = divmod(names.index(word) - s.single, lblm.BAND)
        inner = np.array([math.exp(h @ p["v"][band * lblm.BAND + k] + p["a"][band * lblm.BAND + k]) for k in range(lblm.BAND)])
        return math.log10(first[s.single + 1 + band] * inner[at] / inner.sum())
    e = lblm.ending(word)
    mass = base(b"never seen") + sum(base(w) for w in counts if w not in names[: s.own] and lblm.ending(w) == e)
    return math.log10(first[s.single + 1 + s.bands + e] * base(word) / mass)


def test_lm_score_equals_plain_loops(small_lm):
    stats, counts = small_lm
    assert (stats.single, stats.bands, stats.own) == (4, 2, 10)
    texts = [None, "", "w1", "W2 w9 w13 r3 zz", "r1 w5 w5 w0 r8 w12 qq w4 " * 9, "w7 zz"]
    out = lblm.document_scorer(stats)(texts)
    for k, t in enumerate(texts):
        ws, want = lblm.words(t), 0.0
        for i, w in enumerate([*ws, None]):
            want += plain_log10(stats, counts, w, [ws[i - 1] if i else None, ws[i - 2] if i > 1 else None])
        tail = sum(float(stats.base(counts.get(w, 0))) for w in (out[4][k].as_py() or "").encode().split())
        assert abs(out[3][k] + tail - want) < 1e-4 * max(1, abs(want)) and out[0][k] == len(ws) + 1


def test_lm_probabilities_sum_to_one(small_lm):
    stats, counts = small_lm
    endings = {lblm.ending(b"u%d" % i): b"u%d" % i for i in range(200)}
    assert len(endings) == 5
    for before in ([None, None], [b"w1", b"r2"], [b"w8", None]):
        whole = sum(10 ** plain_log10(stats, counts, w, before) for w in [None, *counts, *endings.values()])
        assert abs(whole - 1) < 1e-9


def test_lm_goes_over_every_training_document_once():
    assert [x for low, high in lblm.ROUNDS for x in range(low, high)] == list(range(lblm.PARTS)) and len(lblm.RATES) == len(lblm.ROUNDS)


def test_lm_averages_by_tokens(spark):
    sizes, rows = [3, 1, 4, 5, 9, 2, 6, 8, 7], []
    for k, n in enumerate(sizes):
        rows.append((k * 40, float(n), False, bytearray(np.full(4, k, np.float16).tobytes())))
    total, tokens = lblm.averaged(spark.createDataFrame(rows, lblm.MOVES))
    assert tokens == sum(sizes) and np.allclose(total, sum(k * n for k, n in enumerate(sizes))) and total.shape == (4,)


def test_lm_beats_its_base_on_held_out_rows(spark):
    rows = queries.QUERIES["op6_lblm"](spark, DATA).where("held_out").collect()
    tokens = sum(r["n_tokens"] for r in rows)
    assert (sum(r["score"] for r in rows) - sum(r["base_score"] for r in rows)) / tokens > 0.15


def test_queries_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name, f in queries.QUERIES.items():
        assert f(spark, str(tmp_path)).count() == 0, name


def test_sums_of_rows_share_one_order_and_keep_their_bits():
    rng = np.random.default_rng(3)
    for bound in (7, 256, 8_226, 1 << 16, 1 << 20):
        at = rng.integers(0, bound, 3_000)
        assert (lblm.in_order(at, bound) == np.argsort(at, kind="stable")).all()
        matrix, vector = rng.normal(size=(3_000, 16)).astype(np.float32), rng.normal(size=3_000).astype(np.float32)
        found, a, b = lblm.summed_rows(at, bound, matrix, vector)
        order = np.argsort(at, kind="stable")
        begin = np.flatnonzero(np.diff(at[order], prepend=-1))
        assert (found == np.unique(at)).all()
        assert a.tobytes() == np.add.reduceat(matrix[order], begin, axis=0).tobytes()
        assert b.tobytes() == np.add.reduceat(vector[order], begin).tobytes()
