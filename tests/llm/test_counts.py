"""Phrase collocations, token counts and whitening, each against a brute-force version."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from mnemospark.llm import cells, phrases, queries, tokencount, whitening

DATA = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string"


# --- phrases ---


def brute_phrases(rows, depth=3, least=10, top=2000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang or "und" if lang is None else lang] += len(words)
            for k in range(1, depth + 1):
                for i in range(len(words) - k + 1):
                    count["und" if lang is None else lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in count.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {q[i : i + k] for q, b in often.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if 100 * b >= 50 * f[q[i : i + k]]}
        ranked = []
        for p, a in often.items():
            if p not in gone:
                score, _, l, r = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out)


def found_phrases(df, **more):
    return sorted(tuple(r) for r in phrases.collocations(df, **more).collect())


@pytest.mark.parametrize("shard, depth, top", [(16 << 20, 3, 2000), (60, 3, 7), (500, 4, 2000)])
def test_phrases_equal_brute_force(spark, shard, depth, top):
    draw = random.Random(5)
    words = ["a", "B", "b", "Été", "x-y", "c", " ", "d"]
    rows = [("".join(draw.choice(words) + draw.choice([" ", "\t", "  ", " ", " ", ".", "\n", "\x0b", ", "]) for _ in range(draw.randrange(60))), draw.choice(["en", "fr", None, "und"])) for _ in range(150)]
    rows += [(None, "en"), ("", "en"), (" \t ", None), ("..", "xx"), ("no more", "yy")] + [("Same text here", "en")] * 40 + [("long " * 3000, "fr")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA).withColumn("phrase", F.lit("clash")).repartition(3)
    want = brute_phrases(rows, depth, top=top)
    assert found_phrases(df, depth=depth, top=top, shard=shard) == want and len(want) > 20


def test_phrases_with_few_cells_are_the_same(spark):
    """When nearly every cell is full the sketch tells nothing apart; the counts are exact all the same."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    rows = [(r["text"], r["lang"]) for r in docs.collect()]
    assert found_phrases(docs) == brute_phrases(rows)
    assert found_phrases(docs, bits=13) == brute_phrases(rows)


def test_sketch_never_loses_a_frequent_phrase(spark):
    rows = spark.createDataFrame([("en", f"w{i % 9} v{i % 7} x") for i in range(300)], "lang string, text string")
    bits = phrases.sketch(rows.repartition(5), 3, 10)
    automaton = phrases.build(["en"] * 300, [f"w{i % 9} v{i % 7} x".encode() for i in range(300)], 3)
    for level in automaton.levels:
        has = cells.told(bits, level.hash, phrases.BITS)
        assert (has | (level.count < 10)).all() and not has[level.count < 2].any()


def test_cells_keep_what_is_frequent(spark):
    draw = np.random.default_rng(1)
    hashes = draw.integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2)
    counts = draw.integers(1, 9, 5000)
    for bits in (12, 16, 20):
        parts = [r for k in range(4) for b in cells.batches(hashes[k::4], counts[k::4], bits, 7) for r in b.to_pylist()]
        got = cells.often(spark.createDataFrame(parts, "range int, cells binary"), bits, 7)
        want = np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), np.minimum(counts, 7), 1 << bits) >= 7
        assert (np.unpackbits(got, bitorder="little").astype(bool) == want).all()
    assert list(cells.batches(hashes[:0], counts[:0], 20, 7)) == []


def test_automaton_links_and_endpos_counts():
    automaton = phrases.build(["en", "en"], [b"a b c. a b", b"b c d"], 3)
    names, words = [[]], automaton.words.to_pylist()
    names[0] = [(words[w],) for w in automaton.levels[0].last]
    for level in automaton.levels[1:]:
        names.append([names[-1][p] + names[0][w] for p, w in zip(level.before, level.last)])
    assert dict(zip(names[1], automaton.levels[1].count)) == {(b"a", b"b"): 2, (b"b", b"c"): 2, (b"c", b"d"): 1}
    assert dict(zip(names[2], automaton.levels[2].count)) == {(b"a", b"b", b"c"): 1, (b"b", b"c", b"d"): 1}
    for k in (1, 2):
        assert [names[k - 1][x] for x in automaton.levels[k].link] == [p[1:] for p in names[k]]


def test_phrases_of_an_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert found_phrases(df) == []
    assert phrases.collocations(df).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


# --- token counts ---


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts():
    draw = random.Random(9)
    kinds = ["the cat sat on it ", "a", " ", "\n", "中国 文字", "🙂🙂", "▁", "é", "<s>", "\x00", "<0x41>", "antidisestablishmentarianism", "zzzz", "\t", "Ünï"]
    out = ["", " ", "a" * 900, " " * 901, "ab" * 700, "\x00" * 50, "🙂" * 300, "<s></s><unk>" * 60]
    out += ["".join(draw.choice(kinds) * draw.choice([1, 1, 2, 30]) for _ in range(draw.randrange(1, 120))) for _ in range(60)]
    return out


@pytest.mark.parametrize("chunk, overlap", [(16, 1), (40, 8), (100, 3), (257, 64)])
def test_spliced_ids_equal_the_library(library, chunk, overlap):
    coder = tokencount.Resync(MODEL, chunk, overlap)
    for text in texts():
        assert coder.encode(text).tolist() == library.encode(text)
    assert coder.counts(texts()) == [len(x) for x in library.encode(texts())]


def test_overlaps_widen_where_nothing_is_common(library, monkeypatch):
    """A run without a common token goes back to the beginning of the text."""
    coder = tokencount.Resync(MODEL, 16, 1)
    asked = []
    plain = coder.tokens
    monkeypatch.setattr(coder, "tokens", lambda text, at: asked.append((at, len(text))) or plain(text, at))
    text = "antidisestablishmentarianism" * 40 + " " * 100
    assert coder.encode(text).tolist() == library.encode(text)
    again = sum(b[0] <= a[0] for a, b in zip(asked, asked[1:]))
    assert again > 0 and len(asked) < len(text)


def test_counts_of_odd_rows(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "one two", None), (3, "long words " * 20_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_TOKENS string")
    got = tokencount.count_tokens(df, MODEL, ["doc_id", "N_TOKENS"], limit=3)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 3) for i, t, _ in rows]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert tokencount.count_tokens(df.limit(0), MODEL, ["doc_id"]).collect() == []


def test_op12_equals_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.QUERIES["op12_token_counts"](spark, DATA).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        n = len(library.encode(texts[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 4096)


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        tokencount.Resync(MODEL, 0)


# --- whitening ---


def brute_covariance(x):
    n, d = len(x), len(x[0])
    mean = [Fraction(sum(r[j] for r in x), n) for j in range(d)]
    return np.array([[float(sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in x) / n) for j in range(d)] for i in range(d)]), mean


def check_whitening(rows, vectors, components=8):
    """rows of ``whiten`` against exact sums and numpy's eigenvalues."""
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors.values()]
    n, cov = len(x), brute_covariance(x)
    s = [sum(r[j] for r in x) for j in range(len(x[0]))]
    values = np.linalg.eigvalsh(cov[0])[::-1]
    k = min(components, len(s))
    assert len(rows) == n * k
    by = {(r["vec_id"], r["component"]): r for r in rows}
    for (i, xs) in zip(vectors, x):
        for c in range(1, k + 1):
            r = by[i, c]
            assert r["n"] == n and int(r["deviation"]) == sum((n * v - t) ** 2 for v, t in zip(xs, s))
            assert abs(r["explained"] - values[c - 1] / values.sum()) <= 1e-9 * abs(r["explained"])
    w = np.array([[by[i, c]["whitened"] for c in range(1, k + 1)] for i in vectors])
    y = np.array([[float(v - m) for v, m in zip(xs, cov[1])] for xs in x])
    assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-9
    # each whitened column is a projection on a unit eigenvector of V
    for c in range(k):
        v = y.T @ w[:, c] / n / np.sqrt(values[c])
        assert abs(np.linalg.norm(v) - 1) < 1e-9 and np.abs(cov[0] @ v - values[c] * v).max() < 1e-9 * values[0]
        assert np.abs(y @ v / np.sqrt(values[c]) - w[:, c]).max() < 1e-8
    assert max(r["identity_error"] for r in rows) < 1e-9


def test_op13_equals_brute_force(spark):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    check_whitening(queries.QUERIES["op13_whitening"](spark, DATA).collect(), vectors)


def test_rows_that_go_and_rows_that_stay(spark):
    draw = np.random.default_rng(3)
    good = {i: draw.normal(size=3).tolist() for i in range(40)} | {40: [50.0, -3.0, 5.0], 41: [50.0, -3.0, 5.0]}
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 0.0, 0.0]), (104, []), (105, [1.0]), (106, [2.0**60, 0.0, 0.0])]
    df = spark.createDataFrame([*good.items(), *bad], "vec_id long, embedding array<double>").withColumn("N", F.lit("clash")).repartition(3)
    rows = whitening.whiten(df, "embedding", ["vec_id", "N"]).collect()
    assert {r["vec_id"] for r in rows} == set(good)
    check_whitening(rows, good)


def test_large_entries_stay_exact(spark):
    vectors = {i: [3.0e11 * (i % 5), float(i), -1e10 * (i * i % 7)] for i in range(30)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    rows = whitening.whiten(df, "embedding", ["vec_id"]).collect()
    x = [[int(1024 * c) + 100_000 for c in map(Fraction, v)] for v in vectors.values()]
    s = [sum(r[j] for r in x) for j in range(3)]
    want = {i: sum((30 * v - t) ** 2 for v, t in zip(xs, s)) for i, xs in zip(vectors, x)}
    assert all(int(r["deviation"]) == want[r["vec_id"]] for r in rows)
    assert max(r["identity_error"] for r in rows) < 1e-6


def test_vectors_without_variance(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    rows = whitening.whiten(one, "embedding", ["vec_id"]).collect()
    assert len(rows) == 4 and all(r["whitened"] is None and r["explained"] == 0 and r["identity_error"] == 0 and r["deviation"] == 0 for r in rows)
    flat = spark.createDataFrame([(i, [float(i), 7.0]) for i in range(6)], "vec_id long, embedding array<float>")
    rows = whitening.whiten(flat, "embedding", ["vec_id"]).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in rows) and rows[0]["identity_error"] < 1e-12
    assert whitening.whiten(one.limit(0), "embedding", ["vec_id"]).collect() == []


def test_whitening_doesnt_depend_on_the_files(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    run = lambda f: {(r["vec_id"], r["component"]): (r["whitened"], r["explained"], r["deviation"]) for r in whitening.whiten(f, "embedding", ["vec_id"]).collect()}
    assert run(df.repartition(5, "label")) == run(df)


@pytest.mark.parametrize("d", [1, 2, 7, 64])
def test_jacobi_keeps_small_eigenvalues(d):
    """Against the graded matrix D C D, whose small eigenvalues an absolute bound would lose."""
    draw = np.random.default_rng(d)
    b = draw.normal(size=(3 * d, d))
    c = b.T @ b / (3 * d)
    scale = 10.0 ** -np.linspace(0, 8, d)
    values, q = whitening.jacobi(c * scale[:, None] * scale)
    assert np.abs(q.T @ q - np.eye(d)).max() < 1e-12 and (np.diff(values) <= 0).all()
    # the inverse has the reciprocal eigenvalues, and its largest is exact
    inverse = np.linalg.inv(c) / scale[:, None] / scale
    assert abs(values[-1] * np.linalg.eigvalsh(inverse)[-1] - 1) < 1e-9
