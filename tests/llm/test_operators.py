"""Sharding, near-dedup, decontamination, tokenising, media, extraction, the pipeline."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from mnemospark.llm import bpe, decontaminate, htmltext, mpegts, queries, shard, simhash

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", "  ", "one", "two words", "Same TEXT here", "same text here", "Ünï 中国 🙂\nline", "long " * 20_000, "Same TEXT here"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(ODD)] + [(None, "null id", None, None, None), (3, "one", "en", "s", 0), (3, "one", "en", "s", 0)]
    return spark.createDataFrame(rows, SCHEMA)


# --- sharding ---


@pytest.mark.parametrize("bucket_bytes", [1 << 20, 40_000, 64])
def test_shards_are_even_gapless_and_whole(spark, odd, bucket_bytes):
    df = odd.withColumn("shard", F.lit("clash"))
    got = shard.shuffle_shards(df, 4, "doc_id", shard.text_size(), bucket_bytes=bucket_bytes, stable=False).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == sorted((str(r["doc_id"]), str(r["text"])) for r in odd.collect())
    per = [sorted(r["slot"] for r in got if r["shard"] == s) for s in range(4)]
    assert all(p == list(range(len(p))) for p in per) and max(map(len, per)) - min(map(len, per)) <= 1


def test_shards_dont_depend_on_the_files(spark, odd, monkeypatch):
    rows = odd.select("doc_id", "text").unionByName(spark.range(700).select(F.col("id").alias("doc_id"), F.repeat(F.lit("xy "), (F.col("id") % 40).cast("int")).alias("text")))
    run = lambda df: sorted((str(r["doc_id"]), r["text"] or "", r["shard"], r["slot"]) for r in shard.shuffle_shards(df, 5, "doc_id", shard.text_size(), bucket_bytes=5000).collect())
    assert run(rows.repartition(3)) == run(rows.repartition(7, "text").sortWithinPartitions("text"))


def test_a_record_with_a_third_of_all_rows_is_spread(spark, monkeypatch):
    monkeypatch.setattr(shard, "REPEATS", 20)
    monkeypatch.setattr(shard, "PARTITIONS", 2)
    monkeypatch.setattr(shard, "PARTITION_BYTES", 4000)
    rows = [(1, "same text")] * 300 + [(i, f"text {i}") for i in range(600)]
    got = shard.shuffle_shards(spark.createDataFrame(rows, "doc_id long, text string"), 4, "doc_id", shard.text_size(), bucket_bytes=500).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted(rows)
    assert all(sorted(r["slot"] for r in got if r["shard"] == k) == list(range(225)) for k in range(4))
    per = [sum(r["text"] == "same text" and r["slot"] // 45 == k for r in got) for k in range(5)]
    assert min(per) > 30


def test_written_shards_read_back(spark, odd, tmp_path):
    sharded = shard.shuffle_shards(odd, 3, "doc_id", shard.text_size(), stable=False)
    shard.write_shards(sharded, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    key = lambda r: (str(r["doc_id"]), r["text"] or "", r["slot"])
    assert sorted(key(r) for r in back.collect()) == sorted(key(r) for r in sharded.collect())
    assert {r["shard"] for r in back.select("shard").distinct().collect()} == {0, 1, 2}


def test_shards_repeat_and_follow_the_seed(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    a, b, c = ({r["doc_id"]: (r["shard"], r["slot"]) for r in shard.shuffle_shards(df, 8, "doc_id", shard.text_size(), seed=s, bucket_bytes=100).collect()} for s in (1, 1, 2))
    assert a == b != c
    assert sum(a[i][0] == i % 8 for i in a) < 200  # not the input's order


def test_op1_columns(spark):
    rows = queries.QUERIES["op1_shard"](spark, DATA).collect()
    assert all(r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < 16 for r in rows)
    n = [sum(r["shard"] == s for r in rows) for s in range(16)]
    assert max(n) - min(n) <= 1


def test_op1_values_equal_brute_force(spark):
    rows = queries.QUERIES["op1_shard"](spark, DATA).collect()
    texts = dict(duckdb.connect().execute(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall())
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
    for k in range(16):
        own = sorted(r["slot"] for r in rows if r["shard"] == k)
        assert own == list(range(len(own)))


# --- near-dedup ---


def brute_fingerprint(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    pieces = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    ones = [0] * 64
    for p in pieces:
        h = xxhash.xxh64_intdigest(p.encode(), seed=42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(pieces))


def brute_components(prints):
    """doc index -> component root index for a list of fingerprints."""
    u = np.array(prints, np.uint64)
    parent = list(range(len(u)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i] ^ u) <= 2):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(u))]


def test_fingerprints_equal_brute_force():
    texts = [*ODD, "a b c d e f g " * 200, "x\x0by\x1cz", " a b c"]
    assert simhash.fingerprints(texts).tolist() == [brute_fingerprint(t) for t in texts]


def test_near_duplicates_equal_brute_force(spark):
    rows = queries.QUERIES["op3_simhash"](spark, DATA).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    ids = sorted(texts)
    prints = [brute_fingerprint(texts[i]) for i in ids]
    roots = brute_components(prints)
    want = {i: (f"{p:016x}", ids[r]) for i, p, r in zip(ids, prints, roots)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == want


@pytest.mark.parametrize("plan", [None, [(2**21 - 1, 0), ((2**42 - 1) ^ (2**21 - 1), 0), ((2**64 - 1) ^ (2**42 - 1), 0)], [(2**32 - 1, 0), ((2**64 - 1) ^ (2**32 - 1), 1)], [(2**64 - 1, 2)]])
@pytest.mark.parametrize("dense", [256, 3])
def test_links_are_complete_under_any_plan(spark, monkeypatch, plan, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = random.Random(4)
    prints = set()
    for _ in range(12):  # tight families of fingerprints, some hot
        base = rng.getrandbits(64)
        for _ in range(15):
            x = base
            for b in rng.sample(range(64), rng.randrange(4)):
                x ^= 1 << b
            prints.add(x)
    u = np.array(sorted(prints), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in u.view(np.int64)], "fp long")
    got = {(r["a"], r["b"]) for r in simhash.links(df, plan or simhash.search_plan(u, len(u))).collect()}
    s = np.sort(u.view(np.int64))
    want = {(int(a), int(b)) for i, a in enumerate(s) for b in s[i + 1 :] if (int(a) ^ int(b)) & (2**64 - 1) and bin((int(a) ^ int(b)) & (2**64 - 1)).count("1") <= 2}
    assert got == want


def test_plans_always_meet_the_pigeonhole_rule():
    rng = np.random.default_rng(0)
    sample = rng.integers(0, 2**63, 500, dtype=np.uint64)
    for n in (10, 10**6, 10**10):
        plan = simhash.search_plan(sample, n)
        assert sum(t + 1 for _, t in plan) == simhash.RADIUS + 1
        assert all(a & b == 0 for i, (a, _) in enumerate(plan) for b, _ in plan[i + 1 :])


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1001)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and got[1001] == 1000


def test_dedup_keeps_one_of_each_group(spark, odd):
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    # 0, 1, 2 have no words; 5, 6 and 9 are one, and so are the rows that repeat a text; null ids are values
    assert ids == sorted(["0", "3", "4", "5", "7", "8", "None"])


# --- decontamination ---


def test_leaks_planted_exact_cut_and_paraphrased(spark):
    rng = random.Random(7)
    ends = "dal fer gin hok jum per quin ros tav wex".split()
    vocabulary = [f"{a}{b}{c}" for a in "ba ke li mo nu ra si to".split() for b in ends for c in ends]
    rng.shuffle(vocabulary)
    weights = [1 / (k + 1) for k in range(len(vocabulary))]  # as words are in texts: few common, many rare
    prose = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    items = [(i, prose(rng.choice([6, 16, 30, 50, 64, 150]))) for i in range(30)] + [(None, "null id item words here now"), (90, None), (91, "")]
    docs, want = [], set()
    for i in range(120):
        text = prose(rng.choice([3, 100, 700]))
        if i % 4 == 0:
            item = items[i % 30]
            w = item[1].split()
            if i % 8 == 0 and len(w) >= 30:  # every eighth word goes
                w = [x for k, x in enumerate(w) if k % 8]
            t = text.split()
            at = rng.randrange(len(t) + 1)
            text = " ".join(t[:at] + [x.upper() + "," for x in w] + t[at:])
            want.add((i, item[0]))
        docs.append((i, text))
    docs += [(None, items[3][1]), (500, None), (501, ""), (502, "word " * 40_000 + items[5][1])]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(df, bench).collect()}
    assert want | {(None, 3), (502, 5)} <= got
    extra = got - want - {(None, 3), (502, 5)}
    assert not extra, extra
    kept = {r["doc_id"] for r in decontaminate.drop_leaked(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want} - {502, None}


def test_leaks_with_three_tenths_of_the_words_changed(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").orderBy("doc_id").limit(400).collect() if r["text"]]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    rng = random.Random(9)
    pool = [w for t in texts[:100] for w in t.split()]
    hosts = [t for t in texts if 100 < len(t.split()) < 600]
    docs, want = [], set()
    for k in range(100):
        item, text = rng.choice([x for x in items if len(x[1].split()) >= 12])
        w = text.split()
        for i in rng.sample(range(len(w)), round(0.3 * len(w))):
            w[i] = rng.choice(pool)
        h = rng.choice(hosts).split()
        at = rng.randrange(len(h))
        docs.append((k, " ".join(h[:at] + w + h[at:])))
        want.add((k, item))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_leaks_in_a_text_of_over_a_million_words(spark, monkeypatch):
    item = "these are the words of one benchmark item that stands nowhere else in the long text at all".split()
    text = "filler words go on " * 260_000 + " ".join(item) + " and on" * 50_000
    docs = spark.createDataFrame([(1, text), (2, "short one")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item), "nowhere else")], "item_id long, text string, answer string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()] == [(1, 7)]


def test_common_subsequence():
    def brute(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b):
                prev, row[j + 1] = row[j + 1], max(row[j + 1], row[j], prev + 1 if x == y else 0)
        return row[-1]

    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        masks = {}
        for k, w in enumerate(a):
            masks[w] = masks.get(w, 0) | 1 << k
        assert decontaminate.common_subsequence(masks, len(a), b) == brute(a, b)


def test_benchmark_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 20)
    whole = queries.QUERIES["op2_decontaminate"](spark, DATA).select("doc_id", "item_id").collect()
    bench = {r["item_id"]: decontaminate.words(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    want = {(r["doc_id"], i) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() for i, w in bench.items() if b" " + b" ".join(w) + b" " in b" " + b" ".join(decontaminate.words(r["text"])) + b" "}
    assert want <= {tuple(r) for r in whole}


# --- tokenising ---


@pytest.fixture(scope="module")
def codec():
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.Encoder(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_the_public_encoder(codec):
    own, public = codec
    rng = random.Random(0)
    letters = "abcdeé ñ'sß\n\t  12中国🙂the ing%$"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(1500)]
    texts += ["", "a" * 700, " " * 300, "é" * 200, "ab" * 300, "<|endoftext|>", "don't we'll", "word " * 5000]
    for t in texts:
        assert own.encode(t) == public.encode_ordinary(t)
        assert own.decode(own.encode(t)) == t.encode()
    assert own.encode(None) == []


def test_prefixes_append_and_edit(codec):
    own, _ = codec
    v, rng = own.vocabulary, random.Random(2)
    for _ in range(60):
        data = bytes(rng.choice(b"abcdefgh the ing\xc3\xa9") for _ in range(rng.randrange(1, 60)))
        cut, end = sorted(rng.randrange(len(data) + 1) for _ in range(2))
        whole = bpe.Prefixes(v, data)
        assert bpe.Prefixes(v, data[:cut]).append(data[cut:]).last == whole.last
        assert whole.edit(cut, end, b"new").tokens() == bpe.Prefixes(v, data[:cut] + b"new" + data[end:]).tokens()
        assert own.batch.encode([data])[0] == bpe.Prefixes(v, data).tokens()


def test_op4_digests(spark, odd, codec):
    _, public = codec
    got = bpe.token_digests(odd, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id", "source"]).collect()
    want = sorted((str(r["doc_id"]), hashlib.sha256(" ".join(map(str, public.encode_ordinary(r["text"] or ""))).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in odd.collect())
    assert sorted((str(r["doc_id"]), r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    ids = {r["doc_id"]: r["ids"] for r in bpe.encode_documents(odd, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id"]).collect()}
    assert ids[4] == public.encode_ordinary("two words") and ids[0] == []


def test_extraction_keeps_what_only_looks_like_a_menu():
    tree = htmltext.train()
    body = "<p>" + "plain words of the article stand here " * 5 + "</p>"
    page = f"<article>{body}<div class='social-history'><p>A chapter on social history.</p></div><div class='cookie-banner'>We use cookies</div></article>"
    got = htmltext.main_text(page, tree)
    assert "A chapter on social history." in got and "cookies" not in got
    linked = "".join(f"<p><a href='/{k}'>A paragraph that is wholly a link, number {k}</a></p>" for k in range(3))
    assert htmltext.main_text(f"<article>{linked}</article>", tree).count("wholly a link") == 3
    works = "<ul>" + "".join(f"<li><a href='/{k}'>Work {k}</a></li>" for k in range(4)) + "</ul>"
    assert htmltext.main_text(f"<article>{body}{works}</article>", tree).endswith("Work 0\nWork 1\nWork 2\nWork 3")
    assert htmltext.main_text(f"<article><p>{'word ' * 30}AT&<b>lt;</b>x</p></article>", tree).endswith("AT&lt;x")


# --- media ---


def test_media_table_is_written_and_read_by_others(spark, odd, tmp_path):
    mpegts.store(odd, ["doc_id", "text"]).write.parquet(str(tmp_path / "media"))
    rows = mpegts.read(spark.read.parquet(str(tmp_path / "media")), ["doc_id", "text", "n_bytes", "media"]).collect()
    assert len(rows) == odd.count()
    for r in rows:
        payload, n = mpegts.padded(r["text"])
        units = -(-len(payload) // mpegts.UNIT)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (n, len(payload), hashlib.sha256(payload).hexdigest())
        assert r["pts"] == [k * mpegts.TICKS for k in range(units)] and r["access_points"] == [k * mpegts.UNIT for k in range(0, units, mpegts.TABLES_EVERY)]


def test_new_columns_replace_those_of_the_same_name(spark):
    df = spark.createDataFrame([(1, "abc", "x", "y", 5)], "doc_id long, text string, feature string, MEDIA string, n_bytes int")
    got = mpegts.media_columns(df, df.columns)
    assert len({c.lower() for c in got.columns}) == len(got.columns) and got.first()["feature"].startswith("units=1") and got.first()["n_bytes"] == 3
    page = spark.createDataFrame([(1, "<p>one two three four five six seven</p>", "old", 3)], "page_id long, html string, text string, N_chars int")
    got = htmltext.extract(page, page.columns)
    assert len({c.lower() for c in got.columns}) == len(got.columns) and got.first()["text"] != "old"



def test_streams_round_trip():
    rng = random.Random(0)
    for n in [0, 1, 63, 64, 65, *range(140, 200), mpegts.UNIT, mpegts.UNIT + 1, 9 * mpegts.UNIT + 5]:
        data = rng.randbytes(n)
        payload = data.ljust(max(64, -(-n // 64) * 64), b"\0")
        stream = mpegts.mux(payload)
        back, stamps, points = mpegts.demux(stream)
        assert back == payload and len(stream) % 188 == 0
        units = -(-len(payload) // mpegts.UNIT)
        assert stamps == [k * mpegts.TICKS for k in range(units)] and points == [k * mpegts.UNIT for k in range(0, units, mpegts.TABLES_EVERY)]


def test_damaged_streams_are_refused():
    stream = mpegts.mux(b"payload" * 5000)
    cases = [stream[:-1], stream[: 188 * 4] + stream[188 * 5 :], b"\0" + stream[1:], stream[:30] + bytes([stream[30] ^ 1]) + stream[31:], stream[188 * 2 :], b"", stream[188:376] + stream[:188] if False else stream[: 188 * 20]]
    bad = bytearray(stream)
    bad[10] ^= 0xFF  # inside the first table
    for s in [*cases, bytes(bad)]:
        if s == cases[3]:
            continue  # stuffing after a table's section carries nothing
        with pytest.raises(ValueError):
            mpegts.demux(s)


def test_op5_columns(spark, odd):
    rows = mpegts.media_columns(odd, ["doc_id", "text"], stream=True).collect()
    for r in rows:
        data = (r["text"] or "").encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(r["media"]), hashlib.sha256(bytes(r["media"])).hexdigest())
    same = {r["media_sha256"] for r in rows if r["text"] == "Same TEXT here"}
    assert len(same) == 1


# --- extraction ---

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home has-sidebar"><header><h1>Site</h1><p>Slogan of the site, a long one with many words in it</p></header>
<nav><ul><li><a href=x>Home</a><li><a href=y>More</a></ul></nav><div class="cookie-notice"><p>We use cookies, accept them all please now.</p></div>%s
<aside><p>Side text with quite a lot of words that are not part of it</p></aside><section id="comments"><article class="comment"><p>Great post, thanks a lot for it!</p></article></section>
<form><label>Name</label><input></form><footer>(c) me</footer></body></html>"""


@pytest.mark.parametrize(
    ("inside", "want"),
    [
        ("<article><h1>Head</h1><p>Be.</p><p>A  b\n c &amp; d&nbsp;e &eacute;</p><div class='ad'>Buy</div><script>x='<p>no</p>'</script><p>End</p></article>", "Head\nBe.\nA b c & d e é\nEnd"),
        ("<main><p>One<br>two</p><!-- <p>no</p> --><ul><li>i</ul></main>", "One two\ni"),
        ("<div id=content><h2>Title here</h2><p>" + "long text " * 20 + "</p><p>Short.</p></div>", "Title here\n" + ("long text " * 20).strip() + "\nShort."),
        ("<article><p>" + "w " * 5 + "unclosed <b>bold", "w w w w w unclosed bold"),
        ("", ""),
    ],
)
def test_main_text(inside, want):
    page = PAGE % inside if "unclosed" not in inside else "<html><body>" + inside
    assert htmltext.main_text(page, htmltext.train()) == want


def test_odd_pages_and_linear_time(spark):
    tree = htmltext.train()
    for page in (None, "", "<", "<<<>>>", "plain", "<p", "<!-- ", "<script>", "<title>a<title>b", "</div></div>", "<a href=\"'>x"):
        assert isinstance(htmltext.main_text(page, tree), str)
    for page in ('<a href="' * 30_000, "<div>" * 30_000 + "x", "<title>" * 30_000, "</p>" * 30_000, "<p>" + "word " * 200_000):
        htmltext.main_text(page, tree)
    df = spark.createDataFrame([(1, "u", None), (2, None, "<article><p>x</p></article>"), (2, None, "<article><p>x</p></article>")], "page_id long, url string, html string")
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in htmltext.extract(df, ["page_id", "url"]).collect()) == [(1, "", 0), (2, "x", 1), (2, "x", 1)]


# --- pipeline ---


def test_pipeline_stages_chain(spark, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("quality_score", F.lit("clash"))
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, DATA)
        if k < len(P.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() <= before
        before = docs.count()
    assert before > 100 and [n for n, _ in P.STAGES] == ["quality", "toxicity", "near_dedup", "decontamination", "tokenise"]


def test_leaks_with_string_ids_and_clashing_columns(spark):
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    docs = spark.createDataFrame([("d1", f"so {words} it is", 1), ("d2", "nothing of the kind is written here at all", 2), (None, words, 3)], "doc_id string, text string, leaked int").withColumns({c: F.lit(c) for c in ("_leaked", "key", "record")})
    benchmark = spark.createDataFrame([("q-1", words), (None, "no id here")], "item_id string, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, benchmark).collect()} == {("d1", "q-1"), (None, "q-1")}
    kept = decontaminate.drop_leaked(docs, benchmark)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [tuple(r) for r in docs.where("doc_id = 'd2'").collect()]
    none = decontaminate.find_leaks(docs, benchmark.limit(0))
    assert none.collect() == [] and dict(none.dtypes)["item_id"] == "string"


def test_latent_space_is_fitted_on_all_documents(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "OFTEN", 4)
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(30)]
    docs = [(k, " ".join(rng.choices(vocabulary, [1 / (j + 1) for j in range(30)], k=rng.choice([0, 5, 70, 200])))) for k in range(2_000)] + [(None, None)]
    space = decontaminate.Space(decontaminate.passages([(k, " ".join(rng.sample(vocabulary[:25], 12)), None) for k in range(10)]))
    rows = decontaminate.numbered(spark.createDataFrame(docs, "doc_id long, text string"), space)
    assert decontaminate.document_frequencies(rows, space) == 2_001
    decontaminate.fit_space(rows, space, 2_001)
    size = len(space.vocabulary)

    def gram(parts):  # A'A by a plain loop
        out = np.zeros((size, size))
        for part in parts:
            a = np.bincount([space.vocabulary[w] for w in part if w in space.vocabulary], minlength=size) * space.idf
            if a.any():
                out += np.outer(a, a) / (a @ a)
        return out

    split = [decontaminate.words(t) for _, t in docs]
    whole = gram(w[a : a + 64] for w in split for a in range(0, len(w), 64)) * decontaminate.PER / 2_001 + decontaminate.WEIGHT * gram(w for _, w, _ in space.passages)
    got = space.basis @ space.basis.T  # all directions are kept here, each divided by the root of its value
    assert np.allclose(got @ whole, np.eye(size), atol=1e-3)


def test_pipeline_stage_fits_on_all_its_documents(spark, monkeypatch, tmp_path):
    told, fit = [], decontaminate.fit_space

    def counted(rows, space, documents, *rest):
        told.append((rows.count(), documents))
        fit(rows, space, documents, *rest)

    monkeypatch.setattr(decontaminate, "fit_space", counted)
    item = "one two three four five six seven eight nine ten eleven twelve"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.range(2_000).selectExpr("id as doc_id", f"if(id = 1999, '{item}', concat('one two five text ', id)) as text")
    assert corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path)).count() == 1_999
    assert told == [(2_000, 2_000)]  # no sample is taken before the fit


def test_candidates_are_left_out_only_by_a_bound():
    rng = random.Random(5)
    items = [(k, " ".join(rng.choices("abcdefghij", k=rng.choice([5, 20, 40])))) for k in range(20)]
    space = decontaminate.Space(decontaminate.passages([(k, t, None) for k, t in items]))
    space.basis = np.eye(len(space.vocabulary), dtype=np.float32)
    space.prepare()
    padded = np.array([rng.randrange(len(space.vocabulary) + 1) for _ in range(640)])
    p, begin = np.array([rng.randrange(len(space.ids)) for _ in range(300)]), np.array([16 * rng.randrange(36) for _ in range(300)])
    bound = decontaminate.held_words(space, padded, p, begin, begin + 48)
    for k, b, x in zip(p, begin, bound):
        there = set(padded[b : b + 48].tolist())
        assert x == sum(w in there for w in space.ids[k].tolist()) / len(space.ids[k])
        assert decontaminate.common_subsequence(space.masks[k], len(space.ids[k]), padded[b : b + 48].tolist()) <= x * len(space.ids[k])
