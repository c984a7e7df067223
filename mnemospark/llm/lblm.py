"""LM scoring: a log-bilinear neural model in numpy, trained by noise-contrastive estimation.

The two words before a token give a predicted vector (a sum of their vectors, each through the
matrix of its place). Its products with output vectors, plus biases, score the next token in two
steps. First come the ``SINGLE`` most frequent words, the end, and classes: bands of ``BAND`` further
words each, by frequency, and for all other words ``ENDINGS`` classes by a hash of their last bytes.
Then, within a band, its words are scored by the same vector; within an ending class a word has
its share of the base distribution. Both steps are normalised by batched matrix products over
distinct contexts, so the whole sums to one over the training words and one unseen word of each ending.

Training goes over every token of every training document once. Documents fall by a hash of
their id into parts of ``ROUNDS``; in each round the tasks descend from common weights over their
own documents of the part, and the weights they reach are averaged, weighted by tokens, in a tree of small rows.
Words with a vector of their own grow with the corpus, from the counts: those that occur ``LEAST`` times, up to ``WORDS``.

Base statistics are exact over all training documents: words are counted in every partition
and summed by a shuffle. Frequent words' counts (at most ``HEAD_WORDS`` and ``HEAD_BYTES``)
go to the tasks; the rest of a document's words is joined with the counts by word.

Nulls and empty texts are one end token. Rows with a null id are never learned from. Rows
may repeat, and each counts; texts of any length are read whole, in pieces of bounded memory. Ties in frequency
go to the lesser word. With nothing to learn from, score and base score are those of c = N = V = 0. An empty
table gives no rows. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemospark.llm.common import append_columns, cut_lineage, fold, held_out, one_thread, release_memory, sigmoid

SINGLE, BAND, ENDINGS, WORDS, LEAST = 128, 128, 32, 8192, 20
DIMENSION, NOISE, OWN_NOISE = 16, 32, 2
#: Tokens of a step: a thousandth of the corpus, within these bounds.
BATCHES = (256, 4096)
#: Parts of the training documents (of the last number in all) that each round goes over: together all of them.
ROUNDS, PARTS = ((0, 1), (1, 3), (3, 8)), 8
#: Tokens a task goes over in a round at least, where there are so many: weights are moved once for them.
TASK_TOKENS = 1_000_000
RATES = (0.12, 0.1, 0.06)
HEAD_WORDS, HEAD_BYTES = 300_000, 12_000_000
#: Distinct words counted in a task before they are passed on.
FLUSH = 300_000
START, END, TAIL = -3, -2, -1


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "replace").lower().split()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over whole texts; tasks add up what they have before it moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            names, numbers = list(counts), list(counts.values())
            counts.clear()
            for at in range(0, len(names), 20_000):
                part = pa.array(names[at : at + 20_000], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part, pa.array(numbers[at : at + 20_000], pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(words(text))
                if len(counts) > FLUSH:
                    yield from flush()
        yield from flush()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def ending(word: bytes) -> int:
    """The ending class of a word: a hash of its last two bytes."""
    return xxhash.xxh32_intdigest(word[-2:]) % ENDINGS


class Statistics:
    """N, V, the count of ends, the frequent words with their counts, the mass of each ending class, and the network."""

    def __init__(self, tokens: int, distinct: int, ends: int, head: list[tuple[bytes, int]], tail: np.ndarray | None = None) -> None:
        self.tokens, self.distinct, self.ends, self.head = tokens, distinct, ends, head
        self.network: dict[str, np.ndarray] | None = None
        counts = np.array([c for _, c in head], np.float64)
        self.single = min(SINGLE, len(head))
        known = int(min(WORDS, max(self.single, (counts >= LEAST).sum())))
        self.bands = (known - self.single) // BAND
        #: Words with vectors of their own; the head's others belong to their ending's class.
        self.own = self.single + self.bands * BAND
        # outputs of the first step: single words, the end, bands, endings
        self.outputs = self.single + 1 + self.bands + ENDINGS
        place = np.arange(len(head))
        self.endings = np.fromiter((ending(w) for w, _ in head), np.int64, len(head))
        first = self.single + 1 + self.bands + self.endings
        band = self.single + 1 + (place - self.single) // max(BAND, 1)
        #: By place in the head, then the end at place -2 (and nothing at -1, a word outside the head).
        self.step_one = np.concatenate([np.where(place < self.single, place, np.where(place < self.own, band, first)), [self.single, 0]]).astype(np.int64)
        #: Rows of the context vectors: own words, the end, endings, and the start.
        self.context = np.concatenate([np.where(place < self.own, place, self.own + 1 + self.endings), [self.own, 0]]).astype(np.int64)
        self.start = self.own + 1 + ENDINGS
        mass = np.bincount(self.endings[self.own :], 10 ** self.base(counts[self.own :]), ENDINGS)
        if tail is not None:
            mass = mass + tail
        #: log10 of each ending class's base mass, one unseen word's included.
        self.log_mass = np.log10(mass + 10 ** self.base(0))
        # expected counts of the first step's outputs, and those of the tokens behind each ending
        share = 10.0 ** np.concatenate([self.base(counts), [self.base(ends), 0]])
        share[-1] = 0
        self.share = np.bincount(self.step_one, share, self.outputs)
        self.share[-ENDINGS:] = mass
        self.share = (self.share + 1e-7) / (self.share + 1e-7).sum()

    def base(self, count: np.ndarray | float) -> np.ndarray:
        """log10 of the base probability of words with such counts."""
        return np.log10((np.asarray(count, np.float64) + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))


def gather_statistics(training: DataFrame, counts: DataFrame) -> Statistics:
    """Totals of the corpus and its frequent words, all that fit the bounds above a common count."""
    ends = training.count()
    step = F.floor(F.log2("n") * 8).alias("step")
    rows = counts.groupBy(step).agg(F.count("*").alias("v"), F.sum("n").alias("n"), F.sum(F.octet_length("word")).alias("b")).collect()
    least, held, size = None, 0, 0
    for r in sorted(rows, key=lambda r: -r["step"]):
        held, size = held + r["v"], size + r["b"]
        if held > HEAD_WORDS or size > HEAD_BYTES:
            break
        least = r["step"]
    head = [] if least is None else [(r["word"].encode(), r["n"]) for r in counts.where(F.floor(F.log2("n") * 8) >= least).collect()]
    head.sort(key=lambda x: (-x[1], x[0]))
    total, distinct = sum(r["n"] for r in rows) + ends, sum(r["v"] for r in rows) + (ends > 0)
    # the words outside the head by their last two bytes: at most 65,536 kinds, summed before they move
    outside = counts if least is None else counts.where(F.floor(F.log2("n") * 8) < least)
    last = F.col("word").cast("binary")
    last = F.hex(F.substring(last, -2, 2))
    tail = np.zeros(ENDINGS)
    for r in outside.groupBy(last.alias("e")).agg(F.sum(F.col("n") + 0.1).alias("m")).collect():
        tail[xxhash.xxh32_intdigest(bytes.fromhex(r["e"])) % ENDINGS] += r["m"]
    return Statistics(int(total), int(distinct), ends, head, tail / (total + 0.1 * (distinct + 1)))


class Reader:
    """From whole texts to places in the head, with the classes of each token and of the two before it."""

    def __init__(self, stats: Statistics) -> None:
        self.stats = stats
        self.get = {w: i for i, (w, _) in enumerate(stats.head)}.get

    def places(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(itertools.chain(map(self.get, ws, itertools.repeat(TAIL)), (END,)), np.int64, len(ws) + 1)

    def classes(self, flat: np.ndarray, tail: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First-step output of each token, and the context rows one and two places before it.

        ``tail`` holds the ending classes of the tokens outside the head, in their order.
        """
        s = self.stats
        target, row = s.step_one[flat], s.context[flat]
        outside = flat == TAIL
        target[outside] = s.single + 1 + s.bands + tail
        row[outside] = s.own + 1 + tail
        one = np.concatenate([[s.start], row[:-1]])
        two = np.concatenate([[s.start, s.start], row[:-2]])[: len(row)]
        begin = np.cumsum(lengths) - lengths
        one[begin] = s.start
        two[begin] = s.start
        two[begin[lengths > 1] + 1] = s.start
        return target, one, two


def first_weights(stats: Statistics, seed: int = 6) -> dict[str, np.ndarray]:
    """The common weights that training starts from: biases are the base shares."""
    rng = np.random.default_rng(seed)
    return {
        "r": rng.normal(0, 0.1, (stats.start + 1, DIMENSION)).astype(np.float32),
        "c1": np.eye(DIMENSION, dtype=np.float32),
        "c2": 0.5 * np.eye(DIMENSION, dtype=np.float32),
        "q": rng.normal(0, 0.1, (stats.outputs, DIMENSION)).astype(np.float32),
        "b": np.log(stats.share).astype(np.float32),
        "v": rng.normal(0, 0.1, (stats.bands * BAND, DIMENSION)).astype(np.float32),
        "a": band_biases(stats),
    }


def band_biases(stats: Statistics) -> np.ndarray:
    """Log shares of the words within their bands."""
    n = np.array([c for _, c in stats.head[stats.single : stats.own]], np.float64).reshape(-1, BAND)
    return np.log(n / n.sum(axis=1, keepdims=True)).ravel().astype(np.float32) if n.size else np.zeros(0, np.float32)


def in_order(at: np.ndarray, bound: int) -> np.ndarray:
    """The stable order of numbers below ``bound``; two-byte numbers are sorted by their bytes, which is quick."""
    return np.argsort(at.astype(np.uint16) if bound <= 1 << 16 else at, kind="stable")


def summed_rows(at: np.ndarray, bound: int, *rows: np.ndarray) -> list[np.ndarray]:
    """The distinct numbers in ``at`` (below ``bound``) and, for each, the sum of its rows in each of ``rows``."""
    order = in_order(at, bound)
    at = at[order]
    begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return [at[begin], *(np.add.reduceat(r[order], begin, axis=0) for r in rows)]


class Learner:
    """Stochastic descent with step sizes by each weight's gradients so far (AdaGrad), over batches of tokens."""

    def __init__(self, stats: Statistics, weights: dict[str, np.ndarray], rate: float, seed: int) -> None:
        self.stats, self.rate = stats, rate
        self.p = {k: v.astype(np.float32).copy() for k, v in weights.items()}
        self.g = {k: np.full_like(v, 1e-2) for k, v in self.p.items()}
        self.rng = np.random.default_rng(seed)
        self.edges = np.cumsum(stats.share)
        self.log_noise = (math.log(NOISE) + np.log(stats.share)).astype(np.float32)
        self.band_share = band_biases(stats)
        self.batch, self.tokens = int(np.clip(stats.tokens // 1000, *BATCHES)), 0

    def step(self, key: str, grad: np.ndarray, at: np.ndarray | slice = slice(None)) -> None:
        g = self.g[key]
        now = g[at] + grad * grad
        g[at] = now
        self.p[key][at] -= self.rate * grad / np.sqrt(now)

    def learn(self, target: np.ndarray, word: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        """One batch: first-step outputs, own-word places (-1: none in a band), context rows."""
        p, size = self.p, len(target)
        self.tokens += size
        r1, r2 = p["r"][one], p["r"][two]
        h = r1 @ p["c1"] + r2 @ p["c2"]
        n = np.minimum(np.searchsorted(self.edges, self.rng.random(NOISE)), len(self.edges) - 1)
        qt, qn = p["q"][target], p["q"][n]
        own = sigmoid((h * qt).sum(1) + p["b"][target] - self.log_noise[target]) - 1
        other = sigmoid(h @ qn.T + p["b"][n] - self.log_noise[n])
        gh = own[:, None] * qt + other @ qn
        qa, qg, bg = summed_rows(np.concatenate([target, n]), self.stats.outputs, np.concatenate([own[:, None] * h, other.T @ h]), np.concatenate([own, other.sum(0)]))
        inside = np.flatnonzero(word >= 0)
        if len(inside):  # the same within the bands, against words drawn from the token's own band
            hb, w = h[inside], word[inside]
            drawn = (w // BAND * BAND)[:, None] + self.rng.integers(0, BAND, (len(w), OWN_NOISE))
            both = np.concatenate([w[:, None], drawn], axis=1)
            vec = p["v"][both]
            # words are drawn evenly, so each has a BANDth of OWN_NOISE draws
            d = sigmoid(np.einsum("ij,ikj->ik", hb, vec) + p["a"][both] - np.float32(math.log(OWN_NOISE / BAND)))
            d[:, 0] -= 1
            gh[inside] += np.einsum("ik,ikj->ij", d, vec)
            va, vg, ag = summed_rows(both.ravel(), len(p["v"]), (d[:, :, None] * hb[:, None, :]).reshape(-1, DIMENSION), d.ravel())
            self.step("v", vg, va)
            self.step("a", ag, va)
        ra, rg = summed_rows(np.concatenate([one, two]), len(p["r"]), np.concatenate([gh @ p["c1"].T, gh @ p["c2"].T]))
        self.step("c1", r1.T @ gh)
        self.step("c2", r2.T @ gh)
        self.step("q", qg, qa)
        self.step("b", bg, qa)
        self.step("r", rg, ra)

    def learn_texts(self, reader: Reader, texts: list[str | None]) -> None:
        """All tokens of whole texts, in random batches."""
        s = self.stats
        docs = [words(t) for t in texts]
        ids = [reader.places(d) for d in docs]
        flat, lengths = np.concatenate(ids), np.array([len(i) for i in ids])
        tail = np.array([ending(d[k]) for d, i in zip(docs, ids) for k in np.flatnonzero(i == TAIL).tolist()], np.int64)
        target, one, two = reader.classes(flat, tail, lengths)
        word = np.where((flat >= s.single) & (flat < s.own), flat - s.single, -1)
        order = self.rng.permutation(len(flat))
        for at in range(0, len(order), self.batch):
            i = order[at : at + self.batch]
            self.learn(target[i], word[i], one[i], two[i])


def groups_of(texts: list[str | None], most: int) -> Iterator[list[str | None]]:
    """The texts in groups of about ``most`` bytes at most; a longer one by itself."""
    group, size = [], 0
    for t in texts:
        if group and size + len(t or "") > most:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t or "")
    if group:
        yield group


def packed(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in sorted(weights)])


def unpacked(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    ends = np.cumsum([like[k].size for k in sorted(like)])
    return {k: flat[end - like[k].size : end].reshape(like[k].shape) for k, end in zip(sorted(like), ends)}


MOVES = "part int, tokens double, summed boolean, moved binary"


def move_row(part: int, tokens: float, summed: bool, moved: np.ndarray) -> pa.RecordBatch:
    """A task's move of the weights (half precision), or a sum of moves times their tokens (single precision)."""
    kinds = [("part", pa.int32()), ("tokens", pa.float64()), ("summed", pa.bool_()), ("moved", pa.binary())]
    data = moved.astype(np.float32 if summed else np.float16).tobytes()
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip((part, tokens, summed, data), kinds)], names=[n for n, _ in kinds])


def averaged(moves: DataFrame) -> tuple[np.ndarray, float]:
    """The tasks' moves times their tokens, added up in a tree of at most 64, then 8 sums; and all tokens."""

    def one(r: dict) -> np.ndarray:
        return np.frombuffer(r["moved"], np.float32) if r["summed"] else np.frombuffer(r["moved"], np.float16).astype(np.float32) * np.float32(r["tokens"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, tokens, part = None, 0.0, 0
        for batch in batches:
            for r in batch.to_pylist():
                total, tokens, part = one(r) if total is None else total + one(r), tokens + r["tokens"], r["part"]
        if total is not None:
            yield move_row(part, tokens, True, total)

    for width in (64, 8):
        moves = moves.withColumn("part", F.pmod("part", F.lit(width))).repartition(width, "part").mapInArrow(add, MOVES)
    rows = moves.collect()
    return sum(map(one, rows), np.float32(0)), sum(r["tokens"] for r in rows)


def train(training: DataFrame, stats: Statistics, seed: int = 6) -> dict[str, np.ndarray]:
    """The network's weights, from every token of every training document (doc_id, text)."""
    context = training.sparkSession.sparkContext
    weights = first_weights(stats, seed)
    part = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(PARTS))
    for k, ((low, high), rate) in enumerate(zip(ROUNDS, RATES)):
        shared = context.broadcast((stats, weights))
        # a text goes to the tasks of its round only; small rounds to few tasks
        own = training.where((part >= low) & (part < high)).select("text", F.spark_partition_id().alias("p"))
        own = own.coalesce(max(1, stats.tokens * (high - low) // PARTS // TASK_TOKENS))

        def run(batches: Iterator[pa.RecordBatch], k=k, rate=rate, shared=shared) -> Iterator[pa.RecordBatch]:
            one_thread()
            learner = reader = None
            for batch in batches:
                if learner is None and batch.num_rows:
                    s, begin = shared.value
                    learner, reader = Learner(s, begin, rate, 1000 * k + batch.column(1)[0].as_py()), Reader(s)
                    first = batch.column(1)[0].as_py()
                for at in range(0, batch.num_rows, 512):
                    for group in groups_of(batch.column(0).slice(at, 512).to_pylist(), 400_000):
                        learner.learn_texts(reader, group)
            if learner is not None:
                yield move_row(first, float(learner.tokens), False, packed({n: learner.p[n] - begin[n] for n in begin}))
            learner = reader = None
            release_memory()

        total, tokens = averaged(own.mapInArrow(run, MOVES))
        if tokens:
            move = unpacked(total / np.float32(tokens), weights)
            weights = {n: weights[n] + move[n] for n in weights}
        shared.unpersist()
    return weights


class Scorer:
    """Normalised natural log-probabilities of tokens, by matrix products over their distinct contexts."""

    def __init__(self, stats: Statistics) -> None:
        self.stats, p = stats, stats.network
        self.first, self.second = p["r"] @ p["c1"], p["r"] @ p["c2"]
        self.q, self.b = p["q"], p["b"]
        self.v, self.a = p["v"].reshape(-1, BAND, DIMENSION), p["a"].reshape(-1, BAND)

    def log_probabilities(self, target: np.ndarray, word: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Of first-step outputs and, where a token is a word of a band, of the word within it too."""
        base = len(self.first)
        keys, inverse = np.unique(one * base + two, return_inverse=True)
        h = self.first[keys // base] + self.second[keys % base]
        norm = np.empty(len(keys), np.float32)
        for at in range(0, len(keys), 4096):
            norm[at : at + 4096] = log_sum(h[at : at + 4096] @ self.q.T + self.b)
        ht = h[inverse]
        out = np.einsum("ij,ij->i", ht, self.q[target]) + self.b[target] - norm[inverse]
        inside = np.flatnonzero(word >= 0)
        order = inside[in_order(word[inside] // BAND, len(self.v))]
        bands = word[order] // BAND
        for band in np.unique(bands):  # one matrix product for each band
            i = order[np.searchsorted(bands, band) : np.searchsorted(bands, band, side="right")]
            for at in range(0, len(i), 4096):
                part = i[at : at + 4096]
                s = ht[part] @ self.v[band].T + self.a[band]
                chosen = s[np.arange(len(part)), word[part] % BAND].copy()
                out[part] += chosen - log_sum(s)
        return out


def log_sum(s: np.ndarray) -> np.ndarray:
    """Natural logs of the sums of exponentials of each row; ``s`` is overwritten."""
    top = s.max(axis=1)
    s -= top[:, None]
    np.exp(s, out=s)
    return np.log(s.sum(axis=1)) + top


def document_scorer(stats: Statistics) -> Callable[[list[str | None]], list]:
    """From whole texts: tokens, known head tokens, base and model sums without the tail's own part, and the tail's words."""
    counts = np.array([c for _, c in stats.head], np.float64)
    base = np.concatenate([stats.base(counts), [stats.base(stats.ends), 0.0]])  # place -2 is the end, -1 the tail
    reader, scorer = Reader(stats), Scorer(stats) if stats.network is not None else None

    def score(texts: list[str | None]) -> list:
        out = [[], [], [], [], []]
        for group in groups_of(texts, 1_000_000):
            docs = [words(t) for t in group]
            ids = [reader.places(d) for d in docs]
            flat, lengths = np.concatenate(ids), np.array([len(d) for d in ids])
            begin = np.cumsum(lengths) - lengths
            own = base[flat]
            known = np.where(flat == END, stats.ends > 0, flat >= 0)
            tails = [[d[k] for k in np.flatnonzero(i == TAIL).tolist()] for d, i in zip(docs, ids)]
            model = own
            if scorer is not None:
                tail = np.array([ending(w) for ws in tails for w in ws], np.int64)
                target, one, two = reader.classes(flat, tail, lengths)
                word = np.where((flat >= stats.single) & (flat < stats.own), flat - stats.single, -1)
                model = np.empty(len(flat))
                for at in range(0, len(flat), 200_000):
                    part = slice(at, at + 200_000)
                    model[part] = scorer.log_probabilities(target[part], word[part], one[part], two[part])
                model /= math.log(10)
                e = target - (stats.outputs - ENDINGS)
                # an ending class's word has its share of the class; the tail's own base follows later
                model += np.where(e >= 0, own - stats.log_mass[np.maximum(e, 0)], 0.0)
            out[0] += lengths.tolist()
            out[1] += np.add.reduceat(known.astype(np.int64), begin).tolist()
            out[2] += np.add.reduceat(own, begin).tolist()
            out[3] += np.add.reduceat(model, begin).tolist()
            out[4] += [b" ".join(ws) or None for ws in tails]
        return [*out[:4], pa.array(out[4], pa.binary()).cast(pa.string())]

    return score


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    docs = docs.select("doc_id", "text")
    training = docs.where(fold(F.col("doc_id"), 10) != 0)
    counts = cut_lineage(count_words(training))
    stats = gather_statistics(training, counts)
    if stats.head:
        stats.network = train(training, stats)
    shared = docs.sparkSession.sparkContext.broadcast(stats)
    new = [("n_tokens", T.LongType()), ("known", T.LongType()), ("base", T.DoubleType()), ("model", T.DoubleType()), ("tail", T.StringType())]
    # the row numbers must not change between the two uses below
    rows = cut_lineage(append_columns(docs, "text", ["doc_id"], new, lambda: document_scorer(shared.value)).withColumn("row", F.monotonically_increasing_id()))
    tail = rows.where(F.col("tail").isNotNull()).select("row", F.explode(F.split("tail", " ")).alias("word"))
    whole = F.lit(stats.tokens + 0.1 * (stats.distinct + 1))
    own = F.log10((F.coalesce(F.col("n"), F.lit(0)) + 0.1) / whole)
    found = tail.join(counts, "word", "left").groupBy("row").agg(F.sum(own).alias("tail_base"), F.count("n").alias("tail_known"))
    none = F.lit(0.0)
    return rows.join(found, "row", "left").select(
        "doc_id",
        held_out(F.col("doc_id"), 10, 0).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(stats.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", none)).alias("base_score"),
        (F.col("model") + F.coalesce("tail_base", none)).alias("score"),
    )
