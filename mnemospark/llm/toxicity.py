"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its learned word vector (for words of the training sample's vocabulary)
beside the mean of its hashed character n-grams' learned vectors, so unseen spellings also count. Both start
from the classes' log odds and are trained with the network. All
windows of ``LENGTH`` words, overlapping by half, over the whole text are scored; a text's
score comes from its highest window through a fitted logistic curve. Long runs without
spaces are read as overlapping pieces, each a word.

Nulls and empty texts are one window of padding. Equal texts get equal scores; repeated rows are scored like
others; an empty table gives no rows. Among windows with equal scores any stands for the text; a score that equals
the threshold drops its document. Other columns are never read; one named like the score is replaced. Without labelled rows of both classes the
score is the labels' rate of 1 (0 with none).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemospark.llm.common import Adam, append_columns, labelled_sample, release_memory, sigmoid

LENGTH, HALF, STATE, WORD, CHAR, BUCKETS, VOCABULARY = 16, 8, 8, 6, 6, 8192, 6000
#: At most so many labelled texts of each class are learned from.
SAMPLE_PER_CLASS = 1200
ROUNDS, MEMO, LEAST, UNSEEN, SETTLE = 8, 120_000, 3, 0.1, 0.1
#: Longer tokens are read as pieces of so many characters, each half over the next.
LONGEST, PIECE = 40, 20
PUNCTUATION = ".,;:!?\"'()[]{}<>|*#$%&-_/\\"
THRESHOLD = 0.5


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of all words, end to end, and how many each word has.

    Every trigram of the bounded word ``^word$``, its starts of 4 to 8 characters and its
    ends of 4 and 5. Each word has one at least.
    """
    bounded = [f"^{w}$" if w else "^^$" for w in words]
    points = np.frombuffer("".join(bounded).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, bounded), np.int64, len(bounded))
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(points)) - begin[owner]
    hashed, owners = [], []

    def add(h: np.ndarray, who: np.ndarray, kind: int) -> None:
        h = (h + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
        hashed.append((h >> np.uint64(40)) % np.uint64(BUCKETS))
        owners.append(who)

    inner = np.flatnonzero(place <= sizes[owner] - 3)
    key = (points[inner] * np.uint64(1_000_003) + points[inner + 1]) * np.uint64(1_000_003) + points[inner + 2]
    add(key, owner[inner], 0)
    for kind, origin, step, lengths in ((1, begin, 1, (4, 5, 6, 7, 8)), (2, begin + sizes - 1, -1, (4, 5))):
        h, who = np.zeros(len(words), np.uint64), np.arange(len(words))
        for k in range(1, max(lengths) + 1):
            ok = sizes[who] >= k
            who, h = who[ok], h[ok]
            h = h * np.uint64(1_000_003) + points[origin[who] + step * (k - 1)]
            if k in lengths:
                add(h, who, 16 * kind + k)
    owners_, hashed_ = np.concatenate(owners), np.concatenate(hashed).astype(np.int64)
    order = np.argsort(owners_, kind="stable")
    return hashed_[order], np.bincount(owners_, minlength=len(words))


def char_means(words: list[str], chars: np.ndarray) -> np.ndarray:
    """The mean character n-gram vector of each word (zero for an empty one)."""
    rows, counts = grams(words)
    out = np.add.reduceat(chars[rows], np.cumsum(counts) - counts, axis=0) / counts[:, None]
    out[np.fromiter((not w for w in words), bool, len(words))] = 0
    return out.astype(np.float32)


def cleaned(token: str) -> str:
    return token.strip(PUNCTUATION)


def words_of(text: str | None) -> list[str]:
    """The text's tokens; those longer than ``LONGEST`` characters as overlapping pieces, so all of them is read."""
    words = (text or "").lower().split()
    if not words or max(map(len, words)) <= LONGEST:
        return words
    out = []
    for w in words:
        if len(w) <= LONGEST or len(cleaned(w)) <= LONGEST:
            out.append(w)
        else:
            out += [w[at : at + PIECE] for at in range(0, len(w) - PIECE // 2, PIECE // 2)]
    return out


class Lexicon:
    """Rows of word and character inputs for raw tokens; a memo that is emptied when full."""

    def __init__(self, vocabulary: dict[str, int], project) -> None:
        self.vocabulary, self.project, self.rows = vocabulary, project, {}
        self.table = np.zeros((1024, 6 * STATE), np.float32)
        self.reset()

    def reset(self) -> None:
        self.rows = {"": 0}
        self.table[0] = self.project([""])[0]

    def lookup(self, tokens: list[str]) -> np.ndarray:
        rows = self.rows
        new = list(set(tokens).difference(rows))
        if len(rows) + len(new) > MEMO and len(rows) > 1:
            self.reset()
            rows, new = self.rows, list(set(tokens))
        if new:
            base = len(rows)
            for k, t in enumerate(new):
                rows[t] = base + k
            while len(self.table) < base + len(new):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            for at in range(0, len(new), 4096):
                part = new[at : at + 4096]
                self.table[base + at : base + at + len(part)] = self.project(part)
        return np.fromiter(map(rows.__getitem__, tokens), np.int64, len(tokens))


def inputs(tokens: list[str], vocabulary: dict[str, int], words: np.ndarray, chars: np.ndarray) -> np.ndarray:
    clean = [cleaned(t) for t in tokens]
    known = words[np.fromiter((vocabulary.get(w, 0) for w in clean), np.int64, len(clean))]
    return np.concatenate([known, char_means(clean, chars)], axis=1)


def run_gru(x: np.ndarray, u: np.ndarray, reverse: bool, keep: bool = False):
    """States (B, L, H) of a gated recurrent layer over projected inputs x (B, L, 3H)."""
    n, length, _ = x.shape
    h = np.zeros((n, STATE), np.float32)
    out = np.empty((length, n, STATE), np.float32)
    tape = []
    for t in range(length - 1, -1, -1) if reverse else range(length):
        a = h @ u
        gates = sigmoid(x[:, t, : 2 * STATE] + a[:, : 2 * STATE])
        z, r = gates[:, :STATE], gates[:, STATE:]
        new = np.tanh(x[:, t, 2 * STATE :] + r * a[:, 2 * STATE :])
        if keep:
            tape.append((t, h, z, r, new, a[:, 2 * STATE :]))
        h = new + z * (h - new)
        out[t] = h
    return out, tape


def back_gru(tape, u, dout):
    """Gradients of the projected inputs and of u, given those of the states (L, B, H)."""
    n = dout.shape[1]
    du, dh, dx = np.zeros_like(u), np.zeros((n, STATE), np.float32), np.zeros((n, dout.shape[0], 3 * STATE), np.float32)
    for t, h, z, r, new, an in reversed(tape):
        d = dh + dout[t]
        dn = d * (1 - z) * (1 - new**2)
        da = np.concatenate([d * (h - new) * z * (1 - z), dn * an * r * (1 - r), dn * r], axis=1)
        dx[:, t, : 2 * STATE], dx[:, t, 2 * STATE :] = da[:, : 2 * STATE], dn
        du += h.T @ da
        dh = d * z + da @ u.T
    return dx, du


def attend(states: np.ndarray, p: dict):
    """Attention-pooled states and window logits; states (L, B, 2H)."""
    e = np.tanh(states @ p["att"])
    s = e @ p["query"]
    s -= s.max(axis=0)
    w = np.exp(s)
    w /= w.sum(axis=0)
    pooled = (w[..., None] * states).sum(axis=0)
    return e, w, pooled, pooled @ p["out"] + p["bias"][0]


def forward(x: np.ndarray, p: dict) -> np.ndarray:
    """Logits of windows whose projected inputs (both directions side by side) are x (B, L, 6H)."""
    f, _ = run_gru(x[:, :, : 3 * STATE], p["uf"], False)
    b, _ = run_gru(x[:, :, 3 * STATE :], p["ub"], True)
    return attend(np.concatenate([f, b], axis=2), p)[3]


def windows(ids: np.ndarray) -> np.ndarray:
    """Every window of a text's rows; row 0 pads."""
    n = max(1, -(-(len(ids) - HALF) // HALF))
    padded = np.zeros((n + 1) * HALF, np.int32)
    padded[: len(ids)] = ids
    halves = padded.reshape(-1, HALF)
    return np.concatenate([halves[:-1], halves[1:]], axis=1)


def train(sample: list[tuple[str, int]], counts_of: tuple[int, int] | None = None, seed: int = 8) -> dict:
    """Weights from (text, label) pairs; the windows that speak for the label are found while learning.

    ``counts_of`` gives how many rows of each class the sample stands for.
    """
    ys = np.array([y for _, y in sample], np.float32)
    if not len(ys) or ys.min() == ys.max():
        return {"prior": float(ys.mean()) if len(ys) else 0.0}
    rng = np.random.default_rng(seed)
    apart = np.arange(len(ys)) % 5 == 4  # a fifth stays out of the weights, for the curve
    if len(set(ys[apart])) < 2 or len(set(ys[~apart])) < 2:
        apart[:] = False
    used = ~apart
    texts = [words_of(t) for t, _ in sample]
    tokens = [""] + sorted({w for t in texts for w in t})
    row = {t: i for i, t in enumerate(tokens)}
    ids = [np.array([row[w] for w in t], np.int32) for t in texts]
    del texts, row  # over a million word objects
    clean = [cleaned(t) for t in tokens]
    counts: dict[str, list[int]] = {}
    gram_rows, per = grams(clean)
    gram_at = np.cumsum(per) - per
    seen = np.zeros((2, BUCKETS))
    for i, y in zip([i for i, u in zip(ids, used) if u], ys[used]):
        distinct = np.unique(i)
        for w in {clean[k] for k in distinct} - {""}:
            counts.setdefault(w, [0, 0])[int(y)] += 1
        g = np.unique(np.concatenate([gram_rows[a : a + n] for a, n in zip(gram_at[distinct], per[distinct])])) if len(distinct) else distinct
        seen[int(y), g] += 1
    totals = np.array([max(1, (ys[used] == 0).sum()), max(1, (ys[used] == 1).sum())], float)

    def odds(c0, c1):
        rate0, rate1 = (c0 + 0.5) / (totals[0] + 1), (c1 + 0.5) / (totals[1] + 1)
        return np.log(rate1 / rate0) * (c0 + c1) / (c0 + c1 + 4)

    common = [w for w in counts if sum(counts[w]) >= LEAST]
    ranked = sorted(common, key=lambda w: (-abs(odds(*counts[w])), w))[:VOCABULARY]
    vocabulary = {w: i + 1 for i, w in enumerate(ranked)}
    words = rng.normal(0, 0.1, (len(ranked) + 1, WORD)).astype(np.float32)
    words[0] = 0
    words[1:, 0] = [odds(*counts[w]) / 2 for w in ranked]
    chars = rng.normal(0, 0.1, (BUCKETS, CHAR)).astype(np.float32)
    chars[:, 0] = odds(seen[0], seen[1])

    word_row = np.array([vocabulary.get(c, 0) if c else 0 for c in clean])
    real = np.array([bool(c) for c in clean])
    p = {
        "wx": rng.normal(0, 0.25, (WORD + CHAR, 6 * STATE)).astype(np.float32),
        "bx": np.zeros(6 * STATE, np.float32),
        "uf": rng.normal(0, 0.25, (STATE, 3 * STATE)).astype(np.float32),
        "ub": rng.normal(0, 0.25, (STATE, 3 * STATE)).astype(np.float32),
        "att": rng.normal(0, 0.3, (2 * STATE, STATE)).astype(np.float32),
        "query": rng.normal(0, 0.3, STATE).astype(np.float32),
        "out": rng.normal(0, 0.3, 2 * STATE).astype(np.float32),
        "bias": np.zeros(1, np.float32),
        "words": words,
        "chars": chars,
    }
    adam, chars_start = Adam(p, 5e-3), chars.copy()

    def spelled(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The n-grams of some tokens end to end, where each token's begin, and the tokens' mean vectors."""
        n = per[which]
        begin = np.cumsum(n) - n
        rows = gram_rows[np.repeat(gram_at[which] - begin, n) + np.arange(n.sum())]
        mean = np.add.reduceat(p["chars"][rows], begin, axis=0) / n[:, None]
        return rows, n, (mean * real[which, None]).astype(np.float32)

    def char_inputs() -> np.ndarray:
        return np.concatenate([spelled(np.arange(at, min(at + 20_000, len(tokens))))[2] for at in range(0, len(tokens), 20_000)])

    char_in = char_inputs()

    def project_all() -> np.ndarray:
        return np.concatenate([p["words"][word_row] * real[:, None], char_in], axis=1) @ p["wx"] + p["bx"]

    per_text = [windows(i) for i in ids]
    owner = np.repeat(np.arange(len(per_text)), [len(w) for w in per_text])
    every = np.concatenate(per_text)
    sizes = np.array([len(w) for w in per_text])
    starts = np.cumsum(sizes) - sizes
    del per_text
    hint = p["words"][word_row, 0] * real + char_in[:, 0]
    score = hint[every].max(axis=1)

    def best(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text, its highest window and the next (the same if it has but one)."""
        order = np.lexsort((-scores, owner))
        return order[starts], order[np.minimum(starts + 1, starts + sizes - 1)]

    for turn in range(ROUNDS):
        top, after = best(score)
        spare = rng.permutation(np.flatnonzero((ys[owner] == 0) & used[owner]))[: len(ys)]
        chosen = np.concatenate([top[used], after[used & (ys == 0)], spare])
        target = ys[owner[chosen]]
        weight = np.where(target == 1, 0.5 / max(target.mean(), 1e-3), 0.5 / max(1 - target.mean(), 1e-3)).astype(np.float32)
        for _ in range(max(1, 60 // max(1, len(chosen) // 64))):
            order = rng.permutation(len(chosen))
            for at in range(0, len(order), 64):
                b = order[at : at + 64]
                win = every[chosen[b]]
                flat = win.ravel()
                shown = real[flat] & (rng.random(len(flat)) > UNSEEN)  # a word must also do by its characters
                distinct, back = np.unique(flat, return_inverse=True)
                g_rows, g_sizes, spelling = spelled(distinct)
                xin = np.concatenate([p["words"][word_row[flat]] * shown[:, None], spelling[back]], axis=1)
                x = (xin @ p["wx"] + p["bx"]).reshape(len(b), LENGTH, 6 * STATE)
                sf, tf = run_gru(x[:, :, : 3 * STATE], p["uf"], False, True)
                sb, tb = run_gru(x[:, :, 3 * STATE :], p["ub"], True, True)
                states = np.concatenate([sf, sb], axis=2)
                e, w, pooled, logit = attend(states, p)
                g = ((sigmoid(logit) - target[b]) * weight[b] / len(b)).astype(np.float32)
                dpool = g[:, None] * p["out"]
                dw = (states * dpool).sum(axis=2)
                ds = w * (dw - (w * dw).sum(axis=0))
                de = ds[..., None] * p["query"] * (1 - e**2)
                dstates = w[..., None] * dpool + de @ p["att"].T
                dxf, duf = back_gru(tf, p["uf"], dstates[:, :, :STATE])
                dxb, dub = back_gru(tb, p["ub"], dstates[:, :, STATE:])
                dx = np.concatenate([dxf, dxb], axis=2).reshape(-1, 6 * STATE)
                dxin = dx @ p["wx"].T
                dwords = np.zeros_like(p["words"])
                np.add.at(dwords, word_row[flat], dxin[:, :WORD] * shown[:, None])
                dwords[0] = 0
                # a token's gradient falls on its n-grams in equal parts
                dspelling = np.zeros((len(distinct), CHAR), np.float32)
                np.add.at(dspelling, back, dxin[:, WORD:])
                part = np.repeat(dspelling * (real[distinct] / g_sizes)[:, None], g_sizes, axis=0)
                dchars = np.stack([np.bincount(g_rows, part[:, c], BUCKETS) for c in range(CHAR)], axis=1).astype(np.float32)
                adam.step(
                    {
                        "wx": xin.T @ dx, "bx": dx.sum(0), "uf": duf, "ub": dub,
                        "att": np.einsum("lbi,lbj->ij", states, de), "query": np.einsum("lb,lbj->j", ds, e),
                        "out": pooled.T @ g, "bias": g.sum(keepdims=True), "words": dwords, "chars": dchars,
                    }
                )
                # n-grams that the sample holds a few times only stay near where they start
                p["chars"] += SETTLE * (chars_start - p["chars"])
        if turn % 2 == 0 and turn < ROUNDS - 2:
            continue
        char_in = char_inputs()
        table = project_all()
        score = np.concatenate([forward(table[every[at : at + 4096]], p) for at in range(0, len(every), 4096)])
    fit_on = apart if apart.any() else used
    top, seen_y = np.maximum.reduceat(score, starts)[fit_on], ys[fit_on]
    # the curve from a text's highest window to its label, at the classes' own rates
    rate = counts_of[1] / sum(counts_of) if counts_of else float(ys.mean())
    share = np.where(seen_y == 1, rate / max(seen_y.mean(), 1e-6), (1 - rate) / max(1 - seen_y.mean(), 1e-6))
    design, coef = np.stack([top, np.ones_like(top)], axis=1).astype(np.float64), np.array([1.0, -1.0])
    for _ in range(50):
        q = sigmoid(design @ coef)
        slope = design.T @ (share * (q - seen_y)) + 0.02 * coef * [1, 0]
        curve = (design * (share * q * (1 - q))[:, None]).T @ design + np.diag([0.02, 1e-6])
        coef = coef - np.clip(np.linalg.solve(curve, slope), -0.5, 0.5)
    a, c = map(float, coef)
    return p | {"vocabulary": vocabulary, "curve": (a, c)}


def scorer(model: dict):
    """A function from whole texts to their probabilities."""
    if "prior" in model:
        return lambda texts: [np.full(len(texts), model["prior"])]
    project = lambda tokens: inputs(tokens, model["vocabulary"], model["words"], model["chars"]) @ model["wx"] + model["bx"]
    lexicon = Lexicon(model["vocabulary"], project)
    a, c = model["curve"]

    def score(texts: list[str | None]) -> list[np.ndarray]:
        out = np.empty(len(texts))
        at = 0
        while at < len(texts):  # as many texts at a time as make about 128,000 words
            group, size = [], 0
            while at + len(group) < len(texts) and (not group or size < 128_000):
                group.append(words_of(texts[at + len(group)]))
                size += len(group[-1])
            rows = lexicon.lookup([w for g in group for w in g])
            edges = np.cumsum([0, *map(len, group)])
            parts = [windows(rows[edges[k] : edges[k + 1]]) for k in range(len(group))]
            every = np.concatenate(parts)
            logits = np.concatenate([forward(lexicon.table[every[i : i + 2048]], model) for i in range(0, len(every), 2048)])
            starts = np.concatenate([[0], np.cumsum([len(x) for x in parts])[:-1]])
            out[at : at + len(group)] = sigmoid(a * np.maximum.reduceat(logits, starts).astype(np.float64) + c)
            at += len(group)
        return [out]

    return score


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> dict:
    """The model learned from the labelled documents outside the held-out fold."""
    sample, counts_of = labelled_sample(docs, labels, "toxic", 5, per_class)
    model = train(sample, counts_of)
    release_memory()
    return model


def score_toxicity(docs: DataFrame, model: dict, keep: list[str], name: str = "score") -> DataFrame:
    """``keep`` and the toxicity of every row's whole text, as ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return append_columns(docs, "text", keep, [(name, T.DoubleType())], lambda: scorer(shared.value))


def drop_toxic(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with their columns, whose toxicity is below ``threshold``."""
    name = "toxicity_score"
    while name in docs.columns:
        name = f"_{name}"
    return score_toxicity(docs, model, docs.columns, name).where(F.col(name) < threshold).drop(name)
