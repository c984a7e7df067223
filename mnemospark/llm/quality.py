"""Quality classifier: a byte-level convolutional network in numpy.

Each of the 256 byte values has a learned vector, which starts from the classes the byte belongs to. Filters of ``WIDTH`` bytes slide over the UTF-8 bytes with stride ``STRIDE``; responses are
max-pooled within chunks of ``2 * HALF`` bytes that overlap by half and cover the whole text;
a small layer maps each chunk's pooled responses to hidden values, whose mean over all
chunks gives one probability. Every byte of a text is read, at any length.

Nulls and empty texts count as a single chunk of padding and get that chunk's score. Equal texts get equal
scores, whatever stands beside them, and repeated rows are scored like others; an empty table gives no rows. A score
that equals the threshold keeps its document. Other columns are never read; one named like the score is replaced.
Without labelled rows of both classes the score is the labels' rate of 1 (0.5 with none).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemospark.llm.common import Adam, append_columns, labelled_sample, release_memory, sigmoid

WIDTH, STRIDE, HALF, FILTERS, HIDDEN, VECTOR = 16, 4, 64, 16, 8, 14
#: Of the labelled texts, at most so many of each class are learned from; the rest of the
#: labels adds nothing that the held-out accuracy shows.
SAMPLE_PER_CLASS = 1000
EPOCHS, CHUNKS_PER_TEXT, BATCH, SHORT = 10, 12, 32, 0.25
THRESHOLD = 0.3


def byte_features() -> np.ndarray:
    """The classes of each of the 256 bytes, from which its vector starts."""
    b = np.arange(256)
    return np.stack(
        [
            (b >= 65) & (b <= 90),
            (b >= 97) & (b <= 122),
            (b >= 48) & (b <= 57),
            (b == 32) | (b == 9),
            (b == 10) | (b == 13),
            np.isin(b, list(b".,;:'?")),
            (b == 33),
            (b > 34) & (b < 127) & ~((b >= 48) & (b <= 57)) & ~((b >= 65) & (b <= 90)) & ~((b >= 97) & (b <= 122)) & ~np.isin(b, list(b".,;:'?")),
            b >= 0xC0,
            (b >= 0x80) & (b < 0xA0),
            (b >= 0xA0) & (b < 0xC0),
        ],
        axis=1,
    ).astype(np.float32)


def chunk_bytes(data: np.ndarray) -> tuple[np.ndarray, int]:
    """``data`` padded to whole half-chunks (and the last filter's reach), and the number of chunks."""
    halves = max(2, -(-len(data) // HALF))
    out = np.zeros(halves * HALF + WIDTH, np.uint8)
    out[: len(data)] = data
    return out, halves - 1


def train(sample: list[tuple[str, int]], seed: int = 9) -> dict:
    """The network's weights from (text, label) pairs."""
    ys = np.array([y for _, y in sample], np.float32)
    if not len(ys) or ys.min() == ys.max():
        return {"prior": float(ys.mean()) if len(ys) else 0.5}
    rng = np.random.default_rng(seed)
    d, start = VECTOR, byte_features()
    vectors = rng.normal(0, 0.15, (256, d)).astype(np.float32)
    vectors[:, : start.shape[1]] += start
    p = {
        "e": vectors,
        "f": rng.normal(0, 0.15, (WIDTH * d, FILTERS)).astype(np.float32),
        "fb": np.zeros(FILTERS, np.float32),
        "h": rng.normal(0, 0.3, (FILTERS, HIDDEN)).astype(np.float32),
        "hb": np.zeros(HIDDEN, np.float32),
        "o": rng.normal(0, 0.3, HIDDEN).astype(np.float32),
        "ob": np.zeros(1, np.float32),
    }
    adam = Adam(p, 4e-3)
    texts = [chunk_bytes(np.frombuffer(t.encode("utf-8", "replace"), np.uint8)) for t, _ in sample]
    weight = np.where(ys == 1, 0.5 / max(ys.mean(), 1e-3), 0.5 / max(1 - ys.mean(), 1e-3)).astype(np.float32)
    span = 2 * HALF + WIDTH - STRIDE
    for _ in range(max(EPOCHS, 1600 // max(1, len(sample)))):
        order = rng.permutation(len(sample))
        for at in range(0, len(order), BATCH):
            ids = order[at : at + BATCH]
            chunks, owner = [], []
            for k, i in enumerate(ids):
                data, n = texts[i]
                if rng.random() < SHORT:  # short texts are judged too: a piece of a text as a text of its own
                    size = int(rng.integers(12, 2 * HALF))
                    start = int(rng.integers(0, max(1, len(data) - WIDTH - size)))
                    data, n = chunk_bytes(data[start : start + size].copy())
                for c in rng.choice(n, min(n, CHUNKS_PER_TEXT), replace=False):
                    chunks.append(data[c * HALF : c * HALF + span])
                    owner.append(k)
            owner = np.array(owner)
            share = 1 / np.bincount(owner, minlength=len(ids))
            seen = np.stack(chunks)
            x = p["e"][seen].reshape(len(chunks), -1)
            w = np.lib.stride_tricks.sliding_window_view(x, WIDTH * d, axis=1)[:, :: STRIDE * d]
            w = np.ascontiguousarray(w)
            a = w @ p["f"] + p["fb"]
            top = a.argmax(axis=1)
            pooled = np.take_along_axis(a, top[:, None, :], 1)[:, 0]
            live = np.maximum(pooled, 0)
            hid = np.tanh(live @ p["h"] + p["hb"])
            mean = np.zeros((len(ids), HIDDEN), np.float32)
            np.add.at(mean, owner, hid * share[owner, None].astype(np.float32))
            prob = sigmoid(mean @ p["o"] + p["ob"])
            g = (prob - ys[ids]) * weight[ids] / len(ids)
            ghid = (g[:, None] * p["o"])[owner] * share[owner, None] * (1 - hid**2)
            glive = (ghid @ p["h"].T) * (pooled > 0)
            gf = np.zeros_like(p["f"])
            rows = np.arange(len(chunks))
            for j in range(FILTERS):
                gf[:, j] = glive[:, j] @ w[rows, top[:, j]]
            # how much of each filter's gradient falls on each byte value at each of its places
            place = (np.arange(FILTERS)[None, :, None] * WIDTH + np.arange(WIDTH)) * 256
            own = seen[rows[:, None, None], top[:, :, None] * STRIDE + np.arange(WIDTH)]
            fall = np.bincount((place + own).ravel(), np.repeat(glive.ravel(), WIDTH), FILTERS * WIDTH * 256).reshape(FILTERS, WIDTH, 256)
            ge = np.einsum("jwb,wdj->bd", fall, p["f"].reshape(WIDTH, d, FILTERS), optimize=True).astype(np.float32)
            adam.step({"e": ge, "f": gf, "fb": glive.sum(0), "h": live.T @ ghid, "hb": ghid.sum(0), "o": mean.T @ g, "ob": g.sum(keepdims=True)})
    return p


def scorer(model: dict):
    """A function from whole texts to their probabilities."""
    if "prior" in model:
        return lambda texts: [np.full(len(texts), model["prior"])]
    filters = model["f"].reshape(WIDTH, VECTOR, FILTERS)
    single = np.einsum("bd,wdf->wbf", model["e"], filters)
    # two neighbouring bytes at once: the row of the pair (first, second), little-endian
    pairs = [np.ascontiguousarray((single[j + 1][:, None, :] + single[j][None, :, :]).reshape(65536, FILTERS)) for j in range(0, WIDTH, 2)]

    def pooled_halves(data: np.ndarray) -> np.ndarray:
        """Max-pooled responses for each half-chunk of padded bytes."""
        halves = (len(data) - WIDTH) // HALF
        out = np.empty((halves, FILTERS), np.float32)
        step = 256
        two = data.view("<u2") if len(data) % 2 == 0 else None
        for h in range(0, halves, step):
            n = min(step, halves - h)
            base = np.arange(h * HALF // 2, (h + n) * HALF // 2, STRIDE // 2)
            acc = pairs[0].take(two.take(base), axis=0)
            for j in range(1, WIDTH // 2):
                acc += pairs[j].take(two.take(base + j), axis=0)
            out[h : h + n] = acc.reshape(n, HALF // STRIDE, FILTERS).max(axis=1)
        return out

    def score(texts: list[str | None]) -> list[np.ndarray]:
        out = np.empty(len(texts))
        at = 0
        while at < len(texts):  # texts are laid end to end, up to about 1 MB at a time
            parts, counts, size = [], [], 0
            while at + len(counts) < len(texts) and (not parts or size < 1 << 20):
                data, n = chunk_bytes(np.frombuffer((texts[at + len(counts)] or "").encode("utf-8", "replace"), np.uint8))
                parts.append(data[:-WIDTH])
                counts.append(n + 1)
                size += len(data)
            # a filter's reach past a text's end must see padding, not the next text
            edges, joined = np.cumsum(counts), np.concatenate([*parts, np.zeros(WIDTH, np.uint8)])
            halves = pooled_halves(joined)
            for k, e in enumerate(edges):
                last = np.concatenate([parts[k][-HALF:], np.zeros(WIDTH, np.uint8)])
                halves[e - 1] = pooled_halves(last)[0]
            chunk = np.maximum(halves[:-1], halves[1:])
            chunk += model["fb"]
            np.maximum(chunk, 0, out=chunk)
            hid = np.tanh(chunk @ model["h"] + model["hb"])
            hid = np.concatenate([hid, np.zeros((1, HIDDEN), np.float32)]).astype(np.float64)
            hid[edges - 1] = 0  # that chunk would join two texts
            starts = np.concatenate([[0], edges[:-1]])
            mean = np.add.reduceat(hid, starts, axis=0) / (np.array(counts) - 1)[:, None]
            out[at : at + len(counts)] = sigmoid(mean @ model["o"].astype(np.float64) + float(model["ob"][0]))
            at += len(counts)
        return [out]

    return score


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> dict:
    """The model learned from the labelled documents outside the held-out fold."""
    model = train(labelled_sample(docs, labels, "quality", 5, per_class)[0])
    release_memory()
    return model


def score_quality(docs: DataFrame, model: dict, keep: list[str], name: str = "score") -> DataFrame:
    """``keep`` and the quality of every row's whole text, as ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return append_columns(docs, "text", keep, [(name, T.DoubleType())], lambda: scorer(shared.value))


def drop_low_quality(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with their columns, whose quality is at least ``threshold``."""
    name = "quality_score"
    while name in docs.columns:
        name = f"_{name}"
    return score_quality(docs, model, docs.columns, name).where(F.col(name) >= threshold).drop(name)
