"""Benchmark decontamination by latent semantic retrieval.

1. Whole texts become numbers of the benchmark's words, stored once for all that follows;
   document frequencies are counted over all documents.
2. A latent space is fitted by a distributed randomised SVD of TF-IDF passages: tasks
   return their share of A'(A Q), added up in blocks of words; the driver orthonormalises.
   The passages are all of the benchmark's and all of all documents.
3. Every document is cut into overlapping windows that cover it whole; windows whose latent
   cosine with a benchmark passage reaches ``COSINE`` are candidates. Each passage is held
   against windows a little longer than itself.
4. A candidate that holds enough of the passage's words is a leak if the longest common subsequence of words covers enough of the
   passage: ``COPY`` of it, or for paraphrases ``PARAPHRASE`` of it if ``ANSWER`` of the
   words of the item's answer (the benchmark's answer column if there is one, else the
   passage's rarest words) stand in the window too. Passages under ``SHORT`` words must be there
   in full.

The benchmark is taken in blocks of about ``BLOCK`` items, so what is broadcast is bounded
whatever its size. Nulls, empty texts and empty tables give no leaks; an item with a null id
or without words is not searched; rows with a null doc_id are reported under a null id.
Repeated rows of one doc_id give one row for each item. Of equally good windows any is reported; equal item ids count as one
item. Texts of any length are searched whole, ``WINDOWS`` windows at a time. Other columns are never read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from mnemospark.llm.common import cut_lineage, one_thread, release_memory, small

RANK, EXTRA = 128, 16
#: A benchmark passage counts as so many in the fit, so that its own words get directions; where there are more
#: than ``PER`` documents, their passages count together as those of ``PER`` average ones.
WEIGHT, PER = 4, 1500
#: Tasks of a pass of the fit at most, words of a block of its sums, and tokens that are summed at a time.
FIT_TASKS, FIT_WORDS, FIT_TOKENS = 256, 128, 65_536
#: So many of the most frequent words have a column of their own there.
OFTEN = 512
STEP = 16
#: Passages of up to so many words are held against windows of so many steps.
SCALES = ((16, 2), (32, 3), (48, 4), (64, 5))
LONGEST, OVERLAP = 64, 32
COSINE, COPY, PARAPHRASE, ANSWER, SHORT, RAREST = 0.3, 0.6, 0.5, 0.5, 8, 8
BLOCK = 4000
#: A block's items have about so many bytes at most, and so many windows are held against its passages at a time.
BLOCK_BYTES, WINDOWS = 4_000_000, 8192
#: Steps whose words' vectors, and candidates whose words, are in memory at a time.
STEPS, CANDIDATES = 512, 4096
_SPACED = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and bytes above ASCII."""
    return (text or "").lower().encode("utf-8", "replace").translate(_SPACED).split()


def passages(items: list[tuple]) -> list[tuple]:
    """(item_id, words, answer words or None) for each passage of items (item_id, text, answer).

    A longer item is covered by passages of ``LONGEST`` words, overlapping by ``OVERLAP``.
    """
    out = []
    for item_id, text, answer in items:
        all_words = words(text)
        for at in range(0, max(1, len(all_words) - OVERLAP), LONGEST - OVERLAP):
            part = all_words[at : at + LONGEST]
            if part:
                out.append((item_id, part, words(answer) or None))
    return out


class Space:
    """What every task needs: word numbers, their weights, the latent basis, the passages."""

    def __init__(self, found: list[tuple]) -> None:
        self.passages = found
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for _, ws, _ in found for w in ws}))}
        self.idf = np.ones(len(self.vocabulary), np.float32)
        self.basis: np.ndarray | None = None

    def numbers(self, text: str | None) -> np.ndarray:
        """The words' numbers; one past the last for words that no passage has."""
        ws = words(text)
        return np.fromiter(map(self.vocabulary.get, ws, itertools.repeat(len(self.vocabulary))), np.int64, len(ws))

    def kind(self) -> type:
        """The type that stored numbers have."""
        return np.uint16 if len(self.vocabulary) < 1 << 16 else np.uint32

    def vectors(self) -> np.ndarray:
        """Each word's weighted latent vector, and a zero row."""
        return np.concatenate([self.basis * self.idf[:, None], np.zeros((1, self.basis.shape[1]), np.float32)]).astype(np.float32)

    def prepare(self) -> None:
        """Works out, once in each task, what the search needs."""
        self.table = self.vectors()
        self.ids = [np.array([self.vocabulary[w] for w in ws]) for _, ws, _ in self.passages]
        latent = np.stack([self.table[i].sum(axis=0) for i in self.ids])
        self.latent = (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        self.masks = []
        for i in self.ids:
            m: dict[int, int] = {}
            for k, w in enumerate(i.tolist()):
                m[w] = m.get(w, 0) | 1 << k
            self.masks.append(m)
        self.answers = []
        for (_, _, answer), i in zip(self.passages, self.ids):
            known = {self.vocabulary[w] for w in answer or () if w in self.vocabulary}
            rare = sorted(set(i.tolist()), key=lambda w: (-self.idf[w], w))[:RAREST]
            self.answers.append(known or set(rare))
        # each passage's distinct words as sorted keys; how many places of the passage each of them fills
        size = len(self.vocabulary) + 1
        each = [np.unique(i, return_counts=True) for i in self.ids]
        self.keys = np.concatenate([k * size + w for k, (w, _) in enumerate(each)])
        self.places = np.concatenate([n for _, n in each])
        self.scale = [next((s for n, s in SCALES if len(i) <= n), SCALES[-1][1]) for i in self.ids]


def common_subsequence(masks: dict[int, int], size: int, window: list[int]) -> int:
    """Length of the longest common subsequence of a passage (bit masks by word) and a window."""
    full = (1 << size) - 1
    v = full
    for w in window:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def numbered(docs: DataFrame, space: Space) -> DataFrame:
    """(doc_id, numbers) of every row, stored: the words' numbers of the whole text, two or four bytes each."""
    shared = docs.sparkSession.sparkContext.broadcast(space)
    kind = space.kind()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                numbers = [s.numbers(t).astype(kind).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(numbers, pa.binary())], names=["doc_id", "numbers"])
        release_memory()

    return cut_lineage(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, numbers binary"))


def document_frequencies(rows: DataFrame, space: Space) -> int:
    """Counts, over all documents, those that have each word of the vocabulary; sets the weights. Returns the number of documents."""
    size, kind = len(space.vocabulary), space.kind()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size + 1, np.int64), 0
        for batch in batches:
            for numbers in batch.column(0).to_pylist():
                total[np.frombuffer(numbers, kind)] += 1  # once for a word, however often it stands there
                n += 1
        total[size] = n  # the last place counts documents
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(total)], names=["word", "n"])
        release_memory()

    got = rows.select("numbers").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(size + 1)
    for r in got:
        df[r["word"]] = r["n"]
    space.idf = np.log((df[-1] + 1) / (df[:-1] + 1)).clip(0.05).astype(np.float32)
    return int(df[-1])


def summed(source: np.ndarray, at: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The sums of the rows ``at`` of ``source``, whose last row is zero, for each run that starts at ``begin``."""
    lengths = np.diff(begin, append=len(at))
    fours = -(-lengths // 4)  # runs are filled up to a multiple of four rows: sums of whole fours are quick
    starts = np.cumsum(fours) - fours
    filled = np.full(4 * fours.sum(), len(source) - 1)
    filled[np.arange(len(at)) + np.repeat(4 * starts - begin, lengths)] = at
    return np.add.reduceat(source[filled].reshape(-1, 4, source.shape[1]).sum(axis=1), starts, axis=0)


class Sums:
    """A'(A q) over passages, in one task; ``table`` is q, each row times its word's weight, and a zero row."""

    def __init__(self, idf: np.ndarray, table: np.ndarray) -> None:
        self.idf, self.table = idf, table
        self.out = np.zeros((len(idf), table.shape[1]))
        # the words of most documents go through a dense matrix, the others row by row
        self.often = np.argsort(idf, kind="stable")[:OFTEN]
        self.column = np.full(len(idf), -1)
        self.column[self.often] = np.arange(len(self.often))

    def add(self, rows: list[np.ndarray]) -> None:
        """Adds the passages of texts given as word numbers."""
        size, width = len(self.idf), len(self.often)
        flat = np.concatenate(rows).astype(np.int64)
        lengths = np.array([len(r) for r in rows])
        of_text = -(-lengths // LONGEST)
        within = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        passage = np.repeat(np.cumsum(of_text) - of_text, lengths) + within // LONGEST
        known = flat < size
        flat, passage = flat[known], passage[known]
        if not len(flat):
            return
        passage = np.cumsum(np.diff(passage, prepend=passage[0]) > 0)  # those without known words are left out
        count = int(passage[-1]) + 1
        keys = np.sort(passage * size + flat)
        begin = np.flatnonzero(np.diff(keys, prepend=-1))
        which, word = np.divmod(keys[begin], size)
        square = np.bincount(which, (np.diff(begin, append=len(keys)) * self.idf[word]) ** 2.0)
        column = self.column[flat]
        often = column >= 0
        dense = np.bincount(passage[often] * width + column[often], minlength=count * width).reshape(count, width).astype(np.float32)
        vectors = np.zeros((count + 1, self.table.shape[1]), np.float32)
        vectors[:-1] = dense @ self.table[self.often]
        flat, passage = flat[~often], passage[~often]
        if len(flat):
            begin = np.flatnonzero(np.diff(passage, prepend=-1))
            vectors[passage[begin]] += summed(self.table, flat, begin)
        vectors[:-1] /= square[:, None].astype(np.float32)
        self.out[self.often] += (dense.T @ vectors[:-1]) * self.idf[self.often][:, None]
        if len(flat):
            order = np.argsort(flat, kind="stable")
            word = flat[order]
            begin = np.flatnonzero(np.diff(word, prepend=-1))
            self.out[word[begin]] += summed(vectors, passage[order], begin) * self.idf[word[begin]][:, None]


def weights_of(q: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Each row of ``q`` times its word's weight, and a zero row."""
    return np.concatenate([q * idf[:, None], np.zeros((1, q.shape[1]))]).astype(np.float32)


def fit_space(rows: DataFrame, space: Space, documents: int, seed: int = 2) -> None:
    """The latent basis, by a randomised SVD of all TF-IDF passages.

    Random directions, drawn towards the benchmark's own passages, are multiplied by A'A in one pass over all documents.
    """
    spark = rows.sparkSession
    size, kind = len(space.vocabulary), space.kind()
    width = min(size, RANK + EXTRA)
    own = [np.array([space.vocabulary[w] for w in ws]) for _, ws, _ in space.passages]
    narrow = rows.select("numbers").coalesce(FIT_TASKS)

    def over_all(q: np.ndarray) -> np.ndarray:
        weighted = weights_of(q, space.idf)
        shared = spark.sparkContext.broadcast((space.idf, weighted))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one_thread()
            sums = Sums(*shared.value)
            for batch in batches:
                group, held = [], 0
                for numbers in batch.column(0):
                    text = np.frombuffer(numbers.as_py(), kind)
                    for at in range(0, len(text), FIT_TOKENS):  # a multiple of a passage
                        group.append(text[at : at + FIT_TOKENS])
                        held += len(group[-1])
                        if held >= FIT_TOKENS:
                            sums.add(group)
                            group, held = [], 0
                if group:
                    sums.add(group)
            for at in range(0, size, FIT_WORDS):
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([sums.out[at : at + FIT_WORDS].astype(np.float32).tobytes()], pa.binary())], names=["at", "m"])
            del sums
            release_memory()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for at, m in zip(batch.column(0).to_pylist(), batch.column(1)):
                    total[at] = total.get(at, 0.0) + np.frombuffer(m.as_buffer(), np.float32).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([m.tobytes() for m in total.values()], pa.binary())], names=["at", "m"])

        schema = "at long, m binary"
        summed = narrow.mapInArrow(part, schema).repartition(min(32, -(-size // FIT_WORDS)), "at").mapInArrow(add, schema)
        total = np.zeros(q.shape)
        for r in summed.collect():  # each word's sums once
            m = np.frombuffer(r["m"]).reshape(-1, q.shape[1])
            total[r["at"] : r["at"] + len(m)] = m
        shared.unpersist()
        total *= min(1.0, PER / max(documents, 1))
        sums = Sums(space.idf, weighted)
        for at in range(0, len(own), 1024):
            sums.add(own[at : at + 1024])
        return total + WEIGHT * sums.out

    start = np.random.default_rng(seed).normal(size=(size, width))
    sums = Sums(space.idf, weights_of(start, space.idf))
    for at in range(0, len(own), 1024):
        sums.add(own[at : at + 1024])  # none is longer than a passage of the documents
    q = np.linalg.qr(start + WEIGHT * sums.out)[0]
    y = over_all(q)
    # the product restricted to the range and what it reaches (Nystrom): y (q'y)^-1 y'
    values, turn = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
    sound = values > 1e-6 * values.max()
    u, root, _ = np.linalg.svd(y @ turn[:, sound] / np.sqrt(values[sound]), full_matrices=False)
    u, values = u[:, :RANK], root[:RANK] ** 2
    # coordinates are divided by their singular values: directions that whole languages share
    # would else make any two passages look alike
    space.basis = (u / np.sqrt(np.maximum(values, 1e-6 * values.max()))).astype(np.float32)


def leak_schema(docs: DataFrame, benchmark: DataFrame) -> str:
    """The columns of a leak; ids have their tables' types."""
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return f"doc_id {kind(docs, 'doc_id')}, item_id {kind(benchmark, 'item_id')}, cosine double, lcs_share double, answer_share double"


def search(numbers: DataFrame, space: Space, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_share) of each leak's best window."""
    shared = numbers.sparkSession.sparkContext.broadcast(space)
    schema, item_type = leak_schema(numbers, benchmark), to_arrow_type(benchmark.schema["item_id"].dataType)
    kind = space.kind()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        s = shared.value
        s.prepare()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at, found = 0, []
            while at < len(texts):  # as many documents at a time as make about 60,000 words
                group, size = [], 0
                while at + len(group) < len(texts) and (not group or size < 60_000):
                    group.append(np.frombuffer(texts[at + len(group)].as_buffer(), kind))
                    size += len(group[-1])
                found += [(at + d, *rest) for d, *rest in leaks(s, group)]
                at += len(group)
            if found:
                rows, items, *scores = zip(*found)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(items, item_type), *(pa.array(x, pa.float64()) for x in scores)], names=["doc_id", "item_id", "cosine", "lcs_share", "answer_share"])
            del ids, texts, found
        release_memory()

    rows = numbers.mapInArrow(run, schema)
    best = F.max(F.struct("lcs_share", "answer_share", "cosine")).alias("b")
    return rows.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.cosine", "b.lcs_share", "b.answer_share")


def held_words(s: Space, padded: np.ndarray, passage: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of each candidate (a passage and a window from ``begin`` to ``end``) the share of the passage's places whose word the window has.

    No common subsequence can be longer.
    """
    out = np.zeros(len(passage))
    size = len(s.vocabulary) + 1
    lengths = np.array([len(i) for i in s.ids])
    starts = np.searchsorted(s.keys, np.arange(len(s.ids)) * size)
    for low in range(0, len(passage), CANDIDATES):
        part = slice(low, low + CANDIDATES)
        p, wide = passage[part], end[part] - begin[part]
        row = np.repeat(np.arange(len(p)), wide)
        word = padded[np.arange(len(row)) + np.repeat(begin[part] - np.cumsum(wide) + wide, wide)]
        row, word = row[word < size - 1], word[word < size - 1]
        key = p[row] * size + word
        at = np.minimum(np.searchsorted(s.keys, key), len(s.keys) - 1)
        found = s.keys[at] == key
        row, at = row[found], at[found]
        seen = np.zeros((len(p), LONGEST), np.int64)
        seen[row, at - starts[p[row]]] = s.places[at]
        out[part] = seen.sum(axis=1) / lengths[p]
    return out


def leaks(s: Space, group: list[np.ndarray]) -> list[tuple]:
    """(place in the group, item_id, cosine, lcs share, answer share) of leaked items."""
    nothing = len(s.vocabulary)
    blocks = [max(1, -(-len(g) // STEP)) for g in group]
    ends = np.cumsum(blocks)
    padded = np.full(ends[-1] * STEP, nothing, np.int64)
    for g, e, n in zip(group, ends, blocks):
        padded[(e - n) * STEP : (e - n) * STEP + len(g)] = g
    owner = np.repeat(np.arange(len(group)), blocks)
    best: dict[tuple, tuple] = {}
    longest = max(s.scale)
    for low in range(0, len(owner), WINDOWS):  # a text of any length goes through in pieces
        high = min(low + WINDOWS, len(owner))
        last = min(high + longest, len(owner))
        sums = np.concatenate([s.table[padded[k * STEP : min(k + STEPS, last) * STEP]].reshape(-1, STEP, s.table.shape[1]).sum(axis=1) for k in range(low, last, STEPS)])
        left = (ends[owner[low:high]] - np.arange(low, high)).astype(np.float32)  # steps to the text's end
        window, steps = np.zeros((high - low, sums.shape[1]), np.float32), 0
        for scale in sorted(set(s.scale)):
            for k in range(steps, min(scale, len(sums))):
                more = sums[k : k + high - low]
                window[: len(more)] += more * (left[: len(more)] > k)[:, None]
            steps = scale
            which = np.array([k for k, x in enumerate(s.scale) if x == scale])
            norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", window, window)), 1e-6)
            product = window @ s.latent[which].T
            b, k = np.nonzero(product >= np.float32(COSINE) * norm[:, None])
            enough = held_words(s, padded, which[k], (low + b) * STEP, np.minimum(low + b + scale, ends[owner[low + b]]) * STEP) >= PARAPHRASE
            for b, k in zip(b[enough].tolist(), k[enough].tolist()):
                p, at = int(which[k]), low + b
                ids = padded[at * STEP : min(at + scale, ends[owner[at]]) * STEP].tolist()
                size = len(s.ids[p])
                lcs = common_subsequence(s.masks[p], size, ids) / size
                if lcs < PARAPHRASE:
                    continue
                there = len(s.answers[p].intersection(ids)) / len(s.answers[p])
                if lcs == 1 or size >= SHORT and (lcs >= COPY or there >= ANSWER):
                    key, got = (int(owner[at]), s.passages[p][0]), (lcs, there, float(product[b, k] / norm[b]))
                    best[key] = max(best.get(key, got), got)
    return [(d, item, c, lcs, there) for (d, item), (lcs, there, c) in best.items()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, answer: str = "answer") -> DataFrame:
    """The leaked (doc_id, item_id) pairs of ``docs`` (doc_id, text) and ``benchmark`` (item_id, text and, if it has one, the answer's column)."""
    told = benchmark.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    blocks = max(1, -(-told["n"] // BLOCK), -(-(told["b"] or 0) // BLOCK_BYTES))
    items = benchmark.select("item_id", "text", F.col(answer).cast("string").alias("answer") if answer in benchmark.columns else F.lit(None).cast("string").alias("answer"))
    out = None
    for k in range(blocks):
        part = items.where((F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) & F.col("item_id").isNotNull()).orderBy("item_id", "text")
        found = passages([(r["item_id"], r["text"], r["answer"]) for r in part.collect()])
        if not found:
            continue
        space = Space(found)
        rows = numbered(docs, space)
        fit_space(rows, space, document_frequencies(rows, space))
        got = search(rows, space, benchmark)
        if blocks > 1:  # a block's numbers can go when its leaks are known
            got = cut_lineage(got)
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = docs.sparkSession.createDataFrame([], leak_schema(docs, benchmark))
    elif blocks > 1:  # an item id that stands on several texts may be found in several blocks
        best = F.max(F.struct("lcs_share", "answer_share", "cosine")).alias("b")
        out = out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.cosine", "b.lcs_share", "b.answer_share")
    return out


def drop_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with their columns, that hold no benchmark item; all rows of a leaked text go, whatever their ids."""
    key = F.xxhash64("text")
    found = cut_lineage(find_leaks(docs.select(key.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("leaked")).distinct())
    # one column beside the key, so no column of the documents can be called like either
    wrapped = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("record"), key.alias("key"))
    return wrapped.join(small(found), F.col("key") == F.col("leaked"), "left_anti").select("record.*")
