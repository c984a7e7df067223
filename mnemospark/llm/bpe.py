"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece of bytes there is one valid encoding, and with it one last
token: the token t that ends the prefix such that the last token before t is one that may
stand in front of t, that is, such that encoding the two tokens' bytes together gives back
just the two. ``Prefixes`` stores that last token for each prefix, so that appending bytes
costs only the new prefixes, and an edit only those from its place on; walking the last
tokens backwards yields the encoding. No merge loop runs over the text.

Texts are split by the vocabulary's pattern first and each match is encoded by itself,
as the public encoder of such rank files does, without special tokens. Nulls and empty
texts have no tokens. Lone surrogates are replaced by U+FFFD. Texts are read whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from mnemospark.llm.common import append_columns

#: A memo, of encoded pieces or of valid pairs, is emptied when it holds so many.
MEMO = 250_000


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file whose lines are a token's bytes in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Tokens by bytes and by rank, the pair from which each was merged, and the rule of valid neighbours."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.split: dict[int, tuple[int, int]] = {}
        self.valid: dict[tuple[int, int], bool] = {}
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")

    def parts(self, token: int) -> tuple[int, int]:
        """The two tokens that the last merge of ``token`` joins; itself twice for a single byte."""
        known = self.split.get(token)
        if known is None:
            data, ranks = self.tokens[token], self.ranks
            known = (token, token)
            if len(data) > 1:
                pieces = [data[i : i + 1] for i in range(len(data))]
                while len(pieces) > 2:
                    best = min(range(len(pieces) - 1), key=lambda i: ranks.get(pieces[i] + pieces[i + 1], 1 << 60))
                    if pieces[best] + pieces[best + 1] not in ranks:
                        break
                    pieces[best : best + 2] = [pieces[best] + pieces[best + 1]]
                if len(pieces) == 2:
                    known = (ranks[pieces[0]], ranks[pieces[1]])
            self.split[token] = known
        return known

    def whole(self, token: int) -> bool:
        """Whether encoding the token's bytes gives the token (some can't be reached by merges)."""
        return len(self.tokens[token]) == 1 or self.parts(token)[0] != token

    def may_follow(self, first: int, second: int) -> bool:
        """Whether encoding the two tokens' bytes together gives just these two.

        Taking both tokens apart along their own merges, latest merge first, no pair that
        meets at the border may have been merged before the merge that hides it.
        """
        key = (first, second)
        known = self.valid.get(key)
        if known is None:
            ranks, tokens, limit, a, b = self.ranks, self.tokens, 1 << 60, first, second
            known = True
            while True:
                joined = ranks.get(tokens[a] + tokens[b])
                if joined is not None and joined < limit:
                    known = False
                    break
                if a > b:
                    limit, (_, right) = a, self.parts(a)
                    if right == a:
                        limit, (left, _) = b + 1, self.parts(b)
                        if left == b:
                            break
                        b = left
                    else:
                        a = right
                else:
                    limit, (left, _) = b + 1, self.parts(b)
                    if left == b:
                        limit, (_, right) = a, self.parts(a)
                        if right == a:
                            break
                        a = right
                    else:
                        b = left
            if len(self.valid) > MEMO:
                self.valid.clear()
            self.valid[key] = known
        return known


class Prefixes:
    """The unique last token of every prefix of growing or edited bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> Prefixes:
        """Adds bytes; the prefixes before them stay as they are."""
        v, at = self.vocabulary, len(self.data)
        self.data += more
        data, last, ranks, longest = self.data, self.last, v.ranks, v.longest
        for end in range(at + 1, len(data) + 1):
            for start in range(max(0, end - longest), end):  # the longest candidate first
                token = ranks.get(data[start:end])
                if token is not None and v.whole(token) and (start == 0 or v.may_follow(last[start - 1], token)):
                    last.append(token)
                    break
            else:
                raise ValueError("no token ends here")
        return self

    def edit(self, start: int, end: int, new: bytes) -> Prefixes:
        """Puts ``new`` in place of bytes start to end; only prefixes from ``start`` on are worked out again."""
        rest = self.data[end:]
        self.data, self.last = self.data[:start], self.last[:start]
        return self.append(new + rest)

    def tokens(self) -> list[int]:
        """The encoding of all bytes."""
        out, end = [], len(self.data)
        while end:
            token = self.last[end - 1]
            out.append(token)
            end -= len(self.vocabulary.tokens[token])
        return out[::-1]


class Batch:
    """The same prefixes for many pieces at a time, one byte position of all pieces a step.

    An automaton over the tokens' bytes gives the longest token that ends at a position; each
    token knows the next shorter one that ends likewise. The first of them that may follow the
    last token before it is the prefix's last token.
    """

    LONGEST, SLOTS = 64, 21

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        size = max(vocabulary.tokens) + 1
        self.size = np.zeros(size, np.int32)
        nodes, step, token_at = {b"": 0}, [], [-1]
        for token, data in sorted(vocabulary.tokens.items()):
            self.size[token] = len(data)
            for k in range(1, len(data) + 1):
                if data[:k] not in nodes:
                    nodes[data[:k]] = len(nodes)
                    token_at.append(-1)
            if vocabulary.whole(token):
                token_at[nodes[data]] = token
        step = np.zeros((len(nodes), 256), np.int32)
        own = np.zeros((len(nodes), 256), bool)
        for data, node in nodes.items():
            if data:
                parent = nodes[data[:-1]]
                step[parent, data[-1]], own[parent, data[-1]] = node, True
        fail, longest = np.zeros(len(nodes), np.int32), np.array(token_at, np.int32)
        self.shorter = np.full(size, -1, np.int32)
        for data, node in sorted(nodes.items(), key=lambda x: len(x[0])):
            if len(data) > 1:  # what follows the longest proper suffix that is a node
                fail[node] = step[fail[nodes[data[:-1]]], data[-1]]
            behind = longest[fail[node]] if data else -1
            if longest[node] >= 0:
                self.shorter[longest[node]] = behind
            else:
                longest[node] = behind
            if data:
                step[node] = np.where(own[node], step[node], step[fail[node]])
        self.step, self.longest = step.ravel(), longest
        # what is known of pairs: a slot each, the newest pair wins
        self.pair, self.ok = np.full(1 << self.SLOTS, -1, np.int64), np.zeros(1 << self.SLOTS, bool)

    def may_follow(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        code = first.astype(np.int64) << 32 | second
        slot = (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        out = self.ok[slot]
        miss = np.flatnonzero(self.pair[slot] != code)
        if len(miss):
            fresh, back = np.unique(code[miss], return_inverse=True)
            known = np.array([self.vocabulary.may_follow(int(c) >> 32, int(c) & 0xFFFFFFFF) for c in fresh])
            out[miss] = known[back]
            self.pair[slot[miss]], self.ok[slot[miss]] = code[miss], out[miss]
        return out

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece (of 1 to ``LONGEST`` bytes)."""
        sizes = np.array([len(p) for p in pieces])
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        data = np.frombuffer(b"".join([pieces[i].ljust(self.LONGEST, b"\0") for i in order]), np.uint8).reshape(-1, self.LONGEST)
        last = np.full((len(pieces), int(sizes[0]) + 1), -1, np.int32)
        state = np.zeros(len(pieces), np.int64)
        for end in range(1, int(sizes[0]) + 1):
            alive = int(np.searchsorted(-sizes, -end, side="right"))
            state = self.step[state[:alive] * 256 + data[:alive, end - 1]].astype(np.int64)
            token = self.longest[state]
            open_ = np.arange(alive)
            while len(open_):
                t = token[open_]
                start = end - self.size[t]
                before = last[open_, start]
                good = start == 0
                inner = np.flatnonzero(~good)
                good[inner] = self.may_follow(before[inner], t[inner])
                open_ = open_[~good]
                token[open_] = self.shorter[token[open_]]
                if len(open_) and (token[open_] < 0).any():
                    raise ValueError("no token ends here")
            last[:alive, end] = token
        out, at, rows = [], sizes.copy(), np.arange(len(pieces))
        while len(rows):
            t = last[rows, at[rows]]
            out.append((rows, t))
            at[rows] -= self.size[t]
            rows = rows[at[rows] > 0]
        ids: list[list[int]] = [[] for _ in pieces]
        for rows, t in reversed(out):  # from the front of each piece
            for i, x in zip(order[rows].tolist(), t.tolist()):
                ids[i].append(x)
        return ids


class Encoder:
    """Encodes and decodes texts: the pattern's matches one by one, each by its prefixes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.vocabulary, self.pattern, self.batch = Vocabulary(ranks), regex.compile(pattern), None
        self.memo: dict[str, bytes] = {}  # a piece's ids as 32-bit numbers
        size = max(self.vocabulary.tokens) + 1
        self.bytes_of, self.decimal_of = np.empty(size, object), np.empty(size, object)
        for token, data in self.vocabulary.tokens.items():
            self.bytes_of[token], self.decimal_of[token] = data, b"%d" % token
        self.batch = Batch(self.vocabulary)

    def learn(self, pieces: set[str]) -> None:
        """Puts the ids of pieces into the memo."""
        fresh = [p for p in pieces if p not in self.memo]
        if len(self.memo) + len(fresh) > MEMO:
            self.memo.clear()
            fresh = list(pieces)
        coded = [p.encode("utf-8", "replace") for p in fresh]
        short = [k for k, c in enumerate(coded) if len(c) <= Batch.LONGEST]
        for at in range(0, len(short), 20_000):
            part = short[at : at + 20_000]
            for k, ids in zip(part, self.batch.encode([coded[k] for k in part])):
                self.memo[fresh[k]] = np.array(ids, "<i4").tobytes()
        for k, c in enumerate(coded):
            if len(c) > Batch.LONGEST:
                self.memo[fresh[k]] = np.array(Prefixes(self.vocabulary, c).tokens(), "<i4").tobytes()

    def encode_all(self, texts: list[str | None]) -> Iterable[np.ndarray]:
        """The ids of each text."""
        find, at = self.pattern.findall, 0
        while at < len(texts):  # as many texts at a time as make about a million characters
            group, size = [], 0
            while at + len(group) < len(texts) and (not group or size < 1_000_000):
                group.append(find(texts[at + len(group)] or ""))
                size += len(texts[at + len(group) - 1] or "")
            self.learn(set().union(*group))
            get = self.memo.__getitem__
            for found in group:
                yield np.frombuffer(b"".join(map(get, found)), "<i4")
            at += len(group)

    def encode(self, text: str | None) -> list[int]:
        return next(iter(self.encode_all([text]))).tolist()

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        return b"".join(self.bytes_of[np.asarray(ids, np.int64)].tolist())

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by spaces."""
        return b" ".join(self.decimal_of[ids].tolist())


_ENCODERS: dict[tuple, Encoder] = {}


def worker_encoder(ranks: dict[bytes, int], pattern: str) -> Encoder:
    """The encoder of a Python worker, kept from task to task."""
    key = (len(ranks), hash(frozenset(ranks.items())), pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(ranks, pattern)
    return _ENCODERS[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, keep: list[str]) -> DataFrame:
    """``keep`` and the ids of every row's whole text, as array<int> ``ids``."""
    encoders = shared_ranks(docs.sparkSession, ranks_path)

    def run(batches):
        encoder = worker_encoder(encoders.value, pattern)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            ids = pa.array(list(encoder.encode_all(texts)), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], ids], names=[*keep, "ids"])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select(*keep, docs["text"].alias("encoded_text")).mapInArrow(run, schema)


def shared_ranks(spark: SparkSession, ranks_path: str):
    """The rank table (a fixed file) as a broadcast, read on the driver."""
    return spark.sparkContext.broadcast(load_ranks(ranks_path))


def token_digests(docs: DataFrame, ranks_path: str, pattern: str, keep: list[str]) -> DataFrame:
    """``keep``, n_tokens, ids_sha256 and decoded_sha256 of every row's whole text.

    The ids are decoded again and the decoded bytes are what is hashed.
    """
    ranks = shared_ranks(docs.sparkSession, ranks_path)

    def make():
        encoder = worker_encoder(ranks.value, pattern)

        def digest(texts):
            counts, ids_hex, decoded_hex = [], [], []
            for ids in encoder.encode_all(texts):
                counts.append(len(ids))
                ids_hex.append(hashlib.sha256(encoder.decimal(ids)).hexdigest())
                decoded_hex.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            return [counts, ids_hex, decoded_hex]

        return digest

    new = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return append_columns(docs, "text", keep, new, make)
