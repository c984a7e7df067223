"""Token counts of whole texts by overlap resynchronisation, for byte-fallback BPE models of sentencepiece.

A huge text isn't encoded in one piece. Chunks that overlap are encoded one after the other, each beginning where a token
of the text before it begins, and every token's offset in the text is known. The encoding so far and the new chunk's are
spliced at the first token that both have at the same place. Where they share none, the overlap is doubled, and
with it the chunk, down to the beginning of the text if need be.

Why the splice is exact: BPE joins the best-ranked adjacent pair first, so a sequence of tokens is the encoding of its text
if and only if every two neighbours are the encoding of theirs (a join over a token's border would have to
happen in some pair by itself, too). Before the common token all neighbours come from the first encoding, after
it all come from the second, and the token itself has a neighbour from each. The space that the library puts
before a text is part of a chunk's first token only, which begins before the chunk and so is never common.

A null text has no bytes and no tokens, like an empty one. Equal texts, repeated rows and ids have equal counts. A text of any
length is counted whole; memory is that of the text, its tokens' offsets and one chunk. An empty table gives no rows.
Columns named like the new ones are replaced; no other column but the text is read. Special strings (``<s>``) in a
text are text. Models that aren't BPE, or that change a text before encoding it, raise ``ValueError``.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from mnemospark.llm.common import append_columns

#: Code points of a chunk, and of its overlap with the text before at first.
CHUNK, OVERLAP = 1 << 15, 1 << 8
#: So many code points of short texts go to the library at once.
BATCH = 1 << 20

NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class Resync:
    """Encodes texts of any length with one model."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        if chunk < 1 or overlap < 1:
            raise ValueError("a chunk and its overlap have one code point at least")
        self.chunk, self.overlap = chunk, overlap
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        described = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            described.ParseFromString(f.read())
        normal, kinds = described.normalizer_spec, {p.type for p in described.pieces}
        if described.trainer_spec.model_type != 2 or normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path} isn't a BPE model over unchanged texts")
        if described.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path} puts its space behind a text")
        self.lead = int(normal.add_dummy_prefix)
        #: code points of each token; of a code point's bytes the first counts, the others begin no token of their own
        self.points = np.array([self.size(p) for p in described.pieces], np.int64)

    @staticmethod
    def size(piece) -> int:
        if piece.type == BYTE:
            return int(not 0x80 <= int(piece.piece[1:-1], 16) < 0xC0)
        return len(piece.piece) if piece.type == NORMAL else 1

    def tokens(self, text: str, at: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``text``, encoded by itself, and where each begins if the text begins at ``at``."""
        ids = np.array(self.model.encode(text), np.int32)
        ends = np.cumsum(self.points[ids]) + (at - self.lead)
        return ids, np.concatenate([[at - self.lead], ends[:-1]])

    def encode(self, text: str) -> np.ndarray:
        """The ids of the whole ``text``."""
        ids, begins = self.tokens(text[: self.chunk], 0)
        end = min(self.chunk, len(text))
        while end < len(text):
            overlap = self.overlap
            while True:
                first = max(0, int(np.searchsorted(begins, end - overlap, "right")) - 1)
                start = max(0, int(begins[first]))
                upto = min(len(text), end + max(self.chunk, overlap))
                new, at = self.tokens(text[start:upto], start)
                cut = (0, 0) if start == 0 else self.common(ids, begins, first, end, new, at)
                if cut is not None:
                    break
                overlap *= 2
            ids, begins = np.concatenate([ids[: cut[0]], new[cut[1] :]]), np.concatenate([begins[: cut[0]], at[cut[1] :]])
            end = upto
        return ids

    def common(self, ids: np.ndarray, begins: np.ndarray, first: int, end: int, new: np.ndarray, at: np.ndarray) -> tuple[int, int] | None:
        """Where the first token that both encodings have at one place stands in each."""
        near = int(np.searchsorted(at, end))
        own, other = np.flatnonzero(self.points[ids[first:]]) + first, np.flatnonzero(self.points[new[:near]])
        _, i, j = np.intersect1d(begins[own], at[other], assume_unique=True, return_indices=True)
        # one place and one id are one token: its length follows
        same = np.flatnonzero(ids[own[i]] == new[other[j]])
        return (int(own[i[same[0]]]), int(other[j[same[0]]])) if len(same) else None

    def counts(self, texts: list[str | None]) -> list[int]:
        """How many tokens each of ``texts`` has."""
        out, short, size = [0] * len(texts), [], 0

        def flush() -> None:
            nonlocal size
            for k, ids in zip(short, self.model.encode([texts[k] for k in short], num_threads=1)):
                out[k] = len(ids)
            short.clear()
            size = 0

        for k, text in enumerate(texts):
            if text and len(text) > self.chunk:
                out[k] = len(self.encode(text))
            elif text:
                short.append(k)
                size += len(text)
                if size >= BATCH:
                    flush()
        flush()
        return out


@functools.cache
def resync(path: str, chunk: int, overlap: int) -> Resync:
    """One model a worker process."""
    return Resync(path, chunk, overlap)


def count_tokens(docs: DataFrame, path: str, keep: list[str], limit: int = 4096, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` narrowed to ``keep``, with n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens).

    ``path`` is the model's file, which every executor has at that place.
    """

    def make():
        coder = resync(path, chunk, overlap)

        def compute(texts: list[str | None]) -> list[list]:
            n = coder.counts(texts)
            return [[len(t.encode()) if t else 0 for t in texts], n, [k > limit for k in n]]

        return compute

    return append_columns(docs, text, keep, [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())], make)
