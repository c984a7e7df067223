"""Word shingles, their hashes, and SimHash fingerprints of them."""

from __future__ import annotations

import numpy as np
import xxhash

BITS, SEED = 64, 42

_LANES = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def shingles(text: str | None, size: int) -> list[bytes]:
    """The text's shingles of ``size`` words, repeats included: bytes with A-Z lower-cased, words joined by one space.

    Fewer words are one shingle, none are no shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[k:] for k in range(size)))))


def hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42, unsigned) of every shingle, in the text's order."""
    pieces = shingles(text, size)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(p, SEED) for p in pieces), np.uint64, len(pieces))


def fingerprints(of: list[np.ndarray]) -> np.ndarray:
    """The 64-bit SimHash (unsigned) of each text's hashes: bits that are 1 in over half of them; none: zero."""
    out = np.zeros(len(of), np.uint64)
    group: list[int] = []

    def flush() -> None:
        """Counts set bits in lanes of eight bits, at most 255 hashes to a lane, then adds the lanes up."""
        sizes = np.array([len(of[k]) for k in group])
        lanes = _LANES[np.concatenate([of[k] for k in group]).view(np.uint8).reshape(-1, 8)]
        ends = np.cumsum(sizes)
        blocks = [np.arange(e - s, e, 255) for s, e in zip(sizes, ends)]
        part = np.add.reduceat(lanes, np.concatenate(blocks), axis=0).view(np.uint8).reshape(-1, BITS).astype(np.int64)
        per = np.array([len(b) for b in blocks])
        ones = np.add.reduceat(part, np.cumsum(per) - per, axis=0)
        bits = (2 * ones > sizes[:, None]).astype(np.uint8)
        out[group] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
        group.clear()

    waiting = 0
    for k, h in enumerate(of):
        if len(h):
            group.append(k)
            waiting += len(h)
        if waiting > 100_000:
            flush()
            waiting = 0
    if group:
        flush()
    return out
