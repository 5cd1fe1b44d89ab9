"""Hashes of word shingles."""

from __future__ import annotations

import numpy as np
import xxhash

SEED = 42


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every ``size``-word shingle, A-Z lowered, words joined by one space, repeats kept.

    Fewer words than ``size`` give the whole sequence; no words give an empty array.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), dtype=np.int64, count=len(words)) - 1)[: len(words) - size + 1]
    return np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[size - 1 :] - 1).tolist())), dtype=np.uint64, count=len(starts)
    )


def majority(hashes: np.ndarray) -> int:
    """64-bit number whose bits are set in over half of the hashes."""
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):  # very long texts in pieces
        bits = np.unpackbits(hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])
