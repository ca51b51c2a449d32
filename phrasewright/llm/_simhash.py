"""SimHash over word shingles, one text at a time; runs in Python workers.

A shingle's hash is XXH64 of its UTF-8 bytes. Each bit of a fingerprint is a vote of the shingles,
repeats included: 1 if set in more than half of their hashes.
"""

from __future__ import annotations

import numpy as np
import xxhash

SEED = 42


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every shingle of ``words`` words (all words, if there are fewer), A-Z lower-cased."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not w:
        return np.empty(0, np.uint64)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)], np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, SEED) for x in map(b" ".join, zip(*(w[i:] for i in range(words))))), np.uint64, len(w) - words + 1)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit set, the most significant first."""
    big = hashes.astype(">u8").view(np.uint8).reshape(len(hashes), 8)
    total = np.zeros(64, np.int64)
    for at in range(0, len(big), 1 << 16):  # bounds the unpacked bits of a long text
        total += np.unpackbits(big[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return total


def pack(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits; 0 for no shingles."""
    return pack(2 * bit_counts(hashes) > len(hashes)) if len(hashes) else 0


#: Odd multipliers that make further hashes of a shingle, one a word of a longer fingerprint.
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def long_fingerprint(hashes: np.ndarray) -> bytes:
    """256 bits by the same rule, from four mixed hashes a shingle; zeros for no shingles."""
    if not len(hashes):
        return bytes(32)
    bits = []
    for m in _MIX:
        x = hashes * m
        x ^= x >> np.uint64(32)
        x *= m
        x ^= x >> np.uint64(29)
        bits.append(2 * bit_counts(x) > len(x))
    return np.packbits(np.concatenate(bits)).tobytes()
