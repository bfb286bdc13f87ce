"""Fast similarity sketching of 64-bit feature sets (numpy core of the near-duplicate operator).

A sketch has ``t`` coordinates.  In round ``i < t`` every element is thrown into one hashed bin; in
round ``t + j`` every element goes to bin ``j``, so each coordinate is filled after ``2 t`` rounds at
the latest, and far earlier for all but tiny sets.  A coordinate keeps the smallest (round, hash) it
saw.  Two sets agree in a coordinate with probability equal to their Jaccard similarity, and the
number of agreeing coordinates is concentrated as in sampling without replacement.
"""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
_M1, _M2, _GOLD = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
#: Distinct words whose hashes a worker remembers before it starts over.
CACHE_WORDS = 150_000


class WordHashes(dict):
    """Word (bytes) to 64-bit hash, remembered for at most CACHE_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit integers (splitmix64)."""
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, as UTF-8."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], hashes: WordHashes, width: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; fewer words make one shingle, none makes none."""
    if not words:
        return np.empty(0, U)
    h = np.fromiter(map(hashes.__getitem__, words), U, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, U(min(len(h), width)), U)
    for k in range(min(width, len(h))):
        out = mix(out * _GOLD + h[k : k + n])
    return np.unique(out)


def sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """``t`` coordinates of a non-empty set of 64-bit elements."""
    full = U(0xFFFFFFFFFFFFFFFF)
    out = np.full(t, full, U)
    n, i = len(elements), 0
    while i < 2 * t:
        rounds = np.arange(i, min(2 * t, i + max(1, 4 * t // n)), dtype=U)[:, None]
        h = mix(elements[None, :] + mix(rounds + U(1)) * _GOLD)
        bins = np.where(rounds < U(t), (h >> U(32)) % U(t), rounds % U(t)).astype(np.int64)
        key = (rounds << U(48)) | (mix(h) >> U(16))
        np.minimum.at(out, bins.ravel(), key.ravel())
        i += len(rounds)
        if (out != full).all():
            break
    return out


def band_keys(coords: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each run of ``rows`` coordinates."""
    b = len(coords) // rows
    c = coords[: b * rows].reshape(b, rows)
    out = mix(np.arange(1, b + 1, dtype=U) * _GOLD)
    for k in range(rows):
        out = mix(out * _GOLD + c[:, k])
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b| for two sorted distinct arrays."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both)
