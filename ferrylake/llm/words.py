"""Words and their stable 64-bit hashes inside Python tasks.

Text is handled as UTF-8 bytes: byte-wise ASCII lower-casing and splitting give
the same words as the code-point patterns, because every byte of a non-ASCII
character is 0x80 or more.
"""

from __future__ import annotations

import numpy as np
import xxhash

# ASCII white space as the quality and scoring contracts name it.
ASCII_SPACE = b" \t\n\x0b\x0c\r"

_ALNUM = bytes(c + 32 if 65 <= c <= 90 else
               c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
               for c in range(256))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, ASCII letters and non-ASCII characters."""
    if not text:
        return []
    return text.encode("utf-8", "surrogatepass").translate(_ALNUM).split()


def space_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z lower-cased on request."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.translate(_LOWER) if lower else raw).split()


class WordHashes(dict):
    """word -> xxh64; cleared when it holds ``limit`` words, so memory is bounded."""

    def __init__(self, limit: int = 50_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (the public splitmix64 one), element-wise."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of ``n`` consecutive word hashes (order matters)."""
    k = len(words) - n + 1
    if k <= 0:
        return np.empty(0, np.uint64)
    acc = np.zeros(k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            acc *= np.uint64(0x9E3779B97F4A7C15)
            acc += words[i:i + k]
    return mix(acc)
