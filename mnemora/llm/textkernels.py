"""Vectorised token hashes over UTF-8 bytes (numpy inside tasks).

A token's hash is a polynomial of its bytes modulo 2**64 read off prefix sums, so a
whole batch is hashed by a few array operations; a splitmix64 step mixes the result.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}


def powers(n: int, base: int = _BASE, name: str = "base") -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    held = _tables.get(name)
    if held is None or len(held) < n:
        with np.errstate(over="ignore"):
            steps = np.full(max(n, 1 << 16), base, dtype=U64)
            steps[0] = 1
            held = np.cumprod(steps, dtype=U64)
        _tables[name] = held
    return held[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def _classes() -> np.ndarray:
    space = np.ones(256, dtype=np.uint8)
    space[[9, 10, 11, 12, 13, 32]] = 0
    return space


NOT_SPACE = _classes()
"""1 for bytes of words, 0 for \\x20 and \\x09-\\x0D."""

_kinds = np.ones(256, dtype=np.uint8)
_kinds[33:127] = 2
_kinds[48:58] = _kinds[65:91] = _kinds[97:123] = 1
_kinds[:33] = 0
_kinds[127] = 0
WORDS_AND_MARKS = _kinds
"""1 for letters, digits and non-ASCII bytes, 2 for ASCII punctuation, 0 for what separates."""

ALNUM = np.where(_kinds == 1, 1, 0).astype(np.uint8)
"""1 for ASCII letters, digits and non-ASCII bytes; all else separates."""


def tokens(data: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes of one non-zero class."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kind = classes[data]
    change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts = np.concatenate(([0], change))
    ends = np.concatenate((change, [len(data)]))
    real = kind[starts] != 0
    return starts[real], ends[real]


def token_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each token's bytes, wherever it stands."""
    if not len(starts):
        return np.empty(0, U64)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum((data.astype(U64) + U64(1)) * powers(len(data)), out=total[1:])
        h = (total[ends] - total[starts]) * powers(len(data), _INVERSE, "inverse")[starts]
        return mix(h ^ ((ends - starts).astype(U64) << U64(56)))


def window_hashes(words: np.ndarray, width: int, base: int = 0xD6E8FEB86659FD93, name: str = "window") -> np.ndarray:
    """Rabin-Karp hashes of every run of `width` word hashes, as the window rolls along."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    with np.errstate(over="ignore"):
        total = np.zeros(len(words) + 1, dtype=U64)
        np.cumsum(words * powers(len(words), base, name), out=total[1:])
        back = powers(len(words), pow(base, -1, 1 << 64), name + "-inverse")
        return mix((total[width:] - total[:n]) * back[:n])


def chunks_of(texts: list[bytes], limit: int = 1 << 20) -> list[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes together; a longer text is a range of its own."""
    out, start, size = [], 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            out.append((start, i))
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        out.append((start, len(texts)))
    return out


def joined(texts: list[bytes], gap: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """The texts with a separator after each, and the offset where each one begins (and the end)."""
    data = np.frombuffer(gap.join(texts) + gap, dtype=np.uint8)
    sizes = np.fromiter((len(t) + len(gap) for t in texts), dtype=np.int64, count=len(texts))
    return data, np.concatenate(([0], np.cumsum(sizes)))
