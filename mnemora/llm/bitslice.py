"""Hamming comparison on vertical bit planes (numpy inside tasks).

Plane b holds bit b of every fingerprint of a block, 64 fingerprints to a machine word.
For a query, the plane (or its complement) is the column of differing bits; it is added
to carry-save counters, bitwise, so one operation moves 64 distances. A lane whose count
passes the radius is dead; a block with no lane alive is abandoned.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
LANES = 64
_ALL = U64(0xFFFFFFFFFFFFFFFF)
_LANE_BIT = U64(1) << np.arange(64, dtype=U64)
CHECK_EVERY = 8
"""Planes between two looks at which blocks are left."""


def _step(counters: list[np.ndarray], dead: np.ndarray, differs: np.ndarray, limit: int) -> None:
    """Adds one to the counters where differs is set; marks as dead what reaches limit."""
    carry = differs
    at_limit = _ALL
    for i, plane in enumerate(counters):
        moved = plane & carry
        plane ^= carry
        carry = moved
        at_limit = at_limit & (plane if limit >> i & 1 else ~plane)
    dead |= at_limit


def planes_of(lanes: np.ndarray) -> np.ndarray:
    """[64 bits, blocks, words] from fingerprints [blocks, words * 64]."""
    blocks, width = lanes.shape
    by_word = lanes.reshape(blocks, width // LANES, LANES)
    return np.stack([np.bitwise_or.reduce((by_word >> U64(b) & U64(1)) * _LANE_BIT, axis=2) for b in range(64)])


def neighbours(planes: np.ndarray, queries: np.ndarray, dead: np.ndarray, radius: int) -> np.ndarray:
    """Lanes within radius of each query.

    planes [64, blocks, words], queries [blocks, n], dead [blocks, n, words]: lanes not to look at.
    Returns [blocks, n, words] masks. Whole blocks are dropped once all their lanes are dead.
    """
    limit = radius + 1
    out = np.zeros_like(dead)
    left = np.arange(len(queries))
    counters = [np.zeros_like(dead) for _ in range(limit.bit_length())]
    dead = dead.copy()
    for b in range(64):
        differs = planes[b][:, None, :] ^ np.where(queries >> U64(b) & U64(1), _ALL, U64(0))[:, :, None]
        _step(counters, dead, differs, limit)
        if b % CHECK_EVERY == CHECK_EVERY - 1 and b < 63:
            alive = (dead != _ALL).any(axis=(1, 2))
            if not alive.any():
                return out
            if alive.mean() < 0.7:
                left, queries, dead, planes = left[alive], queries[alive], dead[alive], planes[:, alive]
                counters = [c[alive] for c in counters]
    out[left] = ~dead
    return out


def _small_groups(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Groups of at most 64, a block each. Returns (row, first row of its part) where they differ."""
    lane = np.arange(LANES)
    real = lane < sizes[:, None]
    rows = np.where(real, starts[:, None] + lane, starts[:, None])
    lanes = fps[rows]
    ignored = ~np.bitwise_or.reduce(np.where(real, _LANE_BIT, U64(0)), axis=1)
    width = int(sizes.max())
    dead = (ignored[:, None] | _LANE_BIT[:width])[:, :, None]
    found = neighbours(planes_of(lanes), lanes[:, :width], dead, radius)[:, :, 0]
    found[~real[:, :width]] = 0
    some = found.any(axis=1)
    reach = found[some] | _LANE_BIT[:width]
    for k in range(width):
        reach |= np.where(reach >> U64(k) & U64(1), reach[:, k : k + 1], U64(0))
    first = np.log2((reach & (~reach + U64(1))).astype(np.float64)).astype(np.int64)
    row = rows[some][:, :width]
    root = np.take_along_axis(rows[some], first, axis=1)
    keep = real[some][:, :width] & (row != root)
    return row[keep], root[keep]


def _large_group(fps: np.ndarray, start: int, size: int, radius: int, at_once: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """One group in blocks of 64 lanes, searched breadth first: each member is a query once."""
    words = -(-size // LANES)
    own = fps[start : start + size]
    lanes = np.concatenate([own, np.repeat(own[:1], words * LANES - size)])[None, :]
    planes = planes_of(lanes)
    fresh = np.full(words, _ALL)
    if size % LANES:
        fresh[-1] = (U64(1) << U64(size % LANES)) - U64(1)
    root = np.full(size, -1, dtype=np.int64)
    for seed in range(size):
        if root[seed] >= 0:
            continue
        root[seed] = seed
        fresh[seed // LANES] &= ~_LANE_BIT[seed % LANES]
        todo = np.array([seed])
        while len(todo):
            q, todo = todo[:at_once], todo[at_once:]
            dead = np.broadcast_to(~fresh, (1, len(q), words)).copy()
            hit = np.bitwise_or.reduce(neighbours(planes, own[q][None, :], dead, radius)[0], axis=0)
            fresh &= ~hit
            new = np.flatnonzero(np.unpackbits(hit.view(np.uint8), bitorder="little"))
            root[new] = seed
            todo = np.concatenate([todo, new])
    row = np.flatnonzero(root != np.arange(size))
    return start + row, start + root[row]


def linked_rows(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int, at_once: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """For groups of rows (start, size): each row that a chain of links within its group joins to
    an earlier row, with the first row of that chain. At most one pair a row, whatever the group."""
    found = []
    small = np.flatnonzero((sizes > 1) & (sizes <= LANES))
    small = small[np.argsort(sizes[small], kind="stable")]
    for i in range(0, len(small), at_once):
        part = small[i : i + at_once]
        found.append(_small_groups(fps, starts[part], sizes[part], radius))
    for g in np.flatnonzero(sizes > LANES):
        found.append(_large_group(fps, int(starts[g]), int(sizes[g]), radius))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])
