"""A bounded memo of what each token of bytes stands for, looked up by numpy for a whole batch.

A token is found by a 64-bit hash and then compared byte for byte, so an equal hash never stands for another token.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from mnemora.llm.textkernels import token_hashes

U64 = np.uint64
ENTRIES = 1 << 20
BYTES = 16 << 20
LONGEST = 96
"""Tokens of more bytes are solved each time and never kept."""


class _Growing:
    """An array that grows by doubling."""

    def __init__(self, dtype):
        self.held, self.used = np.zeros(1024, dtype=dtype), 0

    def add(self, x: np.ndarray) -> None:
        need = self.used + len(x)
        if need > len(self.held):
            more = np.zeros(max(need, 2 * len(self.held)), dtype=self.held.dtype)
            more[: self.used] = self.held[: self.used]
            self.held = more
        self.held[self.used : need] = x
        self.used = need


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] of them), then the same for the next."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class TokenTable:
    """Tokens to lists of unsigned 32-bit values. solve(list of texts) gives (values, sizes) of tokens that are new."""

    def __init__(self, solve: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], entries: int = ENTRIES, most_bytes: int = BYTES, longest: int = LONGEST):
        self.solve, self.entries, self.most_bytes, self.longest = solve, entries, most_bytes, longest
        self.slots = 1 << (2 * entries).bit_length()
        self._start()

    def _start(self) -> None:
        self.slot = np.full(self.slots, -1, dtype=np.int32)
        self.key, self.text = _Growing(U64), _Growing(np.uint8)
        self.text_at, self.text_size = _Growing(np.int32), _Growing(np.int32)
        self.value, self.value_at, self.value_size = _Growing(np.uint32), _Growing(np.int32), _Growing(np.int32)

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry of each hash, -1 for none, and the slot where the search ended."""
        at = (h % U64(self.slots)).astype(np.int64)
        entry = self.slot[at]
        left = np.flatnonzero(entry >= 0)
        left = left[self.key.held[entry[left]] != h[left]]
        while len(left):
            at[left] = (at[left] + 1) % self.slots
            entry[left] = self.slot[at[left]]
            left = left[entry[left] >= 0]
            left = left[self.key.held[entry[left]] != h[left]]
        return entry.astype(np.int64), at

    def _same(self, entry: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether each token's bytes are those of its entry."""
        out = self.text_size.held[entry] == sizes
        some = np.flatnonzero(out & (sizes > 0))
        size = sizes[some]
        equal = data[spread(starts[some], size)] == self.text.held[spread(self.text_at.held[entry[some]].astype(np.int64), size)]
        if len(some) and not equal.all():
            out[some] = np.logical_and.reduceat(equal, np.cumsum(size) - size)
        return out

    def _insert(self, h: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Adds tokens of distinct new hashes."""
        texts = [data[a : a + n].tobytes().decode() for a, n in zip(starts.tolist(), sizes.tolist())]
        values, counts = self.solve(texts)
        number = self.key.used + np.arange(len(h))
        self.text_at.add(self.text.used + np.cumsum(sizes) - sizes)
        self.text_size.add(sizes)
        self.text.add(data[spread(starts, sizes)])
        self.value_at.add(self.value.used + np.cumsum(counts) - counts)
        self.value_size.add(counts)
        self.value.add(values)
        self.key.add(h)
        left = np.arange(len(h))
        while len(left):
            _, at = self._find(h[left])
            _, first = np.unique(at, return_index=True)  # of tokens that meet at a free slot, one takes it
            self.slot[at[first]] = number[left[first]]
            left = np.delete(left, first)

    def values(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, sizes): the values of all tokens in order, and how many each has."""
        if self.key.used > self.entries * 7 // 8 or self.text.used > self.most_bytes:
            self._start()
        sizes = ends - starts
        h = token_hashes(data, starts, ends)
        short = sizes <= self.longest
        entry, _ = self._find(h)
        new = np.flatnonzero((entry < 0) & short)
        if len(new):
            _, first = np.unique(h[new], return_index=True)
            room = self.entries - self.key.used
            first = new[np.sort(first)[:room]]
            self._insert(h[first], data, starts[first], sizes[first])
            entry[new], _ = self._find(h[new])
        known = np.flatnonzero((entry >= 0) & short)
        known = known[self._same(entry[known], data, starts[known], sizes[known])]
        alone = np.ones(len(starts), dtype=bool)
        alone[known] = False
        alone = np.flatnonzero(alone)
        at, count, held = self.value_at.held, self.value_size.held, self.value.held
        if not len(alone):
            n = count[entry].astype(np.int64)
            return held[spread(at[entry].astype(np.int64), n)], n
        more, more_sizes = self.solve([data[a:b].tobytes().decode() for a, b in zip(starts[alone].tolist(), ends[alone].tolist())])
        n, begin = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
        n[known], begin[known] = count[entry[known]], at[entry[known]]
        n[alone], begin[alone] = more_sizes, self.value.used + np.cumsum(more_sizes) - more_sizes
        return np.concatenate([held[: self.value.used], more])[spread(begin, n)], n
