"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Words are the runs of ASCII letters, digits and non-ASCII characters of the lower-cased text; shingles are five
words. Items are partitioned by their number of distinct shingles. An item's sketch is its first shingles in one order of all: those
of the fewest items first, equal ones by their hash, so that a phrase many items begin with is no candidate of each. It has as
many as its partition's largest item needs: of n shingles, a document that
holds a share t misses at most n - ceil(t n), so n - ceil(t n) + 1 of them can't all be missing. Documents
look up their own shingles in the inverted sketches, so a short item is found inside a document of any
length with recall 1; candidates are then verified on the shingles' words.

The index of the items is broadcast in blocks of at most `block_bytes` of item text. A larger benchmark
takes several blocks, one after the other: what a block finds is written before the next is built, so tasks and
driver hold one index at a time.

Edge cases: an item of fewer than five words is one shingle of all its words; null and empty items and
documents match nothing; repeated items and rows each count; a null id is carried along. Empty in, empty out.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.shared import cut, only
from mnemora.llm.textkernels import ALNUM, chunks_of, joined, token_hashes, tokens, window_hashes

SHINGLE = 5
CONTAINMENT = 0.8
BLOCK_BYTES = 8 << 20
_TABLE_BITS = 20


def _lower(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in pc.utf8_lower(column).cast(pa.binary()).to_pylist()]


def _phrase(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, i: int, width: int) -> bytes:
    return b" ".join(data[s:e].tobytes() for s, e in zip(starts[i : i + width].tolist(), ends[i : i + width].tolist()))


class Items:
    """Inverted sketches of a block of items, and all their shingles."""

    def __init__(self, ids: list, texts: list[bytes], containment: float, shingle: int):
        self.ids, self.share = ids, containment
        self.phrases: list[set[bytes]] = []
        self.hashes: list[np.ndarray] = []
        self.widths: list[int] = []
        for text in texts:
            data, _ = joined([text])
            starts, ends = tokens(data, ALNUM)
            width = min(shingle, len(starts))
            h = window_hashes(token_hashes(data, starts, ends), width) if width else np.empty(0, np.uint64)
            self.phrases.append({_phrase(data, starts, ends, i, width) for i in range(len(h))})
            self.hashes.append(np.unique(h))
            self.widths.append(width)
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        known, times = np.unique(np.concatenate(self.hashes or [np.empty(0, np.uint64)]), return_counts=True)
        for width in sorted({w for w in self.widths if w}):
            keys, owners = [], []
            for item, h in enumerate(self.hashes):
                if self.widths[item] == width:
                    rare = np.argsort(times[np.searchsorted(known, h)], kind="stable")  # h is in order
                    sketch = h[rare[: self._sketch_size(len(self.phrases[item]))]]
                    keys.append(sketch)
                    owners.append(np.full(len(sketch), item))
            key, owner = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(key, kind="stable")
            table = np.zeros(1 << _TABLE_BITS, dtype=bool)
            table[key >> np.uint64(64 - _TABLE_BITS)] = True
            self.by_width[width] = key[order], owner[order], table

    def _sketch_size(self, n: int) -> int:
        largest = (1 << n.bit_length()) - 1  # of the partition of items with from 2**k to 2**(k+1) - 1 shingles
        return largest - math.ceil(self.share * largest) + 1

    def matches(self, texts: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(text, item, shared shingles, shingles of the item) where the item is contained."""
        found = []
        for a, b in chunks_of(texts):
            data, begins = joined(texts[a:b])
            starts, ends = tokens(data, ALNUM)
            words = token_hashes(data, starts, ends)
            at = np.searchsorted(starts, begins)
            text_of = np.repeat(np.arange(len(at) - 1), np.diff(at))
            for width, (keys, owners, table) in self.by_width.items():
                h = window_hashes(words, width)
                spots = np.flatnonzero(table[h >> np.uint64(64 - _TABLE_BITS)])
                spots = spots[text_of[spots] == text_of[spots + width - 1]]
                lo, hi = np.searchsorted(keys, h[spots], "left"), np.searchsorted(keys, h[spots], "right")
                times = hi - lo
                entry = np.repeat(lo - (np.cumsum(times) - times), times) + np.arange(times.sum())
                pairs = np.unique(np.repeat(text_of[spots], times) * len(self.ids) + owners[entry])
                for text, item in zip((pairs // len(self.ids)).tolist(), (pairs % len(self.ids)).tolist()):
                    own = np.arange(at[text], at[text + 1] - width + 1)
                    own = own[np.isin(h[own], self.hashes[item])]
                    shared = len({_phrase(data, starts, ends, i, width) for i in own.tolist()} & self.phrases[item])
                    if shared >= self.share * len(self.phrases[item]) - 1e-9:
                        found.append((a + text, item, shared, len(self.phrases[item])))
        return found


def _one_by_one(docs: DataFrame, items: DataFrame, containment: float, shingle: int, block_bytes: int, apply):
    """apply(broadcast index) for each block of items. All but a single block's result is written before the next block."""
    plain = only(items, "item_id", "text").where(F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text")
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        block = plain if n == 1 else plain.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        held = block.toArrow()
        index = docs.sparkSession.sparkContext.broadcast(Items(held.column("item_id").to_pylist(), _lower(held.column("text").combine_chunks()), containment, shingle))
        done = apply(index)
        if n > 1:
            done = cut(done)
            index.destroy()
        yield done


def contained_items(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) for each item contained in a document."""
    schema = "doc_id long, item_id long, n_shared long, n_item long, containment double"

    def search(index):
        def run(batches):
            for batch in batches:
                got = index.value.matches(_lower(batch.column("text")))
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[t], index.value.ids[i], shared, n, shared / n) for t, i, shared, n in got]
                columns = list(zip(*rows)) or [()] * 5
                kinds = [pa.int64()] * 4 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "n_shared", "n_item", "containment"])

        return run

    source = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    parts = [*_one_by_one(docs, items, containment, shingle, block_bytes, lambda index: source.mapInArrow(search(index), schema))]
    return reduce(DataFrame.unionByName, parts)


def clean_documents(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that contain no item; the same columns, row by row: no shuffle."""

    def drop(index):
        def run(batches):
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[t for t, *_ in index.value.matches(_lower(batch.column("text")))]] = False
                yield batch.filter(pa.array(keep))

        return run

    left = [docs]
    for kept in _one_by_one(docs, items, containment, shingle, block_bytes, lambda index: left[-1].mapInArrow(drop(index), docs.schema)):
        left.append(kept)
    return left[-1]
