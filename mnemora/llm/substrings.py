"""Removal of repeated passages: Rabin-Karp hashes of all windows of `width` words, counted in Spark.

Documents are dealt into blocks, ranges of doc_id of about `block_bytes` of text, so that the number of a block tells which of
two documents comes first. The driver holds at most RANGES bounds: a range of more text is cut evenly by doc_id, and a doc_id
of more text than a block is dealt by rows. A block hashes every window of its texts, keeps each distinct hash
once, and sends them, sorted and packed in 9 bytes, to the buckets that count them. A
bucket answers a block with one bit a hash: does a window of an earlier block have it? Then the
block, which deals out by the same exchange and so is not shuffled anew, marks windows seen
earlier, merges them into maximal intervals and cuts those. A hash that half of the
corpus shares is one entry from each block.

The bucket's number and the 9 bytes come from two 64-bit hashes, log2(buckets) + 72 bits together, and the
number of buckets grows with the corpus: 96 bits at 100 TB, where one false repeat is expected in 500 corpora. Blocks and
buckets grow up to GROWTH times with the corpus, so that a block's list for a bucket stays longer than its row's overhead.

Edge cases: a null text has no words (its kept text is empty); texts of fewer words than a window
lose nothing; rows of equal doc_id are ordered by the hash of their text within a block, equal rows among themselves anyhow; a null
doc_id sorts first. Columns of any other name are carried along. Empty in, empty out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from mnemora.llm.shared import free_name, only
from mnemora.llm.textkernels import NOT_SPACE, chunks_of, joined, token_hashes, tokens, window_hashes

U64 = np.uint64
WIDTH = 20
BLOCK_BYTES = 6 << 20
BUCKET_WINDOWS = 1 << 20
RANGES = 4096
GROWTH = 6
GROWS_FROM = 64 << 30


def windows_of(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; then, for all windows in order, two hashes."""
    counts = np.zeros(len(texts), dtype=np.int64)
    first, second = [], []
    for a, b in chunks_of(texts):
        data, begins = joined(texts[a:b])
        starts, ends = tokens(data, NOT_SPACE)
        words = token_hashes(data, starts, ends)
        at = np.searchsorted(starts, begins)
        counts[a:b] = np.diff(at)
        h = window_hashes(words, width)
        if not len(h):
            continue
        g = window_hashes(words, width, 0xA24BAED4963EE407, "window-2")
        inside = np.zeros(len(words) + 1, dtype=bool)  # a window must not reach into the next text
        for s, e in zip(at[:-1], at[1:]):
            inside[s : max(s, e - width + 1)] = True
        inside = inside[: len(h)]
        first.append(h[inside])
        second.append(g[inside])
    none = np.empty(0, U64)
    return counts, np.concatenate(first) if first else none, np.concatenate(second) if second else none


def distinct_windows(texts: list[bytes], width: int, buckets: int):
    """Words of each text, and for the block's distinct windows by (bucket, hash): bucket, 64-bit hash and 8 bits more;
    the distinct window that each window is, and whether it is that one's first place."""
    counts, h, g = windows_of(texts, width)
    bucket = (h >> U64(32)) * U64(buckets) >> U64(32)
    more = h.astype(np.uint8)
    order = np.lexsort((g, bucket))
    b, t, m = bucket[order], g[order], more[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (b[1:] != b[:-1]) | (t[1:] != t[:-1]) | (m[1:] != m[:-1])
    which = np.empty(len(order), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    first = np.zeros(len(order), dtype=bool)
    first[order[new]] = True  # lexsort is stable: the earliest window of a run stands first
    return counts, b[new].astype(np.int64), (t[new], m[new]), which, first


def _packed(tails: np.ndarray, more: np.ndarray) -> bytes:
    return np.concatenate([tails.astype("<u8").view(np.uint8).reshape(-1, 8), more[:, None]], axis=1).tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(data, dtype=np.uint8).reshape(-1, 9)
    return np.ascontiguousarray(rows[:, :8]).view("<u8")[:, 0].astype(U64), rows[:, 8]


def _texts(table: pa.Table) -> list[bytes]:
    return [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]


def covered(n_words: int, marked: np.ndarray, width: int) -> np.ndarray:
    """Which words lie in a marked window: overlapping windows merge into maximal intervals."""
    edge = np.zeros(n_words + 1, dtype=np.int64)
    at = np.flatnonzero(marked)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return np.cumsum(edge[:-1]) > 0


def _blocks(docs: DataFrame, id_: F.Column, total: int, block_bytes: int):
    """A function from (doc_id, any number of the row) to the row's block."""
    n = min(RANGES, max(1, -(-total // block_bytes)))
    cuts = docs.select(F.percentile_approx(id_, [i / n for i in range(1, n)] or [0.5], 16 * n)).first()[0] or []
    values, times = np.unique(np.array(cuts[: n - 1], dtype=np.int64), return_counts=True)
    bounds = np.union1d(values, values[(times > 1) & (values > -(1 << 63))] - 1)  # a doc_id of several ranges is one of its own

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="left").astype(np.int32))

    held = docs.select(range_of(id_).alias("r"), id_.alias("i"), F.octet_length("text").alias("b")).groupBy("r").agg(F.min("i").alias("lo"), F.max("i").alias("hi"), F.sum("b").alias("b")).collect()
    size = len(bounds) + 1
    low, span, parts = np.zeros(size), np.ones(size), np.ones(size, dtype=np.int64)
    for r in held:  # at most 2 * RANGES rows
        low[r.r], span[r.r], parts[r.r] = r.lo, float(r.hi) - float(r.lo), max(1, -(-(r.b or 0) // block_bytes))
    start = np.cumsum(parts) - parts

    @F.pandas_udf("long")
    def block_of(ids: pd.Series, rows: pd.Series) -> pd.Series:
        x = ids.to_numpy()
        r = np.searchsorted(bounds, x, side="left")
        even = ((x.astype(np.float64) - low[r]) / np.maximum(span[r], 1.0) * parts[r]).astype(np.int64)
        dealt = rows.to_numpy().astype(np.int64) % parts[r]
        return pd.Series(start[r] + np.where(span[r] > 0, np.clip(even, 0, parts[r] - 1), dealt))

    return block_of


def remove_repeats(docs: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES, bucket_windows: int = BUCKET_WINDOWS) -> tuple[DataFrame, list[str]]:
    """All columns of docs, text replaced by the kept words joined by one space where something was removed, with three more
    columns whose names are returned: words, words removed, and SHA-256 of the kept words joined by one space."""
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    grown = min(GROWTH, max(1.0, total / GROWS_FROM))
    buckets = max(1, -(-total // int(6 * bucket_windows * grown)))
    names = docs.columns
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    id_name, tie_name, block_name = (free_name(docs, n) for n in ("id", "tie", "block"))
    id_ = F.coalesce(F.col("`doc_id`").cast("long"), F.lit(-(1 << 63)))
    block_of = _blocks(docs, id_, total, int(block_bytes * grown))
    dealt = docs.select(*[F.col(f"`{c}`") for c in names], id_.alias(id_name), F.xxhash64("text").alias(tie_name), block_of(id_, F.abs(F.hash(F.monotonically_increasing_id()).cast("long"))).alias(block_name))

    def in_order(table: pa.Table) -> pa.Table:
        return table.sort_by([(id_name, "ascending"), (tie_name, "ascending")])

    def hashes(table: pa.Table) -> pa.Table:
        table = in_order(table)
        _, bucket, (tail, more), _, _ = distinct_windows(_texts(table), width, buckets)
        cuts = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)])) if len(bucket) else np.zeros(1, np.int64)
        block = table.column(block_name)[0].as_py()
        n = len(cuts) - 1
        lists = [_packed(tail[a:b], more[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.table({"bucket": pa.array(bucket[cuts[:-1]] if n else [], pa.int64()), "block": pa.array([block] * n, pa.int64()), "hashes": pa.array(lists, pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        lists = [_unpacked(x) for x in table.column("hashes").to_pylist()]
        every, more = np.concatenate([x for x, _ in lists]), np.concatenate([m for _, m in lists])
        order = np.argsort(every, kind="stable")  # lists stand in the order of their blocks: the first of a run is the earliest
        seen = np.zeros(len(every), dtype=bool)
        seen[order[1:]] = (every[order[1:]] == every[order[:-1]]) & (more[order[1:]] == more[order[:-1]])
        sizes = np.array([len(x) for x, _ in lists])
        ends = np.cumsum(sizes)
        bits = [np.packbits(seen[e - n : e]).tobytes() for n, e in zip(sizes.tolist(), ends.tolist())]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "seen": pa.array(bits, pa.binary())})

    added = [free_name(docs, n) for n in ("n_words", "n_removed", "kept_sha256")]

    def cut_out(table: pa.Table, verdicts: pa.Table) -> pa.Table:
        table = in_order(table)
        texts = _texts(table)
        counts, bucket, _, which, first = distinct_windows(texts, width, buckets)
        seen = np.zeros(len(bucket), dtype=bool)
        answers = {b: s for b, s in zip(verdicts.column("bucket").to_pylist(), verdicts.column("seen").to_pylist())}
        for b in np.unique(bucket):
            lo, hi = np.searchsorted(bucket, [b, b + 1])
            seen[lo:hi] = np.unpackbits(np.frombuffer(answers[int(b)], dtype=np.uint8), count=hi - lo).astype(bool)
        marked = ~first | seen[which]
        removed, digests, kept = np.zeros(len(texts), dtype=np.int64), [], []
        at = 0
        for i, (text, n) in enumerate(zip(texts, counts.tolist())):
            n_windows = max(0, n - width + 1)
            own = marked[at : at + n_windows]
            at += n_windows
            words = text.split()
            if own.any():
                gone = covered(n, own, width)
                removed[i] = gone.sum()
                words = [w for w, g in zip(words, gone.tolist()) if not g]
            line = b" ".join(words)
            digests.append(hashlib.sha256(line).hexdigest())
            kept.append(line if removed[i] else None)
        old = table.column("text").to_pylist()
        text = [o if k is None else k.decode() for o, k in zip(old, kept)]
        columns = {c: pa.array(text, pa.string()) if c == "text" else table.column(c) for c in names}
        return pa.table(columns | dict(zip(added, (pa.array(counts), pa.array(removed), pa.array(digests, pa.string())))))

    lists = dealt.groupBy(block_name).applyInArrow(hashes, "bucket long, block long, hashes binary")
    verdicts = lists.groupBy("bucket").applyInArrow(count, "block long, bucket long, seen binary")
    schema = StructType([*[StructField(c, kinds[c]) for c in names], StructField(added[0], LongType()), StructField(added[1], LongType()), StructField(added[2], StringType())])
    return dealt.groupBy(block_name).cogroup(verdicts.groupBy("block")).applyInArrow(cut_out, schema), added


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with every passage removed that stands earlier in the corpus; the same columns."""
    out, _ = remove_repeats(docs, width)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def repeats_report(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    out, added = remove_repeats(only(docs, "doc_id", "text"), width)
    return out.select("doc_id", *[F.col(a).alias(n) for a, n in zip(added, ("n_words", "n_removed", "kept_sha256"))])
