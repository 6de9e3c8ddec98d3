"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

Tasks tokenize texts into pieces (rows without text). Pieces that fill a sequence stand alone; the others
are dealt by a hash into chunks of about CHUNK pieces, so no key is hot and no task unbounded, and each
chunk is packed by itself: a bin is filled greedily with the longest piece that fits, then its smallest
piece gives way to two unpacked pieces that fill the widened gap more tightly. A chunk
leaves at most a few bins open, a fixed share of its bins.

Edge cases: a null text counts as empty; an empty document is its end mark alone, a piece of length 1;
rows of equal doc_id are documents of their own; empty in, empty out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.shared import cut, only, utf8
from mnemora.llm.tokens import IdEncoder, proven_whole

LIMIT = 2048
CHUNK = 8192
END = 0
_encoders: dict[str, IdEncoder] = {}
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_KINDS = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}


def _ended(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ids of all texts with the end mark after each."""
    return np.insert(ids, np.cumsum(sizes), END)


def pieces(docs: DataFrame, path: str, limit: int = LIMIT, at_once: int = 4096) -> DataFrame:
    """A row for each piece of each document, without its text."""

    proven = docs.sparkSession.sparkContext.broadcast(proven_whole(path))

    def run(batches):
        if path not in _encoders:
            _encoders[path] = IdEncoder(path, proven.value)
        for batch in batches:
            for i in range(0, batch.num_rows, at_once):
                part = batch.slice(i, at_once)
                doc_id = part.column("doc_id")
                for a, b, ids, sizes in _encoders[path].encode(utf8(part.column("text"))):
                    data = memoryview(_ended(ids, sizes).astype("<u4").tobytes())
                    sizes = sizes + 1
                    begin = np.cumsum(sizes) - sizes
                    n = -(-sizes // limit)
                    of = np.repeat(np.arange(b - a), n)
                    piece = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                    length = np.minimum(limit, sizes[of] - piece * limit)
                    at = 4 * (begin[of] + piece * limit)
                    crc = [zlib.crc32(data[x : x + y]) for x, y in zip(at.tolist(), (4 * length).tolist())]
                    columns = (doc_id.take(pa.array(a + of)), piece, piece * limit, length, crc)
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, _KINDS.values())], list(_KINDS))

    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PIECE)


def best_two_fit(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; all lengths are from 1 to limit."""
    order = np.argsort(lengths, kind="stable")
    begin = np.searchsorted(lengths[order], np.arange(limit + 2))
    left = np.diff(begin)  # unpacked pieces of each length; those of one length are used in turn
    sizes = np.arange(limit + 1)
    at_most = np.maximum.accumulate(np.where(left > 0, sizes, 0))  # the longest unpacked length up to each

    def take(size: int) -> None:
        left[size] -= 1
        if not left[size]:
            end = size
            while end <= limit and at_most[end] == size:
                end += 1
            at_most[size:end] = at_most[size - 1]

    def give_back(size: int) -> None:
        left[size] += 1
        if left[size] == 1:
            np.maximum(at_most[size:], size, out=at_most[size:])

    bin_of = np.empty(len(lengths), dtype=np.int64)
    offset = np.empty(len(lengths), dtype=np.int64)
    used = np.zeros(limit + 1, dtype=np.int64)
    number, packed = 0, 0
    while packed < len(lengths):
        gap, own = limit, []
        while gap and (size := int(at_most[gap])):
            own.append(size)
            gap -= size
            take(size)
        if gap and len(own) > 1:
            smallest = own[-1]
            room = gap + smallest
            a = sizes[1 : room // 2 + 1]
            a = a[left[a] > 0]
            if len(a):
                b = at_most[room - a].copy()
                b[(b == a) & (left[a] < 2)] = 0
                both = np.where(b > 0, a + b, 0)
                k = int(both.argmax())
                if both[k] > smallest:
                    own.pop()
                    give_back(smallest)
                    for size in (int(b[k]), int(a[k])):
                        own.append(size)
                        take(size)
        place = 0
        for size in own:
            row = order[begin[size] + used[size]]
            used[size] += 1
            bin_of[row], offset[row] = number, place
            place += size
        packed += len(own)
        number += 1
    return bin_of, offset


def pack(docs: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    Pieces are dealt by their row number, which differs for equal rows too.
    """
    kept = cut(pieces(docs, path, limit).withColumn("row", F.monotonically_increasing_id()))
    whole = kept.where(F.col("length") == limit)
    chunks = max(1, -(-kept.where(F.col("length") < limit).count() // chunk))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        bin_of, offset = best_two_fit(table.column("length").to_numpy(), limit)
        number = bin_of * (2 * chunks) + 2 * table.column("chunk")[0].as_py()
        columns = {c: table.column(c) for c in _KINDS}
        return pa.table(columns | {"sequence_id": pa.array(number), "offset": pa.array(offset)})

    dealt = kept.where(F.col("length") < limit).withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("long"))
    mixed = dealt.groupBy("chunk").applyInArrow(run, f"{_PIECE}, sequence_id long, offset long")
    alone = whole.select(*_KINDS, (F.col("row") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return mixed.unionByName(alone)
