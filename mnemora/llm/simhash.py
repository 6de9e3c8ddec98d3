"""SimHash near-duplicates: bit-sliced comparison inside pigeonhole buckets.

Two fingerprints at most `radius` bits apart agree on at least BLOCKS - radius of
BLOCKS bit blocks. Every choice of that many blocks is a table; equal values in a table
share a bucket, so no pair within the radius is missed. Buckets are compared on bit
planes. A bucket of over `cap` fingerprints is dealt into parts, and each pair of
parts is a task's work of bounded size. Tasks return chains, not pairs: at most one
row a fingerprint and bucket, whatever the size of a group of copies.

Edge cases: a null text counts as a text without words (fingerprint zero); fewer words
than a shingle make one shingle; equal fingerprints are one node; rows with a
null doc_id take part but never name a group that has another id; empty in, empty out.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.bitslice import linked_rows
from mnemora.llm.components import connected_components
from mnemora.llm.shared import cut, join_spread, keep_first, only

BLOCKS = 4
_FP = "doc_id long, text_hash long, fp long"


def fingerprint(text: bytes | None, shingle: int = 3, at_once: int = 1 << 15) -> int:
    """The 64-bit SimHash of a UTF-8 text: a bit is 1 if set in over half the shingle hashes."""
    import xxhash

    words = (text or b"").lower().split()  # bytes.lower and bytes.split know only ASCII
    if not words:
        return 0
    plain = b" ".join(words)
    width = min(shingle, len(words))
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    count = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), at_once):
        h = np.array([digest(plain[a:b], 42) for a, b in zip(starts[i : i + at_once], ends[i : i + at_once])], dtype=">u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp) of every row; text_hash tells rows apart that share a doc_id."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"])

    source = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return source.mapInArrow(run, _FP)


def table_keys(fp: str, radius: int, blocks: int = BLOCKS) -> list:
    """A column for each choice of blocks that must agree: the table's number over the blocks' bits."""
    width = 64 // blocks
    mask = (1 << width) - 1
    keys = []
    for t, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key = F.lit(t).cast("long")
        for b in chosen:
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(F.col(fp), b * width).bitwiseAND(F.lit(mask).cast("long")))
        keys.append(key)
    return keys


def in_parts(members: DataFrame, keys: list[str], member: str, cap: int) -> DataFrame:
    """members with own, their part, and (a, b), a pair of parts that has it: all members of a key meet, and no (key, a, b)
    has much over 2 * cap of them.

    A key of at most cap members has the one pair (0, 0). Counts are pre-aggregated; only
    the keys over cap are joined back.
    """
    full = members.groupBy(*keys).count().where(F.col("count") > cap).select(*keys, F.ceil(F.col("count") / cap).cast("int").alias("parts"))
    dealt = members.join(full, keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(member), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other")).drop("parts", "other")


def links(distinct_fps: DataFrame, radius: int = 2, cap: int = 4096, blocks: int = BLOCKS) -> DataFrame:
    """(u, v): links between the distinct fingerprints `fp` that keep the same connected components as
    all pairs at most radius bits apart."""
    if not 0 <= radius < blocks:
        raise ValueError("radius must be less than the number of blocks")

    def run(batches):
        held: list[np.ndarray] = []
        count = 0

        def work(rows: np.ndarray, last: bool):
            """Compares all groups that are complete; returns what is left."""
            change = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            if not last:
                if not len(change):
                    return None, rows
                rows, rest = rows[: change[-1]], rows[change[-1] :]
                change = change[:-1]
            else:
                rest = rows[:0]
            starts = np.concatenate(([0], change)).astype(np.int64)
            sizes = np.diff(np.concatenate((starts, [len(rows)])))
            fps = np.ascontiguousarray(rows[:, 3]).view(np.uint64)
            u, v = linked_rows(fps, starts, sizes, radius)
            out = pa.RecordBatch.from_arrays([pa.array(rows[u, 3]), pa.array(rows[v, 3])], ["u", "v"]) if len(u) else None
            return out, rest

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1))
            count += batch.num_rows
            if count >= 32768:
                out, rest = work(np.concatenate(held), last=False)
                held, count = [rest], 0
                if out is not None:
                    yield out
        if held and (rows := np.concatenate(held)).size:
            out, _ = work(rows, last=True)
            if out is not None:
                yield out

    members = distinct_fps.select("fp", F.explode(F.array(*table_keys("fp", radius, blocks))).alias("key"))
    dealt = in_parts(members, ["key"], "fp", cap).select("key", "a", "b", "fp")
    return dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, cap: int = 4096) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, kept): the group of each row, named by its smallest
    doc_id. kept is true for the group's first row by (doc_id, text_hash); rows equal in both are alike."""
    prints = cut(fingerprints(docs, shingle))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("text_hash"))
    nodes = cut(prints.groupBy("fp").agg(F.min(order).alias("first"), F.count("*").alias("times")))
    parts = cut(connected_components(links(nodes.select("fp"), radius, cap)))
    named = nodes.join(parts.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = cut(named)
    heads = named.groupBy("component").agg(F.min("first").alias("head"))
    by_fp = cut(named.select("fp", "component", "times").join(heads, "component").select("fp", "head", "times"))
    return join_spread(prints, by_fp, ["fp"], "times", prints.count()).select(
        "doc_id", "text_hash", "fp", F.col("head.doc_id").alias("component_id"), (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_hash") == F.col("head.text_hash"))).alias("kept")
    )


def keep_one(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """docs with one row of each group of near-duplicates, all columns as they were."""
    return keep_first(docs, cut(near_duplicates(docs, radius, shingle).where("kept").select("doc_id", "text_hash")))
