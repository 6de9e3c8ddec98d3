"""Near copies: five-word shingles with a Jaccard similarity of 0.8 or more, found by SimHash and verified.

A text has a 64-bit SimHash of its shingles and BANDS keys of two MinHash values each. Texts that share a key meet in a
bucket, where their SimHashes are compared bit-sliced (bitslice.py) within RADIUS; what is left is verified on the
sets of shingle hashes, but only where the two are not linked already. So a group of copies costs about one
verification a text and bucket, and returns one link a text, never pairs. At a similarity of exactly 0.8 a pair shares a key
with probability 0.9997; its SimHashes differ by 10 bits on average, by more than RADIUS in 1 of 10,000.

Words are those of the fingerprint query: A-Z lower-cased, split at ASCII white space. Equal texts are one node. The shingles of
a text travel only if it shares a key with another text; buckets over `part_bytes` of them are dealt into
parts, and each pair of parts is a task's work of bounded size.

Edge cases: null texts and texts without words are copies of each other; a text of fewer words than a shingle is one shingle;
repeated rows are copies; of a group the row of the smallest doc_id is kept, rows without one last. Empty in, empty out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.bitslice import LANES, neighbours, planes_of
from mnemora.llm.components import connected_components
from mnemora.llm.shared import cut, keep_first, only, utf8
from mnemora.llm.textkernels import NOT_SPACE, chunks_of, joined, mix, token_hashes, tokens, window_hashes

U64 = np.uint64
SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 22
BANDS = 8
PART_BYTES, PART_ROWS = 24 << 20, 4096
SMALL = 64
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_seed = mix(np.arange(1, 4 * BANDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
_EMPTY = U64(0)


def shingles_of(texts: list[bytes], width: int = SHINGLE):
    """For ranges of texts: (first, end, shingle hashes in order, number of each text's). A text without words has the one hash 0."""
    for a, b in chunks_of(texts):
        data, begins = joined(texts[a:b])
        data = _lower[data]
        starts, ends = tokens(data, NOT_SPACE)
        words = token_hashes(data, starts, ends)
        at = np.searchsorted(starts, begins)
        n = np.diff(at)
        h = window_hashes(words, width)
        inside = np.zeros(len(h) + 1, dtype=np.int64)  # +1 where a text's windows begin, -1 after its last
        full = n >= width
        np.add.at(inside, at[:-1][full], 1)
        np.add.at(inside, at[1:][full] - width + 1, -1)
        own = h[np.cumsum(inside[:-1]) > 0]
        count = np.where(full, n - width + 1, 0)
        short = np.flatnonzero(~full)
        one = [mix(window_hashes(words[at[i] : at[i + 1]], int(n[i]))[:1] ^ U64(n[i]))[0] if n[i] else _EMPTY for i in short]
        own = np.insert(own, np.cumsum(count)[short], np.array(one, dtype=U64))
        count[short] = 1
        yield a, b, own, count


def simhash_and_keys(h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """([texts] SimHashes, [texts, BANDS] keys) of texts of count shingles each."""
    at = np.cumsum(count) - count
    ones = np.add.reduceat(np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1), at, axis=0, dtype=np.int32)
    fp = np.packbits(2 * ones > count[:, None], axis=1).view(">u8").astype(U64)[:, 0]
    keys = np.empty((len(count), BANDS), dtype=U64)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            low = [np.minimum.reduceat((h + _seed[4 * band + 2 * i]) * (_seed[4 * band + 2 * i + 1] | U64(1)), at) for i in range(2)]
            keys[:, band] = mix(low[0] ^ mix(low[1] + _seed[4 * band]))
    return fp, keys


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    shared = int((large[at] == small).sum())
    return shared / (len(a) + len(b) - shared)


def verified_links(fps: np.ndarray, sets: list[np.ndarray], radius: int, least: float) -> list[tuple[int, int]]:
    """Links (i, j) that join the same rows as all pairs within the radius and of the least similarity would."""
    n = len(fps)
    parent = np.arange(n)
    out: list[tuple[int, int]] = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    words = -(-n // LANES)
    planes = planes_of(np.concatenate([fps, np.repeat(fps[:1], words * LANES - n)])[None, :])
    every = np.arange(words * LANES)
    s, step = 0, 1
    while s < n:
        q = np.arange(s, min(n, s + step))
        s, step = s + step, min(256, 4 * step)
        while (parent != parent[parent]).any():
            parent = parent[parent]
        label = np.concatenate([parent, np.full(words * LANES - n, -1)])
        dead = (label == parent[q][:, None]) | (label < 0) | (every <= q[:, None])
        near = neighbours(planes, fps[q][None, :], np.packbits(dead, axis=1, bitorder="little").view(U64)[None], radius)[0]
        i, j = np.nonzero(np.unpackbits(near.view(np.uint8), axis=1, bitorder="little"))
        for x, y in zip(q[i].tolist(), j.tolist()):
            a, b = root(x), root(y)
            if a != b and similarity(sets[x], sets[y]) >= least:
                out.append((x, y))
                parent[b] = a
    return out


def small_links(fps: list[np.ndarray], sets: list[list[np.ndarray]], radius: int, least: float) -> list[list[tuple[int, int]]]:
    """The same for many groups of at most 64 rows, compared bit-sliced together."""
    sizes = np.array([len(x) for x in fps])
    width = int(sizes.max())
    lane = np.arange(LANES)
    real = lane < sizes[:, None]
    lanes = np.zeros((len(fps), LANES), dtype=U64)
    lanes[real] = np.concatenate(fps)
    dead = ~real[:, None, :] | (lane <= np.arange(width)[:, None])
    near = neighbours(planes_of(lanes), lanes[:, :width], np.packbits(dead, axis=2, bitorder="little").view(U64), radius)
    near[~real[:, :width]] = 0
    found = np.unpackbits(near.view(np.uint8), axis=2, bitorder="little")
    out: list[list[tuple[int, int]]] = [[] for _ in fps]
    parents = [list(range(n)) for n in sizes.tolist()]
    for g, x, y in zip(*(k.tolist() for k in np.nonzero(found))):
        parent = parents[g]
        if parent[x] != parent[y] and similarity(sets[g][x], sets[g][y]) >= least:
            out[g].append((x, y))
            old, new = parent[y], parent[x]
            parents[g] = [new if p == old else p for p in parent]
    return out


def _links_of_groups(radius: int, least: float, at_once: int = 256):
    """For rows sorted by (group, a, b): the links of each group, as they pass by."""

    def batch_of(pairs: list[tuple[int, int]]):
        return pa.RecordBatch.from_arrays([pa.array([u for u, _ in pairs], pa.int64()), pa.array([v for _, v in pairs], pa.int64())], ["u", "v"])

    def links(groups: list[list[tuple]]):
        fps = [np.array([f for _, f, _ in g], dtype=np.int64).view(U64) for g in groups]
        sets = [[np.frombuffer(s, dtype=U64) for *_, s in g] for g in groups]
        found = small_links(fps, sets, radius, least) if len(groups[0]) <= LANES else [verified_links(fps[0], sets[0], radius, least)]
        return batch_of([(g[i][0], g[j][0]) for g, pairs in zip(groups, found) for i, j in pairs])

    def run(batches):
        held: list[tuple] = []
        small: list[list[tuple]] = []
        now = None

        def close():
            nonlocal small
            if len(held) > LANES:
                yield links([held])
            elif len(held) > 1:
                small.append(held)
                if len(small) == at_once:
                    yield links(small)
                    small = []

        for batch in batches:
            for *group, node, fp, grams in zip(*[batch.column(c).to_pylist() for c in ("gid", "a", "b", "node", "fp", "grams")]):
                if group != now:
                    yield from close()
                    held, now = [], group
                held.append((node, fp, grams))
        yield from close()
        if small:
            yield links(small)

    return run


def near_copies(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY, radius: int = RADIUS, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, text_hash) of one row of each group of near copies: the first by doc_id, then by the hash of its text."""

    def prints(batches):
        import xxhash

        for batch in batches:
            for a, b, h, count in shingles_of(utf8(batch.column("text")), shingle):
                _, keys = simhash_and_keys(h, count)
                part = batch.slice(a, b - a)
                lists = pa.ListArray.from_arrays(np.arange(b - a + 1, dtype=np.int32) * BANDS, pa.array(keys.reshape(-1).view(np.int64)))
                columns = [part.column(c) for c in ("doc_id", "text_hash", "size")]
                ends = np.cumsum(count)
                words = [xxhash.xxh3_128_digest(h[e - n : e].tobytes()) for e, n in zip(ends.tolist(), count.tolist())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(words, pa.binary()), lists, pa.array(count)], ["doc_id", "text_hash", "size", "words", "keys", "grams"])

    source = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.coalesce(F.octet_length("text"), F.lit(-1)).alias("size"), "text")
    seen = source.mapInArrow(prints, "doc_id long, text_hash long, size int, words binary, keys array<long>, grams long")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("text_hash"), F.col("size"))
    nodes = seen.groupBy("words").agg(F.min(order).alias("first"), F.first("keys").alias("keys"), F.first("grams").alias("grams"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))

    members = nodes.select("node", "grams", F.explode("keys").alias("key"))
    met = cut(members.groupBy("key").agg(F.count("*").alias("n"), F.sum(8 * F.col("grams")).alias("bytes")).where("n > 1"))
    few = members.join(met.where(F.col("n") <= SMALL).select("key"), "key").groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    few = few.select("nodes").distinct().select(F.xxhash64("nodes").alias("gid"), F.lit(0).alias("a"), F.lit(-1).alias("b"), F.explode("nodes").alias("node"))
    parts = F.greatest(F.ceil(F.col("bytes") / part_bytes), F.ceil(F.col("n") / PART_ROWS)).cast("int")
    many = members.join(met.where(F.col("n") > SMALL).select("key", parts.alias("parts")), "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    many = many.select(F.col("key").alias("gid"), F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node")
    groups = cut(few.unionByName(many))

    def sets(batches):
        for batch in batches:
            for a, b, h, count in shingles_of(utf8(batch.column("text")), shingle):
                fp, _ = simhash_and_keys(h, count)
                ends = np.cumsum(count)
                grams = [np.unique(h[e - n : e]).tobytes() for e, n in zip(ends.tolist(), count.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), pa.array(fp.view(np.int64)), pa.array(grams, pa.binary())], ["node", "fp", "grams"])

    no_id = F.lit(-(1 << 63))  # a node's text is read from its first row, so that a text of many copies is no hot key
    wanted = nodes.join(groups.select("node").distinct(), "node").select(F.coalesce("first.doc_id", no_id).alias("at"), "first.text_hash", "first.size", "node")
    texts = source.select(F.coalesce("doc_id", no_id).alias("at"), "text_hash", "size", "text").join(wanted, ["at", "text_hash", "size"]).dropDuplicates(["node"]).select("node", "text")
    rows = groups.join(texts.mapInArrow(sets, "node long, fp long, grams binary"), "node")
    links = rows.repartition("gid", "a", "b").sortWithinPartitions("gid", "a", "b").mapInArrow(_links_of_groups(radius, least), "u long, v long")
    linked = cut(connected_components(links))
    named = nodes.select("node", "first").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = named.groupBy("component").agg(F.min("first").alias("head"))
    return heads.select(F.col("head.doc_id").alias("doc_id"), F.col("head.text_hash").alias("text_hash"))


def keep_one_copy(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group of near copies."""
    return keep_first(docs, cut(near_copies(docs, shingle, least)))
