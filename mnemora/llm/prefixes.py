"""Trie of the conversations' common prefixes, from partial tries that merge by the hash of a prefix.

Turns are reduced to digests by Spark, dealt by ranges of (conversation, turn) and packed into segments of at most SEGMENT turns.
A prefix's key is three sums, modulo 2**64, of its turns' digests under powers of the depth (192 bits beside the depth), so a segment needs
only the sums before it, and a conversation with most of the turns lies in many tasks. Tasks build partial tries of about
BLOCK turns in numpy and emit each local node once, with the members and end lists it has there. Node tables are merged by
(depth, key) in rounds of FAN neighbouring parts; lists of ends, in the order of ids, are joined as they stream into their
hash. The merged facts go back to the partial tries, where sums are rolled up from the leaves; a node counts in the
partial trie of its smallest member only, so that the partial sums of a key add up to its subtree's.

A block that ends within a conversation lacks the nodes that follow: their sum is added at its last node, and taken off
again at the node where a later block goes on with it, which other conversations of that block may share.

Edge cases: null roles and texts count as empty; rows of equal turn follow each other by their digest, repeated rows are
turns of their own; a null conv_id is no conversation; % keeps the sign of negative ids; a rebuilt conversation without turns ends at the
root; other columns do not enter; empty in, empty out.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemora.llm.shared import cut, only, sorted_runs

HEAD, SHARED = 6, 100
"""A conversation takes up to HEAD - 1 turns of the first of its SHARED neighbours."""
SEGMENT, BLOCK, FAN = 4096, 1 << 16, 256
LANES, WIDE = 3, 24
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_MASK = (1 << 64) - 1
_SEGMENTS = "conv_id long, place long, n int, words binary, chars binary, total binary"
_STARTS = "conv_id long, place long, skip int, depth long, start binary, head_words binary, head_chars binary, first boolean, last boolean"
_LOCAL = "block long, at int, up int, depth long, key binary, parent binary, chars int, n_convs long, mine long, ends binary, open_conv long, from_conv long"
_ROLLED = "depth long, key binary, saved_tokens long, n_leaves long, parent_conv_id long"
_powers: dict[int, np.ndarray] = {}


def powers(n: int) -> np.ndarray:
    """[n, LANES]: the bases' powers from 0 on."""
    if n not in _powers:
        steps = np.tile(np.array(BASES, dtype=np.uint64), (n, 1))
        steps[0] = 1
        _powers[n] = np.cumprod(steps, axis=0, dtype=np.uint64)
    return _powers[n]


def lanes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<u8").reshape(-1, LANES)


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, word, chars): a turn's digest and the code points of its text."""
    rows = only(conversations, "conv_id", "turn", "role", "text").where(F.col("conv_id").isNotNull())
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.substring(digest, 1, WIDE).alias("word"), F.length(text).alias("chars"))


def segments(turns: DataFrame, size: int) -> DataFrame:
    """The turns in order, packed: place grows with (conversation, turn) over all tasks."""

    def run(batches):
        place = TaskContext.get().partitionId() << 40
        power = powers(size)
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy()
            fresh = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
            ends = np.append(fresh[1:], len(conv))
            starts = np.concatenate([np.arange(a, b, size) for a, b in zip(fresh, ends)]) if (ends - fresh).max() > size else fresh
            sizes = np.diff(np.append(starts, len(conv)))
            words = b"".join(batch.column("word").to_pylist())
            chars = batch.column("chars").to_numpy().astype("<i4").tobytes()
            weighted = lanes(words) * power[np.arange(len(conv)) - np.repeat(starts, sizes)]
            total = np.add.reduceat(weighted, starts, axis=0).tobytes()
            cuts = np.append(starts, len(conv)).tolist()
            spans = list(zip(cuts, cuts[1:]))
            columns = [
                pa.array(conv[starts]), pa.array(np.arange(len(starts)) + place), pa.array(sizes.astype(np.int32)), pa.array([words[WIDE * a : WIDE * b] for a, b in spans], pa.binary()),
                pa.array([chars[4 * a : 4 * b] for a, b in spans], pa.binary()), pa.array([total[WIDE * i : WIDE * i + WIDE] for i in range(len(starts))], pa.binary()),
            ]
            place += len(starts)
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "place", "n", "words", "chars", "total"])

    by = ["conv_id", "turn", "word"]
    return turns.repartitionByRange(*by).sortWithinPartitions(*by).select("conv_id", "word", "chars").mapInArrow(run, _SEGMENTS)


def starts(packed: DataFrame) -> DataFrame:
    """For each segment what comes before it in the rebuilt conversation: the turns to skip, the depth and sums reached, and, for
    the first one, the turns taken over."""
    least = HEAD - 1
    brief = packed.select("conv_id", "place", "n", F.substring("words", 1, WIDE * least).alias("words"), F.substring("chars", 1, 4 * least).alias("chars"), "total")
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("place"))
    firsts = brief.where(F.col("conv_id") % SHARED == 0).withColumn("nth", nth).where(f"nth <= {least}")
    heads = firsts.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("place", "words", "chars"))).alias("h"))  # of at most HEAD - 1
    convs = packed.select("conv_id").distinct().withColumn("base", F.col("conv_id") - F.col("conv_id") % SHARED).join(heads, "base", "left")
    none = F.lit(None).cast("binary")
    own = brief.select("conv_id", "place", "n", "words", "chars", "total", F.expr("cast(null as array<binary>)").alias("hw"), F.expr("cast(null as array<binary>)").alias("hc"))
    taken = convs.select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit(0).alias("n"), none.alias("words"), none.alias("chars"), none.alias("total"), F.col("h.words").alias("hw"), F.col("h.chars").alias("hc"))
    keep = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).cast("int")

    def run(batches):
        schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("skip", pa.int32()), ("depth", pa.int64()), ("start", pa.binary()), ("head_words", pa.binary()), ("head_chars", pa.binary()), ("first", pa.bool_()), ("last", pa.bool_())])
        held = None  # the segment before, as it may be the last of its conversation
        before, sums, left, hw, hc = None, [0] * LANES, 0, b"", b""
        for batch in batches:
            out = []
            for conv, place, n, words, total, keep_n, hws, hcs in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "place", "n", "words", "total", "keep", "hw", "hc")]):
                if place < 0:
                    if held:
                        out.append((*held, True))
                        held = None
                    hw, hc = b"".join(hws or [])[: WIDE * keep_n], b"".join(hcs or [])[: 4 * keep_n]
                    left, before = keep_n, None
                    continue
                skip = min(left, n)
                left -= skip
                if held:
                    out.append((*held, False))
                if before is None:
                    depth, sums, first, fresh = 0, [0] * LANES, True, True
                    reached = len(hw) // WIDE
                else:
                    (pn, pskip, pwords, ptotal, reached), first = before, False
                    if fresh:
                        for j, word in enumerate(lanes(hw).tolist()):
                            sums = [(s + w * pow(b, j, 1 << 64)) & _MASK for s, w, b in zip(sums, word, BASES)]
                    fresh = False
                    if pn > pskip:  # the sums of the segment before, from its first kept turn on, at the depth where that one stands
                        shift = reached - pskip
                        part = [int(x) for x in lanes(ptotal)[0]]
                        for j, word in enumerate(lanes(pwords)[:pskip].tolist()):
                            part = [(p - w * pow(b, j, 1 << 64)) & _MASK for p, w, b in zip(part, word, BASES)]
                        sums = [(s + p * pow(b, shift, 1 << 64)) & _MASK for s, p, b in zip(sums, part, BASES)]
                    reached += pn - pskip
                    depth = reached
                held = (conv, place, skip, depth, b"".join(s.to_bytes(8, "little") for s in sums), hw if first else b"", hc if first else b"", first)
                before = (n, skip, words, total, reached)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip((*held, True)), schema.types)], schema=schema)

    rows = own.unionByName(taken).withColumn("keep", keep).repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return rows.select("conv_id", "place", "n", "words", "total", "keep", "hw", "hc").mapInArrow(run, _STARTS)


def partial_trie(held: list[tuple], block: int) -> pa.RecordBatch:
    """The local nodes of some segments in order, by depth: parents stand before their children."""
    conv_of = np.array([s[0] for s in held], dtype=np.int64)
    depth_of = np.array([s[4] for s in held], dtype=np.int64)
    own = lanes(b"".join([bytes(WIDE) + s[6] + s[2][WIDE * s[3] :] for s in held]))
    chars = np.frombuffer(b"".join([bytes(4) + s[7] + s[9][4 * s[3] :] for s in held]), dtype="<i4")
    sizes = np.array([1 + len(s[6]) // WIDE + len(s[2]) // WIDE - s[3] for s in held], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    seg = np.repeat(np.arange(len(held)), sizes)
    step = np.arange(len(seg)) - begin[seg]  # 0 for the node where a segment starts
    power = powers(1 << int(max(sizes.max(), 2) - 1).bit_length())
    weighted = own * power[np.maximum(step - 1, 0)]
    for k in np.flatnonzero(depth_of):
        weighted[begin[k] : begin[k] + sizes[k]] *= np.array([pow(b, int(depth_of[k]), 1 << 64) for b in BASES], dtype=np.uint64)
    sums = np.cumsum(weighted, axis=0, dtype=np.uint64)
    keys = sums - sums[begin][seg] + lanes(b"".join([s[5] for s in held]))[seg]
    depth = depth_of[seg] + step
    order = np.lexsort((keys[:, 2], keys[:, 1], keys[:, 0], depth))
    sorted_keys, sorted_depth = keys[order], depth[order]
    fresh = np.concatenate(([True], (sorted_keys[1:] != sorted_keys[:-1]).any(axis=1) | (sorted_depth[1:] != sorted_depth[:-1])))
    first = np.flatnonzero(fresh)
    node_of = np.empty(len(order), dtype=np.int64)
    node_of[order] = np.cumsum(fresh) - 1
    starts_here = step == 0
    member = ~starts_here | np.array([s[8] for s in held])[seg]
    n = len(first)
    no_one = np.iinfo(np.int64).max
    mine = np.minimum.reduceat(np.where(member, conv_of[seg], no_one)[order], first)
    up = np.maximum.reduceat(np.where(starts_here, -1, np.concatenate(([0], node_of[:-1])))[order], first)
    ends: list[bytes | None] = [None] * n
    last = np.array([s[10] for s in held])
    end_node, end_conv = node_of[(begin + sizes - 1)[last]], conv_of[last]
    by = np.argsort(end_node, kind="stable")
    nodes_there, at = np.unique(end_node[by], return_index=True)
    ids = [str(c) for c in end_conv[by].tolist()]
    for k, a, b in zip(nodes_there.tolist(), at.tolist(), [*at[1:].tolist(), len(ids)]):
        ends[k] = ",".join(ids[a:b]).encode()
    open_conv, from_conv = [None] * n, [None] * n
    if not held[-1][10]:
        open_conv[int(node_of[-1])] = held[-1][0]
    if not held[0][8]:
        from_conv[int(node_of[0])] = held[0][0]
    node_keys = sorted_keys[first].tobytes()
    texts = [node_keys[WIDE * i : WIDE * i + WIDE] for i in range(n)]
    columns = [
        pa.array(np.full(n, block)), pa.array(np.arange(n, dtype=np.int32)), pa.array(up.astype(np.int32)), pa.array(sorted_depth[first]), pa.array(texts, pa.binary()),
        pa.array([texts[u] if u >= 0 else None for u in up.tolist()], pa.binary()), pa.array(np.maximum.reduceat(chars[order], first).astype(np.int32)),
        pa.array(np.bincount(node_of, member, n).astype(np.int64)), pa.array(mine, mask=mine == no_one), pa.array(ends, pa.binary()), pa.array(open_conv, pa.int64()), pa.array(from_conv, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["block", "at", "up", "depth", "key", "parent", "chars", "n_convs", "mine", "ends", "open_conv", "from_conv"])


def local_tries(packed: DataFrame, size: int) -> DataFrame:
    """Node tables of blocks of about `size` turns; the blocks' numbers grow with the conversations."""
    fields = ("conv_id", "place", "words", "skip", "depth", "start", "head_words", "head_chars", "first", "chars", "last")

    def run(batches):
        block, held, rows = TaskContext.get().partitionId() << 20, [], 0
        for batch in batches:
            for s in zip(*[batch.column(c).to_pylist() for c in fields]):
                held.append(s)
                rows += 1 + len(s[2]) // WIDE
                if rows >= size:
                    yield partial_trie(held, block)
                    block, held, rows = block + 1, [], 0
        if held:
            yield partial_trie(held, block)

    placed = packed.drop("total").join(starts(packed), ["conv_id", "place"])
    return placed.select(*fields).repartitionByRange("place").sortWithinPartitions("place").mapInArrow(run, _LOCAL)


def merged(local: DataFrame, fan: int) -> DataFrame:
    """(depth, key, parent, chars, n_convs, conv_id): node tables of neighbouring parts are merged by key, `fan` to one, until one is left."""
    table = local.select(F.shiftright("block", 20).alias("part"), "depth", "key", "parent", "chars", "n_convs", "mine")
    parts = (local.agg(F.max(F.shiftright("block", 20))).first()[0] or 0) + 1
    while True:
        facts = F.max("parent").alias("parent"), F.max("chars").alias("chars"), F.sum("n_convs").alias("n_convs"), F.min("mine").alias("mine")
        table = table.groupBy(F.floor(F.col("part") / fan).alias("part"), "depth", "key").agg(*facts)
        parts = -(-parts // fan)
        if parts == 1:
            return table.drop("part").withColumnRenamed("mine", "conv_id")


def end_hashes(local: DataFrame) -> DataFrame:
    """(depth, key, ends_sha256): parts of a node's list of ends follow each other in the order of blocks and stream into its hash."""

    def run(batches):
        at, digest = None, sha256()
        for batch in batches:
            out = []
            for depth, key, ends in zip(*[batch.column(c).to_pylist() for c in ("depth", "key", "ends")]):
                if (depth, key) == at:
                    digest.update(b",")
                else:
                    if at:
                        out.append((*at, digest.hexdigest()))
                    at, digest = (depth, key), sha256()
                digest.update(ends)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.string()))], ["depth", "key", "ends_sha256"])
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.binary()), pa.array([digest.hexdigest()])], ["depth", "key", "ends_sha256"])

    rows = local.where("ends is not null").select("depth", "key", "block", "ends")
    return rows.repartition("depth", "key").sortWithinPartitions("depth", "key", "block").mapInArrow(run, "depth long, key binary, ends_sha256 string")


def rolled_up(known: DataFrame) -> DataFrame:
    """(depth, key, saved_tokens, n_leaves, parent_conv_id): sums over the subtrees, from the leaves of each partial trie up."""
    split = known.select("block", F.explode(F.array_compact(F.array("open_conv", "from_conv"))).alias("conv_id")).distinct()
    own = known.where("rep").join(split, ["conv_id", "block"]).groupBy("conv_id", "block").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = split.join(own, ["conv_id", "block"], "left").na.fill(0, ["saved", "leaf"])
    sums = sums.select("conv_id", "block", "saved", "leaf", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"after_{c}") for c in ("saved", "leaf")])
    goes_on = known.join(sums.select(F.col("conv_id").alias("open_conv"), "block", "after_saved", "after_leaf"), ["open_conv", "block"]).select("block", "at", F.col("after_saved").alias("saved"), F.col("after_leaf").alias("leaf"))
    came = known.join(sums.select(F.col("conv_id").alias("from_conv"), "block", (-F.col("after_saved") - F.col("saved")).alias("s"), (-F.col("after_leaf") - F.col("leaf")).alias("l")), ["from_conv", "block"]).select("block", "at", F.col("s").alias("saved"), F.col("l").alias("leaf"))
    extra = goes_on.unionByName(came).withColumn("extra", F.lit(True))
    nodes = known.select("block", "at", F.when(F.col("rep"), F.col("saved")).otherwise(0).alias("saved"), F.when(F.col("rep"), F.col("leaf")).otherwise(0).alias("leaf"), F.lit(False).alias("extra"), "up", "depth", "key", "rep", "conv_id")

    def run(batches):
        for rows in sorted_runs(batches, ["block"]):
            is_extra = rows["extra"].to_numpy()
            nodes_ = rows.filter(pa.array(~is_extra))
            up, depth, rep, conv = (nodes_[c].to_numpy() for c in ("up", "depth", "rep", "conv_id"))
            sums = np.zeros((len(up), 2), dtype=np.int64)
            for k, c in enumerate(("saved", "leaf")):
                np.add.at(sums[:, k], rows["at"].to_numpy(), rows[c].to_numpy())
            change = [0, *(np.flatnonzero(depth[1:] != depth[:-1]) + 1).tolist(), len(depth)]
            for a, b in zip(change[-2::-1], change[:0:-1]):
                inner = np.arange(a, b)[up[a:b] >= 0]
                np.add.at(sums, up[inner], sums[inner])
            emit = np.flatnonzero(rep | sums.any(axis=1))
            above = up[emit]
            has = rep[emit] & (above >= 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(depth[emit]), nodes_["key"].take(pa.array(emit)).combine_chunks(), pa.array(sums[emit, 0]), pa.array(sums[emit, 1]), pa.array(conv[np.maximum(above, 0)], mask=~has)],
                ["depth", "key", "saved_tokens", "n_leaves", "parent_conv_id"],
            )

    order = ["block", "at", "extra"]
    dealt = nodes.unionByName(extra, allowMissingColumns=True).repartitionByRange("block").sortWithinPartitions(*order)
    parts = dealt.mapInArrow(run, _ROLLED)
    return parts.groupBy("depth", "key").agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"), F.max("parent_conv_id").alias("parent_conv_id"))


def prefix_trie(conversations: DataFrame, segment: int = SEGMENT, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """A row for each node of the trie of the rebuilt conversations: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256)."""
    packed = cut(segments(cut(turn_rows(conversations)), segment))
    local = cut(local_tries(packed, block))
    nodes = merged(local, fan)
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, ["depth", "key"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = cut(nodes.select("depth", "key", "conv_id", "n_convs", "n_children", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf")))
    here = local.select("block", "at", "up", "depth", "key", "mine", "open_conv", "from_conv").join(nodes, ["depth", "key"])
    known = cut(here.withColumn("rep", F.coalesce(F.col("mine") == F.col("conv_id"), F.lit(False))).drop("mine", "n_convs", "n_children"))
    out = nodes.select("depth", "key", "conv_id", "n_convs", "n_children").join(rolled_up(known), ["depth", "key"]).join(end_hashes(local), ["depth", "key"], "left")
    ends = F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends)
