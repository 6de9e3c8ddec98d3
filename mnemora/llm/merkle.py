"""Merkle manifest of a dataset: a tree for each source under one root, with every row's proof.

A leaf is the digest of a row's framed fields. A source's leaves are numbered in order (ranges dealt once, so a source with
most rows lies in many tasks) and cut into aligned blocks of FANOUT**LEVELS. A block is a task's contiguous numpy matrix of
64-byte hex digests: a level is the matrix reshaped to rows of FANOUT digests, each row hashed to a digest of the next. Blocks hand
their top to the next round, which holds one node for each block, until every source has one node; the sources' nodes are the
leaves of one more tree. On the way down each block gets the path above its top: the runs and its place in them, so
that siblings anywhere follow from a place by division. No task or driver holds more than a block and its path.

Edge cases: a null field is framed as `-`; an empty one as `0:`; a null source is a source of its own, before all others; rows
of a null doc_id come first and are never tampered with; rows of equal doc_id follow each other by leaf, and repeated rows are
leaves of their own; a source of one row has its leaf as subroot, and a table of one source its subroot as root; other columns do not
enter; empty in, empty out.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.llm.shared import cut, only, sorted_runs
from mnemora.operators.ordered import numbered

FANOUT, LEVELS = 16, 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HEX = np.frombuffer(b"".join(b"%02x" % i for i in range(256)), dtype=np.uint8).reshape(256, 2)
_BLOCK = "g string, block long, total long, ids array<long>, leaves binary, folded binary, top binary"
_PATH = "g string, block long, subroot binary, runs array<binary>, places array<int>"
_ROWS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def framed(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column) -> Column:
    fields = [framed(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    return F.unhex(F.sha2(F.concat(*fields, framed(text)), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(g, doc_id, leaf, folded): g names the source, in the order of sources; folded is the leaf after tampering, which
    lower-cases A-Z of the text where 5 divides the CRC-32 of doc_id's decimals."""
    rows = only(docs, "doc_id", "source", "lang", "n_chars", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    own = leaf(F.col("text"))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    folded = F.when(tampered, leaf(F.translate("text", _UPPER, _LOWER))).otherwise(own)
    return rows.select(F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("g"), "doc_id", own.alias("leaf"), folded.alias("folded"))


def to_hex(digests: np.ndarray) -> np.ndarray:
    """[n, 64] of hex digits from [n, 32] of bytes."""
    return _HEX[digests].reshape(len(digests), 64)


def grow(hexes: np.ndarray, total: int, fanout: int, levels: int) -> list[np.ndarray]:
    """The levels of an aligned block from its leaves up, each a contiguous matrix of hex digests; total is the number of leaves of the
    whole tree: a level is hashed while the tree has several nodes on it, so a block that stands alone may end earlier."""
    out = [np.ascontiguousarray(hexes)]
    for _ in range(levels):
        if total <= 1:
            break
        below = out[-1]
        full = len(below) // fanout
        runs = [*below[: full * fanout].reshape(full, fanout * 64), *([below[full * fanout :].reshape(-1)] if len(below) > full * fanout else [])]
        out.append(np.frombuffer("".join([sha256(r).hexdigest() for r in runs]).encode(), dtype=np.uint8).reshape(-1, 64))
        total = -(-total // fanout)
    return out


def run_of(level: np.ndarray, place: int, fanout: int) -> tuple[bytes, int]:
    """The run that holds a node of a level, and the node's place in it."""
    first = place - place % fanout
    return level[first : first + fanout].tobytes(), place - first


def fold(own: bytes, runs: list[bytes], places: list[int]) -> bytes:
    """The hex digest reached from a node's through its siblings."""
    for run, k in zip(runs, places):
        own = sha256(run[: 64 * k] + own + run[64 * k + 64 :]).hexdigest().encode()
    return own


def siblings(run: bytes, k: int) -> bytes:
    return run[: 64 * k] + run[64 * k + 64 :]


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, 32)


def blocks(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Aligned blocks of nodes(g, at, total, doc_id, leaf, folded), each with its top."""
    schema = pa.schema([("g", pa.string()), ("block", pa.int64()), ("total", pa.int64()), ("ids", pa.list_(pa.int64())), ("leaves", pa.binary()), ("folded", pa.binary()), ("top", pa.binary())])

    def run(batches):
        for rows in sorted_runs(batches, ["g", "block"]):
            digests, total = _matrix(rows["leaf"]), rows["total"][0].as_py()
            levels_here = grow(to_hex(digests), total, fanout, levels)
            top = bytes.fromhex(levels_here[-1].tobytes().decode())
            one = {"g": rows["g"][0].as_py(), "block": rows["block"][0].as_py(), "total": total, "ids": rows["doc_id"].to_pylist(), "leaves": digests.tobytes(), "folded": b"".join(rows["folded"].to_pylist()), "top": top}
            yield pa.RecordBatch.from_pylist([one], schema=schema)

    dealt = nodes.withColumn("block", F.floor(F.col("at") / fanout**levels))
    dealt = dealt.repartition("g", "block").sortWithinPartitions("g", "block", "at")
    return dealt.select("g", "block", "total", "doc_id", "leaf", "folded").mapInArrow(run, _BLOCK)


def rounds_of(nodes: DataFrame, fanout: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The rounds of blocks, written, from the leaves up, and (g, top) of each finished tree."""
    size, rounds, done = fanout**levels, [], None
    while True:
        made = cut(blocks(nodes, fanout, levels))
        rounds.append(made)
        over = made.where(F.col("total") <= size).select("g", "top")
        done = over if done is None else done.unionByName(over)
        left = made.where(F.col("total") > size)
        if left.isEmpty():
            return rounds, done
        above = left.select("g", F.col("block").alias("at"), F.ceil(F.col("total") / size).alias("total"), F.lit(None).cast("long").alias("doc_id"), F.col("top").alias("leaf"))
        nodes = above.withColumn("folded", F.col("leaf"))


def paths_down(made: DataFrame, paths: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The path of every node of the blocks `made`, from the paths of the blocks' tops: (g, block: the node's place, ...)."""
    schema = pa.schema([("g", pa.string()), ("block", pa.int64()), ("subroot", pa.binary()), ("runs", pa.list_(pa.binary())), ("places", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            for b in range(batch.num_rows):
                g, block, total, leaves, subroot, runs, places = (batch.column(c)[b].as_py() for c in range(7))
                own = grow(to_hex(np.frombuffer(leaves, dtype=np.uint8).reshape(-1, 32)), total, fanout, levels)
                out = []
                for i in range(len(own[0])):
                    here = [run_of(own[h], i // fanout**h, fanout) for h in range(len(own) - 1)]
                    out.append({"g": g, "block": block * fanout**levels + i, "subroot": subroot or own[0][i].tobytes(), "runs": [r for r, _ in here] + runs, "places": [k for _, k in here] + places})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    joined = made.join(paths, ["g", "block"])
    return joined.select("g", "block", "total", "leaves", "subroot", "runs", "places").mapInArrow(run, _PATH)


def proofs(made: DataFrame, paths: DataFrame, fanout: int, levels: int) -> DataFrame:
    """A row for each leaf of the lowest blocks."""
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())])

    def run(batches):
        for batch in batches:
            for b in range(batch.num_rows):
                total, ids, leaves, folded, subroot, runs, places = (batch.column(c)[b].as_py() for c in range(7))
                own = grow(to_hex(np.frombuffer(leaves, dtype=np.uint8).reshape(-1, 32)), total, fanout, levels)
                bent = to_hex(np.frombuffer(folded, dtype=np.uint8).reshape(-1, 32))
                above = b"".join(siblings(r, k) for r, k in zip(runs, places))
                root = fold(own[-1].tobytes(), runs, places)
                out, tails = [], {}
                for i in range(len(own[0])):
                    first = i // fanout
                    if first not in tails:  # what follows the leaf's own run is the same for all of its run
                        here = [run_of(own[h], i // fanout**h, fanout) for h in range(1, len(own) - 1)]
                        tails[first] = ([r for r, _ in here] + runs, [k for _, k in here] + places, b"".join(siblings(r, k) for r, k in here) + above)
                    run_above, place_above, tail = tails[first]
                    mine = [run_of(own[0], i, fanout)] if len(own) > 1 else []
                    proof = sha256(b"".join(siblings(r, k) for r, k in mine) + tail).hexdigest()
                    end = fold(bent[i].tobytes(), [r for r, _ in mine] + run_above, [k for _, k in mine] + place_above)
                    out.append((ids[i], own[0][i].tobytes().decode(), subroot.decode(), root.decode(), proof, end.decode(), end == root))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    joined = made.join(paths, ["g", "block"])
    return joined.select("total", "ids", "leaves", "folded", "subroot", "runs", "places").mapInArrow(run, _ROWS)


def manifest(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row. A proof's digest is taken over the siblings,
    left to right, from the leaf's run up to the root's; folded_root is what a tampered row's leaf leads to."""
    nodes = numbered(cut(leaves(docs)), ["g"], ["doc_id", "leaf", "folded"], "at", "total")
    own_rounds, done = rounds_of(nodes, fanout, levels)
    tops = numbered(done.select(F.col("g").alias("name"), F.lit("").alias("g"), "top"), ["g"], ["name"], "at", "total")
    tops = cut(tops.select("g", "name", "at", "total", F.lit(None).cast("long").alias("doc_id"), F.col("top").alias("leaf"), F.col("top").alias("folded")))
    top_rounds, root = rounds_of(tops.drop("name"), fanout, levels)
    nothing = F.lit(None).cast("binary").alias("subroot"), F.expr("cast(array() as array<binary>)").alias("runs"), F.expr("cast(array() as array<int>)").alias("places")
    paths = root.select("g", F.lit(0).cast("long").alias("block"), *nothing)
    for made in reversed(top_rounds):
        paths = cut(paths_down(made, paths.withColumn("subroot", F.lit(None).cast("binary")), fanout, levels))
    named = tops.select(F.col("name"), F.col("at").alias("block")).join(paths, "block")
    by_source = cut(named.select(F.col("name").alias("g"), F.lit(0).cast("long").alias("block"), "subroot", "runs", "places"))
    paths = None
    size = fanout**levels
    for made in reversed(own_rounds):
        ended = made.where(F.col("total") <= size).select("g").join(by_source, "g")
        here = ended if paths is None else ended.unionByName(paths)
        if made is own_rounds[0]:
            return proofs(made, here, fanout, levels)
        paths = cut(paths_down(made, here, fanout, levels))
