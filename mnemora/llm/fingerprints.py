"""Document fingerprints by a randomised edit embedding, with bit-sampled bands over them.

A text is walked character by character. A shared random table says for each class of characters and each step (of a cycle
of CYCLE steps) whether the walk stays on the character or moves on, so a text becomes the longer string of characters
it stood on; walks over texts that differ by few edits soon fall into step again, and the edit distance becomes a Hamming
distance (Chakraborty, Goldenberg, Koucky 2016). Each of the BITS bits of a fingerprint samples one step of that string, by a
consistent choice: the step before the string's end that has the least value of the bit's own random sequence; a random
table gives the bit of the character there. All characters are walked; likeness is the share of sampled steps that agree,
estimated from the differing bits.

Texts follow each other by descending doc_id: rows are dealt once by ranges and stream through a task two at a time; what a task's
last row needs of the next task is fetched for those rows alone. Near copies share all of a band's sampled bits;
the fingerprints of a bucket are verified on all bits, a bucket of over `cap` of them in pairs of parts.

Edge cases: a null text counts as empty, and an empty one has the fingerprint zero; rows of equal doc_id follow each other by a
hash of their text, null ids come last; repeated rows are documents of their own; a lone document is its own next one; a null
doc_id never names a group that has another; other columns do not enter; empty in, empty out.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemora.llm.components import connected_components
from mnemora.llm.shared import cut, join_spread, only

BITS, CYCLE, CLASSES = 256, 256, 256
BANDS, BAND_BITS = 12, 32
NEAR = 0.95
"""Likeness of near copies. Of pairs that differ in 6 of 256 bits, the most that this allows, a band finds 0.445, and all bands miss one in 1,170."""
AT_ONCE = 1 << 20
BROADCAST = 1 << 17
"""Most keys of full buckets that are broadcast, about 2 MB."""
_rng = np.random.default_rng(12)
_MOVES = _rng.integers(0, 2, (CLASSES, CYCLE)).astype(bool)
_BIT_OF = _rng.integers(0, 2, (BITS, CLASSES)).astype(np.uint8)
_SAMPLED = np.stack([_rng.permutation(BITS)[:BAND_BITS] for _ in range(BANDS)])


def _after() -> list[bytes]:
    """For each class, by the step at which the walk reaches a character: the step at which it leaves, both in the cycle."""
    rows = []
    for c in range(CLASSES):
        moves = np.flatnonzero(_MOVES[c])
        nxt = moves[np.searchsorted(moves, np.arange(CYCLE)) % len(moves)]
        rows.append(((nxt + 1) % CYCLE).astype(np.uint8).tobytes())
    return rows


def _records() -> np.ndarray:
    """[BITS, n]: the steps at which each bit's random sequence has a new least value, from 0 on. The gap to the next one is
    geometric in the value reached."""
    rng, limit = np.random.default_rng(21), 1 << 45
    rows = []
    for _ in range(BITS):
        at, least, row = 0, rng.random(), []
        while at < limit:
            row.append(at)
            at += int(min(rng.geometric(max(least, 1e-15)), limit))
            least *= rng.random()
        rows.append(row)
    width = max(map(len, rows))
    return np.array([r + [limit] * (width - len(r)) for r in rows], dtype=np.int64)


_AFTER, _RECORDS = _after(), _records()


def classes(text: str) -> bytes:
    """ASCII characters are classes of their own, the others share the rest by a hash."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(points < 128, points, 128 + (points * np.uint32(0x9E3779B1) >> np.uint32(25))).astype(np.uint8).tobytes()


def walk(chars: bytes, at: int = 0) -> bytes:
    """The step, in the cycle, at which the walk leaves each character; `at` is where it begins."""
    after, out = _AFTER, []
    for i in range(0, len(chars), AT_ONCE):
        out.append(bytes([at := after[c][at] for c in chars[i : i + AT_ONCE]]))
    return b"".join(out)


def fingerprint(chars: bytes, left: bytes) -> np.ndarray:
    """[BITS / 8] bytes from the characters' classes and the steps at which the walk left them."""
    if not chars:
        return np.zeros(BITS // 8, dtype=np.uint8)
    steps = np.frombuffer(left, dtype=np.uint8)
    stay = np.diff(steps, prepend=np.uint8(0))
    length = int(stay.sum(dtype=np.int64))
    sampled = _RECORDS[np.arange(BITS), (_RECORDS < max(length, 1)).sum(axis=1) - 1]
    where = np.zeros(BITS, dtype=np.int64)
    done = 0
    for i in range(0, len(stay), AT_ONCE):
        ends = done + np.cumsum(stay[i : i + AT_ONCE], dtype=np.int64)
        here = (sampled >= done) & (sampled < ends[-1])
        where[here] = i + np.searchsorted(ends, sampled[here], side="right")
        done = int(ends[-1])
    of = np.frombuffer(chars, dtype=np.uint8)[np.minimum(where, len(chars) - 1)]
    return np.packbits(_BIT_OF[np.arange(BITS), of])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return max(0.0, 1.0 - 2.0 * int(np.bitwise_count(a ^ b).sum()) / BITS)


def text_fingerprint(text: str | None) -> bytes:
    chars = classes(text or "")
    return fingerprint(chars, walk(chars)).tobytes()


def edited_with(text: str, following: str) -> str:
    """The second half's code points replaced by the first of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


class _Walked:
    """A text with its walk and fingerprint."""

    def __init__(self, doc_id, text: str | None):
        self.doc_id, self.text = doc_id, text or ""
        self.chars = classes(self.text)
        self.left = walk(self.chars)
        self.print = fingerprint(self.chars, self.left)

    def row(self, following: _Walked) -> tuple:
        half = len(self.text) // 2
        kept = len(self.text) - half
        added = following.chars[:half]
        left = self.left[:kept] + walk(added, self.left[kept - 1] if kept else 0)
        edited = fingerprint(self.chars[:kept] + added, left)
        digest = sha256(edited_with(self.text, following.text).encode("utf-8", "surrogatepass")).hexdigest()
        return self.doc_id, len(self.text), digest, self.print.tobytes(), edited.tobytes(), likeness(self.print, edited), likeness(self.print, following.print)


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
_REPORT = "doc_id long, n_chars long, edited_sha256 string, fp binary, edited_fp binary, near_edited double, near_next double"


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, packed): texts compressed one by one, as they are shuffled once; mark orders rows of equal doc_id."""

    def run(batches):
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = [squeeze(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(texts, pa.binary())], ["doc_id", "mark", "packed"])

    source = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, mark long, packed binary")


def unpacked(data: bytes) -> str:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data).decode()


def prints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next) of every row."""
    edge_types = [*_TYPES, pa.int32(), pa.bool_(), pa.bool_(), pa.binary()]
    edge_names = [*_NAMES, "part", "first", "last", "packed"]

    def run(batches):
        part, held, own, first = TaskContext.get().partitionId(), None, b"", True

        def rows_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), edge_types)], edge_names)

        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                data = batch.column("packed")[i].as_py()
                now = _Walked(batch.column("doc_id")[i].as_py(), unpacked(data))
                if held:
                    out.append((*held.row(now), part, first, False, own if first else None))
                    first = False
                held, own = now, data
            if out:
                yield rows_of(out)
        if held:
            yield rows_of([(held.doc_id, len(held.text), None, held.print.tobytes(), None, None, None, part, first, True, own)])

    def finish(batches):
        for batch in batches:
            rows = [_Walked(a, unpacked(b)).row(_Walked(None, unpacked(c))) for a, b, c in zip(*[batch.column(k).to_pylist() for k in ("doc_id", "packed", "following")])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)

    order = [F.desc_nulls_last("doc_id"), F.col("mark")]
    dealt = packed(docs).repartitionByRange(*order).sortWithinPartitions(*order)
    done = cut(dealt.select("doc_id", "packed").mapInArrow(run, f"{_REPORT}, part int, first boolean, last boolean, packed binary"))
    parts = Window.orderBy("part")  # a row for each part
    heads = done.where("first").select("part", F.col("packed").alias("following"))
    after = done.where("last").select("part").withColumn("next", F.coalesce(F.lead("part").over(parts), F.min("part").over(parts)))
    ends = done.where("last").select("part", "doc_id", "packed").join(after, "part").join(heads.withColumnRenamed("part", "next"), "next")
    return done.where("not last").select(*_NAMES).unionByName(ends.select("doc_id", "packed", "following").mapInArrow(finish, _REPORT))


def band_keys(fps: DataFrame) -> DataFrame:
    """(key, fp) for each band of each fingerprint."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            fps = batch.column(0)
            bits = np.unpackbits(np.frombuffer(b"".join(fps.to_pylist()), dtype=np.uint8).reshape(-1, BITS // 8), axis=1)
            for k, sampled in enumerate(_SAMPLED):
                value = np.ascontiguousarray(np.packbits(bits[:, sampled], axis=1)).view(">u4")[:, 0].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(value + (k << 32)), fps], ["key", "fp"])

    return fps.mapInArrow(run, "key long, fp binary")


def chained(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each of some fingerprints [n, 4] the first one of those that a chain of near ones joins to it."""
    root = np.full(len(fps), -1)
    for seed in range(len(fps)):
        if root[seed] >= 0:
            continue
        root[seed] = seed
        todo = [seed]
        while todo:
            left = np.flatnonzero(root < 0)
            near = left[np.bitwise_count(fps[left] ^ fps[todo.pop()]).sum(axis=1) <= radius]
            root[near] = seed
            todo += near.tolist()
    return root


def in_parts(fps: DataFrame, cap: int) -> DataFrame:
    """(key, a, b, fp): all fingerprints of a bucket meet, no (key, a, b) has much over 2 * cap of them. Only keys are counted; the full
    ones, usually few, are broadcast where their number allows it, and fingerprints are shuffled once."""
    full = cut(band_keys(fps).groupBy("key").count().where(F.col("count") > cap).select("key", F.ceil(F.col("count") / cap).cast("int").alias("parts")))
    dealt = band_keys(fps).join(F.broadcast(full) if full.count() <= BROADCAST else full, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")


def links(fps: DataFrame, near: float = NEAR, cap: int = 4096) -> DataFrame:
    """(u, v): links between distinct fingerprints `fp` that share a band and are alike by `near` or more, as chains: at most one row a
    fingerprint and bucket."""
    radius = int((1 - near) * BITS / 2)

    def run(batches):
        held = []

        def work(rows: pa.Table, last: bool):
            keys = [rows[c].to_numpy() for c in ("key", "a", "b")]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            if not last:
                if not len(change):
                    return None, rows
                rows, rest = rows.slice(0, change[-1]), rows.slice(change[-1])
                change = change[:-1]
            else:
                rest = rows.slice(0, 0)
            starts = np.concatenate(([0], change))
            sizes = np.diff(np.append(starts, rows.num_rows))
            some = np.flatnonzero(sizes > 1)
            u, v = [], []
            for a, n in zip(starts[some].tolist(), sizes[some].tolist()):
                own = rows["fp"].slice(a, n).to_pylist()
                root = chained(np.frombuffer(b"".join(own), dtype="<u8").reshape(n, BITS // 64), radius)
                joined = np.flatnonzero(root != np.arange(n))
                u += [own[i] for i in joined]
                v += [own[i] for i in root[joined]]
            return pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"]) if u else None, rest

        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= 65536:
                out, rest = work(pa.Table.from_batches(held), last=False)
                held, count = rest.to_batches(), 0
                if out:
                    yield out
        if held and (rows := pa.Table.from_batches(held)).num_rows:
            out, _ = work(rows, last=True)
            if out:
                yield out

    return in_parts(fps, cap).repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(run, "u binary, v binary")


def near_groups(report: DataFrame, near: float = NEAR, cap: int = 4096) -> DataFrame:
    """(fp, component_id, times) of each distinct fingerprint of report(doc_id, fp): the smallest doc_id of its group of near copies."""
    nodes = cut(report.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("times")))
    parts = cut(connected_components(links(nodes.select("fp"), near, cap)))
    named = cut(nodes.join(parts.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    heads = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return named.join(heads, "component").select("fp", "component_id", "times")


def fingerprint_report(docs: DataFrame, near: float = NEAR) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, component_id) of every row;
    component_id is the smallest doc_id among the near copies of the text, itself included."""
    report = cut(prints(docs))
    out = join_spread(report, cut(near_groups(report.select("doc_id", "fp"), near)), ["fp"], "times", report.count())
    hexed = [F.lower(F.hex("fp")).alias("fingerprint"), F.lower(F.hex("edited_fp")).alias("edited_fingerprint")]
    return out.select("doc_id", "n_chars", "edited_sha256", *hexed, "near_edited", "near_next", "component_id")
