"""Embedding near-duplicates through a pivot-permutation index.

A vector is described by its PREFIX nearest pivots, in order of nearness. Two vectors are candidates if
they share at least SHARED of them or have the same nearest one. An inverted list for each (label, pivot) holds the vectors; since
two sets of PREFIX that share SHARED must share one of their first PREFIX - SHARED + 1 by any fixed
order, only those and the nearest one are listed. A list's candidates are verified by their cosine in double precision; as a
matrix product is the cheaper test, it is made first, and shared pivots are counted for the pairs that pass it. A pair
is judged only in the first list that has both, so each link counts once. Lists over `cap` are dealt into pairs of parts; tasks return a
count and a root for each vector, never pairs. Equal vectors are one node with a multiplicity. Vectors travel in their own type.

Vectors often share a direction. Their mean over the sampled ones is taken off before they are described, as far as pairs at the
least cosine stay NEARNESS alike without it, so that pivots and lists tell vectors apart by what they do not share.

Pivots are distinct vectors in the order of a hash, no two with a cosine of APART or more:
a dense cluster gets one pivot, so all its pairs are candidates, and the other pivots still tell
its members from the rest. Pivots from inside it would be nearly equidistant, and their order chance. There is a pivot for
each EACH vectors, PIVOTS at least and MOST at most, chosen from 8 times as many: with up to 500,000 vectors lists keep their length,
beyond that they grow in proportion, and a list is as many pairs as its members squared. Every vector is indexed.

Edge cases: a null label, or a vector that is null, zero, or has null or non-finite components, links with
nothing; vectors of different length never link; repeated rows link with one another. A
null vec_id takes part but names no component that has another id. Columns of any other name are left out. Empty in, empty out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.components import connected_components
from mnemora.llm.shared import cut, join_spread, only
from mnemora.llm.simhash import in_parts

PIVOTS, MOST, EACH = 256, 4096, 128
APART, NEARNESS = 0.5, 0.77
PREFIX = 10
SHARED = 3
CAP = 2048


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, dtype=np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _off(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Unit vectors without their shared direction, as unit vectors; one that is nothing else stays zero."""
    y = x - centre
    return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)


def _centre(x: np.ndarray, least: float) -> np.ndarray:
    """What the unit vectors share: their mean, or as much of it as leaves pairs of cosine `least` at NEARNESS."""
    mean = x.mean(axis=0)
    common = float(mean @ mean)
    keep = max(0.0, (NEARNESS * (1 - common) - least + common) / (1 - NEARNESS))
    return mean * max(0.0, 1 - np.sqrt(keep / max(common, 1e-12)))


def _points(rows: list, most: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The shared direction of some vectors, and pivots among them."""
    x = _unit(rows)
    centre = _centre(x, least)
    return centre, _apart(_off(x, centre), most)


def _apart(x: np.ndarray, most: int, apart: float = APART) -> np.ndarray:
    """The first unit vectors that are far from all chosen before them."""
    free = np.ones(len(x), dtype=bool)
    out = []
    for i in range(len(x)):
        if free[i] and len(out) < most:
            out.append(i)
            free &= x @ x[i] < apart
    return x[out]


def _local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component under the links (i, j)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many entries each row of a has in common with that row of b; entries of a row differ, -1 is none."""
    return ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).sum(axis=(1, 2))


def near_duplicates(vectors: DataFrame, least: float = 0.93, pivots: int | None = None, prefix: int = PREFIX, shared: int = SHARED, cap: int = CAP) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    rows = only(vectors, "vec_id", "embedding", "label").select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{kind}>"), "label")
    finite = F.expr("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))") & F.expr("exists(embedding, x -> x <> 0)")
    usable = F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))
    rows = rows.withColumn("__ok", usable)
    same = ["label", "embedding"]
    nodes = rows.where("__ok").groupBy(*same).agg(F.min("vec_id").alias("first"), F.count("*").alias("times"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    if pivots is None:
        pivots = min(MOST, max(PIVOTS, nodes.count() // EACH))
    chosen = nodes.select("embedding").orderBy(F.xxhash64("embedding"), "node").limit(8 * pivots).toArrow().column(0)
    points: dict = {}  # by length of vector
    for x in chosen.to_pylist():
        points.setdefault(len(x), []).append(x)
    points = {n: _points(x, pivots, least) for n, x in points.items()}
    listed = prefix - shared + 1

    def describe(batches):
        for batch in batches:
            lists = batch.column("embedding").to_pylist()
            near = np.full((len(lists), prefix), -1, dtype=np.int64)
            for n in {len(x) for x in lists} & points.keys():
                own = np.flatnonzero([len(x) == n for x in lists])
                centre, there = points[n]
                dots = _off(_unit([lists[i] for i in own]), centre) @ there.T
                top = np.argpartition(-dots, min(prefix, dots.shape[1]) - 1, axis=1)[:, :prefix] if dots.shape[1] > prefix else np.tile(np.arange(dots.shape[1]), (len(own), 1))
                order = np.argsort(-np.take_along_axis(dots, top, axis=1), axis=1, kind="stable")
                near[own, : top.shape[1]] = np.take_along_axis(top, order, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(near), pa.list_(pa.int64()))], [*batch.schema.names, "near"])

    described = nodes.select("node", "label", "times", "embedding").mapInArrow(describe, f"node long, label {dict(rows.dtypes)['label']}, times long, embedding array<{kind}>, near array<long>")
    real = F.filter("near", lambda x: x >= 0)
    by_pivot = F.array_sort(F.array_union(F.slice(F.array_sort(real), 1, listed), F.slice(real, 1, 1)))
    members = described.withColumn("width", F.size("embedding")).withColumn("listed", by_pivot)
    members = members.select("label", "width", F.explode(F.when(F.size("listed") > 0, F.col("listed")).otherwise(F.array(F.lit(-1).cast("long")))).alias("pivot"), "node", "times", "embedding", "near", "listed")

    def compare(table: pa.Table) -> pa.Table:
        pivot, a, b = (table.column(c)[0].as_py() for c in ("pivot", "a", "b"))
        own = table.column("own").to_numpy()
        node, times = table.column("node").to_numpy(), table.column("times").to_numpy()
        x = _unit(table.column("embedding").to_pylist())
        near = np.array(table.column("near").to_pylist(), dtype=np.int64)
        before = np.full((len(node), listed + 1), -1, dtype=np.int64)
        for r, own_list in enumerate(table.column("listed").to_pylist()):
            before[r, : len(own_list)] = own_list
        before[before >= pivot] = -1  # what is left are the lists before this one
        need = min(shared, int((near >= 0).sum(axis=1).min()))
        left = np.flatnonzero(own == a)
        right = np.flatnonzero(own == b)
        links = np.zeros(len(node), dtype=np.int64)
        pairs = []
        for s in range(0, len(left), 128):
            i = left[s : s + 128]
            close = x[i] @ x[right].T >= least
            if a == b:
                close &= i[:, None] < right
            p, q = np.nonzero(close)
            p, q = i[p], right[q]
            found = (_shared(before[p], before[q]) == 0) & ((near[p, 0] == near[q, 0]) | (_shared(near[p], near[q]) >= need))
            pairs.append((p[found], q[found]))
        p, q = np.concatenate([u for u, _ in pairs] or [[]]).astype(int), np.concatenate([v for _, v in pairs] or [[]]).astype(int)
        links += np.bincount(p, times[q], len(node)).astype(np.int64) + np.bincount(q, times[p], len(node)).astype(np.int64)
        root = _local_roots(len(node), p, q)
        some = np.flatnonzero(links)
        return pa.table({"node": node[some], "n": links[some], "root": node[root[some]]})

    dealt = in_parts(members, ["label", "width", "pivot"], "node", cap)
    found = cut(dealt.groupBy("label", "width", "pivot", "a", "b").applyInArrow(compare, "node long, n long, root long"))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    parts = cut(connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v"))))
    plain = nodes.select("node", "first", "times").join(counts, "node", "left").join(parts, "node", "left")
    plain = cut(plain.select("node", "first", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")))
    heads = plain.groupBy("component").agg(F.min("first").alias("head"))
    by_node = plain.join(heads, "component").select("node", "n_links", "head")
    by_vector = cut(nodes.select("node", "times", *same).join(by_node, "node").drop("node"))
    linked = join_spread(rows.where("__ok"), by_vector, same, "times", rows.count()).select("vec_id", "n_links", F.col("head").alias("component_id"))
    alone = rows.where("not __ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
