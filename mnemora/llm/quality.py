"""Quality classifier: random-indexing word vectors, pooled, under a small calibrated network.

Every word has a sparse random index vector. A word's own vector is the sum of the index
vectors of the words around it (and of its own) over all documents, centred and scaled to
length one; words share VOCABULARY hash buckets, as many for any corpus, so that the table has a size that can be broadcast (2 MB).
Tasks add up and send only the buckets that their texts touch. A
document is the mean of its words' vectors. A two-layer network in numpy is fitted on at
most `sample` labelled rows and its temperature on a part of them kept aside.

Edge cases: null and empty texts pool to zeros and get the network's score for that; with
no usable labels, or labels of one kind only, each score is the share of good labels (0.5 without
any); conflicting labels of a doc_id count as bad; of texts of equal labelled doc_id the fit takes the one of the least
pooled bytes; a null doc_id never has a label.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.shared import free_name, only
from mnemora.llm.textkernels import WORDS_AND_MARKS, chunks_of, joined, token_hashes, tokens

VOCABULARY = 1 << 13
"""Buckets of words, for any corpus. With many more distinct words than these, words share vectors; held-out accuracy on the tables at hand is the
same or better than with up to 65,536, and the time a GB takes hardly depends on it, so a corpus of more words may take more."""
DIM = 64
FEATURES = DIM + 3
NONZEROS = 2
REACH = 2
SLICES = 256
SAMPLE = 20_000
"""Most labelled rows that a fit uses, by the order of a hash of doc_id."""


def index_vectors(vocabulary: int = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzeros of each bucket's index vector."""
    rng = np.random.default_rng(20)
    return rng.integers(0, DIM, (vocabulary, NONZEROS)), rng.choice([-1.0, 1.0], (vocabulary, NONZEROS))


def buckets_of(texts: list[bytes], vocabulary: int = VOCABULARY):
    """For chunks of the texts: range of texts, bucket of each token, first token of each text (and the end)."""
    for a, b in chunks_of(texts):
        data, begins = joined(texts[a:b])
        starts, ends = tokens(data, WORDS_AND_MARKS)
        yield a, b, (token_hashes(data, starts, ends) % np.uint64(vocabulary)).astype(np.int64), np.searchsorted(starts, begins)


def _bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def neighbour_sums(bucket: np.ndarray, at: np.ndarray, place: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets that a chunk of texts touches, the sums of their neighbours' index vectors, and how often each one stands."""
    touched, own_of = np.unique(bucket, return_inverse=True)
    text_of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    keys, weights = [], []
    for reach in range(1, REACH + 1):
        near = text_of[reach:] == text_of[:-reach]
        for own, other in ((own_of[:-reach][near], bucket[reach:][near]), (own_of[reach:][near], bucket[:-reach][near])):
            keys.append((own[:, None] * DIM + place[other]).ravel())
            weights.append(sign[other].ravel())
    sums = np.bincount(np.concatenate(keys), np.concatenate(weights), len(touched) * DIM).reshape(-1, DIM)
    return touched, sums, np.bincount(own_of, minlength=len(touched))


def word_vectors(docs: DataFrame, vocabulary: int = VOCABULARY) -> np.ndarray:
    """[vocabulary, DIM] from all documents. Tasks add up locally and send the buckets they have touched, in slices; the
    slices are added as they stream in."""
    place, sign = index_vectors(vocabulary)
    schema = "slice int, buckets binary, sums binary"
    names = ["slice", "buckets", "sums"]

    def add_up(batches):
        total, seen = np.zeros((vocabulary, DIM), dtype=np.float32), np.zeros(vocabulary, dtype=np.float32)
        for batch in batches:
            for _, _, bucket, at in buckets_of(_bytes(batch.column(0)), vocabulary):
                if len(bucket):
                    touched, sums, times = neighbour_sums(bucket, at, place, sign)
                    total[touched] += sums
                    seen[touched] += times
        held = np.flatnonzero(seen)
        ends = np.searchsorted(held, np.arange(SLICES + 1) * (vocabulary // SLICES))
        rows = [(k, held[a:b].astype(np.int32).tobytes(), np.column_stack([total[held[a:b]], seen[held[a:b]]]).tobytes()) for k, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names)

    def merge(batches):
        total: dict[int, np.ndarray] = {}
        each = vocabulary // SLICES
        for batch in batches:
            for k, buckets, sums in zip(*[c.to_pylist() for c in batch.columns]):
                own = total.setdefault(k, np.zeros((each, DIM + 1)))
                own[np.frombuffer(buckets, dtype=np.int32) - k * each] += np.frombuffer(sums, dtype=np.float32).reshape(-1, DIM + 1)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["slice", "sums"])

    rows = only(docs, "text").mapInArrow(add_up, schema).repartition("slice").mapInArrow(merge, "slice int, sums binary").collect()  # a table of fixed size
    each = vocabulary // SLICES
    vectors, seen = np.zeros((vocabulary, DIM)), np.zeros(vocabulary)
    for r in rows:
        x = np.frombuffer(bytes(r.sums)).reshape(each, DIM + 1)
        vectors[r.slice * each : (r.slice + 1) * each] = x[:, :DIM]
        seen[r.slice * each : (r.slice + 1) * each] = x[:, DIM]
    for t in range(NONZEROS):
        vectors[np.arange(vocabulary), place[:, t]] += sign[:, t] * np.maximum(seen, 1) * 2 * REACH
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    if seen.sum():
        vectors -= (seen[:, None] * vectors).sum(axis=0) / seen.sum()
    return vectors.astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """The mean of the words' vectors of each text, with the mean's length, the share of words that repeat
    the one before, and log(1 + words); zeros without words. The mean of varied words is short."""
    out = np.zeros((len(texts), FEATURES), dtype=np.float32)
    for a, b, bucket, at in buckets_of(texts, len(vectors)):
        n = np.diff(at)
        full = np.flatnonzero(n)
        if not len(full):
            continue
        mean = np.add.reduceat(vectors[bucket], at[full], axis=0) / n[full, None]
        again = np.zeros(len(bucket))
        again[1:] = bucket[1:] == bucket[:-1]
        out[a + full] = np.column_stack([mean, np.linalg.norm(mean, axis=1), np.add.reduceat(again, at[full]) / n[full], np.log1p(n[full])])
    return out


@dataclass
class Network:
    """score = sigmoid((tanh(((x - mean) / scale) a + b) c + d) / temperature)."""

    mean: np.ndarray
    scale: np.ndarray
    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.a + self.b) @ self.c + self.d

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -60, 60)))


def constant(share: float) -> Network:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Network(np.zeros(FEATURES), np.ones(FEATURES), np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4) -> Network:
    """Adam on the cross-entropy; every fifth row is kept aside for the temperature."""
    if len(y) < 10 or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(7)
    order = rng.permutation(len(y))
    x, y = x[order].astype(np.float64), y[order].astype(np.float64)
    aside = np.arange(len(y)) % 5 == 0
    net = Network(x.mean(axis=0), x.std(axis=0) + 1e-6, rng.normal(0, FEATURES**-0.5, (FEATURES, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0)
    z, t = (x[~aside] - net.mean) / net.scale, y[~aside]
    held = [net.a, net.b, net.c, np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in held], [np.zeros_like(p) for p in held], 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(t)), max(1, len(t) // 128)):
            h = np.tanh(z[rows] @ held[0] + held[1])
            g = (1 / (1 + np.exp(-np.clip(h @ held[2] + held[3], -60, 60))) - t[rows]) / len(rows)
            gh = np.outer(g, held[2]) * (1 - h * h)
            step += 1
            for i, grad in enumerate((z[rows].T @ gh + decay * held[0], gh.sum(axis=0), h.T @ g + decay * held[2], np.array([g.sum()]))):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                held[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net.a, net.b, net.c, net.d = held[0], held[1], held[2], float(held[3][0])
    logits, labels = net.logits(x[aside]), y[aside]

    def loss(temperature: float) -> float:
        q = logits / temperature
        return float(np.mean(np.logaddexp(0, q) - labels * q))

    net.temperature = min(np.exp(np.linspace(np.log(0.25), np.log(8), 141)), key=loss)
    return net


def remainder(doc_id) -> F.Column:
    """crc32 of doc_id as text, modulo 3."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def labelled_sample(labels: DataFrame, mark: str, sample: int) -> DataFrame:
    """At most `sample` rows (__id, y) outside the held-out third, in the order of a hash of doc_id."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(mark).isNotNull()).where(remainder("doc_id") != 1)
    one = usable.groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.min(mark).cast("double").alias("y"))
    return one.orderBy(F.xxhash64("__id"), "__id").limit(sample)


def train(docs: DataFrame, labels: DataFrame, mark: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Word vectors of all documents, and the network fitted on the sample's rows."""
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    chosen = labelled_sample(labels, mark, sample)

    def pool(batches):
        for batch in batches:
            x = pooled(_bytes(batch.column("text")), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "y", "x"])

    rows = only(docs, "doc_id", "text").withColumn("__id", F.col("doc_id").cast("long")).join(F.broadcast(chosen), "__id").select("__id", "y", "text")
    one = rows.mapInArrow(pool, "id long, y double, x binary").groupBy("id", "y").agg(F.min("x").alias("x"))  # of rows of equal doc_id the least
    got = sorted((r.id, bytes(r.x), r.y) for r in one.collect())
    x = np.frombuffer(b"".join(r[1] for r in got), dtype=np.float32).reshape(-1, FEATURES)
    return vectors, fit(x, np.array([r[2] for r in got]))


def with_scores(docs: DataFrame, vectors: np.ndarray, net: Network, name: str = "score") -> DataFrame:
    """docs and their score, row by row: no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))
    from pyspark.sql.types import DoubleType, StructField, StructType

    def run(batches):
        vectors, net = shared.value
        for batch in batches:
            score = net.scores(pooled(_bytes(batch.column("text")), vectors))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    vectors, net = train(docs, labels)
    scored = with_scores(only(docs, "doc_id", "text"), vectors, net)
    held_out = F.coalesce(remainder("doc_id") == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score 0.5 or more; the same columns."""
    vectors, net = train(docs, labels)
    score = free_name(docs, "score")
    return with_scores(docs, vectors, net, score).where(F.col(score) >= 0.5).drop(score)
